"""Column functions against numpy and published values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline.functions import geodesy, scalars
from swathline.functions import rotations as rot


def values(spark, cols, data=((0.0,),), names=("a",)):
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], list(names))
    return np.array([list(r) for r in df.select(*(rot.col(c).alias(f"c{i}") for i, c in enumerate(cols))).collect()], dtype=float)


def flat(m):
    return [x for row in m for x in row]


def numpy_body_to_ned(r, p, y):
    c, s = np.cos, np.sin
    r1 = np.array([[1, 0, 0], [0, c(r), s(r)], [0, -s(r), c(r)]])
    r2 = np.array([[c(p), 0, -s(p)], [0, 1, 0], [s(p), 0, c(p)]])
    r3 = np.array([[c(y), s(y), 0], [-s(y), c(y), 0], [0, 0, 1]])
    return (r1 @ r2 @ r3).T


ANGLES = [(0.1, -0.2, 0.3), (0.0, 0.0, math.pi / 2), (1.2, 0.7, -2.9), (-3.0, 0.1, 3.1)]


def test_body_to_ned(spark):
    got = values(spark, flat(rot.body_to_ned(F.col("r"), F.col("p"), F.col("y"))), ANGLES, "rpy")
    for g, a in zip(got, ANGLES, strict=True):
        m = g.reshape(3, 3)
        assert np.allclose(m, numpy_body_to_ned(*a))
        assert np.abs(m @ m.T - np.eye(3)).max() < 1e-10
    assert np.allclose(got[1].reshape(3, 3) @ [1, 0, 0], [0, 1, 0])


def test_quaternions(spark):
    rpy = [F.col(c) for c in "rpy"]
    q = rot.matrix_to_quaternion(rot.body_to_ned(*rpy))
    back = values(spark, flat(rot.quaternion_to_matrix(q)), ANGLES, "rpy")
    for g, a in zip(back, ANGLES, strict=True):
        assert np.allclose(g.reshape(3, 3), numpy_body_to_ned(*a))
    same = values(spark, rot.quaternion_to_euler(rot.euler_to_quaternion(*rpy)), ANGLES[:3], "rpy")
    assert np.allclose(same, ANGLES[:3])
    plain = values(spark, rot.matrix_to_quaternion_by_trace(rot.body_to_ned(*rpy)), ANGLES[:2], "rpy")
    assert np.allclose(plain, values(spark, rot.euler_to_quaternion(*rpy), ANGLES[:2], "rpy"))
    unit = values(spark, rot.multiply(q, rot.inverse(q)), ANGLES, "rpy")
    assert np.allclose(np.abs(unit), [[1, 0, 0, 0]] * 4)


def test_slerp(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [math.cos(0.5), 0.0, 0.0, math.sin(0.5)]
    q = rot.slerp([rot.col(x) for x in a], [rot.col(-x) for x in b], F.col("u"))
    got = values(spark, q, [(0,), (0.5,), (1,)], "u")
    assert np.allclose(got, [[math.cos(h), 0, 0, math.sin(h)] for h in (0, 0.25, 0.5)])
    same = rot.slerp([rot.col(x) for x in a], [rot.col(x) for x in a], F.col("u"))
    assert np.allclose(values(spark, same, [(0.3,)], "u"), [a])
    assert values(spark, rot.normalized([rot.col(0.0)] * 4), [(0.3,)], "u").shape == (1, 4)


def test_rotation_vector_and_small_angle(spark):
    v = values(spark, rot.rotation_vector(rot.body_to_ned(0.0, 0.0, F.col("a"))), [(0.0,), (0.4,), (1e-9,)], "a")
    assert np.allclose(v, [[0, 0, 0], [0, 0, 0.4], [0, 0, 1e-9]])
    e = values(spark, rot.small_angle_error([rot.col(x) for x in (1.0, 0.0, 0.0, 0.0)], rot.euler_to_quaternion(F.col("a"), 0.0, 0.0)), [(math.radians(0.5),)], "a")
    assert abs(abs(e[0][0]) - 0.5) < 1e-4 and np.allclose(e[0][1:], 0)


def test_swiss_grid_example(spark):
    # the published worked example, whose input is rounded to 0.01 seconds of arc
    lat, lon = math.radians(46 + 2 / 60 + 38.87 / 3600), math.radians(8 + 43 / 60 + 49.79 / 3600)
    df = spark.createDataFrame([(lat, lon, 650.60)], "lat double, lon double, h double")
    ecef = df.select(*(c.alias(n) for c, n in zip(geodesy.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("h")), ("ex", "ey", "ez"), strict=True)))
    got = geodesy.with_swiss(ecef, ("ex", "ey", "ez"), ("e", "n", "h")).first()
    assert np.allclose([got["e"], got["n"]], [2_700_000, 1_100_000], atol=0.2) and abs(got["h"] - 600) < 0.05
    assert abs(geodesy.with_swiss(ecef, ("ex", "ey", "ez"), ("e", "n", "h"), "global").first()["h"] - 650.60) < 1e-6


def test_ecef_attitude(spark):
    from swathline.operators.trajectory import QUATERNION, with_ecef_attitude

    poses = [(0.8, 0.3, 0.1, -0.2, 0.4), (-0.5, -2.9, 0.0, 0.3, 3.0)]
    df = with_ecef_attitude(spark.createDataFrame(poses, "lat double, lon double, roll double, pitch double, heading double"))
    m = flat(rot.quaternion_to_matrix([F.col(c) for c in QUATERNION]))
    got = np.array([list(r) for r in df.select(*(c.alias(f"c{i}") for i, c in enumerate(m))).collect()])
    for g, (lat, lon, *rpy) in zip(got, poses, strict=True):
        local = np.array([[float(x) for x in row] for row in rot.ned_to_ecef(lat, lon)])
        assert np.allclose(g.reshape(3, 3), local @ numpy_body_to_ned(*rpy))


def test_geodetic_round_trip(spark):
    data = [(0.8, 0.1, 400.0), (-1.2, 3.0, 9000.0), (0.0, -2.0, -50.0), (1.5707, 1.0, 10.0)]
    back = values(spark, geodesy.ecef_to_geodetic(*geodesy.geodetic_to_ecef(F.col("a"), F.col("b"), F.col("c"))), data, "abc")
    assert np.allclose(back[:, :2], np.array(data)[:, :2], atol=1e-12) and np.allclose(back[:, 2], np.array(data)[:, 2], atol=1e-5)


def test_enu(spark):
    origin = geodesy.geodetic_to_ecef(F.lit(0.8), F.lit(0.1), F.lit(400.0))
    up = geodesy.ecef_to_enu(geodesy.geodetic_to_ecef(F.lit(0.8), F.lit(0.1), F.lit(425.0)), origin, 0.8, 0.1)
    assert np.allclose(values(spark, up), [[0, 0, 25]], atol=1e-6)


def test_names_and_scalars(spark):
    df = spark.createDataFrame([("101010_002000_x.las", "merged_3000_HA.las", "Patch_from_scan_7_with_3.las")], "a string, b string, c string")
    row = df.select(scalars.raw_scan_id(F.col("a")), scalars.merged_scan_id(F.col("b")), *scalars.pair_ids(F.col("c")), scalars.pair_key(F.lit(10), F.lit(9)), scalars.raw_scan_id(F.col("c"))).first()
    assert tuple(row) == (2000, 3000, 7, 3, "10_9", None)
    x = spark.createDataFrame([(0.0,), (9.999,), (10.0,), (30.0,), (None,)], "x double")
    assert [r[0] for r in x.select(scalars.range_bin(F.col("x"))).collect()] == ["[0,10)", "[0,10)", "[10,20)", None, None]
    assert scalars.uncertainty({"uncertainty_r": 1, "k": 2}, 0.5, 2) == {"k": 2, "uncertainty_r_min": 0.5, "uncertainty_r_max": 2.0}
    assert scalars.uncertainty({"uncertainty_r_min": 1}, scalar=3) == {"uncertainty_r": 3.0} and scalars.uncertainty({"a": 1}) == {"a": 1}
    nan = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1.0,)], "x double")
    assert [r[0] for r in nan.select(scalars.finite(F.col("x"))).collect()] == [False, False, False, True]
