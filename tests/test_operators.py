"""Operators on small inputs with known answers, and against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from swathline.functions import rotations as rot
from swathline.operators import calibration, chunking, clouds, footprint, matching, metrics, neighbours, ordered, pairs, patches
from swathline.operators import trajectory as trj
from swathline.operators.range_join import interval_join, range_join


def listed(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("closed", ["left", "right", "both", "none"])
def test_range_join_brute_force(spark, closed):
    r = random.Random(3)
    pts = [(i, float(r.randint(-50, 1000))) for i in range(300)]
    iv = [(k, float(a), float(a + w)) for k, (a, w) in enumerate((r.randint(-40, 900), r.choice([0, 1, 5, 80, 700])) for _ in range(40))]
    ok = {"left": lambda p, a, b: a <= p < b, "right": lambda p, a, b: a < p <= b, "both": lambda p, a, b: a <= p <= b, "none": lambda p, a, b: a < p < b}[closed]
    got = range_join(spark.createDataFrame(pts, "i int, p double"), spark.createDataFrame(iv, "k int, a double, b double"), "p", "a", "b", 3.0, closed=closed)
    assert listed(got, "i", "k") == sorted((i, k) for i, p in pts for k, a, b in iv if ok(p, a, b))


def test_range_join_left_and_empty(spark):
    pts, iv = spark.createDataFrame([(1, 0.5), (2, 9.0)], "i int, p double"), spark.createDataFrame([(7, 0.0, 1.0)], "k int, a double, b double")
    assert listed(range_join(pts, iv, "p", "a", "b", 1.0, how="left"), "i", F.coalesce("k", F.lit(-1))) == [(1, 7), (2, -1)]
    assert range_join(pts, iv.limit(0), "p", "a", "b", 1.0).count() == 0
    null = spark.createDataFrame([(None, 0.5), (None, None), (3, 5.0)], "i int, p double")
    assert range_join(null, iv, "p", "a", "b", 1.0, how="left").count() == 3


def test_interval_join(spark):
    r = random.Random(5)
    mk = lambda n: [(i, float(a), float(a + r.randint(0, 60))) for i, a in ((i, r.randint(0, 500)) for i in range(n))]
    a, b = mk(40), mk(40)
    got = interval_join(spark.createDataFrame(a, "i int, a double, b double"), spark.createDataFrame(b, "j int, c double, d double"), ("a", "b"), ("c", "d"), 25.0)
    assert listed(got, "i", "j") == sorted((i, j) for i, x, y in a for j, c, d in b if min(y, d) > max(x, c))


def test_interpolation(spark):
    t = spark.createDataFrame([(0.0, 0.0), (1.0, 10.0), (2.0, 20.0)], "t double, x double")
    p = spark.createDataFrame([(0.5,), (2.0,), (3.0,), (-1.0,)], "t double")
    assert listed(trj.interpolate(p, t, ["x"], 1.0, 1.5), "t", "trj_x") == [(-1.0, 0.0), (0.5, 5.0), (2.0, 20.0), (3.0, 20.0)]
    assert listed(trj.interpolate(p, t, ["x"], 1.0, 1.5, clamp=False), "t", "trj_x") == [(0.5, 5.0), (2.0, 20.0)]


def test_path_length_across_blocks(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 3.0, 4.0), (5.0, 3.0, 10.0)], "t double, x double, y double")
    assert listed(ordered.path_length(rows, "t", ("x", "y"), 2.0), "t", "s") == [(0.0, 0.0), (1.0, 5.0), (5.0, 11.0)]


@pytest.mark.parametrize(("hi", "least", "want"), [(40, 10, [0, 15, 30, 40]), (35, 10, [0, 15, 35]), (45, 10, [0, 15, 30, 45]), (15, 10, [0, 15]), (10, 10, [0, 10]), (0, 10, [0, 0]), (16, 10, [0, 16])])
def test_chunk_edges(spark, hi, least, want):
    row = spark.range(1).select(chunking.edges(F.lit(0.0), F.lit(float(hi)), 15.0, float(least))).first()[0]
    assert row == pytest.approx([float(x) for x in want])


def test_chunk_points_edges(spark):
    t = spark.createDataFrame([(1, float(i), float(i * 10), 0.0) for i in range(5)], "scan_id int, t double, x double, y double")
    p = spark.createDataFrame([(1, 0.0), (1, 1.5), (1, 1.49), (1, 3.9), (1, 4.0), (2, 1.0)], "scan_id int, t double")
    got = chunking.chunk_points(p, t.drop("scan_id"), 15.0, 10.0, 100.0, 1.0, ["scan_id"])
    assert listed(got, "scan_id", "t", "chunk_k") == [(1, 0.0, 0), (1, 1.49, 0), (1, 1.5, 1), (1, 3.9, 2)]
    assert chunking.least_last(15.0) == 10.0


def test_slices(spark):
    scans = spark.createDataFrame([(1, 0.0, 10.0), (2, 10.0, 20.0)], "scan_id int, t_start double, t_end double")
    p = spark.createDataFrame([(5.0,), (10.0,), (10.1,), (25.0,), (-3.0,)], "t double")
    assert listed(clouds.slice_onto_scans(p, scans, 10.0), "t", "slice_scan") == [(-3.0, 1), (5.0, 1), (10.0, 1), (10.1, 2), (25.0, 2)]
    with pytest.raises(ValueError):
        clouds.slices(spark.createDataFrame([(1, 0.0, 10.0), (2, 1.0, 5.0)], scans.schema))


def test_crossing_margin(spark):
    far = lambda gap: spark.createDataFrame([(i, float(i), x, x + 1, 0.0, 1.0) for i, x in ((0, 0.0), *((k, 500.0 + 10 * k) for k in range(1, 12)), (12, 1.0 + gap))], "chunk int, t_start double, x_min double, x_max double, y_min double, y_max double")
    assert listed(pairs.crossings(far(3.0), 10, 3.0, 4.0), "a", "b") == [(0, 12)]
    assert listed(pairs.crossings(far(3.1), 10, 3.0, 4.0), "a", "b") == []


def test_crossings_brute_force(spark):
    r = random.Random(1)
    b = [(i, float(i), *(v for _ in "xy" for v in sorted((r.uniform(0, 60), r.uniform(0, 60))))) for i in range(60)]
    got = listed(pairs.crossings(spark.createDataFrame(b, "chunk int, t_start double, x_min double, x_max double, y_min double, y_max double"), 5, 2.0, 7.0), "a", "b")
    want = sorted((i[0], j[0]) for i in b for j in b if j[0] - i[0] > 5 and all(i[k] - 2 <= j[k + 1] and j[k] - 2 <= i[k + 1] for k in (2, 4)))
    assert got == want


def test_exact_time_errors(spark):
    ref = spark.createDataFrame([(1, 0.0), (2, 0.0), (2, 5.0), (3, 0.0)], "t int, x double")
    tgt = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, -2.0), (4, 0.0)], "t int, x double")
    assert listed(matching.time_errors(ref, tgt, ["x"]), "t", "e") == [(1, 1.0), (3, 2.0)]
    c = matching.match_counts(ref, tgt).first().asDict()
    assert c == {"n_ref": 4, "n_tgt": 4, "ref_dup": 1, "tgt_dup": 0, "ref_unique": 2, "tgt_unique": 4, "only_ref": 0, "only_tgt": 2, "n_match": 2}


def test_smoothing_support(spark):
    rows = spark.createDataFrame([("m", i, float(i == 100)) for i in range(200)], "k string, i int, e double")
    got = listed(ordered.moving_average(rows, ["k"], ["i"], "e", 50, "s").where("s <> 0"), "i")
    assert got == [(i,) for i in range(76, 126)]
    odd = listed(ordered.moving_average(rows, ["k"], ["i"], "e", 5, "s").where("s <> 0"), "i")
    assert odd == [(i,) for i in range(98, 103)]


def test_day_shift(spark):
    p = spark.createDataFrame([("f", 120.0 + i) for i in range(5)], "file string, t double")
    t = spark.createDataFrame([(3 * 86400.0 + 242.0 + i,) for i in range(5)], "t double")
    row = clouds.day_shift(p, t, leap=18).first()
    assert row["day_shift"] == 3 and row["t"] >= 3 * 86400 + 120 + 18


def test_union_needs_equal_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(1, 2)], "x int, y int")
    with pytest.raises(ValueError):
        clouds.union_clouds(a, b)
    assert clouds.union_clouds(a, b, strict=False).count() == 2
    with pytest.raises(clouds.EmptyResult):
        clouds.required(a.where("x > 5"), "nothing")


def test_best_overlap_tie(spark):
    t = spark.createDataFrame([("t", 0.0, 10.0)], "target string, t_start double, t_end double")
    r = spark.createDataFrame([("b", 1, 5.0, 15.0), ("a", 0, -5.0, 5.0), ("c", 2, 10.0, 20.0)], "ref string, ref_pos int, r_start double, r_end double")
    assert listed(clouds.best_overlap(t, r, 5.0), "target", "ref", "overlap") == [("t", "a", 5.0)]


def test_neighbour_brute_force(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 0.01, (150, 3)), r.uniform(-40, 40, (50, 3)), [[500.0, 0, 0]]])
    pts = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, x double, y double, z double")
    got = {i: d for i, d in listed(neighbours.nearest_other(pts.where("i % 2 = 0"), pts, 0.01, ["x", "y", "z"], "i"), "i", "dist")}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) + np.diag([np.inf] * len(x))
    assert got == pytest.approx({i: float(d[i].min()) for i in range(0, len(x), 2)})
    alone = neighbours.nearest_other(pts.where("i = 0"), pts.where("i = 0"), 1.0, ["x"], "i").first()
    assert alone["dist"] is None


def test_rectangles_and_density(spark):
    p = spark.createDataFrame([(1, 5.0, 0.0), (2, 5.01, 0.0), (3, 0.0, 2.0), (4, 0.0, -2.5)], "i int, x double, y double")
    q = spark.createDataFrame([(9, 0.0, 0.0, 1.0, 0.0, 10.0, 4.0)], "patch_id int, cx double, cy double, dx double, dy double, length double, width double")
    assert listed(footprint.in_rectangles(p, q, 3.0), "patch_id", "i") == [(9, 1), (9, 3)]


def test_patches_of_a_strip():
    g = footprint.Grid(0.0, 10.0, 1.0, 60, 10)
    cells = np.array([(r, c) for r in range(10) for c in range(50)] + [(0, 55)])
    part = cells[patches.largest_component(cells)]
    assert len(part) == 500
    ring = patches.outline(part, g)
    assert abs(abs(patches.area(ring)) - 500) < 1e-9 and len(ring) == 5
    a, b = patches.axis_of(np.column_stack([part[:, 1] + 0.5, 10 - part[:, 0] - 0.5]))
    found = patches.series(ring, a, b, 10.0, 4.0, 10.0, lines=2, offset=2.0, search=1.0)
    assert [p["patch_id"] for p in found] == sorted(p["patch_id"] for p in found) and {p["line"] for p in found} == {0, 1}
    assert all(patches.within(p["ring"], ring) for p in found)
    size, _ = patches.longest(ring, a, b, 4.0)
    assert 30 <= size <= 50
    assert patches.longest(patches.rectangle(np.zeros(2), np.array([1.0, 0]), 1, 1), np.zeros(2), np.array([1.0, 0]), 5.0) == (0.0, 0.0)
    square = patches.rectangle(np.zeros(2), np.array([1.0, 0]), 2, 2)
    assert patches.intersects(square, square + 1.5) and not patches.intersects(square, square + 5)
    diagonal = np.array([(0, 0), (1, 1), (2, 2), (5, 5)])
    assert len(patches.largest_component(diagonal)) == 3


def test_outline_with_hole():
    g = footprint.Grid(0.0, 3.0, 1.0, 3, 3)
    cells = np.array([(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)])
    assert abs(abs(patches.area(patches.outline(cells, g))) - 9) < 1e-9


def test_mean_rotation(spark):
    names = [[f"m{i}{j}" for j in range(3)] for i in range(3)]
    a = spark.createDataFrame([(0.3 + d,) for d in (-0.01, 0.0, 0.01)], "a double")
    m = rot.body_to_ned(0.0, 0.0, F.col("a"))
    rows = a.select(*(rot.col(m[i][j]).alias(names[i][j]) for i in range(3) for j in range(3)))
    mean, std = calibration.mean_rotation(rows, names)
    want = calibration.exponential(np.array([0, 0, 0.3]))
    assert np.allclose(mean, want, atol=1e-9) and std[2] == pytest.approx(0.01 * (2 / 3) ** 0.5)
    assert calibration.orthogonality(rows, names).first()[0] < 1e-10


def test_lag_and_lever_arm():
    t = np.arange(2000)
    x = np.sin(t / 37) + 0.3 * np.sin(t / 11)
    assert calibration.lag(x[10:1500], x[:1490], 5.0) == pytest.approx(-50.0)
    new, half = calibration.lever_arm([((0.0, 0.0, 0.0), np.array([0.0, 1.0, 0.0])), ((0.0, 0.0, np.pi), np.array([0.0, -1.0, 0.0]))], np.array([0.1, 0.2, 0.3]))
    assert np.allclose(new, [1.1, 0.2, 0.3]) and np.allclose(half, 0)


def test_matcher(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0), (1, 1.0, 10.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0, 0.0)], "k int, t double, x double, y double, z double")
    b = spark.createDataFrame([(1, 5.0, 0.1, 0.0, 0.0), (1, 6.0, 50.0, 0.0, 0.0)], a.schema)
    got = pairs.match_clouds(a, b, ["k"], {"uncertainty_r": 1.0}).collect()
    assert [(r["k"], r["time_a"], r["time_b"]) for r in got] == [(1, 0.0, 5.0)] and got[0]["d_xyz"] == pytest.approx(0.1)
    assert pairs.nearest_matcher(pd.DataFrame(columns=["t", "x", "y", "z"]), pd.DataFrame(columns=["t", "x", "y", "z"]), {}).empty


def test_metrics_keep_empty_groups(spark):
    e = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "k string, e double")
    m = metrics.with_empty(metrics.summary(e, ["k"]), spark.createDataFrame([("a",), ("b",)], "k string"), ["k"])
    got = {r["k"]: (r["n"], r["rmse"], r["q50"]) for r in m.collect()}
    assert got["a"] == (2, pytest.approx(5**0.5), 2.0) and got["b"] == (0, None, None)
    one = metrics.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 10)
    assert listed(one, "bin", "n") == [(0, 2)]
    assert metrics.worst(e, "e", "k").first()["worst"] == "a"


def test_intensity(spark):
    p = spark.createDataFrame([("f", i, float(i)) for i in range(101)] + [("g", 0, 5.0)], "file string, i int, intensity double")
    got = {(r["file"], r["i"]): r["intensity_u16"] for r in clouds.normalize_intensity(p).collect()}
    assert got["f", 0] == got["f", 5] == 0 and got["f", 95] == got["f", 100] == 65535 and got["f", 50] == 32767 and got["g", 0] == 0


def test_blocks_change_nothing(spark):
    """Averages, runs and places are the same however a sequence is cut."""
    r = random.Random(4)
    rows = [(k, float(i * 3 + r.randint(0, 2)), r.choice([None, "a", "b"]), r.random()) for k in (1, 2, None) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, t double, s string, v double").repartition(3)
    one = lambda f: sorted(map(repr, f.collect()))
    for width in (1, 4, 7):
        want = one(ordered.moving_average(df, ["k"], ["t"], "v", width, "m").selectExpr("k", "t", "round(m, 9) m"))
        assert one(ordered.moving_average(df, ["k"], ["t"], "v", width, "m", 10.0, 16).selectExpr("k", "t", "round(m, 9) m")) == want
    by = {}
    for k, t, s, _ in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        held = by.setdefault(k, [])
        held.append((k, t, held[-1][2] + (held[-1][3] != s) if held else 1, s))
    got = sorted((tuple(x) for x in ordered.islands(df, "t", "s", "run", ["k"], 25.0).select("k", "t", "run").collect()), key=str)
    assert got == sorted((x[:3] for held in by.values() for x in held), key=str)
    assert one(ordered.islands(df, "t", "s", "run", ["k"])) == one(ordered.islands(df, "t", "s", "run", ["k"], 25.0))


def test_matcher_cells(monkeypatch):
    r = np.random.default_rng(2)
    monkeypatch.setattr(pairs, "PAIRS", 50)
    for reach in (0.3, 1.0, 50.0):
        p, q = r.uniform(-3, 3, (60, 3)), r.uniform(-3, 3, (45, 3))
        d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1))
        at, best = pairs._nearest(p, q, reach)
        near = d.min(1) <= reach
        assert (at[near] == d.argmin(1)[near]).all() and (at[~near] == -1).all() and np.allclose(best[near], d.min(1)[near])
        frame = lambda x: pd.DataFrame({"t": np.arange(len(x)) * 1.0, **dict(zip("xyz", x.T, strict=True))})
        every, some = pairs.nearest_matcher(frame(p), frame(q), {}), pairs.nearest_matcher(frame(p), frame(q), {"uncertainty_r": reach})
        assert len(some) == (every["d_xyz"] <= reach).sum()
