"""Trajectories: poses at the times of points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rotations as rot
from .ordered import first_of_each, next_row
from .range_join import range_join

QUATERNION = ("qw", "qx", "qy", "qz")


def unique_times(trajectory: DataFrame, t: str = "t", order: str = "point_idx", keys: list[str] = ()) -> DataFrame:
    """The first row of each time."""
    return first_of_each(trajectory, [*keys, t], [order])


def segments(trajectory: DataFrame, values: list[str], block: float, t: str = "t", keys: list[str] = ()) -> DataFrame:
    """Consecutive poses as intervals (t0, t1, each value v as v0 and v1).  The last pose is an empty segment."""
    rows = next_row(trajectory.select(*keys, t, *values), t, values, block, keys)
    cols = [F.col(t).alias("t0"), F.coalesce(f"{t}_next", t).alias("t1")]
    for v in values:
        cols += [F.col(v).alias(f"{v}0"), F.coalesce(F.when(F.col(f"{t}_next").isNotNull(), F.col(f"{v}_next")), F.col(v)).alias(f"{v}1")]
    return rows.select(*keys, *cols)


def interpolate(points: DataFrame, trajectory: DataFrame, values: list[str], width: float, block: float, t: str = "t", keys: list[str] = (), clamp: bool = True, attitude: bool = False) -> DataFrame:
    """Adds the values of the trajectory at each point's time, linear between poses.

    Outside the trajectory the end poses hold if `clamp`, else points are dropped.  `attitude` interpolates the
    quaternion columns spherically besides; outside the trajectory its end poses hold too."""
    q = list(QUATERNION) if attitude else []
    names = [*values, *q]
    parts = segments(trajectory, names, block, t, keys)
    ends = trajectory.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    rows = points.join(F.broadcast(ends), list(keys)) if keys else points.crossJoin(F.broadcast(ends))  # one row per trajectory
    rows = rows.withColumn("_at", F.least(F.greatest(F.col(t), "_lo"), "_hi") if clamp else F.col(t))
    if not clamp:
        rows = rows.where(F.col(t).between(F.col("_lo"), F.col("_hi")))
    last = F.col("t1") == F.col("t0")
    parts = parts.withColumn("_end", F.when(last, F.col("t1") + width * 1e-6 + (0 if dict(parts.dtypes)["t1"] == "double" else 1)).otherwise(F.col("t1")))
    met = range_join(rows, parts, "_at", "t0", "_end", width, tuple(keys))
    u = F.when(last, F.lit(0.0)).otherwise((F.col("_at") - F.col("t0")) / F.nullif(F.col("t1") - F.col("t0"), F.lit(0)))
    out = [(F.col(f"{v}0") + (F.col(f"{v}1") - F.col(f"{v}0")) * u).alias(f"trj_{v}") for v in values]
    if attitude:
        met = rot.with_slerp(met, [f"{c}0" for c in q], [f"{c}1" for c in q], u, [f"trj_{c}" for c in q])
        out += [F.col(f"trj_{c}") for c in q]
    return met.select(*points.columns, *out)


def with_ecef_attitude(trajectory: DataFrame) -> DataFrame:
    """Adds body-to-earth quaternions from lat, lon (radians) and roll, pitch, heading."""
    lat, lon = F.col("lat"), F.col("lon")
    # north-east-down to earth-fixed is a turn by lon about z, then by -lat - 90 degrees about y
    turn = [F.cos(lon / 2), F.lit(0.0), F.lit(0.0), F.sin(lon / 2)]
    tilt = [F.cos(lat / 2 + math.pi / 4), F.lit(0.0), -F.sin(lat / 2 + math.pi / 4), F.lit(0.0)]
    own = rot.euler_to_quaternion(F.col("roll"), F.col("pitch"), F.col("heading"))
    rows = trajectory.withColumns({f"_l{i}": c for i, c in enumerate(rot.multiply(turn, tilt))} | {f"_o{i}": c for i, c in enumerate(own)})
    q = rot.multiply([F.col(f"_l{i}") for i in range(4)], [F.col(f"_o{i}") for i in range(4)])
    return rows.withColumns(dict(zip(QUATERNION, q, strict=True))).drop(*(f"_{n}{i}" for n in "lo" for i in range(4)))


def compare(reference: DataFrame, other: DataFrame, compat: bool = False) -> DataFrame:
    """Per epoch of two trajectories on the same times: position error in local north-east-down of the reference
    and small-angle attitude error in degrees.  `compat` leaves the local frame untransposed."""
    a = reference.select("t", *(F.col(c).alias(f"r_{c}") for c in ("lat", "lon", "ex", "ey", "ez", *QUATERNION)))
    b = other.select("t", *(F.col(c).alias(f"o_{c}") for c in ("ex", "ey", "ez", *QUATERNION)))
    rows = a.join(b, "t")
    axes = rot.ned_to_ecef(F.col("r_lat"), F.col("r_lon"))
    d = [F.col(f"r_{c}") - F.col(f"o_{c}") for c in ("ex", "ey", "ez")]
    ned = rot.mat_vec(axes if compat else rot.transpose(axes), d)
    angle = rot.small_angle_error([F.col(f"r_{c}") for c in QUATERNION], [F.col(f"o_{c}") for c in QUATERNION])
    named = dict(zip(("d_north", "d_east", "d_down", "d_roll", "d_pitch", "d_yaw"), [*ned, *angle], strict=True))
    return rows.select("t", *(c.alias(n) for n, c in named.items()))
