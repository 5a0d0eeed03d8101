"""Joins of points with intervals, without comparing every pair.

Intervals are cut into buckets and points are put into one bucket each, so that the join is an equality on the
bucket; a remaining predicate makes it exact.  Interval lengths may differ by orders of magnitude: each
interval goes to the level whose buckets are wide enough for it to touch few of them, and points meet the
levels that are in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 4  # ratio of bucket widths between levels


def levels(intervals: DataFrame, lo: str, hi: str, width: float) -> list[int]:
    """The levels that the intervals use; at most a few dozen numbers."""
    rows = intervals.select(_level(F.col(lo), F.col(hi), width).alias("l")).distinct().where("l is not null")
    return sorted(r["l"] for r in rows.collect())


def _level(lo: Column, hi: Column, width: float) -> Column:
    span = F.greatest((hi - lo).cast("double"), F.lit(float(width)))
    return F.greatest(F.ceil(F.log(span / width) / F.log(F.lit(float(FAN))) - 1e-9), F.lit(0)).cast("int")


def range_join(
    points: DataFrame,
    intervals: DataFrame,
    at: str,
    lo: str,
    hi: str,
    width: float,
    keys: tuple[str, ...] = (),
    closed: str = "left",
    how: str = "inner",
) -> DataFrame:
    """Each point with the intervals that hold it.  closed: left [lo, hi), right (lo, hi], both or none.

    `width` is the narrowest bucket, best near the median interval length.  Columns of both sides other than
    `keys` must have different names.  With how="left", points in no interval come once, with nulls."""
    used = levels(intervals, lo, hi, width) or [0]
    scale = lambda level: F.pow(F.lit(float(FAN)), level) * float(width)
    marked = intervals.withColumn("_level", _level(F.col(lo), F.col(hi), width))
    size = scale(F.col("_level"))
    marked = marked.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(lo) / size).cast("long"), F.floor(F.col(hi) / size).cast("long"))))
    place = lambda level: F.struct(F.lit(level).alias("l"), F.floor(F.col(at) / float(width * FAN**level)).cast("long").alias("b"))
    ops = {
        "left": (F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi)),
        "right": (F.col(at) > F.col(lo)) & (F.col(at) <= F.col(hi)),
        "both": (F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi)),
        "none": (F.col(at) > F.col(lo)) & (F.col(at) < F.col(hi)),
    }
    if len(used) == 1:
        spread = points.withColumn("_e", place(used[0]))
    else:
        spread = points.withColumn("_e", F.explode(F.array(*map(place, used))))
    spread = spread.withColumns({"_level": F.col("_e.l"), "_bucket": F.col("_e.b")}).drop("_e")
    found = spread.join(marked, [*keys, "_level", "_bucket"]).where(ops[closed]).drop("_level", "_bucket")
    if how == "inner":
        return found
    seen = found.select(*(F.col(c).alias(f"_seen_{c}") for c in points.columns)).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_seen_{c}")) for c in points.columns]
    rest = points.join(seen, same, "left_anti")
    return found.unionByName(rest, allowMissingColumns=True)


def interval_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], width: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of intervals that share more than a point.  The bucket that decides is that of the later start, so
    every pair comes once."""
    (a, b), (c, d) = left_range, right_range
    buckets = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width).cast("long"), F.floor(F.col(hi) / width).cast("long")))
    both = left.withColumn("_bucket", buckets(a, b)).join(right.withColumn("_bucket", buckets(c, d)), [*keys, "_bucket"])
    start = F.greatest(F.col(a), F.col(c))
    return both.where((F.least(F.col(b), F.col(d)) > start) & (F.floor(start / width).cast("long") == F.col("_bucket"))).drop("_bucket")
