"""Cutting scans into chunks, along the path or along a straight axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import next_row, path_length
from .range_join import range_join
from .trajectory import interpolate


def edges(lo: Column, hi: Column, length: float, least_last: float) -> Column:
    """Chunk edges from lo to hi as an array: every `length`, then hi; a last chunk shorter than `least_last`
    joins the one before, if there is one."""
    total = hi - lo
    n = F.ceil(total / length).cast("int")  # edges below hi
    starts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: lo + i * F.lit(float(length)))
    starts = F.filter(starts, lambda x: x < hi)
    short = (F.size(starts) >= 2) & (hi - F.element_at(starts, -1) < least_last)
    starts = F.when(short, F.slice(starts, 1, F.size(starts) - 1)).otherwise(starts)
    return F.when(total <= length, F.array(lo, hi)).otherwise(F.concat(starts, F.array(hi)))


def even_edges(lo: Column, hi: Column, length: float) -> Column:
    """Edges of text clouds' chunks: every `length` from lo, then hi; a short last chunk stays one of its own."""
    n = F.greatest(F.ceil((hi - lo) / length).cast("int"), F.lit(1))
    return F.concat(F.transform(F.sequence(F.lit(0), n - 1), lambda i: lo + i * F.lit(float(length))), F.array(hi))


def least_last(length: float) -> float:
    """The default for the shortest last chunk."""
    return round(2 * length / 3, 2)


def edge_rows(extents: DataFrame, lo: str, hi: str, length: float, least: float, keys: list[str]) -> DataFrame:
    """(keys, chunk_k, s_lo, s_hi): the chunks of each extent."""
    e = F.col("_e")
    rows = extents.select(*keys, edges(F.col(lo), F.col(hi), length, least).alias("_e"))
    return rows.select(*keys, "_e", F.explode(F.sequence(F.lit(0), F.size("_e") - 2)).alias("chunk_k")).select(*keys, "chunk_k", e[F.col("chunk_k")].alias("s_lo"), e[F.col("chunk_k") + 1].alias("s_hi"))


def chunk_intervals(path: DataFrame, length: float, least: float, block: float, keys: list[str] = (), t: str = "t", s: str = "s") -> DataFrame:
    """(keys, chunk_k, t_lo, t_hi): chunks of a path (t, s) as time intervals, by the time at which it passes each
    edge; where it stands still on an edge, the first such time."""
    keys = list(keys)
    ends = path.groupBy(*keys).agg(F.min(s).alias("_lo"), F.max(s).alias("_hi"), F.min(t).alias("_t0"), F.max(t).alias("_t1"))
    marks = ends.select(*keys, "_t0", "_t1", F.posexplode(edges(F.col("_lo"), F.col("_hi"), length, least)).alias("k", "edge"))
    n = marks.groupBy(*keys).agg(F.max("k").alias("_last"))
    marks = marks.join(n, keys) if keys else marks.crossJoin(F.broadcast(n))
    steps = next_row(path.select(*keys, t, s), t, [s], block, keys).where(F.col(f"{s}_next") > F.col(s))
    steps = steps.select(*keys, F.col(t).alias("_ta"), F.col(f"{t}_next").alias("_tb"), F.col(s).alias("_sa"), F.col(f"{s}_next").alias("_sb"))
    inner = marks.where((F.col("k") > 0) & (F.col("k") < F.col("_last")))
    met = range_join(inner, steps, "edge", "_sa", "_sb", length, tuple(keys), closed="right")
    at = F.col("_ta") + (F.col("_tb") - F.col("_ta")) * (F.col("edge") - F.col("_sa")) / (F.col("_sb") - F.col("_sa"))
    times = met.select(*keys, "k", at.cast("double").alias("at"))
    outer = marks.where((F.col("k") == 0) | (F.col("k") == F.col("_last")))
    times = times.unionByName(outer.select(*keys, "k", F.when(F.col("k") == 0, F.col("_t0")).otherwise(F.col("_t1")).cast("double").alias("at")))
    upper = times.select(*keys, (F.col("k") - 1).alias("k"), F.col("at").alias("t_hi"))
    return times.withColumnRenamed("at", "t_lo").join(upper, [*keys, "k"]).select(*keys, F.col("k").alias("chunk_k"), "t_lo", "t_hi")


def chunk_points(points: DataFrame, trajectory: DataFrame, length: float, least: float, block: float, width: float, keys: list[str] = (), t: str = "t", xy: tuple[str, str] = ("x", "y"), min_points: int = 0) -> DataFrame:
    """Each point's chunk along the trajectory between the points' first and last times.

    Points before the first trajectory row in that range, or at or after the last, get no chunk and are left
    out; the last edge is exclusive.  Chunks of fewer than `min_points` are left out."""
    keys = list(keys)
    ends = points.groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    own = trajectory.crossJoin(F.broadcast(ends)) if not keys else range_join(trajectory, ends, t, "_a", "_b", max(width, 1), closed="both")
    own = own.where(F.col(t).between(F.col("_a"), F.col("_b"))).select(*keys, t, *xy)
    path = path_length(own, t, xy, block, keys).persist()  # read several times below; a row per pose
    chunks = chunk_intervals(path, length, least, block, keys, t).persist()  # a row per chunk
    out = range_join(points, chunks, t, "t_lo", "t_hi", width, tuple(keys)).drop("t_lo", "t_hi")
    if min_points > 1:
        full = out.groupBy(*keys, "chunk_k").count().where(F.col("count") >= min_points).drop("count")
        out = out.join(full, [*keys, "chunk_k"], "left_semi")
    return out


def axis(trajectory: DataFrame, keys: list[str], t: str = "t", xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """(keys, ox, oy, tx, ty): origin and unit direction from the first to the last row; null direction where they
    coincide."""
    first = F.min_by(F.struct(*xy), F.col(t))
    last = F.max_by(F.struct(*xy), F.col(t))
    rows = trajectory.groupBy(*keys).agg(first.alias("_f"), last.alias("_l"))
    dx, dy = (F.col("_l")[c] - F.col("_f")[c] for c in xy)
    n = F.sqrt(dx * dx + dy * dy)
    n = F.when(n >= 1e-6, n)
    return rows.select(*keys, F.col("_f")[xy[0]].alias("ox"), F.col("_f")[xy[1]].alias("oy"), (dx / n).alias("tx"), (dy / n).alias("ty"))


def project(points: DataFrame, axes: DataFrame, keys: list[str], xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Adds the distance along the axis."""
    proj = (F.col(xy[0]) - F.col("ox")) * F.col("tx") + (F.col(xy[1]) - F.col("oy")) * F.col("ty")
    return points.join(axes, list(keys)).withColumn("proj", proj).select(*points.columns, "proj")


def chunk_by_axis(points: DataFrame, extents: DataFrame, length: float, least: float, keys: list[str]) -> DataFrame:
    """Each point's chunk by its projection (proj) within extents (keys, s_min, s_max); the last edge is exclusive."""
    rows = edge_rows(extents, "s_min", "s_max", length, least, list(keys))
    return range_join(points, rows, "proj", "s_lo", "s_hi", length, tuple(keys)).drop("s_lo", "s_hi")


def common_chunks(forward: DataFrame, backward: DataFrame, keys: list[str]) -> DataFrame:
    """Chunk numbers that both passes have."""
    return forward.select(*keys, "chunk_k").distinct().join(backward.select(*keys, "chunk_k").distinct(), [*keys, "chunk_k"])


def chunk_boxes(chunked: DataFrame, keys: list[str], t: str = "t", xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Bounding box and time range of each chunk's points."""
    x, y = xy
    return chunked.groupBy(*keys).agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"))


def trajectory_boxes(chunked: DataFrame, trajectory: DataFrame, keys: list[str], width: float, block: float, samples: int = 20, t: str = "t", xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Bounding box of each chunk from the trajectory at evenly spaced times of its points' range."""
    x, y = xy
    ends = chunked.groupBy(*keys).agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"))
    at = ends.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    at = at.withColumn(t, F.col("t_start") + (F.col("t_end") - F.col("t_start")) * F.col("_i") / (samples - 1))
    on = interpolate(at, trajectory.withColumn(t, F.col(t).cast("double")), [x, y], width, block, t)
    return on.groupBy(*keys, "t_start", "t_end").agg(F.min(f"trj_{x}").alias("x_min"), F.max(f"trj_{x}").alias("x_max"), F.min(f"trj_{y}").alias("y_min"), F.max(f"trj_{y}").alias("y_max"))
