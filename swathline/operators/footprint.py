"""Raster footprints of flights and where they overlap, as sparse cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import flight_pairs


@dataclass(frozen=True)
class Grid:
    """x grows from x0 to the right, rows grow downwards from y0."""

    x0: float
    y0: float
    res: float
    ncol: int
    nrow: int


def bounds(points: DataFrame) -> DataFrame:
    """One row: least and greatest finite x and y."""
    ok = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    return points.agg(*(f(ok(c)).alias(f"{c}_{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))))


def grid(extent, res: float, buffer: float = 0.0) -> Grid:
    """A grid over bounds, widened by a buffer."""
    import math

    x0, x1, y0, y1 = extent["x_min"] - buffer, extent["x_max"] + buffer, extent["y_min"] - buffer, extent["y_max"] + buffer
    return Grid(x0, y1, res, math.floor((x1 - x0) / res) + 1, math.floor((y1 - y0) / res) + 1)


def rasterize(points: DataFrame, g: Grid, keys: list[str] = ("flight",), t: str = "t") -> DataFrame:
    """(keys, row, col, tmin, tmax, n) of the cells that hold a point; points off the grid are left out."""
    row = F.floor((F.lit(g.y0) - F.col("y")) / g.res).cast("int")
    column = F.floor((F.col("x") - F.lit(g.x0)) / g.res).cast("int")
    rows = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)").withColumns({"row": row, "col": column})
    rows = rows.where(F.col("row").between(0, g.nrow - 1) & F.col("col").between(0, g.ncol - 1))
    return rows.groupBy(*keys, "row", "col").agg(F.min(t).alias("tmin"), F.max(t).alias("tmax"), F.count(F.lit(1)).alias("n"))


def overlap_cells(footprint: DataFrame, mode: str = "all", key: str = "flight") -> DataFrame:
    """(fi, fj, row, col, and both time ranges) of the cells that two flights share."""
    pairs = flight_pairs(footprint.select(key).distinct(), mode, key)
    side = lambda s: footprint.select(F.col(key).alias(f"f{s}"), "row", "col", F.col("tmin").alias(f"tmin_{s}"), F.col("tmax").alias(f"tmax_{s}"))
    both = side("i").join(side("j"), ["row", "col"]).where("fi < fj")
    return both if mode == "all" else both.join(F.broadcast(pairs), ["fi", "fj"], "left_semi")


def overlap_windows(cells: DataFrame) -> DataFrame:
    """Time windows of each pair over the cells it shares."""
    return cells.groupBy("fi", "fj").agg(
        F.min("tmin_i").alias("tmin_i"), F.max("tmax_i").alias("tmax_i"), F.min("tmin_j").alias("tmin_j"), F.max("tmax_j").alias("tmax_j"), F.count(F.lit(1)).alias("n_cells")
    )


def valid_windows(windows: DataFrame) -> DataFrame:
    """Windows that are finite and not empty on both sides."""
    keep = F.lit(True)
    for s in "ij":
        keep &= F.coalesce(F.col(f"tmin_{s}") < F.col(f"tmax_{s}"), F.lit(False))
    return windows.where(keep)


def extract_windows(points: DataFrame, windows: DataFrame, key: str = "flight", t: str = "t") -> DataFrame:
    """The points of each flight in its time window of each pair, every flight read once."""
    per = windows.select(F.explode(F.array(*(F.struct(F.col(f"f{s}").alias(key), F.col(f"tmin_{s}").alias("lo"), F.col(f"tmax_{s}").alias("hi"), F.col("fi"), F.col("fj")) for s in "ij"))).alias("w")).select("w.*")
    return points.join(per, key).where(F.col(t).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def extract_overlaps(points: DataFrame, cells: DataFrame, g: Grid, key: str = "flight", t: str = "t") -> DataFrame:
    """The points of each flight that lie in a cell shared with another one and in the pair's time window: a narrower cut
    than extract_windows()."""
    side = lambda s: cells.select("fi", "fj", F.col(f"f{s}").alias(key), "row", "col", F.col(f"tmin_{s}").alias("_lo"), F.col(f"tmax_{s}").alias("_hi"))
    both = side("i").unionByName(side("j"))
    window = both.groupBy("fi", "fj", key).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    both = both.select("fi", "fj", key, "row", "col").join(window, ["fi", "fj", key])
    put = points.withColumns({"row": F.floor((F.lit(g.y0) - F.col("y")) / g.res).cast("int"), "col": F.floor((F.col("x") - F.lit(g.x0)) / g.res).cast("int")})
    return put.join(both, [key, "row", "col"]).where(F.col(t).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi", "row", "col")


def crop(points: DataFrame, x: tuple[float, float], y: tuple[float, float]) -> DataFrame:
    """Points in a box, borders included."""
    return points.where(F.col("x").between(*x) & F.col("y").between(*y))


def in_rectangles(points: DataFrame, patches: DataFrame, size: float) -> DataFrame:
    """Points in rotated rectangles (patch_id, cx, cy, dx, dy, length, width), borders included.  Rectangles meet
    points in grid cells of the given size."""
    half = F.sqrt(F.col("length") * F.col("length") + F.col("width") * F.col("width")) / 2
    cells = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("_r")) / size).cast("long"), F.floor((F.col(c) + F.col("_r")) / size).cast("long")))
    put = patches.withColumn("_r", half).withColumn("_gx", cells("cx")).withColumn("_gy", cells("cy"))
    pts = points.withColumns({"_gx": F.floor(F.col("x") / size).cast("long"), "_gy": F.floor(F.col("y") / size).cast("long")})
    met = pts.join(put, ["_gx", "_gy"])
    n = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    c, s = F.col("dx") / n, F.col("dy") / n
    ex, ey = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    u, v = ex * c + ey * s, ey * c - ex * s
    return met.where((F.abs(u) <= F.col("length") / 2) & (F.abs(v) <= F.col("width") / 2)).select("patch_id", *points.columns)


def principal_axis(cells: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Centre, unit direction (pointing right, or up) and extent of each group's cells along their principal axis; groups
    of fewer than two cells are left out."""
    rows = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("cxx"), F.var_pop(y).alias("cyy"), F.covar_pop(x, y).alias("cxy")).where("n >= 2")
    theta = F.atan2(2 * F.col("cxy"), F.col("cxx") - F.col("cyy")) / 2
    rows = rows.select(*keys, "n", "mx", "my", F.cos(theta).alias("ax"), F.sin(theta).alias("ay"))
    proj = (F.col(x) - F.col("mx")) * F.col("ax") + (F.col(y) - F.col("my")) * F.col("ay")
    ends = cells.join(rows, list(keys)).groupBy(*keys).agg(F.min(proj).alias("s_min"), F.max(proj).alias("s_max"))
    return rows.join(ends, list(keys))


def centreline(axes: DataFrame, keys: list[str], points: int = 100) -> DataFrame:
    """Evenly spaced points of each axis."""
    rows = axes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    s = F.col("s_min") + (F.col("s_max") - F.col("s_min")) * F.col("i") / (points - 1)
    return rows.select(*keys, "i", (F.col("mx") + s * F.col("ax")).alias("x"), (F.col("my") + s * F.col("ay")).alias("y"))
