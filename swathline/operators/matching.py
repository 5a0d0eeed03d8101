"""Joins between clouds by exact, near or nearest time, and by place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .partners import nearest, partners, timed
from .range_join import range_join


def single_times(cloud: DataFrame, values: list[str], keys: list[str] = (), t: str = "t") -> DataFrame:
    """Times that occur once, with their values."""
    rows = cloud.groupBy(*keys, t).agg(F.count(F.lit(1)).alias("_n"), *(F.first(v).alias(v) for v in values))
    return rows.where("_n = 1").drop("_n")


def time_errors(reference: DataFrame, target: DataFrame, axes: list[str], keys: list[str] = (), t: str = "t") -> DataFrame:
    """Differences target - reference at times that are single in both, and their length e."""
    r = single_times(reference, axes, keys, t).select(*keys, t, *(F.col(a).alias(f"r_{a}") for a in axes))
    rows = single_times(target, axes, keys, t).join(r, [*keys, t])
    rows = rows.withColumns({f"d{a}": F.col(a) - F.col(f"r_{a}") for a in axes})
    return rows.withColumn("e", F.sqrt(sum(F.col(f"d{a}") * F.col(f"d{a}") for a in axes)))


def match_counts(reference: DataFrame, target: DataFrame, keys: list[str] = (), t: str = "t") -> DataFrame:
    """How the times of two clouds meet: rows, repeated times left out, times of one side alone, matches."""
    side = lambda df, n: df.groupBy(*keys, t).agg(F.count(F.lit(1)).alias(n))
    rows = side(reference, "nr").join(side(target, "nt"), [*keys, t], "full")
    one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    count = lambda c: F.count_if(c)
    cols = {
        "n_ref": F.coalesce(F.sum("nr"), F.lit(0)), "n_tgt": F.coalesce(F.sum("nt"), F.lit(0)), "ref_dup": count(F.coalesce(F.col("nr") > 1, F.lit(False))), "tgt_dup": count(F.coalesce(F.col("nt") > 1, F.lit(False))),
        "ref_unique": count(one("nr")), "tgt_unique": count(one("nt")), "only_ref": count(one("nr") & ~one("nt")), "only_tgt": count(one("nt") & ~one("nr")), "n_match": count(one("nr") & one("nt")),
    }
    return rows.groupBy(*keys).agg(*(c.alias(n) for n, c in cols.items()))


def unique_lookup(queries: DataFrame, cloud: DataFrame, tolerance: float, width: float, query_id: str, at: str, t: str = "t") -> tuple[DataFrame, DataFrame]:
    """Rows of a cloud within a tolerance (exclusive) of each query's time where there is exactly one, and the number of
    candidates of every query."""
    spans = queries.withColumns({"_lo": F.col(at) - tolerance, "_hi": F.col(at) + tolerance})
    met = range_join(cloud, spans, t, "_lo", "_hi", width, closed="none").drop("_lo", "_hi")
    counts = met.groupBy(query_id).agg(F.count(F.lit(1)).alias("n"))
    counts = queries.select(query_id).join(counts, query_id, "left").select(query_id, F.coalesce("n", F.lit(0)).alias("n"))
    return met.join(counts.where("n = 1").select(query_id), query_id, "left_semi"), counts


def reproject(queries: DataFrame, cloud: DataFrame, tolerance: float, distance: float, width: float, query_id: str, axes: list[str], order: str, t: str = "t", at: str = "q_t") -> DataFrame:
    """Each query's nearest point in space among those within a time tolerance (exclusive), if nearer than `distance`;
    the least `order` on ties.  Query coordinates are q_<axis>."""
    spans = queries.withColumns({"_lo": F.col(at) - tolerance, "_hi": F.col(at) + tolerance})
    met = partners(*timed(spans, cloud, at, t, tolerance, width), nearest([(f"q_{a}", a) for a in axes], t, tolerance, distance), [order])
    met = met.drop("_lo", "_hi")
    d = F.sqrt(sum(F.pow(F.col(a) - F.col(f"q_{a}"), 2) for a in axes))
    met = met.withColumn("dist", d).where(F.col("dist") < distance)
    rest = [c for c in met.columns if c != query_id]
    best = met.groupBy(query_id).agg(F.min_by(F.struct(*rest), F.struct("dist", order)).alias("_b"))
    return best.select(query_id, *(F.col(f"_b.{c}").alias(c) for c in rest))


def nearest_in_time(marks: DataFrame, cloud: DataFrame, tolerance: float, width: float, mark_id: str, at: str, order: list[str], t: str = "t") -> DataFrame:
    """For each mark the row of the cloud nearest in time, nearer than the tolerance; nulls where there is none."""
    spans = marks.select(mark_id, at).withColumns({"_lo": F.col(at) - tolerance, "_hi": F.col(at) + tolerance})
    met = partners(*timed(spans, cloud, at, t, tolerance, width), nearest([(at, t)], t, tolerance), order)
    met = met.drop("_lo", "_hi").withColumn("dt", F.abs(F.col(t) - F.col(at)))
    rest = [c for c in met.columns if c not in (mark_id, at)]
    best = met.groupBy(mark_id).agg(F.min_by(F.struct(*rest), F.struct("dt", *order)).alias("_b"))
    return marks.join(best, mark_id, "left").select(*marks.columns, *(F.col(f"_b.{c}").alias(c) for c in rest))


def nearest_reference(marks: DataFrame, cloud: DataFrame, tolerance: float, farthest: float, width: float, mark_id: str, at: str, axes: list[str], order: list[str], t: str = "t") -> DataFrame:
    """For each mark the point nearest in space within a time tolerance (exclusive), no farther than `farthest`; nulls where
    there is none."""
    spans = marks.withColumns({"_lo": F.col(at) - tolerance, "_hi": F.col(at) + tolerance})
    spans = spans.select(mark_id, F.col(at).alias("_at"), "_lo", "_hi", *(F.col(a).alias(f"m_{a}") for a in axes))
    met = partners(*timed(spans, cloud, "_at", t, tolerance, width), nearest([(f"m_{a}", a) for a in axes], t, tolerance, farthest), order)
    met = met.withColumn("dist", F.sqrt(sum(F.pow(F.col(a) - F.col(f"m_{a}"), 2) for a in axes)))
    best = met.groupBy(mark_id).agg(F.min_by(F.struct("dist", t, *(F.col(a).alias(f"ref_{a}") for a in axes)), F.struct("dist", *order)).alias("_b"))
    best = best.where(F.col("_b.dist") <= farthest)
    return marks.join(best, mark_id, "left").select(*marks.columns, F.col("_b.dist").alias("dist"), F.col(f"_b.{t}").alias("ref_t"), *(F.col(f"_b.ref_{a}").alias(f"ref_{a}") for a in axes))


def density(marks: DataFrame, cloud: DataFrame, radius: float, dz: float, mark_id: str, keys: list[str] = ()) -> DataFrame:
    """Points in the upright cylinder about each mark (mx, my, mz), of the mark's own file if keys name it, and their
    number per area.  Marks meet points in grid cells of the radius."""
    m = marks.withColumn("_dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("_dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    m = m.withColumns({"cx": scalars.cell(F.col("mx"), 0, radius) + F.col("_dx"), "cy": scalars.cell(F.col("my"), 0, radius) + F.col("_dy")}).drop("_dx", "_dy")
    p = cloud.withColumns({"cx": scalars.cell(F.col("x"), 0, radius), "cy": scalars.cell(F.col("y"), 0, radius)})
    met = m.join(p, [*keys, "cx", "cy"])
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    met = met.where((F.abs(F.col("z") - F.col("mz")) < dz) & (dx * dx + dy * dy <= radius * radius))
    n = met.groupBy(mark_id).agg(F.count(F.lit(1)).alias("n"))
    out = marks.join(n, mark_id, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("density", scalars.cylinder_density(F.col("n"), radius))


def vector_errors(vectors: DataFrame, nominal: DataFrame, outage: DataFrame) -> DataFrame:
    """Laser vectors joined to nominal errors on time_a, then to outage errors on both times where there are any."""
    return vectors.join(nominal, "time_a").join(outage, ["time_a", "time_b"], "left")


def swap_sides(df: DataFrame, stems: list[str]) -> DataFrame:
    """Exchange the _a and _b columns of the given stems."""
    swap = {f"{s}_a": f"{s}_b" for s in stems} | {f"{s}_b": f"{s}_a" for s in stems}
    return df.select(*(F.col(swap.get(c, c)).alias(c) for c in df.columns))


def compared(first: DataFrame, second: DataFrame, on: list[str], prefixes: tuple[str, str]) -> DataFrame:
    """Two tables of the same marks side by side: all of the first, other columns under their table's prefix."""
    side = lambda df, p: df.select(*on, *(F.col(c).alias(f"{p}{c}") for c in df.columns if c not in on))
    return side(first, prefixes[0]).join(side(second, prefixes[1]), on, "left")
