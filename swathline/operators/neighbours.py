"""Nearest other point in space, by cells that grow until the answer is certain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_other(queries: DataFrame, points: DataFrame, start: float, axes: list[str], ident: str, keys: list[str] = (), rounds: int = 40) -> DataFrame:
    """For each query the distance to the nearest other point of its group: (keys, ident, dist), null where it is alone.

    A query looks into its cell and the cells around it.  What it finds nearer than a cell's width is nearest
    indeed; the other queries go on with cells twice as wide.  Only open queries are joined again, and the last
    round's cells span all points."""
    keys, spark = list(keys), queries.sparkSession
    ends = points.agg(*(f(a).alias(f"{n}{a}") for a in axes for n, f in (("lo_", F.min), ("hi_", F.max)))).first()
    span = max([float(ends[f"hi_{a}"] or 0) - float(ends[f"lo_{a}"] or 0) for a in axes] + [start])
    open_, found, size = queries.select(*keys, ident, *axes), None, start
    for _ in range(rounds):
        cells = [F.floor(F.col(a) / size).cast("long").alias(f"_c{i}") for i, a in enumerate(axes)]
        names = [f"_c{i}" for i in range(len(axes))]
        put = points.select(*keys, F.col(ident).alias("_other"), *(F.col(a).alias(f"_p{i}") for i, a in enumerate(axes)), *cells)
        look = open_.select(*keys, ident, *axes, *cells)
        for n in names:
            look = look.withColumn(n, F.explode(F.sequence(F.col(n) - 1, F.col(n) + 1)))
        d = F.sqrt(sum(F.pow(F.col(a) - F.col(f"_p{i}"), 2) for i, a in enumerate(axes)))
        met = look.join(put, [*keys, *names]).where(F.col(ident) != F.col("_other"))
        best = met.groupBy(*keys, ident).agg(F.min(d).alias("dist"))
        last = size > span
        sure = best if last else best.where(F.col("dist") <= size)
        sure = sure.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else sure.persist()
        found = sure if found is None else found.unionByName(sure)
        open_ = open_.join(sure.select(*keys, ident), [*keys, ident], "left_anti")
        if last or open_.isEmpty():
            break
        size *= 2
    return queries.select(*keys, ident).join(found, [*keys, ident], "left")
