"""Error metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rmse(e: str) -> Column:
    return F.sqrt(F.avg(F.col(e) * F.col(e)))


def share_above(e: str, limit: float) -> Column:
    """Per cent of rows above a limit."""
    return 100 * F.avg(F.when(F.col(e) > limit, 1.0).when(F.col(e).isNotNull(), 0.0))


def quantile(e: str, q: float) -> Column:
    """Exact, linear between neighbours."""
    return F.percentile(F.col(e), F.lit(q))


def summary(errors: DataFrame, keys: list[str], e: str = "e", axes: list[str] = (), limits: tuple[float, ...] = (0.1, 0.5, 1.0), quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """n, rmse, mean, max, quantiles, shares above limits, and mean and population deviation per axis."""
    cols = [F.count(e).alias("n"), rmse(e).alias("rmse"), F.avg(e).alias("mean"), F.max(e).alias("max")]
    cols += [quantile(e, q).alias(f"q{q * 100:g}".replace(".", "_")) for q in quantiles]
    cols += [share_above(e, x).alias(f"above_{i}") for i, x in enumerate(limits, 1)]
    for a in axes:
        cols += [F.avg(a).alias(f"{a}_mean"), F.stddev_pop(a).alias(f"{a}_std")]
    return errors.groupBy(*keys).agg(*cols)


def with_empty(metrics: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """A row for every wanted key, n = 0 and nulls where nothing was measured."""
    out = wanted.join(metrics, keys, "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def by_range(rows: DataFrame, distance: str, e: str, other: str, edges: tuple[float, ...] = (0, 10, 20, 30)) -> DataFrame:
    """Metrics per range bin and over all rows, in one pass: n, median and rmse of e, rmse of another error where present."""
    from ..functions.scalars import range_bin

    bins = F.array(F.lit("Global"), range_bin(F.col(distance), edges))
    rows = rows.withColumn("bin", F.explode(bins)).where("bin is not null")
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), quantile(e, 0.5).alias("q50"), rmse(e).alias("rmse"), rmse(other).alias("rmse_other"))


def weighted(metrics: DataFrame, keys: list[str], values: list[str], n: str = "n", file: str = "file") -> DataFrame:
    """Averages over files weighted by n, of finite values only; files and rows counted."""
    cols = []
    for v in values:
        x = F.when(~F.isnan(F.col(v).cast("double")) & (F.abs(F.col(v)) < float("inf")), F.col(v))
        cols.append((F.sum(x * F.col(n)) / F.nullif(F.sum(F.when(x.isNotNull(), F.col(n))), F.lit(0))).alias(v))
    return metrics.groupBy(*keys).agg(F.count_distinct(file).alias("n_files"), F.sum(n).alias("n"), *cols)


def histogram(rows: DataFrame, value: str, bins: int, keys: list[str] = ()) -> DataFrame:
    """Counts over equal bins between the least and greatest of all values; the last bin is closed."""
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(step > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / F.nullif(step, F.lit(0.0))), F.lit(bins - 1)))
    out = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("bin", F.coalesce(b, F.lit(0)).cast("int"))
    return out.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def circular_mean(angle: str) -> Column:
    return F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))


def worst(rows: DataFrame, e: str, key: str) -> DataFrame:
    """rmse, greatest error and whose it is."""
    return rows.agg(rmse(e).alias("rmse"), F.max(e).alias("max"), F.max_by(key, F.struct(F.coalesce(e, F.lit(float("-inf"))), F.col(key))).alias("worst"))


def described(rows: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of a value, null where there is none."""
    at = lambda q, n: F.percentile(value, q).alias(n)
    return rows.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), at(0.25, "q25"), at(0.5, "q50"), at(0.75, "q75"), F.max(value).alias("max"))
