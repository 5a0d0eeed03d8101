"""Incremental forms of batch aggregates over arriving points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def manifest_stream(points: DataFrame, late: str = "1 hour", span: str = "1 day", event_time: str = "ts", key: str = "scan") -> DataFrame:
    """Time range and count per scan and event-time window of a stream of points, final once the watermark passes."""
    rows = points.withWatermark(event_time, late)
    out = rows.groupBy(F.window(event_time, span).alias("w"), key).agg(F.min(event_time).alias("t_start"), F.max(event_time).alias("t_end"), F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("from"), "t_start", "t_end", "n")


def append_metrics(errors: DataFrame, path: str, checkpoint: str, keys: list[str], e: str = "e") -> StreamingQuery:
    """Keep running sums of an error stream per key: one Parquet row set per micro-batch, whose sums add up to the whole."""

    def put(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*keys).agg(F.count(e).alias("n"), F.sum(e).alias("sum"), F.sum(F.col(e) * F.col(e)).alias("sum2"), F.max(e).alias("max"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")  # the same batch again replaces itself

    return errors.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_summary(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics from the sums of append_metrics()."""
    n = F.sum("n")
    return sums.groupBy(*keys).agg(n.alias("n"), F.sqrt(F.sum("sum2") / n).alias("rmse"), (F.sum("sum") / n).alias("mean"), F.max("max").alias("max"))
