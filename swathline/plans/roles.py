"""Point-cloud roles played by the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import micros

DAY = 86_400_000_000  # microseconds
HOUR = 3_600_000_000


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as points: point_id, t (microseconds), x, y, scan, src."""
    y = F.get_json_object("props", "$.k").try_cast("int")
    cols = [F.col("event_id").alias("point_id"), micros(F.col("ts")).alias("t"), F.col("value").alias("x"), y.alias("y"), F.col("user_id").alias("scan"), F.col("event_type").alias("src")]
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(*cols)


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view events as a trajectory (t, x, y), one row per time."""
    from ..operators.trajectory import unique_times

    rows = points(spark, sf_dir).where("src = 'view'").select("t", "x", F.col("y").cast("double").alias("y"), "point_id")
    return unique_times(rows, order="point_id").select("t", "x", "y")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a 3-D cloud: point_id, x, y, z, src."""
    e = F.col("embedding")
    cols = [F.col("vec_id").alias("point_id"), *(e[i].cast("double").alias(c) for i, c in enumerate("xyz")), F.col("label").alias("src")]
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(*cols)


POINTS_SQL = "pts AS (SELECT event_id AS point_id, epoch_us(ts) AS t, value AS x, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS y, user_id AS scan, event_type AS src FROM events)"
TRAJECTORY_SQL = POINTS_SQL + ",\ntrj AS (SELECT t, arg_min(x, point_id) AS x, CAST(arg_min(y, point_id) AS DOUBLE) AS y FROM pts WHERE src = 'view' GROUP BY t)"
SEGMENTS_SQL = TRAJECTORY_SQL + """,
ahead AS (SELECT t, x, y, lead(t) OVER w AS tn, lead(x) OVER w AS xn, lead(y) OVER w AS yn FROM trj WINDOW w AS (ORDER BY t)),
ends AS (SELECT min(t) AS tlo, max(t) AS thi FROM trj)"""
CLOUD_SQL = "cloud AS (SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label AS src FROM embeddings)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; negative zero becomes zero."""
    return df.select(*((F.round(f.name, digits) + 0.0).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema))
