"""Tables and clouds as files: manifests, box indexes, error summaries, extracted windows, error points.

Small reports (a row per file, chunk, group or range) are one CSV part each with a header and fixed decimals; clouds are
written by all tasks, in folders by their keys.  Every sink replaces what its folder held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import formatted


def fixed(rows: DataFrame, digits: int | None) -> DataFrame:
    """Floating-point columns as text with so many decimals; null and not-a-number stay empty."""
    if digits is None:
        return rows
    text = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.format_string(f"%.{digits}f", F.col(c))).alias(c)
    return rows.select(*(text(c) if kind in ("double", "float") else F.col(c) for c, kind in rows.dtypes))


def write_report(rows: DataFrame, path: str, order: list[str], digits: int | None = None) -> None:
    """A small table in order, written by one task."""
    fixed(rows.orderBy(*order), digits).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_manifest(files: DataFrame, path: str, raw: bool = False) -> None:
    """File time ranges (filename, t_min, t_max, ...) by name, or scans by number; raw files' times have six decimals."""
    write_report(files, path, ["filename"] if "filename" in files.columns else ["scan_id"], 6 if raw else None)


def write_boxes(boxes: DataFrame, path: str) -> None:
    """Chunk boxes in order of time."""
    write_report(boxes, path, ["t_start", *(c for c in ("scan_id", "chunk_k", "chunk_file") if c in boxes.columns)])


def write_summary(summary: DataFrame, path: str, keys: list[str], digits: int = 6) -> None:
    """Error or spacing summaries, a row per group."""
    write_report(summary, path, keys, digits)


def write_windows(points: DataFrame, path: str, keys: tuple[str, ...] = ("fi", "fj", "flight")) -> None:
    """Extracted points with all their columns, a folder per pair and flight.  Parts are dealt by key and a salt, so that
    a large window is several files."""
    salt = F.pmod(F.xxhash64(*(c for c in points.columns if c not in keys)), F.lit(16))
    points.withColumn("_salt", salt).repartition(*keys, "_salt").drop("_salt").write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_window_text(points: DataFrame, path: str, keys: tuple[str, ...] = ("fi", "fj", "flight"), vector: tuple[str, ...] = (), digits: int = 10) -> None:
    """Extracted points as lines t, x, y, z and the vector's columns, a folder per pair and flight."""
    line = F.concat_ws(",", *(F.format_string(f"%.{digits}f", F.col(c).cast("double")) for c in ("t", "x", "y", "z", *vector)))
    points.select(*keys, line.alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)


def write_errors(errors: DataFrame, path: str, method: str = "method") -> None:
    """Error points (t, x, y, z, e3d), a folder per method."""
    errors.select("t", "x", "y", "z", "e3d", method).write.mode("overwrite").partitionBy(method).parquet(path)


def write_error_files(errors: DataFrame, path: str) -> None:
    """Error points of one method as point files, named as error_files() finds them, whose extra column holds the error."""
    rows = errors.select("t", "x", "y", "z", F.lit(0).alias("intensity"), F.col("e3d").cast("float").alias("e3d"))
    rows.write.format("las").option("pointFormat", 6).option("prefix", "rmse_").mode("overwrite").save(path)


def write_lines(points: DataFrame, path: str, keys: tuple[str, ...] = (), **columns) -> None:
    """Points in the fixed text format, a folder per key if there are keys."""
    rows = points.select(*keys, formatted(**columns).alias("value")).write.mode("overwrite")
    (rows.partitionBy(*keys) if keys else rows).text(path)
