"""Text clouds, trajectories, correspondences and manifests."""

from __future__ import annotations

import functools
import shutil
import tarfile
import uuid

import pyarrow.fs as pafs
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trajectory import unique_times
from . import files
from .sbet import as_trajectory

MANIFEST = "filename string, t_min_sow double, t_max_sow double, t_min double, t_max double, n_records long"
SCANS = "scan_id long, filename string, t_start double, t_end double"
BOXES = "chunk_file string, t_start double, t_end double, x_min double, x_max double, y_min double, y_max double"
CORRESPONDENCES = ["time_a", "x_a", "y_a", "z_a", "time_b", "x_b", "y_b", "z_b", "d_xyz", "icp_x", "icp_y", "icp_z"]
VECTOR_PAIRS = ["time_a", "time_b", "vx_a", "vy_a", "vz_a", "vx_b", "vy_b", "vz_b"]


def lines(spark: SparkSession, path: str, separator: str = r"[,\t]\s*|\s+", skip: str = "#") -> DataFrame:
    """Fields of text lines: file, fields.  Blank lines and comments are left out."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("_v"))
    return rows.where((F.length("_v") > 0) & ~F.startswith(F.col("_v"), F.lit(skip))).select("file", F.split("_v", separator).alias("fields"))


def numbers(rows: DataFrame, names: list[str], at: list[int] | None = None) -> DataFrame:
    """Fields as doubles; rows where one of them is missing or no number are left out, which takes headers out too."""
    at = at or list(range(len(names)))
    out = rows.where(F.size("fields") > max(at)).select("file", *(F.col("fields")[i].try_cast("double").alias(n) for n, i in zip(names, at, strict=True)))
    return out.dropna(subset=names)


def ascii_cloud(spark: SparkSession, path: str) -> DataFrame:
    """t, x, y, z[, lvx, lvy, lvz][, intensity] by the number of fields (4, 5, 7 or 8)."""
    f, n = F.col("fields"), F.size("fields")
    d = lambda i: f[i].try_cast("double")
    vec = lambda i: F.when(n >= 7, F.get(f, F.lit(i)).try_cast("double"))
    intensity = F.when(n == 5, F.get(f, F.lit(4))).when(n >= 8, F.get(f, F.lit(7))).try_cast("double")
    rows = lines(spark, path).where(n >= 4)
    return rows.select("file", d(0).alias("t"), d(1).alias("x"), d(2).alias("y"), d(3).alias("z"), vec(4).alias("lvx"), vec(5).alias("lvy"), vec(6).alias("lvz"), intensity.alias("intensity")).dropna(subset=["t", "x", "y", "z"])


def laser_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated vectors x, y, z, t, intensity after one header line."""
    return numbers(lines(spark, path, ","), ["sx", "sy", "sz", "t", "intensity_raw"]).select("file", "t", "sx", "sy", "sz", "intensity_raw")


def ascii_trajectory(spark: SparkSession, path: str, columns: dict[str, int], degrees: bool = False, utc: bool = False, leap: float = 18.0) -> DataFrame:
    """A text trajectory with its columns named (t, lat, lon, alt, ex, ey, ez, roll, pitch, heading, qw..qz); the first row of each
    time counts."""
    rows = spark.read.text(path).withColumn("point_idx", F.monotonically_increasing_id())
    fields = rows.select("point_idx", F.lit("").alias("file"), F.split(F.trim("value"), r"[,\t]\s*|\s+").alias("fields"))
    at = list(columns.values())
    got = fields.where(F.size("fields") > max(at)).select("point_idx", *(F.col("fields")[i].try_cast("double").alias(n) for n, i in columns.items())).dropna()
    angles = [c for c in ("lat", "lon", "roll", "pitch", "heading") if c in columns]
    if degrees:
        got = got.withColumns({c: F.radians(c) for c in angles})
    return unique_times(got.withColumn("t", F.col("t") + (leap if utc else 0.0)))


def pose_log(spark: SparkSession, path: str, origin: tuple[float, float, float] = (0, 0, 0), every: int = 1, utc: bool = False, leap: float = 18.0, folder: str | None = None) -> DataFrame:
    """A pose log (column 0 time, 2-4 place, 5-8 quaternion), from a file or out of a .tar.gz, thinned before it is sorted.  A log
    out of an archive is put into the given folder, else below spark.checkpoint.dir: one that executors see too."""
    if path.endswith((".tar.gz", ".tgz")):
        to = folder or spark.conf.get("spark.checkpoint.dir", None)
        if not to:
            raise ValueError("name a folder that driver and executors share, or set spark.checkpoint.dir")
        fs, at = files.resolve(to)
        at = f"{at.rstrip('/')}/pose-{uuid.uuid4().hex}"
        fs.create_dir(at, recursive=True)
        with tarfile.open(path) as t:
            inner = min((m for m in t if m.name.endswith("PoseSE3(W).log")), key=lambda m: m.name)
            with fs.open_output_stream(f"{at}/pose.log", compression=None) as out:
                shutil.copyfileobj(t.extractfile(inner), out)
        path = f"{to.rstrip('/')}/{at.rsplit('/', 1)[-1]}/pose.log"
    names = {"t": 0, "ex": 2, "ey": 3, "ez": 4, "qw": 5, "qx": 6, "qy": 7, "qz": 8}
    rows = spark.read.text(path).coalesce(1).withColumn("point_idx", F.monotonically_increasing_id())  # one log is one task, in order
    got = rows.select("point_idx", F.split("value", r",\s*").alias("f")).where(F.size("f") > 8)
    got = got.select("point_idx", *(F.col("f")[i].try_cast("double").alias(n) for n, i in names.items())).dropna().where(F.col("point_idx") % every == 0)
    moved = {c: F.col(c) + float(o) for c, o in zip(("ex", "ey", "ez"), origin, strict=True)}
    return got.withColumns(moved | {"t": F.col("t") + (leap if utc else 0.0)})


def correspondences(spark: SparkSession, path: str) -> DataFrame:
    return numbers(lines(spark, path, r",\s*"), CORRESPONDENCES)


def vector_pairs(spark: SparkSession, path: str) -> DataFrame:
    return numbers(lines(spark, path, r",\s*"), VECTOR_PAIRS)


def concatenated(spark: SparkSession, paths: list[str], to: str) -> None:
    """All lines of some correspondence files as one text folder."""
    spark.read.text(paths).where("trim(value) <> ''").coalesce(1).write.mode("overwrite").text(to)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """File time ranges; needs filename, t_min and t_max."""
    rows = spark.read.csv(path, header=True)
    missing = {"filename", "t_min", "t_max"} - set(rows.columns)
    if missing:
        raise ValueError(f"manifest lacks {sorted(missing)}")
    kinds = dict(f.strip().split(" ") for f in MANIFEST.split(","))
    return rows.select(*(F.col(c).try_cast(kinds.get(c, "string")).alias(c) for c in rows.columns))


def scans(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    kinds = dict(f.strip().split(" ") for f in SCANS.split(","))
    return rows.select(*(F.col(c).try_cast(kinds.get(c, "long")).alias(c) for c in rows.columns))


def boxes(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.csv(paths, header=True, schema=BOXES)


def control_points(spark: SparkSession, path: str) -> DataFrame:
    """The lcps of a YAML file; values other than id and gps_time stay as they are, by name."""
    fs, at = files.resolve(path)
    with fs.open_input_stream(at) as f:
        rows = yaml.safe_load(f.read())["lcps"]
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([{n: (float(v) if isinstance(v := r.get(n), int | float) and n != "id" else str(v) if v is not None else None) for n in names} for r in rows])


def trajectory(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """A trajectory by the kind of its file: SBET, ASCII or DN (a pose log)."""
    readers = {"SBET": lambda: as_trajectory(spark.read.format("sbet").load(path), **options), "ASCII": lambda: ascii_trajectory(spark, path, **options), "DN": lambda: pose_log(spark, path, **options)}
    if kind not in readers:
        raise ValueError(f"no trajectory of kind {kind}; one of {', '.join(readers)}")
    return readers[kind]()


def error_files(spark: SparkSession, root: str) -> DataFrame:
    """Error points of the point files <root>/<method>/rmse_*.las: method, file, t, x, y, z, e3d; no method is an error.
    Rows aren't ordered: order by method and t where that matters."""
    fs, folder = files.resolve(root)
    methods = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.type == pafs.FileType.Directory)
    methods = [m for m in methods if files.listing(m, (".las",), "rmse_*")]
    if not methods:
        raise FileNotFoundError(f"no rmse_*.las in the folders of {root}")
    parts = [spark.read.format("las").option("pattern", "rmse_*").load(m).select(F.lit(m.rsplit("/", 1)[-1]).alias("method"), "file", "t", "x", "y", "z", "e3d") for m in methods]
    return functools.reduce(DataFrame.unionByName, parts)


def error_points(spark: SparkSession, root: str) -> DataFrame:
    """Error points stored as Parquet under <root>/method=<m>/: t, x, y, z, e3d, method."""
    return spark.read.parquet(root)


def formatted(t: str = "t", xyz: tuple[str, ...] = ("x", "y", "z"), vector: tuple[str, ...] = (), intensity: str | None = None) -> Column:
    """A point as a line of text: time with nine digits, the rest with three, intensity with none."""
    number = lambda c: F.col(c).cast("double")
    parts = [F.format_string("%.9f", number(t)), *(F.format_string("%.3f", number(c)) for c in (*xyz, *vector))]
    return F.concat_ws(",", *parts, *([F.format_string("%.0f", number(intensity))] if intensity else []))


def write_cloud(points: DataFrame, path: str, vector: tuple[str, ...] = (), intensity: str | None = None) -> None:
    points.select(formatted(vector=vector, intensity=intensity).alias("value")).write.mode("overwrite").text(path)


def write_chunks(chunked: DataFrame, path: str, keys: list[str]) -> None:
    """One folder per chunk."""
    chunked.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)
