"""Registered queries over files: tables written in a format and read back, against SQL over the tables."""

from __future__ import annotations

import numpy as np
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rotations as rot
from ..operators import calibration, chunking, clouds, metrics
from ..operators import trajectory as trj
from ..session import shared_folder
from ..sources import files, las, register, sdc, sinks, text
from .queries import ANGLES_SQL, CHUNK_SQL, HOUR, LEAST, LENGTH, START, QUERIES, SQL, _angles, query  # noqa: F401
from .roles import DAY, POINTS_SQL, TRAJECTORY_SQL, points, rounded, trajectory


def _cloud(spark: SparkSession, d: str) -> DataFrame:
    """events as a cloud in seconds, with body vectors, intensity, scanner and error."""
    p = points(spark, d)
    cols = [(F.col("t") / 1e6).alias("t"), "x", F.col("y").cast("double").alias("y"), (F.col("x") - F.col("y")).alias("z")]
    vector = [(F.col("x") / 8).cast("float").alias("lvx"), (F.col("y") / F.lit(4.0)).cast("float").alias("lvy"), F.lit(0.5).cast("float").alias("lvz")]
    scanner = (F.when(F.col("src") == "click", 1).otherwise(2)).cast("short")
    return p.select("point_id", "scan", "src", *cols, *vector, (F.col("point_id") % 65536).cast("int").alias("intensity"), scanner.alias("scanner_src"), (F.col("y") / F.lit(16.0)).alias("e3d"))


FILE_SQL = POINTS_SQL + ", cl AS (SELECT point_id, scan, src, t / 1e6 AS t, x, CAST(y AS DOUBLE) AS y, round(x - y, 3) AS z, CAST(x / 8 AS FLOAT) AS lvx, CAST(y / 4.0 AS FLOAT) AS lvy, CAST(0.5 AS FLOAT) AS lvz, CAST(point_id % 65536 AS INTEGER) AS intensity, CASE WHEN src = 'click' THEN 1 ELSE 2 END AS scanner_src, y / 16.0 AS e3d FROM pts)"


def _lines(rows: DataFrame, *columns: str, separator: str = ",") -> DataFrame:
    return rows.select(F.concat_ws(separator, *(F.col(c).cast("string") for c in columns)).alias("value"))


def _put(spark: SparkSession, name: str, lines: DataFrame, *more: str) -> str:
    """Lines, and some that readers leave out, as text files in a new folder."""
    path = shared_folder(spark, name)
    extra = spark.createDataFrame([(m,) for m in more], "value string")
    lines.unionByName(extra).write.text(path)
    return path


# --- point files -----------------------------------------------------------------------------------------------


def _las(spark: SparkSession, d: str, fmt: int = 1) -> str:
    register(spark)
    path = shared_folder(spark, "las")
    _cloud(spark, d).drop("point_id", "scan", "src", "e3d").write.format("las").option("pointFormat", fmt).mode("append").save(path)
    return path


LAS_SQL = f"WITH {FILE_SQL} SELECT t, round(x, 3) AS x, round(y, 3) AS y, z, intensity, round(CAST(lvx AS DOUBLE), 4) AS lvx, round(CAST(lvy AS DOUBLE), 4) AS lvy, round(CAST(lvz AS DOUBLE), 4) AS lvz, CAST(scanner_src AS SMALLINT) AS scanner_src FROM cl"


def _las_rows(rows: DataFrame) -> DataFrame:
    place = [(F.round(c, 3) + 0.0).alias(c) for c in "xyz"]
    return rows.select("t", *place, "intensity", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in ("lvx", "lvy", "lvz")), "scanner_src")


@query(LAS_SQL)
def las_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Point files with extra dimensions, read in ranges of records."""
    path = _las(spark, d)
    return _las_rows(spark.read.format("las").option("recordsPerTask", 2000).load(path))


@query(LAS_SQL)
def las_round_trip_14(spark: SparkSession, d: str) -> DataFrame:
    """The same in point format 6."""
    path = _las(spark, d, 6)
    return _las_rows(spark.read.format("las").load(path))


@query(f"WITH {FILE_SQL} SELECT '1.4' AS version, CAST(1 AS INTEGER) AS point_format, CAST(count(*) AS BIGINT) AS n_points, round(min(x), 3) AS x_min, round(max(x), 3) AS x_max, round(min(y), 3) AS y_min, round(max(y), 3) AS y_max, round(min(z), 3) AS z_min, round(max(z), 3) AS z_max FROM cl")
def las_headers(spark: SparkSession, d: str) -> DataFrame:
    """Counts and bounds from the headers alone."""
    rows = las.headers(spark, _las(spark, d))
    ends = [f(f"{c}_{n}").alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return rounded(rows.groupBy("version", "point_format").agg(F.sum("n_points").alias("n_points"), *ends), 3)


@query(f"WITH {FILE_SQL} SELECT src AS method, t, round(x, 3) AS x, round(y, 3) AS y, z, round(e3d, 4) AS e3d FROM cl")
def error_file_scan(spark: SparkSession, d: str) -> DataFrame:
    """Error files of each method, found by their names; other files in the folders are left alone."""
    register(spark)
    root, rows = shared_folder(spark, "errors"), _cloud(spark, d)
    for method in sorted(r["src"] for r in rows.select("src").distinct().collect()):  # a few methods
        sinks.write_error_files(rows.where(F.col("src") == method), f"{root}/{method}")
        rows.where(F.col("src") == method).limit(3).select("t", "x", "y", "z", "intensity").write.format("las").mode("append").save(f"{root}/{method}")
    got = text.error_files(spark, root)
    return got.select("method", "t", *((F.round(c, 3) + 0.0).alias(c) for c in "xyz"), F.round(F.col("e3d").cast("double"), 4).alias("e3d"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS flight_id, 'flight_' || n_nationkey || '_a.las' AS file, 'las' AS format FROM nation")
def flight_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Files of a template by flight, among others, and the folder's format; a row per file, so listed by the driver."""
    flights = [r[0] for r in spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey").collect()]
    root = shared_folder(spark, "flights")
    fs, at = files.resolve(root)
    fs.create_dir(at, recursive=True)
    for name in [*(f"flight_{f}_a.las" for f in flights), "flight_x.txt", "notes.md", "other_3_a.las"]:
        fs.open_output_stream(f"{at}/{name}").close()
    found = files.templated(f"{root}/flight_{{flight_id}}_a.las")
    kind = files.format_of(root)
    return spark.createDataFrame([(f, p.rsplit("/", 1)[-1], kind) for f, p in found.items()], "flight_id string, file string, format string")


# --- raw vectors -----------------------------------------------------------------------------------------------

WEEK_SQL = POINTS_SQL + f", raw AS (SELECT 50000 + ((t - {START}) % 600000000000) / 1e6 AS t, CAST(x / 20 AS FLOAT) AS sx, CAST(y / 10.0 AS FLOAT) AS sy, CAST(x / 50 - 1 AS FLOAT) AS sz, CAST(point_id % 65536 AS DOUBLE) AS intensity_raw FROM pts)"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    time = F.lit(50000) + ((F.col("t") - START) % 600_000_000_000) / 1e6
    f4 = lambda c, n: c.cast("float").alias(n)
    return points(spark, d).select(time.alias("t"), f4(F.col("x") / 20, "sx"), f4(F.col("y") / F.lit(10.0), "sy"), f4(F.col("x") / 50 - 1, "sz"), (F.col("point_id") % 65536).cast("double").alias("intensity_raw"))


def _sdc(spark: SparkSession, d: str) -> DataFrame:
    register(spark)
    path = shared_folder(spark, "sdc")
    _raw(spark, d).write.format("sdc").mode("append").save(path)
    return spark.read.format("sdc").option("recordsPerTask", 3000).load(path)


@query(f"WITH {WEEK_SQL} SELECT t, round(CAST(sx AS DOUBLE), 4) AS sx, round(CAST(sy AS DOUBLE), 4) AS sy, round(CAST(sz AS DOUBLE), 4) AS sz, intensity_raw FROM raw")
def sdc_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Raw vectors; the reader finds the size of a record."""
    return rounded(_sdc(spark, d).select("t", "sx", "sy", "sz", "intensity_raw").withColumns({c: F.round(c, 4) for c in ("sx", "sy", "sz")}), 6)


@query(f"WITH {WEEK_SQL} SELECT round(min(t), 6) AS t_min_sow, round(max(t), 6) AS t_max_sow, round(min(t) + 86400.0 + 18, 6) AS t_min, round(max(t) + 86400.0 + 18, 6) AS t_max, CAST(count(*) AS BIGINT) AS n_records FROM raw")
def sdc_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Time ranges of raw files on the trajectory's scale, over all files."""
    rows = sdc.manifest(_sdc(spark, d), day_shift=1, leap=18)
    ends = [f(c).alias(c) for c, f in (("t_min_sow", F.min), ("t_max_sow", F.max), ("t_min", F.min), ("t_max", F.max))]
    return rounded(rows.agg(*ends, F.sum("n_records").alias("n_records")), 6)


@query(f"WITH {POINTS_SQL} SELECT x / 20 AS sx, y / 10.0 AS sy, x / 50 - 1 AS sz, t / 1e6 AS t, CAST(point_id AS DOUBLE) AS intensity_raw FROM pts")
def laser_vector_scan(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as text with a header line in every file."""
    rows = points(spark, d).select((F.col("x") / 20).alias("x"), (F.col("y") / F.lit(10.0)).alias("y"), (F.col("x") / 50 - 1).alias("z"), (F.col("t") / 1e6).alias("t"), F.col("point_id").alias("i"))
    path = shared_folder(spark, "vectors")
    rows.write.option("header", True).csv(path)
    return text.laser_vectors(spark, path).drop("file")


# --- trajectories ----------------------------------------------------------------------------------------------

POSE_SQL = TRAJECTORY_SQL + ", po AS (SELECT t / 1e6 AS t, 0.8 + x / 1e4 AS lat, 0.1 + y / 1e4 AS lon, x AS alt, x / 700 AS roll, y / 300 AS pitch, x / 300 AS heading FROM trj)"


def _geo_poses(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    cols = {"lat": 0.8 + x / 1e4, "lon": 0.1 + y / 1e4, "alt": x, "roll": x / 700, "pitch": y / 300, "heading": x / 300}
    return trajectory(spark, d).select((F.col("t") / 1e6).alias("t"), *(c.alias(n) for n, c in cols.items()))


@query(f"WITH {POSE_SQL} SELECT round(t + 18, 6) AS t, round(lat, 9) AS lat, round(lon, 9) AS lon, alt, round(roll, 9) AS roll, round(pitch, 9) AS pitch, round(heading, 9) AS heading FROM po")
def sbet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A smoothed trajectory with times in UTC, written and read by its kind."""
    register(spark)
    path = shared_folder(spark, "sbet")
    _geo_poses(spark, d).withColumnRenamed("t", "time").write.format("sbet").mode("append").save(path)
    got = text.trajectory(spark, path, "SBET", utc=True).drop("point_idx")
    return rounded(got, 9).withColumn("t", F.round("t", 6))


@query(f"WITH {POSE_SQL} SELECT round(t + 18, 6) AS t, round(radians(lat), 9) AS lat, round(radians(lon), 9) AS lon, alt FROM po")
def text_trajectory(spark: SparkSession, d: str) -> DataFrame:
    """A text trajectory in degrees and UTC, every pose twice: the first of a time counts."""
    rows = _lines(_geo_poses(spark, d), "t", "lat", "lon", "alt")
    path = _put(spark, "trajectory", rows.unionByName(rows), "", "# comment", "1,2")
    got = text.trajectory(spark, path, "ASCII", columns={"t": 0, "lat": 1, "lon": 2, "alt": 3}, degrees=True, utc=True)
    return rounded(got.select("t", "lat", "lon", "alt"), 9).withColumn("t", F.round("t", 6))


@query(f"WITH {TRAJECTORY_SQL} SELECT round(t / 1e6 + 18, 6) AS t, round(x + 100, 6) AS ex, round(y + 200, 6) AS ey, x - y - 300 AS ez, round(cos(x / 700), 9) AS qw, CAST(0 AS DOUBLE) AS qx, CAST(0 AS DOUBLE) AS qy, round(sin(x / 700), 9) AS qz FROM trj")
def pose_log(spark: SparkSession, d: str) -> DataFrame:
    """A pose log around an origin, with times in UTC."""
    rows = trajectory(spark, d).select((F.col("t") / 1e6).alias("t"), F.lit(0).alias("o"), "x", "y", (F.col("x") - F.col("y")).alias("z"), F.cos(F.col("x") / 700).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(F.col("x") / 700).alias("qz"))
    path = _put(spark, "poses", _lines(rows, *rows.columns), "short,line")
    got = text.trajectory(spark, path, "DN", origin=(100.0, 200.0, -300.0), utc=True).drop("point_idx")
    return rounded(got, 9).withColumns({c: F.round(c, 6) for c in ("t", "ex", "ey")})


@query(f"""WITH {ANGLES_SQL.replace('FROM pts)', "FROM pts WHERE src = 'click')", 1)} SELECT point_id, round(w, 6) AS qw, round(x, 6) AS qx, round(y, 6) AS qy, round(z, 6) AS qz, round(2 * (x * y + w * z), 6) AS east, round(w * w + x * x - y * y - z * z, 6) AS north, round(2 * (w * y - x * z), 6) AS up FROM q""")
def map_attitude(spark: SparkSession, d: str) -> DataFrame:
    """Quaternions by the trace, and the forward axis in east, north, up."""
    a = _angles(spark, d).join(points(spark, d).where("src = 'click'").select("point_id"), "point_id", "left_semi")
    m = rot.body_to_ned(F.col("r"), F.col("p"), F.col("h"))
    q = rot.matrix_to_quaternion_by_trace(m)
    forward = [rot.col(row[0]) for row in rot.mat_mul(rot.enu_ned(), m)]
    return rounded(a.select("point_id", *(c.alias(n) for c, n in zip(q, trj.QUATERNION, strict=True)), *(c.alias(n) for c, n in zip(forward, ("east", "north", "up"), strict=True))))


ARM_SQL = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS axis, round({old} + (a{i} + b{i}) / 2, 6) AS arm, round((a{i} - b{i}) / 2, 6) AS half FROM k" for i, old in enumerate((0.1, -0.2, 0.3)))


@query(f"""WITH {POINTS_SQL}, p AS (SELECT src, avg(x) AS e, avg(y) AS n, avg(x - y) AS u FROM pts GROUP BY src), v AS (SELECT * FROM p WHERE src = 'view'), c AS (SELECT * FROM p WHERE src = 'click'),
k AS (SELECT sin(0.4) * v.e + cos(0.4) * v.n AS a0, cos(0.4) * v.e - sin(0.4) * v.n AS a1, -v.u AS a2, sin(2.0) * c.e + cos(2.0) * c.n AS b0, cos(2.0) * c.e - sin(2.0) * c.n AS b1, -c.u AS b2 FROM v, c)
{ARM_SQL}""")
def lever_arm(spark: SparkSession, d: str) -> DataFrame:
    """The lever arm from the mean offsets of two passes with different headings."""
    means = points(spark, d).where("src in ('view', 'click')").groupBy("src").agg(F.avg("x"), F.avg("y"), F.avg(F.col("x") - F.col("y")))
    offset = {r[0]: np.array(r[1:], dtype=float) for r in means.collect()}  # two passes
    arm, half = calibration.lever_arm([((0.0, 0.0, 0.4), offset["view"]), ((0.0, 0.0, 2.0), offset["click"])], np.array([0.1, -0.2, 0.3]))
    return rounded(spark.createDataFrame([(i, float(a), float(h)) for i, (a, h) in enumerate(zip(arm, half, strict=True))], "axis int, arm double, half double"))


@query(f"""WITH {POINTS_SQL}, h AS (SELECT (t - {START}) // {HOUR} AS i, src, count(*) AS n FROM pts WHERE src IN ('view', 'click') GROUP BY ALL), r AS (SELECT unnest(range(0, max((t - {START}) // {HOUR}) + 1)) AS i FROM pts),
a AS (SELECT r.i, coalesce(n, 0) AS v FROM r LEFT JOIN h ON r.i = h.i AND src = 'view'), b AS (SELECT r.i, coalesce(n, 0) AS v FROM r LEFT JOIN h ON r.i = h.i AND src = 'click'),
za AS (SELECT i, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z FROM a), zb AS (SELECT i, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z FROM b)
SELECT CAST(za.i - zb.i AS DOUBLE) * 60 AS lag FROM za, zb GROUP BY za.i - zb.i ORDER BY abs(sum(za.z * zb.z)) DESC LIMIT 1""")
def correlation_lag(spark: SparkSession, d: str) -> DataFrame:
    """The lag, in minutes, at which two sources' hourly counts correlate most; the series have a value an hour."""
    rows = points(spark, d).select("src", F.floor((F.col("t") - START) / HOUR).cast("int").alias("i"))
    counts = rows.groupBy("i").agg(*(F.count_if(F.col("src") == s).alias(s) for s in ("view", "click"))).collect()
    series = np.zeros((2, max(r["i"] for r in counts) + 1))
    for r in counts:
        series[:, r["i"]] = r["view"], r["click"]
    return spark.createDataFrame([(calibration.lag(series[0], series[1], 60.0),)], "lag double")


# --- text clouds and tables ------------------------------------------------------------------------------------


@query(f"WITH {FILE_SQL} SELECT t, round(x, 3) AS x, y, z, round(lvx, 3) AS lvx, round(lvy, 3) AS lvy, round(lvz, 3) AS lvz, CAST(intensity AS DOUBLE) AS intensity FROM (SELECT * REPLACE (round(x / 10, 3) AS lvx, y / 10.0 AS lvy, x AS lvz) FROM cl)")
def text_cloud_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Clouds as text, among comments and short lines."""
    rows = _cloud(spark, d).withColumns({"lvx": F.round(F.col("x") / 10, 3), "lvy": F.col("y") / 10, "lvz": F.col("x")})
    lines = rows.select(text.formatted(vector=("lvx", "lvy", "lvz"), intensity="intensity").alias("value"))
    path = _put(spark, "cloud", lines, "# comment", "", "1,2", "1,2,x,4")
    return rounded(text.ascii_cloud(spark, path).drop("file"), 6)


@query(f"WITH {FILE_SQL} SELECT src || '.csv' AS filename, min(t) AS t_min, max(t) AS t_max, CAST(count(*) AS BIGINT) AS n_records FROM cl GROUP BY src")
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Time bounds of files as a report with six decimals."""
    rows = _cloud(spark, d).withColumn("filename", F.concat("src", F.lit(".csv")))
    path = shared_folder(spark, "manifest")
    bounds = clouds.time_bounds(rows, ["filename"]).join(rows.groupBy("filename").agg(F.count("*").alias("n_records")), "filename")
    sinks.write_manifest(bounds, path, raw=True)
    return text.manifest(spark, path)


@query(f"WITH {FILE_SQL} SELECT scan AS scan_id, min(t) AS t_start, max(t) AS t_end, CAST(count(*) FILTER (scanner_src = 2) AS BIGINT) AS n_vux, CAST(count(*) FILTER (scanner_src = 1) AS BIGINT) AS n_puck, CAST(count(*) AS BIGINT) AS n_total FROM cl GROUP BY scan")
def scan_manifest_file(spark: SparkSession, d: str) -> DataFrame:
    """The merged scans' manifest as a report."""
    path = shared_folder(spark, "scans")
    rows = clouds.scan_manifest(_cloud(spark, d).withColumnRenamed("scan", "scan_id"), source="scanner_src", names={"vux": 2, "puck": 1})
    sinks.write_manifest(rows, path)
    return text.scans(spark, path)


@query(f"WITH {FILE_SQL} SELECT src || '_' || scan || '.las' AS chunk_file, min(t) AS t_start, max(t) AS t_end, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM cl GROUP BY src, scan")
def box_index(spark: SparkSession, d: str) -> DataFrame:
    """Chunk boxes of several folders, each a report, read together."""
    rows = _cloud(spark, d).withColumn("chunk_file", F.format_string("%s_%d.las", "src", "scan"))
    paths = []
    for group in ("src = 'view'", "src <> 'view'"):
        paths.append(shared_folder(spark, "boxes"))
        ends = [f(c).alias(n) for c, n, f in (("t", "t_start", F.min), ("t", "t_end", F.max), ("x", "x_min", F.min), ("x", "x_max", F.max), ("y", "y_min", F.min), ("y", "y_max", F.max))]
        sinks.write_boxes(rows.where(group).groupBy("chunk_file").agg(*ends), paths[-1])
    return text.boxes(spark, paths)


@query(f"WITH {FILE_SQL} SELECT t AS time_a, x AS x_a, y AS y_a, x - y AS z_a, t + 1 AS time_b, x + 1 AS x_b, y + 1 AS y_b, x - y AS z_b, e3d AS d_xyz, x / 8 AS icp_x, y / 8 AS icp_y, x / 4 AS icp_z FROM cl")
def correspondence_files(spark: SparkSession, d: str) -> DataFrame:
    """Correspondences of several files, put together as one, without headers and broken lines."""
    c = _cloud(spark, d)
    x, y, t = F.col("x"), F.col("y"), F.col("t")
    made = {"time_a": t, "x_a": x, "y_a": y, "z_a": x - y, "time_b": t + 1, "x_b": x + 1, "y_b": y + 1, "z_b": x - y, "d_xyz": F.col("e3d"), "icp_x": x / 8, "icp_y": y / 8, "icp_z": x / 4}
    rows = c.select("src", *(v.alias(n) for n, v in made.items()))
    head = ", ".join(text.CORRESPONDENCES)
    paths = [_put(spark, "matches", _lines(rows.where(group), *text.CORRESPONDENCES, separator=", "), head, "1, 2, 3", " ") for group in ("src = 'view'", "src <> 'view'")]
    whole = shared_folder(spark, "matches")
    text.concatenated(spark, paths, whole)
    return text.correspondences(spark, whole).drop("file")


@query(f"WITH {FILE_SQL} SELECT t AS time_a, t + 1 AS time_b, x AS vx_a, y AS vy_a, x - y AS vz_a, x / 8 AS vx_b, y / 8 AS vy_b, e3d AS vz_b FROM cl")
def vector_pair_files(spark: SparkSession, d: str) -> DataFrame:
    c = _cloud(spark, d)
    x, y, t = F.col("x"), F.col("y"), F.col("t")
    rows = c.select(t.alias("time_a"), (t + 1).alias("time_b"), x.alias("vx_a"), y.alias("vy_a"), (x - y).alias("vz_a"), (x / 8).alias("vx_b"), (y / 8).alias("vy_b"), F.col("e3d").alias("vz_b"))
    path = _put(spark, "pairs", _lines(rows, *text.VECTOR_PAIRS), "a,b,c,d,e,f,g,h")
    return text.vector_pairs(spark, path).drop("file")


@query("SELECT n_name AS id, CAST(n_nationkey * 10 AS DOUBLE) AS gps_time, CASE WHEN n_regionkey = 0 THEN 'first' END AS note FROM nation")
def control_point_file(spark: SparkSession, d: str) -> DataFrame:
    """Control points in YAML, a short list that the driver reads."""
    rows = spark.read.parquet(f"{d}/nation.parquet").collect()
    listed = [{"id": r["n_name"], "gps_time": r["n_nationkey"] * 10} | ({"note": "first"} if r["n_regionkey"] == 0 else {}) for r in rows]
    path = shared_folder(spark, "points")
    fs, at = files.resolve(path)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/points.yml", compression=None) as f:
        f.write(yaml.safe_dump({"lcps": listed}).encode())
    return text.control_points(spark, f"{path}/points.yml").select("id", "gps_time", "note")


@query(f"WITH {FILE_SQL} SELECT CAST(scan % 3 AS INTEGER) AS fi, CAST(scan % 3 + 1 AS INTEGER) AS fj, src AS flight, point_id, t, x, y, e3d FROM cl")
def window_files(spark: SparkSession, d: str) -> DataFrame:
    """Extracted windows with all their columns, a folder per pair and flight."""
    rows = _cloud(spark, d).select((F.col("scan") % 3).cast("int").alias("fi"), (F.col("scan") % 3 + 1).cast("int").alias("fj"), F.col("src").alias("flight"), "point_id", "t", "x", "y", "e3d")
    path = shared_folder(spark, "windows")
    sinks.write_windows(rows, path)
    return spark.read.parquet(path).select(rows.columns)


@query(f"WITH {FILE_SQL} SELECT src AS flight, t, x, y, z, x / 8 AS lvx, y / 8 AS lvy, e3d AS lvz FROM cl")
def window_text(spark: SparkSession, d: str) -> DataFrame:
    """The same as text with ten decimals."""
    rows = _cloud(spark, d).select((F.col("scan") % 3).alias("fi"), (F.col("scan") % 3 + 1).alias("fj"), F.col("src").alias("flight"), "t", "x", "y", F.round("z", 3).alias("z"), (F.col("x") / 8).alias("lvx"), (F.col("y") / 8).alias("lvy"), F.col("e3d").alias("lvz"))
    path = shared_folder(spark, "windows")
    sinks.write_window_text(rows, path, vector=("lvx", "lvy", "lvz"))
    got = text.ascii_cloud(spark, path)
    return got.select(F.regexp_extract("file", "flight=([^/]+)/", 1).alias("flight"), "t", "x", "y", "z", "lvx", "lvy", "lvz")


@query(f"WITH {FILE_SQL} SELECT src AS method, t, x, y, x - y AS z, e3d FROM cl")
def error_points(spark: SparkSession, d: str) -> DataFrame:
    """Error points of several methods, a folder per method, read together."""
    path = shared_folder(spark, "errors")
    sinks.write_errors(_cloud(spark, d).withColumnRenamed("src", "method"), path)
    return text.error_points(spark, path).select("method", "t", "x", "y", "z", "e3d")


@query(f"WITH {FILE_SQL} SELECT src AS method, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg(e3d * e3d)), 6) AS rmse, round(avg(e3d), 6) AS mean, round(max(e3d), 6) AS largest FROM cl GROUP BY src")
def summary_file(spark: SparkSession, d: str) -> DataFrame:
    """An error summary as a report."""
    path = shared_folder(spark, "summary")
    rows = _cloud(spark, d).groupBy(F.col("src").alias("method")).agg(F.count("*").alias("n"), metrics.rmse("e3d").alias("rmse"), F.avg("e3d").alias("mean"), F.max("e3d").alias("largest"))
    sinks.write_summary(rows, path, ["method"])
    return spark.read.csv(path, header=True, schema="method string, n long, rmse double, mean double, largest double")


@query(f"WITH {CHUNK_SQL} SELECT chunk_k, point_id FROM chunked WHERE chunk_k IN (SELECT chunk_k FROM chunked GROUP BY chunk_k HAVING count(*) >= 30)")
def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of at least 30 points, a folder each."""
    p = points(spark, d).where("src = 'click'").select("point_id", "t", "x", "y")
    cut = chunking.chunk_points(p, trajectory(spark, d), LENGTH, LEAST, DAY, HOUR, min_points=30)
    path = shared_folder(spark, "chunks")
    text.write_chunks(cut, path, ["chunk_k"])
    return spark.read.schema("point_id long, chunk_k int").parquet(path).select("chunk_k", "point_id")
