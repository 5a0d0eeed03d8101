"""Registered queries, one or more for each operator, over the driver's tables in their roles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geodesy, scalars
from ..functions import rotations as rot
from ..operators import calibration, chunking, clouds, footprint, matching, metrics, neighbours, ordered, pairs, patches
from ..operators import trajectory as trj
from ..operators.range_join import range_join
from .roles import CLOUD_SQL, DAY, HOUR, POINTS_SQL, SEGMENTS_SQL, TRAJECTORY_SQL, cloud, points, rounded, trajectory

QUERIES: dict = {}
SQL: dict[str, str] = {}
START = 1_704_067_200_000_000  # 2024-01-01, microseconds


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# --- errors between clouds -------------------------------------------------------------------------------------


def _reference(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return p.unionByName(p.where("point_id % 50 = 0"))


def _target(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).withColumn("t", F.col("t") + F.when(F.col("point_id") % 3 == 0, 1).otherwise(0)).withColumn("x", F.col("x") + (F.col("point_id") % 7) / F.lit(100.0))


ERRORS_SQL = POINTS_SQL + """,
ref AS (SELECT src, t, x, y FROM pts UNION ALL SELECT src, t, x, y FROM pts WHERE point_id % 50 = 0),
tgt AS (SELECT src, t + CASE WHEN point_id % 3 = 0 THEN 1 ELSE 0 END AS t, x + (point_id % 7) / CAST(100 AS DOUBLE) AS x, y, point_id FROM pts),
r1 AS (SELECT src, t, any_value(x) AS x, any_value(y) AS y FROM ref GROUP BY src, t HAVING count(*) = 1),
t1 AS (SELECT src, t, any_value(x) AS x, any_value(y) AS y FROM tgt GROUP BY src, t HAVING count(*) = 1),
e AS (SELECT src, t, t1.x - r1.x AS dx, CAST(t1.y - r1.y AS DOUBLE) AS dy, sqrt((t1.x - r1.x) * (t1.x - r1.x) + (t1.y - r1.y) * (t1.y - r1.y)) AS e FROM r1 JOIN t1 USING (src, t))"""


@query(f"""WITH {ERRORS_SQL}
SELECT src, count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS mean, round(max(e), 6) AS max, round(quantile_cont(e, 0.5), 6) AS q50, round(quantile_cont(e, 0.95), 6) AS q95, round(quantile_cont(e, 0.99), 6) AS q99,
  round(100 * avg(CASE WHEN e > 0.015 THEN 1 ELSE 0 END), 6) AS above_1, round(100 * avg(CASE WHEN e > 0.035 THEN 1 ELSE 0 END), 6) AS above_2, round(100 * avg(CASE WHEN e > 0.055 THEN 1 ELSE 0 END), 6) AS above_3,
  round(avg(dx), 6) AS dx_mean, round(stddev_pop(dx), 6) AS dx_std, round(avg(dy), 6) AS dy_mean, round(stddev_pop(dy), 6) AS dy_std
FROM e GROUP BY src""")
def rmse_summary(spark: SparkSession, d: str) -> DataFrame:
    e = matching.time_errors(_reference(spark, d), _target(spark, d), ["x", "y"], ["src"])
    return rounded(metrics.summary(e, ["src"], axes=["dx", "dy"], limits=(0.015, 0.035, 0.055)))


@query(f"""WITH {ERRORS_SQL},
g AS (SELECT coalesce(r.src, t.src) AS src, nr, nt FROM (SELECT src, t, count(*) AS nr FROM ref GROUP BY src, t) r FULL JOIN (SELECT src, t, count(*) AS nt FROM tgt GROUP BY src, t) t ON r.src = t.src AND r.t = t.t)
SELECT src, CAST(coalesce(sum(nr), 0) AS BIGINT) AS n_ref, CAST(coalesce(sum(nt), 0) AS BIGINT) AS n_tgt, count(*) FILTER (nr > 1) AS ref_dup, count(*) FILTER (nt > 1) AS tgt_dup, count(*) FILTER (nr = 1) AS ref_unique, count(*) FILTER (nt = 1) AS tgt_unique,
  count(*) FILTER (nr = 1 AND coalesce(nt, 0) <> 1) AS only_ref, count(*) FILTER (nt = 1 AND coalesce(nr, 0) <> 1) AS only_tgt, count(*) FILTER (nr = 1 AND nt = 1) AS n_match
FROM g GROUP BY src""")
def match_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_counts(_reference(spark, d), _target(spark, d), ["src"])


OUTAGES = [("o1", 5, 580), ("o2", 12, 475), ("o3", 40, 350)]  # name, start day, hours
ZONES = [(START + 6 * DAY, START + 7 * DAY), (START + 13 * DAY, START + 13 * DAY + 5 * HOUR)]


@query(f"""WITH {ERRORS_SQL},
o(outage, lo, hi) AS (VALUES {', '.join(f"('{n}', {START + s * DAY}, {START + s * DAY + h * HOUR // 10})" for n, s, h in OUTAGES)}),
want AS (SELECT outage, src FROM o, (SELECT DISTINCT src FROM pts)),
m AS (SELECT outage, src, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(e) AS mean, max(e) AS max, quantile_cont(e, 0.5) AS q50, quantile_cont(e, 0.9) AS q90, 100 * avg(CASE WHEN e > 0.025 THEN 1 ELSE 0 END) AS above_1
  FROM e JOIN o ON t BETWEEN lo AND hi WHERE NOT {' AND NOT '.join(f'(t BETWEEN {a} AND {b})' for a, b in ZONES)} GROUP BY outage, src)
SELECT outage, src, coalesce(n, 0) AS n, round(rmse, 6) AS rmse, round(mean, 6) AS mean, round(max, 6) AS max, round(q50, 6) AS q50, round(q90, 6) AS q90, round(above_1, 6) AS above_1 FROM want LEFT JOIN m USING (outage, src)""")
def outage_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics per outage and source, without exclusion zones; empty ones kept."""
    e = matching.time_errors(_reference(spark, d), _target(spark, d), ["x", "y"], ["src"])
    windows = spark.createDataFrame([(n, START + s * DAY, START + s * DAY + h * HOUR // 10) for n, s, h in OUTAGES], "outage string, lo long, hi long")
    rows = range_join(e.where(scalars.outside(F.col("t"), ZONES)), windows, "t", "lo", "hi", DAY, closed="both")
    m = metrics.summary(rows, ["outage", "src"], limits=(0.025,), quantiles=(0.5, 0.9))
    want = points(spark, d).select("src").distinct().crossJoin(F.broadcast(windows.select("outage")))
    return rounded(metrics.with_empty(m, want, ["outage", "src"]))


# --- trajectories ----------------------------------------------------------------------------------------------

AT_SQL = SEGMENTS_SQL + """,
qp AS (SELECT p.*, least(greatest(p.t, tlo), thi) AS u FROM pts p, ends WHERE src = 'click'),
pos AS (SELECT qp.*, CASE WHEN tn IS NULL THEN a.x ELSE a.x + (xn - a.x) * ((u - a.t) / CAST(tn - a.t AS DOUBLE)) END AS tx, CASE WHEN tn IS NULL THEN a.y ELSE a.y + (yn - a.y) * ((u - a.t) / CAST(tn - a.t AS DOUBLE)) END AS ty
  FROM qp ASOF JOIN ahead a ON qp.u >= a.t)"""


@query(f"WITH {AT_SQL} SELECT point_id, round(tx, 6) AS trj_x, round(ty, 6) AS trj_y FROM pos")
def trajectory_interp(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).where("src = 'click'")
    return rounded(trj.interpolate(p, trajectory(spark, d), ["x", "y"], HOUR, DAY).select("point_id", "trj_x", "trj_y"))


@query(f"WITH {AT_SQL}, q AS (SELECT *, sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) AS d FROM pos) SELECT point_id, round(d, 6) AS distance FROM q WHERE d <= 60")
def distance_filter(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).where("src = 'click'").withColumn("y", F.col("y").cast("double"))
    return rounded(clouds.near_trajectory(p, trajectory(spark, d), 60.0, HOUR, DAY).select("point_id", "distance"))


@query(f"""WITH {POINTS_SQL},
las AS (SELECT scan, t / 1e6 - (scan % 5) * 86400 AS t FROM pts WHERE src = 'click'),
m AS (SELECT median(t / 1e6) AS mt FROM pts WHERE src = 'view'),
s AS (SELECT scan, round_even((any_value(mt) - median(t)) / 86400, 0) AS day_shift FROM las, m GROUP BY scan)
SELECT scan, CAST(day_shift AS BIGINT) AS day_shift, count(*) AS n, round(min(t + day_shift * 86400 + 18), 3) AS t_min, round(max(t + day_shift * 86400 + 18), 3) AS t_max FROM las JOIN s USING (scan) GROUP BY scan, day_shift""")
def day_shift_sync(spark: SparkSession, d: str) -> DataFrame:
    las = points(spark, d).where("src = 'click'").select("scan", (F.col("t") / 1e6 - (F.col("scan") % 5) * 86400).alias("t"))
    path = points(spark, d).where("src = 'view'").select((F.col("t") / 1e6).alias("t"))
    rows = clouds.day_shift(las, path, keys=["scan"], leap=18)
    out = rows.groupBy("scan", F.col("day_shift").cast("long").alias("day_shift")).agg(F.count("*").alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))
    return rounded(out, 3)


@query(f"""WITH {TRAJECTORY_SQL}, st AS (SELECT t, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS d FROM trj WINDOW w AS (ORDER BY t))
SELECT t, round(coalesce(sum(d) OVER (ORDER BY t), 0), 4) AS s FROM st""")
def curvilinear_distance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ordered.path_length(trajectory(spark, d), "t", ("x", "y"), DAY).select("t", "s"), 4)


@query(f"""WITH {SEGMENTS_SQL} SELECT t, tn AS t_next, round(xn - x, 6) AS dx FROM ahead""")
def trajectory_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered.next_row(trajectory(spark, d), "t", ["x"], DAY)
    return rounded(rows.select("t", "t_next", (F.col("x_next") - F.col("x")).alias("dx")))


# --- filters and manifests -------------------------------------------------------------------------------------

WINDOWS = [(START + 2 * DAY, 10 * HOUR), (START + 9 * DAY, 30 * HOUR)]


@query(f"""WITH {POINTS_SQL} SELECT point_id, t FROM pts WHERE {' OR '.join(f't BETWEEN {a - HOUR} AND {a + b + HOUR}' for a, b in WINDOWS)}""")
def time_window_or(spark: SparkSession, d: str) -> DataFrame:
    return clouds.required(points(spark, d).where(scalars.any_window(F.col("t"), WINDOWS, HOUR)).select("point_id", "t"), "no point in the windows")


MANIFEST_SQL = POINTS_SQL + ", man AS (SELECT scan, min(t) AS t_min, max(t) AS t_max FROM pts GROUP BY scan)"


@query(f"""WITH {MANIFEST_SQL}, k AS (SELECT scan FROM man WHERE {' OR '.join(f'(t_max >= {a - HOUR} AND t_min <= {a + b + HOUR})' for a, b in WINDOWS)})
SELECT p.scan, count(*) AS n FROM pts p JOIN k USING (scan) GROUP BY p.scan""")
def manifest_prune(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    man = clouds.time_bounds(p, ["scan"])
    keep = clouds.within_manifest(man, WINDOWS, HOUR).select("scan")
    return p.join(keep, "scan", "left_semi").groupBy("scan").agg(F.count("*").alias("n"))


@query(f"""WITH {POINTS_SQL} SELECT scan, min(t) AS t_start, max(t) AS t_end, count(*) FILTER (src = 'view') AS n_vux, count(*) FILTER (src = 'click') AS n_puck, count(*) AS n_total FROM pts GROUP BY scan""")
def scan_manifest(spark: SparkSession, d: str) -> DataFrame:
    return clouds.scan_manifest(points(spark, d), ["scan"], source="src", names={"vux": "view", "puck": "click"})


@query(f"""WITH {POINTS_SQL} SELECT scan, arg_min(t, point_id) AS t_first, arg_max(t, point_id) AS t_last FROM pts GROUP BY scan""")
def first_last_times(spark: SparkSession, d: str) -> DataFrame:
    return clouds.time_bounds(points(spark, d), ["scan"], index="point_id")


@query(f"""WITH {POINTS_SQL} SELECT src, floor(min(x)) AS offset_x, CAST(floor(min(y)) AS DOUBLE) AS offset_y, CAST(floor(min(t)) AS DOUBLE) AS offset_z FROM pts GROUP BY src""")
def las_offsets(spark: SparkSession, d: str) -> DataFrame:
    return clouds.las_offsets(points(spark, d).withColumn("z", F.col("t")), ["src"])


@query(f"""WITH {POINTS_SQL},
a AS (SELECT scan, min(point_id) AS f FROM pts WHERE src = 'view' GROUP BY scan), b AS (SELECT scan, min(point_id) AS f FROM pts WHERE src = 'click' GROUP BY scan)
SELECT scan AS scan_id, a.f AS file_0, b.f AS file_1, CAST(1000 * row_number() OVER (ORDER BY scan) AS INTEGER) AS label FROM a JOIN b USING (scan)""")
def merge_pairing(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select(F.col("scan").alias("scan_id"), F.col("point_id").alias("filename"), "src")
    return clouds.pair_scans(p.where("src = 'view'"), p.where("src = 'click'"))


SCANS_SQL = "scans AS (SELECT CAST(floor((t - 1704067200000000) / 86400000000.0) AS BIGINT) AS scan_id, min(t) AS t_start, max(t) AS t_end FROM pts WHERE src = 'view' GROUP BY 1)"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor((F.col("t") - START) / float(DAY)).cast("long")
    return points(spark, d).where("src = 'view'").groupBy(day.alias("scan_id")).agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"))


@query(f"""WITH {POINTS_SQL}, {SCANS_SQL},
c AS (SELECT *, lag(t_end) OVER w AS pe, lead(t_end) OVER w IS NULL AS last FROM scans WINDOW w AS (ORDER BY t_start))
SELECT scan_id AS slice_scan, point_id, t FROM pts p JOIN c ON (pe IS NULL OR p.t > pe) AND (last OR p.t <= t_end) WHERE p.src = 'click'""")
def puck_slice(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).where("src = 'click'").select("point_id", "t")
    return clouds.slice_onto_scans(p, _daily(spark, d), DAY).select("slice_scan", "point_id", "t")


@query(f"""WITH {POINTS_SQL} SELECT source, count(*) AS n, round(sum(x), 4) AS sum_x, CAST(sum(scanner_src) AS BIGINT) AS sum_src FROM (
  SELECT 'vux' AS source, x, 2 AS scanner_src FROM pts WHERE src = 'view' UNION ALL SELECT 'puck', x, 1 FROM pts WHERE src = 'click' UNION ALL SELECT 'other', x, NULL FROM pts WHERE src = 'error') GROUP BY source""")
def union_clouds(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    part = lambda s, n: p.where(F.col("src") == s).select(F.lit(n).alias("source"), "x")
    rows = clouds.union_clouds(part("view", "vux").withColumn("scanner_src", F.lit(2)), part("click", "puck").withColumn("scanner_src", F.lit(1)), part("error", "other"), strict=False)
    return rounded(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.sum("scanner_src").alias("sum_src")), 4)


@query(f"""WITH {POINTS_SQL}, m AS (SELECT scan, min(t) AS a, max(t) AS b FROM pts WHERE src = 'view' GROUP BY scan), r AS (SELECT scan AS ref, scan AS ref_pos, min(t) AS c, max(t) AS e FROM pts WHERE src = 'click' GROUP BY scan)
SELECT scan AS target, ref, least(b, e) - greatest(a, c) AS overlap FROM m, r WHERE least(b, e) > greatest(a, c) QUALIFY row_number() OVER (PARTITION BY scan ORDER BY least(b, e) - greatest(a, c) DESC, ref_pos) = 1""")
def best_overlap(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    t = p.where("src = 'view'").groupBy(F.col("scan").alias("target")).agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"))
    r = p.where("src = 'click'").groupBy(F.col("scan").alias("ref")).agg(F.min("t").alias("r_start"), F.max("t").alias("r_end")).withColumn("ref_pos", F.col("ref"))
    return clouds.best_overlap(t, r, 5.0 * DAY).select("target", "ref", "overlap")


# --- chunks ----------------------------------------------------------------------------------------------------

LENGTH = 4000.0
LEAST = chunking.least_last(LENGTH)
EDGES_SQL = """ed AS (SELECT {keys} k, s0, s1, n, CASE WHEN s1 - s0 <= {L} THEN [s0, s1] ELSE list_concat(CASE WHEN n >= 2 AND s1 - (s0 + (n - 1) * {L}) < {M} THEN list_transform(range(0, n - 1), lambda i: s0 + i * {L}) ELSE list_transform(range(0, n), lambda i: s0 + i * {L}) END, [s1]) END AS e
  FROM (SELECT *, CAST(ceil((s1 - s0) / {L}) AS INTEGER) AS n FROM ext))"""


@query(f"""WITH {POINTS_SQL}, ext AS (SELECT scan AS k, CAST(min(x) AS DOUBLE) AS s0, max(x) * 1.7 AS s1 FROM pts GROUP BY scan), {EDGES_SQL.format(keys='', L='CAST(15 AS DOUBLE)', M='CAST(10 AS DOUBLE)')}
SELECT k AS scan, CAST(len(e) AS INTEGER) - 1 AS n_chunks, round(e[len(e) - 1], 6) AS last_lo, round(e[len(e)], 6) AS last_hi FROM ed""")
def chunk_edges(spark: SparkSession, d: str) -> DataFrame:
    ext = points(spark, d).groupBy("scan").agg(F.min("x").alias("s0"), (F.max("x") * 1.7).alias("s1"))
    rows = chunking.edge_rows(ext, "s0", "s1", 15.0, 10.0, ["scan"])
    out = rows.groupBy("scan").agg((F.max("chunk_k") + 1).alias("n_chunks"), F.max_by("s_lo", "chunk_k").alias("last_lo"), F.max_by("s_hi", "chunk_k").alias("last_hi"))
    return rounded(out)


CHUNK_SQL = TRAJECTORY_SQL + f""",
c AS (SELECT point_id, t, x, y FROM pts WHERE src = 'click'), b AS (SELECT min(t) AS a, max(t) AS z FROM c),
own AS (SELECT t, x, y FROM trj, b WHERE t BETWEEN a AND z),
st AS (SELECT t, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS d FROM own WINDOW w AS (ORDER BY t)),
path AS (SELECT t, sum(d) OVER (ORDER BY t) AS s FROM st),
ext AS (SELECT 0 AS k, min(s) AS s0, max(s) AS s1 FROM path), {EDGES_SQL.format(keys='', L=f'CAST({LENGTH} AS DOUBLE)', M=f'CAST({LEAST} AS DOUBLE)')},
marks AS (SELECT unnest(range(0, len(e))) AS k, unnest(e) AS edge, len(e) - 1 AS last FROM ed),
seg AS (SELECT t AS ta, lead(t) OVER w AS tb, s AS sa, lead(s) OVER w AS sb FROM path WINDOW w AS (ORDER BY t)),
times AS (SELECT k, ta + (tb - ta) * (edge - sa) / (sb - sa) AS t FROM marks JOIN seg ON edge > sa AND edge <= sb AND sb > sa WHERE k > 0 AND k < last
  UNION ALL SELECT k, CAST((SELECT min(t) FROM path) AS DOUBLE) FROM marks WHERE k = 0 UNION ALL SELECT k, CAST((SELECT max(t) FROM path) AS DOUBLE) FROM marks WHERE k = last),
iv AS (SELECT k, t AS lo, lead(t) OVER (ORDER BY k) AS hi FROM times),
chunked AS (SELECT CAST(k AS INTEGER) AS chunk_k, c.* FROM c JOIN iv ON c.t >= lo AND c.t < hi)"""


def _chunked(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).where("src = 'click'").select("point_id", "t", "x", "y")
    return chunking.chunk_points(p, trajectory(spark, d), LENGTH, LEAST, DAY, HOUR)


@query(f"WITH {CHUNK_SQL} SELECT chunk_k, point_id FROM chunked")
def chunk_assign(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d).select("chunk_k", "point_id")


@query(f"WITH {CHUNK_SQL} SELECT chunk_k, count(*) AS n, min(t) AS t_start, max(t) AS t_end, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, min(y) AS y_min, max(y) AS y_max FROM chunked GROUP BY chunk_k")
def chunk_bbox(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunked(spark, d)
    n = rows.groupBy("chunk_k").agg(F.count("*").alias("n"))
    return rounded(chunking.chunk_boxes(rows, ["chunk_k"]).join(n, "chunk_k"))


@query(f"""WITH {SEGMENTS_SQL}, g AS (SELECT scan, min(t) AS t_start, max(t) AS t_end FROM pts WHERE src = 'click' GROUP BY scan),
s AS (SELECT scan, t_start, t_end, t_start + (t_end - t_start) * CAST(i AS DOUBLE) / 19 AS t FROM g, range(0, 20) r(i)),
u AS (SELECT s.*, least(greatest(t, CAST(tlo AS DOUBLE)), CAST(thi AS DOUBLE)) AS u FROM s, ends),
v AS (SELECT u.scan, t_start, t_end, CASE WHEN tn IS NULL THEN a.x ELSE a.x + (xn - a.x) * ((u - a.t) / CAST(tn - a.t AS DOUBLE)) END AS tx, CASE WHEN tn IS NULL THEN a.y ELSE a.y + (yn - a.y) * ((u - a.t) / CAST(tn - a.t AS DOUBLE)) END AS ty FROM u ASOF JOIN ahead a ON u.u >= a.t)
SELECT scan, t_start, t_end, round(min(tx), 4) AS x_min, round(max(tx), 4) AS x_max, round(min(ty), 4) AS y_min, round(max(ty), 4) AS y_max FROM v GROUP BY scan, t_start, t_end""")
def chunk_bbox_trajectory(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).where("src = 'click'")
    return rounded(chunking.trajectory_boxes(p, trajectory(spark, d), ["scan"], HOUR, DAY), 4)


AXIS_SQL = POINTS_SQL + """,
ax AS (SELECT scan, arg_min(x, t) AS ox, arg_min(y, t) AS oy, arg_max(x, t) - arg_min(x, t) AS dx, arg_max(y, t) - arg_min(y, t) AS dy FROM pts WHERE src = 'view' GROUP BY scan),
pr AS (SELECT p.scan, point_id, src, ((x - ox) * (dx / sqrt(dx * dx + dy * dy)) + (y - oy) * (dy / sqrt(dx * dx + dy * dy))) AS proj FROM pts p JOIN ax USING (scan) WHERE sqrt(dx * dx + dy * dy) >= 1e-6),
ext AS (SELECT scan AS k, min(proj) AS s0, max(proj) AS s1 FROM pr WHERE src = 'view' GROUP BY scan)"""


def _projected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, d)
    axes = chunking.axis(p.where("src = 'view'"), ["scan"]).where("tx is not null")
    pr = chunking.project(p, axes, ["scan"])
    return pr, pr.where("src = 'view'").groupBy("scan").agg(F.min("proj").alias("s_min"), F.max("proj").alias("s_max"))


SPATIAL_SQL = AXIS_SQL + ", " + EDGES_SQL.format(keys="", L="CAST(20 AS DOUBLE)", M="CAST(13.33 AS DOUBLE)") + """,
iv AS (SELECT k AS scan, unnest(range(0, len(e) - 1)) AS c, unnest(e[1:len(e) - 1]) AS lo, unnest(e[2:len(e)]) AS hi FROM ed)"""


@query(f"WITH {SPATIAL_SQL} SELECT scan, CAST(c AS INTEGER) AS chunk_k, count(*) AS n FROM pr JOIN iv USING (scan) WHERE proj >= lo AND proj < hi AND src <> 'view' GROUP BY scan, c")
def spatial_chunks(spark: SparkSession, d: str) -> DataFrame:
    pr, ext = _projected(spark, d)
    rows = chunking.chunk_by_axis(pr.where("src <> 'view'"), ext, 20.0, chunking.least_last(20.0), ["scan"])
    return rows.groupBy("scan", "chunk_k").agg(F.count("*").alias("n"))


@query(f"WITH {SPATIAL_SQL}, q AS (SELECT DISTINCT scan, src, CAST(c AS INTEGER) AS chunk_k FROM pr JOIN iv USING (scan) WHERE proj >= lo AND proj < hi) SELECT scan, chunk_k FROM q WHERE src = 'click' INTERSECT SELECT scan, chunk_k FROM q WHERE src = 'error'")
def common_chunks(spark: SparkSession, d: str) -> DataFrame:
    pr, ext = _projected(spark, d)
    rows = chunking.chunk_by_axis(pr, ext, 20.0, chunking.least_last(20.0), ["scan"])
    return chunking.common_chunks(rows.where("src = 'click'"), rows.where("src = 'error'"), ["scan"])


# --- pairs -----------------------------------------------------------------------------------------------------

BOXES_SQL = POINTS_SQL + ", bx AS (SELECT CAST(floor((t - 1704067200000000) / 7200000000.0) AS BIGINT) AS chunk, CAST(floor((t - 1704067200000000) / 86400000000.0) AS BIGINT) AS scan, min(t) AS t_start, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM pts GROUP BY ALL)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of two hours in scans of a day, with the extents of all their points."""
    number = lambda unit: F.floor((F.col("t") - START) / float(unit)).cast("long")
    rows = points(spark, d).withColumns({"chunk": number(2 * HOUR), "scan": number(DAY)})
    return chunking.chunk_boxes(rows, ["chunk", "scan"]).drop("t_end")


@query(f"""WITH {BOXES_SQL}, o AS (SELECT scan, chunk, row_number() OVER (PARTITION BY scan ORDER BY chunk) AS r FROM bx)
SELECT a.scan, a.chunk AS a, b.chunk AS b, CAST(b.r - a.r AS INTEGER) AS step FROM o a JOIN o b ON a.scan = b.scan AND b.r - a.r BETWEEN 1 AND 2""")
def f2b_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.neighbours(_boxes(spark, d).select("scan", "chunk"), 2)


@query(f"""WITH {BOXES_SQL}, e AS (SELECT scan, min(chunk) AS f, max(chunk) AS l FROM bx GROUP BY scan)
SELECT lag(scan) OVER w AS scan_a, lag(l) OVER w AS a, scan AS scan_b, f AS b FROM e WINDOW w AS (ORDER BY scan) QUALIFY scan_a IS NOT NULL""")
def cross_scan_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.across_scans(_boxes(spark, d).select("scan", "chunk"))


@query(f"""WITH {BOXES_SQL}, s AS (SELECT chunk, x_min, x_max, y_min, y_max, row_number() OVER (ORDER BY t_start, chunk) - 1 AS seq FROM bx)
SELECT a.chunk AS a, b.chunk AS b, CAST(a.seq AS INTEGER) AS seq_a, CAST(b.seq AS INTEGER) AS seq_b FROM s a JOIN s b ON a.seq + 10 < b.seq AND a.x_min - 0.5 <= b.x_max AND b.x_min - 0.5 <= a.x_max AND a.y_min - 0.5 <= b.y_max AND b.y_min - 0.5 <= a.y_max""")
def crossing_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.crossings(_boxes(spark, d), 10, 0.5, 200.0, block=float(DAY))


@query(f"""WITH {POINTS_SQL}, f AS (SELECT DISTINCT scan AS a, y AS b FROM pts WHERE y <> scan)
SELECT x.a, CAST(x.b AS BIGINT) AS b, 'Patch_from_scan_' || x.a || '_with_' || x.b || '.las' AS file_ab, 'Patch_from_scan_' || x.b || '_with_' || x.a || '.las' AS file_ba FROM f x JOIN f z ON x.a = z.b AND x.b = z.a WHERE x.a < x.b""")
def reciprocal_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).where("y <> scan")
    return pairs.reciprocal(p.select(F.format_string("Patch_from_scan_%d_with_%d.las", "scan", "y").alias("name")))


@query("WITH f AS (SELECT DISTINCT n_name AS f FROM nation) SELECT a.f AS fi, b.f AS fj FROM f a JOIN f b ON a.f < b.f")
def flight_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.flight_pairs(spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("flight")).distinct())


@query(f"""WITH {POINTS_SQL}, m AS (SELECT scan, avg(t) FILTER (src = 'view') AS f, avg(t) FILTER (src = 'click') AS b FROM pts GROUP BY scan) SELECT scan FROM m WHERE abs(f - b) >= 86400000000""")
def pair_separation(spark: SparkSession, d: str) -> DataFrame:
    m = points(spark, d).groupBy("scan").agg(F.avg(F.when(F.col("src") == "view", F.col("t"))).alias("mean_a"), F.avg(F.when(F.col("src") == "click", F.col("t"))).alias("mean_b"))
    return pairs.separated(m, DAY).select("scan")


# --- joins by time and place -----------------------------------------------------------------------------------


@query(f"""WITH {POINTS_SQL}, m2 AS (SELECT point_id AS id, t + (point_id % 1000) * 1000000 AS q FROM pts WHERE src = 'error'),
c AS (SELECT id, q, p.point_id, abs(p.t - q) AS dt FROM m2 JOIN pts p ON p.src = 'view' AND p.t > q - 1800000000 AND p.t < q + 1800000000)
SELECT m2.id, q, b.point_id, b.dt FROM m2 LEFT JOIN (SELECT id, point_id, dt FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY dt, point_id) = 1) b USING (id)""")
def nearest_time(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    marks = p.where("src = 'error'").select(F.col("point_id").alias("id"), (F.col("t") + (F.col("point_id") % 1000) * 1_000_000).alias("q"))
    rows = matching.nearest_in_time(marks, p.where("src = 'view'").select("point_id", "t"), HOUR // 2, HOUR, "id", "q", ["point_id"])
    return rows.select("id", "q", "point_id", "dt")


@query(f"""WITH {POINTS_SQL}, q AS (SELECT point_id AS id, t + 1000000 AS q FROM pts WHERE src = 'error'),
c AS (SELECT id, p.point_id, p.x FROM q JOIN pts p ON p.src <> 'error' AND p.t > q - 120000000 AND p.t < q + 120000000)
SELECT id, any_value(point_id) AS point_id, round(any_value(x), 6) AS x FROM c GROUP BY id HAVING count(*) = 1""")
def unique_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    q = p.where("src = 'error'").select(F.col("point_id").alias("id"), (F.col("t") + 1_000_000).alias("q"))
    found, _ = matching.unique_lookup(q, p.where("src <> 'error'").select("point_id", "t", "x"), 120_000_000, HOUR, "id", "q")
    return rounded(found.select("id", "point_id", "x"))


@query(f"""WITH {POINTS_SQL}, q AS (SELECT point_id AS id, t + 1000000 AS q, x AS qx, y AS qy FROM pts WHERE src = 'error'),
c AS (SELECT id, p.point_id, sqrt((p.x - qx) * (p.x - qx) + (p.y - qy) * (p.y - qy)) AS dist FROM q JOIN pts p ON p.src <> 'error' AND p.t > q - 3600000000 AND p.t < q + 3600000000)
SELECT id, point_id, round(dist, 6) AS dist FROM c WHERE dist < 40 QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, point_id) = 1""")
def reproject(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    q = p.where("src = 'error'").select(F.col("point_id").alias("id"), (F.col("t") + 1_000_000).alias("q_t"), F.col("x").alias("q_x"), F.col("y").alias("q_y"))
    rows = matching.reproject(q, p.where("src <> 'error'").select("point_id", "t", "x", "y"), HOUR, 40.0, HOUR, "id", ["x", "y"], "point_id")
    return rounded(rows.select("id", "point_id", "dist"))


@query(f"""WITH {POINTS_SQL}, q AS (SELECT point_id AS id, t - 18000000 AS q, x AS qx, y AS qy FROM pts WHERE src = 'error'),
c AS (SELECT id, p.point_id, p.t, sqrt((p.x - qx) * (p.x - qx) + (p.y - qy) * (p.y - qy)) AS dist FROM q JOIN pts p ON p.src <> 'error' AND p.t > q - 3600000000 AND p.t < q + 3600000000),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, point_id) = 1)
SELECT q.id, round(dist, 6) AS dist, t AS ref_t FROM q LEFT JOIN (SELECT * FROM b WHERE dist <= 30) USING (id)""")
def nearest_reference(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    q = p.where("src = 'error'").select(F.col("point_id").alias("id"), (F.col("t") - 18_000_000).alias("q"), "x", "y")
    rows = matching.nearest_reference(q, p.where("src <> 'error'").select("point_id", "t", "x", "y"), HOUR, 30.0, HOUR, "id", "q", ["x", "y"], ["point_id"])
    return rounded(rows.select("id", "dist", "ref_t"))


@query(f"""WITH {CLOUD_SQL}, m AS (SELECT point_id AS id, src, x AS mx, y AS my, z AS mz FROM cloud)
SELECT id, count(point_id) AS n, round(count(point_id) / (pi() * 0.15 * 0.15), 1) AS density FROM m LEFT JOIN cloud c ON m.src = c.src AND abs(z - mz) < 0.1 AND (x - mx) * (x - mx) + (y - my) * (y - my) <= 0.15 * 0.15 GROUP BY id""")
def density(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    marks = c.select(F.col("point_id").alias("id"), "src", *(F.col(a).alias(f"m{a}") for a in "xyz"))
    return matching.density(marks, c.select("src", "x", "y", "z"), 0.15, 0.1, "id", ["src"]).select("id", "n", "density")


VECTORS_SQL = POINTS_SQL + """,
v AS (SELECT t AS time_a, t + point_id % 3 AS time_b, x / 15 AS rng FROM pts WHERE src = 'view'), nom AS (SELECT t AS time_a, abs(sin(x)) AS e FROM pts),
o AS (SELECT t AS time_a, t + point_id % 4 % 3 AS time_b, abs(cos(x)) AS e_out FROM pts),
j AS (SELECT * FROM v JOIN nom USING (time_a) LEFT JOIN o USING (time_a, time_b))"""


def _vector_errors(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    v = p.where("src = 'view'").select(F.col("t").alias("time_a"), (F.col("t") + F.col("point_id") % 3).alias("time_b"), (F.col("x") / 15).alias("rng"))
    nominal = p.select(F.col("t").alias("time_a"), F.abs(F.sin("x")).alias("e"))
    outage = p.select(F.col("t").alias("time_a"), (F.col("t") + F.col("point_id") % 4 % 3).alias("time_b"), F.abs(F.cos("x")).alias("e_out"))
    return matching.vector_errors(v, nominal, outage)


@query(f"""WITH {VECTORS_SQL}, u AS (SELECT 'nominal' AS series, e FROM j UNION ALL SELECT 'outage', e_out FROM j)
SELECT series, count(e) AS n, round(100 * quantile_cont(e, 0.5), 6) AS q50_cm, round(100 * quantile_cont(e, 0.95), 6) AS q95_cm, round(100 * sqrt(avg(e * e)), 6) AS rmse_cm FROM u GROUP BY series""")
def l2l_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _vector_errors(spark, d).select(F.explode(F.array(F.struct(F.lit("nominal").alias("series"), F.col("e")), F.struct(F.lit("outage").alias("series"), F.col("e_out").alias("e")))).alias("s")).select("s.*")
    cm = lambda c: 100 * c
    return rounded(rows.groupBy("series").agg(F.count("e").alias("n"), cm(metrics.quantile("e", 0.5)).alias("q50_cm"), cm(metrics.quantile("e", 0.95)).alias("q95_cm"), cm(metrics.rmse("e")).alias("rmse_cm")))


@query(f"""WITH {VECTORS_SQL}, u AS (SELECT 'Global' AS bin, * FROM j UNION ALL SELECT CASE WHEN rng >= 0 AND rng < 10 THEN '[0,10)' WHEN rng >= 10 AND rng < 20 THEN '[10,20)' WHEN rng >= 20 AND rng < 30 THEN '[20,30)' END, * FROM j)
SELECT bin, count(*) AS n, round(quantile_cont(e, 0.5), 6) AS q50, round(sqrt(avg(e * e)), 6) AS rmse, round(sqrt(avg(e_out * e_out)), 6) AS rmse_other FROM u WHERE bin IS NOT NULL GROUP BY bin""")
def l2l_by_range(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.by_range(_vector_errors(spark, d), "rng", "e", "e_out"))


@query(f"WITH {VECTORS_SQL} SELECT time_a // 86400000000 AS day, count(*) AS n, round(median(e), 6) AS median FROM j GROUP BY 1")
def l2l_by_pair(spark: SparkSession, d: str) -> DataFrame:
    rows = _vector_errors(spark, d).withColumn("day", F.expr("time_a div 86400000000"))
    return rounded(rows.groupBy("day").agg(F.count("*").alias("n"), F.median("e").alias("median")))


@query("SELECT l_linenumber AS time_a, l_orderkey AS x_b, l_partkey AS x_a, l_suppkey AS time_b FROM lineitem")
def swap_sides(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("time_a"), F.col("l_orderkey").alias("x_a"), F.col("l_partkey").alias("x_b"), F.col("l_linenumber").alias("time_b"))
    return matching.swap_sides(rows, ["time", "x"])


@query(f"WITH {ERRORS_SQL} SELECT round(sqrt(avg(e * e)), 6) AS rmse, round(max(e), 6) AS max, arg_max(t, (e, t)) AS worst FROM e")
def lcp_summary(spark: SparkSession, d: str) -> DataFrame:
    e = matching.time_errors(_reference(spark, d), _target(spark, d), ["x", "y"], ["src"])
    return rounded(metrics.worst(e, "e", "t"))


# --- rasters, rectangles, axes ---------------------------------------------------------------------------------

GRID = footprint.Grid(0.0, 100.0, 10.0, 60, 12)
FOOT_SQL = POINTS_SQL + ", fp AS (SELECT src AS flight, CAST(floor((100 - y) / 10.0) AS INTEGER) AS row, CAST(floor(x / 10.0) AS INTEGER) AS col, min(t) AS tmin, max(t) AS tmax, count(*) AS n FROM pts WHERE floor((100 - y) / 10.0) BETWEEN 0 AND 11 AND floor(x / 10.0) BETWEEN 0 AND 59 GROUP BY ALL)"


def _footprint(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select(F.col("src").alias("flight"), "t", "x", F.col("y").cast("double").alias("y"))
    return footprint.rasterize(p, GRID)


@query(f"WITH {FOOT_SQL} SELECT * FROM fp")
def footprint_cells(spark: SparkSession, d: str) -> DataFrame:
    return _footprint(spark, d)


@query(f"""WITH {FOOT_SQL} SELECT a.flight AS fi, b.flight AS fj, min(a.tmin) AS tmin_i, max(a.tmax) AS tmax_i, min(b.tmin) AS tmin_j, max(b.tmax) AS tmax_j, count(*) AS n_cells FROM fp a JOIN fp b ON a.flight < b.flight AND a.row = b.row AND a.col = b.col GROUP BY 1, 2
HAVING min(a.tmin) < max(a.tmax) AND min(b.tmin) < max(b.tmax)""")
def overlap_windows(spark: SparkSession, d: str) -> DataFrame:
    return footprint.valid_windows(footprint.overlap_windows(footprint.overlap_cells(_footprint(spark, d))))


@query(f"""WITH {FOOT_SQL}, w AS (SELECT a.flight AS fi, b.flight AS fj, min(a.tmin) AS li, max(a.tmax) AS hi, min(b.tmin) AS lj, max(b.tmax) AS hj FROM fp a JOIN fp b ON a.flight < b.flight AND a.row = b.row AND a.col = b.col GROUP BY 1, 2)
SELECT fi, fj, src AS flight, count(*) AS n FROM w JOIN pts ON (src = fi AND t BETWEEN li AND hi) OR (src = fj AND t BETWEEN lj AND hj) GROUP BY 1, 2, 3""")
def window_extraction(spark: SparkSession, d: str) -> DataFrame:
    w = footprint.overlap_windows(footprint.overlap_cells(_footprint(spark, d)))
    rows = footprint.extract_windows(points(spark, d).withColumnRenamed("src", "flight"), w)
    return rows.groupBy("fi", "fj", "flight").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS_SQL} SELECT round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, CAST(min(y) AS DOUBLE) AS y_min, CAST(max(y) AS DOUBLE) AS y_max FROM pts")
def global_bounds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(footprint.bounds(points(spark, d).withColumn("y", F.col("y").cast("double"))))


@query(f"""WITH {POINTS_SQL}, pt(patch_id, cx, cy, dx, dy, l, w) AS (VALUES (1, 30, 40, 1, 1, 40, 20), (2, 80, 60, 1, -2, 90, 30), (3, 300, 50, 0, 1, 60, 200)),
q AS (SELECT patch_id, point_id, (x - cx) * (dx / sqrt(dx * dx + dy * dy)) + (y - cy) * (dy / sqrt(dx * dx + dy * dy)) AS u, (y - cy) * (dx / sqrt(dx * dx + dy * dy)) - (x - cx) * (dy / sqrt(dx * dx + dy * dy)) AS v, l, w FROM pts, pt)
SELECT patch_id, point_id FROM q WHERE abs(u) <= l / 2 AND abs(v) <= w / 2""")
def rect_filter(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame([(1, 30.0, 40.0, 1.0, 1.0, 40.0, 20.0), (2, 80.0, 60.0, 1.0, -2.0, 90.0, 30.0), (3, 300.0, 50.0, 0.0, 1.0, 60.0, 200.0)], "patch_id int, cx double, cy double, dx double, dy double, length double, width double")
    return footprint.in_rectangles(points(spark, d).select("point_id", "x", "y"), p, 50.0).select("patch_id", "point_id")


@query(f"""WITH {POINTS_SQL}, a AS (SELECT scan, count(*) AS n, avg(x) AS mx, avg(y) AS my, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS th FROM pts GROUP BY scan HAVING count(*) >= 2)
SELECT scan, any_value(n) AS n, round(any_value(mx), 5) AS mx, round(any_value(my), 5) AS my, round(any_value(cos(th)), 5) AS ax, round(any_value(sin(th)), 5) AS ay, round(min((x - mx) * cos(th) + (y - my) * sin(th)), 5) AS s_min, round(max((x - mx) * cos(th) + (y - my) * sin(th)), 5) AS s_max FROM a JOIN pts USING (scan) GROUP BY scan""")
def pca_axis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(footprint.principal_axis(points(spark, d).select("scan", "x", "y"), ["scan"]), 5)


def _zones(spark: SparkSession, d: str) -> DataFrame:
    return footprint.overlap_cells(_footprint(spark, d))


@query()
def largest_component(spark: SparkSession, d: str) -> DataFrame:
    cells = footprint.overlap_cells(_footprint(spark, d))
    return patches.component_cells(cells, ["fi", "fj"])


@query()
def patch_series(spark: SparkSession, d: str) -> DataFrame:
    return patches.zone_patches(_zones(spark, d), GRID, ["fi", "fj"], 30.0, 20.0, 15.0, lines=3, offset=10.0, search=5.0)


@query(f"""WITH {FOOT_SQL}, w AS (SELECT a.flight AS fi, b.flight AS fj, a.row AS row, a.col AS col, a.tmin AS li, a.tmax AS hi, b.tmin AS lj, b.tmax AS hj FROM fp a JOIN fp b ON a.flight < b.flight AND a.row = b.row AND a.col = b.col),
q AS (SELECT fi, fj, fi AS flight, row, col, li AS lo, hi AS up FROM w UNION ALL SELECT fi, fj, fj, row, col, lj, hj FROM w), t AS (SELECT fi, fj, flight, min(lo) AS lo, max(up) AS up FROM q GROUP BY ALL)
SELECT q.fi, q.fj, q.flight, count(*) AS n FROM pts JOIN q ON src = q.flight AND floor((100 - y) / 10.0) = q.row AND floor(x / 10.0) = q.col JOIN t ON q.fi = t.fi AND q.fj = t.fj AND q.flight = t.flight WHERE pts.t BETWEEN t.lo AND t.up GROUP BY ALL""")
def overlap_extraction(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumnRenamed("src", "flight")
    return footprint.extract_overlaps(p, footprint.overlap_cells(_footprint(spark, d)), GRID).groupBy("fi", "fj", "flight").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS_SQL} SELECT point_id, x, y FROM pts WHERE x BETWEEN 20 AND 150 AND y BETWEEN 10 AND 60")
def box_crop(spark: SparkSession, d: str) -> DataFrame:
    return footprint.crop(points(spark, d), (20, 150), (10, 60)).select("point_id", "x", "y")


@query(f"WITH {POINTS_SQL} SELECT point_id, t FROM pts WHERE src = 'view' AND t BETWEEN {START + 3 * DAY} AND {START + 12 * DAY}")
def scanner_crop(spark: SparkSession, d: str) -> DataFrame:
    return clouds.of_scanner(points(spark, d), "view", (START + 3 * DAY, START + 12 * DAY), "src").select("point_id", "t")


@query(f"""WITH {POINTS_SQL} SELECT scan, count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS max FROM pts GROUP BY scan""")
def range_description(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.described(points(spark, d), "x", ["scan"]))


@query(f"""WITH {POINTS_SQL}, a AS (SELECT scan, count(*) AS n, round(avg(x), 6) AS mean FROM pts WHERE src = 'view' GROUP BY scan), b AS (SELECT scan, count(*) AS n, round(avg(x), 6) AS mean FROM pts WHERE src = 'error' GROUP BY scan)
SELECT scan, a.n AS als_n, a.mean AS als_mean, b.n AS mls_n, b.mean AS mls_mean FROM a LEFT JOIN b USING (scan)""")
def side_by_side(spark: SparkSession, d: str) -> DataFrame:
    part = lambda s: rounded(points(spark, d).where(F.col("src") == s).groupBy("scan").agg(F.count("*").alias("n"), F.avg("x").alias("mean")))
    return matching.compared(part("view"), part("error"), ["scan"], ("als_", "mls_"))


@query(f"""WITH {POINTS_SQL}, ext AS (SELECT scan, CAST(min(x) AS DOUBLE) AS lo, max(x) * 1.7 AS hi FROM pts GROUP BY scan)
SELECT scan, CAST(greatest(ceil((hi - lo) / 15), 1) AS INTEGER) AS n_chunks, round(lo + (greatest(ceil((hi - lo) / 15), 1) - 1) * 15, 6) AS last_lo, round(hi, 6) AS last_hi FROM ext""")
def text_chunk_edges(spark: SparkSession, d: str) -> DataFrame:
    ext = points(spark, d).groupBy("scan").agg(F.min("x").alias("lo"), (F.max("x") * 1.7).alias("hi"))
    e = F.col("e")
    rows = ext.withColumn("e", chunking.even_edges(F.col("lo"), F.col("hi"), 15.0))
    return rounded(rows.select("scan", (F.size(e) - 1).alias("n_chunks"), F.element_at(e, -2).alias("last_lo"), F.element_at(e, -1).alias("last_hi")))


# --- ordered rows ----------------------------------------------------------------------------------------------


@query(f"WITH {POINTS_SQL}, f AS (SELECT src, min(point_id) AS f FROM pts GROUP BY src) SELECT src, point_id FROM pts JOIN f USING (src) WHERE (point_id - f) % 7 = 0")
def decimate(spark: SparkSession, d: str) -> DataFrame:
    return ordered.every_nth(points(spark, d), 7, "point_id", ["src"]).select("src", "point_id")


@query(f"""WITH {POINTS_SQL} SELECT scan, point_id, CASE WHEN count(*) OVER (PARTITION BY scan) >= 50 THEN round(sum(x) OVER (PARTITION BY scan ORDER BY t, point_id ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) / 50, 6) ELSE round(x, 6) END AS smooth FROM pts""")
def smooth(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ordered.moving_average(points(spark, d), ["scan"], ["t", "point_id"], "x", 50, "smooth", 5 * DAY).select("scan", "point_id", "smooth"))


@query(f"""WITH {POINTS_SQL}, g AS (SELECT scan, t, src, point_id, CASE WHEN src = lag(src) OVER w THEN 0 ELSE 1 END AS new FROM pts WINDOW w AS (PARTITION BY scan ORDER BY point_id))
SELECT scan, point_id, CAST(sum(new) OVER (PARTITION BY scan ORDER BY point_id) AS BIGINT) AS run FROM g""")
def consecutive_groups(spark: SparkSession, d: str) -> DataFrame:
    return ordered.islands(points(spark, d), "point_id", "src", "run", ["scan"], 1000).select("scan", "point_id", "run")


@query(f"""WITH {POINTS_SQL}, m AS (SELECT min(x) AS lo, max(x) AS hi FROM pts) SELECT src, CAST(least(floor((x - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n FROM pts, m GROUP BY 1, 2""")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(points(spark, d), "x", 50, ["src"])


@query(f"""WITH {POINTS_SQL}, s AS (SELECT src, t, point_id FROM pts UNION ALL SELECT src, t, point_id + 1000000000 FROM pts WHERE point_id % 20 = 0) SELECT src, t, min(point_id) AS point_id FROM s GROUP BY src, t""")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select("src", "t", "point_id")
    rows = p.unionByName(p.where("point_id % 20 = 0").withColumn("point_id", F.col("point_id") + 1_000_000_000))
    return trj.unique_times(rows, order="point_id", keys=["src"])


# --- neighbours and metrics by file ----------------------------------------------------------------------------

NN_SQL = CLOUD_SQL + ", nn AS (SELECT q.src, q.point_id, min(sqrt(power(q.x - p.x, 2) + power(q.y - p.y, 2) + power(q.z - p.z, 2))) AS dist FROM cloud q JOIN cloud p ON q.src = p.src AND q.point_id <> p.point_id WHERE q.point_id % 3 = 0 GROUP BY ALL)"


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return neighbours.nearest_other(ordered.every_nth(c, 3, "point_id"), c, 0.02, ["x", "y", "z"], "point_id", ["src"])


@query(f"WITH {NN_SQL} SELECT src, point_id, round(dist, 6) AS dist FROM nn")
def gsd_nn(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_nearest(spark, d).where("dist is not null"))


@query(f"WITH {NN_SQL}, m AS (SELECT src % 3 AS scanner, src AS file, count(*) AS n, sqrt(avg(dist * dist)) AS rmse, quantile_cont(dist, 0.5) AS q50, stddev_pop(dist) AS std FROM nn GROUP BY src) SELECT scanner, count(DISTINCT file) AS n_files, CAST(sum(n) AS BIGINT) AS n, round(sum(rmse * n) / sum(n), 6) AS rmse, round(sum(q50 * n) / sum(n), 6) AS q50, round(sum(std * n) / sum(n), 6) AS std FROM m GROUP BY scanner")
def gsd_weighted(spark: SparkSession, d: str) -> DataFrame:
    m = _nearest(spark, d).where("dist is not null").groupBy((F.col("src") % 3).alias("scanner"), F.col("src").alias("file")).agg(F.count("*").alias("n"), metrics.rmse("dist").alias("rmse"), metrics.quantile("dist", 0.5).alias("q50"), F.stddev_pop("dist").alias("std"))
    return rounded(metrics.weighted(m, ["scanner"], ["rmse", "q50", "std"]))


# --- rotations and frames --------------------------------------------------------------------------------------


@query(f"WITH {POINTS_SQL} SELECT scan, round(atan2(avg(sin(x / 50)), avg(cos(x / 50))), 6) AS heading FROM pts GROUP BY scan")
def circular_mean(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumn("a", F.col("x") / 50)
    return rounded(p.groupBy("scan").agg(metrics.circular_mean("a").alias("heading")))


ANGLES_SQL = POINTS_SQL + ", a AS (SELECT point_id, x / 700 AS r, y / 300.0 - 0.15 AS p, x / 300 - 0.8 AS h FROM pts), q AS (SELECT point_id, r, p, h, cos(r/2)*cos(p/2)*cos(h/2)+sin(r/2)*sin(p/2)*sin(h/2) AS w, sin(r/2)*cos(p/2)*cos(h/2)-cos(r/2)*sin(p/2)*sin(h/2) AS x, cos(r/2)*sin(p/2)*cos(h/2)+sin(r/2)*cos(p/2)*sin(h/2) AS y, cos(r/2)*cos(p/2)*sin(h/2)-sin(r/2)*sin(p/2)*cos(h/2) AS z FROM a)"


def _angles(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("point_id", (F.col("x") / 700).alias("r"), (F.col("y") / F.lit(300.0) - 0.15).alias("p"), (F.col("x") / 300 - 0.8).alias("h"))


@query(f"WITH {ANGLES_SQL} SELECT point_id, round(w, 6) AS qw, round(x, 6) AS qx, round(y, 6) AS qy, round(z, 6) AS qz FROM q")
def rpy_to_quat(spark: SparkSession, d: str) -> DataFrame:
    """Through the matrix and back, which gives the half-angle form where w > 0."""
    a = _angles(spark, d)
    q = rot.matrix_to_quaternion(rot.body_to_ned(F.col("r"), F.col("p"), F.col("h")))
    return rounded(a.select("point_id", *(c.alias(n) for c, n in zip(q, ("qw", "qx", "qy", "qz"), strict=True))))


@query(f"WITH {ANGLES_SQL} SELECT point_id, round(r, 6) AS roll, round(p, 6) AS pitch, round(h, 6) AS yaw FROM q")
def quat_to_rpy(spark: SparkSession, d: str) -> DataFrame:
    a = _angles(spark, d)
    e = rot.quaternion_to_euler(rot.euler_to_quaternion(F.col("r"), F.col("p"), F.col("h")))
    return rounded(a.select("point_id", *(c.alias(n) for c, n in zip(e, ("roll", "pitch", "yaw"), strict=True))))


@query(f"WITH {ANGLES_SQL} SELECT point_id, round(0.5*w - 0.5*x - 0.5*y - 0.5*z, 6) AS qw, round(0.5*x + 0.5*w + 0.5*z - 0.5*y, 6) AS qx, round(0.5*y - 0.5*z + 0.5*w + 0.5*x, 6) AS qy, round(0.5*z + 0.5*y - 0.5*x + 0.5*w, 6) AS qz FROM q")
def quat_compose(spark: SparkSession, d: str) -> DataFrame:
    a = _angles(spark, d)
    q = rot.multiply([0.5, 0.5, 0.5, 0.5], rot.euler_to_quaternion(F.col("r"), F.col("p"), F.col("h")))
    return rounded(a.select("point_id", *(c.alias(n) for c, n in zip(q, ("qw", "qx", "qy", "qz"), strict=True))))


LAT0, LON0, ALT0 = math.radians(46.5), math.radians(6.6), 400.0
ECEF_SQL = POINTS_SQL + f""", g AS (SELECT point_id, {LAT0} + x / 1e7 AS lat, {LON0} + y / 1e7 AS lon, {ALT0} + x / 10 AS alt FROM pts
  UNION ALL SELECT -1, {LAT0}, {LON0}, {ALT0}),
n AS (SELECT *, 6378137.0 / sqrt(1 - 0.0066943799901413165 * sin(lat) * sin(lat)) AS n FROM g),
c AS (SELECT point_id, (n + alt) * cos(lat) * cos(lon) AS ex, (n + alt) * cos(lat) * sin(lon) AS ey, (n * (1 - 0.0066943799901413165) + alt) * sin(lat) AS ez FROM n)"""


def _geodetic(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("point_id", (LAT0 + F.col("x") / 1e7).alias("lat"), (LON0 + F.col("y") / 1e7).alias("lon"), (ALT0 + F.col("x") / 10).alias("alt"))


@query(f"""WITH {ECEF_SQL}, o AS (SELECT ex AS ox, ey AS oy, ez AS oz FROM c WHERE point_id = -1), e AS (SELECT point_id, ex - ox AS dx, ey - oy AS dy, ez - oz AS dz FROM c, o WHERE point_id >= 0)
SELECT point_id, round(-sin({LON0}) * dx + cos({LON0}) * dy, 4) AS east, round(-sin({LAT0}) * cos({LON0}) * dx - sin({LAT0}) * sin({LON0}) * dy + cos({LAT0}) * dz, 4) AS north, round(cos({LAT0}) * cos({LON0}) * dx + cos({LAT0}) * sin({LON0}) * dy + sin({LAT0}) * dz, 4) AS up FROM e""")
def enu(spark: SparkSession, d: str) -> DataFrame:
    g = _geodetic(spark, d)
    xyz = geodesy.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("alt"))
    origin = geodesy.geodetic_to_ecef(F.lit(LAT0), F.lit(LON0), F.lit(ALT0))
    out = geodesy.ecef_to_enu(xyz, origin, LAT0, LON0)
    return rounded(g.select("point_id", *(c.alias(n) for c, n in zip(out, ("east", "north", "up"), strict=True))), 4)


@query(f"WITH {ECEF_SQL} SELECT g.point_id, round(lat, 9) AS lat, round(lon, 9) AS lon, round(alt, 3) AS alt, round(ex, 3) AS ex, round(ey, 3) AS ey, round(ez, 3) AS ez FROM g JOIN c USING (point_id) WHERE g.point_id >= 0")
def ecef_round_trip(spark: SparkSession, d: str) -> DataFrame:
    g = _geodetic(spark, d)
    xyz = geodesy.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("alt"))
    c = g.select("point_id", *(x.alias(n) for x, n in zip(xyz, ("ex", "ey", "ez"), strict=True)))
    lat, lon, alt = geodesy.ecef_to_geodetic(F.col("ex"), F.col("ey"), F.col("ez"))
    return c.select("point_id", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"), F.round(alt, 3).alias("alt"), *(F.round(n, 3).alias(n) for n in ("ex", "ey", "ez")))


E2B = geodesy.BESSEL[1] * (2 - geodesy.BESSEL[1])
AB, FB = geodesy.BESSEL
EB, SB = math.sqrt(E2B), math.sin(geodesy.SWISS_LAT)
ALPHA = math.sqrt(1 + E2B / (1 - E2B) * math.cos(geodesy.SWISS_LAT) ** 4)
B0 = math.asin(SB / ALPHA)
KB = math.log(math.tan(math.pi / 4 + B0 / 2)) - ALPHA * math.log(math.tan(math.pi / 4 + geodesy.SWISS_LAT / 2)) + ALPHA * EB / 2 * math.log((1 + EB * SB) / (1 - EB * SB))
RB = AB * math.sqrt(1 - E2B) / (1 - E2B * SB * SB)
LATITUDE_SQL = f"atan2(z + {E2B / (1 - E2B) * AB * (1 - FB)} * power(sin(beta), 3), p - {E2B * AB} * power(cos(beta), 3))"


@query(f"""WITH {ECEF_SQL}, s AS (SELECT point_id, ex - 674.374 AS x, ey - 15.056 AS y, ez - 405.346 AS z FROM c WHERE point_id >= 0),
b0 AS (SELECT *, sqrt(x * x + y * y) AS p, atan2(z * {AB}, sqrt(x * x + y * y) * {AB * (1 - FB)}) AS beta FROM s),
l1 AS (SELECT * EXCLUDE (beta), atan2({1 - FB} * sin({LATITUDE_SQL}), cos({LATITUDE_SQL})) AS beta FROM b0),
l2 AS (SELECT point_id, {LATITUDE_SQL} AS lat, atan2(y, x) AS lon, p, z FROM l1),
q AS (SELECT *, 2 * (atan(exp({ALPHA} * ln(tan(pi() / 4 + lat / 2)) - {ALPHA * EB / 2} * ln((1 + {EB} * sin(lat)) / (1 - {EB} * sin(lat))) + {KB})) - pi() / 4) AS bb, {ALPHA} * (lon - {geodesy.SWISS_LON}) AS l FROM l2)
SELECT point_id, round(2600000 + {RB} * atan2(sin(l), {math.sin(B0)} * tan(bb) + {math.cos(B0)} * cos(l)), 4) AS east,
  round(1200000 + {RB / 2} * ln((1 + ({math.cos(B0)} * sin(bb) - {math.sin(B0)} * cos(bb) * cos(l))) / (1 - ({math.cos(B0)} * sin(bb) - {math.sin(B0)} * cos(bb) * cos(l)))), 4) AS north,
  round(p * cos(lat) + z * sin(lat) - {AB} * sqrt(1 - {E2B} * sin(lat) * sin(lat)), 4) AS height FROM q""")
def swiss_grid(spark: SparkSession, d: str) -> DataFrame:
    g = _geodetic(spark, d)
    xyz = geodesy.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("alt"))
    c = g.select("point_id", *(x.alias(n) for x, n in zip(xyz, ("ex", "ey", "ez"), strict=True)))
    return rounded(geodesy.with_swiss(c, ("ex", "ey", "ez"), ("east", "north", "height")).select("point_id", "east", "north", "height"), 4)


MOUNT = [[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, -1.0]]
LEVER = [0.1, -0.2, 0.3]


def _poses(spark: SparkSession, d: str) -> DataFrame:
    t = trajectory(spark, d)
    q = rot.euler_to_quaternion(F.col("x") / 700, F.col("y") / 300.0 - 0.15, F.col("x") / 300 - 0.8)
    return t.select("t", (F.col("x") * 10).alias("ex"), (F.col("y") * 7).alias("ey"), (F.col("x") + F.col("y")).alias("ez"), *(c.alias(n) for c, n in zip(q, trj.QUATERNION, strict=True)))


@query(f"""WITH {TRAJECTORY_SQL}, an AS (SELECT t, x * 10 AS ex, y * 7 AS ey, x + y AS ez, x / 700 / 2 AS r, (y / 300.0 - 0.15) / 2 AS p, (x / 300 - 0.8) / 2 AS h FROM trj),
ps AS (SELECT t, ex, ey, ez, cos(r)*cos(p)*cos(h)+sin(r)*sin(p)*sin(h) AS w, sin(r)*cos(p)*cos(h)-cos(r)*sin(p)*sin(h) AS a, cos(r)*sin(p)*cos(h)+sin(r)*cos(p)*sin(h) AS b, cos(r)*cos(p)*sin(h)-sin(r)*sin(p)*cos(h) AS c FROM an),
sg AS (SELECT *, lead(t) OVER o AS tn, lead(ex) OVER o AS exn, lead(ey) OVER o AS eyn, lead(ez) OVER o AS ezn, lead(w) OVER o AS wn, lead(a) OVER o AS an, lead(b) OVER o AS bn, lead(c) OVER o AS cn FROM ps WINDOW o AS (ORDER BY t)),
lv AS (SELECT point_id, t AS pt, x / 20 AS sx, y / 10.0 AS sy, x / 50 - 1 AS sz, x AS i FROM pts WHERE src = 'click' AND t BETWEEN (SELECT min(t) FROM trj) AND (SELECT max(t) FROM trj) - 1),
m AS (SELECT *, (pt - t) / CAST(tn - t AS DOUBLE) AS u, w * wn + a * an + b * bn + c * cn AS dot FROM lv ASOF JOIN sg ON lv.pt >= sg.t),
k AS (SELECT *, acos(least(abs(dot), 1)) AS th, CASE WHEN dot < 0 THEN -1 ELSE 1 END AS sg FROM m),
f AS (SELECT *, CASE WHEN least(abs(dot), 1) > 1 - 1e-12 THEN 1 - u ELSE sin((1 - u) * th) / sin(th) END AS fa, sg * CASE WHEN least(abs(dot), 1) > 1 - 1e-12 THEN u ELSE sin(u * th) / sin(th) END AS fb FROM k),
q0 AS (SELECT *, fa * w + fb * wn AS x0, fa * a + fb * an AS x1, fa * b + fb * bn AS x2, fa * c + fb * cn AS x3, sy + 0.1 AS b1, sx - 0.2 AS b2, -sz + 0.3 AS b3 FROM f),
q AS (SELECT *, x0 / sqrt(x0*x0+x1*x1+x2*x2+x3*x3) AS qw, x1 / sqrt(x0*x0+x1*x1+x2*x2+x3*x3) AS qx, x2 / sqrt(x0*x0+x1*x1+x2*x2+x3*x3) AS qy, x3 / sqrt(x0*x0+x1*x1+x2*x2+x3*x3) AS qz FROM q0)
SELECT point_id, round((qw*qw+qx*qx-qy*qy-qz*qz)*b1 + 2*(qx*qy-qw*qz)*b2 + 2*(qx*qz+qw*qy)*b3 + ex + (exn - ex) * u, 5) AS x, round(2*(qx*qy+qw*qz)*b1 + (qw*qw-qx*qx+qy*qy-qz*qz)*b2 + 2*(qy*qz-qw*qx)*b3 + ey + (eyn - ey) * u, 5) AS y, round(2*(qx*qz-qw*qy)*b1 + 2*(qy*qz+qw*qx)*b2 + (qw*qw-qx*qx-qy*qy+qz*qz)*b3 + ez + (ezn - ez) * u, 5) AS z,
  round(i * sqrt(greatest(sqrt(sx*sx + sy*sy + sz*sz), 3)), 5) AS intensity FROM q""")
def georef_points(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).where("src = 'click'").select("point_id", "t", (F.col("x") / 20).alias("sx"), (F.col("y") / F.lit(10.0)).alias("sy"), (F.col("x") / 50 - 1).alias("sz"), F.col("x").alias("intensity_raw"))
    t = _poses(spark, d)
    ends = t.agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    p = p.crossJoin(F.broadcast(ends)).where("t between _lo and _hi - 1").drop("_lo", "_hi")
    rows = clouds.georeference(p, t, rot.sensor_to_body(0.0, 0.0, 0.0, MOUNT), LEVER, HOUR, DAY, frame="ecef")
    return rounded(rows.select("point_id", "x", "y", "z", "intensity"), 5)


@query()
def slerp(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).where("src = 'click'").select("point_id", "t")
    return rounded(trj.interpolate(p, _poses(spark, d), [], HOUR, DAY, attitude=True).drop("t"))


@query(f"""WITH {POINTS_SQL}, v AS (SELECT src, point_id, x * sqrt(greatest(y / 10.0, 3)) AS i FROM pts), q AS (SELECT src, quantile_cont(i, 0.05) AS lo, quantile_cont(i, 0.95) AS hi FROM v GROUP BY src)
SELECT point_id, CAST(CASE WHEN hi > lo THEN floor(least(greatest((i - lo) / (hi - lo), 0), 1) * 65535) ELSE 0 END AS INTEGER) AS intensity_u16 FROM v JOIN q USING (src)""")
def intensity_norm(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumn("intensity", scalars.range_corrected(F.col("x"), F.col("y") / F.lit(10.0)))
    return clouds.normalize_intensity(p, keys=["src"]).select("point_id", "intensity_u16")


@query(f"WITH {CLOUD_SQL} SELECT point_id, round(round_even(x / 0.001, 0) * 0.001, 6) AS x, round(round_even(y / 0.001, 0) * 0.001, 6) AS y, round(round_even(z / 0.001, 0) * 0.001, 6) AS z FROM cloud")
def quantize(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clouds.quantize(cloud(spark, d)).select("point_id", "x", "y", "z"))


@query()
def frechet_mean(spark: SparkSession, d: str) -> DataFrame:
    a = _angles(spark, d)
    m = rot.body_to_ned(F.col("r") / 10, F.col("p"), F.col("h") / 10)
    names = [[f"m{i}{j}" for j in range(3)] for i in range(3)]
    rows = a.select(*(rot.col(m[i][j]).alias(names[i][j]) for i in range(3) for j in range(3)))
    mean, std = calibration.mean_rotation(rows, names)
    return spark.createDataFrame([(i, *map(float, mean[i]), float(std[i])) for i in range(3)], "axis int, m0 double, m1 double, m2 double, std double")


@query(f"WITH {POINTS_SQL} SELECT point_id FROM pts WHERE NOT (t BETWEEN {ZONES[0][0]} AND {ZONES[0][1]}) AND NOT (t BETWEEN {ZONES[1][0]} AND {ZONES[1][1]})")
def exclusion_zones(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).where(scalars.outside(F.col("t"), ZONES)).select("point_id")


@query(f"""WITH {POINTS_SQL}, s AS (SELECT point_id, src, sin(t / 3.6e9) * 0.1 AS r, t FROM pts), f AS (SELECT * FROM s WHERE src = 'click'), g AS (SELECT t, sin(r) AS sr, cos(r) AS cr, lead(t) OVER w AS tn, lead(sin(r)) OVER w AS srn, lead(cos(r)) OVER w AS crn FROM s WHERE src = 'view' WINDOW w AS (ORDER BY t))
SELECT point_id, round(atan2(sr + (srn - sr) * ((f.t - g.t) / CAST(tn - g.t AS DOUBLE)), cr + (crn - cr) * ((f.t - g.t) / CAST(tn - g.t AS DOUBLE))), 6) AS trj_roll FROM f ASOF JOIN g ON f.t >= g.t WHERE tn IS NOT NULL""")
def attitude_alignment(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumn("roll", F.sin(F.col("t") / 3.6e9) * 0.1).withColumns({"pitch": F.col("roll"), "yaw": F.col("roll")})
    second = trj.unique_times(p.where("src = 'view'").select("t", "roll", "pitch", "yaw", "point_id"), order="point_id").drop("point_id")
    rows = calibration.align_attitudes(p.where("src = 'click'").select("point_id", "t"), second, HOUR, DAY)
    return rounded(rows.select("point_id", "trj_roll"))


@query(f"""WITH {POINTS_SQL} SELECT scan, round((max(t) - min(t)) / 1e6, 3) AS span, count(*) AS n FROM pts GROUP BY scan""")
def relative_time(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("scan")
    p = points(spark, d).withColumn("rel", (F.col("t") - F.min("t").over(w)) / 1e6)
    return rounded(p.groupBy("scan").agg(F.max("rel").alias("span"), F.count("*").alias("n")), 3)


# --- comparisons, extraction, matching -------------------------------------------------------------------------


def _shifted_poses(spark: SparkSession, d: str) -> DataFrame:
    turn = [math.cos(0.0005), 0.0, 0.0, math.sin(0.0005)]
    p = _poses(spark, d).withColumns({"lat": F.lit(LAT0), "lon": F.lit(LON0)})
    q = rot.multiply([F.col(c) for c in trj.QUATERNION], turn)
    return p.select("t", "lat", "lon", (F.col("ex") + 0.01).alias("ex"), (F.col("ey") - 0.02).alias("ey"), "ez", *(c.alias(n) for c, n in zip(q, trj.QUATERNION, strict=True)))


@query(f"""WITH {TRAJECTORY_SQL}, e AS (SELECT t, -0.01 AS dx, 0.02 AS dy FROM trj)
SELECT count(*) AS n, round(sqrt(avg(power(-sin({LAT0}) * cos({LON0}) * dx - sin({LAT0}) * sin({LON0}) * dy, 2))), 6) AS rmse_north, round(sqrt(avg(power(-sin({LON0}) * dx + cos({LON0}) * dy, 2))), 6) AS rmse_east,
  round(sqrt(avg(power(-cos({LAT0}) * cos({LON0}) * dx - cos({LAT0}) * sin({LON0}) * dy, 2))), 6) AS rmse_down, round(degrees(0.001), 4) AS q50_yaw FROM e""")
def trajectory_compare(spark: SparkSession, d: str) -> DataFrame:
    """Errors of a trajectory against one that is moved and turned by known amounts."""
    a = _poses(spark, d).withColumns({"lat": F.lit(LAT0), "lon": F.lit(LON0)})
    e = trj.compare(a, _shifted_poses(spark, d))
    out = e.agg(F.count("*").alias("n"), *(metrics.rmse(f"d_{c}").alias(f"rmse_{c}") for c in ("north", "east", "down")), F.round(metrics.quantile("d_yaw", 0.5), 4).alias("q50_yaw"))
    return rounded(out.withColumn("q50_yaw", F.abs("q50_yaw")))


@query(f"WITH {ANGLES_SQL} SELECT round(max(abs(w * w + x * x + y * y + z * z - 1)), 9) AS deviation FROM q")
def orthogonality(spark: SparkSession, d: str) -> DataFrame:
    m = rot.body_to_ned(F.col("r"), F.col("p"), F.col("h"))
    names = [[f"m{i}{j}" for j in range(3)] for i in range(3)]
    rows = _angles(spark, d).select(*(rot.col(m[i][j]).alias(names[i][j]) for i in range(3) for j in range(3)))
    return rounded(calibration.orthogonality(rows, names), 9)


@query(f"WITH {POINTS_SQL} SELECT round(atan2(avg(sin(x / 70)), avg(cos(x / 70))), 6) AS roll, round(atan2(avg(sin(y / 30.0)), avg(cos(y / 30.0))), 6) AS pitch, round(atan2(avg(sin(x / 300)), avg(cos(x / 300))), 6) AS heading, count(*) AS n FROM pts WHERE t BETWEEN {START + 3 * DAY} AND {START + 9 * DAY}")
def mean_attitude(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select("t", (F.col("x") / 70).alias("roll"), (F.col("y") / F.lit(30.0)).alias("pitch"), (F.col("x") / 300).alias("heading"))
    return rounded(calibration.mean_attitude(p, START + 3 * DAY, START + 9 * DAY))


@query(f"WITH {FOOT_SQL} SELECT a.flight AS fi, b.flight AS fj, count(*) AS n FROM fp a JOIN fp b ON a.row = b.row AND a.col = b.col JOIN (SELECT flight AS f, lead(flight) OVER (ORDER BY flight) AS g FROM (SELECT DISTINCT flight FROM fp)) s ON a.flight = f AND b.flight = g GROUP BY 1, 2")
def successive_overlaps(spark: SparkSession, d: str) -> DataFrame:
    cells = footprint.overlap_cells(_footprint(spark, d), "successive")
    return cells.groupBy("fi", "fj").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS_SQL}, a AS (SELECT scan, count(*) AS n, avg(x) AS mx, avg(y) AS my, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS th FROM pts GROUP BY scan HAVING count(*) >= 2), e AS (SELECT scan, any_value(mx) AS mx, any_value(my) AS my, any_value(cos(th)) AS ax, any_value(sin(th)) AS ay, min((x - mx) * cos(th) + (y - my) * sin(th)) AS lo, max((x - mx) * cos(th) + (y - my) * sin(th)) AS hi FROM a JOIN pts USING (scan) GROUP BY scan) SELECT scan, CAST(i AS INTEGER) AS i, round(mx + (lo + (hi - lo) * i / 9) * ax, 4) AS x, round(my + (lo + (hi - lo) * i / 9) * ay, 4) AS y FROM e, range(0, 10) r(i)")
def centreline(spark: SparkSession, d: str) -> DataFrame:
    axes = footprint.principal_axis(points(spark, d).select("scan", "x", "y"), ["scan"])
    return rounded(footprint.centreline(axes, ["scan"], 10), 4)


@query()
def match_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal nearest points of two sources, per scan."""
    p = points(spark, d).select("scan", (F.col("t") / 1e6).alias("t"), "x", F.col("y").cast("double").alias("y"), F.lit(0.0).alias("z"), "src")
    return rounded(pairs.match_clouds(p.where("src = 'view'").drop("src"), p.where("src = 'click'").drop("src"), ["scan"], {"uncertainty_r": 25.0}))


@query()
def patch_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Patches of one zone and the flights whose zones they meet."""
    cells = _zones(spark, d)
    found = patches.zone_patches(cells, GRID, ["fi", "fj"], 30.0, 20.0, 15.0, search=5.0).where("fi = 'click'").select("patch_id", "cx", "cy", "corners")
    boxes = cells.groupBy("fi", "fj").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1"))
    x = lambda c: F.col(c) * GRID.res + GRID.x0
    y = lambda c: GRID.y0 - F.col(c) * GRID.res
    c1, r1 = (F.col("c1") + 1) * GRID.res + GRID.x0, GRID.y0 - (F.col("r1") + 1) * GRID.res
    ring = F.array(F.array(x("c0"), y("r0")), F.array(c1, y("r0")), F.array(c1, r1), F.array(x("c0"), r1), F.array(x("c0"), y("r0")))
    return patches.relevant_patches(found, boxes.select("fi", "fj", ring.alias("outline"))).select("flight", "patch_id")
