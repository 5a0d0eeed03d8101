"""Best partners: against brute force, and without a row for every pair."""

import random

import numpy as np
from pyspark.sql import functions as F

from swathline.operators import clouds, matching
from swathline.operators.partners import nearest, partners, timed


def most_rows(df):
    """Rows that the plan's largest node gave when it ran."""
    df.collect()

    def walk(p):
        kind, size = p.getClass().getSimpleName(), p.metrics().get("numOutputRows")
        below = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        return max([size.get().value() if size.isDefined() else 0, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


def crowd(spark, n=1500):
    """As many marks and points within one second, at few places."""
    marks = spark.range(n).select("id", (F.col("id") * 7 % n).alias("q"), (F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    cloud = spark.range(n).select(F.col("id").alias("p"), (F.col("id") * 11 % n).alias("t"), (F.col("id") % 4).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    return marks, cloud


def scattered(spark, n=250):
    """Marks (id, q, x, y) and points (p, t, x, y), with ties, copies, nulls and NaN."""
    r = random.Random(8)
    nan = float("nan")
    time = lambda: r.choice([float(r.randint(-60, 60)), r.uniform(-50, 50)])
    marks = [(i, time(), float(r.randint(0, 9)), r.randint(0, 6)) for i in range(n)] + [(n, None, 1.0, 1), (n + 1, nan, 1.0, 1), (n + 2, 1.0, nan, 1), (n + 3, 1.0, 1.0, None), (n + 4, 9e5, 1.0, 1)]
    cloud = [(i, time(), float(r.randint(0, 9)), r.randint(0, 6)) for i in range(2 * n)] + [(2 * n + i, 3.0, 2.0, 2) for i in range(20)] + [(-1, None, 1.0, 1), (-2, nan, 1.0, 1), (-3, 1.0, nan, 1), (-4, 1.0, 1.0, None)]
    r.shuffle(cloud)
    return marks, cloud, spark.createDataFrame(marks, "id int, q double, x double, y int"), spark.createDataFrame(cloud, "p int, t double, x double, y int")


def test_nearest_in_time_brute_force(spark):
    marks, cloud, m, c = scattered(spark)
    got = {r["id"]: (r["p"], r["dt"]) for r in matching.nearest_in_time(m, c.select("p", "t"), 2.5, 1.0, "id", "q", ["p"]).collect()}
    best = lambda q: min(((abs(t - q), p) for p, t, *_ in cloud if q is not None and t is not None and q - 2.5 < t < q + 2.5), default=(None, None))
    assert got == {i: best(q)[::-1] for i, q, *_ in marks}


def test_nearest_in_time_lists_no_pairs(spark):
    m, c = crowd(spark)
    assert most_rows(matching.nearest_in_time(m.select("id", "q"), c.select("p", "t"), 5000, 5000, "id", "q", ["p"])) < 20_000


def test_large_buckets_are_cut(spark):
    marks, cloud, m, c = scattered(spark)
    spans = m.select("id", "q").withColumns({"_lo": F.col("q") - 2.5, "_hi": F.col("q") + 2.5})
    sides = timed(spans, c.select("p", "t"), "q", "t", 2.5, 1.0)
    rows = partners(*sides, nearest([("q", "t")], "t", 2.5), ["p"], rows=40).collect()
    best = {}
    for r in rows:
        best[r["id"]] = min(best.get(r["id"], (np.inf, 0)), (abs(r["t"] - r["q"]), r["p"]))
    whole = partners(*sides, nearest([("q", "t")], "t", 2.5), ["p"]).collect()
    assert len(rows) > len(whole) == len(best)
    assert best == {r["id"]: (abs(r["t"] - r["q"]), r["p"]) for r in whole}


def near(marks, cloud, tolerance, limit):
    """Each mark's least (distance, point) up to a limit within the tolerance, by brute force."""
    out = {}
    for i, q, x, y in marks:
        if None not in (q, y):
            met = ((float(np.sqrt((px - x) ** 2 + (py - y) ** 2)), p) for p, t, px, py in cloud if None not in (t, py) and q - tolerance < t < q + tolerance)
            out[i] = min((m for m in met if m[0] <= limit), default=(None, None))
    return {i: out.get(i, (None, None)) for i, *_ in marks}


def test_reproject_brute_force(spark):
    marks, cloud, m, c = scattered(spark)
    q = m.select("id", F.col("q").alias("q_t"), F.col("x").alias("q_x"), F.col("y").alias("q_y"))
    for tolerance, limit in ((2.5, 2.0), (30.0, 1e9), (0.4, 3.0)):
        got = {r["id"]: (r["dist"], r["p"]) for r in matching.reproject(q, c, tolerance, limit, 1.0, "id", ["x", "y"], "p").collect()}
        assert got == {i: b for i, b in near(marks, cloud, tolerance, np.nextafter(limit, 0)).items() if b[1] is not None}


def test_reproject_lists_no_pairs(spark):
    m, c = crowd(spark)
    q = m.select("id", F.col("q").alias("q_t"), F.col("x").alias("q_x"), F.col("y").alias("q_y"))
    assert most_rows(matching.reproject(q, c, 5000, 40.0, 5000, "id", ["x", "y"], "p")) < 20_000


def test_nearest_reference_brute_force(spark):
    marks, cloud, m, c = scattered(spark)
    for tolerance, limit in ((2.5, 2.0), (30.0, 1e9), (0.4, 3.0)):
        rows = matching.nearest_reference(m, c, tolerance, limit, 1.0, "id", "q", ["x", "y"], ["p"]).collect()
        want, times = near(marks, cloud, tolerance, limit), {p: t for p, t, *_ in cloud}
        assert {r["id"]: (r["dist"], r["ref_t"]) for r in rows} == {i: (d, times.get(p)) for i, (d, p) in want.items()}


def test_nearest_reference_lists_no_pairs(spark):
    m, c = crowd(spark)
    assert most_rows(matching.nearest_reference(m, c, 5000, 30.0, 5000, "id", "q", ["x", "y"], ["p"])) < 20_000


def test_best_overlap_brute_force(spark):
    r = random.Random(4)
    mk = lambda n: [(i, float(a), float(a + r.choice([0, 3, 3, 20, 90]))) for i, a in ((i, r.randint(0, 100)) for i in range(n))]
    targets, refs = mk(120), [(*x, p) for x, p in zip(mk(160), r.sample(range(160), 160), strict=True)]
    t = spark.createDataFrame([*targets, (500, None, 5.0)], "target int, t_start double, t_end double")
    f = spark.createDataFrame([*refs, (500, 0.0, None, -1)], "ref int, r_start double, r_end double, ref_pos int")
    shared = lambda x, y: min(x[2], y[2]) - max(x[1], y[1])
    want = {}
    for x in targets:
        best = min(((-shared(x, y), y[3], y[0]) for y in refs if shared(x, y) > 0), default=None)
        if best:
            want[x[0]] = (best[2], -best[0])
    for width in (7.0, 1000.0):
        assert {r["target"]: (r["ref"], r["overlap"]) for r in clouds.best_overlap(t, f, width).collect()} == want


def test_best_overlap_lists_no_pairs(spark):
    t = spark.range(1500).select(F.col("id").alias("target"), F.col("id").alias("t_start"), (F.col("id") + 5000).alias("t_end"))
    r = spark.range(1500).select(F.col("id").alias("ref"), (F.col("id") * 7 % 1500).alias("r_start"), (F.col("id") + 6000).alias("r_end"), F.col("id").alias("ref_pos"))
    assert most_rows(clouds.best_overlap(t, r, 10000.0)) < 20_000
