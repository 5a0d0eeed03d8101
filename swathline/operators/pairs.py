"""Pairs of chunks, scans and flights to be matched."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from .ordered import numbered


def neighbours(chunks: DataFrame, k: int, scan: str = "scan", chunk: str = "chunk") -> DataFrame:
    """Each chunk of a scan with the next 1 to k in order: (scan, a, b, step)."""
    w = Window.partitionBy(scan).orderBy(chunk)
    steps = F.array(*(F.struct(F.lead(chunk, d).over(w).alias("b"), F.lit(d).alias("step")) for d in range(1, k + 1)))
    rows = chunks.select(scan, F.col(chunk).alias("a"), steps.alias("_n")) if k else chunks.select(scan, F.col(chunk).alias("a"), F.array().cast("array<struct<b:int,step:int>>").alias("_n"))
    return rows.select(scan, "a", F.explode("_n").alias("_n")).where("_n.b is not null").select(scan, "a", F.col("_n.b").alias("b"), F.col("_n.step").alias("step"))


def across_scans(chunks: DataFrame, scan: str = "scan", chunk: str = "chunk") -> DataFrame:
    """The last chunk of each scan with the first of the next scan that has any: (scan_a, a, scan_b, b)."""
    ends = chunks.groupBy(scan).agg(F.min(chunk).alias("_first"), F.max(chunk).alias("_last"))
    w = Window.orderBy(scan)  # one row per scan
    rows = ends.select(F.lag(scan).over(w).alias("scan_a"), F.lag("_last").over(w).alias("a"), F.col(scan).alias("scan_b"), F.col("_first").alias("b"))
    return rows.where("scan_a is not null")


def crossings(boxes: DataFrame, min_separation: int, margin: float, size: float, key: str = "chunk", block: float | None = None) -> DataFrame:
    """Pairs of boxes that come within the margin in both axes and are further apart than `min_separation` in order of
    t_start: (a, b, seq_a, seq_b).

    Boxes meet in grid cells of the given size.  They are numbered by blocks of t_start, or all at once without a block
    size."""
    seq = numbered(boxes, [], ["t_start", key], block, "seq", "_all").withColumn("seq", F.col("seq").cast("int"))
    cells = lambda lo, hi: F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))
    half = margin / 2
    seq = seq.select(F.col(key).alias("k"), "seq", *((F.col(f"{c}_min") - half).alias(f"{c}0") for c in "xy"), *((F.col(f"{c}_max") + half).alias(f"{c}1") for c in "xy"), *(f"{c}_{e}" for c in "xy" for e in ("min", "max")))
    put = seq.withColumn("cx", F.explode(cells(F.col("x0"), F.col("x1")))).withColumn("cy", F.explode(cells(F.col("y0"), F.col("y1"))))
    a, b = put.alias("a"), put.alias("b")
    met = a.join(b, (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.seq") + min_separation < F.col("b.seq")))
    # widened boxes only propose; the margin is tested as stated
    for c in "xy":
        met = met.where((F.col(f"a.{c}_min") - margin <= F.col(f"b.{c}_max")) & (F.col(f"b.{c}_min") - margin <= F.col(f"a.{c}_max")))
    return met.select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.col("a.seq").alias("seq_a"), F.col("b.seq").alias("seq_b")).distinct()


def reciprocal(files: DataFrame, name: str = "name") -> DataFrame:
    """Patch files whose counterpart exists: (a, b, file_ab, file_ba), a < b.  Of files with equal ids the last by name
    counts; self-pairs are left out."""
    a, b = scalars.pair_ids(F.col(name))
    rows = files.select(a.alias("a"), b.alias("b"), F.col(name).alias("file")).where("a is not null and b is not null")
    rows = rows.groupBy("a", "b").agg(F.max("file").alias("file"))
    back = rows.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("file").alias("file_ba"))
    return rows.withColumnRenamed("file", "file_ab").join(back, ["a", "b"]).where("a < b")


def separated(pairs: DataFrame, least: float, a: str = "mean_a", b: str = "mean_b") -> DataFrame:
    """Pairs whose mean times differ by at least so much."""
    return pairs.where(F.abs(F.col(a) - F.col(b)) >= least)


def flight_pairs(flights: DataFrame, mode: str = "all", key: str = "flight") -> DataFrame:
    """All pairs of flights in order, or only successive ones.  A table of flights is small by nature."""
    if mode == "successive":
        w = Window.orderBy(key)
        return flights.select(F.col(key).alias("fi"), F.lead(key).over(w).alias("fj")).where("fj is not null")
    return flights.select(F.col(key).alias("fi")).join(F.broadcast(flights.select(F.col(key).alias("fj"))), F.col("fi") < F.col("fj"))


PAIRS = 4_000_000  # distances that the matcher holds at once
MATCHES = "time_a double, x_a double, y_a double, z_a double, time_b double, x_b double, y_b double, z_b double, d_xyz double"


def _nearest(p: np.ndarray, q: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of q for each of p, and its distance: -1 and infinity where none lies within reach.  Points meet in cells
    as wide as the reach; without a reach all are compared.  PAIRS distances are held at once, or one point's."""
    at, best = np.full(len(p), -1), np.full(len(p), np.inf)
    if not np.isfinite(reach) or reach <= 0:
        step = max(1, PAIRS // len(q))
        for i in range(0, len(p), step):
            d = ((p[i : i + step, None, :] - q[None]) ** 2).sum(-1)
            at[i : i + step], best[i : i + step] = d.argmin(1), np.sqrt(d.min(1))
        return at, best
    low = np.minimum(p.min(0), q.min(0))
    cells = lambda x: np.floor((x - low) / reach).astype(np.int64) + 1
    cp, cq = cells(p), cells(q)
    span = np.maximum(cp.max(0), cq.max(0)) + 2
    key = lambda c: (c[:, 0] * span[1] + c[:, 1]) * span[2] + c[:, 2]
    order = np.argsort(key(cq), kind="stable")
    kq = key(cq)[order]
    for shift in np.ndindex(3, 3, 3):
        k = key(cp + np.array(shift) - 1)
        lo, n = np.searchsorted(kq, k), np.searchsorted(kq, k, side="right") - np.searchsorted(kq, k)
        cuts = np.searchsorted(np.cumsum(n), np.arange(PAIRS, n.sum() + PAIRS, PAIRS), side="right")
        for a, b in zip([0, *cuts], [*cuts, len(p)], strict=True):
            rows = np.repeat(np.arange(a, b), n[a:b])
            if not len(rows):
                continue
            first = np.cumsum(n[a:b]) - n[a:b]
            j = order[np.repeat(lo[a:b] - first, n[a:b]) + np.arange(len(rows))]
            d = np.sqrt(((p[rows] - q[j]) ** 2).sum(-1))
            rank = np.lexsort((j, d, rows))
            rank = rank[np.unique(rows[rank], return_index=True)[1]]
            r, dr, jr = rows[rank], d[rank], j[rank]
            better = (dr <= reach) & ((dr < best[r]) | (dr == best[r]) & (jr < at[r]))
            at[r[better]], best[r[better]] = jr[better], dr[better]
    return at, best


def nearest_matcher(a: pd.DataFrame, b: pd.DataFrame, cfg: dict) -> pd.DataFrame:
    """A stand-in matcher: points that are each other's nearest, within uncertainty_r or its range."""
    low, high = cfg.get("uncertainty_r_min", 0.0), cfg.get("uncertainty_r_max", cfg.get("uncertainty_r", np.inf))
    if a.empty or b.empty:
        return pd.DataFrame({f.split()[0]: pd.Series(dtype=float) for f in MATCHES.split(", ")})
    p, q = a[["x", "y", "z"]].to_numpy(float), b[["x", "y", "z"]].to_numpy(float)
    (ab, d), (ba, _) = _nearest(p, q, high), _nearest(q, p, high)
    i = np.flatnonzero((ab >= 0) & (ba[ab] == np.arange(len(p))) & (d >= low) & (d <= high))
    cols = {f"{n}_{s}": (a if s == "a" else b)[c].to_numpy(float)[i if s == "a" else ab[i]] for s in "ab" for n, c in (("time", "t"), ("x", "x"), ("y", "y"), ("z", "z"))}
    return pd.DataFrame(cols | {"d_xyz": d[i]})[[f.split()[0] for f in MATCHES.split(", ")]]


def match_clouds(first: DataFrame, second: DataFrame, keys: list[str], cfg: dict, matcher: Callable = nearest_matcher) -> DataFrame:
    """Run a matcher on each pair of chunks: matcher(points_a, points_b, cfg) returns MATCHES.  A chunk pair is the unit
    of work and is bounded by the chunk length."""
    schema = ", ".join(f"`{k}` {first.schema[k].dataType.simpleString()}" for k in keys) + ", " + MATCHES

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = matcher(a, b, cfg)
        return pd.concat([pd.DataFrame({k: [v] * len(out) for k, v in zip(keys, key, strict=True)}), out.reset_index(drop=True)], axis=1)

    second = second.select(*(F.col(c).alias(c) for c in second.columns))  # both may come from one frame
    return first.groupBy(*keys).cogroup(second.groupBy(*keys)).applyInPandas(run, schema)
