"""The best partner of each row, without listing the pairs.

Rows that may be partners share a bucket.  In each bucket the candidates stand in a balanced k-d tree, whose nodes
hold the bounds of their rows; a search leaves out the nodes that can't hold anything better than what is surely
reached elsewhere.  Nothing is written for a pair, so that the disk used follows the rows.  All bounds are made by the
operations that the costs are made by, which rounding leaves in order: results are exact, ties included.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS = 500_000  # of one side of a bucket; larger ones are cut into parts
PAIRS = 500_000  # of rows and nodes looked at together


class Tree:
    """Rows in order of preference, halved again and again.  `split` gives the columns' weights from their extents,
    and a node is halved along the greatest."""

    def __init__(self, columns: list[np.ndarray], split: Callable):
        n = self.rows = len(columns[0])
        self.levels, order = [], np.arange(n)
        for level in range(max(n.bit_length(), 1)):
            ends = (n * np.arange((1 << level) + 1)) >> level
            lo = [np.minimum.reduceat(c[order], ends[:-1]) for c in columns]
            hi = [np.maximum.reduceat(c[order], ends[:-1]) for c in columns]
            self.levels.append((ends, lo, hi, np.minimum.reduceat(order, ends[:-1])))
            node = np.repeat(np.arange(1 << level), np.diff(ends))
            axis = np.argmax(split([(b - a).astype(float) for a, b in zip(lo, hi, strict=True)]), 0)[node]
            order = order[np.lexsort((np.choose(axis, [(c - c.min()).astype(float)[order] for c in columns]), node))]
        self.levels.append((None, [c[order] for c in columns], [c[order] for c in columns], order))

    def best(self, queries: int, judge: Callable, limit: float) -> np.ndarray:
        """Each query's row of least cost up to `limit`, the first on ties; the number of rows if there is none.

        judge(query, lo, hi) gives for queries and bounds of nodes the least cost that is possible (infinite if no row
        is allowed), one that some row surely has (else infinite), and whether all rows have it."""
        best, row = np.full(queries, float(limit)), np.full(queries, self.rows)
        open_ = [(0, q := np.arange(queries), np.zeros_like(q))]
        while open_:
            level, q, node = open_.pop()
            if len(q) > PAIRS:
                half = len(q) // 2
                open_ += [(level, q[half:], node[half:]), (level, q[:half], node[:half])]
                continue
            ends, lo, hi, first = self.levels[level]
            low, sure, same = judge(q, [c[node] for c in lo], [c[node] for c in hi])
            before = best.copy()
            np.minimum.at(best, q, sure)
            row[best < before] = self.rows
            least = same & (sure == best[q])
            np.minimum.at(row, q[least], first[node[least]])
            go = ~same & (low < np.inf) & ((low < best[q]) | (low == best[q]) & (first[node] < row[q]))
            q, node = q[go], node[go]
            if ends is None or not len(q):
                continue
            last = level == len(self.levels) - 2  # below it are the rows
            start, count = (ends[node], ends[node + 1] - ends[node]) if last else (2 * node, np.full(len(q), 2))
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            open_.append((level + 1, np.repeat(q, count), np.repeat(start, count) + place))
        return row


def _numbers(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    """Whole numbers stay, others become doubles; nulls are NaN."""
    cols = [table[n] for n in names]
    return [c.to_numpy().astype(np.int64) if pa.types.is_integer(c.type) and not c.null_count else c.cast("double", safe=False).to_numpy() for c in cols]


def _known(table: pa.Table, names: list[str]) -> pa.Table:
    return table.filter(pa.array(np.all([np.isfinite(c) for c in _numbers(table, names)], 0)))


def nearest(axes: list[tuple[str, str]], t: str, tolerance: float, limit: float = np.inf) -> Callable:
    """A search for the nearest row along axes (own, other), at times t between _lo and _hi."""

    def search(own: pa.Table, other: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray]:
        mine, theirs = zip(*axes, strict=True)
        own, other = _known(own, [*mine, "_lo", "_hi"]), _known(other, [*theirs, t])
        at, (start, end) = _numbers(own, mine), _numbers(own, ["_lo", "_hi"])

        def split(extents: list[np.ndarray]) -> list[np.ndarray]:
            *place, time = extents
            return [*place, np.where(time > tolerance / 2, np.inf, time * 1e-30)]

        def judge(q, lo, hi):
            gaps = [np.maximum(np.maximum(a - m[q], m[q] - b), 0) for m, a, b in zip(at, lo, hi, strict=False)]
            ends = [np.maximum(np.abs(a - m[q]), np.abs(b - m[q])) for m, a, b in zip(at, lo, hi, strict=False)]
            low, sure = (x[0].astype(float) if len(x) == 1 else np.sqrt(sum(g * g for g in (g.astype(float) for g in x))) for x in (gaps, ends))
            whole = (lo[-1] > start[q]) & (hi[-1] < end[q])
            low[(hi[-1] <= start[q]) | (lo[-1] >= end[q])] = np.inf
            sure[~whole] = np.inf
            return low, sure, whole & (low == sure)

        if not len(own) or not len(other):
            return own, other, np.full(len(own), len(other))
        return own, other, Tree(_numbers(other, [*theirs, t]), split).best(len(own), judge, limit)

    return search


def longest(own_range: tuple[str, str], other_range: tuple[str, str]) -> Callable:
    """A search for the interval that shares most, more than a point."""

    def search(own: pa.Table, other: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray]:
        own, other = _known(own, own_range), _known(other, other_range)
        (a, b), (c, e) = _numbers(own, own_range), _numbers(other, other_range)

        def judge(q, lo, hi):
            start, end, (c0, e0, _), (c1, e1, length) = a[q], b[q], lo, hi
            shared = lambda x, y: np.minimum(end, y) - np.maximum(start, x)
            most, least = np.minimum(shared(c0, e1), length), shared(c1, e0)
            some = np.maximum(least, np.maximum(np.where(c1 <= start, shared(c1, e1), least), np.where(e0 >= end, shared(c0, e0), least)))
            some = np.maximum(some, np.where((c0 >= start) & (e1 <= end), length, least)).astype(float)
            return np.where(most > 0, -most.astype(float), np.inf), np.where(some > 0, -some, np.inf), (most > 0) & (most == least)

        if not len(own) or not len(other):
            return own, other, np.full(len(own), len(other))
        return own, other, Tree([c, e, e - c], lambda x: [x[0], x[1], np.full_like(x[2], -1.0)]).best(len(own), judge, np.inf)

    return search


def partners(own: DataFrame, other: DataFrame, search: Callable, order: list[str], rows: int = ROWS) -> DataFrame:
    """Rows of `own` with the row of `other` that the search gives in their `_bucket`, which must be among the best by
    `order`; rows without one are left out.  Of a row that is in several buckets, or in a bucket of more than `rows`
    rows of the other side, several best come, one for each bucket and part."""
    sides = own.select("_bucket", F.lit(1).alias("_o"), F.lit(0).alias("_p")).unionByName(other.select("_bucket", F.lit(0).alias("_o"), F.lit(1).alias("_p")))
    parts = sides.groupBy("_bucket").agg(F.ceil(F.sum("_o") / rows).alias("_no"), F.ceil(F.sum("_p") / rows).alias("_np"))
    hot = [tuple(r) for r in parts.where("(_no > 1 OR _np > 1) AND _bucket IS NOT NULL").collect()]
    keys, kept = ["_bucket"], [own.columns, other.columns]
    if hot:
        parts = F.broadcast(own.sparkSession.createDataFrame(hot, "_bucket long, _no long, _np long"))

        def cut(df: DataFrame, by: str, mine: str, theirs: str, key: str, key2: str) -> DataFrame:
            n = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1))
            df = df.join(parts, "_bucket", "left").withColumn(key, F.pmod(by, n(mine)))
            return df.withColumn(key2, F.explode(F.sequence(F.lit(0).cast("long"), n(theirs) - 1))).drop("_no", "_np")

        each = lambda df: F.xxhash64(*(c for c in df.columns if c != "_bucket"))
        own, other, keys = cut(own, each(own), "_no", "_np", "_i", "_j"), cut(other, each(other), "_np", "_no", "_j", "_i"), ["_bucket", "_i", "_j"]
    kept = [[c for c in names if c != "_bucket"] for names in kept]
    schema = StructType([own.schema[c] for c in kept[0]] + [other.schema[c] for c in kept[1]])
    names = [f.name for f in schema]

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.take(pc.sort_indices(theirs, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
        mine, theirs, row = search(mine.select(kept[0]), theirs.select(kept[1]))
        hit = np.flatnonzero(row < len(theirs))
        mine, theirs = mine.take(pa.array(hit)), theirs.take(pa.array(row[hit]))
        return pa.table([*mine.columns, *theirs.columns], names=names)

    other = other.select(*(F.col(c).alias(c) for c in other.columns))  # both may come from one frame
    return own.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInArrow(run, schema)


def timed(marks: DataFrame, cloud: DataFrame, at: str, t: str, tolerance: float, width: float) -> tuple[DataFrame, DataFrame]:
    """Marks in the bucket of their time, and the cloud in all buckets whose marks are within the tolerance."""
    wide, pad = float(max(width, 8 * tolerance)), F.abs(F.col(t)) * 1e-15 + tolerance * 1.001
    bucket = lambda c: F.floor(c / wide).cast("long")
    finite = lambda c: F.abs(F.col(c)) < float("inf")  # noqa: E731  not null, not NaN
    near = F.explode(F.sequence(bucket(F.col(t) - pad), bucket(F.col(t) + pad)))
    return marks.where(finite(at)).withColumn("_bucket", bucket(F.col(at))), cloud.where(finite(t)).withColumn("_bucket", near)
