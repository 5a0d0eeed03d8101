"""Embedding near-duplicates by iterative quantisation.

A rotation of the principal axes is learned on a bounded sample (SAMPLE vectors, the first in order of a hash
of their id) by alternating between sign codes and the orthogonal map that fits them best, which balances the
bits.  Each code is cut into TABLES strings; a table per string is probed with the string itself and with
every string one bit away.  Partners found in any table within the code distance MAX_BITS are reranked by the
cosine of the original vectors in double precision, so no link is below the threshold; recall at the threshold
is about 0.97 by the binomial law of flipped bits, and higher for nearer pairs.

Vectors equal in label and components form one class, which is indexed once and counts with its number of
members.  Vectors that are null, zero, or hold null or non-finite components link with nothing, as do those
with a null label; vectors of different lengths don't link.  Rows with a null id are returned with a null
component, kept, and link as others do.  Codes and tables are joined in the JVM; skewed tables are left to
adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, release

THRESHOLD, SAMPLE, ROUNDS = 0.93, 4096, 30
BITS, TABLES, MAX_BITS = 64, 5, 20


def learn(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """The projection (dimensions x bits) whose signs are the code; without vectors, empty."""
    if not len(x):
        return np.zeros((0, bits))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    r = np.random.default_rng(seed)
    values, axes = np.linalg.eigh(np.cov(x.T).reshape(x.shape[1], x.shape[1]) if len(x) > 1 else np.eye(x.shape[1]))
    axes = axes[:, np.argsort(-values)]
    if axes.shape[1] >= bits:
        axes = axes[:, :bits]
    else:  # more bits than dimensions: further random directions
        more = r.normal(size=(axes.shape[0], bits - axes.shape[1]))
        axes = np.concatenate([axes, more / np.linalg.norm(more, axis=0)], axis=1)
    v = x @ axes
    rotation = np.linalg.qr(r.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        code = np.where(v @ rotation >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(code.T @ v)
        rotation = (u @ w).T
    return axes @ rotation


def fit(vectors: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Learn on a sample of usable vectors (id, v); of several lengths the commonest is taken."""
    rows = vectors.select(F.xxhash64("vec_id", "v").alias("o"), "v")
    last = rows.select("o").orderBy("o").limit(sample).agg(F.max("o")).first()[0]
    rows = rows.where(F.col("o") <= last).limit(sample).collect() if last is not None else []
    rows.sort()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["v"]), []).append(r["v"])
    most = max(by.values(), key=len, default=[])
    return learn(np.array(most, dtype=np.float64))


def coded(classes: DataFrame, projection: np.ndarray) -> DataFrame:
    """Adds code (64 bits) to rows with v; vectors of another length get code 0 and meet in one code."""
    from pyspark.sql import types as T

    names = classes.columns
    shared = classes.sparkSession.sparkContext.broadcast(projection)
    weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            column = batch.column("v")
            ends, values = column.offsets.to_numpy(), column.values.to_numpy()
            sizes, code = np.diff(ends), np.zeros(len(column), dtype=np.uint64)
            ok = sizes == p.shape[0]
            if ok.any() and p.shape[0]:
                x = np.stack([values[a : a + p.shape[0]] for a in ends[:-1][ok]])
                code[ok] = ((x @ p >= 0) * weights).sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.view(np.int64))], [*names, "code"])

    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, T.StructField("code", T.LongType())]))


def candidates(codes: DataFrame, tables: int = TABLES, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a < b) of rows (label, c, code) that meet in a table and are near in code."""
    cuts = np.linspace(0, BITS, tables + 1).astype(int)
    part = lambda t: F.shiftrightunsigned("code", int(cuts[t])).bitwiseAND(F.lit((1 << int(cuts[t + 1] - cuts[t])) - 1))
    entry = lambda t, *flips: F.struct(F.lit(t).alias("t"), part(t).bitwiseXOR(F.lit(flips[0] if flips else 0)).alias("s"))
    index = codes.select("label", F.col("c").alias("b"), F.col("code").alias("cb"), F.explode(F.array(*(entry(t) for t in range(tables)))).alias("e"))
    flips = [entry(t, f) for t in range(tables) for f in (0, *(1 << i for i in range(int(cuts[t + 1] - cuts[t]))))]
    probe = codes.select("label", F.col("c").alias("a"), F.col("code").alias("ca"), F.explode(F.array(*flips)).alias("e"))
    flat = lambda df, *cols: df.select("label", F.col("e.t").alias("t"), F.col("e.s").alias("s"), *cols)
    met = flat(probe, "a", "ca").join(flat(index, "b", "cb"), ["label", "t", "s"])
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) <= max_bits)
    return met.where(near).select("a", "b").distinct()


def rerank(pairs: DataFrame, classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs whose vectors' cosine reaches the threshold."""
    side = lambda s: classes.select(F.col("c").alias(s), F.col("v").alias(f"v{s}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [[c.values.to_numpy()[a:b] for a, b in zip(o, o[1:], strict=False)] for c in (batch.column("va"), batch.column("vb")) for o in (c.offsets.to_numpy(),)]
            keep = [len(x) == len(y) and float(x @ y) / (float(np.sqrt(x @ x)) * float(np.sqrt(y @ y))) >= threshold for x, y in zip(*both, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per vector."""
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & F.col(label_col).isNotNull() & F.coalesce(F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    fine = F.coalesce(fine, F.lit(False))
    named = F.when(fine, F.xxhash64(F.transform(v, lambda x: x + F.lit(0.0))))
    all_ = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.when(fine, v).alias("v"), named.alias("h"))
    classes = all_.where(F.col("h").isNotNull()).groupBy("label", "h", "v").agg(F.min("vec_id").alias("c"), F.count("*").alias("members"))
    classes = classes.withColumn("c0", F.col("c")).withColumn("c", F.xxhash64("label", "h", "v"))
    classes = materialize(classes, "vectors")
    model = fit(classes.select(F.col("c0").alias("vec_id"), "v"))
    codes = coded(classes.select("label", "c", "v"), model).drop("v")
    codes = materialize(codes, "codes")
    links = materialize(rerank(candidates(codes), classes, threshold), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partners = both.join(classes.select(F.col("c").alias("b"), "members"), "b").groupBy("a").agg(F.sum("members").alias("others"))
    parts = components(links)
    least = parts.join(classes.select(F.col("c").alias("node"), "c0"), "node").groupBy("component").agg(F.min("c0").alias("least"))
    parts = parts.join(least, "component").select(F.col("node").alias("c"), "least")
    info = classes.join(partners, F.col("c") == F.col("a"), "left").join(parts, "c", "left")
    info = materialize(info.select("c", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least", "c0").alias("least")), "info")
    release(codes, links)
    out = all_.select("vec_id", F.when(F.col("h").isNotNull(), F.xxhash64("label", "h", "v")).alias("c")).join(info, "c", "left")
    component = F.when(F.col("vec_id").isNull(), None).otherwise(F.coalesce("least", "vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
