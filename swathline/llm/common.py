"""Helpers shared by the corpus operators: tokens, shared storage, connected components."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The word and token classes of the operators' contracts.  The word class holds both
# cases here because A-Z is lowered word by word afterwards, which costs less than a whole-text pass.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOKEN = r"[^\x20\x09-\x0D]+"

CHUNK = 1 << 20  # edges that a task contracts at once
SALTS = 64  # parts of a node's neighbours


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.when(F.lower(c) == c, c).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column, pattern: str = WORD) -> Column:
    """All words of a text as an array; null counts as empty."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), lower_az)


def indices(count: Column) -> Column:
    """[0, count) as an array, empty for count <= 0."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.expr("array()").cast("array<int>"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; -1 where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what setCheckpointDir() was given.  Only a
    local session may have neither; it then gets a temporary folder, which on a cluster the executors would not see."""
    base, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not base:
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not context._jsc.sc().isLocal():
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='swathline-')}")
            held = context._jsc.sc().getCheckpointDir()
        base = held.get()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/swathline/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._swathline_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_swathline_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, in order, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) of a task as stars (u, v) around smallest nodes, CHUNK edges at a time."""
    held, size = [], 0

    def stars() -> pa.RecordBatch:
        nodes, root = forest(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))
        own = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(root[own])], ["u", "v"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            yield stars()
            held, size = [], 0
    if held:
        yield stars()


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (u, v, old) with u > v as rows (u, v, link, open): one edge of each u to the smallest of its v, and links
    from others of its v to that.  A node's neighbours are dealt by SALTS parts of v first, and links stay so dealt,
    so no task gathers all neighbours of a node."""
    salt = lambda v: F.pmod(F.xxhash64(v), F.lit(SALTS)).cast("int")
    part = edges.groupBy("u", salt("v").alias("g")).agg(F.collect_set("v").alias("vs"), F.max("old").alias("old"))
    row = lambda u, v, old, g: F.struct(u.alias("u"), v.alias("v"), old.cast("long").alias("old"), g.cast("int").alias("g"))
    low = F.array_min("vs")
    links = F.transform(F.filter("vs", lambda x: x > low), lambda x: row(x, low, F.lit(None), salt(low)))
    part = part.select(F.explode(F.concat(F.array(row(F.col("u"), low, F.col("old"), F.lit(-1))), links)).alias("x")).select("x.*")
    whole = part.groupBy("u", "g").agg(F.min("v").alias("v"), F.collect_set("v").alias("vs"), F.max("old").alias("old"))
    row = lambda u, link, is_open: F.struct(u.alias("u"), F.col("v"), link.alias("link"), is_open.alias("open"))
    own = row(F.col("u"), F.col("g") >= 0, (F.col("g") >= 0) | F.coalesce(F.col("v") != F.col("old"), F.lit(True)))
    links = F.transform(F.filter("vs", lambda x: x > F.col("v")), lambda x: row(x, F.lit(True), F.lit(True)))
    return whole.select(F.explode(F.concat(F.array(own), links)).alias("x")).select("x.*")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the smallest node.

    Every task first contracts its own edges to stars around smallest nodes.  A round then joins each edge's smaller end
    to that end's own smaller neighbour (a step to the root) and keeps of each node the edge to its smallest
    neighbour; the others become links between neighbours.  It ends when a round changes nothing and makes no link.
    Rounds are written, so the join is one between plain shuffles, which adaptive execution splits where one end is
    very frequent.  Nodes without an edge are not returned.
    """
    first = edges.where("a <> b").select("a", "b").mapInArrow(_contracted, "u long, v long")
    at = materialize(_stars(first.withColumn("old", F.lit(None).cast("long"))), "stars")
    while at.where("open").head(1):
        up = at.where("not link").select(F.col("u").alias("k"), F.col("v").alias("p"))
        moved = at.join(up, at["v"] == up["k"], "left").select("u", F.coalesce("p", "v").alias("v"), F.when(~F.col("link"), F.col("v")).alias("old"))
        nxt = materialize(_stars(moved), "stars")
        release(at)
        at = nxt
    own = at.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.unionByName(own.select(F.col("component").alias("node"), "component").distinct())
