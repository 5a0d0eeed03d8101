"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every `window - k + 1` consecutive k-gram hashes the smallest (leftmost on ties) is kept, so any
shared span of `window` words has a fingerprint in common on both sides.  Fingerprints are joined, each
hit is extended to the whole window and compared word by word, and hit windows are laid over the text.

An item of fewer than `window` words, but not none, is one window; its fingerprint is the hash of all its words, and
texts are probed with the hashes of exactly that many words at every place.

There is one plan for benchmarks of every size.  A text's fingerprints, its places and one entry that stands for the text
itself are joined, as a few numbers each, to the distinct fingerprints of the benchmark, which are written first; what is
found is written too, and the texts that were hit are read again to compare words.  The joins carry no hint: the optimiser
broadcasts a side whose written size is below its limit, else sorts and merges.  The text's own entry has a hash of its
own as key, so such entries meet in no one place.

Nulls and empty texts have no words.  Every row gives one result row: rows equal in id and text are compared once and
counted.  Null ids are kept.
Items equal in id and text count once; null item ids are left out of the list and not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import indices, materialize, words

WINDOW, K = 10, 5
POSITION_BITS = 28  # of a fingerprint: the hash above, the position below


def _gram(h: Column, i: Column, k: int) -> Column:
    """The hash of k words from place i, from the hashes of words."""
    return F.xxhash64(*(h[i + j] for j in range(k)))


def _packed(h: Column, k: int) -> Column:
    """The k-gram hashes of a text with their positions in the low bits: the order is by hash, then position."""
    place = lambda i: F.shiftleft(F.shiftright(_gram(h, i, k), POSITION_BITS), POSITION_BITS).bitwiseOR(i.cast("long"))
    return F.transform(indices(F.size(h) - (k - 1)), place)


def _position(p: Column) -> Column:
    return p.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")


def _hash(p: Column) -> Column:
    return F.shiftright(p, POSITION_BITS)


def _hashed(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def fingerprints(texts: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Adds _fps to rows with an array _h of word hashes: the winnowed fingerprints."""
    many = window - k + 1
    rows = texts.withColumn("_grams", _packed(F.col("_h"), k))
    g = F.col("_grams")
    least = lambda j: F.least(*(g[j + i] for i in range(many))) if many > 1 else g[j]
    return rows.withColumn("_fps", F.array_distinct(F.transform(indices(F.size(g) - (many - 1)), least))).drop("_grams")


def item_windows(items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(len, fp, offset, win, items): each distinct window of the benchmark with the ids that hold it."""
    w = F.col("_w")
    rows = items.select(F.col("item_id").cast("string").alias("_item"), words(F.col("text")).alias("_w")).where(F.size("_w") > 0).withColumn("_h", _hashed(w))
    many = window - k + 1
    long = rows.where(F.size("_w") >= window).withColumn("_grams", _packed(F.col("_h"), k))
    long = long.select("_item", "_w", "_grams", F.explode(indices(F.size("_grams") - (many - 1))).alias("_s"))
    long = long.withColumn("_min", F.array_min(F.slice("_grams", F.col("_s") + 1, many)))
    long = long.select("_item", F.lit(window).alias("len"), _hash(F.col("_min")).alias("fp"), (_position(F.col("_min")) - F.col("_s")).alias("offset"), F.slice("_w", F.col("_s") + 1, window).alias("win"))
    short = rows.where(F.size("_w") < window).select("_item", F.size("_w").alias("len"), F.coalesce(*(F.when(F.size("_w") == m, _gram(F.col("_h"), F.lit(0), m)) for m in range(1, window))).alias("fp"), F.lit(0).alias("offset"), w.alias("win"))
    return long.unionByName(short).groupBy("len", "fp", "offset", "win").agg(F.collect_set("_item").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per row of docs: n_words, n_hit, n_items, items (sorted ids as strings), contaminated."""
    wins = materialize(item_windows(benchmark, window, k), "windows")
    known = materialize(wins.select("len", "fp").distinct(), "window-hashes")
    short = sorted(r["len"] for r in known.where(F.col("len") < window).select("len").distinct().collect())  # fewer than `window` rows

    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))
    rows = texts.withColumn("_w", words(F.col("_text"))).withColumn("_h", _hashed(F.col("_w")))
    probe = lambda n, h, p: F.struct(F.lit(n).alias("len"), h.alias("fp"), p.cast("int").alias("p"))
    h = F.col("_h")
    own = F.array(probe(0, F.xxhash64("_id", "_key"), F.lit(-1)))
    long = F.transform("_fps", lambda x: probe(window, _hash(x), _position(x)))
    places = [F.transform(indices(F.size(h) - (m - 1)), lambda i: probe(m, _gram(h, i, m), i)) for m in short]  # noqa: B023
    probes = fingerprints(rows, window, k).select("_id", "_key", F.size("_w").cast("long").alias("n_words"), F.explode(F.concat(own, long, *places)).alias("x")).select("_id", "_key", "n_words", "x.*")
    met = probes.join(known.withColumn("_known", F.lit(True)), ["len", "fp"], "left").where("_known or len = 0")
    found = materialize(met.groupBy("_id", "_key", "n_words").agg(F.collect_set(F.when(F.col("len") > 0, F.struct("len", "fp", "p"))).alias("at"), F.count_if(F.col("len") == 0).alias("copies")), "hits")

    # the words around the hits, to compare
    hit = found.where(F.size("at") > 0).select(F.col("_id").alias("i"), F.col("_key").alias("y"), "at")
    again = texts.join(hit, texts["_id"].eqNullSafe(hit["i"]) & (texts["_key"] == hit["y"])).select("_id", "_key", words(F.col("_text")).alias("_w"), "at")
    reach = lambda x: F.when(x["len"] == window, window - k).otherwise(0)
    base = lambda x: F.greatest(x["p"] - reach(x), F.lit(0))
    near = F.transform("at", lambda x: F.struct(x["len"].alias("len"), x["fp"].alias("fp"), x["p"].alias("p"), base(x).alias("base"), F.slice("_w", base(x) + 1, x["len"] + reach(x)).alias("near")))
    around = again.select("_id", "_key", F.explode(near).alias("x")).select("_id", "_key", "x.*")
    start = F.col("p") - F.col("offset")
    same = (start >= F.col("base")) & (F.slice("near", F.greatest(start - F.col("base"), F.lit(0)) + 1, F.col("len")) == F.col("win"))
    hits = around.join(wins, ["len", "fp"]).where(same).select("_id", "_key", F.lit(None).cast("long").alias("n_words"), F.struct(start.alias("s"), F.col("len").alias("n")).alias("_at"), "items", F.lit(None).cast("long").alias("copies"))
    every = found.select("_id", "_key", "n_words", F.lit(None).cast(hits.schema["_at"].dataType).alias("_at"), F.lit(None).cast("array<string>").alias("items"), "copies")
    per = every.unionByName(hits).groupBy("_id", "_key").agg(
        F.max("n_words").alias("n_words"), F.collect_set("_at").alias("_at"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.max("copies").cast("int").alias("copies")
    ).withColumn("_copy", F.explode(F.array_repeat(F.lit(True), F.col("copies"))))
    covered = F.array_distinct(F.flatten(F.transform("_at", lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1))))
    per = per.select(F.col("_id").alias(id_col), "n_words", F.size(covered).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sort_array("items").alias("items"))
    return per.withColumn("contaminated", F.col("n_hit") > 0)
