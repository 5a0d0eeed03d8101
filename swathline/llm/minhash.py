"""Near-duplicates by bottom-k sketches of one hash function.

A document's set is its distinct five-word shingles, hashed; its sketch is the K least hashes.  Documents
with equal sets form one class, so copies are compared once.  Inverted lists of the retained values
propose pairs of classes: all pairs of a list of up to SHORT classes; in longer lists every class is paired
with representatives of the list, one chosen alike for all lists and others anew for each list, so a
class that shares many values meets many different partners.  Pairs are then estimated from the bottom-k of
the union of their sketches and dropped when the estimate is more than SIGMAS standard deviations below the
threshold.  Pairs that share long lists only and don't meet through representatives are found by prefix
filtering: near classes share so many values that each has one of them among its rarest, so a class stays in the long
lists of its rarest values only, and what no proposal has joined yet is compared there block by block on sketches.
What remains is verified on the full sets.  A pair within one component needs no
verification: first each class's likeliest partner is verified, then all pairs across the components so
far.

Large groups of copies can hold links that the representatives don't meet.  Documents joined by proposed pairs form
a family; where a family has several components, every document outside the largest is compared with all of the
family on the full sets, block by block, and only links that join components leave a block.

Links lost: a pair is missed only if its estimate is off by SIGMAS standard deviations.  Any other near pair is proposed
or in one family.

Documents without words link with nothing.  Rows with a null id are returned with a null component and
kept.  Each row of an id that repeats is in the component of its own set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKEN, components, materialize, release, words

WIDTH, K, SHORT, SIGMAS = 5, 32, 6, 5.0
NUMERATOR, DENOMINATOR = 75, 100
BLOCK, COLUMNS = 256, 4096  # documents of a block and columns of its matrices
_FILL = np.iinfo(np.int64).max
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(tokens: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text's token hashes; with fewer tokens, of the whole text."""
    t = tokens.view(np.uint64)
    if not len(t):
        return t.view(np.int64)
    n = min(width, len(t))
    h = np.full(len(t) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = _mix(h + t[k : k + len(h)])
    return np.unique(h.view(np.int64))


def _tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    hashed = F.transform(words(F.col(text_col), TOKEN), lambda w: F.xxhash64(w))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), hashed.alias("_t"))


def _rows(column: pa.ListArray) -> Iterator[np.ndarray]:
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    for a, b in zip(ends, ends[1:], strict=False):
        yield values[a:b]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(x) for x in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(doc_id, n, h1, h2, sketch): set size, 128 bits that name the set, and its k least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, low = [], [], []
            for tokens in _rows(batch.column("_t")):
                s = shingles(tokens)
                u = s.view(np.uint64)
                n.append(len(s))
                names.append((int(_mix(u).sum(dtype=np.uint64).view(np.int64)), int(_mix(u ^ _M2).sum(dtype=np.uint64).view(np.int64))))
                low.append(s[:k])
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()), _lists(low)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "h1", "h2", "sketch"])

    return _tokens(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sketch array<long>")


def least_shared(n: int, k: int = K) -> int:
    """The values that the sketch of a class of n shingles shares, at least, with one whose estimate passes."""
    t = NUMERATOR / DENOMINATOR
    cut = max(1, math.ceil(k * (t - SIGMAS * math.sqrt(t * (1 - t) / k))))
    # sketches that are whole sets give the Jaccard similarity itself
    return min(cut, -(-NUMERATOR * n // DENOMINATOR)) if n <= k else cut


def estimates(sa: np.ndarray, sb: np.ndarray, na: np.ndarray, nb: np.ndarray, k: int = K) -> np.ndarray:
    """The estimate of each pair of rows, from sketches filled up with the largest number; -1 if it isn't near."""
    u = np.sort(np.concatenate([sa, sb], axis=1), axis=1)
    new = np.ones(u.shape, dtype=bool)
    new[:, 1:] = u[:, 1:] != u[:, :-1]
    held = u != _FILL
    rank = np.cumsum(new & held, axis=1)
    m = np.where((na <= k) & (nb <= k), rank[:, -1], np.minimum(rank[:, -1], k))
    i = (~new & held & (rank <= m[:, None])).sum(1)
    t = NUMERATOR / DENOMINATOR
    near = (i / m >= t - SIGMAS * np.sqrt(t * (1 - t) / m)) & (DENOMINATOR * np.minimum(na, nb) >= NUMERATOR * np.maximum(na, nb))
    return np.where(near, i / m, -1.0)


def block_proposals(outer: pa.Table, inner: pa.Table, k: int = K) -> list[tuple[int, int, float]]:
    """Near pairs (a, b, estimate) between two blocks of (c, n, family, sketch), the nearest first, as many as are needed
    to join the families that any near pair joins."""

    def read(t: pa.Table) -> tuple[np.ndarray, ...]:
        s = np.full((len(t), k), _FILL)
        for row, x in zip(s, t.column("sketch").to_pylist(), strict=True):
            row[: len(x)] = x
        return *(t.column(x).to_numpy() for x in ("c", "n", "family")), s

    (ca, na, fa, sa), (cb, nb, fb, sb) = read(outer), read(inner)
    found = []
    for a in range(0, len(ca), 32):
        x, y = np.nonzero(fa[a : a + 32, None] != fb[None])
        x += a
        e = estimates(sa[x], sb[y], na[x], nb[y], k)
        found.append((x[e >= 0], y[e >= 0], e[e >= 0]))
    x, y, e = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
    up: dict[int, int] = {}

    def root(f: int) -> int:
        while up.setdefault(f, f) != f:
            up[f] = up[up[f]]
            f = up[f]
        return f

    out = []
    for p in np.argsort(-e, kind="stable"):
        f, g = root(int(fa[x[p]])), root(int(fb[y[p]]))
        if f != g:
            up[f] = g
            out.append((int(ca[x[p]]), int(cb[y[p]]), float(e[p])))
    return out


def prefix_proposals(listed: DataFrame, families: DataFrame, classes: DataFrame, k: int = K, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """Near pairs (a < b, estimate) that meet in long lists only, as many as bring each into one family with what is
    proposed.  listed has the posts (v, c) in lists of several classes and the length m of v's list; families the
    components of the pairs proposed so far."""
    family = families.select(F.col("node").alias("c"), F.col("component").alias("family"))
    own = listed.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("m", "v"))).alias("p"))
    own = own.where(F.element_at("p", -1)["m"] > short).join(classes.select("c", "n", F.size("sketch").alias("k")), "c")
    least = F.element_at(F.array(*(F.lit(least_shared(n, k)) for n in range(1, k + 2))), F.least("n", F.lit(k + 1)).cast("int"))
    # values of one class only are the rarest
    keep = F.col("k") - least + 1 - (F.col("k") - F.size("p"))
    own = own.where(keep > 0).select("c", "n", F.explode(F.slice("p", F.lit(1), keep)).alias("p")).where(F.col("p.m") > short)
    own = own.join(family, "c", "left")
    # near sizes fall into one step or into two next to each other
    step = F.floor(F.log("n") / math.log(DENOMINATOR / NUMERATOR + 0.01)).cast("int")
    rows = own.select("c", "n", F.col("p.v").alias("v"), F.coalesce("family", "c").alias("family"), F.explode(F.array(step, step + 1)).alias("step"))
    rows = materialize(rows, "prefixes")
    sizes = rows.groupBy("v", "step", "family").agg(F.count("*").alias("n"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("h"))
    sizes = sizes.groupBy("v", "step").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("family", "n").alias("main"), F.sum("h").alias("h"))
    # lists of the same classes are compared once
    sizes = sizes.where(F.col("size") > F.col("most")).groupBy("size", "h").agg(F.min_by(F.struct("v", "step", "most", "main"), F.struct("v", "step")).alias("s")).select("size", "s.*")
    count = lambda n: F.ceil(n / block).cast("int")
    sizes = materialize(sizes.select("v", "step", "main", count(F.col("size")).alias("na"), count(F.col("size") - F.col("most")).alias("no")), "sizes")
    put = rows.join(sizes, ["v", "step"])
    pick = lambda salt, n: F.pmod(F.xxhash64("c", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["c", "n", "family", "v", "step"]
    outer = put.where("family <> main").select(*cols, F.lit(True).alias("outer"), pick(1, "no").alias("i"), every("na").alias("j"))
    inner = put.select(*cols, F.lit(False).alias("outer"), pick(2, "na").alias("j"), every("no").alias("i"))
    put = outer.unionByName(inner).join(classes.select("c", "sketch"), "c")

    def run(key: tuple, got: pa.Table) -> pa.Table:
        mask = got.column("outer")
        found = block_proposals(got.filter(mask), got.filter(pc.invert(mask)), k)
        cols = [pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else ([], [], []), (pa.int64(), pa.int64(), pa.float64()), strict=True)]
        return pa.table(cols, names=["a", "b", "estimate"])

    found = put.groupBy("v", "step", "i", "j").applyInArrow(run, "a long, b long, estimate double")
    found = found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("estimate").alias("estimate"))
    out = materialize(found, "pairs")
    release(rows, sizes)
    return out


def tree(parts: DataFrame) -> DataFrame:
    """Components as edges, few enough to go on from."""
    return parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def proposals(classes: DataFrame, k: int = K, short: int = SHORT) -> DataFrame:
    """Pairs (a < b) of classes that meet in an inverted list and whose union sketch looks near, with the
    estimate."""
    return families(classes, k, short)[0]


def families(classes: DataFrame, k: int = K, short: int = SHORT) -> tuple[DataFrame, DataFrame]:
    """The proposals and their components."""
    posts = classes.select(F.explode("sketch").alias("v"), "c")
    # most values belong to one class; only the others make lists
    # (written first, so that the join below is one that adaptive execution can split)
    lists = materialize(posts.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("v"), "lists")
    posts = materialize(posts.join(lists, "v", "left_semi"), "posts")
    head = lambda *by: F.min_by("c", F.xxhash64("c", *by))
    heads = materialize(posts.groupBy("v").agg(F.count("*").alias("m"), head().alias("r0"), head("v").alias("r1"), head("v", F.lit(1)).alias("r2")), "heads")
    listed = posts.join(heads, "v")
    stars = listed.where(F.col("m") > short).select("c", F.explode(F.array("r0", "r1", "r2")).alias("r"))
    small = listed.where(F.col("m") <= short).select("v", "c")
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.v") == F.col("y.v")) & (F.col("x.c") < F.col("y.c"))).select(F.col("x.c").alias("c"), F.col("y.c").alias("r"))
    both = stars.where("c <> r").unionByName(pairs).select(F.least("c", "r").alias("a"), F.greatest("c", "r").alias("b")).distinct()
    # the high halves of the retained values are enough for an estimate
    half = F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int"))
    side = lambda s: classes.select(F.col("c").alias(s), F.col("n").alias(f"n{s}"), half.alias(f"s{s}"))
    rows = both.join(side("a"), "a").join(side("b"), "b")
    rows = rows.where(DENOMINATOR * F.least("na", "nb") >= NUMERATOR * F.greatest("na", "nb"))
    whole = (F.col("na") <= k) & (F.col("nb") <= k)
    rows = rows.withColumn("u", F.array_sort(F.array_union("sa", "sb")))
    rows = rows.withColumn("u", F.when(whole, F.col("u")).otherwise(F.slice("u", 1, k)))
    rows = rows.withColumn("i", F.size(F.array_intersect(F.array_intersect("sa", "sb"), "u"))).withColumn("m", F.size("u"))
    t = NUMERATOR / DENOMINATOR
    near = F.col("i") / F.col("m") >= t - SIGMAS * F.sqrt(t * (1 - t) / F.col("m"))
    met = materialize(rows.where(near).select("a", "b", (F.col("i") / F.col("m")).alias("estimate")), "pairs")
    joined = components(met.select("a", "b"))
    more = prefix_proposals(posts.join(heads.select("v", "m"), "v"), joined, classes, k, short)
    out = materialize(met.unionByName(more), "pairs")
    joined = components(tree(joined).unionByName(more.select("a", "b")))
    release(lists, posts, heads, met, more)
    return out, joined


def shingle_set(text: str | None, width: int = WIDTH) -> set:
    """The distinct shingles themselves."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if len(w) < width:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(width)), strict=False))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.  Only texts travel, which compress better than hashes."""
    side = lambda s: texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"t{s}"))
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            keep = []
            for i, b in enumerate(batch.column("b").to_pylist()):
                tb = batch.column("tb")[i].as_py()
                if tb != last:  # rows of one b come together
                    last, held = tb, shingle_set(tb)
                x = shingle_set(batch.column("ta")[i].as_py())
                both = len(x & held)
                keep.append(DENOMINATOR * both >= NUMERATOR * (len(x) + len(held) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def block_links(outer: list[tuple[int, int, str]], inner: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Links between two blocks of (id, component, text), as many as are needed to join the components that any link
    joins.  Intersections of all pairs come from products of incidence matrices, some columns at a time."""
    made: dict[int, set] = {}
    for i, _, text in (*outer, *inner):
        if i not in made:
            made[i] = shingle_set(text)
    number: dict = {}
    for i, _, _ in outer:
        for g in made[i]:
            number.setdefault(g, len(number))

    def incidence(rows: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
        at = [(number[g], k) for k, (i, _, _) in enumerate(rows) for g in made[i] if g in number]
        at.sort()
        both = np.array(at, dtype=np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    (oc, orow), (ic, irow) = incidence(outer), incidence(inner)
    shared = np.zeros((len(outer), len(inner)), dtype=np.float32)
    for c in range(0, len(number), COLUMNS):
        part = []
        for cols, rows, n in ((oc, orow, len(outer)), (ic, irow, len(inner))):
            lo, hi = np.searchsorted(cols, (c, c + COLUMNS))
            x = np.zeros((n, COLUMNS), dtype=np.float32)
            x[rows[lo:hi], cols[lo:hi] - c] = 1
            part.append(x)
        shared += part[0] @ part[1].T
    no, ni = (np.array([len(made[i]) for i, _, _ in rows]) for rows in (outer, inner))
    near = DENOMINATOR * shared >= NUMERATOR * (no[:, None] + ni[None] - shared)
    near &= np.array([c for _, c, _ in outer])[:, None] != np.array([c for _, c, _ in inner])[None]
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    out = []
    for a, b in zip(*np.nonzero(near), strict=True):
        x, y = root(outer[a][1]), root(inner[b][1])
        if x != y:
            up[x] = y
            out.append((outer[a][0], inner[b][0]))
    return out


def remaining_links(pairs: DataFrame, parts: DataFrame, texts: DataFrame, block: int = BLOCK, joined: DataFrame | None = None) -> DataFrame:
    """Links that the proposals have not met.  Documents joined by proposed pairs, verified or not, form a family; in a
    family of several components every document outside the largest one is compared with all of the family, block by
    block.  A family of two is one proposed pair, which is verified already.  joined: the families, if known."""
    joined = components(pairs.select("a", "b")) if joined is None else joined
    family = joined.select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    own = parts.select(F.col("node").alias("doc_id"), "component")
    rows = materialize(family.join(own, "doc_id", "left").select("doc_id", "family", F.coalesce("component", "doc_id").alias("part")), "members")
    sizes = rows.groupBy("family", "part").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("family").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("part", "n").alias("main"))
    sizes = sizes.where((F.col("size") > 2) & (F.col("size") > F.col("most")))
    count = lambda n: F.ceil(n / block).cast("int")
    sizes = materialize(sizes.select("family", "main", count(F.col("size")).alias("na"), count(F.col("size") - F.col("most")).alias("no")), "sizes")
    rows = rows.join(sizes, "family")
    pick = lambda salt, n: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["doc_id", "part", "family"]
    outer = rows.where("part <> main").select(*cols, F.lit(True).alias("outer"), pick(1, "no").alias("i"), every("na").alias("j"))
    inner = rows.select(*cols, F.lit(False).alias("outer"), pick(2, "na").alias("j"), every("no").alias("i"))
    put = outer.unionByName(inner).join(texts, "doc_id")

    def run(key: tuple, got: pa.Table) -> pa.Table:
        all_ = list(zip(*(got.column(c).to_pylist() for c in ("doc_id", "part", "text", "outer")), strict=True))
        found = block_links([r[:3] for r in all_ if r[3]], [r[:3] for r in all_ if not r[3]])
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return put.groupBy("family", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per document."""
    rows = materialize(sketches(docs, id_col, text_col), "sketches")
    named = rows.where("n > 0 and doc_id is not null")
    classes = materialize(named.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("c"), F.first("sketch").alias("sketch")), "classes")
    pairs, joined = families(classes.select("c", "n", "sketch"))
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # neither side has a bound, so the plan is the same at every size
    texts = materialize(source.join(needed.hint("merge"), "doc_id", "left_semi"), "texts")
    # the likeliest partner of each class first
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "estimate"))
    best = ends.groupBy("a").agg(F.max_by("b", "estimate").alias("b"))
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialize(verified(best, texts), "links")
    parts = components(links)
    of = lambda s: parts.select(F.col("node").alias(s), F.col("component").alias(f"p{s}"))
    apart = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = apart.where(F.coalesce("pa", "a") != F.coalesce("pb", "b")).select("a", "b")
    more = materialize(verified(apart, texts), "more")
    parts = components(tree(parts).unionByName(more))
    rest = materialize(remaining_links(pairs, parts, texts, joined=joined), "rest")
    parts2 = components(tree(parts).unionByName(rest))
    release(texts, pairs, links, more, rest)
    classes = classes.join(parts2, F.col("c") == F.col("node"), "left").select("h1", "h2", "n", F.coalesce("component", "c").alias("component_id"))
    out = rows.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    out = out.select(F.col("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
