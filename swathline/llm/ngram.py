"""Language-model scoring with an Elias-Fano n-gram trie.

The first level holds the training words (their 64-bit hashes in order, with counts; a word's number is its
place).  The second level holds, for each context word, the words seen after it.  Successor numbers
rise within a context; each context adds the last value of the one before, so the whole level rises and is
stored in Elias-Fano form: low bits packed, high bits in unary.  The pointers to each context's first
successor are monotone too and stored alike.  A lookup takes the context's pointers, makes the word's
number relative to the context, jumps to its high part and searches the few entries that share it.
Probabilities are smoothed against the shorter context with a Dirichlet prior,
    P(w | c) = (n(c w) + PRIOR * P(w)) / (n(c) + PRIOR),   P(w) = (n(w) + 0.5) / (N + 0.5 (V + 1)),
and quantised to 256 levels; contexts unseen, or words unseen after them, back off with the prior's share.

Counts come from all training texts.  Each level is written in shards by ranges of hash bits, a context's
successors spread over several shards, so no word, however frequent, makes a large shard.  Shards are files in
the shared folder that scorers map into memory; where that folder isn't a mounted one they are read whole.  A scorer
keeps up to HELD bytes of opened shards of each level, whatever the size of the model.
Word counts are combined per task before they are shuffled.

Null texts are empty and consist of the end token alone.  Each input row gives one output row.  A null id
trains and is not held out.  Without training rows every word is unknown: N = V = 0 and P(w) = 1.
"""

from __future__ import annotations

import io
import json
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, new_path
from .tokens import hashes, mix, slices

PRIOR = 100.0
BITS = 12  # both levels are dealt into 2**BITS buckets, or 16 for each shuffle partition if that is more
SPREAD = 64  # buckets over which one context's successors lie
LEVELS = 256
HELD = 256 << 20  # bytes of opened shards that a scorer keeps of each level
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bucket(context: np.ndarray, word: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The bucket of a pair of word hashes."""
    part = mix(word) % np.uint64(SPREAD)
    return (mix(context + part * _GOLD) >> np.uint64(64 - bits)).astype(np.int32)


class EliasFano:
    """A rising sequence of n non-negative numbers below a universe: per entry the low bits, packed to whole bytes
    as needed, and the high parts in unary with a running count of ones for select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, rank: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.rank = n, low_bits, low, high, rank.astype(np.int64)
        self.zeros = np.arange(len(rank)) * 64 - self.rank

    @staticmethod
    def build(values: np.ndarray) -> dict[str, np.ndarray]:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, int(top // max(n, 1)).bit_length() - 1)
        packed = np.zeros((n * bits + 63) // 64 + 1, dtype=np.uint64)
        if bits:
            low = values.astype(np.uint64) & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(packed, word, low << off)
            over = off + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(packed, word[over] + 1, low[over] >> (np.uint64(64) - off[over]))
        ones = (values.astype(np.int64) >> bits) + np.arange(n)
        size = (int(ones[-1]) + 1 if n else 0) + 64
        plane = np.zeros((size + 63) // 64 * 64, dtype=np.uint8)
        plane[ones] = 1
        high = np.packbits(plane, bitorder="little").view(np.uint64)
        rank = np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype(np.uint32)
        return {"low": packed, "high": high, "rank": rank, "shape": np.array([n, bits], dtype=np.int64)}

    @staticmethod
    def of(parts: dict[str, np.ndarray]) -> EliasFano:
        n, bits = (int(x) for x in parts["shape"])
        return EliasFano(n, bits, parts["low"], parts["high"], parts["rank"])

    @staticmethod
    def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one (from 0) of each word, by halving."""
        at, k = np.zeros(len(word), dtype=np.uint64), k.astype(np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            part = (word >> at) & np.uint64((1 << width) - 1)
            c = np.bitwise_count(part).astype(np.uint64)
            go = k >= c
            k = np.where(go, k - c, k)
            at = np.where(go, at + np.uint64(width), at)
        return at.astype(np.int64)

    def lows(self, j: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(j), dtype=np.int64)
        bits = np.uint64(self.low_bits)
        at = j.astype(np.uint64) * bits
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> off
        over = off + bits > np.uint64(64)
        value = np.where(over, value | (self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63))), value)
        return (value & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def get(self, j: np.ndarray) -> np.ndarray:
        """Entries by number."""
        w = np.searchsorted(self.rank, j, side="right") - 1
        one = w * 64 + self._select(self.high[w], j - self.rank[w])
        return ((one - j) << self.low_bits) | self.lows(j)

    def before(self, h: np.ndarray) -> np.ndarray:
        """How many entries have a high part below h."""
        h = np.minimum(h, len(self.high) * 64 - self.n)
        k = np.maximum(h - 1, 0)  # after the h-th zero
        w = np.minimum(np.searchsorted(self.zeros, k, side="right") - 1, len(self.high) - 1)
        at = w * 64 + self._select(~self.high[w], k - self.zeros[w])
        return np.where(h > 0, at - k, 0)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The entry equal to each value, or -1: jump to its high part, then halve within it."""
        if not self.n:
            return np.full(len(value), -1, dtype=np.int64)
        h, low = value >> self.low_bits, value & ((1 << self.low_bits) - 1)
        lo, end = self.before(h), self.before(h + 1)
        hi = end.copy()
        while True:
            go = lo < hi
            if not go.any():
                break
            mid = (lo + hi) >> 1
            less = self.lows(np.minimum(mid, self.n - 1)) < low
            lo, hi = np.where(go & less, mid + 1, lo), np.where(go & ~less, mid, hi)
        found = lo < end
        found &= self.lows(np.minimum(lo, self.n - 1)) == low
        return np.where(found, lo, -1)


def _store(root: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of arrays: a JSON line that says where they lie, then the arrays, aligned."""
    place, at = {}, 0
    for k, a in arrays.items():
        place[k] = [str(a.dtype), at, len(a)]
        at += (a.nbytes + 63) // 64 * 64
    head = json.dumps(place).encode()
    out = io.BytesIO()
    out.write(len(head).to_bytes(8, "little") + head + bytes(-(8 + len(head)) % 64))
    for a in arrays.values():
        out.write(a.tobytes() + bytes(-a.nbytes % 64))
    fs, folder = pyarrow.fs.FileSystem.from_uri(root)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/{name}", compression=None) as f:
        f.write(out.getbuffer())


class Held:
    """Opened shards, the least recently used let go beyond HELD bytes (those last asked for stay)."""

    def __init__(self, root: str, make):
        self.root, self.make, self.size = root, make, 0
        self.shards: OrderedDict[str, tuple] = OrderedDict()

    def __getitem__(self, name: str):
        if name not in self.shards:
            parts = _open(self.root, name)
            size = sum(a.nbytes for a in parts.values())
            self.shards[name] = (self.make(parts), size)
            self.size += size
            while self.size > HELD and len(self.shards) > 1:
                self.size -= self.shards.popitem(last=False)[1][1]
        self.shards.move_to_end(name)
        return self.shards[name][0]


def _open(root: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory where the folder is mounted."""
    at = urlparse(root)
    if at.scheme in ("", "file"):
        raw = np.memmap(f"{at.path}/{name}", dtype=np.uint8, mode="r")
    else:
        fs, folder = pyarrow.fs.FileSystem.from_uri(root)
        with fs.open_input_file(f"{folder}/{name}") as f:
            raw = np.frombuffer(f.read(), dtype=np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    place = json.loads(raw[8 : 8 + size].tobytes())
    base = (8 + size + 63) // 64 * 64
    return {k: raw[base + o : base + o + n * np.dtype(d).itemsize].view(d) for k, (d, o, n) in place.items()}


class Words:
    """The first level: hashes in order over all buckets, counts, and the sums N and V."""

    def __init__(self, root: str, buckets: list[tuple[int, str, int, int]], total: int, bits: int = BITS):
        """buckets: (bucket, file, first place in the file, entries), in order."""
        self.root, self.total, self.bits = root, total, bits
        self.files = sorted({f for _, f, _, _ in buckets})
        place = {f: k for k, f in enumerate(self.files)}
        self.file_of, self.shift, self.known = np.full(1 << bits, -1, dtype=np.int32), np.zeros(1 << bits, dtype=np.int64), 0
        for b, f, at, n in buckets:
            self.file_of[b], self.shift[b] = place[f], self.known - at
            self.known += n
        self.held = Held(root, lambda parts: (parts["hash"], parts["count"]))

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1 if unknown) and count of each of some hashes (uint64, in order)."""
        number, count = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        b = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        file = self.file_of[b]
        for k in np.unique(file[file >= 0]):
            at = np.flatnonzero(file == k)
            table, n = self.held[self.files[k]]
            i = np.minimum(np.searchsorted(table, hashes[at]), len(table) - 1)
            same = table[i] == hashes[at]
            number[at] = np.where(same, i + self.shift[b[at]], -1)
            count[at] = np.where(same, n[i], 0)
        return number, count

    def log(self, count: np.ndarray) -> np.ndarray:
        """Base log10 probability of words by their counts."""
        if not self.total:
            return np.zeros(len(count))
        return np.log10(count + 0.5) - np.log10(self.total + 0.5 * (self.known + 1))


def _texts(docs: DataFrame, text_col: str, *keep) -> DataFrame:
    return docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token hashes with an end token per text, lengths) of some rows at a time."""
    for raw, rows in slices(batch.column("_t")):
        yield hashes(raw, rows, end=True)


def _pairs(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each token has one before it in its text."""
    inner = np.ones(len(tokens), dtype=bool)
    inner[np.cumsum(lengths)[:-1]] = False
    inner[:1] = False
    return inner


class _Combiner:
    """Counts of pairs of numbers, combined in memory up to a bound."""

    def __init__(self, limit: int = 1_500_000):
        self.limit, self.held, self.size = limit, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple]:
        if len(a):
            self.held.append(self._sum(a, b, np.ones(len(a), dtype=np.int64)))
            self.size += len(self.held[-1][0])
        if self.size > self.limit:
            merged = self._sum(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
            self.held, self.size = [merged], len(merged[0])
            if self.size > self.limit // 2:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if self.held:
            yield self._sum(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
        self.held, self.size = [], 0

    @staticmethod
    def _sum(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple:
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        return a[at], b[at], np.add.reduceat(n, at)


def _batch(names: list[str], *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names)


def _gathered(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    held = [[b.column(c).to_numpy() for c in names] for b in batches if b.num_rows]
    return [np.concatenate(x) for x in zip(*held, strict=True)] if held else []


def train(docs: DataFrame, text_col: str = "text") -> dict:
    """Count, write both levels and return what scorers need to open them: a few values per shard."""
    spark = docs.sparkSession
    root = new_path(spark, "ngram")
    tokens = _texts(docs, text_col)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = max(BITS, (parts - 1).bit_length() + 4)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Combiner()
        out = lambda x: _batch(["b", "w", "n"], (x[0] >> np.uint64(64 - bits)).astype(np.int32), x[0].view(np.int64), x[2])
        for batch in batches:
            for t, _ in _tokens(batch):
                for x in held.add(t, np.zeros(len(t), dtype=np.uint8)):
                    yield out(x)
        for x in held.flush():
            yield out(x)

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gathered(batches, ["b", "w", "n"])
        if got:
            b, w, n = got
            w = w.view(np.uint64)
            order = np.argsort(w)
            name = f"w-{uuid.uuid4().hex}"
            _store(root, name, {"hash": w[order], "count": n[order]})
            used, at, many = np.unique(b[order], return_index=True, return_counts=True)
            total = np.add.reduceat(n[order], at)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([name] * len(used)), pa.array(at), pa.array(many), pa.array(total)], ["b", "file", "at", "n", "total"])

    counted = tokens.mapInArrow(count_words, "b int, w long, n long")
    summed = counted.repartition(parts, "b").groupBy("b", "w").agg(F.sum("n").alias("n"))
    found = materialize(summed.mapInArrow(write_words, "b int, file string, at long, n long, total long"), "words").collect()  # a row per bucket at most
    vocabulary = (root, sorted((r["b"], r["file"], r["at"], r["n"]) for r in found), sum(r["total"] for r in found), bits)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Combiner()
        out = lambda x: _batch(["b", "c", "w", "n"], bucket(x[0], x[1], bits), x[0].view(np.int64), x[1].view(np.int64), x[2])
        for batch in batches:
            for t, lengths in _tokens(batch):
                at = np.flatnonzero(_pairs(t, lengths))
                for x in held.add(t[at - 1], t[at]):
                    yield out(x)
        for x in held.flush():
            yield out(x)

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gathered(batches, ["b", "c", "w", "n"])
        if got:
            b, c, w, n = got
            name = f"p-{uuid.uuid4().hex}"
            _store(root, name, build_shard(Words(*vocabulary), c.view(np.uint64), w.view(np.uint64), n))
            used = np.unique(b)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([name] * len(used))], ["b", "file"])

    pairs = tokens.mapInArrow(count_pairs, "b int, c long, w long, n long").repartition(parts, "b")
    pairs = pairs.groupBy("b", "c", "w").agg(F.sum("n").alias("n"))
    level2 = {r["b"]: r["file"] for r in materialize(pairs.mapInArrow(write_pairs, "b int, file string"), "pairs").collect()}  # a row per bucket at most
    return {"root": root, "words": vocabulary, "pairs": level2}


def build_shard(vocabulary: Words, c: np.ndarray, w: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a second-level shard from its pairs of hashes and their counts."""

    def look(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, back = np.unique(x, return_inverse=True)
        number, count = vocabulary.look(u)
        return number[back], count[back]

    (ci, cn), (wi, wn) = look(c), look(w)
    order = np.lexsort((wi, ci))
    ci, cn, wi, wn, n = ci[order], cn[order], wi[order], wn[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], ci[1:] != ci[:-1]]))
    size = np.diff(np.append(first, len(ci)))
    top = wi[np.append(first[1:], len(ci)) - 1] + 1  # of each context: its largest successor, plus one
    base = np.concatenate([[0], np.cumsum(top)[:-1]])
    values = wi + np.repeat(base, size)
    lower = 10.0 ** vocabulary.log(wn)
    logp = np.log10((n + PRIOR * lower) / (cn + PRIOR))
    lo, hi = float(logp.min()), float(logp.max())
    step = (hi - lo) / (LEVELS - 1) or 1.0
    out = {"quantum": np.array([lo, step]), "code": np.round((logp - lo) / step).astype(np.uint8)}
    for name, x in (("context", ci[first]), ("pointer", np.append(first, len(ci))), ("successor", values)):
        out |= {f"{name}.{k}": v for k, v in EliasFano.build(x).items()}
    return out


class Shard:
    def __init__(self, parts: dict[str, np.ndarray]):
        of = lambda name: EliasFano.of({k: parts[f"{name}.{k}"] for k in ("low", "high", "rank", "shape")})
        self.contexts, self.pointers, self.successors = of("context"), of("pointer"), of("successor")
        self.low, self.step = (float(x) for x in parts["quantum"])
        self.code = parts["code"]

    def look(self, c: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 P(w | c) by the numbers of both, NaN where the pair wasn't seen."""
        out = np.full(len(c), np.nan)
        u, back = np.unique(c, return_inverse=True)
        at = self.contexts.find(u)
        ok = at >= 0
        begin = self.pointers.get(np.where(ok, at, 0))
        # a context's offset is what the one before ends with
        base = np.where(ok & (begin > 0), self.successors.get(np.maximum(begin - 1, 0)) + 1, 0)
        end = self.pointers.get(np.where(ok, at + 1, 0))
        top = np.where(ok, self.successors.get(np.maximum(end - 1, 0)), -1)
        ok, base, top = ok[back], base[back], top[back]
        value = w + base
        q = np.flatnonzero(ok & (value <= top))
        found = self.successors.find(value[q])
        hit = found >= 0
        out[q[hit]] = self.low + self.step * self.code[found[hit]]
        return out


class Scorer:
    def __init__(self, model: dict):
        self.model, self.words = model, Words(*model["words"])
        self.files = sorted(set(model["pairs"].values()))
        place = {f: k for k, f in enumerate(self.files)}
        self.shard_of = np.full(1 << self.words.bits, -1, dtype=np.int32)
        for b, f in model["pairs"].items():
            self.shard_of[b] = place[f]
        self.held = Held(model["root"], Shard)

    def score(self, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and model score of each text."""
        u, back = np.unique(tokens, return_inverse=True)
        number, count = self.words.look(u)
        log = self.words.log(count)
        starts = np.cumsum(lengths) - lengths
        known, base = np.add.reduceat((count > 0)[back].astype(np.int64), starts), np.add.reduceat(log[back], starts)
        model = log[back].copy()
        at = np.flatnonzero(_pairs(tokens, lengths))
        key, pair = np.unique(back[at - 1] * len(u) + back[at], return_inverse=True)  # each pair once
        a, b = key // len(u), key % len(u)
        p = np.full(len(key), np.nan)
        both = np.flatnonzero((number[a] >= 0) & (number[b] >= 0))
        shard = self.shard_of[bucket(u[a[both]], u[b[both]], self.words.bits)]
        for k in np.unique(shard[shard >= 0]):
            q = both[shard == k]
            p[q] = self.held[self.files[k]].look(number[a[q]], number[b[q]])
        off = np.log10(PRIOR) - np.log10(count[a] + PRIOR) + log[b]
        model[at] = np.where(np.isnan(p), off, p)[pair]
        return known, base, np.add.reduceat(model, starts)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few values per shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            got = [(lengths.astype(np.int64), *scorer.score(t, lengths)) for t, lengths in _tokens(batch)]
            cols = [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, cols)], ["id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = _texts(docs, text_col, F.col(id_col).alias("id"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("id", id_col)


def training(docs: DataFrame, id_col: str = "doc_id", folds: int = 5, held: int = 1) -> DataFrame:
    return docs.where(fold(F.col(id_col), folds) != held)
