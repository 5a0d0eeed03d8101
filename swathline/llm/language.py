"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's features are its byte trigrams and four-grams, A-Z lowered, each hashed to one of BUCKETS rows of an
embedding table; the mean of these rows goes through a linear layer and a softmax.  Table and layer are
trained by stochastic gradient descent in numpy on a bounded sample of labelled texts (SAMPLE of them, whole
texts, the first in order of a hash of the id), of which the driver sees the hashed features only.  A part of the sample is left out of training and sets the
softmax temperature and the least score below which a prediction is rejected.

Predictions see the text alone.  A text that is null or has no letter is `und` with score 0.  Without any
labelled text every prediction is `und`.  Each input row gives one output row, whatever its id; the model is
of fixed size and is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, DIM = 1 << 15, 12
SAMPLE = 4000  # labelled texts, at most, that the driver trains on
EPOCHS, BATCH, RATE = 10, 32, 0.5
REJECTED = 0.0005  # share of held-out sample texts that may fall under the least score
MOST_LEAST = 0.2  # however few texts set it, the least score is never above this part of the way from chance to certainty: 0.4 of four labels
UNDETERMINED = "und"
_WORDLIKE = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_BLOCK = 1 << 20  # bytes of a text hashed at once


def _hashes(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all byte trigrams and four-grams, in blocks."""
    raw = np.frombuffer(f" {text} ".encode("utf-8", "replace"), dtype=np.uint8)
    for at in range(0, len(raw), _BLOCK):
        b = _FOLD[raw[at : at + _BLOCK + 3]]
        for n in (3, 4):
            if len(b) < n:
                continue
            starts = min(len(b) - n + 1, _BLOCK)
            h = np.full(starts, n, dtype=np.uint32)
            for k in range(n):
                h = (h ^ b[k : k + starts]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            yield h & np.uint32(BUCKETS - 1)


def has_letter(text: str) -> bool:
    """Whether a text has a character of a letter category; fractions and circled numbers are none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for h in _hashes(text):
        total += np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, (total[at] / max(1, total.sum())).astype(np.float32)


def train(texts: list[str], labels: list[str], seed: int = 5) -> dict:
    """The model as plain values: labels, one weight row per bucket and label, bias, temperature, least score."""
    return train_counts([_counts(x) for x in texts], labels, seed)


def train_counts(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 5) -> dict:
    """train() from what _counts() makes of the texts."""
    names = sorted(set(labels))
    if not names:
        return {"labels": [], "weights": np.zeros((BUCKETS, 0), np.float32), "bias": np.zeros(0, np.float32), "temperature": 1.0, "least": 0.0}
    r = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in labels])
    fit = [i for i in range(len(bags)) if i % 5] or list(range(len(bags)))
    held = [i for i in range(len(bags)) if not i % 5]
    table, layer, bias = r.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32), r.normal(0, 0.3, (DIM, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = r.permutation(fit)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            index, weight = np.concatenate([bags[i][0] for i in rows]), np.concatenate([bags[i][1] for i in rows])
            ends = np.cumsum([0] + [len(bags[i][0]) for i in rows])[:-1]
            mean = np.add.reduceat(table[index] * weight[:, None], ends)
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            down = p @ layer.T
            layer -= rate / len(rows) * (mean.T @ p)
            bias -= rate / len(rows) * p.sum(0)
            # a bucket holds a small share of a text, so its own step is longer
            step = np.repeat(down, np.diff(np.append(ends, len(index))), axis=0) * weight[:, None]
            np.subtract.at(table, index, rate * 40 / len(rows) * step)
    weights = table @ layer
    z = np.array([(weights[bags[i][0]] * bags[i][1][:, None]).sum(0) + bias for i in held], dtype=np.float64).reshape(-1, len(names))

    def chance(temperature: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / temperature)
        return e / e.sum(1, keepdims=True)

    loss = lambda t: -np.log(chance(t)[np.arange(len(held)), y[held]] + 1e-12).mean()
    temperature = min((float(t) for t in np.geomspace(0.05, 20, 60)), key=loss) if len(held) else 1.0
    most = 1 / len(names) + MOST_LEAST * (1 - 1 / len(names))
    least = min(float(np.quantile(chance(temperature).max(1), REJECTED)), most) if len(held) else 0.0
    return {"labels": names, "weights": weights.astype(np.float32), "bias": bias, "temperature": temperature, "least": least}


def predict(model: dict, text: str | None) -> tuple[str, float]:
    if text is None or not model["labels"] or not has_letter(text):
        return UNDETERMINED, 0.0
    z, n = model["bias"].astype(np.float64), 0
    total = np.zeros(len(z))
    for h in _hashes(text):
        for at in range(0, len(h), 1 << 16):
            total += model["weights"][h[at : at + (1 << 16)]].sum(0, dtype=np.float64)
        n += len(h)
    z = (z + total / max(1, n)) / model["temperature"]
    p = np.exp(z - z.max())
    p /= p.sum()
    best = int(p.argmax())
    return model["labels"][best], float(p[best])


def fit(labelled: DataFrame, text: Column, label: Column, order: Column, sample: int = SAMPLE) -> dict:
    """Train on the first `sample` rows by `order` (a number) whose text and label aren't null, with rows that tie with
    the last, up to as many again."""
    rows = labelled.select(text.cast("string").alias("t"), label.cast("string").alias("l"), order.alias("o")).where("t is not null and l is not null")
    # the place of the last of the sample first, so that texts of other rows never leave their tasks
    last = rows.select("o").orderBy("o").limit(sample).agg(F.max("o")).first()[0]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [_counts(x) for x in batch.column("t").to_pylist()]
            ends = pa.array(np.cumsum([0] + [len(a) for a, _ in bags]), pa.int32())
            flat = [np.concatenate([bag[k] for bag in bags]) if bags else np.zeros(0) for k in (0, 1)]
            arrays = [pa.ListArray.from_arrays(ends, pa.array(v, kind)) for v, kind in zip(flat, (pa.int32(), pa.float32()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("l"), *arrays], ["o", "l", "at", "w"])

    # a text's features are BUCKETS numbers at most, however long it is
    some = rows.where(F.col("o") <= F.lit(last)).withColumn("o", F.col("o").cast("long")).limit(2 * sample)
    got = some.mapInArrow(hashed, "o long, l string, at array<int>, w array<float>").toArrow().combine_chunks()
    names, place = got.column("l").to_pylist(), got.column("o").to_pylist()
    at, w = ([x.values.to_numpy()[a:b] for x in got.column(k).chunks for a, b in zip(x.offsets.to_numpy(), x.offsets.to_numpy()[1:], strict=False)] for k in ("at", "w"))
    order = sorted(range(len(names)), key=lambda i: (place[i], names[i]))
    return train_counts([(at[i], w[i]) for i in order], [names[i] for i in order])


def identify(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score and rejected to every row (of the kept columns)."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["lang_pred", "score", "rejected"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(*keep, docs[text_col].alias("_read"))
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = [predict(m, x) for x in batch.column("_read").to_pylist()]
            new = [pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64()), pa.array([x == UNDETERMINED or s < m["least"] for x, s in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], [*keep, *added])

    return rows.mapInArrow(run, schema)
