"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the vocabulary's pieces drives a single left-to-right pass over a text's
characters.  At each position the output links give the pieces that end there, and each relaxes the best
score of its end from that of its start.  A unigram vocabulary's scores are log probabilities that add up
(Viterbi).  A BPE vocabulary's result is the one sequence whose neighbouring pairs all survive the merges,
so there a relaxation counts only where the piece is compatible with the best path's last piece; the path
is then exactly the merge result.  A character that no piece covers falls back to its bytes.

Texts are cut where no piece can lie across (before a run of spaces, around characters that stand alone),
and the cuts' results are kept in a bounded table per worker.  The vocabulary file is read once on the
driver and sent to the executors as a broadcast of its own fixed size.

Null texts have null pieces and a null decoded text; empty texts have none.  Every input row gives one
output row.  U+2581 in a text stands for a space and comes back as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
KEPT, KEPT_CHARS = 400_000, 48  # entries of a worker's tables of results, and their longest text


def load(path: str = VOCABULARY) -> dict:
    """The vocabulary as plain values: pieces, scores, kinds and whether it is BPE."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    proto = sp.serialized_model_proto()
    return {
        "pieces": [sp.id_to_piece(i) for i in range(n)], "scores": [sp.get_score(i) for i in range(n)],
        "bytes": {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}, "unknown": sp.unk_id(),
        "special": [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)], **_settings(proto),
    }


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


def _settings(proto: bytes) -> dict:
    # Field 2 of a model is its trainer's settings (3: kind, 2 for BPE), field 3 its
    # normaliser's (3: dummy prefix, 4: drop extra spaces).
    parts = dict(x for x in _fields(proto) if x[0] in (2, 3))
    trainer, normal = dict(_fields(parts.get(2, b""))), dict(_fields(parts.get(3, b"")))
    return {"bpe": trainer.get(3, 1) == 2, "prefix": bool(normal.get(3, 1)), "trim": bool(normal.get(4, 1))}


def merged(text: str, ids: dict[str, int], rank: list[int]) -> tuple[list[str], list[str]]:
    """The merges of a short text one by one, the least rank first and then the leftmost; and the state before the
    last merge."""
    parts = before = list(text)
    while len(parts) > 1:
        found = [(rank[i], n) for n, pair in enumerate(zip(parts, parts[1:], strict=False)) if (i := ids.get("".join(pair))) is not None]
        if not found:
            break
        n = min(found)[1]
        before, parts = parts, [*parts[:n], "".join(parts[n : n + 2]), *parts[n + 2 :]]
    return parts, before


class Coder:
    def __init__(self, vocabulary: dict):
        import ahocorasick

        self.pieces, self.scores, self.byte_ids, self.unknown, self.bpe = (vocabulary[k] for k in ("pieces", "scores", "bytes", "unknown", "bpe"))
        self.prefix, self.trim = vocabulary["prefix"], vocabulary["trim"]
        special = set(vocabulary["special"]) | set(self.byte_ids.values())
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.chars = {c for p in self.ids for c in p}
        used = dict(self.ids)
        if self.bpe:
            self._plan_merges()
            used = {p: i for p, i in used.items() if self.left[i] is not None}  # others never come out of the merges
        self.automaton = ahocorasick.Automaton()
        for p, i in used.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            self.cuts = None  # some piece lies across the start of a word
        else:
            alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
            self.cuts = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.kept: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        raw = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.raw = [raw.get(i, b"" if i in special else p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)]

    def _plan_merges(self) -> None:
        """Each piece's rank in the order of merges and the two pieces of its own last merge; characters come
        before all merges and are their own parts."""
        n = len(self.pieces)
        order = sorted(self.ids.values(), key=lambda i: (len(self.pieces[i]) > 1, -self.scores[i], i))
        self.rank = [n] * n
        for r, i in enumerate(order):
            self.rank[i] = r
        self.left: list = [None] * n
        self.right: list = [None] * n
        for p, i in self.ids.items():
            if len(p) == 1:
                self.left[i] = self.right[i] = i
            else:
                parts, before = merged(p, self.ids, self.rank)
                if len(parts) == 1 and all(x in self.ids for x in before):
                    self.left[i], self.right[i] = (self.ids[x] for x in before)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border between pieces a and b.

        Both pieces are taken apart from the last merge back, always the younger part first; the parts at the
        border must not form a piece that would have merged before they grew."""
        pieces, ids, rank, left, right = self.pieces, self.ids, self.rank, self.left, self.right
        limit = len(pieces)
        while True:
            both = ids.get(pieces[a] + pieces[b])
            if both is not None and rank[both] < limit:
                return False
            if rank[a] > rank[b] and right[a] != a:
                limit, a = rank[a], right[a]
            elif left[b] != b:
                limit, b = rank[b] + 1, left[b]
            elif right[a] != a:
                limit, a = rank[a], right[a]
            else:
                return True

    def _merge_path(self, text: str) -> list[int]:
        """BPE: at each end the one piece that fits the best path of what precedes it."""
        n, pairs, many = len(text), self.pairs, len(self.pieces)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for end, (k, i) in self.automaton.iter(text):
            end += 1
            if size[end]:
                continue
            if k < end:
                before = last[end - k]
                if before < 0:
                    continue
                key = before * many + i
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= KEPT:
                        pairs.clear()
                    fits = pairs[key] = self._compatible(before, i)
                if not fits:
                    continue
            last[end], size[end] = i, k
        if not size[n]:  # a character that is a piece's part but no piece
            return [self.ids.get(x, self.unknown) for x in merged(text, self.ids, self.rank)[0]]
        return self._back(last, size)

    def _score_path(self, text: str) -> list[int]:
        """Unigram: the path of greatest total score.  A character without a piece costs more than any piece."""
        n, scores = len(text), self.scores
        none = min(scores) - 10.0
        best, last, size = [-np.inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        done = 0
        for end, (k, i) in self.automaton.iter(text):
            end += 1
            while done < end - 1:  # ends that no piece reaches
                done += 1
                if best[done - 1] + none > best[done]:
                    best[done], last[done], size[done] = best[done - 1] + none, self.unknown, 1
            value = best[end - k] + scores[i]
            if value > best[end]:
                best[end], last[end], size[end] = value, i, k
        while done < n:
            done += 1
            if best[done - 1] + none > best[done]:
                best[done], last[done], size[done] = best[done - 1] + none, self.unknown, 1
        return self._back(last, size)

    @staticmethod
    def _back(last: list[int], size: list[int]) -> list[int]:
        ids, n = [], len(last) - 1
        while n:
            ids.append(last[n])
            n -= size[n]
        return ids[::-1]

    def _path(self, text: str) -> list[int]:
        """The best path over a text, as ids; characters of no piece become bytes."""
        path = self._merge_path if self.bpe else self._score_path
        if self.chars.issuperset(text):
            return path(text)
        ids: list[int] = []
        start = 0
        for at, c in enumerate(text):
            if c not in self.chars:
                ids += path(text[start:at]) if at > start else []
                ids += [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unknown]
                start = at + 1
        return ids + (path(text[start:]) if start < len(text) else [])

    def _cut(self, text: str) -> bytes:
        out = self.kept.get(text)
        if out is None:
            out = np.array(self._path(text), dtype=np.int32).tobytes()
            if len(text) <= KEPT_CHARS:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[text] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        text = text.replace(" ", SPACE)
        if text and self.prefix:
            text = SPACE + text
        cuts = self.cuts.findall(text) if self.cuts else [text] * bool(text)
        kept, cut = self.kept, self._cut
        return np.frombuffer(b"".join([kept.get(x) or cut(x) for x in cuts]), dtype=np.int32)

    def decode(self, ids) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_CODERS: dict = {}  # of a worker, by broadcast


def _coder(shared) -> Coder:
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) is not None else shared._path
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(shared.value)
    return _CODERS[key]


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, decoded: bool = True) -> DataFrame:
    """Adds pieces array<int>, and with `decoded` the text that they give back, to every row."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    names = [c for c in docs.columns if c not in ("pieces", "decoded")]
    docs = docs.select(*names)
    schema = T.StructType([*docs.schema.fields, T.StructField("pieces", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(text_col).to_pylist()
                ids = [None if x is None else coder.encode(x) for x in texts]
                ends = np.cumsum([0] + [0 if x is None else len(x) for x in ids]).astype(np.int32)
                flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
                null = pa.array([x is None for x in ids])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=null)
                added = [lists] + [pa.array([None if x is None else coder.decode(x.tolist()) for x in ids], pa.string())] * decoded
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [f.name for f in schema])

    return docs.mapInArrow(run, schema)
