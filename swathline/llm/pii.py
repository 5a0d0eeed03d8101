"""Personal data by candidate gradient boosting, in DataFrame operations only.

High-recall patterns propose spans.  Four base kinds are decided by their fixed rules; further kinds
(secret, iban, ssn, and phone numbers without a country code) are scored by boosted trees over format
and context features, and kept above a threshold per kind calibrated on held-out examples.  The trees
are trained on a bounded set of generated examples (EXAMPLES, seeded) with numpy on the driver and
compiled into CASE expressions, so texts never leave the JVM and no row is shuffled.

Null and empty texts have no spans.  Repeated rows, null ids and extra columns are independent of each
other: each input row gives one output row.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in order, as patterns.  Possessive repeats match what the plain ones do
# (nothing that follows could use what they would give back) and don't recurse on long runs.  A run that doesn't match
# from its first character, or from where the last match ended (\G), doesn't match from a later one either, so no
# other start is tried: time stays in proportion to the text.
BASE = [
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
# Candidate generators of the kinds that the trees decide.
PROPOSED = [
    ("phone", r"(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}"),
    ("secret", r"[A-Za-z0-9_/+=-]{20,}+"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
]
KINDS = ["email", "ip", "card", "phone", "secret", "iban", "ssn"]
GUARD = {"email": "@", "phone": "+"}  # a literal that every base match holds
CONTEXT = 32  # code points before a candidate that its features see
BLOCK, CHUNK = 256, 4096  # elements of an array that grows by one, code points of a long text's parts
CUES = {
    "cue_secret": r"(?i)(?:token|secret|password|passwd|api.?key|key|bearer)[^A-Za-z0-9]*$",
    "cue_bank": r"(?i)(?:iban|account|konto|bank)[^A-Za-z0-9]*$",
    "cue_ssn": r"(?i)(?:ssn|social|security)[^A-Za-z0-9]*(?:number|no)?[^A-Za-z0-9]*$",
    "cue_phone": r"(?i)(?:phone|tel|call|mobile|fax)[^A-Za-z0-9]*$",
}
FEATURES = ["kind", "length", "digits", "uppers", "lowers", "hexes", "marks", "inside", *CUES]
EXAMPLES, TREES, RATE, PRECISION = 4000, 24, 0.3, 0.99


def let(value: Column, body) -> Column:
    """body(value), with the value evaluated once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op) -> Column:
    """The running totals of a non-empty array under an associative op.  Arrays that grow by one element are copied each
    time, so none grows beyond BLOCK elements, or one for each block."""
    last = lambda x: F.element_at(x, -1)
    within = lambda x: F.aggregate(F.slice(x, 2, BLOCK), F.array(x[0]), lambda acc, v: F.array_append(acc, op(last(acc), v)))
    heads = lambda y: F.aggregate(F.slice(y, 2, F.size(y)), F.array(last(y[0])), lambda acc, x: F.array_append(acc, op(last(acc), last(x))))
    joined = lambda y, h: F.flatten(F.transform(y, lambda x, k: F.when(k == 0, x).otherwise(F.transform(x, lambda v: op(h[k - 1], v)))))
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: within(F.slice(v, b * BLOCK + 1, BLOCK)))
    return let(values, lambda v: let(blocks(v), lambda y: let(heads(y), lambda h: joined(y, h))))


def matches(found: Column, pieces: Column, context: bool = False) -> Column:
    """Spans of all matches as array<struct<s, e, m>>, in code points: pieces are what lies between them.  With context
    also the CONTEXT code points before a match (no match of that kind is shorter than a third of it) and the one after."""
    size = lambda c: F.char_length(c)
    plus = lambda a, b: a + b

    def span(end: Column, i: Column) -> Column:
        cols = [(end - size(found[i])).alias("s"), end.alias("e"), found[i].alias("m")]
        if context:
            left = lambda x: F.substring(x, 1, 1)
            near = [F.get(x, i - k) for k in (3, 2, 1) for x in (pieces, found)]
            after = F.coalesce(F.nullif(left(pieces[i + 1]), F.lit("")), left(F.get(found, i + 1)), F.lit(""))
            cols += [F.right(F.concat_ws("", *near, pieces[i]), F.lit(CONTEXT)).alias("before"), after.alias("after")]
        return F.struct(*cols)

    sizes = F.transform(found, lambda m, i: size(pieces[i]) + size(m))
    kind = "array<struct<s:int,e:int,m:string" + (",before:string,after:string" if context else "") + ">>"
    return F.when(F.size(found) > 0, F.transform(running(sizes, plus), span)).otherwise(F.expr(f"cast(array() as {kind})"))


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        d = F.split(F.reverse(digits), "(?<=.)(?=.)")
        twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        at = F.transform(d, lambda x, i: F.when(i % 2 == 1, twice(x.cast("int"))).otherwise(x.cast("int")))
        return F.when(F.length(digits).between(13, 19), F.aggregate(at, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(False)
    return F.lit(True)


def _share(m: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(m, f"[^{chars}]", "")) / F.length(m)


def _features(kind: int, m: Column, before: Column, after: Column) -> Column:
    cols = [
        F.lit(float(kind)), F.length(m).cast("double"), _share(m, "0-9"), _share(m, "A-Z"), _share(m, "a-z"), _share(m, "0-9a-f"),
        _share(m, r" ()._/+=-"), (before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]")).cast("double"),
    ]
    cols += [before.rlike(p).cast("double") for p in CUES.values()]
    return F.array(*cols)


def _features_of(kind: int, m: str, before: str, after: str) -> list[float]:
    """The same features in Python, for the generated examples."""
    share = lambda chars: len(re.findall(f"[{chars}]", m)) / len(m)
    inside = bool(re.search("[A-Za-z0-9]$", before) or re.search("^[A-Za-z0-9]", after))
    row = [kind, len(m), share("0-9"), share("A-Z"), share("a-z"), share("0-9a-f"), share(r" ()._/+=-"), inside]
    return [float(x) for x in row + [bool(re.search(p, before)) for p in CUES.values()]]


def _examples(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Generated candidates with their labels: private data in its usual places, and look-alikes."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    digit, lower, upper, hexa = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
    plain = ["see the ", "and ", "of ", "in part ", "", "no. ", "page ", "the file "]
    rows, labels = [], []
    for _ in range(n):
        kind, good = r.randrange(len(PROPOSED)), r.random() < 0.5
        after = r.choice([" ", ".", '"', ",", ""])
        if kind == 0:
            m = f"({pick(digit, 3)}) {pick(digit, 3)}-{pick(digit, 4)}" if r.random() < 0.5 else "-".join((pick(digit, 3), pick(digit, 3), pick(digit, 4)))
            before = r.choice(["call ", "tel: ", "phone ", "mobile: ", "fax: "]) if good else r.choice(plain)
            after = after if good or r.random() < 0.5 else pick(digit, 2)
        elif kind == 1:
            if good:
                m, before = r.choice([pick(hexa, r.choice([32, 40, 64])), pick(lower + upper + digit, r.randint(24, 48))]), r.choice(['token = "', "api_key=", "secret: ", "password: ", "Bearer ", "key: "])
            else:
                m = r.choice([pick(lower, r.randint(20, 40)), pick("-=_", r.randint(20, 60)), "-".join(pick(lower, r.randint(3, 9)) for _ in range(5)), "/".join(pick(lower, r.randint(3, 9)) for _ in range(5)), pick(digit, 24), pick(upper, 22)])
                before = r.choice([*plain, "key: ", "token "]) if r.random() < 0.2 else r.choice(plain)
        elif kind == 2:
            if good:
                m = pick(upper, 2) + pick(digit, r.choice([14, 16, 18, 20]))
                m = " ".join(m[i : i + 4] for i in range(0, len(m), 4)) if r.random() < 0.5 else m
                before = r.choice(["IBAN ", "IBAN: ", "account ", "Konto: ", "bank ", "pay to ", ""])
            else:
                m, before = pick(upper, 2) + pick(digit, 2) + pick(upper, r.choice([12, 16])), r.choice(plain)
        else:
            m = f"{pick(digit, 3)}-{pick(digit, 2)}-{pick(digit, 4)}"
            before = r.choice(["SSN ", "SSN: ", "social security number ", "ssn "]) if good else r.choice(plain)
        rows.append(_features_of(kind, m, before, after))
        labels.append(float(good))
    return np.array(rows), np.array(labels)


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
    """A regression tree of the second-order boosting objective: (feature, cut, left, right) or a leaf value."""
    g, h = grad.sum(), hess.sum() + 1.0
    best, gain = None, 1e-6
    if depth:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in np.unique(np.quantile((values[1:] + values[:-1]) / 2, np.linspace(0, 1, 16), method="nearest")) if len(values) > 1 else []:
                left = x[:, f] <= cut
                gl, hl = grad[left].sum(), hess[left].sum() + 1.0
                gr, hr = g - gl, h - hl + 1.0
                won = gl * gl / hl + gr * gr / hr - g * g / h
                if won > gain:
                    best, gain = (f, float(cut)), won
    if best is None:
        return float(round(-RATE * g / h, 6))
    f, cut = best
    left = x[:, f] <= cut
    return f, cut, _tree(x[left], grad[left], hess[left], depth - 1), _tree(x[~left], grad[~left], hess[~left], depth - 1)


def _value(tree, row) -> float:
    while not isinstance(tree, float):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@functools.cache
def model() -> tuple[list, list[float]]:
    """Boosted trees and, per proposed kind, the least margin at which held-out examples reach PRECISION."""
    x, y = _examples(EXAMPLES)
    fit = np.arange(len(y)) % 4 != 0
    trees, margin = [], np.zeros(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin[fit]))
        trees.append(_tree(x[fit], p - y[fit], p * (1 - p), 3))
        margin += np.array([_value(trees[-1], row) for row in x])
    cuts = []
    for kind in range(len(PROPOSED)):
        held = ~fit & (x[:, 0] == kind)
        order = np.argsort(-margin[held])
        precision = np.cumsum(y[held][order]) / np.arange(1, held.sum() + 1)
        fine = np.flatnonzero(precision >= PRECISION)
        cut = margin[held][order][fine[-1]] if len(fine) else np.inf
        cuts.append(float(round(max(cut, 0.0), 6)))
    return trees, cuts


def _compiled(tree, f: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    return F.when(f[tree[0]] <= tree[1], _compiled(tree[2], f)).otherwise(_compiled(tree[3], f))


def _zipped(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others.  In one order of the others' starts and the spans' ends (an end first
    where they are equal), a span overlaps one if the largest end of those before its own end lies beyond its start."""
    mark = lambda at, kind, end, x: F.struct(at.alias("at"), F.lit(kind).alias("kind"), end.alias("end"), x.alias("x"))
    queries = F.transform(spans, lambda x: mark(x["e"], 0, F.lit(-1), x))
    events = F.array_sort(F.concat(queries, F.transform(others, lambda o: mark(o["s"], 1, o["e"], F.lit(None)))))

    def free(ev: Column) -> Column:
        far = running(F.transform(ev, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        both = F.filter(_zipped(ev, far), lambda z: (z["a"]["kind"] == 0) & (z["b"] <= z["a"]["x"]["s"]))
        return F.transform(both, lambda z: z["a"]["x"])

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), let(events, free)).otherwise(spans)


def _likelier(spans: Column) -> Column:
    """Of each two overlapping spans (s, e, kind, p) of different kinds only the likelier (then the earlier, then the
    earlier kind), as codes.  Spans of one kind don't overlap, so a span's start lies in at most one of each kind; these
    are all pairs, since of two that overlap one starts inside the other."""
    code = lambda x: F.shiftleft(x["s"].cast("long"), 33).bitwiseOR(F.shiftleft(x["e"].cast("long"), 2)).bitwiseOR(x["n"].cast("long"))
    better = lambda a, b: F.struct(-a["p"], a["s"], a["n"]) < F.struct(-b["p"], b["s"], b["n"])

    def kept(x: Column) -> Column:
        lost = []
        for n in range(len(PROPOSED)):
            last = running(F.transform(x, lambda z: F.when(z["n"] == n, z)), lambda a, b: F.greatest(a, b))  # noqa: B023
            pairs = F.filter(_zipped(x, last), lambda z: (z["a"]["n"] != n) & z["b"].isNotNull() & (z["b"]["e"] > z["a"]["s"]))  # noqa: B023
            lost.append(F.transform(pairs, lambda z: F.when(better(z["a"], z["b"]), code(z["b"])).otherwise(code(z["a"]))))
        return F.array_except(F.transform(x, code), F.concat(*lost))

    return let(F.array_sort(spans), kept)


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds _base and _spans (arrays of struct<kind, s, e>, sorted by kind, then start) to every row; columns of those
    names are replaced.

    _base holds the base kinds, _spans these and what the model adds.  Of overlapping additions the
    likelier stays (then the earlier, then the earlier kind); none overlaps a base span."""
    trees, cuts = model()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    named = [(f"b{n}", GUARD.get(k), p) for n, (k, p) in enumerate(BASE)] + [(f"p{n}", None, p) for n, (_, p) in enumerate(PROPOSED)]
    none = F.expr("cast(array() as array<string>)")
    found = {}
    for n, guard, p in named:
        take = F.regexp_extract_all("_text", F.lit(p), F.lit(0))
        found[f"_m{n}"] = F.when(F.contains("_text", F.lit(guard)), take).otherwise(none) if guard else take
    rows = rows.withColumns(found)
    rows = rows.withColumns({f"_s{n}": F.when(F.size(f"_m{n}") > 0, F.split("_text", p, -1)).otherwise(none) for n, _, p in named})
    rows = rows.withColumns({f"_a{n}": matches(F.col(f"_m{n}"), F.col(f"_s{n}"), n[0] == "p") for n, _, _ in named})
    span = lambda k, x: F.struct(F.lit(KINDS.index(k)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
    decided = lambda n, k: F.transform(F.filter(f"_ab{n}", lambda x: _valid(k, x["m"])), lambda x: span(k, x))
    rows = rows.withColumn("_base", F.concat(*(decided(n, k) for n, (k, _) in enumerate(BASE))))

    def scored(n: int) -> Column:
        margin = lambda f: sum((_compiled(t, f) for t in trees[1:]), _compiled(trees[0], f))
        seen = F.transform(F.col(f"_ap{n}"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _features(n, x["m"], x["before"], x["after"]).alias("f")))
        out = F.transform(seen, lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("n"), x["e"].alias("e"), margin(x["f"]).alias("p")))
        return F.filter(out, lambda x: x["p"] >= cuts[n])

    rows = rows.withColumn("_more", F.concat(*(scored(n) for n in range(len(PROPOSED)))))
    rows = rows.withColumn("_free", _apart(F.col("_more"), F.col("_base")))
    kinds = F.array(*(F.lit(KINDS.index(k)) for k, _ in PROPOSED))
    part = lambda c, at, bits: F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    kept = F.transform(_likelier(F.col("_free")), lambda c: F.struct(kinds[part(c, 0, 2)].alias("kind"), part(c, 33, 31).alias("s"), part(c, 2, 31).alias("e")))
    spans = F.when(F.size("_free") > 0, F.sort_array(F.concat("_base", kept))).otherwise(F.col("_base"))
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("_base", "_spans")]
    return rows.select(*own, "_base", spans.alias("_spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by [KIND]; of overlapping spans the first names the gap."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def filled(x: Column, chunks: Column, far: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / CHUNK).cast("int")
            some = F.slice(chunks, first + 1, F.floor(b / CHUNK).cast("int") - first + 1)
            return F.substring(F.array_join(some, ""), a - first * CHUNK + 1, b - a)

        def piece(z: Column, i: Column) -> Column:
            done = F.when(i > 0, far[i - 1]).otherwise(0)  # up to here the text is given out or replaced
            return F.when(z["s"] >= done, F.concat(between(done, z["s"]), names[z["kind"]])).otherwise("")

        whole = (F.size(chunks) - 1) * CHUNK + F.char_length(F.element_at(chunks, -1))
        return F.concat(F.array_join(F.transform(x, piece), ""), between(F.element_at(far, -1), whole))

    # a long text is cut once, so that a piece of it is found without a walk from its start
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    far = lambda x: running(F.transform(x, lambda z: z["e"]), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) > 0, let(ordered, lambda x: let(chunks, lambda c: let(far(x), lambda f: filled(x, c, f))))).otherwise(text)
