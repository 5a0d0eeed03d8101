"""The operators that run Python on executors, against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import itertools
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from swathline.llm import common, embeddings, html_text, language, minhash, ngram, pieces, tokens, warc

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPLIT = re.compile("[^\x20\x09-\x0d]+")


def toks(text):
    return SPLIT.findall((text or "").translate(AZ))


# --- components ------------------------------------------------------------------------------------------------


def closure(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components(spark):
    r = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(30)] + [(7, 7)]
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == closure([p for p in pairs if p[0] != p[1]])
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- archives --------------------------------------------------------------------------------------------------


def test_warc(spark):
    big, small = "<p>" + "é" * 600, "<p>tiny"
    pages = [(1, "http://a/\n x", big), (2, None, big), (5, "http://b", big), (3, "u", small), (4, "u", small), (6, "u", None), (None, "n", big), (7, "", ""), (3, "u", small)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as file", "1 as offset").repartition(3)
    index = warc.write_archive(df)
    got = sorted((tuple(r) for r in warc.read_archive(index, index._warc_root).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert len(got) == len(pages)
    by = {}
    for r in got:
        by.setdefault(r[0], r)
    sha = lambda x: hashlib.sha1((x or "").encode()).hexdigest()
    for i, _, h in pages:
        r = by[i]
        assert (r[2], r[3]) == (len((h or "").encode()), sha(h)) and r[1] == next(u for j, u, _ in pages if j == i)
        revisit = h == big and i != 5
        assert (r[4], r[5]) == (("revisit", 5) if revisit else ("response", None))
        assert r[6] == (None if revisit else (h or "").encode())
    one = index.where("page_id = 4")
    assert [r["page_id"] for r in warc.read_archive(one, index._warc_root).collect()] == [4]
    assert warc.write_archive(df.limit(0)).count() == 0


def test_warc_record_is_standard():
    raw = warc._record(1, "http://x/", b"body", 4, hashlib.sha1(b"body").hexdigest(), None)
    import gzip

    text = gzip.decompress(raw).decode()
    head = dict(line.split(": ", 1) for line in text.split("\r\n\r\n")[0].split("\r\n")[1:])
    assert text.startswith("WARC/1.1\r\n") and text.endswith("body\r\n\r\n") and head["WARC-Type"] == "response"
    assert head["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    with pytest.raises(ValueError):
        warc._parse(warc._record(1, None, b"other", 5, hashlib.sha1(b"body").hexdigest(), None))


# --- main text -------------------------------------------------------------------------------------------------


def test_min_cut_brute_force():
    r = random.Random(8)
    for _ in range(60):
        n = r.randint(1, 7)
        costs = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, r.uniform(0, 2)) for a in range(n) for b in range(a) if r.random() < 0.5]
        price = lambda x: sum(c for c, k in zip(costs, x) if c > 0 and not k) + sum(-c for c, k in zip(costs, x) if c < 0 and k) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: B023, B905, E731
        got = html_text.min_cut(costs, edges)
        assert price(got) == pytest.approx(min(price(x) for x in itertools.product([False, True], repeat=n)))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies &amp; more</div><article><h1>Title&nbsp;one</h1><p>First <b>para</b>graph &lt;here&gt;.<p>Second
  one<br>with break<script>var a="</p>";</script><div class="ad">Buy!</div><form><label>Mail</label><button>Send</button></form>
<p>Third.</p></article><div id="comments"><p>I liked this text very much, thanks for writing all of it down here.</p></div>
<aside>Related</aside><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title one First paragraph <here>. Second one with break Third."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("<p>" * 3000 + "deep text that is long enough to stand alone as content, with words") != ""
    assert html_text.main_text("<article><p>a < b and c > d</p><!-- x --></article>") == "a < b and c > d"


def test_raw_elements_end_at_their_end_tag():
    for raw in ("<script>for(i=0;i<n;i++){f(i)}</script>", '<script>s="<!--"</script>', "<STYLE>a<b{}</Style >", "<script>if(a<b)c='\"</script>", "<svg><script>i<n;</script><!-- </svg> --><text>no</text></svg>", "<title>a <b</title>"):
        page = f"<html><body>{raw}<article><p>The article's first words stay.</p></article></body></html>"
        assert [b["text"] for b in html_text.blocks(page)] == ["The article's first words stay."], raw
    assert html_text.blocks("<p>before</p><script>i<n;") == html_text.blocks("<p>before</p>")


def test_stray_quotes():
    text = lambda page: [b["text"] for b in html_text.blocks(page)]
    assert html_text.main_text('<article><p class="a"">Hello world here</p><p class="b">Second para</p></article>') == "Hello world here Second para"
    assert text('<p>one <img alt="x>two three</p>') == ["one two three"]
    assert text("<p title=a'b>it's</p><p data-x='a>b' \"c>d</p>") == ["it's", "d"]
    assert text('<p class="x" ' + 'a="1" ' * 50000 + "no end") == [] and text("<p <b>x</b") == ["x"]
    assert text("<!-->a<!-- b -->c<!DOCTYPE x>d") == ["acd"]


LONG = "A paragraph that is long enough, with several words and a full stop at its end, to be told as content by itself. A second sentence makes it longer, and a third part of it longer still, as articles have them."
OPEN = [  # pages whose elements have no telling names, with their main text
    (f"<div><h2>Its title</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><div><a href=1>More</a> <a href=2>Links</a></div>", f"Its title {LONG} Yes. {LONG}"),
    (f"<div><div><a href=1>Home</a></div><div><p>{LONG}</p><p>No</p><p>Never</p><p>{LONG}</p></div><div>© 2020 Us</div></div>", f"{LONG} No Never {LONG}"),
    (f"<article><p>{LONG}</p><p><a href=x>A link alone</a></p><div class=ad>Buy this now!</div><p>End</p></article><footer>{LONG}</footer>", f"{LONG} A link alone End"),
]


def test_cut_decides():
    fitted = html_text.model()
    alone = (fitted[0], 0.0, 0.0)  # the classifier without edges
    for page, want in OPEN:
        assert html_text.main_text(page) == want
    assert [html_text.main_text(page, alone) != want for page, want in OPEN] == [True, True, False]
    pages = html_text.examples(150, 5)  # other than those of the fit
    right = lambda f: sum(a == b for found, kept in pages for a, b in zip(html_text.labels(found, f), kept, strict=True)) / sum(len(kept) for _, kept in pages)
    assert right(fitted) > 0.97 and right(fitted) > right(alone) + 0.005


def test_main_text_rows(spark):
    rows = [(1, "u", PAGE), (None, None, None), (1, "u", PAGE), (2, "v", "")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text")).collect()
    assert len(got) == 4 and sorted((r["n_chars"], r["text"] == "") for r in got) == [(0, True), (0, True), (62, False), (62, False)]


# --- pieces ----------------------------------------------------------------------------------------------------

needs_vocabulary = pytest.mark.skipif(not os.path.exists(pieces.VOCABULARY), reason="no vocabulary")
TEXTS = ["", " ", "  two  spaces ", "Hello, world!\n\n\ttabs", "日本語 text 😀 \u0000", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 3000, "ab" * 700 + "c", "naïve Ærøskøbing", "1234567890" * 30, "=" * 200, "the of and " * 400]


@needs_vocabulary
def test_pieces_equal_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    coder = pieces.Coder(pieces.load())
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("abcdehilnorst  .é\n▂😀") for _ in range(r.randint(1, 80))) for _ in range(400)]
    for t in texts:
        ids = coder.encode(t).tolist()
        assert ids == sp.encode(t), t
        assert coder.decode(ids) == t


@needs_vocabulary
def test_pieces_rows(spark):
    rows = [(1, TEXTS[3]), (None, None), (1, TEXTS[3]), (2, ""), (3, "a▁b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as pieces")
    got = pieces.encode(df).collect()
    assert len(got) == 5
    for r in got:
        assert (r["pieces"] is None, r["decoded"] is None) == (r["text"] is None,) * 2
        assert r["text"] is None or r["decoded"] == r["text"].replace("▁", " ")
    assert pieces.encode(df.limit(0)).count() == 0


def test_unigram_paths():
    vocabulary = {p: s for p, s in [("a", -1.0), ("b", -1.2), ("ab", -1.9), ("ba", -2.5), ("aba", -2.6), ("bb", -9.0), ("abab", -4.9)]}
    names = ["<unk>", *vocabulary]
    coder = pieces.Coder({"pieces": names, "scores": [0.0, *vocabulary.values()], "bytes": {}, "unknown": 0, "special": [0], "bpe": False, "prefix": False, "trim": False})

    def best(t):
        if not t:
            return 0.0
        return max(vocabulary[t[:k]] + best(t[k:]) for k in range(1, len(t) + 1) if t[:k] in vocabulary)

    for n in range(1, 8):
        for t in map("".join, itertools.product("ab", repeat=n)):
            ids = coder.encode(t).tolist()
            assert "".join(names[i] for i in ids) == t and sum(vocabulary[names[i]] for i in ids) == pytest.approx(best(t))
    assert coder.encode("axb").tolist() == [1, 0, 2]


# --- language --------------------------------------------------------------------------------------------------


def invented(r, lang):
    syllables = {"aa": ["ka", "to", "mi", "sen"], "bb": ["sch", "rund", "ein", "ver"], "cc": ["eau", "oir", "que", "ment"]}[lang]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(8, 60)))


def test_language(spark):
    r = random.Random(2)
    rows = [(i, invented(r, lang), lang) for i, lang in enumerate(r.choice(["aa", "bb", "cc"]) for _ in range(400))]
    df = spark.createDataFrame([*rows, (None, None, "aa"), (401, "12 34 !", None), (402, "", "bb")], "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id % 4 <> 2"), df["text"], df["lang"], df["doc_id"])
    got = {x["doc_id"]: x for x in language.identify(df.selectExpr("*", "1 as score"), model).collect()}
    held = [x for i, x in got.items() if i is not None and i < 400 and i % 4 == 2]
    assert sum(x["lang_pred"] == x["lang"] for x in held) >= 0.97 * len(held)
    assert not any(x["rejected"] for x in held) and all(0 <= x["score"] <= 1 for x in got.values())
    for i in (None, 401, 402):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    none = language.fit(df.where("false"), df["text"], df["lang"], df["doc_id"])
    assert language.predict(none, "words") == ("und", 0.0)
    long = language.predict(model, invented(r, "bb") * 3000)
    assert long[0] == "bb"


def test_least_score_is_calibrated():
    r = random.Random(4)
    labels = [r.choice(["aa", "bb"]) for _ in range(400)]
    model = language.train([invented(r, x) for x in labels], labels)
    assert model["least"] > 0.5  # the top score of two languages is never lower, so a lower threshold rejects nothing


def test_letters_are_letters():
    for text in ("½ ²", "①", "12 34 !", "٣", "_", "Ⅷ"):
        assert not language.has_letter(text)
    assert language.has_letter("½ a") and language.has_letter("日") and language.has_letter("ʰ")


def test_language_forward_pass():
    """predict() against the same sums one n-gram at a time."""
    r = random.Random(7)
    labels = [r.choice(["aa", "bb", "cc"]) for _ in range(60)]
    model = language.train([invented(r, x) for x in labels], labels)
    for text in [invented(r, "aa"), "Öl ÄÖÜ 日本", "a", "x" * 500, invented(r, "cc").upper()]:
        raw = f" {text} ".encode().lower()  # A-Z only
        total, n = np.zeros(3), 0
        for size in (3, 4):
            for at in range(len(raw) - size + 1):
                h = size
                for c in raw[at : at + size]:
                    h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
                    h ^= h >> 15
                total += model["weights"][h % language.BUCKETS].astype(float)
                n += 1
        z = (model["bias"] + total / n) / model["temperature"]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        got = language.predict(model, text)
        assert got[0] == model["labels"][int(p.argmax())] and got[1] == pytest.approx(p.max(), abs=1e-6)


# --- near duplicates -------------------------------------------------------------------------------------------


def shingle(text):
    w = toks(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def corpus(r):
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    docs, passage = [], [word() for _ in range(50)]
    for _ in range(25):
        base = [word() for _ in range(r.randint(5, 120))]
        docs.append(base)
        for _ in range(r.choice([0, 0, 1, 3, 9])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 5])):
                copy[r.randrange(len(copy))] = word()
            docs.append(copy)
    docs += [[word() for _ in range(r.randint(0, 60))] + passage for _ in range(30)]
    base = [word() for _ in range(80)]
    for _ in range(60):  # a large group of different near copies
        copy = list(base)
        copy[r.randrange(80)] = word()
        docs.append(copy)
    return [" ".join(x) for x in docs] + ["one two", "ONE two", "a", None, "", "  "]


def test_near_duplicates(spark):
    texts = corpus(random.Random(6))
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([*rows, (None, "one two")], "doc_id long, text string").selectExpr("*", "1 as c", "2 as component_id", "3 as n")
    got = {x["doc_id"]: x for x in minhash.near_duplicates(df).collect()}
    sets = [shingle(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    up = closure(links)
    for i in range(len(texts)):
        want = up.get(i, i)
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want, want == i)
    assert (got[None]["component_id"], got[None]["kept"]) == (None, True)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_near_copies_of_common_passages(spark):
    r = random.Random(8)
    value = lambda n: [r.getrandbits(62) for _ in range(n)]
    rows = []
    for _ in range(3):  # two near copies whose values many other classes hold, a third of them each
        passages = [value(11), value(11), value(10)]
        base = sum(passages, [])
        rows += [base, base[:31] + value(1)] + [p + value(32 - len(p)) for p in passages for _ in range(500)]
    classes = spark.createDataFrame([(i, 600, sorted(x)) for i, x in enumerate(rows)], "c long, n long, sketch array<long>")
    got = closure([(x["a"], x["b"]) for x in minhash.proposals(classes).collect()])
    assert all(i in got and got[i] == got.get(i + 1) for i in (0, 1502, 3004))


def test_estimates():
    r = np.random.default_rng(4)
    for _ in range(200):
        k, whole = 8, np.unique(r.integers(0, 30, 24))
        a, b = (np.unique(r.choice(whole, r.integers(1, len(whole)))) for _ in range(2))
        u = sorted({*a[:k], *b[:k]})
        u = u if len(a) <= k and len(b) <= k else u[:k]
        want = len({*a[:k]} & {*b[:k]} & {*u}) / len(u)
        near = want >= 0.75 - 5 * math.sqrt(0.75 * 0.25 / len(u)) and min(len(a), len(b)) >= 0.75 * max(len(a), len(b))
        fill = lambda x: np.array([[*x[:k], *[np.iinfo(np.int64).max] * (k - len(x[:k]))]])
        assert minhash.estimates(fill(a), fill(b), np.array([len(a)]), np.array([len(b)]), k)[0] == pytest.approx(want if near else -1)


def test_small_families_are_compared(spark):
    r = random.Random(3)
    a, r1 = [r.randbytes(3).hex() for _ in range(100)], [r.randbytes(3).hex() for _ in range(50)]
    texts = spark.createDataFrame([(1, " ".join(a)), (2, " ".join([*a[:99], "x"])), (3, " ".join(a[:50] + r1))], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 3), (2, 3)], "a long, b long")  # near copies that only met a third document
    none = spark.createDataFrame([], "node long, component long")
    assert [sorted(x) for x in minhash.remaining_links(pairs, none, texts).collect()] == [[1, 2]]


# --- scores ----------------------------------------------------------------------------------------------------


def test_token_hashes():
    import pyarrow as pa

    r = random.Random(3)
    texts = ["", None, "A b", "  ", "É é a" + "z" * 200] + ["".join(r.choice("aAb é\n\t😀") for _ in range(r.randint(0, 40))) for _ in range(300)]
    seen = {}
    for size in (1, 50, 10**6):
        at = 0
        for raw, rows in tokens.slices(pa.array(texts), size):
            got, counts = tokens.hashes(raw, rows, end=True)
            ends = np.cumsum(counts)
            for k, n in enumerate(counts):
                w = toks(texts[at + k])
                assert n == len(w) + 1 and got[ends[k] - 1] == tokens.END
                for x, h in zip(w, got[ends[k] - n : ends[k] - 1], strict=True):
                    assert seen.setdefault(x, int(h)) == int(h)
            at += len(counts)
        assert at == len(texts)
    assert len(set(seen.values())) == len(seen)


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (300, 200), (5000, 10**9), (4000, 4001), (700, 2**45)):
        x = np.sort(r.integers(0, top, n))
        e = ngram.EliasFano.of(ngram.EliasFano.build(x))
        if n:
            assert (e.get(np.arange(n)) == x).all()
        asked = np.concatenate([x, r.integers(0, top, 200), [top, top + 10**6]])
        found = e.find(asked)
        want = np.isin(asked, x)
        assert ((found >= 0) == want).all() and (x[found[found >= 0]] == asked[found >= 0]).all()


def test_scores(spark):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcde") for _ in range(r.randint(1, 4))) for _ in range(60)]
    texts = [(i, " ".join(r.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=r.randint(0, 80))).title()) for i in range(120)] + [(120, None), (121, ""), (122, "never seen words"), (None, "a b"), (5, "repeated id")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as id", "2 as score")
    model = ngram.train(ngram.training(df))
    got = ngram.score(df, model).collect()
    import zlib

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    ones, twos = Counter(), Counter()
    for i, t in texts:
        if not held(i):
            w = [*toks(t), None]
            ones.update(w)
            twos.update(zip(w, w[1:], strict=False))
    total, known = sum(ones.values()), len(ones)
    assert model["words"][2] == total
    p1 = lambda w: (ones[w] + 0.5) / (total + 0.5 * (known + 1))
    p2 = lambda c, w: (twos[c, w] + ngram.PRIOR * p1(w)) / (ones[c] + ngram.PRIOR)
    want = []
    for i, t in texts:
        w = [*toks(t), None]
        want.append((i, len(w), sum(ones[x] > 0 for x in w), sum(math.log10(p1(x)) for x in w), math.log10(p1(w[0])) + sum(math.log10(p2(c, x)) for c, x in zip(w, w[1:], strict=False))))
    key = lambda x: (x[0] is None, x[0] or 0, x[1], round(x[3], 6))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-9)
        assert g[4] == pytest.approx(w[4], abs=0.012 * w[1])  # half a quantum a token
    none = ngram.train(df.where("false"))
    assert {tuple(x)[2:] for x in ngram.score(df, none).collect()} == {(0, 0.0, 0.0)}


def test_scorer_lets_shards_go(spark, monkeypatch):
    """The same scores with shards read whole, as from an object store, and hardly any of them kept."""
    r = random.Random(3)
    texts = [(i, " ".join(r.choice("abcdefghij") * r.randint(1, 9) for _ in range(40))) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = ngram.train(docs)
    import pyarrow as pa

    batch = [(tokens.hashes(raw, rows, end=True)) for raw, rows in tokens.slices(pa.array([t for _, t in texts]), 500)]
    want = [ngram.Scorer(model).score(*x) for x in batch]
    plain = ngram.Scorer(model)
    monkeypatch.setattr(ngram, "HELD", 1)
    monkeypatch.setattr(ngram, "urlparse", lambda root: type("At", (), {"scheme": "store", "path": ""}))
    few = ngram.Scorer(model)
    for x, w in zip(batch, want, strict=True):
        for got in (plain.score(*x), few.score(*x)):
            assert all(np.array_equal(a, b) for a, b in zip(got, w, strict=True))
        assert len(few.held.shards) <= 1 and len(few.words.held.shards) <= 1
    assert len(set(model["pairs"].values())) > 1


# --- vectors ---------------------------------------------------------------------------------------------------


def test_vectors(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(80, 64))
    rows = [(i, [float(v) for v in x], i % 3) for i, x in enumerate(base)]
    for k in range(160):
        i = int(r.integers(0, 60))
        x = base[i] + r.normal(size=64) * r.choice([0.0, 0.05, 0.15, 0.3, 0.38])
        rows.append((100 + k, [float(v) for v in x], i % 3 if k % 7 else None))
    rows += [(500, None, 1), (501, [0.0] * 64, 1), (502, [float("nan")] + [1.0] * 63, 1), (503, [None] + [1.0] * 63, 1), (504, [1.0, 2.0], 1), (None, rows[0][1], 0), (505, [float("inf")] * 64, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as c", "2 as v")
    got = {x["vec_id"]: x for x in embeddings.near_vectors(df).collect()}
    fine = [(i, np.array(v, dtype=np.float32).astype(float), lab) for i, v, lab in rows if v and lab is not None and i not in (501, 502, 503, 505)]
    n, links = Counter(), []
    for (i, x, a), (j, y, b) in itertools.combinations(fine, 2):
        if a == b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
            n[i] += 1
            n[j] += 1
            links.append((i, j))
    found, all_ = sum(got[i]["n_links"] for i in got), sum(n.values())
    assert all(got[i]["n_links"] <= n[i] for i in got) and found >= 0.9 * all_ and all_ > 50
    if found == all_:
        up = closure([p for p in links if None not in p])
        assert all(got[i]["component_id"] == up.get(i, i) for i in got if i is not None)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (500, 501, 502, 503, 504, 505))
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_rotation_balances_bits():
    r = np.random.default_rng(3)
    x = r.normal(size=(2000, 64)) * np.linspace(3, 0.2, 64)
    p = embeddings.learn(x)
    assert p.shape == (64, 64) and np.allclose(p.T @ p, np.eye(64), atol=1e-8)
    assert np.abs((x @ p >= 0).mean(0) - 0.5).max() < 0.1
    assert embeddings.learn(np.zeros((0, 64))).shape == (0, 64) and embeddings.learn(r.normal(size=(1, 5))).shape == (5, 64)
