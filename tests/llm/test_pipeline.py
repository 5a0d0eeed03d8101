"""The pipeline's stages on a small corpus, and the registered queries."""

import os

import pytest

import __spark_entry__
import corpus_pipeline
from swathline.llm import pieces, queries

SF = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not (os.path.isdir(SF) and os.path.exists(pieces.VOCABULARY)), reason="no test data")


def test_registered():
    named = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in named} and "pipeline" in named
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "pieces"]


@needs
def test_pipeline(spark):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    columns, docs, seen = first.columns, first, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.selectExpr("*", "1 as n_words"), SF)
        if name != "pieces":
            assert out.columns == columns
        rows = out.collect()
        seen.append((name, len(rows)))
        docs = spark.createDataFrame(rows, out.schema)
        assert len({r["doc_id"] for r in rows}) == len(rows)
    counts = dict(seen)
    assert 200 * 0.97 <= counts["language"] <= 200 and counts["near_duplicates"] < counts["language"]
    assert counts["personal_data"] == counts["decontamination"] == counts["pieces"]
    assert all(r["round_trip"] for r in docs.collect())


@needs
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    rel = con.sql(queries.SQL[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r) for r in df.select(*rel.columns).collect()), key=key) == sorted(rel.fetchall(), key=key)


@needs
def test_stages_against_brute_force(spark):
    """Each stage on all that the one before kept, against plain Python on the same rows."""
    import itertools
    import re

    import sentencepiece

    from swathline.llm import language, pii

    az = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first = spark.read.parquet(f"{SF}/documents.parquet")
    model = queries.language_model(first)
    docs = {r["doc_id"]: r["text"] for r in first.collect()}
    stages = dict(corpus_pipeline.STAGES)

    def staged(name, texts):
        df = first.where(first["doc_id"].isin(list(texts))).drop("text").join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id")
        return {r["doc_id"]: r for r in stages[name](spark, df.select(*first.columns), SF).collect()}

    # the model is the query's own on the same table; the decision is remade row by row
    got = staged("language", docs)
    want = {i for i, t in docs.items() for label, score in [language.predict(model, t)] if label != "und" and score >= model["least"]}
    assert set(got) == want
    docs = {i: docs[i] for i in want}

    sets = {}
    for i, t in docs.items():
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(az))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    want = {i for i in sets if root(i) == i}
    assert set(staged("near_duplicates", docs)) == want and len(want) < len(docs)
    docs = {i: docs[i] for i in want}

    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(az))
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        for n in [min(10, len(w))] if w else []:
            windows.setdefault(n, set()).update(tuple(w[s : s + n]) for s in range(len(w) - n + 1))
    clean = lambda w: not any(tuple(w[s : s + n]) in held for n, held in windows.items() for s in range(len(w) - n + 1))
    want = {i for i, t in docs.items() if clean(words(t))}
    assert set(staged("decontamination", docs)) == want and len(want) < len(docs)
    docs = {i: docs[i] for i in want}

    got = staged("personal_data", docs)
    found = pii.find_pii(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    for r in found.collect():
        text, out, at = r["text"], "", 0
        for s in sorted(r["_spans"], key=lambda s: (s["s"], s["e"], s["kind"])):
            if s["s"] >= at:
                out += text[at : s["s"]] + f"[{pii.KINDS[s['kind']].upper()}]"
            at = max(at, s["e"])
        want = out + text[at:] if text is not None else None
        assert (got[r["doc_id"]]["text"], got[r["doc_id"]]["n_chars"]) == (want, len(want) if want is not None else None)
    docs = {i: got[i]["text"] for i in docs}

    coder = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    got = staged("pieces", docs)
    assert set(got) == set(docs)
    assert all(got[i]["n_pieces"] == len(coder.encode(t or "")) and got[i]["round_trip"] for i, t in docs.items())
