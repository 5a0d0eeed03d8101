"""License scans by diagonal voting.

Rolling word k-gram hashes of every text are joined to the positions of the same k-grams in license
templates; hits vote for the diagonal (text position minus template position); neighbouring diagonals
merge into one alignment, which is verified by the share of template k-grams that it covers.

Templates are a fixed list of a few kilobytes, so their hashes are a constant set and their table is
broadcast.  The set is tested inside the text's row, before rows are exploded; only hits are shuffled.

Nulls and empty texts have no words and no hits.  Every row gives one result row: rows equal in id and text are scanned
as one and counted (copies).  A null id is a value like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import indices, words

K = 3
# Base phrases and their labels.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
# Further notices and license bodies, as publicly known.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "spdx license identifier mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-3", "gnu general public license v3"),
    ("gpl-3", "spdx license identifier gpl 3 0"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-2", "gnu general public license v2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd license"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mozilla public license version 2"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc0", "cc0 1 0 universal"),
]


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, is a base phrase, words)."""
    rows = [(label, True, text.split()) for label, text in BASE.items()]
    rows += [(label, False, text.split()) for label, text in NOTICES]
    return [(i, *row) for i, row in enumerate(rows)]


def license_votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text, template and diagonal: (id, text_key, n_words, template, label, base, length,
    diagonal, grams, first, last, copies), grams being the template positions hit.  Every text has one row with a null
    template besides, whose copies are the rows that hold it; elsewhere they are 0."""
    spark = docs.sparkSession
    grams = [
        (t, label, base, len(w), p, *w[p : p + K])
        for t, label, base, w in templates()
        for p in range(len(w) - K + 1)
    ]
    table = spark.createDataFrame(
        grams, "template int, label string, base boolean, length int, at int, g0 string, g1 string, g2 string"
    ).withColumn("gram", F.xxhash64("g0", "g1", "g2"))
    known = sorted({r[0] for r in table.select("gram").collect()})  # bounded by the template list

    w, i = F.col("_w"), F.col("_p")
    hit = lambda at: F.xxhash64(w[at], w[at + 1], w[at + 2])
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), words(F.col(text_col)).alias("_w"))
    rows = rows.select("_id", "_key", "_w", F.filter(indices(F.size("_w") - (K - 1)), lambda p: hit(p).isin(known)).alias("_hits"))
    rows = rows.select("_id", "_key", "_w", F.explode(F.concat(F.array(F.lit(None).cast("int")), "_hits")).alias("_p"))
    rows = rows.select("_id", "_key", F.size("_w").cast("long").alias("n_words"), "_p", hit(i).alias("gram"), w[i].alias("g0"), w[i + 1].alias("g1"), w[i + 2].alias("g2"))
    votes = rows.join(F.broadcast(table), ["gram", "g0", "g1", "g2"], "left").withColumn("diagonal", F.col("_p") - F.col("at"))
    return votes.groupBy("_id", "_key", "n_words", "template", "label", "base", "length", "diagonal").agg(
        F.collect_set("at").alias("grams"), F.min("_p").alias("first"), F.max("_p").alias("last"), F.count_if(F.col("_p").isNull()).alias("copies")
    )


def license_spans(votes: DataFrame, drift: int = 6, cover: float = 0.7, short: int = 8) -> DataFrame:
    """Merge neighbouring diagonals of license_votes() and verify them.

    Adds span, start, end (words, end exclusive), coverage (share of the template's k-grams hit) and
    verified.  Templates of up to `short` words must be covered wholly on one diagonal; longer ones to
    the share `cover`, within a span of at most one and a half template lengths."""
    by = Window.partitionBy("_id", "_key", "template").orderBy("diagonal")
    near = (F.col("diagonal") - F.lag("diagonal").over(by) <= drift) & (F.col("length") > short)
    rows = votes.withColumn("_new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("span", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("_id", "_key", "n_words", "template", "label", "base", "length", "span").agg(
        F.min("first").alias("start"),
        (F.max("last") + K).alias("end"),
        F.size(F.array_distinct(F.flatten(F.collect_list("grams")))).alias("_hit"),
        F.max("copies").alias("copies"),
    )
    coverage = F.when(F.col("template").isNotNull(), F.col("_hit") / (F.col("length") - K + 1))
    fits = F.col("end") - F.col("start") <= 1.5 * F.col("length") + K
    need = F.when(F.col("length") <= short, F.lit(1.0)).otherwise(F.lit(cover))
    return rows.withColumn("coverage", coverage).withColumn("verified", F.coalesce((F.col("coverage") >= need) & fits, F.lit(False)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: n_words, places of base phrases, labels and the best verified coverage."""
    spans = license_spans(license_votes(docs, id_col, text_col))
    ok, base = F.col("verified"), F.col("verified") & F.col("base")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    rows = spans.groupBy("_id", "_key").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(base, 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(ok, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(ok, F.col("coverage"))), F.lit(0.0)).alias("score"),
        F.max("copies").cast("int").alias("_copies"),
    )
    rows = rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), F.col("_copies"))))
    return rows.withColumnRenamed("_id", id_col).drop("_key", "_copies", "_copy")
