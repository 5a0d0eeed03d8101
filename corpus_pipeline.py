"""The corpus pipeline: language ID, near-duplicates, benchmark passages, personal data, pieces.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.llm import common, decontaminate, language, minhash, pieces, pii, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; lang becomes the predicted one."""
    docs = docs.select(*COLUMNS)
    rows = language.identify(docs, queries.language_model(docs)).where("not rejected")
    return rows.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id."""
    docs = docs.select(*COLUMNS)
    dropped = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    docs = docs.select(*COLUMNS)
    found = decontaminate.contamination(docs, queries.table(spark, sf_dir, "benchmark"))
    return docs.join(found.where("contaminated").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    rows = pii.find_pii(docs.select(*COLUMNS))
    rows = rows.withColumn("text", pii.redact(F.col("text"), F.col("_spans")))
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces; a text that its pieces don't give back is an error."""
    rows = pieces.encode(docs.select("doc_id", "lang", "source", "text"))
    same = F.col("decoded").eqNullSafe(F.translate("text", pieces.SPACE, " "))
    return rows.select("doc_id", "lang", "source", F.when(F.col("pieces").isNull(), 0).otherwise(F.size("pieces")).cast("long").alias("n_pieces"), "pieces", same.alias("round_trip"))


STAGES = [("language", identified), ("near_duplicates", deduplicated), ("decontamination", decontaminated), ("personal_data", redacted), ("pieces", encoded)]
# A learned language model decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
