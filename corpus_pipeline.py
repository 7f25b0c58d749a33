"""A training corpus from ``documents``: language ID, line dedup, near dedup, mixing, packing.

Each stage is a function of (spark, docs, sf_dir) on the Parquet that the one
before has written; all but the last return the columns of documents.  ``run``
applies them in order.

Defined cases: rows with null texts have no language and go in the first
stage; an empty table passes through every stage; other columns of documents
are carried to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiaudit.llm.common import TEXT_ROWS, drop_scratch, held_out, scratch_mark, scratch_path, table, written
from equiaudit.llm.langid import MIN_WORDS, UNKNOWN, identify, least_known_shares, train
from equiaudit.llm.line_dedup import deduplicated
from equiaudit.llm.mixture import mixed_documents
from equiaudit.llm.near_dedup import near_duplicates
from equiaudit.llm.packing import pack


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language, and fills ``lang`` where it is null.

    Null texts and texts without a letter go.  So do texts of 20 words and more of which the model of the learned
    languages knows next to nothing: less than half of what nearly all labelled documents of the predicted language
    reach that it was not trained on (a quarter of them, by a hash of the id).  Every labelled document counts, for the
    model or for these limits.  Shorter texts tell too little to be rejected, and a language of a few labelled documents
    rejects nothing.  Where no row has a label, no language can be learned, and texts with a letter pass."""
    aside = held_out("doc_id", 4, 2)
    model = train(docs.select("text", "lang").where(F.col("lang").isNotNull() & ~aside))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = written(identify(docs, model, out=("__lang", "__score", "__words", "__known")), "languages", TEXT_ROWS)
    least = least_known_shares(told.where(F.col("lang").isNotNull() & aside))
    needed = F.lit(0.0)
    for name, share in least.items():
        needed = F.when(F.col("__lang") == name, F.lit(share)).otherwise(needed)
    kept = told.where((F.col("__lang") != UNKNOWN) & ((F.col("__words") < MIN_WORDS) | (F.col("__known") >= needed)))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated and similar lines, and documents that lose all their words by that."""
    out = deduplicated(docs, counts=True)
    empty = (F.col("__removed") > 0) & (F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) == "")
    return _recounted(out.where(~empty | F.col("text").isNull()).select(*docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document as often as its source's target takes it, the last one as far as it reaches."""
    return _recounted(mixed_documents(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near), ("mixture", mix), ("packing", packed)]

#: Learned models and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path, mark = scratch_path(spark, f"pipeline-{name}"), scratch_mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_scratch(spark, mark)  # the stage is stored; what it was built on goes
        docs = spark.read.parquet(path)
    return docs
