"""Preparing a corpus in five stages; each takes (spark, docs, folder) and returns a DataFrame.

Language ID drops documents of no known language, the Jaccard join keeps the first of each group of near copies,
suffix dedup cuts repeated passages, secret scans mask secrets, and packing lays the tokens into sequences. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm import best_fit_packing, language_id, ngram_join, secret_scans, suffix_dedup
from airgrid.llm.common import table, written

#: Of a document's grams, the share beyond which no learned language explains them and it is dropped.
MOST_UNEXPLAINED = 0.5
#: Bytes of the windows that count as repeated passages, and of their anchors: less than 50 words of these languages fill.
PASSAGE_BYTES, ANCHOR_BYTES = 200, 80


def _apart(docs: DataFrame) -> DataFrame:
    """Id and text of ``docs`` and all its other columns in one, so that an operator's columns don't clash with them."""
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(True).alias("__row"), *rest).alias("__rest"))


def _together(found: DataFrame, docs: DataFrame, changed: Column | None = None, text: Column | None = None) -> DataFrame:
    """The columns of ``docs`` again; where ``changed``, with the new ``text`` and its length."""
    columns = {c: F.col("__rest")[c] if c not in ("doc_id", "text") else F.col(c) for c in docs.columns}
    if changed is not None:
        columns["text"] = F.when(changed, text).otherwise(F.col("text"))
        if "n_chars" in columns:
            columns["n_chars"] = F.when(changed, F.length(text).cast("long")).otherwise(columns["n_chars"])
    return found.select(*[column.alias(c) for c, column in columns.items()])


def language_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents without letters and those mostly in no learned language; the model learns from the documents given."""
    found = language_id.predict(_apart(docs), language_id.learned(docs))
    rejected = (F.col("lang_pred") == language_id.UNKNOWN) | (F.col("no_lang") > MOST_UNEXPLAINED)
    return _together(found.where(~rejected), docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep the document with the smallest id of each component; rows that share an id stay together."""
    found = ngram_join.jaccard_components(docs)
    first = found.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select("doc_id").distinct()
    return docs.join(first.withColumnRenamed("doc_id", "__first"), F.col("doc_id").eqNullSafe(F.col("__first")), "left_semi").select(*docs.columns)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Cut passages of ``PASSAGE_BYTES`` that come again, wherever they stand; a document that loses all of its text goes."""
    found = suffix_dedup.dedup(_apart(docs), window=PASSAGE_BYTES, seed=ANCHOR_BYTES)
    found = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    return _together(found, docs, F.col("n_removed") > 0, F.col("kept_text"))


def secret_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Mask secrets; a text that changed gets its new length."""
    found = secret_scans.scan(_apart(docs))
    found = found.withColumn("__masked", F.when(F.size("secret_spans") > 0, secret_scans.masked(F.col("text"), F.col("secret_spans"))))
    return _together(found, docs, F.col("__masked").isNotNull(), F.col("__masked"))


def packing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token pieces and their places in sequences of 4096."""
    return best_fit_packing.pack(written(best_fit_packing.token_pieces(docs)))


STAGES = [
    ("language_id", language_stage),
    ("ngram_join", near_copy_stage),
    ("suffix_dedup", repeated_passage_stage),
    ("secret_scans", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: Segmentation and language inference have no SQL form; the tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, folder, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, folder))
    return docs
