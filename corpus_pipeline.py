"""The corpus pipeline: each stage works on all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Its
result is written as Parquet and read back as the next stage's docs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grootboek.llm import kneser_ney, line_quality, packing, simhash, substrings
from grootboek.llm.common import small, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rule and the line field keep. Null texts go. Rows with one doc_id are judged each."""
    field = line_quality.fit(docs, table(spark, sf_dir, "labels"))
    return line_quality.judge(docs, COLUMNS, field).filter("kept").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose doc_id the language model keeps; rows with one doc_id (null is one) are judged together."""
    verdicts = kneser_ney.classify(docs, table(spark, sf_dir, "labels"))
    rejected = stored(verdicts.filter("not kept").select(F.col("doc_id").alias("_rejected")), "rejected")
    rejected = small(rejected, rejected.count())
    return docs.select(*COLUMNS).join(rejected, F.col("doc_id").eqNullSafe(F.col("_rejected")), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of its smallest doc_id. Rows that repeat it go, too."""
    return simhash.first_of_each(docs, COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages that an earlier document has; ``n_chars`` is counted anew."""
    kept = substrings.deduplicated(docs, [c for c in COLUMNS if c not in ("text", "n_chars")])
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_of_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", packing_of_documents),
]
#: SQL can express none of the stages whole, so they are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
