"""One query per operator, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grootboek.llm import (
    bpe,
    divergence,
    kneser_ney,
    licenses,
    line_quality,
    max_sketch,
    packing,
    search,
    simhash,
    substrings,
    super_minhash,
    token_trees,
    warc,
)
from grootboek.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"])


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])


@query
def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_token_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts after four edits of every document: an insertion or replacement of words, a deletion, one inside a
    word and one with white space, at places that depend on a hash of the id."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    length = F.coalesce(F.length("text"), F.lit(0))
    edits = token_trees.spread_edits(F.col("doc_id"), length, [" some more words", "", "x", " \n\n"])
    documents = table(spark, sf_dir, "documents").withColumn("edits", edits)
    rows = token_trees.trees(documents, ["doc_id", "edits"], tokenizer)
    return token_trees.edited(rows, ["doc_id"], tokenizer).select(
        "doc_id", "n_before", "n_after", "n_edits", "n_encoded", F.length("text").cast("long").alias("n_chars")
    )


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents"))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    queries = documents.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), "text")
    return search.search(documents, queries)


@query
def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    field = line_quality.fit(documents, table(spark, sf_dir, "labels"))
    return line_quality.judge(documents, ["doc_id"], field)


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query
def op12_max_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return super_minhash.near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])
