"""Ledger tables: Parquet in, database in, Parquet out."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grootboek.functions.dates import bank_date, card_date, ym_of
from grootboek.schema import BANK, CARD, SCORE, TERM, conform

# The column names of the database tables the ledgers come from.
BANK_COLUMNS = {
    "id": "id",
    "TransactieID": "tx_id",
    "Datum": "raw_date",
    "Naam / Omschrijving": "description",
    "Rekening": "account",
    "Tegenrekening": "counter_account",
    "Code": "code",
    "Af Bij": "direction",
    "Bedrag (EUR)": "amount",
    "Mutatiesoort": "mutation_kind",
    "Mededelingen": "memo",
    "Saldo na mutatie": "balance_after",
    "Hoofdcategorie": "category",
    "Subcategorie": "subcategory",
    "Entiteit": "merchant",
    "Similarity": "similarity",
    "oorsprong_hoofd": "orig_category",
    "oorsprong_sub": "orig_subcategory",
}
CARD_COLUMNS = {
    "id": "id",
    "TransactieID": "tx_id",
    "Datum": "raw_date",
    "Omschrijving": "description",
    "Rekening": "account",
    "Type": "card_type",
    "Mutatie": "token",
    "Af Bij": "direction",
    "Bedrag": "amount",
    "Hoofdcategorie": "category",
    "Subcategorie": "subcategory",
    "Entiteit": "merchant",
    "Similarity": "similarity",
    "oorsprong_hoofd": "orig_category",
    "oorsprong_sub": "orig_subcategory",
}


class TableRefused(ValueError):
    """A table that is not on the caller's list."""


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), BANK)


def read_card(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), CARD)


def read_terms(spark: SparkSession, path: str, locale: str) -> DataFrame:
    """Translations for one locale, one row per (namespace, source)."""
    terms = conform(spark.read.parquet(path), TERM)
    return terms.where(F.col("locale") == locale).drop("locale")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    allowed: frozenset[str],
    properties: Mapping[str, str],
    id_range: tuple[int, int],
    partitions: int,
) -> DataFrame:
    """A database table read in parallel slices of its primary key. Tables not in ``allowed`` are refused."""
    if table not in allowed:
        raise TableRefused(table)
    low, high = id_range
    return spark.read.jdbc(
        url,
        table,
        column="id",
        lowerBound=low,
        upperBound=high,
        numPartitions=partitions,
        properties=dict(properties),
    )


def _from_table(df: DataFrame, names: Mapping[str, str], parse_date, schema: T.StructType) -> DataFrame:
    renamed = df.select(
        *[F.col(f"`{old}`").alias(new) for old, new in names.items() if old in df.columns],
        *[F.lit(None).alias(new) for old, new in names.items() if old not in df.columns],
    )
    dated = renamed.withColumn("tx_date", parse_date(F.col("raw_date").cast("string")))
    dated = dated.withColumn("ym", ym_of(F.col("tx_date")))
    return conform(dated.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]), schema)


def bank_from_table(df: DataFrame) -> DataFrame:
    """A bank table with its database column names, in the library's schema."""
    return _from_table(df, BANK_COLUMNS, bank_date, BANK)


def card_from_table(df: DataFrame) -> DataFrame:
    return _from_table(df, CARD_COLUMNS, card_date, CARD)


def loaded_ids(ledger: DataFrame) -> DataFrame:
    """The ids already in a ledger."""
    return ledger.where(F.col("tx_id").isNotNull()).select("tx_id").distinct()


class CheckFailed(ValueError):
    """A table that must not be written, or one that was not written whole."""


def table_stats(ledger: DataFrame) -> DataFrame:
    """One row: row count, distinct ids, shortest and longest id, rows without similarity."""
    length = F.length("tx_id")
    return ledger.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("tx_id").alias("distinct_ids"),
        F.min(length).alias("id_min"),
        F.max(length).alias("id_max"),
        F.count_if(F.col("similarity").isNull()).alias("similarity_nulls"),
    )


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("ym").parquet(path)


def replace_months(rows: DataFrame, path: str) -> None:
    """Overwrite only the month partitions present in ``rows``."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("ym").parquet(path)


def write_snapshot(ledger: DataFrame, path: str) -> None:
    """Write a whole ledger to a new folder, one folder per month."""
    ledger.write.mode("errorifexists").partitionBy("ym").parquet(path)


def _path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def copy_table(spark: SparkSession, source: DataFrame, path: str, dry_run: bool = False) -> str:
    """Copy a ledger with checks, similarity cleared. Returns ``skipped``, ``dry-run`` or ``copied``.

    The source must have unique ids of 32 characters. A finished copy is left alone; a folder that holds anything
    else is refused, never overwritten.
    """
    before = table_stats(source).first()
    if before.n != before.distinct_ids:
        raise CheckFailed("ids are not unique")
    if (before.id_min, before.id_max) != (32, 32):
        raise CheckFailed("ids are not 32 characters long")

    def is_complete() -> bool:
        after = table_stats(spark.read.schema(source.schema).parquet(path)).first()
        same = (after.n, after.distinct_ids) == (before.n, before.distinct_ids)
        return same and after.similarity_nulls == after.n

    if _path_exists(spark, path):
        if is_complete():
            return "skipped"
        raise CheckFailed("the target exists and is not a finished copy")
    if dry_run:
        return "dry-run"
    write_snapshot(source.withColumn("similarity", F.lit(None).cast(SCORE)), path)
    if not is_complete():
        raise CheckFailed("counts differ after the copy")
    return "copied"


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
