"""Substring search without a scan: an index of the groups of three characters in the searched columns.

A text that contains a needle contains each of its groups of three. The index lists, for each group, the rows that have
it in one of the columns. A search reads the lists of the needle's rarest groups, keeps the rows that are on all of them,
and compares the texts of those rows alone. Lists and texts are bucketed tables: lists are dealt by their group, texts by
shards of rows, so both are read bucket by bucket. A list is cut by shards, so no row of the index grows with the ledger.

An import adds a segment of its own; a search looks into all segments. Rows whose texts change are indexed again in
whole: the index holds the texts as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grootboek.checkpoints import checkpointed, kept
from grootboek.functions.text import casefold, contains_any, search_needle, text_or_empty
from grootboek.operators.classify import SEARCHED
from grootboek.sources.bucket_table import DIGITS, BucketTable

SIZE = 3
#: So many of a needle's groups, the rarest ones, are looked up; the others hardly narrow what those leave.
LOOKED_UP = 4
#: Rows to a shard.
SHARD_ROWS = 50_000
_ROW = ["src", "tx_id"]


def _grams(text: Column) -> Column:
    """The different groups of three characters in a text, as an array."""
    starts = F.when(F.length(text) >= SIZE, F.sequence(F.lit(1), F.length(text) - SIZE + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(SIZE))))


def needle_grams(needle: str) -> list[str]:
    return sorted({needle[i : i + SIZE] for i in range(len(needle) - SIZE + 1)})


class TextIndex:
    """The index of a ledger's searched columns, below a folder with a folder for each segment."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, ledger: DataFrame, path: str, digits: int = DIGITS) -> TextIndex:
        index = cls(ledger.sparkSession, path)
        index.add(ledger, "0", digits)
        return index

    def add(self, rows: DataFrame, segment: str, digits: int = DIGITS) -> None:
        """Indexes more rows (``src``, ``tx_id`` and the searched columns). A segment that is there is refused."""
        texts = [text_or_empty(F.col(c)).alias(c) for c in SEARCHED]
        rows = kept(rows.select(*_ROW, *texts), "texts")
        shards = max(1, -(-rows.count() // SHARD_ROWS))
        placed = rows.withColumns(
            {"shard": F.pmod(F.xxhash64(*_ROW), F.lit(shards)), "place": F.xxhash64(*_ROW, F.lit(1))}
        )
        both = F.array_distinct(F.flatten(F.array(*[_grams(casefold(F.col(c))) for c in SEARCHED])))
        each = placed.select("shard", "place", F.explode(both).alias("gram"))
        lists = each.groupBy("gram", "shard").agg(F.collect_set("place").alias("places"))
        lists = lists.withColumn("n", F.size("places"))
        folder = f"{self.path}/segment={segment}"
        BucketTable.create(placed, f"{folder}/texts", ["shard"], digits)
        BucketTable.create(lists, f"{folder}/lists", ["gram"], digits)
        named = self.spark.createDataFrame([(segment,)], "name string").coalesce(1)
        named.write.mode("append").parquet(f"{self.path}/segments")

    def segments(self) -> list[str]:
        """Segments are named when they are complete."""
        return sorted(r["name"] for r in self.spark.read.schema("name string").parquet(f"{self.path}/segments").collect())

    def search(self, text: str | None) -> DataFrame:
        """(src, tx_id) of the rows with the text in one of the columns, ignoring case.

        An empty text finds nothing. One of fewer than three characters has no group, so the texts of all rows are read.
        """
        needle = search_needle(text)
        found = self.spark.createDataFrame([], "src string, tx_id string")
        if not needle:
            return found
        for segment in self.segments():
            found = found.unionByName(self._search(f"{self.path}/segment={segment}", needle))
        return found

    def _search(self, folder: str, needle: str) -> DataFrame:
        texts = BucketTable(self.spark, f"{folder}/texts")
        columns = [F.col(c) for c in SEARCHED]
        grams = needle_grams(needle.casefold())
        if not grams:
            return texts.read().where(contains_any(columns, needle)).select(*_ROW)
        near = self.candidates(folder, grams)
        own = texts.buckets(near.select("shard").distinct())
        return own.join(near, ["shard", "place"], "left_semi").where(contains_any(columns, needle)).select(*_ROW)

    def candidates(self, folder: str, grams: list[str]) -> DataFrame:
        """(shard, place) of the rows that are on the lists of the rarest of these groups."""
        lists = BucketTable(self.spark, f"{folder}/lists")
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string")
        own = lists.buckets(asked).where(F.col("gram").isin(grams))
        sizes = {r["gram"]: r["n"] for r in own.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        none = self.spark.createDataFrame([], "shard long, place long")
        if len(sizes) < len(grams):
            return none
        rarest = sorted(grams, key=lambda g: (sizes[g], g))[:LOOKED_UP]
        each = own.where(F.col("gram").isin(rarest)).select("shard", F.explode("places").alias("place"))
        both = each.groupBy("shard", "place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest))
        return checkpointed(both.select("shard", "place"))
