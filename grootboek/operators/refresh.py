"""Suggestions that are kept up to date: after an import or a correction only the texts that it touched are judged again.

Two bucketed tables are stored, both dealt by (text, direction): how many rows each text has with each label, and the
suggestion of every row together with the row's own label. Both are sums and lookups over one text at a time, so a change
concerns only the texts of its rows. The counts are kept as sums of differences; of the rows in a touched bucket, those
with other texts are carried over as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grootboek.checkpoints import checkpointed
from grootboek.operators.memory import LABEL, TEXT_KEY, label_counts, suggestions
from grootboek.skew import lookup
from grootboek.sources.bucket_table import DIGITS, BucketTable

#: A row without a usable text is dealt by its own id: such rows may be very many, and are never judged by others.
_DEALT = "dealt_by"
_OWN = {"category": "own_category", "subcategory": "own_subcategory"}
RESULT = ["src", "tx_id", "category", "subcategory", "score", "unanimous", "neighbor_n", "layer", "disagrees"]


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with the value by which they are dealt: their text and direction, or else their id."""
    text = F.concat_ws("\u0001", *TEXT_KEY)
    return rows.withColumn(_DEALT, F.when(_keyed(), text).otherwise(F.concat_ws("\u0001", "src", "tx_id")))


def _keyed():
    return F.col("text_key").isNotNull() & F.col("direction").isNotNull()


def _judged(corpus: DataFrame, counts: DataFrame) -> DataFrame:
    """Suggestions of the corpus rows, with what is needed to judge them again."""
    own = corpus.select("src", "tx_id", *TEXT_KEY, *[F.col(c).alias(own) for c, own in _OWN.items()])
    made = suggestions(corpus, counts)
    return _dealt(made.join(own, ["src", "tx_id"])).select(_DEALT, *RESULT, *TEXT_KEY, *_OWN.values())


class SuggestionStore:
    """Stored label counts and suggestions of a corpus (``memory.memory_corpus``), one row per ``src`` and ``tx_id``."""

    def __init__(self, spark: SparkSession, path: str):
        self.counts = BucketTable(spark, f"{path.rstrip('/')}/counts")
        self.rows = BucketTable(spark, f"{path.rstrip('/')}/rows")

    @classmethod
    def create(cls, corpus: DataFrame, path: str, digits: int = DIGITS) -> SuggestionStore:
        corpus = checkpointed(corpus)
        counts = checkpointed(_dealt_counts(label_counts(corpus)))
        BucketTable.create(counts, f"{path.rstrip('/')}/counts", [_DEALT], digits)
        BucketTable.create(_judged(corpus, counts.drop(_DEALT)), f"{path.rstrip('/')}/rows", [_DEALT], digits)
        return cls(corpus.sparkSession, path)

    def read(self) -> DataFrame:
        return self.rows.read().select(*RESULT)

    def refresh(self, batch: str, added: DataFrame, removed: DataFrame | None = None) -> None:
        """Takes corpus rows in and out. A corrected row is taken out as it was and in as it is.

        ``batch`` names the change. One that broke off between the two tables is repeated under the same name: what it
        has already changed is left alone.
        """
        added = checkpointed(added)
        removed = checkpointed(added.limit(0) if removed is None else removed)
        both = checkpointed(_dealt(added.unionByName(removed)).select(_DEALT, "src", "tx_id", *TEXT_KEY))
        keyed = both.where(_keyed())
        more, less = label_counts(added), label_counts(removed).withColumn("label_n", -F.col("label_n"))
        delta = _dealt_counts(more.unionByName(less))

        def summed(stored: DataFrame) -> DataFrame:
            sums = stored.unionByName(delta).groupBy(_DEALT, *TEXT_KEY, *LABEL).agg(F.sum("label_n").alias("label_n"))
            return sums.where(F.col("label_n") != 0)

        self.counts.change(keyed, summed, note=batch)
        texts = keyed.select(_DEALT).distinct()
        counts = self.counts.buckets(keyed).join(texts, _DEALT, "left_semi").drop(_DEALT)

        def judged_again(stored: DataFrame) -> DataFrame:
            stays = lookup(stored, both.select("src", "tx_id").distinct(), ["src", "tx_id"], ["src", "tx_id"], "left_anti")
            same_text = lookup(stays, texts, _DEALT, ["src", "tx_id"], "left_semi")
            other = lookup(stays, texts, _DEALT, ["src", "tx_id"], "left_anti")
            corpus = same_text.select("src", "tx_id", *TEXT_KEY, *[F.col(own).alias(c) for c, own in _OWN.items()])
            return other.unionByName(_judged(corpus.unionByName(added.select(*corpus.columns)), counts))

        self.rows.change(both, judged_again, note=batch)


def _dealt_counts(counts: DataFrame) -> DataFrame:
    return counts.withColumn(_DEALT, F.concat_ws("\u0001", *TEXT_KEY))
