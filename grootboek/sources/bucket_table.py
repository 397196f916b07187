"""Stored tables whose rows are dealt to buckets by a key, and that change bucket by bucket.

Below a table's folder, ``data/<generation>/bucket=<b>`` holds Parquet files that are never changed, and
``manifest/version=<n>`` is one small file with the generation of every bucket. A change reads and writes only the
buckets that it concerns, into a generation of its own, and then writes the next manifest: until that file is there,
readers see the table as it was, and a change that broke off leaves nothing but files that no manifest names. Files of
earlier generations stay for readers that started earlier. There is one writer at a time: one that finds its version
taken is refused, and has changed nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grootboek.checkpoints import checkpointed, kept
from grootboek.sources.ledgers import CheckFailed

#: Hexadecimal digits of a key's MD5 that name its bucket: 256 buckets, at most 65,536.
DIGITS, MOST_DIGITS = 2, 4
#: Rows to a file; buckets with more have several.
FILE_ROWS = 500_000

_BETWEEN = "\u0001"
_MANIFEST = "bucket string, generation string, about string, version long"


@dataclass(frozen=True)
class Manifest:
    """What a version of a table consists of. ``note`` names what made it, so that a repeated change can be told."""

    version: int
    keys: tuple[str, ...]
    digits: int
    shape: T.StructType
    note: str
    generations: dict[str, str]

    @property
    def numbers(self) -> dict[str, int]:
        """The version in which each bucket was last written."""
        return {b: int(g.split("-")[0]) for b, g in self.generations.items()}


def bucket_of(keys: Sequence[str], digits: int = DIGITS) -> Column:
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.substring(F.md5(F.concat_ws(_BETWEEN, *parts).cast("binary")), 1, digits)


class BucketTable:
    """A stored table, dealt by its key columns. A missing key counts as an empty one for that."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(
        cls, rows: DataFrame, path: str, keys: Sequence[str], digits: int = DIGITS, note: str = ""
    ) -> BucketTable:
        """A new table. One that is there already is not replaced."""
        if not 1 <= digits <= MOST_DIGITS:
            raise ValueError(f"digits must be 1 to {MOST_DIGITS}")
        table = cls(rows.sparkSession, path)
        first = Manifest(1, tuple(keys), digits, rows.schema, note, {})
        table._commit(first, table._write(rows, first, 1), 1, note)
        return table

    def manifest(self, version: int | None = None) -> Manifest:
        """A version, the newest by default; as many rows are collected as there are buckets."""
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        version = self._newest() if version is None else version
        listed = rows.where(F.col("version") == version).collect()
        about = json.loads(next(r["about"] for r in listed if r["bucket"] is None))
        shape = T.StructType.fromJson(about["shape"])
        generations = {r["bucket"]: r["generation"] for r in listed if r["bucket"] is not None}
        return Manifest(version, tuple(about["keys"]), about["digits"], shape, about["note"], generations)

    def _newest(self) -> int:
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").agg(F.max("version")).first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, of the newest version or of an earlier one."""
        return self._rows(self.manifest(version))

    def buckets(self, named: DataFrame) -> DataFrame:
        """The rows of all buckets that the keys in ``named`` fall into; other files are not read."""
        at = self.manifest()
        return self._rows(at, self._buckets(named, at))

    def one(self, *key: str) -> DataFrame:
        """The rows with a key, from its bucket."""
        at = self.manifest()
        bucket = hashlib.md5(_BETWEEN.join(key).encode()).hexdigest()[: at.digits]
        rows = self._rows(at, {bucket})
        for column, value in zip(at.keys, key, strict=True):
            rows = rows.where(F.col(column) == value)
        return rows

    def upsert(self, fresh: DataFrame) -> int:
        """Puts rows in the place of those with the same keys, adds the others, and returns the new version."""
        keys = self.manifest().keys
        fresh = unique(fresh, keys)

        def merged(stored: DataFrame) -> DataFrame:
            return stored.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)

        return self.change(fresh, merged)

    def remove(self, named: DataFrame) -> int:
        """Removes the rows with the keys in ``named``."""
        keys = list(self.manifest().keys)
        named = checkpointed(named.select(*keys).distinct())
        return self.change(named, lambda stored: stored.join(named, keys, "left_anti"), adds=False)

    def change(
        self,
        named: DataFrame,
        made: Callable[[DataFrame], DataFrame],
        adds: bool = True,
        note: str = "",
        base: Manifest | None = None,
    ) -> int:
        """Replaces the buckets that the keys in ``named`` fall into by what ``made`` makes of their rows.

        Without ``adds``, buckets that are not there yet stay so. A change with the note of the newest version is a
        repetition, and is left out. ``base`` is the version to start from, if not the newest. Returns the version.
        """
        at = base or self.manifest()
        if note and note == at.note:
            return at.version
        touched = self._buckets(named, at)
        if not adds:
            touched &= set(at.generations)
        if not touched:
            return at.version
        version = (self._newest() if base else at.version) + 1
        written = self._write(made(self._rows(at, touched)).select(*at.shape.fieldNames()), at, version)
        # A bucket without rows has no folder.
        others = {b: g for b, g in at.generations.items() if b not in touched}
        self._commit(at, others | written, version, note)
        return version

    def _buckets(self, named: DataFrame, at: Manifest) -> set[str]:
        """At most as many values as there are buckets."""
        return {r[0] for r in named.select(bucket_of(at.keys, at.digits)).distinct().collect()}

    def _rows(self, at: Manifest, buckets: set[str] | None = None) -> DataFrame:
        wanted = at.generations if buckets is None else {b: g for b, g in at.generations.items() if b in buckets}
        if not wanted:
            return self.spark.createDataFrame([], at.shape)
        # Folders by name, so that others are not even listed.
        folders = [f"{self.path}/data/{g}/bucket={b}" for b, g in sorted(wanted.items())]
        return self.spark.read.schema(at.shape).parquet(*folders)

    def _write(self, rows: DataFrame, at: Manifest, version: int) -> dict[str, str]:
        """Writes the rows as a generation of its own; returns the buckets it has, each with its name."""
        generation = f"{version}-{uuid.uuid4().hex[:8]}"
        rows = kept(rows.withColumn("bucket", bucket_of(at.keys, at.digits)), "rows")
        # At most as many rows as there are buckets.
        counts = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}
        files = max(1, -(-sum(counts.values()) // (16**at.digits * FILE_ROWS)))
        # By bucket and part of it, so that a large bucket is written by several tasks and a small one to one file.
        spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "bucket" and _plain(rows, c)]), F.lit(files))
        dealt = rows.repartition("bucket", spread)
        dealt.write.partitionBy("bucket").mode("errorifexists").parquet(f"{self.path}/data/{generation}")
        return dict.fromkeys(counts, generation)

    def _commit(self, at: Manifest, generations: dict[str, str], version: int, note: str) -> None:
        about = {"keys": at.keys, "digits": at.digits, "shape": at.shape.jsonValue(), "note": note}
        # The row without a bucket tells about the table, also about one without rows.
        rows = [(None, None, json.dumps(about)), *((b, g, None) for b, g in sorted(generations.items()))]
        listed = self.spark.createDataFrame(rows, "bucket string, generation string, about string").coalesce(1)
        listed.write.mode("errorifexists").parquet(f"{self.path}/manifest/version={version}")


def _plain(rows: DataFrame, column: str) -> bool:
    return not isinstance(rows.schema[column].dataType, (T.ArrayType, T.MapType, T.StructType))


def unique(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows``, stored, after a check that every key is there once: which of two rows is newer could not be told."""
    rows = checkpointed(rows)
    twice = rows.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect()
    if twice:
        raise CheckFailed(f"repeated key: {', '.join(str(twice[0][k]) for k in keys)}")
    return rows
