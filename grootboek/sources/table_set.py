"""Several bucketed tables that change together: a version of the set names a version of each table.

A change writes new versions of the tables, one after the other; none of them counts until the next version of the set is
written, which is one small file. A change that broke off in between, or whose checks failed, leaves all tables as they
were for every reader of the set.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grootboek.sources.bucket_table import DIGITS, BucketTable, Manifest

_SET = "name string, at long, version long"


class TableSet:
    """Named tables below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, tables: Mapping[str, DataFrame], path: str, keys: Mapping[str, list[str]], digits: int = DIGITS) -> TableSet:
        some = next(iter(tables.values()))
        made = cls(some.sparkSession, path)
        for name, rows in tables.items():
            BucketTable.create(rows, f"{made.path}/tables/{name}", keys[name], digits)
        made._commit(dict.fromkeys(tables, 1), 1)
        return made

    def versions(self) -> tuple[int, dict[str, int]]:
        """The version of the set and of each of its tables."""
        rows = self.spark.read.schema(_SET).parquet(f"{self.path}/set")
        version = rows.agg(F.max("version")).first()[0]
        return version, {r["name"]: r["at"] for r in rows.where(F.col("version") == version).collect()}

    def table(self, name: str) -> BucketTable:
        return BucketTable(self.spark, f"{self.path}/tables/{name}")

    def read(self, name: str) -> DataFrame:
        _, at = self.versions()
        return self.table(name).read(at[name])

    def change(
        self,
        named: Mapping[str, DataFrame],
        made: Callable[[str, DataFrame], DataFrame],
        check: Callable[[dict[str, DataFrame]], None] | None = None,
    ) -> int:
        """Changes the buckets of the rows in ``named``, table by table. ``check`` sees the tables as they would be, and
        refuses by raising; then nothing has changed."""
        version, at = self.versions()
        now = dict(at)
        for name, rows in named.items():
            base: Manifest = self.table(name).manifest(at[name])
            now[name] = self.table(name).change(rows, lambda stored, name=name: made(name, stored), adds=False, base=base)
        if now == at:
            return version
        if check:
            check({name: self.table(name).read(now[name]) for name in now})
        self._commit(now, version + 1)
        return version + 1

    def _commit(self, at: dict[str, int], version: int) -> None:
        rows = self.spark.createDataFrame(sorted(at.items()), "name string, at long").coalesce(1)
        rows.write.mode("errorifexists").parquet(f"{self.path}/set/version={version}")
