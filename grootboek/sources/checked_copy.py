"""Checked copies of large ledgers: by slices of ids, each compared by its content, and valid only as a whole.

A slice holds the ids with the same first characters. Below the copy's folder, ``data/slice=<s>`` has its rows by month and
``checks/slice=<s>`` one row: the count, the ids and a sum over hashes of all columns, taken from the source and found
again in the files just written. ``committed`` is written last, when every slice has passed. A copy that broke off goes on
where it stopped: slices that have passed, and whose source is still the same, stay; a slice that was half written has no
checks and is written again. Without ``committed`` nothing can be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grootboek.checkpoints import checkpointed
from grootboek.schema import SCORE
from grootboek.sources.ledgers import CheckFailed, _path_exists

ID_LENGTH = 32
#: First characters of an id that name its slice: 16 slices for hexadecimal ids.
DIGITS = 1
#: Rows of a slice for each file of a month.
FILE_ROWS = 5_000_000

_CHECKS = "n long, ids long, checksum decimal(38,0), similarities long"


def checks(rows: DataFrame) -> DataFrame:
    """What a slice holds, one row each: rows, different ids, and a sum of hashes that changes with any cell.

    Columns are taken by name and every kind of value by itself, so that files read back give what their source gave.
    """
    hashed = F.xxhash64(*[F.col(c) for c in sorted(rows.columns) if c not in ("slice", "similarity")])
    return rows.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("tx_id").alias("ids"),
        F.sum(hashed.cast("decimal(38,0)")).alias("checksum"),
        F.count("similarity").alias("similarities"),
    )


class CheckedCopy:
    """A copy of a ledger with unique ids of 32 characters, similarity cleared."""

    def __init__(self, spark: SparkSession, path: str, digits: int = DIGITS):
        self.spark, self.path, self.digits = spark, path.rstrip("/"), digits

    def run(self, source: DataFrame, at_most: int | None = None) -> dict[str, str]:
        """Copies what is not copied yet, up to ``at_most`` slices, and says of each slice whether it was ``copied`` or
        ``kept``. The copy is committed when no slice is left."""
        if self.committed():
            return {}
        sliced = source.withColumn("slice", F.left("tx_id", F.lit(self.digits)))
        self._refuse(sliced)
        wanted = {r["slice"]: r for r in checks(sliced).collect()}
        outcomes: dict[str, str] = {}
        passed = self._passed()
        for name in sorted(wanted):
            if passed.get(name) == (wanted[name]["n"], wanted[name]["checksum"]):
                outcomes[name] = "kept"
        left = [s for s in sorted(wanted) if s not in outcomes]
        for name in left[:at_most]:
            self._copy(sliced.where(F.col("slice") == name), name, wanted[name])
            outcomes[name] = "copied"
        if len(outcomes) == len(wanted):
            stale = sorted(set(passed) - set(wanted))
            if stale:
                raise CheckFailed(f"slices that the source does not have: {', '.join(stale)}")
            self._commit(sum(r["n"] for r in wanted.values()))
        return outcomes

    def committed(self) -> bool:
        return _path_exists(self.spark, f"{self.path}/committed/_SUCCESS")

    def read(self) -> DataFrame:
        """The whole copy. One that is not committed is refused."""
        if not self.committed():
            raise CheckFailed("the copy is not finished")
        return self.spark.read.schema(self._shape()).parquet(f"{self.path}/data").drop("slice")

    def report(self) -> DataFrame:
        """The checks of every slice that has passed."""
        return self.spark.read.schema(f"{_CHECKS}, slice string").parquet(f"{self.path}/checks")

    def _refuse(self, sliced: DataFrame) -> None:
        length = F.length("tx_id")
        wrong = F.col("tx_id").isNull() | (length != ID_LENGTH)
        if not sliced.where(wrong).limit(1).isEmpty():
            raise CheckFailed(f"ids are not {ID_LENGTH} characters long")

    def _passed(self) -> dict[str, tuple]:
        if not _path_exists(self.spark, f"{self.path}/checks"):
            return {}
        return {r["slice"]: (r["n"], r["checksum"]) for r in self.report().collect()}

    def _copy(self, rows: DataFrame, name: str, want) -> None:
        if want["n"] != want["ids"]:
            raise CheckFailed(f"ids of slice {name} are not unique")
        folder, checked = f"{self.path}/data/slice={name}", f"{self.path}/checks/slice={name}"
        cleared = rows.withColumn("similarity", F.lit(None).cast(SCORE)).drop("slice")
        # Static: what a broken run has left in the folder goes.
        plain = {"partitionOverwriteMode": "static"}
        # By month and part of it: few files for a small slice, several tasks for a large month.
        parts = max(1, -(-want["n"] // FILE_ROWS))
        dealt = cleared.repartition("ym", F.pmod(F.xxhash64("tx_id"), F.lit(parts)))
        dealt.write.options(**plain).mode("overwrite").partitionBy("ym").parquet(folder)
        written = self.spark.read.schema(cleared.schema).parquet(folder).withColumn("slice", F.lit(name))
        found = checkpointed(checks(written.select(*rows.columns)))
        got = found.first()
        if got is None or (got["n"], got["checksum"], got["similarities"]) != (want["n"], want["checksum"], 0):
            raise CheckFailed(f"slice {name} differs after the copy")
        found.drop("slice").coalesce(1).write.options(**plain).mode("overwrite").parquet(checked)

    def _shape(self) -> str:
        return self.spark.read.parquet(f"{self.path}/committed").first()["shape"]

    def _commit(self, n: int) -> None:
        shape = self.spark.read.parquet(f"{self.path}/data").schema
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in shape.fields if f.name != "slice"]
        total = self.report().agg(F.sum("n")).first()[0]
        if (total or 0) != n:
            raise CheckFailed("counts differ after the copy")
        row = self.spark.createDataFrame([(n, ", ".join([*fields, "slice string"]))], "n long, shape string")
        row.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/committed")
