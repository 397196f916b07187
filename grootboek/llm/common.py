"""What the operators of this package share: tables, shared folders and work on texts inside tasks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A task works through its texts in pieces of so many rows, or fewer rows if they hold so many bytes.
PIECE_ROWS, PIECE_BYTES = 512, 8 << 20
#: Whether Spark removes the shuffles of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How Spark passes rows to tasks' Python, where the session does not say: by default, 10,000 rows at once may hold any
#: number of bytes.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path under the session's ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting gets a temporary folder; a cluster without it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="grootboek-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives the loss of executors. What it
    shuffled is removed at once, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, n: int, most: int = 2_000_000) -> DataFrame:
    """``df`` marked for broadcasting if its ``n`` rows, of a few numbers each, are at most ``most``."""
    return F.broadcast(df) if n <= most else df


def _pieces(batch: pa.RecordBatch, rows: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    if batch.num_rows <= 1 or (batch.num_rows <= rows and batch.nbytes <= size):
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from _pieces(batch.slice(0, half), rows, size)
    yield from _pieces(batch.slice(half), rows, size)


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: later stages use the same worker processes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _in_batches(df: DataFrame) -> DataFrame:
    conf = df.sparkSession.conf
    for key, value in BATCHES.items():
        if conf.get(key, None) is None:
            conf.set(key, value)
    return df


def map_texts(
    df: DataFrame,
    keep: list[str],
    text: str,
    fields: str | T.StructType,
    start: Callable[[], Callable[[list], list[list]]],
) -> DataFrame:
    """The ``keep`` columns of ``df``, unchanged, and ``fields`` computed from the texts of the same rows.

    ``start`` runs once per task and returns the function that maps a list of texts (None for null) to one list of
    values per field. Rows stay where they are: no shuffle.
    """
    more = T._parse_datatype_string(fields) if isinstance(fields, str) else fields
    source = _in_batches(df).select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*(source.schema[c] for c in keep), *more.fields])
    arrow, n = to_arrow_schema(schema), len(keep)

    def run(batches):
        work = start()
        for batch in batches:
            for part in _pieces(batch):
                new = work(part.column(n).to_pylist())
                made = [pa.array(v, arrow.field(n + i).type) for i, v in enumerate(new)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), *made], schema=arrow)
        give_back()

    return source.mapInArrow(run, schema)


def explode_texts(
    df: DataFrame,
    columns: list[str],
    fields: str | T.StructType,
    start: Callable[[], Callable[[list[list]], list]],
    piece_rows: int = PIECE_ROWS,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Rows of ``fields`` made from pieces of ``df``: the function maps the columns' value lists to columns of the
    result, of any length. A piece has up to ``piece_rows`` rows and, if it has several, ``piece_bytes`` bytes."""
    schema = T._parse_datatype_string(fields) if isinstance(fields, str) else fields
    arrow = to_arrow_schema(schema)

    def run(batches):
        work = start()
        for batch in batches:
            for part in _pieces(batch, piece_rows, piece_bytes):
                made = work([c.to_pylist() for c in part.columns])
                arrays = [v if isinstance(v, pa.Array) else pa.array(v, arrow.field(i).type) for i, v in enumerate(made)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        give_back()

    return _in_batches(df).select(*columns).mapInArrow(run, schema)


class Recent:
    """A bounded memo: what was looked up lately stays, so a task's memory does not grow with its input.

    Two generations of ``size`` entries; when the younger is full, the older goes. Forgotten entries are made again.
    """

    def __init__(self, make: Callable, size: int = 200_000):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def many(self, keys: list) -> list:
        found = list(map(self.young.get, keys))
        if None in found:
            for i, value in enumerate(found):
                if value is None:
                    found[i] = self.one(keys[i])
        return found

    def one(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.make(key)
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[key] = value
        return value
