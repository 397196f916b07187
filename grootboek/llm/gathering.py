"""Combining rows inside a task, over all the pieces it reads, before anything is shuffled."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from grootboek.llm.common import PIECE_BYTES, PIECE_ROWS, _in_batches, _pieces, give_back


def gathered(
    df: DataFrame,
    columns: list[str],
    fields: str | T.StructType,
    start: Callable[[], tuple[Callable, Callable]],
    piece_rows: int = PIECE_ROWS,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Rows of ``fields`` from pieces of ``df``, made by a task that keeps something from piece to piece.

    ``start`` runs once per task and returns two functions: one takes the columns' value lists of a piece and returns
    columns to pass on, or None; the other is called at the end of the task and returns the rest.
    """
    schema = T._parse_datatype_string(fields) if isinstance(fields, str) else fields
    arrow = to_arrow_schema(schema)

    def run(batches):
        work, rest = start()

        def batch_of(made):
            arrays = [v if isinstance(v, pa.Array) else pa.array(v, arrow.field(i).type) for i, v in enumerate(made)]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            for part in _pieces(batch, piece_rows, piece_bytes):
                made = work([c.to_pylist() for c in part.columns])
                if made is not None:
                    yield batch_of(made)
                    del made
        made = rest()
        if made is not None:
            yield batch_of(made)
        del made, work, rest
        give_back()

    return _in_batches(df).select(*columns).mapInArrow(run, schema)
