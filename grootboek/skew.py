"""Looking up one row per key when a single key may hold a third of all rows.

Partial aggregation already keeps hot keys out of aggregates. A join that attaches the aggregate to the rows again has
no such help: every row of a hot key would hash to one task, and adaptive skew handling does not apply where one side
of the join is an aggregate rather than a plain shuffle. ``lookup`` joins on the key and a slot made from it. Neither
side is distributed by both, so both are shuffled for the join alone, and adaptive execution can split a hot key.
Rows without a key take their slot from their own id, so they spread.

The result is the same as that of a plain join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SLOT, _DIM_SLOT, _VALUE = "_slot", "_dim_slot", "_value"


def _all(conditions: list[Column]) -> Column:
    return reduce(and_, conditions)


def lookup(
    facts: DataFrame, dim: DataFrame, on: str | Sequence[str], spread: Sequence[str], how: str = "left"
) -> DataFrame:
    """``facts`` with the columns of ``dim``, which has one row per key.

    ``spread`` names columns that identify a row of ``facts``. ``how`` is ``left``, ``inner``, ``left_semi`` or
    ``left_anti``. A null key finds nothing.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join kind {how!r}")
    keys = [on] if isinstance(on, str) else list(on)
    payload = [c for c in dim.columns if c not in keys]
    has_key = _all([F.col(k).isNotNull() for k in keys])
    slotted = facts.withColumn(_SLOT, F.when(has_key, F.xxhash64(*keys)).otherwise(F.xxhash64(*spread)))
    known = dim.select(
        F.xxhash64(*keys).alias(_DIM_SLOT),
        *[F.col(k).alias(f"_dim_{k}") for k in keys],
        F.struct(F.lit(True).alias("_found"), *payload).alias(_VALUE),
    )
    match = [F.col(_SLOT) == F.col(_DIM_SLOT), *[F.col(k) == F.col(f"_dim_{k}") for k in keys]]
    joined = slotted.join(known, _all(match), how)
    if how in ("left_semi", "left_anti"):
        return joined.select(*facts.columns)
    return joined.select(*facts.columns, *[F.col(_VALUE)[c].alias(c) for c in payload])
