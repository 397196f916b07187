"""Table schemas. They are explicit and checked on read; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
SCORE = T.DecimalType(6, 4)


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


_LABELS = (
    ("category", T.StringType()),
    ("subcategory", T.StringType()),
    ("merchant", T.StringType()),
    ("similarity", SCORE),
    ("orig_category", T.StringType()),
    ("orig_subcategory", T.StringType()),
)

BANK = _struct(
    ("id", T.LongType()),
    ("tx_id", T.StringType()),
    ("tx_date", T.DateType()),
    ("ym", T.IntegerType()),
    ("description", T.StringType()),
    ("account", T.StringType()),
    ("counter_account", T.StringType()),
    ("code", T.StringType()),
    ("direction", T.StringType()),
    ("amount", MONEY),
    ("mutation_kind", T.StringType()),
    ("memo", T.StringType()),
    ("balance_after", MONEY),
    *_LABELS,
)

CARD = _struct(
    ("id", T.LongType()),
    ("tx_id", T.StringType()),
    ("tx_date", T.DateType()),
    ("ym", T.IntegerType()),
    ("description", T.StringType()),
    ("account", T.StringType()),
    ("card_type", T.StringType()),
    ("token", T.StringType()),
    ("direction", T.StringType()),
    ("amount", MONEY),
    *_LABELS,
)

SUGGESTION = _struct(
    ("src", T.StringType()),
    ("tx_id", T.StringType()),
    ("category", T.StringType()),
    ("subcategory", T.StringType()),
    ("score", SCORE),
    ("unanimous", T.BooleanType()),
    ("neighbor_n", T.LongType()),
    ("layer", T.StringType()),
    ("disagrees", T.BooleanType()),
)

TERM = _struct(
    ("namespace", T.StringType()),
    ("source", T.StringType()),
    ("locale", T.StringType()),
    ("text", T.StringType()),
)

# Fields a vector point may carry beside its id and vector. No free text among them.
PAYLOAD = (
    "src",
    "tx_id",
    "category",
    "subcategory",
    "merchant",
    "direction",
    "account",
    "year",
    "month",
    "flow_kind",
    "corrected",
)


class SchemaMismatch(ValueError):
    """A table lacks columns or has other types than its schema says."""


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order; fails when a column is missing or has another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f.name for f in schema.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise SchemaMismatch(f"missing or differently typed columns: {', '.join(wrong)}")
    return df.select(*schema.fieldNames())
