"""Stable ids and validation of keys and parameters."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

from grootboek.functions.text import text_or_empty

SOURCES = ("bank", "cc")
DEFAULT_THRESHOLD = Decimal("0.70")

# RFC 4122 namespace for names that are URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def _md5_of(*parts: Column) -> Column:
    return F.md5(F.concat(*[text_or_empty(p.cast("string")) for p in parts]))


def bank_tx_id(date: Column, description: Column, memo: Column, balance: Column) -> Column:
    """MD5 of the four raw cells, no separator, missing counts as empty."""
    return _md5_of(date, description, memo, balance)


def card_tx_id(date: Column, description: Column, card_type: Column, token: Column) -> Column:
    return _md5_of(date, description, card_type, token)


def point_id(src: Column, tx_id: Column, prefix: str = "ledger") -> Column:
    """Name-based UUID (version 5) of ``prefix:src:tx_id``."""
    name = F.concat_ws(":", F.lit(prefix), src, tx_id)
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def valid_tx_id(c: Column) -> Column:
    """Lower-cased id where it is 32 hex digits, else NULL."""
    return F.when(c.rlike(r"^[0-9a-fA-F]{32}$"), F.lower(c))


def valid_source(c: Column) -> Column:
    return F.when(c.isin(*SOURCES), c)


def parse_threshold(raw: object) -> Decimal:
    """A threshold between 0 and 1 with two decimals; the default when it is anything else."""
    try:
        value = Decimal(str(raw))
    except InvalidOperation:
        return DEFAULT_THRESHOLD
    if not value.is_finite() or not 0 <= value <= 1:
        return DEFAULT_THRESHOLD
    return value.quantize(Decimal("0.01"))


def score_as_similarity(score: Column) -> Column:
    """What ``parse_threshold`` makes of a stored score, row by row."""
    inside = score.between(0, 1)
    rounded = F.bround(score.cast("decimal(10,6)"), 2).cast("decimal(6,4)")
    default = F.lit(DEFAULT_THRESHOLD).cast("decimal(6,4)")
    return F.when(score.isNull(), F.lit(None).cast("decimal(6,4)")).when(inside, rounded).otherwise(default)
