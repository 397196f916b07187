"""Amounts. Money is decimal from the first cast to the last sum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grootboek.functions.text import text_or_empty

MONEY = "decimal(18,2)"


def parse_amount(c: Column) -> Column:
    """``1.234,56`` or ``+ 12,50`` to a decimal; NULL where the text is no amount."""
    text = F.regexp_replace(text_or_empty(c), r"(?U)\s+", "")
    european = F.translate(text, ",.", ".")
    return F.when(F.contains(text, F.lit(",")), european).otherwise(text).try_cast(MONEY)


def hash_token(amount: Column) -> Column:
    """The shortest decimal text of an amount, as it enters the card id: ``1101.57``, ``12``, ``-12.5``, ``0``."""
    text = F.regexp_replace(amount.cast(MONEY).cast("string"), r"\.?0+$", "")
    return F.regexp_replace(text, "^-0$", "0")


def signed_net(kind: Column, amount: Column, plus: str, minus: str) -> Column:
    return F.when(kind == plus, amount).when(kind == minus, -amount).otherwise(F.lit(0))


def total(condition: Column, amount: Column) -> Column:
    """Sum of ``amount`` where ``condition`` holds, 0 when no row does."""
    return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0).cast(MONEY))
