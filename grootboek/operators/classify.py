"""One ledger out of two: flow kinds, the union, transfer legs and row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grootboek.functions.text import contains_any
from grootboek.vocabulary import (
    DEFAULT,
    EXPENSE,
    INCOME,
    INTERNAL,
    REFUND,
    SAVING,
    SETTLEMENT,
    STRUCTURAL_KINDS,
    UNCLASSIFIED,
    Vocabulary,
)

LEDGER_COLUMNS = (
    "src",
    "id",
    "tx_id",
    "tx_date",
    "ym",
    "account",
    "counter_account",
    "direction",
    "amount",
    "category",
    "subcategory",
    "description",
    "merchant",
    "orig_category",
    "orig_subcategory",
    "similarity",
    "card_type",
    "flow_kind",
)


def bank_flow_kind(v: Vocabulary = DEFAULT) -> Column:
    """First match wins: transfers and settlements before savings, savings before income and spending."""
    category, sub, direction = F.col("category"), F.col("subcategory"), F.col("direction")
    settles = (
        (category == v.settlement_pair[0])
        & (sub == v.settlement_pair[1])
        & (direction == v.debit)
        & (F.col("account") == v.card_account)
    )
    return (
        F.when(category == v.internal_category, INTERNAL)
        .when(settles, SETTLEMENT)
        .when(sub.isin(*v.saving_subs), SAVING)
        .when((direction == v.credit) & (category == v.income_category), INCOME)
        .when(direction == v.credit, REFUND)
        .when(direction == v.debit, EXPENSE)
        .otherwise(UNCLASSIFIED)
    )


def card_flow_kind(v: Vocabulary = DEFAULT) -> Column:
    direction, card_type = F.col("direction"), F.col("card_type")
    return (
        F.when((direction == v.credit) & (card_type == v.collection_type), SETTLEMENT)
        .when((direction == v.debit) & card_type.isin(*v.charge_types), EXPENSE)
        .when(F.col("category") == v.internal_category, INTERNAL)
        .when(direction == v.credit, REFUND)
        .when(direction == v.debit, EXPENSE)
        .otherwise(UNCLASSIFIED)
    )


def unify(bank: DataFrame, card: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """Both ledgers under common columns. Filters and pruning reach each scan through the union."""
    no_text = F.lit(None).cast("string")
    left = bank.withColumns({"src": F.lit("bank"), "card_type": no_text, "flow_kind": bank_flow_kind(v)})
    right = card.withColumns({"src": F.lit("cc"), "counter_account": no_text, "flow_kind": card_flow_kind(v)})
    return left.select(*LEDGER_COLUMNS).unionByName(right.select(*LEDGER_COLUMNS))


def without_structural(ledger: DataFrame) -> DataFrame:
    return ledger.where(~F.col("flow_kind").isin(*STRUCTURAL_KINDS))


def chosen(category: str | None = None, subcategory: str | None = None) -> Column:
    """The optional category and subcategory filter; true for every row when neither is given."""
    keep = F.lit(True)
    if category:
        keep = keep & (F.col("category") == category)
    if subcategory:
        keep = keep & (F.col("subcategory") == subcategory)
    return keep


#: The columns that a search looks into.
SEARCHED = ("description", "merchant", "category", "subcategory")


def search(ledger: DataFrame, needle: str) -> DataFrame:
    """Rows whose description, merchant or labels contain the text, ignoring case."""
    if not needle:
        return ledger
    return ledger.where(contains_any([F.col(c) for c in SEARCHED], needle))


def is_structural_pair(category: Column, subcategory: Column, v: Vocabulary = DEFAULT) -> Column:
    """Labels that mark moves between own accounts; no correction may set them."""
    settlement = (category == v.settlement_pair[0]) & (subcategory == v.settlement_pair[1])
    return F.coalesce((category == v.internal_category) | settlement, F.lit(False))


def known_counterpart(c: Column, v: Vocabulary = DEFAULT) -> Column:
    """Only the names of own accounts and savings pots pass; anything else becomes NULL."""
    return F.when(c.isin(*v.saving_counterparts) | c.startswith(v.account_prefix), c)


def transfer_legs(ledger: DataFrame, card_merchant: bool = False, v: Vocabulary = DEFAULT) -> DataFrame:
    """Adds ``from_account`` and ``to_account``.

    The other side is the counter account, else the merchant. Card rows have no counter account; their merchant
    counts only where ``card_merchant`` asks for it.
    """
    merchant = F.col("merchant")
    if not card_merchant:
        merchant = F.when(F.col("src") == "bank", merchant)
    other = F.coalesce(known_counterpart(F.col("counter_account"), v), known_counterpart(merchant, v))
    outgoing = F.coalesce(F.col("direction") == v.debit, F.lit(False))
    return ledger.withColumns(
        {
            "from_account": F.when(outgoing, F.col("account")).otherwise(other),
            "to_account": F.when(outgoing, other).otherwise(F.col("account")),
        }
    )


def on_leg(legs: DataFrame, from_account: str | None, to_account: str | None) -> DataFrame:
    """Transfers on one leg; None asks for an unknown side."""
    return legs.where(
        F.col("from_account").eqNullSafe(F.lit(from_account or None).cast("string"))
        & F.col("to_account").eqNullSafe(F.lit(to_account or None).cast("string"))
    )
