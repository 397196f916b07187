"""Reports over the unified ledger.

Each takes rows already cut to a period (``in_period`` or ``in_pay_cycle``), so one report serves both kinds of
month. All of them are hash aggregates with partial aggregation; amounts stay decimal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grootboek.functions.money import MONEY, signed_net, total
from grootboek.functions.text import redact
from grootboek.operators.classify import chosen, on_leg, transfer_legs
from grootboek.operators.period import Period, month_spine
from grootboek.vocabulary import (
    DEFAULT,
    EXPENSE,
    INCOME,
    INTERNAL,
    LIST_KINDS,
    REFUND,
    SAVING,
    SETTLEMENT,
    UNCLASSIFIED,
    Vocabulary,
)

LIST_LIMIT = 200


def _net() -> Column:
    return F.coalesce(F.sum(signed_net(F.col("flow_kind"), F.col("amount"), EXPENSE, REFUND)), F.lit(0).cast(MONEY))


def kpis(
    rows: DataFrame,
    n_months: int,
    category: str | None = None,
    subcategory: str | None = None,
    v: Vocabulary = DEFAULT,
) -> DataFrame:
    """The dashboard figures in one scan and one aggregate.

    Category filters apply to spending and income only; transfers, savings and settlements ignore them.
    """
    keep = chosen(category, subcategory)
    out, back = F.col("direction") == v.debit, F.col("direction") == v.credit
    sums = rows.agg(
        total(keep & (F.col("flow_kind") == EXPENSE), F.col("amount")).alias("expense"),
        total(keep & (F.col("flow_kind") == REFUND), F.col("amount")).alias("refund"),
        total(keep & (F.col("flow_kind") == INCOME), F.col("amount")).alias("income"),
        total((F.col("flow_kind") == INTERNAL) & out, F.col("amount")).alias("internal"),
        total((F.col("flow_kind") == SAVING) & out, F.col("amount")).alias("saving_in"),
        total((F.col("flow_kind") == SAVING) & back, F.col("amount")).alias("saving_out"),
        total((F.col("flow_kind") == SETTLEMENT) & (F.col("src") == "bank"), F.col("amount")).alias("cc"),
    )
    net = F.col("expense") - F.col("refund")
    months = F.lit(max(n_months, 1))
    return sums.withColumns(
        {
            "expenses_net": net,
            "delta": F.col("income") - net,
            "saving": F.col("saving_in") - F.col("saving_out"),
            "avg_month": net / months,
            "avg_income": F.col("income") / months,
            "n_months": months,
        }
    )


def net_by(rows: DataFrame, label: str, category: str | None = None, subcategory: str | None = None) -> DataFrame:
    """Net spending per ``category`` or ``subcategory``, zeros left out, largest first."""
    return (
        rows.where(chosen(category, subcategory))
        .groupBy(F.col(label).alias("label"))
        .agg(
            total(F.col("flow_kind") == EXPENSE, F.col("amount")).alias("expense"),
            total(F.col("flow_kind") == REFUND, F.col("amount")).alias("refund"),
            _net().alias("net"),
        )
        .where(F.col("net") != 0)
        .orderBy(F.desc("net"), "label")
    )


def income_by_sub(rows: DataFrame) -> DataFrame:
    return (
        rows.where(F.col("flow_kind") == INCOME)
        .groupBy(F.col("subcategory").alias("label"))
        .agg(total(F.lit(True), F.col("amount")).alias("amount"), F.count(F.lit(1)).alias("n"))
        .where(F.col("amount") != 0)
        .orderBy(F.desc("amount"), "label")
    )


def _dense(sums: DataFrame, period: Period, key: str, values: list[str]) -> DataFrame:
    """Every key in every month, zero where it has no rows. Grows with keys x months, never with rows.

    ``sums`` has one row per key and month, so a key's months fit in a map, and the rows are read once.
    """
    by_month = F.map_from_entries(F.collect_list(F.struct("ym", F.struct(*values))))
    keyed = sums.groupBy(key).agg(by_month.alias("_by")).withColumn("ym", F.explode(period.months()))
    at = F.col("_by")[F.col("ym")]
    return keyed.select("ym", key, *[F.coalesce(at[c], F.lit(0).cast(MONEY)).alias(c) for c in values])


def monthly_stack(
    rows: DataFrame,
    period: Period,
    label: str = "category",
    category: str | None = None,
    subcategory: str | None = None,
) -> DataFrame:
    """Net spending per month and label. A missing label and an empty one are the same label."""
    sums = (
        rows.where(chosen(category, subcategory))
        .groupBy(F.col("bucket").alias("ym"), F.coalesce(label, F.lit("")).alias("label"))
        .agg(_net().alias("net"))
    )
    return _dense(sums, period, "label", ["net"]).orderBy("label", "ym")


def income_vs_expense(
    rows: DataFrame,
    period: Period,
    category: str | None = None,
    subcategory: str | None = None,
    v: Vocabulary = DEFAULT,
) -> DataFrame:
    """Income and net spending per month for the accounts on the chart, in chart order."""
    accounts = v.chart_accounts(period.account)
    sums = (
        rows.where(chosen(category, subcategory) & F.col("account").isin(*accounts))
        .groupBy(F.col("bucket").alias("ym"), "account")
        .agg(total(F.col("flow_kind") == INCOME, F.col("amount")).alias("income"), _net().alias("expenses"))
    )
    zero = F.lit(0).cast(MONEY)
    zeros = month_spine(rows.sparkSession, period).select(
        "ym",
        F.explode(F.array(*[F.lit(a) for a in accounts])).alias("account"),
        zero.alias("income"),
        zero.alias("expenses"),
    )
    dense = sums.unionByName(zeros).groupBy("ym", "account")
    place = F.array_position(F.array(*[F.lit(a) for a in accounts]), F.col("account"))
    return dense.agg(F.sum("income").alias("income"), F.sum("expenses").alias("expenses")).orderBy(place, "ym")


def transfers_monthly(rows: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    legs = transfer_legs(rows.where(F.col("flow_kind") == INTERNAL), v=v)
    return (
        legs.groupBy(F.col("bucket").alias("ym"), "from_account", "to_account")
        .agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
        .orderBy("ym", F.coalesce("from_account", F.lit("")), F.coalesce("to_account", F.lit("")))
    )


def transfer_totals(monthly: DataFrame) -> DataFrame:
    return (
        monthly.groupBy("from_account", "to_account")
        .agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))
        .orderBy(F.desc("amount"), F.coalesce("from_account", F.lit("")), F.coalesce("to_account", F.lit("")))
    )


def saving_monthly(rows: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """Deposits and withdrawals per month and account; here the subcategory must fit the direction too."""
    deposit = (F.col("subcategory") == v.deposit_sub) & (F.col("direction") == v.debit)
    withdrawal = (F.col("subcategory") == v.withdrawal_sub) & (F.col("direction") == v.credit)
    return (
        rows.where(F.col("flow_kind") == SAVING)
        .groupBy(F.col("bucket").alias("ym"), "account")
        .agg(
            total(deposit, F.col("amount")).alias("deposit"),
            total(withdrawal, F.col("amount")).alias("withdrawal"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("net", F.col("deposit") - F.col("withdrawal"))
        .orderBy("ym", "account")
    )


def saving_series(monthly: DataFrame, period: Period) -> DataFrame:
    """Savings per month over all accounts, every month present."""
    values = ["deposit", "withdrawal", "net"]
    zeros = month_spine(monthly.sparkSession, period).select(
        "ym", *[F.lit(0).cast(MONEY).alias(c) for c in values]
    )
    inside = monthly.where(F.col("ym").between(period.from_ym, period.to_ym)).select("ym", *values)
    return inside.unionByName(zeros).groupBy("ym").agg(*[F.sum(c).alias(c) for c in values]).orderBy("ym")


def saving_by_account(monthly: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("deposit", "withdrawal", "net", "n")]
    return monthly.groupBy("account").agg(*sums).orderBy(F.coalesce("account", F.lit("")))


def refund_monthly(rows: DataFrame, category: str | None = None, subcategory: str | None = None) -> DataFrame:
    return (
        rows.where(chosen(category, subcategory) & (F.col("flow_kind") == REFUND))
        .groupBy(F.col("bucket").alias("ym"), "category", "subcategory", "account")
        .agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
        .orderBy("ym", "category", "subcategory", "account")
    )


def unclassified_count(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("flow_kind") == UNCLASSIFIED).agg(F.count(F.lit(1)).alias("n"))


def _labelled() -> Column:
    return (F.col("category") != "") & (F.col("subcategory") != "")


def category_pairs(ledger: DataFrame) -> DataFrame:
    """Every (category, subcategory) in use."""
    return ledger.where(_labelled()).select("category", "subcategory").distinct()


def allowed_pairs(ledger: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """Pairs in use plus the scheme's extra pairs."""
    extra = ledger.sparkSession.createDataFrame(list(v.extra_pairs), "category string, subcategory string")
    return category_pairs(ledger).unionByName(extra).distinct()


def own_accounts(ledger: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    return ledger.where(F.col("account").isin(*v.own_accounts)).select("account").distinct()


def unique_category_for_sub(ledger: DataFrame) -> DataFrame:
    """Per subcategory its category, NULL where it occurs under more than one."""
    pairs = ledger.where(F.col("category") != "").select("category", "subcategory").distinct()
    only = F.when(F.count(F.lit(1)) == 1, F.min("category"))
    return pairs.groupBy("subcategory").agg(only.alias("category"))


# Translation namespaces and the columns whose words they hold.
NAMESPACES = {
    "hoofd": "category",
    "sub": "subcategory",
    "af_bij": "direction",
    "rekening": "account",
    "mutatiesoort": "mutation_kind",
    "cc_type": "card_type",
}


def _words(ledger: DataFrame) -> DataFrame:
    present = {ns: c for ns, c in NAMESPACES.items() if c in ledger.columns}
    pairs = F.array(
        *[F.struct(F.lit(ns).alias("namespace"), F.col(c).alias("source")) for ns, c in present.items()]
    )
    words = ledger.select(F.explode(pairs).alias("w")).select("w.namespace", "w.source")
    return words.where(F.col("source") != "").distinct()


def vocabulary(bank: DataFrame, card: DataFrame) -> DataFrame:
    """Distinct words per translation namespace over both ledgers."""
    return _words(bank).unionByName(_words(card)).distinct()


def translate(report: DataFrame, terms: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Replace label columns by their translation; a label without one stays as it is.

    ``columns`` maps a label column to its namespace. Run it on a finished report: labels are few by then, and
    whether the terms are broadcast is left to their measured size.
    """
    out = report
    for column, namespace in columns.items():
        words = terms.where(F.col("namespace") == namespace)
        words = words.select(F.col("source").alias("_source"), F.col("text").alias("_text"))
        out = out.join(words, F.col(column) == F.col("_source"), "left")
        text = F.when(F.col("_text") != "", F.col("_text"))
        out = out.withColumn(column, F.coalesce(text, F.col(column), F.lit(""))).drop("_source", "_text")
    return out


def transactions(
    rows: DataFrame,
    kind: str,
    category: str | None = None,
    subcategory: str | None = None,
    leg: tuple[str | None, str | None] | None = None,
    limit: int = LIST_LIMIT,
    v: Vocabulary = DEFAULT,
) -> DataFrame:
    """The newest transactions of a kind, redacted, at most ``limit``, with a flag that more exist.

    A transfer leg is matched before the limit applies. Category filters serve spending lists; an income list takes
    the subcategory only.
    """
    picked = rows.where(F.col("flow_kind").isin(*LIST_KINDS.get(kind, ("",))))
    if kind in ("spend", "refund"):
        picked = picked.where(chosen(category, subcategory))
    elif kind == "income":
        picked = picked.where(chosen(None, subcategory))
    elif kind == "internal" and leg is not None:
        picked = on_leg(transfer_legs(picked, card_merchant=True, v=v), *leg)
    order = [F.desc("tx_date"), F.desc("id"), F.asc("src")]
    # One row more than shown tells whether the list was cut, so the windows below see at most limit + 1 rows.
    newest = picked.orderBy(*order).limit(limit + 1)
    everything = Window.partitionBy()
    numbered = newest.withColumns(
        {
            "place": F.row_number().over(everything.orderBy(*order)),
            "truncated": F.count(F.lit(1)).over(everything) > limit,
        }
    )
    return numbered.where(F.col("place") <= limit).select(
        "place",
        "src",
        "id",
        F.date_format("tx_date", "dd-MM-yyyy").alias("date"),
        "account",
        "direction",
        "amount",
        "category",
        "subcategory",
        redact(F.col("description")).alias("description"),
        "truncated",
    )


