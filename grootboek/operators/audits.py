"""Audits and profiles of the ledgers: counts and sums, never rows with personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grootboek.functions.dates import ym_of
from grootboek.functions.text import looks_secret, redact, strip, text_or_empty
from grootboek.vocabulary import DEFAULT, Vocabulary

GROUP_LIMIT = 40
LABEL_LIMIT = 40


def _measures(*extra: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), *extra]


def _credits(bank: DataFrame, v: Vocabulary) -> DataFrame:
    return bank.where(F.col("direction") == v.credit)


def credit_buckets(bank: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """Bank credits by what they are."""
    bucket = (
        F.when(F.col("category") == v.internal_category, "internal")
        .when(F.col("subcategory").isin(*v.saving_subs), "saving")
        .when(F.col("category") == v.income_category, "income")
        .otherwise("refund_or_other")
    )
    return _credits(bank, v).groupBy(bucket.alias("bucket")).agg(*_measures()).orderBy(F.desc("n"), "bucket")


def income_subs(bank: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """Income per subcategory, with a mark for those that are income in their own right."""
    income = _credits(bank, v).where(F.col("category") == v.income_category)
    real = F.coalesce(F.col("subcategory").isin(*v.real_income_subs, v.withdrawal_sub), F.lit(False))
    counts = income.groupBy("subcategory").agg(*_measures()).withColumn("real_income", real)
    return counts.orderBy(F.desc("n"), "subcategory")


def other_income_merchants(bank: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    other = (F.col("category") == v.default_credit_pair[0]) & (F.col("subcategory") == v.default_credit_pair[1])
    extremes = (F.min("amount").alias("smallest"), F.max("amount").alias("largest"))
    groups = _credits(bank, v).where(other).groupBy("merchant").agg(*_measures(*extremes))
    return groups.orderBy(F.desc("n"), F.desc("amount"), "merchant")


def income_expense_overlap(bank: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """Merchants that bring income and also take spending. Both sides are aggregated before they meet."""
    named = bank.where(F.col("merchant") != "")
    income = (
        _credits(named, v)
        .where(F.col("category") == v.income_category)
        .groupBy("merchant", F.col("subcategory").alias("income_sub"))
        .agg(F.count(F.lit(1)).alias("n_in"), F.sum("amount").alias("amount_in"))
    )
    spending = (
        named.where(F.col("direction") == v.debit)
        .where(~F.col("category").isin(v.income_category, v.internal_category))
        .where(~F.col("subcategory").isin(v.deposit_sub, v.settlement_pair[1]))
        .groupBy("merchant")
        .agg(
            F.count(F.lit(1)).alias("n_out"),
            F.sum("amount").alias("amount_out"),
            F.min("category").alias("category_out"),
            F.min("subcategory").alias("subcategory_out"),
        )
    )
    return income.join(spending, "merchant").orderBy(F.desc("n_in"), F.desc("n_out"), "merchant", "income_sub")


def saving_merchants(bank: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """Who savings withdrawals name; a shop among them is a mistake."""
    extremes = (F.min("amount").alias("smallest"), F.max("amount").alias("largest"))
    rows = _credits(bank, v).where(F.col("subcategory") == v.withdrawal_sub)
    return rows.groupBy("merchant").agg(*_measures(*extremes)).orderBy(F.desc("n"), "merchant")


def _booked_as_refund(bank: DataFrame, v: Vocabulary) -> DataFrame:
    rows = _credits(bank, v).where(~F.col("category").isin(v.income_category, v.internal_category))
    return rows.where(~F.col("subcategory").isin(*v.saving_subs))


def refund_groups(bank: DataFrame, limit: int = GROUP_LIMIT, v: Vocabulary = DEFAULT) -> DataFrame:
    """The largest groups of credits already booked against a spending category."""
    groups = _booked_as_refund(bank, v).groupBy("category", "subcategory", "merchant").agg(*_measures())
    return groups.orderBy(F.desc("n"), F.desc("amount"), "category", "subcategory", "merchant").limit(limit)


def refund_total(bank: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    return _booked_as_refund(bank, v).agg(*_measures())


def charging(bank: DataFrame, subs: tuple[str, str] | None = None, v: Vocabulary = DEFAULT) -> DataFrame:
    """A reimbursement next to the cost it repays, per merchant; car charging by default."""
    rows = bank.where(F.col("subcategory").isin(*(subs or v.charging_subs)))
    groups = rows.groupBy("category", "subcategory", "direction", "merchant").agg(*_measures())
    return groups.orderBy("subcategory", "direction", F.desc("n"), "category", "merchant")


def card_credits(card: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    groups = card.where(F.col("direction") == v.credit).groupBy("card_type", "direction", "category", "subcategory")
    return groups.agg(*_measures()).orderBy(F.desc("n"), "card_type", "category", "subcategory")


def id_lengths(ledger: DataFrame) -> DataFrame:
    length = F.length("tx_id")
    return ledger.groupBy("src").agg(
        F.min(length).alias("id_min"),
        F.max(length).alias("id_max"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("tx_id").alias("distinct_ids"),
    )


def hash_recipe(table: DataFrame, parts: list[str], control: list[str], id_column: str = "tx_id") -> DataFrame:
    """How many stored ids equal the MD5 of ``parts``, and how many that of a control recipe."""
    stored = F.lower(F.trim(id_column))

    def equals(columns: list[str]) -> Column:
        return F.md5(F.concat(*[text_or_empty(F.col(c).cast("string")) for c in columns])) == stored

    return table.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(equals(parts)).alias("matched"),
        F.count_if(equals(control)).alias("control_matched"),
    )


def id_overlap(raw: DataFrame, ledger: DataFrame) -> DataFrame:
    """Number of (raw row, ledger row) pairs that share an id, from counts per id rather than from the pairs."""

    def per_id(table: DataFrame, name: str) -> DataFrame:
        trimmed = table.select(F.trim("tx_id").alias("tx_id")).where(F.col("tx_id").isNotNull())
        return trimmed.groupBy("tx_id").agg(F.count(F.lit(1)).alias(name))

    both = per_id(raw, "raw_n").join(per_id(ledger, "ledger_n"), "tx_id")
    pairs = F.coalesce(F.sum(F.col("raw_n") * F.col("ledger_n")), F.lit(0))
    return both.agg(pairs.alias("id_join"))


# The columns whose words are profiled.
PROFILED = ("category", "subcategory", "direction", "mutation_kind", "merchant", "account", "code")


def frequencies(table: DataFrame, columns: tuple[str, ...] = PROFILED) -> DataFrame:
    """How often each word occurs per column, in one pass. Values that look like an account are masked."""
    present = [c for c in columns if c in table.columns]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in present])
    words = table.select(F.explode(cells).alias("c")).groupBy("c.column", "c.value")
    counts = words.agg(F.count(F.lit(1)).alias("n"))
    masked = F.concat(F.lit("<redacted len="), F.length("value"), F.lit(">"))
    shown = F.when(F.col("value").isNull(), "<NULL>").when(looks_secret(F.col("value")), masked)
    return counts.select("column", shown.otherwise(F.col("value")).alias("value"), "n")


def counter_accounts(bank: DataFrame) -> DataFrame:
    """Counter accounts: distinct values, plain labels, rows with something account-like, empty rows."""
    counts = bank.groupBy("counter_account").agg(F.count(F.lit(1)).alias("n"))
    empty = strip(F.col("counter_account")) == ""
    secret = ~empty & looks_secret(F.col("counter_account"))
    return counts.agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.count_if(~empty & ~secret).alias("label_values"),
        F.coalesce(F.sum(F.when(secret, F.col("n"))), F.lit(0)).alias("secret_like_rows"),
        F.coalesce(F.sum(F.when(empty, F.col("n"))), F.lit(0)).alias("empty_rows"),
    )


def counter_account_labels(bank: DataFrame, limit: int = LABEL_LIMIT) -> DataFrame:
    """The most frequent counter accounts that are labels, not account numbers."""
    named = bank.where(strip(F.col("counter_account")) != "")
    labels = named.groupBy("counter_account").agg(F.count(F.lit(1)).alias("n"))
    plain = labels.where(~looks_secret(F.col("counter_account")))
    return plain.orderBy(F.desc("n"), "counter_account").limit(limit)


def pair_counts(ledger: DataFrame) -> DataFrame:
    groups = ledger.groupBy("src", "category", "subcategory", "direction").agg(F.count(F.lit(1)).alias("n"))
    return groups.orderBy("src", "category", "subcategory", "direction")


def hypotheses(ledger: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """Counts behind the classification rules, all in one aggregate per source."""
    category, sub = F.col("category"), F.col("subcategory")
    repaid = category == v.repayment_pair[0]
    return ledger.groupBy("src").agg(
        F.count_if(category == v.internal_category).alias("internal_category"),
        F.count_if(sub == v.settlement_pair[1]).alias("settlement_sub"),
        F.count_if(sub == v.deposit_sub).alias("deposit_sub"),
        F.count_if(sub == v.withdrawal_sub).alias("withdrawal_sub"),
        F.count_if(repaid).alias("repayment_category"),
        F.count_if(repaid & (F.col("direction") == v.credit)).alias("repayment_credit"),
    )


def date_range(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("src").agg(F.min("tx_date").alias("first_date"), F.max("tx_date").alias("last_date"))


def months(ledger: DataFrame) -> DataFrame:
    """Rows per source and calendar month."""
    counts = ledger.groupBy("src", ym_of(F.col("tx_date")).alias("ym")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy("src", "ym")


def shown_merchant(c: Column, limit: int = 40) -> Column:
    """A merchant as an audit prints it."""
    return redact(F.when(text_or_empty(c) == "", F.lit("(leeg)")).otherwise(c), limit)
