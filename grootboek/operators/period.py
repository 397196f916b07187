"""Periods, month buckets and pay cycles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grootboek.functions.dates import (
    CALENDAR,
    EARLIEST_PAYDAY,
    PAYDAY,
    add_months,
    first_day_of,
    months_between,
    next_ym,
    previous_ym,
    ym_of,
)
from grootboek.vocabulary import DEFAULT, Vocabulary


@dataclass(frozen=True)
class Period:
    """Months ``from_ym`` to ``to_ym``, both included, for one account or all."""

    from_ym: int
    to_ym: int
    account: str | None = None

    @property
    def n_months(self) -> int:
        return months_between(self.from_ym, self.to_ym)

    def months(self) -> Column:
        """The months of the period as an array of ``yyyymm``."""
        first = self.from_ym // 100 * 12 + self.from_ym % 100 - 1
        index = F.sequence(F.lit(first), F.lit(first + self.n_months - 1))
        return F.transform(index, lambda i: (F.floor(i / 12) * 100 + i % 12 + 1).cast("int"))


def month_spine(spark: SparkSession, period: Period) -> DataFrame:
    """One row per month of the period."""
    if not period.n_months:
        return spark.range(0).select(F.col("id").cast("int").alias("ym"))
    return spark.range(1).select(F.explode(period.months()).alias("ym"))


def _for_account(ledger: DataFrame, account: str | None) -> DataFrame:
    return ledger.where(F.col("account") == account) if account else ledger


def payday_starts(bank: DataFrame, period: Period, v: Vocabulary = DEFAULT) -> DataFrame:
    """Start day per named month, one month before the period to two after it.

    A named month starts in the calendar month before it, on the earliest day from the 20th to the 25th that brought
    salary, or on the 25th. Columns: ``named_ym``, ``calendar_ym``, ``payday``, ``start_date``.
    """
    named = Period(add_months(period.from_ym, -1), add_months(period.to_ym, 2))
    first, last = add_months(named.from_ym, -1), add_months(named.to_ym, -1)
    day = F.dayofmonth("tx_date")
    seen = (
        bank.where(F.col("ym").between(first, last))
        .where(F.col("category") == v.income_category)
        .where(F.col("subcategory") == v.salary_sub)
        .where(F.col("direction") == v.credit)
        .where(day.between(EARLIEST_PAYDAY, PAYDAY))
        .groupBy(F.col("ym").alias("calendar_ym"))
        .agg(F.min(day).alias("seen_day"))
    )
    spine = month_spine(bank.sparkSession, named).select(
        F.col("ym").alias("named_ym"), previous_ym(F.col("ym")).alias("calendar_ym")
    )
    payday = F.coalesce("seen_day", F.lit(PAYDAY))
    # ``seen`` has at most one row per month of the period.
    return spine.join(F.broadcast(seen), "calendar_ym", "left").select(
        "named_ym",
        "calendar_ym",
        payday.alias("payday"),
        F.date_add(first_day_of(F.col("calendar_ym")), payday - 1).alias("start_date"),
    )


def in_period(ledger: DataFrame, period: Period) -> DataFrame:
    """Rows of the period, ``bucket`` being the calendar month."""
    low, high = CALENDAR.bounds(period.from_ym, period.to_ym)
    rows = ledger.where(F.col("ym").between(period.from_ym, period.to_ym))
    rows = rows.where(F.col("tx_date").between(F.lit(low), F.lit(high)))
    return _for_account(rows, period.account).withColumn("bucket", F.col("ym"))


def in_pay_cycle(ledger: DataFrame, period: Period, starts: DataFrame) -> DataFrame:
    """Rows whose pay-cycle month lies in the period; ``bucket`` is that month.

    A day belongs to the next named month from its own calendar month's payday on, so the bucket needs one equality
    join on the month. ``starts`` has one row per month of the period, which is why it is broadcast.
    """
    rows = ledger.where(F.col("ym").between(add_months(period.from_ym, -1), period.to_ym))
    rows = _for_account(rows, period.account)
    paydays = starts.select(F.col("calendar_ym").alias("_ym"), "payday")
    joined = rows.join(F.broadcast(paydays), F.col("ym") == F.col("_ym"), "left")
    opened = F.dayofmonth("tx_date") >= F.coalesce("payday", F.lit(PAYDAY))
    bucket = F.when(opened, next_ym(F.col("ym"))).otherwise(F.col("ym"))
    return (
        joined.withColumn("bucket", bucket)
        .where(F.col("bucket").between(period.from_ym, period.to_ym))
        .drop("_ym", "payday")
    )


def latest_month(bank: DataFrame, by_payday: bool = False, v: Vocabulary = DEFAULT) -> DataFrame:
    """The month of the last booked day; its pay-cycle month when asked. One row, NULL when the ledger is empty."""
    day = F.dayofmonth("tx_date")
    salary = (
        (F.col("category") == v.income_category)
        & (F.col("subcategory") == v.salary_sub)
        & (F.col("direction") == v.credit)
        & day.between(EARLIEST_PAYDAY, PAYDAY)
    )
    if not by_payday:
        return bank.agg(ym_of(F.max("tx_date")).alias("ym"))
    per_month = bank.groupBy("ym").agg(
        F.max("tx_date").alias("last_day"), F.min(F.when(salary, day)).alias("seen_day")
    )
    last = per_month.agg(F.max(F.struct("last_day", "ym", "seen_day")).alias("m"))
    opened = F.dayofmonth("m.last_day") >= F.coalesce("m.seen_day", F.lit(PAYDAY))
    return last.select(F.when(opened, next_ym(F.col("m.ym"))).otherwise(F.col("m.ym")).alias("ym"))


def year_bounds(ledger: DataFrame, empty: tuple[int, int] = (2024, 2026)) -> DataFrame:
    """First and last year over both ledgers, with defaults for an empty one."""
    year = F.year("tx_date")
    return ledger.agg(
        F.coalesce(F.min(year), F.lit(empty[0])).alias("first_year"),
        F.coalesce(F.max(year), F.lit(empty[1])).alias("last_year"),
    )
