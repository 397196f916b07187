"""Months as ``INT yyyymm``, date parsing, and the period arithmetic a caller needs on the driver."""

from __future__ import annotations

from calendar import monthrange
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

PAYDAY = 25
EARLIEST_PAYDAY = 20


def ym_of(c: Column) -> Column:
    return F.year(c) * 100 + F.month(c)


def ymd_int(c: Column) -> Column:
    return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)


def next_ym(ym: Column) -> Column:
    return F.when(ym % 100 == 12, ym + 89).otherwise(ym + 1)


def previous_ym(ym: Column) -> Column:
    return F.when(ym % 100 == 1, ym - 89).otherwise(ym - 1)


def first_day_of(ym: Column) -> Column:
    return F.make_date((ym / 100).cast("int"), ym % 100, F.lit(1))


def bank_date(c: Column) -> Column:
    return F.try_to_date(c, "yyyyMMdd")


def card_date(c: Column) -> Column:
    return F.try_to_date(c, "dd-MM-yyyy")


# Parameter arithmetic: a handful of values, worked out before a plan is built.


def add_months(ym: int, delta: int) -> int:
    months = (ym // 100) * 12 + ym % 100 - 1 + delta
    return months // 12 * 100 + months % 12 + 1


def months_between(from_ym: int, to_ym: int) -> int:
    """Number of months from ``from_ym`` to ``to_ym``, both included; 0 when reversed."""
    span = (to_ym // 100 - from_ym // 100) * 12 + to_ym % 100 - from_ym % 100 + 1
    return max(span, 0)


def default_range(to_ym: int) -> tuple[int, int]:
    """The twelve months that end in ``to_ym``."""
    return add_months(to_ym, -11), to_ym


def ordered_range(from_ym: int, to_ym: int) -> tuple[int, int]:
    return (to_ym, from_ym) if from_ym > to_ym else (from_ym, to_ym)


@dataclass(frozen=True)
class Cycle:
    """How days fall into named months: by calendar, or from payday to payday.

    ``paydays`` holds the known start day per named month; a month without one starts on the 25th of the month
    before it.
    """

    by_payday: bool = False
    paydays: Mapping[int, date] | None = None

    def start(self, ym: int) -> date:
        if not self.by_payday:
            return date(ym // 100, ym % 100, 1)
        if self.paydays and ym in self.paydays:
            return self.paydays[ym]
        before = add_months(ym, -1)
        return date(before // 100, before % 100, PAYDAY)

    def end(self, ym: int) -> date:
        if not self.by_payday:
            return date(ym // 100, ym % 100, monthrange(ym // 100, ym % 100)[1])
        return self.start(add_months(ym, 1)) - timedelta(days=1)

    def bounds(self, from_ym: int, to_ym: int) -> tuple[date, date]:
        return self.start(from_ym), self.end(to_ym)

    def month_of(self, day: date) -> int:
        ym = day.year * 100 + day.month
        if self.by_payday and day >= self.start(add_months(ym, 1)):
            return add_months(ym, 1)
        return ym


CALENDAR = Cycle()


def period_presets(today: date, cycle: Cycle = CALENDAR) -> dict[str, tuple[int, int]]:
    """Named shortcuts relative to today, as (from, to) months."""
    this = cycle.month_of(today)
    year, month = divmod(this, 100)
    quarter = year * 100 + (month - 1) // 3 * 3 + 1
    last_quarter = add_months(quarter, -3)
    last = add_months(this, -1)
    return {
        "this_year": (year * 100 + 1, this),
        "this_quarter": (quarter, min(add_months(quarter, 2), this)),
        "last_quarter": (last_quarter, add_months(last_quarter, 2)),
        "this_month": (this, this),
        "last_month": (last, last),
    }
