"""Matching card collections to the bank debits that pay them.

The rule is greedy: card rows in (date, id) order each take a bank row of the same amount, two to four days later,
the shortest lag first and the lowest bank id within a day; each bank row serves once.

Within one amount the rows of a day are interchangeable apart from their order, so *how many* rows a day takes from
which bank day follows from counts per (amount, day) alone. Those counts are folded in date order, at most one entry
per calendar day; the rows themselves are never gathered. A card row's rank within its day then names the bank day
and the rank it is paid by, and the pairs come from one equality join on a unique key. A single amount that holds
a third of all rows costs no more than the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grootboek.functions.dates import CALENDAR, Cycle
from grootboek.operators.period import Period
from grootboek.vocabulary import DEFAULT, Vocabulary

# Days between the card collection and the bank debit.
SHORTEST_LAG, LONGEST_LAG = 2, 4

# Ids are unique per ledger, so a slice of this many consecutive ids bounds what one task ranks.
ID_SLICE = 1 << 20

_DAY = ["amount", "day"]
_SLICE = [*_DAY, "id_slice"]


def settlement_rows(
    bank: DataFrame, card: DataFrame, period: Period, cycle: Cycle = CALENDAR, v: Vocabulary = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """Card collections from four days before the period, and bank debits until four days after it."""
    first, last = cycle.bounds(period.from_ym, period.to_ym)

    def dated(rows: DataFrame, low: Column, high: Column) -> DataFrame:
        months = F.col("ym").between(F.year(low) * 100 + F.month(low), F.year(high) * 100 + F.month(high))
        kept = rows.where(months & F.col("tx_date").between(low, high))
        return kept.where(F.col("account") == period.account) if period.account else kept

    cards = card.where((F.col("direction") == v.credit) & (F.col("card_type") == v.collection_type))
    banks = bank.where(
        (F.col("category") == v.settlement_pair[0])
        & (F.col("subcategory") == v.settlement_pair[1])
        & (F.col("direction") == v.debit)
        & (F.col("account") == v.card_account)
    )
    return (
        dated(cards, F.date_sub(F.lit(first), LONGEST_LAG), F.lit(last)),
        dated(banks, F.lit(first), F.date_add(F.lit(last), LONGEST_LAG)),
    )


def _ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their rank inside an id slice, and per slice the number of rows before it on that day."""
    keyed = (
        rows.where(F.col("amount").isNotNull())
        .withColumn("day", F.unix_date("tx_date"))
        .withColumn("id_slice", F.floor(F.col("id") / ID_SLICE))
    )
    ranked = keyed.withColumn("slice_rank", F.row_number().over(Window.partitionBy(*_SLICE).orderBy("id")) - 1)
    sizes = keyed.groupBy(*_SLICE).agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy(*_DAY).orderBy("id_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("ahead", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return ranked, offsets


def _empty_state() -> Column:
    zero = F.lit(0).cast("bigint")
    plan = F.array().cast(
        "array<struct<day:int,from2:bigint,take2:bigint,from3:bigint,take3:bigint,from4:bigint,take4:bigint>>"
    )
    return F.struct(
        F.lit(None).cast("int").alias("day"), zero.alias("used3"), zero.alias("used4"), plan.alias("plan")
    )


def _take_day(state: Column, today: Column) -> Column:
    """One day of the fold: what today's card rows take, given what earlier days took from the same bank days.

    ``used3`` and ``used4`` count rows already taken on the bank days three and four days after the last card day;
    seen from a day or two later these are the days two and three ahead.
    """
    gap = today["day"] - state["day"]
    zero = F.lit(0).cast("bigint")
    used2 = F.when(gap == 1, state["used3"]).when(gap == 2, state["used4"]).otherwise(zero)
    used3 = F.when(gap == 1, state["used4"]).otherwise(zero)
    take2 = F.least(today["cards"], today["banks2"] - used2)
    take3 = F.least(today["cards"] - take2, today["banks3"] - used3)
    take4 = F.least(today["cards"] - take2 - take3, today["banks4"])
    entry = F.struct(
        today["day"].alias("day"),
        used2.alias("from2"),
        take2.alias("take2"),
        used3.alias("from3"),
        take3.alias("take3"),
        zero.alias("from4"),
        take4.alias("take4"),
    )
    return F.struct(
        today["day"].alias("day"),
        (used3 + take3).alias("used3"),
        take4.alias("used4"),
        F.array_append(state["plan"], entry).alias("plan"),
    )


def _day_plan(cards: DataFrame, banks: DataFrame) -> DataFrame:
    """Per amount and card day: how many rows it takes from each of the three bank days, and from which rank on."""
    none = F.lit(0).cast("bigint")
    days = (
        cards.groupBy(*_DAY)
        .agg(F.sum("size").alias("cards"))
        .withColumn("banks", none)
        .unionByName(banks.groupBy(*_DAY).agg(F.sum("size").alias("banks")).withColumn("cards", none))
        .groupBy(*_DAY)
        .agg(F.sum("cards").alias("cards"), F.sum("banks").alias("banks"))
    )
    by_day = Window.partitionBy("amount").orderBy("day")

    def banks_after(lag: int) -> Column:
        return F.coalesce(F.sum("banks").over(by_day.rangeBetween(lag, lag)), none)

    lags = range(SHORTEST_LAG, LONGEST_LAG + 1)
    offered = days.select(*_DAY, "cards", *[banks_after(lag).alias(f"banks{lag}") for lag in lags])
    wanted = offered.where(F.col("cards") > 0)
    # Days more than two apart share no bank day, so a longer gap starts a fresh fold.
    fresh = F.when(F.col("day") - F.lag("day").over(by_day) <= LONGEST_LAG - SHORTEST_LAG, 0).otherwise(1)
    chained = wanted.withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(by_day))
    entry = F.struct("day", "cards", "banks2", "banks3", "banks4")
    folded = (
        chained.groupBy("amount", "chain")
        .agg(F.array_sort(F.collect_list(entry)).alias("days"))
        .withColumn("state", F.aggregate("days", _empty_state(), _take_day))
    )
    return folded.select("amount", F.explode("state.plan").alias("plan")).select("amount", "plan.*")


def match_settlements(cards: DataFrame, banks: DataFrame, period: Period, cycle: Cycle = CALENDAR) -> DataFrame:
    """Matched pairs, card rows left over and bank rows left over, as far as they touch the period."""
    card_rows, card_offsets = _ranked(cards)
    bank_rows, bank_offsets = _ranked(banks)

    plan = _day_plan(card_offsets, bank_offsets)
    placed = card_offsets.join(plan, _DAY, "left").drop("size")
    ranked = card_rows.join(placed, _SLICE, "left").withColumn("rank", F.col("ahead") + F.col("slice_rank"))

    rank, end2 = F.col("rank"), F.col("take2")
    end3 = end2 + F.col("take3")
    end4 = end3 + F.col("take4")

    def pick(on2: Column, on3: Column, on4: Column, otherwise: Column) -> Column:
        return F.when(rank < end2, on2).when(rank < end3, on3).when(rank < end4, on4).otherwise(otherwise)

    day = F.col("day")
    # A card row without a bank row gets a key of its own that no bank row has; ranks start at 0.
    pay_day = pick(day + 2, day + 3, day + 4, day)
    pay_rank = pick(
        F.col("from2") + rank, F.col("from3") + rank - end2, F.col("from4") + rank - end3, -rank - 1
    )
    left = ranked.select(
        F.col("amount").alias("_amount"),
        pay_day.alias("_day"),
        pay_rank.alias("_rank"),
        F.struct("id", F.col("tx_date").alias("date"), "account", "direction", *_LABELS, "card_type").alias("card"),
    )
    right = bank_rows.join(bank_offsets.drop("size"), _SLICE).select(
        F.col("amount").alias("_amount"),
        F.col("day").alias("_day"),
        (F.col("ahead") + F.col("slice_rank")).alias("_rank"),
        F.struct("id", F.col("tx_date").alias("date"), "account", "direction", *_LABELS).alias("bank"),
    )
    pairs = left.join(right, ["_amount", "_day", "_rank"], "full_outer")

    has_card, has_bank = F.col("card").isNotNull(), F.col("bank").isNotNull()
    status = F.when(has_card & has_bank, "matched").when(has_card, "unmatched_cc").otherwise("unmatched_topup")
    first, last = cycle.bounds(period.from_ym, period.to_ym)
    visible = F.col("card_date").between(F.lit(first), F.lit(last)) | F.col("bank_date").between(
        F.lit(first), F.lit(last)
    )

    def own(prefer: str, other: str, field: str) -> Column:
        return F.when(F.col(prefer).isNotNull(), F.col(f"{prefer}.{field}")).otherwise(F.col(f"{other}.{field}"))

    rows = pairs.select(
        status.alias("status"),
        F.col("_amount").alias("amount"),
        F.col("card.date").alias("card_date"),
        F.col("bank.date").alias("bank_date"),
        F.coalesce("card.date", "bank.date").alias("sort_date"),
        F.col("card.id").alias("card_id"),
        F.col("bank.id").alias("bank_id"),
        own("bank", "card", "account").alias("account"),
        own("bank", "card", "direction").alias("direction"),
        own("card", "bank", "category").alias("category"),
        own("card", "bank", "subcategory").alias("subcategory"),
        F.col("card.card_type").alias("card_type"),
    )
    return rows.where(F.coalesce(visible, F.lit(False)))


def in_day_order(settled: DataFrame) -> DataFrame:
    """For showing: by day, matches before what is left open."""
    return settled.orderBy("sort_date", "status", F.coalesce("card_id", F.lit(0)), "bank_id")


_LABELS = ("category", "subcategory")


def settlements(
    bank: DataFrame, card: DataFrame, period: Period, cycle: Cycle = CALENDAR, v: Vocabulary = DEFAULT
) -> DataFrame:
    cards, banks = settlement_rows(bank, card, period, cycle, v)
    return match_settlements(cards, banks, period, cycle)
