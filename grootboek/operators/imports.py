"""Import: preview new rows, carry refunds to their charge, and append what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grootboek.functions.dates import ym_of, ymd_int
from grootboek.functions.text import (
    LABEL_LIMIT,
    LONG_DIGIT_RUN,
    MASK,
    AnonymiseRules,
    anonymise,
    is_account_label,
    normalize,
    redact,
    strip,
    strip_iban,
    text_or_empty,
)
from grootboek.schema import BANK, CARD, conform
from grootboek.skew import lookup
from grootboek.sources.bank_csv import parse_bank_rows
from grootboek.sources.bucket_table import BucketTable
from grootboek.sources.card_text import parse_card_lines, stitch_lines
from grootboek.sources.ledgers import CheckFailed, append_ledger, loaded_ids
from grootboek.vocabulary import DEFAULT, Vocabulary

# A share that counts as "always".
SURE_SHARE = 0.999
SURE_ROWS = 3

_ROW = ["file", "pos"]


def _certain(v: Vocabulary) -> Column:
    """Sure when every earlier row with the text agrees and there are enough of them."""
    sure = F.col("memory.unanimous") & (F.col("memory.share") >= SURE_SHARE) & (F.col("memory.n") >= SURE_ROWS)
    return F.when(F.coalesce(sure, F.lit(False)), v.tone_sure).otherwise(v.tone_doubt)


def _with_recall_keys(rows: DataFrame, direction: Column) -> DataFrame:
    keyed = rows.withColumns({"_text": normalize(F.col("description")), "_way": strip(direction)})
    usable = (F.col("_text") != "") & (F.col("_way") != "")
    return keyed.withColumns({"_text": F.when(usable, F.col("_text")), "_way": F.when(usable, F.col("_way"))})


def recall(rows: DataFrame, memory: DataFrame, direction: Column) -> DataFrame:
    """Attach what earlier rows with the same text and direction were booked as, as ``memory``."""
    keyed = _with_recall_keys(rows, direction)
    known = memory.select(F.col("text_key").alias("_text"), F.col("direction").alias("_way"), "memory")
    return lookup(keyed, known, ["_text", "_way"], spread=_ROW).drop("_text", "_way")


def mark_duplicates(rows: DataFrame, ledger: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """``status``: error, duplicate of a loaded id, or new. Repeats inside the import itself all count as new."""
    # Only unreadable lines share an id, the empty one; without it ids are unique and a plain join has no hot key.
    loaded = loaded_ids(ledger).select(F.col("tx_id").alias("_id"), F.lit(True).alias("_loaded"))
    found = rows.join(loaded, F.when(F.col("tx_id") != "", F.col("tx_id")) == F.col("_id"), "left").drop("_id")
    status = (
        F.when(F.col("error").isNotNull(), v.status_error)
        .when(F.col("_loaded"), v.status_duplicate)
        .otherwise(v.status_new)
    )
    return found.withColumn("status", status).drop("_loaded")


def _label_choice(rows: DataFrame, fallback: Column, rule: Column, v: Vocabulary) -> DataFrame:
    """Category, subcategory, tone and their source: fixed rule, else memory, else ``fallback``."""
    repayment = F.struct(
        F.lit(v.repayment_pair[0]).alias("category"), F.lit(v.repayment_pair[1]).alias("subcategory")
    )
    recalled = F.when(F.col("memory").isNotNull(), F.struct("memory.category", "memory.subcategory"))
    pair = F.when(rule, repayment).otherwise(F.coalesce(recalled, fallback))
    has_memory = ~rule & F.col("memory").isNotNull()
    source = F.when(rule, v.source_rule).when(has_memory, v.source_text).otherwise(v.source_fallback)
    good = F.col("error").isNull()
    fresh = F.col("status") == v.status_new
    tone = F.when(rule, v.tone_sure).otherwise(_certain(v))
    return rows.withColumns(
        {
            "category": F.when(good, pair["category"]),
            "subcategory": F.when(good, pair["subcategory"]),
            "source": F.when(good, source).otherwise(""),
            "tone": F.when(good & fresh, tone).otherwise(""),
            "mem_n": F.when(good & has_memory, F.col("memory.n")).otherwise(F.lit(0).cast("bigint")),
            "mem_share": F.when(good & has_memory, F.col("memory.share")),
        }
    ).drop("memory")


def _pair(pair: tuple[str, str]) -> Column:
    return F.struct(F.lit(pair[0]).alias("category"), F.lit(pair[1]).alias("subcategory"))


PREVIEW = (
    "file",
    "pos",
    "tx_id",
    "status",
    "error",
    "tone",
    "source",
    "tx_date",
    "shown",
    "direction",
    "amount",
    "category",
    "subcategory",
    "account",
    "mem_n",
    "mem_share",
)
BANK_EXTRA = ("description", "counter_account", "code", "mutation_kind", "memo", "balance_after")
CARD_EXTRA = ("description", "card_type", "token")


def preview_bank(
    raw: DataFrame, rules: AnonymiseRules, ledger: DataFrame, memory: DataFrame, v: Vocabulary = DEFAULT
) -> DataFrame:
    """Bank rows ready to review: id from the raw cells, then redaction, status and a proposed label.

    Raw cells do not leave this function.
    """
    parsed = parse_bank_rows(raw)

    good = F.col("error").isNull()
    cleaned = {"description": "raw_description", "memo": "raw_memo"}
    cleaned |= {"account": "raw_account", "counter_account": "raw_counter_account"}
    safe = parsed.withColumns(
        {name: F.when(good, anonymise(F.col(raw), rules, v)).otherwise("") for name, raw in cleaned.items()}
    )
    # Account numbers that no rule turned into a label do not pass.
    label_only = {
        c: F.when(is_account_label(F.col(c), v), F.col(c)).otherwise("") for c in ("account", "counter_account")
    }
    safe = safe.withColumns(label_only).select(
        *_ROW, "tx_id", "error", "tx_date", "direction", "amount", "account", *BANK_EXTRA
    )
    known = recall(mark_duplicates(safe, ledger, v), memory, F.col("direction"))
    credit = F.col("direction") == v.credit
    fallback = F.when(credit, _pair(v.default_credit_pair)).otherwise(_pair(v.default_debit_pair))
    labelled = _label_choice(known, fallback, F.lit(False), v)
    return labelled.withColumn("shown", redact(F.col("description"))).select(*PREVIEW, *BANK_EXTRA)


def preview_card(
    lines: DataFrame, rules: AnonymiseRules, ledger: DataFrame, memory: DataFrame, v: Vocabulary = DEFAULT
) -> DataFrame:
    """Card rows ready to review.

    A collection is a repayment by rule. A credit takes the label of the charge it refunds. All charges with one text
    get the same label here, namely what memory holds for that text as a debit, or the default debit pair; so a
    credit's label is found by the same lookup, whether or not the charge is in the statement.
    """
    parsed = parse_card_lines(stitch_lines(lines, v), v)
    masked = F.regexp_replace(F.col("line"), LONG_DIGIT_RUN, MASK)
    good = F.col("error").isNull()
    safe = parsed.withColumns(
        {
            "description": F.when(good, anonymise(F.col("raw_description"), rules, v)).otherwise(""),
            "unparsed": F.when(good, "").otherwise(redact(masked)),
            "account": F.when(good, v.card_account).otherwise(""),
        }
    )
    safe = safe.select(
        *_ROW, "tx_id", "error", "tx_date", "direction", "amount", "account", *CARD_EXTRA, "unparsed"
    )
    as_debit = F.when(good, F.lit(v.debit))
    known = recall(mark_duplicates(safe, ledger, v), memory, as_debit)
    collected = F.coalesce(F.col("card_type") == v.collection_type, F.lit(False))
    labelled = _label_choice(known, _pair(v.default_debit_pair), collected, v)
    shown = F.when(good, redact(F.col("description"))).otherwise(redact(F.col("unparsed")))
    return labelled.withColumn("shown", shown).select(*PREVIEW, *CARD_EXTRA)


def in_review_order(preview: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """Errors first, then new rows in doubt, then new sure rows, then the rest; newest first inside each."""
    fresh = F.col("status") == v.status_new
    band = (
        F.when(F.col("status") == v.status_error, -1)
        .when(fresh & (F.col("tone") == v.tone_doubt), 0)
        .when(fresh & (F.col("tone") == v.tone_sure), 1)
        .otherwise(2)
    )
    return preview.orderBy(band, F.desc_nulls_last("tx_date"), *_ROW)


def preview_counts(preview: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    fresh = F.col("status") == v.status_new
    return preview.agg(
        F.count_if(fresh).alias("n_new"),
        F.count_if(F.col("status") == v.status_duplicate).alias("n_dupe"),
        F.count_if(F.col("status") == v.status_error).alias("n_err"),
        F.count_if(fresh & (F.col("tone") == v.tone_sure)).alias("n_sure"),
        F.count_if(fresh & (F.col("tone") == v.tone_doubt)).alias("n_doubt"),
    )


def nearest_charge(rows: DataFrame, group: list[str], order: str, v: Vocabulary = DEFAULT) -> DataFrame:
    """Each credit with the label of the debit it most likely refunds.

    Within ``group`` and the same normalised text: a debit of the same amount before any other, then the smallest
    difference between the dates written as numbers, then the first in ``order``. ``in_doubt`` marks credits whose
    equal-amount debits carry different labels. Credits without a debit get NULL.

    Rows meet as one entry per (text, amount, day): the nearest day before and after is a running value over at most
    one entry per calendar day, so neither pairs nor whole texts are gathered.
    """
    keyed = rows.withColumns({"text_key": normalize(F.col("description")), "day": ymd_int(F.col("tx_date"))})
    keyed = keyed.where((F.col("text_key") != "") & F.col("day").isNotNull() & F.col("amount").isNotNull())
    text, amount = [*group, "text_key"], [*group, "text_key", "amount"]
    label = F.struct("category", "subcategory")
    is_debit = F.col("direction") == v.debit
    is_credit = F.col("direction") == v.credit
    first = F.min(F.when(is_debit, F.struct(F.col(order).alias("at"), "category", "subcategory")))

    days = keyed.groupBy(*amount, "day").agg(
        first.alias("debit"),
        F.min(F.when(is_debit, label)).alias("low"),
        F.max(F.when(is_debit, label)).alias("high"),
        F.count_if(is_credit).alias("credits"),
    )
    same = _nearest_day(days, amount).withColumns(
        {
            "low": F.min("low").over(Window.partitionBy(*amount)),
            "high": F.max("high").over(Window.partitionBy(*amount)),
        }
    )
    same = same.where(F.col("credits") > 0).select(
        *amount,
        "day",
        "credits",
        F.col("nearest").alias("same_amount"),
        (~F.col("low").eqNullSafe(F.col("high"))).alias("in_doubt"),
    )
    any_days = days.groupBy(*text, "day").agg(
        F.min("debit").alias("debit"), F.count_if(F.col("credits") > 0).alias("amounts")
    )
    other = _nearest_day(any_days, text).where(F.col("amounts") > 0)
    other = other.select(*text, "day", "amounts", F.col("nearest").alias("any_amount"))
    answers = lookup(same, other, [*text, "day"], spread=["amount"])
    best = F.coalesce("same_amount", "any_amount")
    answers = answers.select(
        *amount,
        "day",
        "credits",
        best["gap"].alias("gap"),
        F.when(best.isNotNull(), F.col("same_amount").isNotNull()).alias("same_amount"),
        best["category"].alias("charge_category"),
        best["subcategory"].alias("charge_subcategory"),
        (F.col("in_doubt") & best.isNotNull()).alias("in_doubt"),
    )
    found = lookup(keyed.where(is_credit), answers, [*amount, "day"], spread=[order])
    return found.drop("credits")


def _nearest_day(days: DataFrame, group: list[str]) -> DataFrame:
    """Adds ``nearest``: the debit of the closest day, the first in order when two days are equally close."""
    earlier = Window.partitionBy(*group).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*group).orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col("debit").isNotNull(), F.struct("day", "debit"))
    found = days.withColumns(
        {
            "_before": F.last(seen, ignorenulls=True).over(earlier),
            "_after": F.last(seen, ignorenulls=True).over(later),
        }
    )

    def candidate(side: str) -> Column:
        gap = F.abs(F.col(f"{side}.day") - F.col("day"))
        hit = F.struct(
            gap.alias("gap"),
            F.col(f"{side}.debit.at").alias("at"),
            F.col(f"{side}.debit.category").alias("category"),
            F.col(f"{side}.debit.subcategory").alias("subcategory"),
        )
        return F.when(F.col(side).isNotNull(), hit)

    return found.withColumn("nearest", F.least(candidate("_before"), candidate("_after"))).drop("_before", "_after")


# Commit.


def apply_overrides(preview: DataFrame, overrides: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """New rows with the reviewer's label and merchant. ``overrides`` has one row per ``tx_id``; blanks keep the proposal."""
    fresh = preview.where(F.col("status") == v.status_new)
    chosen = overrides.select(
        "tx_id",
        F.col("category").alias("_category"),
        F.col("subcategory").alias("_subcategory"),
        F.col("merchant").alias("_merchant"),
    )
    found = fresh.join(chosen, "tx_id", "left")

    def pick(given: str, proposed: Column) -> Column:
        return strip(F.when(text_or_empty(F.col(given)) != "", F.col(given)).otherwise(proposed))

    return found.withColumns(
        {
            "category": pick("_category", F.col("category")),
            "subcategory": pick("_subcategory", F.col("subcategory")),
            "merchant": F.left(strip_iban(pick("_merchant", F.lit(""))), F.lit(LABEL_LIMIT)),
        }
    ).drop("_category", "_subcategory", "_merchant")


def unknown_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Label pairs in ``rows`` that are not allowed. A commit with any of them fails as a whole."""
    used = rows.select("category", "subcategory").distinct()
    return used.join(pairs.select("category", "subcategory").distinct(), ["category", "subcategory"], "left_anti")


def first_of_each_id(rows: DataFrame) -> DataFrame:
    """One row per id, the first by file and position, as a unique key would keep it."""
    rest = [c for c in rows.columns if c not in ("tx_id", *_ROW)]
    first = F.min_by(F.struct(*_ROW, *rest), F.struct(*_ROW))
    return rows.groupBy("tx_id").agg(first.alias("r")).select("tx_id", *[f"r.{c}" for c in (*_ROW, *rest)])


def new_rows(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows whose id is not loaded yet, one per id."""
    return first_of_each_id(rows).join(ledger.select("tx_id"), "tx_id", "left_anti")


def with_known(rows: DataFrame, ids: BucketTable) -> DataFrame:
    """``known``: whether a row's id is in a stored table of loaded ids, of which only the rows' buckets are read.

    An import of few rows reads few buckets, whatever the size of the ledger. ``rows`` must be a written table.
    """
    asked = rows.withColumn("_asked", F.when(F.col("tx_id") != "", F.col("tx_id")))
    loaded = ids.buckets(rows.select("tx_id")).select(F.col("tx_id").alias("_id")).distinct()
    found = asked.join(loaded, F.col("_asked") == F.col("_id"), "left")
    return found.withColumn("known", F.col("_id").isNotNull()).drop("_asked", "_id")


def to_ledger(rows: DataFrame, kind: str, next_id: Column) -> DataFrame:
    """Committed rows in the ledger's schema."""
    schema = BANK if kind == "bank" else CARD
    filled = rows.withColumns({"id": next_id, "ym": ym_of(F.col("tx_date"))})
    for field in schema.fields:
        if field.name not in filled.columns:
            filled = filled.withColumn(field.name, F.lit(None))
    return conform(filled.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]), schema)


def commit(
    preview: DataFrame, overrides: DataFrame, pairs: DataFrame, ledger: DataFrame, path: str, kind: str
) -> int:
    """Append the new rows of a staged preview to the ledger at ``path``; returns how many.

    New ids continue after the highest one in the order of the files and of the rows in them; gaps are allowed.
    ``preview`` must be a written table, so that the check and the write see the same rows.
    """
    rows = apply_overrides(preview, overrides)
    if not unknown_pairs(rows, pairs).isEmpty():
        raise CheckFailed("unknown pair")
    top = ledger.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = new_rows(rows, ledger).orderBy(*_ROW)
    before = ledger.count()
    append_ledger(to_ledger(fresh, kind, F.lit(top + 1) + F.monotonically_increasing_id()), path)
    spark = ledger.sparkSession
    return spark.read.schema(ledger.schema).parquet(path).count() - before
