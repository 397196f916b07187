"""Review: queues of rows to look at, what each row shows, and its doubt flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grootboek.checkpoints import kept
from grootboek.functions.text import (
    MERCHANT_DISPLAY_LIMIT,
    casefold,
    description_key,
    index_text,
    merchant_key,
    redact,
    search_needle,
    strip,
    text_or_empty,
)
from grootboek.operators.classify import search, without_structural
from grootboek.operators.memory import (
    LABEL,
    TEXT_KEY,
    label_counts,
    leave_one_out_answers,
    memory_corpus,
    merchant_stats,
    split_texts,
    with_memory_keys,
)
from grootboek.operators.period import Period
from grootboek.skew import lookup
from grootboek.vocabulary import DEFAULT, SAVING, UNCLASSIFIED, Vocabulary

PAGE_SIZE = 20
#: So many pages may be sorted to show one. Ids have so many characters.
FEW_PAGES, ID_CHARACTERS = 10, 32
LARGE_SAVING = 50
QUEUES = (
    "twijfel",
    "mismatch",
    "split_text",
    "overig",
    "saving_odd",
    "unclassified",
    "corrected",
    "zoek",
    "all",
)
_ROW = ["src", "tx_id"]
_RULE, _TEXT = "regel", "text"


def _in_period(rows: DataFrame, period: Period) -> DataFrame:
    kept = rows.where(F.col("ym").between(period.from_ym, period.to_ym))
    return kept.where(F.col("account") == period.account) if period.account else kept


def _is_other(v: Vocabulary) -> Column:
    return F.lower("subcategory") == v.other_sub


def _suggested_by_text(rows: DataFrame, suggested: DataFrame, only_disagreeing: bool) -> DataFrame:
    """Rows for which text memory has an answer. Both sides have one row per id."""
    answered = suggested.where(F.col("layer") == "text")
    if only_disagreeing:
        answered = answered.where(F.col("disagrees"))
    return rows.join(answered.select(*_ROW), _ROW, "left_semi")


def _split_rows(rows: DataFrame) -> DataFrame:
    """Rows whose exact text carries more than one label among these rows; a missing label counts as one."""
    keyed = rows.withColumn("_text", F.when(strip(F.col("description")) != "", strip(F.col("description"))))
    labels = keyed.where(F.col("_text").isNotNull()).groupBy("_text", "category", "subcategory")
    split = labels.agg(F.lit(1).alias("_n")).groupBy("_text").agg((F.count("_n") > 1).alias("_split"))
    found = lookup(keyed, split, "_text", spread=_ROW)
    return found.where(F.col("_split")).drop("_text", "_split")


def queue(
    ledger: DataFrame,
    name: str,
    period: Period,
    suggested: DataFrame | None = None,
    text: str | None = None,
    v: Vocabulary = DEFAULT,
) -> DataFrame:
    """The rows of one review queue. Structural rows never appear.

    ``suggested`` is the stored suggestion table; without it the two queues that need it are empty. The search queue
    is empty without a search text.
    """
    rows = _in_period(without_structural(ledger), period)
    needle = search_needle(text)
    nothing = F.lit(False)
    if name not in QUEUES:
        name = QUEUES[0]
    if name in ("twijfel", "mismatch"):
        if suggested is None:
            return rows.where(nothing)
        if name == "twijfel":
            rows = rows.where(_is_other(v) | (F.col("flow_kind") == UNCLASSIFIED))
        rows = _suggested_by_text(rows, suggested, only_disagreeing=name == "mismatch")
    elif name == "split_text":
        rows = _split_rows(rows)
    elif name == "overig":
        rows = rows.where(_is_other(v))
    elif name == "saving_odd":
        known = F.col("merchant").isin(*v.saving_counterparts)
        rows = rows.where((F.col("flow_kind") == SAVING) & (F.col("merchant").isNull() | ~known))
    elif name == "unclassified":
        rows = rows.where(F.col("flow_kind") == UNCLASSIFIED)
    elif name == "corrected":
        rows = rows.where(F.col("orig_category").isNotNull())
    elif name == "zoek" and not needle:
        return rows.where(nothing)
    return search(rows, needle)


def page(
    rows: DataFrame,
    number: int = 1,
    newest_source_first: bool = False,
    after: tuple[int, str, str] | None = None,
    size: int = PAGE_SIZE,
) -> DataFrame:
    """One page, newest month first, then source, then id descending. The split-text queue turns the sources around.

    ``after`` is the (ym, src, tx_id) of the last row seen. With it a page deep in a queue is a filter and a top-``size``
    instead of a sort of all rows before it; ``number`` then counts from there.
    """
    src = F.desc("src") if newest_source_first else F.asc("src")
    if after is not None:
        ym, last_src, tx_id = after
        later = F.col("src") < last_src if newest_source_first else F.col("src") > last_src
        same_month = later | ((F.col("src") == last_src) & (F.col("tx_id") < tx_id))
        rows = rows.where((F.col("ym") < ym) | ((F.col("ym") == ym) & same_month))
    ordered = rows.orderBy(F.desc("ym"), src, F.desc("tx_id"))
    return ordered.offset((max(1, number) - 1) * size).limit(size)


def page_at(
    rows: DataFrame, number: int, newest_source_first: bool = False, size: int = PAGE_SIZE
) -> DataFrame:
    """The page that ``page`` gives, found by counting, with the ``place`` of each row in the whole queue.

    Counts by month and source say in which of them the page is, counts by the first characters of the ids where in
    those, and by more characters while there are many rows. Only what is left is sorted, however deep the page; the
    rows before it are only counted.
    """
    first, last = (max(1, number) - 1) * size, max(1, number) * size
    src = F.desc("src") if newest_source_first else F.asc("src")
    before, some = 0, rows
    for depth in range(0, ID_CHARACTERS + 1, 2):
        keys = ["ym", "src", "_head"] if depth else ["ym", "src"]
        headed = some.withColumn("_head", F.left("tx_id", F.lit(depth)))
        groups = headed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        by = Window.orderBy(F.desc("ym"), src, *[F.desc(k) for k in keys[2:]])
        start = F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n") + F.lit(before)
        started = groups.withColumn("_start", start)
        # At most as many groups as a page has rows.
        near = started.where((F.col("_start") < last) & (F.col("_start") + F.col("_n") > first)).collect()
        if not near:
            return rows.limit(0).withColumn("place", F.lit(None).cast("bigint"))
        hit = F.lit(False)
        for group in near:
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.lit(group[k]))
            hit = hit | same
        before, some = min(group["_start"] for group in near), headed.where(hit).drop("_head")
        if last - before <= FEW_PAGES * size:
            break
    order = [F.desc("ym"), src, F.desc("tx_id")]
    top = some.orderBy(*order).limit(last - before)
    place = (F.row_number().over(Window.orderBy(*order)) + F.lit(before)).cast("bigint")
    return top.withColumn("place", place).where(F.col("place") > first)


def queue_size(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"))


def one_row(ledger: DataFrame, src: str, tx_id: str) -> DataFrame:
    return without_structural(ledger).where((F.col("src") == src) & (F.col("tx_id") == tx_id))


def present(rows: DataFrame) -> DataFrame:
    """What a reviewer sees of a row, with the keys the flags need."""
    return rows.select(
        *_ROW,
        "ym",
        F.coalesce(F.dayofmonth("tx_date"), F.lit(1)).alias("day"),
        "account",
        "direction",
        "amount",
        "category",
        "subcategory",
        redact(F.col("description")).alias("description"),
        index_text(F.col("description")).alias("embed_text"),
        description_key(F.col("description")).alias("text_key"),
        redact(F.col("merchant"), MERCHANT_DISPLAY_LIMIT).alias("merchant"),
        strip(F.col("merchant")).alias("merchant_name"),
        "orig_category",
        "orig_subcategory",
        "similarity",
        "flow_kind",
        (text_or_empty(F.col("orig_category")) != "").alias("corrected"),
        *([F.col("suggest")] if "suggest" in rows.columns else []),
    )


def with_suggestions(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """Ledger rows with ``suggest``: the leave-one-out answer of text memory. ``corpus`` must include the rows."""
    keys = [*TEXT_KEY, *LABEL]
    own = [f"own_{k}" for k in keys]
    keyed = with_memory_keys(rows)
    answers = leave_one_out_answers(label_counts(corpus))
    answers = answers.select(*[F.col(k).alias(f"own_{k}") for k in keys], "memory")
    found = lookup(keyed, answers, own, spread=_ROW)
    suggest = F.struct(
        "memory.category",
        "memory.subcategory",
        F.col("memory.share").alias("score"),
        "memory.unanimous",
        F.col("memory.n").alias("neighbor_n"),
        F.lit(_TEXT).alias("source"),
    )
    return found.select(*rows.columns, F.when(F.col("memory").isNotNull(), suggest).alias("suggest"))


def flag(
    rows: DataFrame,
    merchants: DataFrame,
    splits: DataFrame,
    neighbours_mixed: Column | None = None,
    v: Vocabulary = DEFAULT,
) -> DataFrame:
    """Doubt flags per row, the suggestion after the rules, and whether it may be applied in bulk.

    A shop booked as savings with a large credit loses its suggestion; with a small one it gets the shop's usual
    label, as does a shop booked as other income. ``rows`` come from ``with_suggestions`` and ``present``.
    """
    def with_keys(table: DataFrame) -> DataFrame:
        return table.withColumns(
            {
                "_merchant": F.when(F.col("merchant_name") != "", merchant_key(F.col("merchant_name"))),
                "_text": F.when(F.col("text_key") != "", F.col("text_key")),
            }
        )

    stats = merchants.select(F.col("merchant_key").alias("_merchant"), "majority", "mixed")
    keyed = lookup(with_keys(rows), stats, "_merchant", spread=_ROW)
    texts = splits.select(F.col("text_key").alias("_text"), F.lit(True).alias("_is_split"))
    keyed = lookup(keyed, texts, "_text", spread=_ROW)

    suggest, majority = F.col("suggest"), F.col("majority")
    category, sub = text_or_empty(F.col("category")), text_or_empty(F.col("subcategory"))
    saving_names = [name.casefold() for name in v.saving_counterparts]
    saving_shop = (F.col("flow_kind") == SAVING) & ~F.col("_merchant").isin(*saving_names)
    large = (F.col("direction") == v.credit) & (F.col("amount") >= LARGE_SAVING)
    same_label = suggest["category"].eqNullSafe(category) & suggest["subcategory"].eqNullSafe(F.col("subcategory"))
    unknown = F.lit(False)
    # Each condition becomes a column before the next step uses it, so none is repeated inside another.
    keyed = keyed.withColumns(
        {
            "_saving_shop": F.coalesce(saving_shop, unknown),
            "_large": F.coalesce(large, unknown),
            "_other": casefold(sub) == v.other_sub,
            "_income": (category == v.income_category) & ~sub.isin(*v.real_income_subs) & majority.isNotNull(),
            "_mismatch": suggest.isNotNull() & ~same_label,
            "_knn_split": unknown if neighbours_mixed is None else F.coalesce(neighbours_mixed, unknown),
            "_split": F.coalesce("_is_split", unknown),
            "_mixed": F.coalesce("mixed", unknown),
        }
    )
    step = (
        F.when(F.col("_saving_shop") & F.col("_large"), "shop_saving_large")
        .when(F.col("_saving_shop"), "shop_saving_small")
        .when(F.col("_other") & F.col("_income"), "shop_as_income")
        .when(F.col("_other"), "overig")
        .otherwise("")
    )
    keyed = keyed.withColumn("_step", step)
    keyed = keyed.withColumns(
        {
            "_by_rule": F.col("_step").isin("shop_saving_small", "shop_as_income") & majority.isNotNull(),
            "_unsafe": F.col("_knn_split") | F.col("_split") | F.col("_mixed"),
        }
    )
    named = (
        (F.col("_mismatch"), F.lit("knn_mismatch")),
        (F.col("_knn_split"), F.lit("knn_split")),
        (F.col("_split"), F.lit("split_text")),
        (F.col("_mixed"), F.lit("mixed_entity")),
        (F.col("_step") != "", F.col("_step")),
        (F.col("flow_kind") == UNCLASSIFIED, F.lit("unclassified")),
    )
    rule = F.struct(
        majority["category"].alias("category"),
        majority["subcategory"].alias("subcategory"),
        F.lit(None).cast("double").alias("score"),
        F.lit(True).alias("unanimous"),
        majority["n"].alias("neighbor_n"),
        F.lit(_RULE).alias("source"),
    )
    is_large = F.col("_step") == "shop_saving_large"
    from_text = (F.col("_step") == "overig") & F.coalesce(suggest["source"] == _TEXT, unknown) & ~F.col("_unsafe")
    suggested = F.when(is_large, unknown).otherwise(suggest.isNotNull() & ~F.col("_unsafe"))
    flagged = keyed.withColumns(
        {
            "flags": F.array_compact(F.array(*[F.when(condition, name) for condition, name in named])),
            "suggest": F.when(is_large, F.lit(None)).when(F.col("_by_rule"), rule).otherwise(suggest),
            "above": F.col("_by_rule") | suggested,
            "bulk_ok": (F.col("_by_rule") | from_text) & ~F.col("corrected"),
        }
    )
    return flagged.select(*rows.columns, "flags", "above", "bulk_ok", (F.size("flags") > 0).alias("doubt"))


def doubt_flags(ledger: DataFrame, bank: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """Every reviewable row with its suggestion and flags. The ledger is made once and stored for its three uses."""
    ledger = kept(ledger, "ledger")
    plain = without_structural(ledger)
    rows = present(with_suggestions(plain, memory_corpus(ledger)))
    return flag(rows, merchant_stats(bank, v), split_texts(ledger), v=v)
