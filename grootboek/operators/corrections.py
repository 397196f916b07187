"""Corrections, undo, bulk corrections and relabelling, as batch changes to whole ledgers.

A batch of corrections is a table; the result is the ledger with those rows changed, and the refused corrections with
the reason. ``sources.ledgers.replace_months`` writes the changed months back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grootboek.checkpoints import checkpointed
from grootboek.functions.ids import score_as_similarity, valid_source, valid_tx_id
from grootboek.functions.text import LABEL_LIMIT, strip, strip_iban, text_or_empty
from grootboek.operators.classify import is_structural_pair
from grootboek.skew import lookup
from grootboek.sources.table_set import TableSet
from grootboek.vocabulary import DEFAULT, STRUCTURAL_KINDS, Vocabulary

_ROW = ["src", "tx_id"]
_PAIR = ["category", "subcategory"]


class MoveRefused(ValueError):
    """A relabelling that may not be done."""


def _wanted(items: DataFrame) -> DataFrame:
    """The label each item asks for. A new subcategory, cleaned, takes the place of the chosen one."""
    new_sub = strip(F.left(strip_iban(strip(F.col("new_subcategory"))), F.lit(LABEL_LIMIT)))
    typed = strip(F.col("new_subcategory")) != ""
    return items.withColumns(
        {
            "category": strip(F.col("category")),
            "subcategory": F.when(typed, new_sub).otherwise(strip(F.col("subcategory"))),
            "is_new": typed,
            "merchant": F.left(strip_iban(strip(F.col("merchant"))), F.lit(LABEL_LIMIT)),
        }
    )


def judge(items: DataFrame, ledger: DataFrame, pairs: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """Items with ``reason``: NULL when accepted, else why not.

    ``items``: ``seq``, ``src``, ``tx_id``, ``category``, ``subcategory``, ``new_subcategory``, ``merchant``,
    ``similarity``. A pair must be in use or allowed, or be introduced by a new subcategory; once an accepted item has
    introduced it, items with a later ``seq`` may use it.
    """
    # Read three times below, and usually the end of a long plan.
    wanted = checkpointed(_wanted(items))
    found = wanted.join(ledger.select(*_ROW, "flow_kind"), _ROW, "left")
    empty = (F.col("category") == "") | (F.col("subcategory") == "")
    structural = is_structural_pair(F.col("category"), F.col("subcategory"), v)
    missing = F.col("flow_kind").isNull() | F.col("flow_kind").isin(*STRUCTURAL_KINDS)

    introducing = found.where(F.col("is_new") & ~empty & ~structural & ~missing)
    introduced = introducing.groupBy(*_PAIR).agg(F.min("seq").alias("since")).withColumn("allowed", F.lit(False))
    in_use = pairs.select(*_PAIR).distinct()
    in_use = in_use.withColumns({"since": F.lit(None).cast("bigint"), "allowed": F.lit(True)})
    known_pairs = in_use.unionByName(introduced).groupBy(*_PAIR)
    known_pairs = known_pairs.agg(F.max("allowed").alias("_allowed"), F.min("since").alias("_since"))
    found = lookup(found, known_pairs, _PAIR, spread=["seq"])

    known = F.coalesce("_allowed", F.lit(False)) | F.coalesce(F.col("_since") < F.col("seq"), F.lit(False))
    reason = (
        F.when(empty, "empty")
        .when(~known & ~F.col("is_new"), "pair")
        .when(structural, "structural")
        .when(missing, "missing")
    )
    return found.withColumn("reason", reason).drop("flow_kind", "_allowed", "_since", "is_new")


def _last_of_each_row(accepted: DataFrame) -> DataFrame:
    """One change per row. The last item decides the label, the last one that names a merchant decides that."""
    named = F.when(F.col("merchant") != "", F.col("seq"))
    return accepted.groupBy(*_ROW).agg(
        F.max_by(F.struct("category", "subcategory", "similarity"), "seq").alias("_change"),
        F.max_by("merchant", named).alias("_merchant"),
    )


def _written(ledger: DataFrame, accepted: DataFrame) -> DataFrame:
    changed = ledger.join(_last_of_each_row(accepted), _ROW, "left")
    hit = F.col("_change").isNotNull()

    def when_hit(value: Column, column: str) -> Column:
        return F.when(hit, value).otherwise(F.col(column))

    return changed.select(
        *[
            {
                "orig_category": when_hit(F.coalesce("orig_category", "category"), "orig_category"),
                "orig_subcategory": when_hit(F.coalesce("orig_subcategory", "subcategory"), "orig_subcategory"),
                "category": when_hit(F.col("_change.category"), "category"),
                "subcategory": when_hit(F.col("_change.subcategory"), "subcategory"),
                "similarity": when_hit(F.col("_change.similarity"), "similarity"),
                "merchant": F.when(text_or_empty(F.col("_merchant")) != "", F.col("_merchant")).otherwise(
                    F.col("merchant")
                ),
            }
            .get(c, F.col(c))
            .alias(c)
            for c in ledger.columns
        ]
    )


def apply_corrections(
    ledger: DataFrame, items: DataFrame, pairs: DataFrame, v: Vocabulary = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """The corrected ledger, and the refused items with their reason. The first original label is kept."""
    judged = judge(items, ledger, pairs, v)
    return _written(ledger, judged.where(F.col("reason").isNull())), judged.where(F.col("reason").isNotNull())


def undo_corrections(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """Put the original labels of the named rows back and clear their similarity."""
    named = rows.select(*_ROW).distinct().withColumn("_undo", F.lit(True))
    marked = ledger.join(named, _ROW, "left")
    structural = F.col("flow_kind").isin(*STRUCTURAL_KINDS)
    hit = F.col("_undo") & (text_or_empty(F.col("orig_category")) != "") & ~structural
    back = F.coalesce(hit, F.lit(False))
    return marked.withColumns(
        {
            "category": F.when(back, F.col("orig_category")).otherwise(F.col("category")),
            "subcategory": F.when(back, F.col("orig_subcategory")).otherwise(F.col("subcategory")),
            "orig_category": F.when(~back, F.col("orig_category")),
            "orig_subcategory": F.when(~back, F.col("orig_subcategory")),
            "similarity": F.when(~back, F.col("similarity")),
        }
    ).select(*ledger.columns)


def bulk_items(selected: DataFrame, flagged: DataFrame) -> DataFrame:
    """Selected rows with the label to apply: the reviewer's own, else the row's suggestion.

    ``selected``: ``seq``, ``src``, ``tx_id`` and the typed ``category``, ``subcategory``, ``new_subcategory``,
    ``merchant``. A row selected twice counts once, at its first place. Rows without either label get an empty
    one, which the judgement refuses.
    """
    rest = ["category", "subcategory", "new_subcategory", "merchant"]
    once = selected.groupBy(*_ROW).agg(F.min("seq").alias("seq"), F.min_by(F.struct(*rest), "seq").alias("t"))
    # An id that is none keeps its text: it matches no row and is refused as missing.
    typed = once.select(
        F.coalesce(valid_source(F.col("src")), F.lit("?")).alias("src"),
        F.coalesce(valid_tx_id(F.col("tx_id")), F.col("tx_id")).alias("tx_id"),
        "seq",
        *[strip(F.col(f"t.{c}")).alias(c) for c in rest],
    )
    found = typed.join(flagged.select(*_ROW, "suggest"), _ROW, "left")
    explicit = (F.col("category") != "") & ((F.col("subcategory") != "") | (F.col("new_subcategory") != ""))

    def choose(field: str) -> Column:
        return F.when(explicit, F.col(field)).otherwise(text_or_empty(F.col(f"suggest.{field}")))

    return found.select(
        "seq",
        *_ROW,
        choose("category").alias("category"),
        choose("subcategory").alias("subcategory"),
        F.when(explicit, F.col("new_subcategory")).otherwise("").alias("new_subcategory"),
        "merchant",
        score_as_similarity(F.when(~explicit, F.col("suggest.score"))).alias("similarity"),
    )


def bulk_counts(judged: DataFrame) -> DataFrame:
    saved = F.col("reason").isNull()
    return judged.agg(F.count_if(saved).alias("saved"), F.count_if(~saved).alias("skipped"))


def check_move(from_category: str, to_category: str, subcategory: str, v: Vocabulary = DEFAULT) -> None:
    """Refuse an empty, idle or structural move."""
    names = [(text or "").strip() for text in (from_category, to_category, subcategory)]
    if not all(names):
        raise MoveRefused("two categories and a subcategory are required")
    if names[0] == names[1]:
        raise MoveRefused("both categories are the same")
    for category in names[:2]:
        if category == v.internal_category or (category, names[2]) == v.settlement_pair:
            raise MoveRefused("structural pair")


def relabel(table: DataFrame, from_category: str, to_category: str, subcategory: str) -> DataFrame:
    """Move a pair to another category, in a ledger or in the suggestion table."""
    check_move(from_category, to_category, subcategory)
    hit = (F.col("category") == from_category) & (F.col("subcategory") == subcategory)
    return table.withColumn("category", F.when(hit, F.lit(to_category)).otherwise(F.col("category")))


def relabel_counts(table: DataFrame, from_category: str, to_category: str, subcategory: str) -> DataFrame:
    """Rows on either side of a move, per source; run it before and after."""
    pair = table.where((F.col("subcategory") == subcategory) & F.col("category").isin(from_category, to_category))
    return pair.groupBy("src", "category", "subcategory").agg(F.count(F.lit(1)).alias("n"))


def move(
    tables: dict[str, DataFrame], from_category: str, to_category: str, subcategory: str
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The named tables (ledgers, suggestions) after a move, and the counts of either side before and after it, by
    ``table_name`` and ``moment``. ``check_moved`` says whether it is complete."""
    moved = {name: relabel(df, from_category, to_category, subcategory) for name, df in tables.items()}
    counts = None
    for moment, of in (("before", tables), ("after", moved)):
        for name, df in of.items():
            part = relabel_counts(df, from_category, to_category, subcategory)
            part = part.withColumns({"table_name": F.lit(name), "moment": F.lit(moment)})
            counts = part if counts is None else counts.unionByName(part)
    return moved, counts


def move_stored(tables: TableSet, names: Sequence[str], from_category: str, to_category: str, subcategory: str) -> DataFrame:
    """Moves a pair in stored tables, in all of them or in none, and returns the counts as ``move`` does.

    Only buckets with rows of the pair are written. Rows left behind in any table refuse the move before it counts.
    """
    check_move(from_category, to_category, subcategory)
    before = {name: checkpointed(tables.read(name)) for name in names}
    _, counts = move(before, from_category, to_category, subcategory)
    counts = checkpointed(counts)

    def check(after: dict[str, DataFrame]) -> None:
        check_moved(after, from_category, subcategory)

    named = {name: left_behind(rows, from_category, subcategory) for name, rows in before.items()}
    tables.change(named, lambda name, rows: relabel(rows, from_category, to_category, subcategory), check)
    found = None
    for name in names:
        part = relabel_counts(tables.read(name), from_category, to_category, subcategory)
        part = part.withColumns({"table_name": F.lit(name), "moment": F.lit("after")})
        found = part if found is None else found.unionByName(part)
    return counts.where(F.col("moment") == "before").unionByName(found)


def check_moved(tables: dict[str, DataFrame], from_category: str, subcategory: str) -> None:
    """Refuse tables in which rows still carry the old pair."""
    for name, df in tables.items():
        if not left_behind(df, from_category, subcategory).isEmpty():
            raise MoveRefused(f"rows left behind in {name}")


def left_behind(table: DataFrame, from_category: str, subcategory: str) -> DataFrame:
    """Rows still carrying the old pair; empty after a complete move."""
    return table.where((F.col("category") == from_category) & (F.col("subcategory") == subcategory))
