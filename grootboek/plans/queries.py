"""The named queries: each operator applied to the whole derived ledgers.

Results are shaped for comparison: decimals as doubles after summing, dates as text, flags as 0 and 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grootboek.checkpoints import checkpointed, kept, shared_folder
from grootboek.functions.text import (
    INDEX_LIMIT,
    anonymise,
    is_denied_merchant,
    key_of_clean,
    looks_secret,
    redact,
    strip_iban,
)
from grootboek.operators import audits, corrections, imports, memory, neighbours, reports, review, settle
from grootboek.operators.classify import SEARCHED, transfer_legs
from grootboek.operators.imports import with_known
from grootboek.operators.period import (
    Period,
    in_pay_cycle,
    in_period,
    latest_month,
    payday_starts,
    year_bounds,
)
from grootboek.operators.refresh import SuggestionStore
from grootboek.operators.text_index import TextIndex
from grootboek.plans import fixtures as fx
from grootboek.sources import bank_csv, card_text
from grootboek.sources.ledgers import copy_table, loaded_ids, read_bank, read_terms, table_stats
from grootboek.sources.bucket_table import BucketTable, bucket_of
from grootboek.sources.checked_copy import CheckedCopy
from grootboek.sources.table_set import TableSet
from grootboek.sources.vector_table import VectorTable
from grootboek.vocabulary import EXPENSE, REFUND

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WHOLE = fx.WHOLE
ONE_YEAR = Period(199701, 199712, "Rekening A")


def plain(df: DataFrame) -> DataFrame:
    """Simple column types only."""

    def cell(field: T.StructField):
        c = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return c.cast("double").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return c.cast("string").alias(field.name)
        if isinstance(field.dataType, (T.BooleanType, T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(field.name)
        return c

    return df.select(*[cell(f) for f in df.schema.fields])


def query(function: Query) -> Query:
    name = function.__name__.removeprefix("q_")
    QUERIES[name] = lambda spark, sf_dir: plain(function(spark, sf_dir))
    return function


def _rows(spark: SparkSession, sf_dir: str, period: Period = WHOLE) -> DataFrame:
    return in_period(fx.ledger(spark, sf_dir), period)


def _cycle_rows(spark: SparkSession, sf_dir: str, period: Period = WHOLE) -> DataFrame:
    starts = payday_starts(fx.bank_ledger(spark, sf_dir), period)
    return in_pay_cycle(fx.ledger(spark, sf_dir), period, starts)


def _kpis(rows: DataFrame, period: Period, **chosen: str) -> DataFrame:
    figures = reports.kpis(rows, period.n_months, **chosen)
    averages = {c: F.round(F.col(c), 2) for c in ("avg_month", "avg_income")}
    return figures.withColumns(averages)


# Reports.


@query
def kpis(spark, sf_dir):
    return _kpis(_rows(spark, sf_dir), WHOLE)


@query
def kpis_one_category(spark, sf_dir):
    return _kpis(_rows(spark, sf_dir, ONE_YEAR), ONE_YEAR, category="Huishouden")


@query
def kpis_paycycle(spark, sf_dir):
    return _kpis(_cycle_rows(spark, sf_dir), WHOLE)


@query
def net_by_category(spark, sf_dir):
    return reports.net_by(_rows(spark, sf_dir), "category")


@query
def net_by_subcategory(spark, sf_dir):
    return reports.net_by(_rows(spark, sf_dir), "subcategory", category="Huishouden")


@query
def income_by_sub(spark, sf_dir):
    return reports.income_by_sub(_rows(spark, sf_dir))


@query
def monthly_stack(spark, sf_dir):
    return reports.monthly_stack(_rows(spark, sf_dir), WHOLE)


@query
def monthly_stack_paycycle(spark, sf_dir):
    return reports.monthly_stack(_cycle_rows(spark, sf_dir), WHOLE, label="subcategory")


@query
def income_vs_expense(spark, sf_dir):
    return reports.income_vs_expense(_rows(spark, sf_dir), WHOLE)


@query
def transfers_monthly(spark, sf_dir):
    return reports.transfers_monthly(_rows(spark, sf_dir))


@query
def transfer_totals(spark, sf_dir):
    return reports.transfer_totals(reports.transfers_monthly(_rows(spark, sf_dir)))


@query
def transfer_legs_of_rows(spark, sf_dir):
    legs = transfer_legs(fx.ledger(spark, sf_dir), card_merchant=True)
    return legs.select("src", "id", "from_account", "to_account")


@query
def saving_monthly(spark, sf_dir):
    return reports.saving_monthly(_rows(spark, sf_dir))


@query
def saving_series(spark, sf_dir):
    return reports.saving_series(reports.saving_monthly(_rows(spark, sf_dir)), WHOLE)


@query
def saving_by_account(spark, sf_dir):
    return reports.saving_by_account(reports.saving_monthly(_rows(spark, sf_dir)))


@query
def refund_monthly(spark, sf_dir):
    return reports.refund_monthly(_rows(spark, sf_dir))


@query
def unclassified_count(spark, sf_dir):
    return reports.unclassified_count(_rows(spark, sf_dir))


@query
def q_latest_month(spark, sf_dir):
    bank = fx.bank_ledger(spark, sf_dir)
    calendar = latest_month(bank).select(F.lit("calendar").alias("cycle"), "ym")
    return calendar.unionByName(latest_month(bank, by_payday=True).select(F.lit("payday").alias("cycle"), "ym"))


@query
def q_year_bounds(spark, sf_dir):
    return year_bounds(fx.ledger(spark, sf_dir))


@query
def q_payday_starts(spark, sf_dir):
    return payday_starts(fx.bank_ledger(spark, sf_dir), WHOLE)


@query
def category_pairs(spark, sf_dir):
    return reports.category_pairs(fx.ledger(spark, sf_dir))


@query
def allowed_pairs(spark, sf_dir):
    return reports.allowed_pairs(fx.ledger(spark, sf_dir))


@query
def accounts(spark, sf_dir):
    return reports.own_accounts(fx.ledger(spark, sf_dir))


@query
def unique_category_for_sub(spark, sf_dir):
    return reports.unique_category_for_sub(fx.ledger(spark, sf_dir))


@query
def vocabulary(spark, sf_dir):
    return reports.vocabulary(fx.bank_ledger(spark, sf_dir), fx.card_ledger(spark, sf_dir))


@query
def translated_totals(spark, sf_dir):
    report = reports.net_by(_rows(spark, sf_dir), "category")
    return reports.translate(report, fx.terms(spark, sf_dir), {"label": "hoofd"})


@query
def tx_list_spend(spark, sf_dir):
    return reports.transactions(_rows(spark, sf_dir), "spend")


@query
def tx_list_income(spark, sf_dir):
    return reports.transactions(_rows(spark, sf_dir), "income", subcategory="salaris")


@query
def tx_list_transfer_leg(spark, sf_dir):
    return reports.transactions(_rows(spark, sf_dir), "internal", leg=("Rekening A", "Rekening B"))


# Memory.


@query
def text_memory(spark, sf_dir):
    found = memory.text_memory(memory.memory_corpus(fx.ledger(spark, sf_dir)))
    return found.select("text_key", "direction", "memory.*")


@query
def loo_suggestions(spark, sf_dir):
    return memory.suggestions(memory.memory_corpus(fx.ledger(spark, sf_dir)))


@query
def merchant_majority(spark, sf_dir):
    return memory.merchant_majority(fx.bank_ledger(spark, sf_dir))


@query
def mixed_merchants(spark, sf_dir):
    return memory.mixed_merchants(fx.bank_ledger(spark, sf_dir))


@query
def split_texts(spark, sf_dir):
    return memory.split_texts(fx.ledger(spark, sf_dir))


@query
def index_stats(spark, sf_dir):
    return memory.index_stats(fx.ledger(spark, sf_dir))


def _with_memory(spark, sf_dir):
    return memory.leave_one_out(memory.memory_corpus(fx.ledger(spark, sf_dir)))


@query
def matcher_tally(spark, sf_dir):
    return memory.tally(_with_memory(spark, sf_dir), "memory")


@query
def confusion_pairs(spark, sf_dir):
    return memory.confusion(_with_memory(spark, sf_dir), "memory")


@query
def matcher_variants(spark, sf_dir):
    return memory.compare_variants(_with_memory(spark, sf_dir), _variants())


@query
def confusion_by_variant(spark, sf_dir):
    return memory.confusion_by_variant(_with_memory(spark, sf_dir), _variants())


def _variants() -> dict[str, Column]:
    """Stored proposals as they are, unanimous ones only, memory, and memory before unanimous ones."""
    hit = F.col("memory").isNotNull()
    pair = F.struct(
        F.when(hit, F.col("memory.category")).otherwise(F.col("category")).alias("category"),
        F.when(hit, F.col("memory.subcategory")).otherwise(F.col("subcategory")).alias("subcategory"),
    )
    complete = (pair["category"] != "") & (pair["subcategory"] != "")
    recalled = F.when(hit, F.struct("memory.category", "memory.subcategory"))
    unanimous = F.when(complete & F.coalesce("memory.unanimous", F.lit(False)), pair)
    return {
        "A": F.when(complete, pair),
        "B": unanimous,
        "M": recalled,
        "D": memory.first_proposal(recalled, unanimous),
    }


# Import.


@query
def bank_ids(spark, sf_dir):
    return fx.bank_ledger(spark, sf_dir).select("id", "tx_id")


@query
def card_ids(spark, sf_dir):
    return fx.card_raw(spark, sf_dir).select("id", "token", "tx_id")


def _bank_preview(spark, sf_dir):
    recalled = memory.text_memory(memory.memory_corpus(fx.ledger(spark, sf_dir)))
    bank = fx.bank_ledger(spark, sf_dir)
    return imports.preview_bank(fx.bank_cells(spark, sf_dir), fx.RULES, bank, recalled)


@query
def bank_import_preview(spark, sf_dir):
    return imports.in_review_order(_bank_preview(spark, sf_dir)).withColumnRenamed("pos", "id")


@query
def bank_import_counts(spark, sf_dir):
    return imports.preview_counts(_bank_preview(spark, sf_dir))


@query
def bank_csv_round_trip(spark, sf_dir):
    """Bank cells written as CSV files, with cells over several lines, and read again as an import reads them."""
    names = {new: old for old, new in bank_csv.COLUMNS.items()}
    cells = fx.bank_csv_cells(spark, sf_dir).select(*[F.col(c).alias(names[c]) for c in names])
    path = shared_folder(spark, "bank-csv")
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    cells.write.options(header=True, sep=";", quote='"', escape='"', **kept).csv(path)
    rows = bank_csv.parse_bank_rows(bank_csv.read_bank_csv(spark, path))
    return rows.select("tx_id", "tx_date", "amount", "direction", "raw_description", "raw_memo", "balance_after", "error")


def _card_preview(spark, sf_dir):
    recalled = memory.text_memory(memory.memory_corpus(fx.ledger(spark, sf_dir)))
    card = fx.card_ledger(spark, sf_dir)
    return imports.preview_card(fx.card_lines(spark, sf_dir), fx.RULES, card, recalled)


@query
def card_import_preview(spark, sf_dir):
    preview = imports.in_review_order(_card_preview(spark, sf_dir))
    return preview.select("pos.seq", *[c for c in preview.columns if c != "pos"])


@query
def card_text_round_trip(spark, sf_dir):
    """Statement lines written as text files and read again; a file holds whole blocks of lines, in their order."""
    lines = fx.card_lines(spark, sf_dir).repartitionByRange("file", "block").sortWithinPartitions("file", "block", "seq")
    path = shared_folder(spark, "statements")
    lines.select("line", "file").write.partitionBy("file").text(path)
    read = card_text.read_card_text(spark, f"{path}/*")
    parsed = card_text.parse_card_lines(card_text.stitch_lines(read))
    read = [F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("raw_description", "card_type", "signed")]
    return parsed.select("tx_id", F.when(F.col("error").isNull(), F.col("tx_date")).alias("tx_date"), *read, "direction", "error")


@query
def import_neighbours(spark, sf_dir):
    """Import rows with the labels of their nearest ledger rows; those that disagree put a row in doubt."""
    preview = _bank_preview(spark, sf_dir)
    embeddings = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")
    vectors = preview.join(embeddings, "pos").select("file", "pos", "embedding")
    found = neighbours.import_neighbours(preview, vectors, fx.points(spark, sf_dir))
    near = F.transform("neighbours", lambda n: F.concat_ws(":", n["point_id"], n["category"], n["subcategory"]))
    return found.select("file", "pos", "status", "tone", "neighbours_mixed", F.concat_ws(",", near).alias("near"))


@query
def refund_follows_charge(spark, sf_dir):
    rows = fx.ledger(spark, sf_dir).where(F.col("flow_kind").isin(EXPENSE, REFUND))
    found = imports.nearest_charge(rows, ["src"], "id")
    fields = ("gap", "same_amount", "charge_category", "charge_subcategory", "in_doubt")
    return found.select("src", "id", *fields)


def _overrides(staged: DataFrame) -> DataFrame:
    """A reviewer's choices, one per new row: urgent ones get another label, high ones a merchant."""
    rows = staged.where(F.col("status") == "nieuw")
    chosen = rows.groupBy("tx_id").agg(F.min("mutation_kind").alias("kind"))
    return chosen.select(
        "tx_id",
        F.when(F.col("kind") == "1-URGENT", "Huishouden").otherwise("").alias("category"),
        F.when(F.col("kind") == "1-URGENT", "boodschappen").otherwise("").alias("subcategory"),
        F.when(F.col("kind") == "2-HIGH", "Winkel NL00BANK0123456789").otherwise("").alias("merchant"),
    )


@query
def import_commit(spark, sf_dir):
    staged = checkpointed(_bank_preview(spark, sf_dir))
    rows = imports.apply_overrides(staged, _overrides(staged))
    fresh = imports.new_rows(rows, fx.bank_ledger(spark, sf_dir))
    return imports.to_ledger(fresh, "bank", F.col("pos")).drop("similarity", "orig_category", "orig_subcategory")


@query
def redacted_documents(spark, sf_dir):
    texts = fx.table(spark, sf_dir, "documents").withColumn("clean", strip_iban(F.col("text")))
    return texts.select(
        "doc_id",
        redact(F.col("text")).alias("shown"),
        F.md5(F.col("clean").cast("binary")).alias("clean_md5"),
        F.left("clean", F.lit(INDEX_LIMIT)).alias("index_text"),
        F.md5(anonymise(F.col("text"), fx.RULES).cast("binary")).alias("anonymous_md5"),
        looks_secret(F.col("text")).alias("secret"),
        F.length(key_of_clean(F.col("clean"))).alias("key_length"),
    )


# Settlements.


@query
def settlements(spark, sf_dir):
    return settle.settlements(fx.bank_ledger(spark, sf_dir), fx.card_ledger(spark, sf_dir), WHOLE)


@query
def settlements_one_year(spark, sf_dir):
    return settle.settlements(fx.bank_ledger(spark, sf_dir), fx.card_ledger(spark, sf_dir), ONE_YEAR)


# Review.


def _suggested(spark, sf_dir):
    return memory.suggestions(memory.memory_corpus(fx.ledger(spark, sf_dir)))


def _queue(name: str, with_suggestions: bool = False, text: str | None = None) -> Query:
    def run(spark, sf_dir):
        suggested = _suggested(spark, sf_dir) if with_suggestions else None
        rows = review.queue(fx.ledger(spark, sf_dir), name, WHOLE, suggested, text)
        return plain(rows.select("src", "tx_id", "ym", "category", "subcategory", "flow_kind"))

    return run


QUERIES["queue_doubt"] = _queue("twijfel", with_suggestions=True)
QUERIES["queue_mismatch"] = _queue("mismatch", with_suggestions=True)
QUERIES["queue_overig"] = _queue("overig")
QUERIES["queue_saving_odd"] = _queue("saving_odd")
QUERIES["queue_unclassified"] = _queue("unclassified")
QUERIES["queue_corrected"] = _queue("corrected")
QUERIES["queue_search"] = _queue("zoek", text="  FURN%")
QUERIES["queue_split_text"] = _queue("split_text")
QUERIES["queue_all"] = _queue("all")


@query
def review_page(spark, sf_dir):
    rows = review.queue(fx.ledger(spark, sf_dir), "overig", WHOLE)
    return review.present(review.page(rows, 3)).drop("embed_text")


@query
def review_page_deep(spark, sf_dir):
    """A page far down in the queue of all rows, and the last one of the split-text queue, with the place of each row."""
    every = review.queue(fx.ledger(spark, sf_dir), "all", WHOLE)
    split = review.queue(fx.ledger(spark, sf_dir), "split_text", WHOLE)
    n = review.queue_size(split).first()["n"]
    deep = review.page_at(every, 61).select("src", "tx_id", "ym", "place", F.lit("all").alias("queue"))
    last = review.page_at(split, -(-n // review.PAGE_SIZE), newest_source_first=True)
    return deep.unionByName(last.select("src", "tx_id", "ym", "place", F.lit("split_text").alias("queue")))


@query
def queue_search_indexed(spark, sf_dir):
    """Rows with a text in one of the searched columns, by an index of the text that an import has added to."""
    ledger = fx.ledger(spark, sf_dir)
    rows = checkpointed(review.queue(ledger, "all", WHOLE).select("src", "tx_id", "id", *SEARCHED))
    index = TextIndex.create(rows.where(F.col("id") % 7 != 0), shared_folder(spark, "text-index"), digits=1)
    index.add(rows.where(F.col("id") % 7 == 0), "import", digits=1)
    found = None
    for text in ("  FURN%", "Huis", "ery ger", "BUILDING CHINA NL00", "sho", "op", "nowhere at all", ""):
        part = index.search(text).withColumn("needle", F.lit(text))
        found = part if found is None else found.unionByName(part)
    return found


@query
def known_ids(spark, sf_dir):
    """Which rows of an import are loaded already, by an index of ids of which only the import's buckets are read."""
    raw = bank_csv.parse_bank_rows(fx.bank_cells(spark, sf_dir)).where("error is null").select("file", "pos", "tx_id")
    ids = BucketTable.create(
        loaded_ids(fx.bank_ledger(spark, sf_dir)), shared_folder(spark, "ids"), ["tx_id"], digits=1
    )
    raw = checkpointed(raw)
    return with_known(raw, ids).select("file", "pos", "tx_id", "known")


@query
def rows_by_id(spark, sf_dir):
    """Five rows looked up one by one in a ledger stored by id; structural ones are not shown."""
    ledger = checkpointed(fx.ledger(spark, sf_dir).select("src", "tx_id", "amount", "category", "flow_kind"))
    stored = BucketTable.create(ledger, shared_folder(spark, "ledger"), ["src", "tx_id"])
    found = None
    for row in ledger.orderBy("tx_id", "src").limit(5).collect():
        one = review.one_row(stored.one(row["src"], row["tx_id"]), row["src"], row["tx_id"])
        found = one if found is None else found.unionByName(one)
    return found


@query
def split_text_page(spark, sf_dir):
    """The second page of the split-text queue, bank rows before card rows turned around, with the place of each row."""
    rows = review.queue(fx.ledger(spark, sf_dir), "split_text", WHOLE)
    found = review.page(rows, 2, newest_source_first=True).select("src", "tx_id", "ym")
    order = Window.orderBy(F.desc("ym"), F.desc("src"), F.desc("tx_id"))
    return found.withColumn("place", F.row_number().over(order))


@query
def queue_totals(spark, sf_dir):
    """How many rows each queue holds."""
    ledger = kept(fx.ledger(spark, sf_dir), "ledger")
    suggested = memory.suggestions(memory.memory_corpus(ledger)).select("src", "tx_id", "layer", "disagrees")
    suggested = kept(suggested, "suggested")
    totals = None
    for name in review.QUEUES:
        rows = review.queue(ledger, name, WHOLE, suggested, "  FURN%" if name == "zoek" else None)
        part = review.queue_size(rows).withColumn("queue", F.lit(name))
        totals = part if totals is None else totals.unionByName(part)
    return totals


@query
def doubt_flags(spark, sf_dir):
    flagged = review.doubt_flags(fx.ledger(spark, sf_dir), fx.bank_ledger(spark, sf_dir))
    return flagged.select(
        "src",
        "tx_id",
        F.concat_ws(",", "flags").alias("flags"),
        F.col("suggest.category").alias("suggest_category"),
        F.col("suggest.subcategory").alias("suggest_subcategory"),
        F.col("suggest.source").alias("suggest_source"),
        "above",
        "bulk_ok",
        "doubt",
    )


def _items(spark, sf_dir):
    """A batch of corrections, one per ledger row; the row's merchant and account decide what it asks for."""
    rows = fx.ledger(spark, sf_dir)
    kind = F.col("id") % 6
    return rows.select(
        (F.col("id") * 2 + F.when(F.col("src") == "bank", 0).otherwise(1)).alias("seq"),
        "src",
        "tx_id",
        F.when(kind == 0, "Vervoer")
        .when(kind == 1, "Huishouden")
        .when(kind == 2, "Huishouden")
        .when(kind == 3, "Onbekend")
        .when(kind == 4, "Interne overboeking")
        .otherwise("")
        .alias("category"),
        F.when(kind == 0, "taxi")
        .when(kind == 2, "tuin 12345678")
        .when(kind == 3, "paar")
        .when(kind == 4, "intern")
        .otherwise("")
        .alias("subcategory"),
        F.when((kind == 1) & (F.col("id") > 100), "tuin").otherwise("").alias("new_subcategory"),
        F.when(kind == 0, " Taxi NL00BANK0123456789 ").otherwise("").alias("merchant"),
        F.when(kind == 0, F.lit(0.91)).cast("decimal(6,4)").alias("similarity"),
    ).withColumn("subcategory", F.when(F.col("subcategory") == "tuin 12345678", "tuin").otherwise(F.col("subcategory")))


_LABELS = ("src", "tx_id", "category", "subcategory", "merchant", "orig_category", "orig_subcategory", "similarity")


@query
def corrected_ledger(spark, sf_dir):
    ledger = fx.ledger(spark, sf_dir)
    corrected, _ = corrections.apply_corrections(ledger, _items(spark, sf_dir), reports.allowed_pairs(ledger))
    return corrected.select(*_LABELS)


@query
def correction_rejects(spark, sf_dir):
    ledger = fx.ledger(spark, sf_dir)
    _, rejects = corrections.apply_corrections(ledger, _items(spark, sf_dir), reports.allowed_pairs(ledger))
    return rejects.select("seq", "src", "tx_id", "reason")


@query
def undo_ledger(spark, sf_dir):
    ledger = fx.ledger(spark, sf_dir)
    return corrections.undo_corrections(ledger, ledger.where(F.col("account") == "Rekening A")).select(*_LABELS)


@query
def bulk_corrections(spark, sf_dir):
    ledger = fx.ledger(spark, sf_dir)
    items = _items(spark, sf_dir).drop("similarity")
    flagged = review.doubt_flags(ledger, fx.bank_ledger(spark, sf_dir))
    bulk = corrections.bulk_items(items, flagged)
    return corrections.judge(bulk, ledger, reports.allowed_pairs(ledger)).select("seq", "src", "tx_id", "reason")


@query
def move_over_tables(spark, sf_dir):
    """A pair moved in both ledgers and in the stored suggestions: counts before and after, and what is left behind."""
    ledger, pair = fx.ledger(spark, sf_dir), ("Huishouden", "Wonen", "furniture")
    tables = {
        "bank": ledger.where(F.col("src") == "bank").select("src", *memory.LABEL),
        "card": ledger.where(F.col("src") == "cc").select("src", *memory.LABEL),
        "suggestions": checkpointed(_suggested(spark, sf_dir)).select("src", *memory.LABEL),
    }
    moved, counts = corrections.move(tables, *pair)
    corrections.check_moved(moved, pair[0], pair[2])
    left = None
    for name, table in moved.items():
        part = corrections.left_behind(table, pair[0], pair[2]).agg(F.count(F.lit(1)).alias("n"))
        part = part.select(F.lit(None).cast("string").alias("src"), F.lit(pair[0]).alias("category"), F.lit(pair[2]).alias("subcategory"), "n", F.lit(name).alias("table_name"), F.lit("left").alias("moment"))
        left = part if left is None else left.unionByName(part)
    return counts.unionByName(left)


@query
def move_stored(spark, sf_dir):
    """The same move in stored tables that change together, counted in what is then stored."""
    ledger = checkpointed(fx.ledger(spark, sf_dir).select("src", "tx_id", *memory.LABEL))
    stored = {
        "bank": ledger.where(F.col("src") == "bank"),
        "card": ledger.where(F.col("src") == "cc"),
        "suggestions": checkpointed(_suggested(spark, sf_dir)).select("src", "tx_id", *memory.LABEL),
    }
    keys = dict.fromkeys(stored, ["src", "tx_id"])
    tables = TableSet.create(stored, shared_folder(spark, "tables"), keys, digits=1)
    return corrections.move_stored(tables, list(stored), "Huishouden", "Wonen", "furniture")


@query
def copy_resumed(spark, sf_dir):
    """The bank ledger copied in two runs, the first of five slices: checks of every slice, and what the second run did."""
    copy, bank = CheckedCopy(spark, shared_folder(spark, "copy")), checkpointed(fx.bank_ledger(spark, sf_dir))
    copy.run(bank, at_most=5)
    outcomes = copy.run(bank)
    done = spark.createDataFrame(sorted(outcomes.items()), "slice string, outcome string")
    sums = copy.read().groupBy(F.left("tx_id", F.lit(1)).alias("slice")).agg(F.sum("amount").alias("amount"))
    return copy.report().drop("checksum").join(done, "slice").join(sums, "slice")


@query
def relabel_counts(spark, sf_dir):
    ledger, move = fx.ledger(spark, sf_dir), ("Huishouden", "Wonen", "furniture")

    def counted(table: DataFrame, when: str) -> DataFrame:
        return corrections.relabel_counts(table, *move).withColumn("moment", F.lit(when))

    return counted(ledger, "before").unionByName(counted(corrections.relabel(ledger, *move), "after"))


# Neighbours.


def _neighbours(spark, sf_dir, scope="direction"):
    points = fx.points(spark, sf_dir)
    return neighbours.labelled(neighbours.nearest(points, points, scope=scope))


@query
def knn_top5(spark, sf_dir):
    found = _neighbours(spark, sf_dir).select("point_id", F.posexplode("neighbours").alias("place", "n"))
    return found.select(
        "point_id", (F.col("place") + 1).alias("place"), "n.category", F.round("n.score", 4).alias("score")
    )


@query
def knn_proposals(spark, sf_dir):
    found = _neighbours(spark, sf_dir).withColumn("p", neighbours.proposal(F.col("neighbours")))
    split = F.transform("p.split", lambda s: F.concat_ws(":", s["category"], s["subcategory"], s["n"].cast("string")))
    return found.select(
        "point_id",
        "p.category",
        "p.subcategory",
        "p.unanimous",
        "p.neighbor_n",
        "p.mixed",
        F.concat_ws(",", split).alias("split"),
    )


@query
def knn_variants(spark, sf_dir):
    """Live neighbours as a matcher: always, unanimous only, and over both directions."""
    points = fx.points(spark, sf_dir).select(
        F.col("point_id").alias("id"), F.col("payload.category"), F.col("payload.subcategory")
    )

    def judged(scope: str | None, name: str) -> DataFrame:
        found = _neighbours(spark, sf_dir, scope).withColumn("p", neighbours.proposal(F.col("neighbours")))
        rows = points.join(found, F.col("id") == F.col("point_id"))
        hit = F.struct("p.category", "p.subcategory")
        always = F.when(F.col("p").isNotNull(), hit)
        return memory.compare_variants(rows, {name: always, f"{name}'": F.when(F.col("p.unanimous"), hit)})

    return judged("direction", "C").unionByName(judged(None, "all"))


def _proposed(spark, sf_dir) -> DataFrame:
    """Ledger rows that have a vector, with their memory and what their neighbours propose."""
    corpus = _with_memory(spark, sf_dir).where(F.col("src") == "bank")
    ids = fx.bank_ledger(spark, sf_dir).select(F.col("id").alias("vec_id"), F.col("tx_id").alias("_tx_id"), F.col("direction").alias("way"))
    vectors = fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = checkpointed(corpus.join(ids.join(vectors, "vec_id"), F.col("tx_id") == F.col("_tx_id")))
    points = rows.select(
        F.col("vec_id").cast("string").alias("point_id"),
        F.col("way").alias("direction"),
        F.struct("category", "subcategory").alias("payload"),
        "embedding",
    )
    found = neighbours.labelled(neighbours.nearest(points, points)).withColumn("p", neighbours.proposal(F.col("neighbours")))
    return rows.join(found, F.col("vec_id").cast("string") == F.col("point_id")).select(*memory.LABEL, "memory", "p")


def _neighbour_variants() -> dict[str, Column]:
    """Live neighbours, unanimous ones only, and memory before those."""
    pair = F.struct("p.category", "p.subcategory")
    unanimous = F.when(F.col("p.unanimous"), pair)
    recalled = F.when(F.col("memory").isNotNull(), F.struct("memory.category", "memory.subcategory"))
    return {
        "C": F.when(F.col("p").isNotNull(), pair),
        "C'": unanimous,
        "E": memory.first_proposal(recalled, unanimous),
    }


@query
def knn_memory_variants(spark, sf_dir):
    return memory.compare_variants(_proposed(spark, sf_dir), _neighbour_variants())


@query
def knn_confusion(spark, sf_dir):
    return memory.confusion_by_variant(_proposed(spark, sf_dir), _neighbour_variants())


@query
def knn_recall(spark, sf_dir):
    """Whether the approximate search finds nine in ten of the true neighbours on the given vectors."""
    points = fx.points(spark, sf_dir)
    found = neighbours.nearest(points, points, recall=0.95, n_cells=45)
    measured = neighbours.recall(found, neighbours.nearest_exact(points, points))
    return measured.select("queries", "neighbours", (F.col("recall") >= 0.9).alias("enough"))


@query
def point_ids(spark, sf_dir):
    rows = neighbours.index_rows(fx.ledger(spark, sf_dir))
    return rows.select("point_id", "index_text", "payload.*")


@query
def points_stored(spark, sf_dir):
    """The vector table after an upsert, a patch and a removal, read back, with the generation of each point's bucket."""
    points, number = fx.points(spark, sf_dir), F.col("point_id").cast("long")
    table = VectorTable.of(points.where(number % 4 != 0), shared_folder(spark, "points"))
    table.upsert(points.where(number % 10 == 0).withColumn("payload", F.col("payload").withField("category", F.lit("N"))))
    named = points.where(number % 50 == 7).select("point_id")
    table.patch(named.select("point_id", F.lit(None).cast("string").alias("category"), F.lit("P").alias("subcategory")))
    table.remove(points.where(number % 100 == 3))
    at = table.manifest()
    written = spark.createDataFrame(list(at.numbers.items()), "bucket string, generation long")
    rows = table.read().withColumn("bucket", bucket_of(at.keys, at.digits)).join(written, "bucket")
    return rows.select("point_id", "direction", "payload.category", "payload.subcategory", "bucket", "generation", F.size("embedding").alias("size"))


@query
def suggestions_stored(spark, sf_dir):
    """Suggestions written, written again over themselves, and read back."""
    path, suggested = shared_folder(spark, "suggestions"), checkpointed(_suggested(spark, sf_dir))
    for _ in range(2):
        memory.write_suggestions(suggested, path)
    return spark.read.parquet(path)


def _corpus_parts(spark, sf_dir):
    """The corpus without every seventh bank row, and those rows: an import of rows with old and with new texts."""
    corpus = checkpointed(memory.memory_corpus(fx.ledger(spark, sf_dir)))
    ids = fx.bank_ledger(spark, sf_dir).where(F.col("id") % 7 == 0).select("tx_id")
    late = F.col("src") == "bank"
    added = corpus.where(late).join(ids, "tx_id", "left_semi")
    return corpus.where(~late).unionByName(corpus.where(late).join(ids, "tx_id", "left_anti")), added


@query
def suggestions_refreshed(spark, sf_dir):
    """Suggestions of a part of the ledger, brought up to date when the rest is imported."""
    before, added = _corpus_parts(spark, sf_dir)
    store = SuggestionStore.create(before, shared_folder(spark, "store"), digits=1)
    store.refresh("import", added)
    return store.read()


@query
def suggestions_corrected(spark, sf_dir):
    """Suggestions brought up to date when every ninth bank row gets another label."""
    corpus = checkpointed(memory.memory_corpus(fx.ledger(spark, sf_dir)))
    ids = fx.bank_ledger(spark, sf_dir).where(F.col("id") % 9 == 0).select("tx_id")
    old = checkpointed(corpus.where(F.col("src") == "bank").join(ids, "tx_id", "left_semi"))
    new = old.withColumns({"category": F.lit("Wonen"), "subcategory": F.lit("tuin")})
    store = SuggestionStore.create(corpus, shared_folder(spark, "store"), digits=1)
    store.refresh("correction", new, old)
    return store.read()


@query
def ledger_copy(spark, sf_dir):
    """The bank ledger copied with checks, copied again (left alone), and read back by month."""
    path, bank = shared_folder(spark, "copy"), checkpointed(fx.bank_ledger(spark, sf_dir))
    outcomes = [copy_table(spark, bank, path), copy_table(spark, bank, path)]
    rows = read_bank(spark, path).groupBy("ym").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.count("similarity").alias("similarities")
    )
    return rows.withColumn("outcomes", F.lit(",".join(outcomes)))


@query
def stored_terms(spark, sf_dir):
    """Translations of two locales, stored, and those of one read back."""
    path, terms = shared_folder(spark, "terms"), fx.terms(spark, sf_dir)
    other = terms.withColumn("text", F.concat(F.lit("DE "), F.col("source")))
    both = terms.withColumn("locale", F.lit("en")).unionByName(other.withColumn("locale", F.lit("de")))
    both.write.parquet(path)
    return read_terms(spark, path, "en")


@query
def denied_merchants(spark, sf_dir):
    """Every merchant, and whether its name says nothing about what was bought."""
    names = fx.ledger(spark, sf_dir).select("merchant").distinct()
    spelled = names.select(F.explode(F.array("merchant", F.concat(F.lit(" "), F.upper("merchant")), F.lit("I.N.G. Bank"))).alias("merchant"))
    return spelled.distinct().select("merchant", is_denied_merchant(F.col("merchant")).alias("denied"))


# Audits.


@query
def audit_credit_buckets(spark, sf_dir):
    return audits.credit_buckets(fx.bank_ledger(spark, sf_dir))


@query
def audit_income_subs(spark, sf_dir):
    return audits.income_subs(fx.bank_ledger(spark, sf_dir))


@query
def audit_other_income_merchants(spark, sf_dir):
    return audits.other_income_merchants(fx.bank_ledger(spark, sf_dir))


@query
def audit_income_expense_overlap(spark, sf_dir):
    return audits.income_expense_overlap(fx.bank_ledger(spark, sf_dir))


@query
def audit_saving_merchants(spark, sf_dir):
    return audits.saving_merchants(fx.bank_ledger(spark, sf_dir))


@query
def audit_refund_groups(spark, sf_dir):
    return audits.refund_groups(fx.bank_ledger(spark, sf_dir))


@query
def audit_refund_total(spark, sf_dir):
    return audits.refund_total(fx.bank_ledger(spark, sf_dir))


@query
def audit_charging(spark, sf_dir):
    return audits.charging(fx.bank_ledger(spark, sf_dir))


@query
def audit_card_credits(spark, sf_dir):
    return audits.card_credits(fx.card_ledger(spark, sf_dir))


@query
def audit_id_lengths(spark, sf_dir):
    return audits.id_lengths(fx.ledger(spark, sf_dir))


@query
def audit_hash_recipe(spark, sf_dir):
    bank, card = fx.bank_raw(spark, sf_dir), fx.card_raw(spark, sf_dir)
    cells = ["raw_date", "description", "memo", "balance_after"]
    parts = ["raw_date", "raw_description", "card_type", "token"]
    of_bank = audits.hash_recipe(bank, cells, ["raw_date", "description", "balance_after"])
    of_card = audits.hash_recipe(card, parts, ["raw_date", "raw_description", "card_type", "amount"])
    return of_bank.withColumn("src", F.lit("bank")).unionByName(of_card.withColumn("src", F.lit("cc")))


@query
def audit_raw_overlap(spark, sf_dir):
    raw = _bank_preview(spark, sf_dir).select(F.concat(F.col("tx_id"), F.lit(" ")).alias("tx_id"))
    return audits.id_overlap(raw, fx.bank_ledger(spark, sf_dir))


@query
def profile_frequencies(spark, sf_dir):
    bank, card = fx.bank_ledger(spark, sf_dir), fx.card_ledger(spark, sf_dir)
    of_bank = audits.frequencies(bank, (*audits.PROFILED, "counter_account")).withColumn("src", F.lit("bank"))
    return of_bank.unionByName(audits.frequencies(card).withColumn("src", F.lit("cc")))


@query
def profile_counter_accounts(spark, sf_dir):
    return audits.counter_accounts(fx.bank_ledger(spark, sf_dir))


@query
def profile_counter_account_labels(spark, sf_dir):
    return audits.counter_account_labels(fx.bank_ledger(spark, sf_dir))


@query
def profile_pairs(spark, sf_dir):
    return audits.pair_counts(fx.ledger(spark, sf_dir))


@query
def profile_hypotheses(spark, sf_dir):
    return audits.hypotheses(fx.ledger(spark, sf_dir))


@query
def profile_date_range(spark, sf_dir):
    return audits.date_range(fx.ledger(spark, sf_dir))


@query
def profile_months(spark, sf_dir):
    return audits.months(fx.ledger(spark, sf_dir))


@query
def snapshot_check(spark, sf_dir):
    bank = table_stats(fx.bank_ledger(spark, sf_dir)).withColumn("src", F.lit("bank"))
    return bank.unionByName(table_stats(fx.card_ledger(spark, sf_dir)).withColumn("src", F.lit("cc")))

