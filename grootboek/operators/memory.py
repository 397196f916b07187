"""Category memory: what earlier rows with the same text were booked as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grootboek.functions.text import index_text, key_of_index_text, merchant_key, strip, text_or_empty
from grootboek.operators.classify import without_structural
from grootboek.skew import lookup
from grootboek.vocabulary import DEFAULT, STRUCTURAL_KINDS, Vocabulary

# How many rows must agree, and how strongly.
MEMORY_MIN_ROWS = 3
MEMORY_MIN_SHARE = 0.80
MERCHANT_MIN_ROWS = 8
MERCHANT_MIN_SHARE = 0.75
CONFUSION_LIMIT = 8
CONFUSION_MIN_ROWS = 2

TEXT_KEY = ["text_key", "direction"]
LABEL = ["category", "subcategory"]


def memory_corpus(ledger: DataFrame) -> DataFrame:
    """Rows that may teach a category: no structural rows, and no personal columns leave this function.

    ``text_key`` and ``direction`` are NULL where a row has no usable key.
    """
    rows = without_structural(ledger).select("src", "tx_id", "description", "direction", *LABEL)
    return with_memory_keys(rows).select("src", "tx_id", *[F.col(f"own_{k}").alias(k) for k in (*TEXT_KEY, *LABEL)])


def with_memory_keys(rows: DataFrame) -> DataFrame:
    """Adds ``own_...``: the text, direction and label under which a ledger row is remembered.

    The text goes through several expressions; each step is a column of its own, so it is computed once.
    """
    steps = rows.withColumn("_text", index_text(F.col("description")))
    steps = steps.withColumns({"_key": key_of_index_text(F.col("_text")), "_way": strip(F.col("direction"))})
    usable = (F.col("_key") != "") & (F.col("_way") != "")
    return steps.withColumns(
        {
            "own_text_key": F.when(usable, F.col("_key")),
            "own_direction": F.when(usable, F.col("_way")),
            "own_category": text_or_empty(F.col("category")),
            "own_subcategory": text_or_empty(F.col("subcategory")),
        }
    ).drop("_text", "_key", "_way")


def label_counts(corpus: DataFrame) -> DataFrame:
    """How many rows each (text, direction) has with each label."""
    keyed = corpus.where(F.col("text_key").isNotNull() & F.col("direction").isNotNull())
    return keyed.groupBy(*TEXT_KEY, *LABEL).agg(F.count(F.lit(1)).alias("label_n"))


def _top_label() -> Column:
    return F.max(F.struct("label_n", "category", "subcategory"))


def _suggestion(category: Column, subcategory: Column, hits: Column, n: Column, unanimous: Column) -> Column:
    """A proposal, or NULL when too few rows agree or the label is incomplete.

    With a share of at least 0.80 there is one candidate only, so ties cannot matter.
    """
    share = hits.cast("double") / n.cast("double")
    good = (n >= MEMORY_MIN_ROWS) & (share >= MEMORY_MIN_SHARE) & (category != "") & (subcategory != "")
    hit = F.struct(
        category.alias("category"),
        subcategory.alias("subcategory"),
        n.cast("bigint").alias("n"),
        share.alias("share"),
        unanimous.alias("unanimous"),
    )
    return F.when(good, hit)


def text_memory(corpus: DataFrame) -> DataFrame:
    """What each (text, direction) is usually booked as; keys without a clear answer are left out."""
    per_text = label_counts(corpus).groupBy(*TEXT_KEY)
    totals = per_text.agg(
        F.sum("label_n").alias("n"), _top_label().alias("top"), F.count(F.lit(1)).alias("labels")
    )
    memory = _suggestion(
        F.col("top.category"), F.col("top.subcategory"), F.col("top.label_n"), F.col("n"), F.col("labels") == 1
    )
    return totals.select(*TEXT_KEY, memory.alias("memory")).where(F.col("memory").isNotNull())


def leave_one_out_answers(counts: DataFrame) -> DataFrame:
    """Per (text, direction, label): what the other rows with that text say to a row with that label.

    Taking a row out changes its text's counts by one, so counts per label (``label_counts``) suffice: no row meets
    another row. ``label_n`` is the number of rows an answer is for; ``memory`` is NULL where the others disagree.
    """
    same_text = Window.partitionBy(*TEXT_KEY)  # over label counts, one row per label of a text
    counts = counts.select(
        *TEXT_KEY,
        *LABEL,
        "label_n",
        F.sum("label_n").over(same_text).alias("n"),
        _top_label().over(same_text).alias("top"),
        F.count(F.lit(1)).over(same_text).alias("labels"),
    )
    own_is_top = (F.col("category") == F.col("top.category")) & (F.col("subcategory") == F.col("top.subcategory"))
    left_over = F.col("labels") - F.when(F.col("label_n") == 1, 1).otherwise(0)
    memory = _suggestion(
        F.col("top.category"),
        F.col("top.subcategory"),
        F.col("top.label_n") - F.when(own_is_top, 1).otherwise(0),
        F.col("n") - 1,
        left_over == 1,
    )
    return counts.select(*TEXT_KEY, *LABEL, "label_n", memory.alias("memory"))


def leave_one_out(corpus: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The corpus with ``memory``: for each row, what the *other* rows with its text and direction say. ``counts`` are
    those of a larger corpus that these rows are part of."""
    answers = leave_one_out_answers(label_counts(corpus) if counts is None else counts)
    found = lookup(corpus, answers, [*TEXT_KEY, *LABEL], spread=["src", "tx_id"])
    return found.drop("label_n")


def suggestions(corpus: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The stored suggestion per row: the memory's answer (layer ``text``) or the row's own label (layer ``none``)."""
    rows = leave_one_out(corpus, counts).where(text_or_empty(F.col("tx_id")) != "")
    hit = F.col("memory").isNotNull()

    def shown(field: str) -> Column:
        own = F.when(F.col(field) != "", F.col(field)).otherwise("?")
        return F.when(hit, F.col(f"memory.{field}")).otherwise(own).alias(field)

    differs = (F.col("memory.category") != F.col("category")) | (F.col("memory.subcategory") != F.col("subcategory"))
    return rows.select(
        "src",
        "tx_id",
        shown("category"),
        shown("subcategory"),
        F.coalesce("memory.share", F.lit(0.0)).cast("decimal(6,4)").alias("score"),
        F.coalesce("memory.unanimous", F.lit(False)).alias("unanimous"),
        F.coalesce("memory.n", F.lit(0)).alias("neighbor_n"),
        F.when(hit, "text").otherwise("none").alias("layer"),
        F.coalesce(differs, F.lit(False)).alias("disagrees"),
    )


def write_suggestions(suggested: DataFrame, path: str) -> None:
    """Replace the stored suggestions. They are derived, so a refresh writes them whole."""
    suggested.write.mode("overwrite").parquet(path)


def merchant_stats(bank: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """Per merchant of ordinary spending: its usual label when stable, or a mark that it is mixed.

    Counts are taken per spelling of the merchant and label, then compared per caseless merchant.
    """
    excluded_subs = (v.deposit_sub, v.settlement_pair[1], v.withdrawal_sub)
    spending = (
        bank.where(F.col("direction") == v.debit)
        .where(~F.col("category").isin(v.internal_category, v.income_category))
        .where(~F.col("subcategory").isin(*excluded_subs))
        .where(F.trim("merchant") != "")
    )
    spelled = spending.groupBy("merchant", *LABEL).agg(F.count(F.lit(1)).alias("label_n"))
    keyed = spelled.withColumn("merchant_key", merchant_key(F.col("merchant"))).where(F.col("merchant_key") != "")
    per_key = keyed.groupBy("merchant_key").agg(
        _top_label().alias("top"), F.sum("label_n").alias("total"), F.count(F.lit(1)).alias("spellings")
    )
    top_n = F.col("top.label_n")
    share = top_n.cast("double") / F.col("total").cast("double")
    stable = (top_n >= MERCHANT_MIN_ROWS) & (share >= MERCHANT_MIN_SHARE)
    mixed = ~stable & (F.col("spellings") > 1) & (F.col("total") >= MERCHANT_MIN_ROWS)
    majority = F.struct(F.col("top.category"), F.col("top.subcategory"), top_n.alias("n"))
    return per_key.select(
        "merchant_key", F.when(stable, majority).alias("majority"), mixed.alias("mixed")
    ).where(F.col("majority").isNotNull() | F.col("mixed"))


def merchant_majority(bank: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    stats = merchant_stats(bank, v).where(F.col("majority").isNotNull())
    return stats.select("merchant_key", "majority.category", "majority.subcategory", "majority.n")


def mixed_merchants(bank: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    return merchant_stats(bank, v).where(F.col("mixed")).select("merchant_key")


def split_texts(ledger: DataFrame) -> DataFrame:
    """Descriptions, over all time, that carry more than one complete label."""
    rows = without_structural(ledger).where(F.col("category").isNotNull() & F.col("subcategory").isNotNull())
    labelled = rows.select(F.lower(F.trim("description")).alias("text_key"), *LABEL)
    labels = labelled.where(F.col("text_key") != "").distinct()
    return labels.groupBy("text_key").agg(F.count(F.lit(1)).alias("labels")).where(F.col("labels") > 1)


def index_stats(ledger: DataFrame) -> DataFrame:
    """Rows per source and flow kind, and whether they enter the index."""
    counts = ledger.groupBy("src", "flow_kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("indexed", ~F.col("flow_kind").isin(*STRUCTURAL_KINDS))


# Judging proposals against the labels rows carry.


def first_proposal(*proposals: Column) -> Column:
    """The first proposal that is not NULL."""
    return F.coalesce(*proposals)


def tally(rows: DataFrame, proposal: str, *by: str) -> DataFrame:
    """How often a proposal was shown and right. ``rows`` holds ``category``, ``subcategory`` and the proposal."""
    shown = F.col(proposal).isNotNull()
    same_category = F.col(f"{proposal}.category") == F.col("category")
    same_pair = same_category & (F.col(f"{proposal}.subcategory") == F.col("subcategory"))
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(shown).alias("shown"),
        F.count_if(same_category).alias("category_ok"),
        F.count_if(same_pair).alias("pair_ok"),
    )

    def accuracy(ok: str) -> Column:
        return F.when(F.col("shown") > 0, F.col(ok) / F.col("shown"))

    return counts.withColumns(
        {
            "silent": F.col("n") - F.col("shown"),
            "category_acc": accuracy("category_ok"),
            "pair_acc": accuracy("pair_ok"),
        }
    )


def confusion(rows: DataFrame, proposal: str, limit: int = CONFUSION_LIMIT) -> DataFrame:
    """The most frequent wrong categories, seen at least twice."""
    pairs = rows.select(F.col("category").alias("gold"), F.col(f"{proposal}.category").alias("suggested"))
    wrong = pairs.where(F.col("gold") != F.col("suggested"))
    counts = wrong.groupBy("gold", "suggested").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.where(F.col("n") >= CONFUSION_MIN_ROWS)
        .orderBy(F.desc("n"), "gold", "suggested")
        .limit(limit)
    )


def _judged(rows: DataFrame, variants: dict[str, Column]) -> DataFrame:
    """Each row under every variant, read once."""
    judged = F.array(
        *[F.struct(F.lit(name).alias("variant"), hit.alias("proposal")) for name, hit in variants.items()]
    )
    return rows.select(*LABEL, F.explode(judged).alias("v")).select(*LABEL, "v.variant", "v.proposal")


def compare_variants(rows: DataFrame, variants: dict[str, Column]) -> DataFrame:
    """One ``tally`` row per named variant, in one pass."""
    return tally(_judged(rows, variants), "proposal", "variant")


def confusion_by_variant(rows: DataFrame, variants: dict[str, Column], limit: int = CONFUSION_LIMIT) -> DataFrame:
    """``confusion`` of every named variant, in one pass, with the ``place`` in its list."""
    pairs = _judged(rows, variants).select(
        "variant", F.col("category").alias("gold"), F.col("proposal.category").alias("suggested")
    )
    counts = pairs.where(F.col("gold") != F.col("suggested")).groupBy("variant", "gold", "suggested")
    listed = counts.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CONFUSION_MIN_ROWS)
    order = Window.partitionBy("variant").orderBy(F.desc("n"), "gold", "suggested")
    return listed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


