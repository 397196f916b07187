"""Card statements as text lines.

Some statements break a transaction over two lines: date and description, then type and amount. Joining the two needs
the next line. Lines are therefore ordered inside short spans of the file block Spark read them from, which bounds how
many belong together; the last line of a span looks at the first line of the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grootboek.functions.dates import card_date
from grootboek.functions.ids import card_tx_id
from grootboek.functions.money import MONEY, hash_token, parse_amount
from grootboek.functions.text import strip
from grootboek.sources.spans import KEYS, in_file, in_span, in_spans, read_lines
from grootboek.vocabulary import DEFAULT, Vocabulary

# The shape of a statement line.
AMOUNT = r"[+-] ?\d{1,3}(?:\.\d{3})*,\d{2}"
DATE = r"^\d{2}-\d{2}-\d{4}"
OTHER_TYPE = r"[A-Za-z][A-Za-z]{2,}"
UNIX_LINES = "(?d)"


def _known_types(v: Vocabulary) -> str:
    return "|".join((v.collection_type, v.payment_type, v.costs_type))


def _known_line(v: Vocabulary) -> str:
    return rf"{UNIX_LINES}{DATE} .+ (?:{_known_types(v)}) {AMOUNT}$"


def _other_line() -> str:
    return rf"{UNIX_LINES}{DATE} .+ ({OTHER_TYPE}) {AMOUNT}$"


def is_transaction_line(line: Column, v: Vocabulary = DEFAULT) -> Column:
    return line.rlike(_known_line(v)) | line.rlike(_other_line())


def read_card_text(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """Lines of statement texts with their ``file``, the ``block`` they came from and their order in it."""
    return read_lines(spark, paths, encoding).select("file", "block", "seq", "line")


def stitch_lines(lines: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """Transaction lines, and dated lines that are none (``matched`` false).

    A dated line followed by a bare ``Type amount`` line is joined with it. Such a continuation never starts with a
    date, so using it up cannot change what any other line becomes.
    """
    line = F.col("line")
    filled = in_spans(lines.withColumn("line", strip(line)).where(line != ""))
    starts = filled.groupBy(*KEYS).agg(F.min_by("line", "seq").alias("first_line"))
    after = F.lead("first_line").over(in_file())
    # One row for each span: so small that the lines stay where they are.
    starts = F.broadcast(starts.select(*KEYS, after.alias("after_span")))

    next_here = filled.withColumns({"whole": is_transaction_line(line, v), "next_here": F.lead("line").over(in_span())})
    linked = next_here.where(line.rlike(DATE)).join(starts, KEYS)
    following = F.coalesce("next_here", "after_span")
    joined = F.concat_ws(" ", line, following)
    continues = following.rlike(rf"{UNIX_LINES}^{OTHER_TYPE} {AMOUNT}$") & is_transaction_line(joined, v)
    continued = ~F.col("whole") & F.coalesce(continues, F.lit(False))
    return linked.withColumn("continued", continued).select(
        "file",
        F.struct("block", "seq").alias("pos"),
        F.when(F.col("continued"), joined).otherwise(line).alias("line"),
        # Where lines were joined, the joined one is a transaction line.
        (F.col("whole") | F.col("continued")).alias("matched"),
    )


def parse_card_lines(stitched: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """Date, description, type, signed amount, hash token and id of each matched line.

    A known type is the first one named anywhere in the line. A costs line keeps its tail in the description: ids of
    earlier imports were made that way. ``error`` is set for lines that are no transaction or have no such date.
    """
    line = F.col("line")
    known = line.rlike(_known_line(v))
    card_type = F.when(known, F.regexp_extract(line, f"({_known_types(v)})", 1)).otherwise(
        F.regexp_extract(line, _other_line(), 1)
    )
    removable = f"{v.collection_type}|{v.payment_type}"
    tail_known = F.regexp_replace(line, rf"{UNIX_LINES} (?:{removable}) {AMOUNT}$", "")
    tail_other = F.regexp_replace(line, rf"{UNIX_LINES} {OTHER_TYPE} {AMOUNT}$", "")
    bare = F.when(known, tail_known).otherwise(tail_other)
    raw_date = F.left(line, F.lit(10))
    signed = parse_amount(F.regexp_extract(line, rf"{UNIX_LINES}({AMOUNT})$", 1))
    parsed = stitched.withColumns(
        {
            "raw_date": raw_date,
            "tx_date": card_date(raw_date),
            "card_type": F.when(F.col("matched"), card_type),
            "raw_description": F.when(F.col("matched"), strip(F.regexp_replace(bare, DATE + " ", ""))),
            "signed": F.when(F.col("matched"), signed.cast(MONEY)),
        }
    )
    good = F.col("matched") & F.col("tx_date").isNotNull()
    token = hash_token(F.col("signed"))
    tx_id = card_tx_id(F.col("raw_date"), F.col("raw_description"), F.col("card_type"), token)
    return parsed.withColumns(
        {
            "token": F.when(good, token),
            "tx_id": F.when(good, tx_id).otherwise(""),
            "amount": F.abs("signed"),
            "direction": F.when(good, card_direction(F.col("card_type"), F.col("signed"), v)),
            "error": F.when(~good, "unmatched"),
        }
    )


def card_direction(card_type: Column, signed: Column, v: Vocabulary = DEFAULT) -> Column:
    """A collection is always a credit; anything else is one when its amount is positive."""
    return F.when((card_type == v.collection_type) | (signed > 0), v.credit).otherwise(v.debit)
