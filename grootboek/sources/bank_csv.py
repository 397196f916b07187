"""Bank CSV files.

Files are read with an explicit all-text schema and split over tasks, whatever is in them. Two facts are looked up per
file before that: its header and separator (from its first lines), and whether a quoted cell runs over a line's end. A
file without such cells goes to Spark's CSV reader. Otherwise its lines are put together to records first
(``_records``): lines are ordered in short spans of the file block Spark read them from, and whether a line begins
inside a quoted cell follows from what the lines before it do to an open quote, span by span.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grootboek.functions.dates import bank_date
from grootboek.functions.ids import bank_tx_id
from grootboek.functions.money import MONEY, parse_amount
from grootboek.functions.text import strip, text_or_empty
from grootboek.sources.ledgers import union_all
from grootboek.sources.spans import KEYS, in_file, in_span, in_spans, read_lines

#: So many bytes of files at most make one task, where that gives more tasks than the session's own number.
TASK_BYTES = 32 << 20

# Header names of the bank's export, and ours.
COLUMNS = {
    "Datum": "raw_date",
    "Naam / Omschrijving": "raw_description",
    "Rekening": "raw_account",
    "Tegenrekening": "raw_counter_account",
    "Code": "code",
    "Af Bij": "direction",
    "Bedrag (EUR)": "raw_amount",
    "Mutatiesoort": "mutation_kind",
    "Mededelingen": "raw_memo",
    "Saldo na mutatie": "raw_balance",
}
REQUIRED = (
    "Datum",
    "Naam / Omschrijving",
    "Mededelingen",
    "Saldo na mutatie",
    "Af Bij",
    "Bedrag (EUR)",
    "Rekening",
)


class CsvFormatError(ValueError):
    """A file without the required columns. ``headers`` holds what it has instead."""

    def __init__(self, message: str, headers: Iterable[str] = ()):
        super().__init__(message)
        self.headers = list(headers)


def _opens(line: Column, separator: str) -> Column:
    """Whether a line that begins outside of quotes ends inside a quoted cell. A quote inside a bare cell is text."""
    inside, bare = '(?:[^"]|"")*+', f"[^{separator}]*+"
    cell = f'(?:"{inside}"{bare}|(?!"){bare})'
    return line.rlike(f'(?s)^(?:{cell}{separator})*+"{inside}$')


def _stays_open(line: Column, separator: str) -> Column:
    """Whether a line that begins inside a quoted cell ends inside one: in the same or in another one."""
    closed = F.regexp_extract(line, f'(?s)^(?:[^"]|"")*+"[^{separator}]*+{separator}(.*)$', 1)
    return line.rlike('(?s)^(?:[^"]|"")*+$') | _opens(closed, separator)


def _heads(lines: DataFrame) -> DataFrame:
    """First line, separator, whether a quoted cell holds a line break, and size, per file, in one pass over the lines."""
    first = F.min(F.when(F.col("block") == 0, F.struct("seq", "line")))["line"]
    some = F.col("line").contains('"')
    broken = [F.max(some & _opens(F.col("line"), sep)).alias(name) for sep, name in ((";", "_semi"), (",", "_comma"))]
    heads = lines.groupBy("file").agg(first.alias("header"), F.max("size").alias("size"), *broken)

    def occurrences(char: str) -> Column:
        return F.length("header") - F.length(F.translate("header", char, ""))

    semi = occurrences(";") >= occurrences(",")
    return heads.select(
        "file",
        "header",
        F.when(semi, ";").otherwise(",").alias("separator"),
        F.when(semi, F.col("_semi")).otherwise(F.col("_comma")).alias("broken"),
        "size",
    )


def _spread(lines: DataFrame, size: int) -> DataFrame:
    """``lines`` dealt out by span to so many tasks that each has a bounded share of the ``size`` bytes of the files."""
    n = -(-size // TASK_BYTES)
    return lines.repartition(n, *KEYS) if n > int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")) else lines


def _records(lines: DataFrame, separator: str, size: int) -> DataFrame:
    """The records of files whose quoted cells hold line breaks: (file, block, seq, line, first) with the place of the
    record's first line, the whole text of the record, and whether it is the file's first.

    A line keeps a quote open or shut, opens, shuts or flips it. Whether it begins inside a quoted cell is decided by the
    last line before it that opens or shuts whatever came, and by the flips since then; for the lines before a span,
    that is one value per span. Lines of one record meet by its first line; all other lines stay where they are. A quote
    that is never shut makes the rest of its file one record.
    """
    lines = in_spans(lines.select("file", "block", "seq", "line"))
    kinds = lines.withColumns({"_out": _opens(F.col("line"), separator), "_in": _stays_open(F.col("line"), separator)})
    flips = (F.col("_out") & ~F.col("_in")).cast("int")
    # Opens or shuts, whatever came.
    fixed = F.when(F.col("_out") == F.col("_in"), F.col("_in").cast("int"))
    before = in_span().rowsBetween(Window.unboundedPreceding, -1)
    stated = kinds.select(*KEYS, "seq", "line", fixed.alias("_fixed"), flips.alias("_flip"))
    counted = _spread(stated, size).withColumn("_flips", F.sum("_flip").over(in_span()))
    marked = F.when(F.col("_fixed").isNotNull(), F.struct(F.col("_fixed").alias("to"), F.col("_flips").alias("at")))
    traced = counted.select(
        *KEYS,
        "seq",
        "line",
        marked.alias("_mark"),
        "_flips",
        F.last(marked, ignorenulls=True).over(before).alias("_last"),
        (F.col("_flips") - F.col("_flip")).alias("_sofar"),
        F.row_number().over(in_span()).alias("_nth"),
    )

    def begins(enters: Column) -> Column:
        """Whether a line begins a record, if the span begins inside a quoted cell (1) or not (0)."""
        since = F.when(F.col("_last").isNull(), enters).otherwise(F.col("_last.to") - F.col("_last.at"))
        return (since + F.col("_sofar")) % 2 == 0

    # What a whole span does to an open quote, and from that the state in which each span begins; and the last line
    # before each span that begins a record, which a span gives for both states that it may begin in.
    end = traced.groupBy(*KEYS).agg(
        F.max_by(F.coalesce("_mark", "_last"), "seq").alias("_end"),
        F.max("_flips").alias("_all"),
        *[F.max(F.when(begins(F.lit(i)), F.struct("block", "seq"))).alias(f"_begun{i}") for i in (0, 1)],
    )
    earlier = in_file().rowsBetween(Window.unboundedPreceding, -1)
    ends = end.withColumn("_total", F.sum("_all").over(in_file()) - F.col("_all"))
    known = F.when(
        F.col("_end").isNotNull(),
        F.struct(F.col("_end.to").alias("to"), (F.col("_total") + F.col("_end.at")).alias("at")),
    )
    carried = F.last(known, ignorenulls=True).over(earlier)
    enters = (F.coalesce("_carried.to", F.lit(0)) + F.col("_total") - F.coalesce("_carried.at", F.lit(0))) % 2
    starts = ends.withColumn("_carried", carried).withColumn("_enters", enters)
    begun = F.when(F.col("_enters") == 0, F.col("_begun0")).otherwise(F.col("_begun1"))
    starts = starts.select(
        *KEYS,
        "_enters",
        F.last(begun, ignorenulls=True).over(earlier).alias("_before"),
        (F.row_number().over(in_file()) == 1).alias("_first"),
    )
    # One row for each span: so small that the lines stay where they are.
    placed = traced.join(F.broadcast(starts), KEYS)
    rows = placed.withColumn("_begins", begins(F.col("_enters")))
    # The last line of the file so far that begins a record: within the span, or in an earlier one.
    own = F.last(F.when(F.col("_begins"), F.struct("block", "seq")), ignorenulls=True).over(in_span())
    first = F.col("_first") & (F.col("block") == 0) & (F.col("_nth") == 1)
    rows = rows.select(
        *KEYS,
        "seq",
        "line",
        first.alias("first"),
        F.coalesce(own, "_before").alias("_from"),
        "_begins",
        F.lead("_begins").over(in_span()).alias("_next"),
    )
    # A line that begins a record and is followed, in its span, by another such line is a whole record.
    alone = rows.where(F.col("_begins") & F.coalesce("_next", F.lit(False)))
    parts = rows.where(~F.col("_begins") | ~F.coalesce("_next", F.lit(False)))
    whole = parts.groupBy("file", "_from").agg(
        F.array_sort(F.collect_list(F.struct("block", "seq", "line"))).alias("_lines"), F.max("first").alias("first")
    )
    text = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    together = whole.select("file", "_from.block", "_from.seq", text.alias("line"), "first")
    return alone.select("file", "block", "seq", "line", "first").unionByName(together)


def _header_names(header: str, separator: str) -> list[str]:
    bare = header.lstrip("﻿").rstrip("\r")
    return [name.strip().strip('"').strip() for name in bare.split(separator)]


def read_bank_csv(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """Raw cells of all files, one row per record, with ``file`` and the orderable ``pos`` inside it.

    What is collected is one line per file, never rows.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    heads = _heads(read_lines(spark, paths, encoding)).collect()
    if not heads:
        raise CsvFormatError("empty csv")

    alike = defaultdict(list)
    for head in heads:
        names = _header_names(head.header, head.separator)
        missing = [c for c in REQUIRED if c not in names]
        if missing:
            raise CsvFormatError("missing columns: " + ", ".join(missing), names)
        alike[(tuple(names), head.separator, bool(head.broken))].append(head)
    return union_all(
        [_read_alike(spark, found, names, sep, broken, encoding) for (names, sep, broken), found in alike.items()]
    )


def _read_alike(
    spark: SparkSession, heads: list[Row], names: tuple[str, ...], separator: str, broken: bool, encoding: str
) -> DataFrame:
    files = [head.file for head in heads]
    places = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(place, T.StringType()) for place in places])
    options = {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    block = F.struct(F.col("_block").alias("block"), F.col("_seq").alias("seq"))
    if broken:
        size = sum(head.size for head in heads)
        records = _records(read_lines(spark, files, encoding), separator, size).where(~F.col("first"))
        line = F.regexp_replace("line", "\r$", "")
        cells = F.from_csv(line, ", ".join(f"{place} string" for place in places), options | {"multiLine": "true"})
        found = records.where(line != "").select(
            "file", F.col("block").alias("_block"), F.col("seq").alias("_seq"), cells.alias("_cells")
        )
        rows = found.select("file", block.alias("pos"), "_cells.*")
    else:
        reader = spark.read.schema(schema).options(header=True, encoding=encoding, **options)
        rows = reader.csv(files).select(
            "*",
            F.col("_metadata.file_path").alias("file"),
            F.struct(
                F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")
            ).alias("pos"),
        )
    # A repeated header name means its last column.
    place_of = dict(zip(names, places))
    named = [
        text_or_empty(F.col(place_of[old]) if old in place_of else F.lit(None).cast("string")).alias(new)
        for old, new in COLUMNS.items()
    ]
    filled = F.lit(False)
    for place in places:
        filled = filled | (strip(F.col(place)) != "")
    return rows.where(filled).select("file", "pos", *named)


def parse_bank_rows(raw: DataFrame) -> DataFrame:
    """Ids over the raw cells, then dates and amounts. A row that does not parse keeps its id and gets an ``error``."""
    date_text = strip(F.col("raw_date"))
    balance_text = strip(F.col("raw_balance"))
    amount = parse_amount(F.col("raw_amount"))
    balance = F.when(balance_text == "", F.lit(0).cast(MONEY)).otherwise(parse_amount(F.col("raw_balance")))
    parsed = raw.withColumns(
        {
            "tx_id": bank_tx_id(date_text, F.col("raw_description"), F.col("raw_memo"), F.col("raw_balance")),
            "tx_date": bank_date(date_text),
            "amount": F.abs(amount),
            "balance_after": balance,
            "direction": strip(F.col("direction")),
        }
    )
    error = (
        F.when(F.col("tx_date").isNull(), "date")
        .when(F.col("amount").isNull(), "amount")
        .when(F.col("balance_after").isNull(), "balance")
    )
    return parsed.withColumn("error", error)
