import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from grootboek.sources import bank_csv, card_text
from grootboek.sources.bank_csv import CsvFormatError, parse_bank_rows, read_bank_csv
from grootboek.sources.ledgers import CheckFailed, copy_table

HEADER = "Datum;Naam / Omschrijving;Rekening;Tegenrekening;Code;Af Bij;Bedrag (EUR);Mutatiesoort;Mededelingen;Saldo na mutatie"


def _write(folder, name, content):
    path = folder / name
    path.write_bytes(content.encode("utf-8"))
    return str(path)


def test_bank_csv(spark, tmp_path):
    paths = [
        _write(tmp_path, "a.csv", "﻿" + HEADER + "\n20230704;Fietsenmaker De Spaak;NL77TEST0444555666;;BA;Af;-68,35;pin;binnenband;412,90\n;;;;;;;;;\n"),
        _write(tmp_path, "b.csv", HEADER.replace(";", ",") + '\n20230711,"Atelier ""Noord"", kade",R,,OV,Bij,"2.450,00",x,"terug\nvan borg",\n20231545,Kiosk,R,,BA,Af,"1,00",x,m,"1,00"\n'),
    ]
    rows = {r.raw_date: r for r in parse_bank_rows(read_bank_csv(spark, paths)).collect()}
    assert len(rows) == 3
    first = rows["20230704"]
    assert (str(first.amount), first.error, first.direction) == ("68.35", None, "Af")
    second = rows["20230711"]
    assert second.raw_description == 'Atelier "Noord", kade' and second.raw_memo == "terug\nvan borg"
    assert str(second.amount) == "2450.00" and str(second.balance_after) == "0.00"
    assert rows["20231545"].error == "date" and len(rows["20231545"].tx_id) == 32


def test_csv_without_columns(spark, tmp_path):
    with pytest.raises(CsvFormatError) as caught:
        read_bank_csv(spark, _write(tmp_path, "c.csv", "Foo;Bar\n1;2\n"))
    assert caught.value.headers == ["Foo", "Bar"] and "Datum" in str(caught.value)


STATEMENT = """noise
14-10-2023 TUINWERELD BREDA Betaling - 73,45
16-10-2023 TUINWERELD BREDA Credit + 73,45
18-10-2023 Incasso LOKET Kosten - 2,75
20-10-2023 TUINWERELD BREDA

Credit + 6,10
Credit + 5,20
22-10-2023 AFSCHRIJVING OKTOBER Incasso +2.318,40
27-10-2023 ZOMAAR EEN REGEL
30-02-2024 KIOSK Betaling - 3,00
"""


def test_card_lines(spark, tmp_path):
    lines = card_text.read_card_text(spark, _write(tmp_path, "s.txt", STATEMENT.replace("\n", "\r\n")))
    parsed = card_text.parse_card_lines(card_text.stitch_lines(lines)).orderBy("pos").collect()
    got = [(r.raw_description, r.card_type, str(r.signed), r.token, r.direction) for r in parsed if r.error is None]
    assert got == [
        ("TUINWERELD BREDA", "Betaling", "-73.45", "-73.45", "Af"),
        ("TUINWERELD BREDA", "Credit", "73.45", "73.45", "Bij"),
        # The first known word names the type; the tail of a costs line stays.
        ("Incasso LOKET Kosten - 2,75", "Incasso", "-2.75", "-2.75", "Bij"),
        ("TUINWERELD BREDA", "Credit", "6.10", "6.1", "Bij"),
        ("AFSCHRIJVING OKTOBER", "Incasso", "2318.40", "2318.4", "Bij"),
    ]
    assert [r.line for r in parsed if r.error] == ["27-10-2023 ZOMAAR EEN REGEL", "30-02-2024 KIOSK Betaling - 3,00"]


def test_lines_meet_across_blocks(spark):
    rows = [("f", 0, 0, "20-10-2023 TUINWERELD"), ("f", 10, 1, " "), ("f", 20, 2, "Credit + 6,10"), ("g", 0, 3, "Credit + 2,00")]
    lines = spark.createDataFrame(rows, "file string, block bigint, seq bigint, line string")
    assert [r.line for r in card_text.stitch_lines(lines).collect()] == ["20-10-2023 TUINWERELD Credit + 6,10"]


def test_copy_table(spark, tmp_path):
    good = spark.range(3).select(F.md5(F.col("id").cast("string")).alias("tx_id"), F.lit(1).cast("decimal(6,4)").alias("similarity"), F.lit(202401).alias("ym"))
    path = str(tmp_path / "copy")
    assert copy_table(spark, good, path, dry_run=True) == "dry-run"
    assert copy_table(spark, good, path) == "copied" and copy_table(spark, good, path) == "skipped"
    with pytest.raises(CheckFailed):
        copy_table(spark, good.limit(2), path)
    with pytest.raises(CheckFailed):
        copy_table(spark, good.unionByName(good), path)


def test_required_columns_are_mapped():
    assert set(bank_csv.REQUIRED) <= set(bank_csv.COLUMNS)


# Records over several lines.


def _random_csv(seed, rows=60, sep=";", end="\n"):
    """A file with cells over several lines, doubled quotes and bare quotes, and its records by Python's reader."""
    rng = random.Random(seed)
    pieces = ["a", "bb", " ", sep, '"', "\n", "x" * 30, "é", '""']
    lines, names = [HEADER.replace(";", sep)], HEADER.split(";")
    for i in range(rows):
        cells = []
        for k in range(len(names)):
            text = "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 2, 6])))
            if rng.random() < 0.6 or text.startswith('"') or set(text) & {sep, "\n"}:
                cells.append('"' + text.replace('"', '""') + '"')
            else:
                cells.append(text)
        cells[0] = f"{i:04d}"
        lines.append(sep.join(cells))
    content = end.join(lines) + (end if rng.random() < 0.5 else "")
    return content, list(csv.reader(io.StringIO(content, newline=""), delimiter=sep))[1:]


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of a few lines."""
    settings = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


@pytest.mark.parametrize("seed, sep", [(1, ";"), (2, ";"), (3, ",")])
def test_records_over_lines_and_blocks(spark, tmp_path, small_blocks, seed, sep):
    content, want = _random_csv(seed, sep=sep)
    other, more = _random_csv(seed + 10, rows=25, sep=sep)
    paths = [_write(tmp_path, "a.csv", content), _write(tmp_path, "b.csv", other)]
    rows = read_bank_csv(spark, paths)
    assert rows.select("pos.block").distinct().count() > 10
    order = ["raw_date", "raw_description", "raw_account", "raw_counter_account", "code", "direction", "raw_amount", "mutation_kind", "raw_memo", "raw_balance"]
    for name, records in (("a.csv", want), ("b.csv", more)):
        got = rows.where(F.col("file").endswith(name)).orderBy("pos").select(*order).collect()
        assert [list(r) for r in got] == records


def test_records_with_windows_line_ends(spark, tmp_path, small_blocks):
    content = HEADER + '\r\n1;"two\r\nlines";R;;;Af;1;x;"m";2\r\n3;one;R;;;Af;1;x;m;4\r\n'
    got = read_bank_csv(spark, _write(tmp_path, "w.csv", content)).orderBy("pos").collect()
    assert [(r.raw_date, r.raw_description, r.raw_balance) for r in got] == [("1", "two\r\nlines", "2"), ("3", "one", "4")]


def test_a_bare_quote_opens_nothing(spark, tmp_path):
    content = HEADER + '\n1;5" pipe;R;;;Af;1;x;m;2\n3;6" pipe;R;;;Af;1;x;"a\nb";4\n5;"q""\n";R;;;Af;1;x;7" ;4\n'
    got = read_bank_csv(spark, _write(tmp_path, "q.csv", content)).orderBy("pos").collect()
    assert [(r.raw_date, r.raw_description, r.raw_memo) for r in got] == [("1", '5" pipe', "m"), ("3", '6" pipe', "a\nb"), ("5", 'q"\n', '7" ')]


def test_a_quote_that_is_never_shut(spark, tmp_path, small_blocks):
    content = HEADER + "\n1;one;R;;;Af;1;x;m;2\n" + '3;"two;R;;;Af;1;x;m;4\n' + "5;three;R;;;Af;1;x;m;6\n" * 20
    got = read_bank_csv(spark, _write(tmp_path, "o.csv", content)).orderBy("pos").collect()
    assert [r.raw_date for r in got] == ["1", "3"] and got[1].raw_description.count("three") == 20


def test_files_without_line_breaks_are_read_as_they_are(spark, tmp_path):
    path = _write(tmp_path, "p.csv", HEADER + '\n1;"a;b";R;;;Af;1;x;m;2\n')
    plan = read_bank_csv(spark, path)._jdf.queryExecution().toString()
    assert "Window" not in plan and read_bank_csv(spark, path).first().raw_description == "a;b"


# Spans of a block.


@pytest.fixture
def short_spans(monkeypatch):
    """Blocks are cut into spans of two lines."""
    monkeypatch.setattr("grootboek.sources.spans.SPAN_BITS", 1)


def test_card_lines_meet_across_spans(spark, short_spans):
    rows = []
    for file in "fg":
        for i in range(40):
            at, block = 6 * i, 900 * (i // 20)
            rows.append((file, block, at, f"20-10-2023 {file}{i}"))
            rows += [(file, block, at + k, " ") for k in range(1, 1 + i % 5)]
            # Every third line is not continued; at the end of the first block, the next line is in the second one.
            if i % 3:
                rows.append((file, 900 if i == 19 else block, at + 5, f"Credit + {i},10"))
    lines = spark.createDataFrame(rows, "file string, block bigint, seq bigint, line string").repartition(3)
    order = sorted(((f, b, n, line) for f, b, n, line in rows if line.strip()))
    want = []
    for (f, *_, line), after in zip(order, [*order[1:], (None,) * 4]):
        if line[:2] == "20":
            meets = after[0] == f and after[3].startswith("Credit")
            want.append(f"{line} {after[3]}" if meets else line)
    got = card_text.stitch_lines(lines).collect()
    assert sorted(r.line for r in got) == sorted(want) and all(r.matched == ("Credit" in r.line) for r in got)
    assert "span" in str(card_text.stitch_lines(lines)._jdf.queryExecution().optimizedPlan())


@pytest.mark.parametrize("seed, sep", [(4, ";"), (5, ",")])
def test_records_over_lines_blocks_and_spans(spark, tmp_path, small_blocks, short_spans, seed, sep):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    content, want = _random_csv(seed, sep=sep)
    rows = read_bank_csv(spark, _write(tmp_path, "a.csv", content))
    order = ["raw_date", "raw_description", "raw_account", "raw_counter_account", "code", "direction", "raw_amount", "mutation_kind", "raw_memo", "raw_balance"]
    assert [list(r) for r in rows.orderBy("pos").select(*order).collect()] == want


def test_windows_over_records_hold_a_span_and_tasks_grow_in_number(spark, tmp_path, monkeypatch):
    content, want = _random_csv(6)
    path = _write(tmp_path, "a.csv", content)
    plan = read_bank_csv(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "seq#" in line]
    assert windows and all("span#" in line for line in windows)
    monkeypatch.setattr(bank_csv, "TASK_BYTES", len(content) // 9)
    rows = read_bank_csv(spark, path)
    assert "RepartitionByExpression" in rows._jdf.queryExecution().optimizedPlan().toString() and rows.count() == len(want)
