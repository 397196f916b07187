from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from grootboek.operators import memory, neighbours, review
from grootboek.schema import BANK, CARD, TERM, SchemaMismatch, conform
from grootboek.sources import ledgers


def _bank(spark, days):
    rows = [(i, f"{i:032x}", d, d.year * 100 + d.month, f"Atelier {i}", Decimal("8.20")) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "id bigint, tx_id string, tx_date date, ym int, description string, amount decimal(18,2)")
    for field in BANK.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return conform(df, BANK)


def test_month_replacement_leaves_other_months(spark, tmp_path):
    path = str(tmp_path / "bank")
    ledgers.write_snapshot(_bank(spark, [date(2023, 7, 4), date(2023, 7, 11), date(2023, 8, 1)]), path)
    fresh = _bank(spark, [date(2023, 7, 4)]).withColumn("description", F.lit("new"))
    ledgers.replace_months(fresh, path)
    got = ledgers.read_bank(spark, path).orderBy("ym").collect()
    assert [(r.ym, r.description) for r in got] == [(202307, "new"), (202308, "Atelier 2")]
    assert [f.name for f in ledgers.read_bank(spark, path).schema.fields] == BANK.fieldNames()
    with pytest.raises(SchemaMismatch):
        ledgers.read_card(spark, path)


@pytest.mark.parametrize("kind", ["bank", "card"])
def test_database_tables_in_the_librarys_schema(spark, tmp_path, kind):
    names, schema, read, convert, raw = {
        "bank": (ledgers.BANK_COLUMNS, BANK, ledgers.read_bank, ledgers.bank_from_table, "20230704"),
        "card": (ledgers.CARD_COLUMNS, CARD, ledgers.read_card, ledgers.card_from_table, "04-07-2023"),
    }[kind]
    values = {"id": "7", "tx_id": "a" * 32, "raw_date": raw, "amount": "8.20", "similarity": "0.5", "description": "Kiosk"}
    given = {old: values[new] for old, new in names.items() if new in values}
    df = spark.createDataFrame([tuple(given.values())], ", ".join(f"`{c}` string" for c in given))
    path = str(tmp_path / kind)
    ledgers.write_snapshot(convert(df), path)
    (row,) = read(spark, path).collect()
    assert (row.id, row.tx_date, row.ym, row.amount, row.description) == (7, date(2023, 7, 4), 202307, Decimal("8.20"), "Kiosk")
    assert row.__fields__ == schema.fieldNames()


def test_terms_of_one_locale(spark, tmp_path):
    rows = [("menu", "Home", "nl", "Begin"), ("menu", "Home", "de", "Start"), ("menu", "Stop", "nl", "Einde")]
    spark.createDataFrame(rows, TERM).write.parquet(str(tmp_path / "terms"))
    got = ledgers.read_terms(spark, str(tmp_path / "terms"), "nl").orderBy("source").collect()
    assert [tuple(r) for r in got] == [("menu", "Home", "Begin"), ("menu", "Stop", "Einde")]


def test_suggestions_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "suggested")
    rows = [("bank", str(i), "atelier", "Af", "Wonen", "dak") for i in range(4)]
    corpus = spark.createDataFrame(rows, "src string, tx_id string, text_key string, direction string, category string, subcategory string")
    memory.write_suggestions(memory.suggestions(corpus), path)
    memory.write_suggestions(memory.suggestions(corpus.where("tx_id < '2'")), path)
    got = spark.read.parquet(path).orderBy("tx_id").collect()
    assert [(r.tx_id, r.layer) for r in got] == [("0", "none"), ("1", "none")]


def test_points_of_rows_with_a_vector(spark):
    rows = spark.createDataFrame([("p1", "text one", ("a",)), ("p2", "text two", ("b",))], "point_id string, index_text string, payload struct<category:string>")
    vectors = spark.createDataFrame([("p2", [1.0, 0.0], "x"), ("p9", [0.0, 1.0], "x")], "point_id string, embedding array<float>, model string")
    (point,) = neighbours.build_points(rows, vectors).collect()
    assert (point.point_id, point.payload.category, point.embedding) == ("p2", "b", [1.0, 0.0])
    assert "index_text" not in point.__fields__


def test_one_row_by_its_key(spark):
    ledger = spark.createDataFrame([("bank", "1", "expense"), ("cc", "1", "expense"), ("bank", "2", "internal")], "src string, tx_id string, flow_kind string")
    assert [r.src for r in review.one_row(ledger, "cc", "1").collect()] == ["cc"]
    assert review.one_row(ledger, "bank", "2").count() == 0
