"""Two ledgers, import files and a vector table derived from the given tables.

The given tables hold no bank data, so orders become a bank ledger, events a card ledger, and both also the raw cells
of an import. The mapping is plain SQL that Spark and the checking database both understand; remainders of a key only
decide *what* a row looks like, every row is used.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grootboek.functions.ids import bank_tx_id, card_tx_id
from grootboek.functions.money import hash_token
from grootboek.functions.text import AnonymiseRules
from grootboek.operators.classify import unify
from grootboek.operators.period import Period
from grootboek.schema import BANK, CARD

# All months in which the derived ledgers have rows.
WHOLE = Period(199501, 200112)

RULES = AnonymiseRules("Voorbeeldnaam", {"NL00BANK0123456789": "Rekening A", "NL00BANK0987654321": "Rekening B"})

_DIRECTION = "CASE WHEN k % 101 = 0 THEN '' WHEN k % 10 < 7 THEN 'Af' ELSE 'Bij' END"

BANK_ORDER = {
    "id": "k",
    "tx_date": "CAST(o_orderdate AS DATE)",
    "description": (
        "CASE WHEN k % 37 = 0 THEN concat(c_mktsegment, ' ', n_name, ' NL00BANK0123456789 ref 123456789')"
        " ELSE concat(c_mktsegment, ' ', n_name) END"
    ),
    "account": "CASE WHEN o_custkey % 2 = 0 THEN 'Rekening A' ELSE 'Rekening B' END",
    "counter_account": (
        "CASE WHEN k % 17 = 0 AND k % 2 = 0 AND o_custkey % 2 = 0 THEN 'Rekening B'"
        " WHEN k % 17 = 0 AND k % 2 = 0 THEN 'Rekening A'"
        " WHEN k % 17 = 0 AND k % 3 = 0 THEN 'spaarrekening'"
        " WHEN k % 5 = 0 THEN 'NL00BANK0123456789' ELSE '' END"
    ),
    "code": "CASE WHEN k % 4 = 0 THEN 'GT' ELSE 'BA' END",
    "direction": _DIRECTION,
    "amount": "CAST(o_totalprice AS DECIMAL(18,2))",
    "mutation_kind": "o_orderpriority",
    "memo": "concat('REF ', CAST(k AS STRING))",
    "balance_after": "CAST(c_acctbal AS DECIMAL(18,2))",
    "category": (
        "CASE WHEN k % 103 = 0 THEN NULL WHEN k % 17 = 0 THEN 'Interne overboeking'"
        " WHEN k % 19 = 0 THEN 'Overige uitgaven' WHEN k % 13 = 0 THEN 'Inkomsten'"
        " WHEN k % 31 = 0 AND k % 10 < 7 THEN 'Vervoer' WHEN k % 31 = 0 THEN 'Inkomsten'"
        " WHEN k % 43 = 0 AND k % 10 >= 7 THEN 'Inkomsten' WHEN k % 10 >= 8 THEN 'Inkomsten'"
        " WHEN k % 11 = 0 THEN 'Overige uitgaven' WHEN c_mktsegment = 'BUILDING' THEN 'Wonen'"
        " WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Vervoer'"
        " WHEN c_mktsegment = 'MACHINERY' AND k % 3 = 0 THEN 'Vrije tijd' ELSE 'Huishouden' END"
    ),
    "subcategory": (
        "CASE WHEN k % 103 = 0 THEN NULL WHEN k % 17 = 0 THEN 'intern' WHEN k % 19 = 0 THEN 'creditcard'"
        " WHEN k % 13 = 0 AND k % 10 < 7 THEN 'sparen' WHEN k % 13 = 0 THEN 'van spaarrekening'"
        " WHEN k % 31 = 0 AND k % 10 < 7 THEN 'laadpaal' WHEN k % 31 = 0 THEN 'laadvergoeding'"
        " WHEN k % 43 = 0 AND k % 10 >= 7 THEN 'overig' WHEN k % 10 >= 8 THEN 'salaris'"
        " WHEN k % 11 = 0 THEN 'overig' ELSE lower(c_mktsegment) END"
    ),
    "merchant": (
        "CASE WHEN k % 23 = 0 THEN NULL WHEN k % 26 = 0 THEN 'spaarrekening'"
        " WHEN k % 71 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END"
    ),
    "similarity": "CASE WHEN k % 29 = 0 THEN CAST(0.9 AS DECIMAL(6,4)) END",
    "orig_category": "CASE WHEN k % 29 = 0 THEN 'Huishouden' END",
    "orig_subcategory": "CASE WHEN k % 29 = 0 THEN 'overig' END",
}

# The bank debit that pays a card collection, two to five days later.
BANK_SETTLEMENT = {
    "id": "event_id + 1000000000",
    "tx_date": "DATE '1995-01-01' + CAST(event_id % 2400 + 2 + event_id % 4 AS INT)",
    "description": "'INCASSO'",
    "account": "'Rekening A'",
    "counter_account": "''",
    "code": "'IC'",
    "direction": "'Af'",
    "amount": "CAST(value AS DECIMAL(18,2))",
    "mutation_kind": "'Incasso'",
    "memo": "concat('CARD ', CAST(event_id AS STRING))",
    "balance_after": "CAST(0 AS DECIMAL(18,2))",
    "category": "'Overige uitgaven'",
    "subcategory": "'creditcard'",
    "merchant": "'card'",
    "similarity": "CAST(NULL AS DECIMAL(6,4))",
    "orig_category": "CAST(NULL AS STRING)",
    "orig_subcategory": "CAST(NULL AS STRING)",
}

CARD_EVENT = {
    "id": "event_id",
    "tx_date": "DATE '1995-01-01' + CAST(event_id % 2400 AS INT)",
    "description": "concat('SHOP ', CAST(user_id % 50 AS STRING))",
    "raw_description": (
        "concat('SHOP ', CAST(user_id % 50 AS STRING), ' ', lpad(CAST(event_id AS STRING), 10, '0'))"
    ),
    "account": "'Rekening A'",
    "card_type": (
        "CASE event_type WHEN 'error' THEN 'Kosten' WHEN 'view' THEN 'Credit' WHEN 'signup' THEN 'Incasso'"
        " ELSE 'Betaling' END"
    ),
    "direction": "CASE WHEN event_type IN ('signup', 'view') THEN 'Bij' ELSE 'Af' END",
    "amount": "CAST(value AS DECIMAL(18,2))",
    "category": (
        "CASE WHEN event_id % 97 = 0 AND event_type = 'view' THEN 'Interne overboeking'"
        " WHEN event_id % 41 = 0 THEN 'Vrije tijd' WHEN user_id % 5 = 0 THEN 'Huishouden'"
        " WHEN user_id % 5 = 1 THEN 'Vrije tijd' WHEN user_id % 5 = 2 THEN 'Vervoer'"
        " WHEN user_id % 5 = 3 THEN 'Huishouden' ELSE 'Overige uitgaven' END"
    ),
    "subcategory": (
        "CASE WHEN event_id % 97 = 0 AND event_type = 'view' THEN 'intern'"
        " WHEN event_id % 41 = 0 THEN 'abonnementen' WHEN user_id % 5 = 0 THEN 'boodschappen'"
        " WHEN user_id % 5 = 1 THEN 'uit eten' WHEN user_id % 5 = 2 THEN 'brandstof'"
        " WHEN user_id % 5 = 3 THEN 'Overig' ELSE 'overig' END"
    ),
    "merchant": "CASE WHEN event_id % 23 = 0 THEN NULL ELSE concat('Shop ', CAST(user_id % 50 AS STRING)) END",
    "similarity": "CAST(NULL AS DECIMAL(6,4))",
    "orig_category": "CAST(NULL AS STRING)",
    "orig_subcategory": "CAST(NULL AS STRING)",
}

YMD_TEXT = "CAST(year(tx_date) * 10000 + month(tx_date) * 100 + day(tx_date) AS STRING)"
DMY_TEXT = (
    "concat(lpad(CAST(day(tx_date) AS STRING), 2, '0'), '-', lpad(CAST(month(tx_date) AS STRING), 2, '0'), '-',"
    " CAST(year(tx_date) AS STRING))"
)

# Raw cells of a bank file: most rows repeat the ledger, every third is new, a few do not parse.
BANK_CELLS = {
    "file": "concat('bank-', CAST(id % 7 AS STRING))",
    "pos": "id",
    "raw_date": f"CASE WHEN id % 61 = 0 THEN '20241332' ELSE {YMD_TEXT} END",
    "raw_description": "CASE WHEN id % 27 = 0 THEN concat(description, ' voorbeeldnaam') ELSE description END",
    "raw_account": (
        "CASE WHEN account = 'Rekening A' THEN 'NL00BANK0123456789'"
        " WHEN id % 9 = 0 THEN 'XX' ELSE 'nl00 BANK 0987 6543 21' END"
    ),
    "raw_counter_account": "counter_account",
    "code": "code",
    "direction": "direction",
    "raw_amount": (
        "CASE WHEN id % 67 = 0 THEN 'abc'"
        " ELSE concat('+ ', replace(CAST(amount AS STRING), '.', ',')) END"
    ),
    "mutation_kind": "mutation_kind",
    "raw_memo": "CASE WHEN id % 3 = 0 THEN concat(memo, ' NEW') ELSE memo END",
    "raw_balance": "CAST(balance_after AS STRING)",
}

# The same as a file would have them: memos over several lines, with quotes and separators, and bare quotes.
BANK_CSV_CELLS = BANK_CELLS | {
    "raw_memo": (
        "CASE WHEN id % 5 = 0 THEN concat(memo, chr(10), 'line \"two\"; ', CAST(id AS STRING), chr(10))"
        " WHEN id % 11 = 0 THEN concat('5\" pipe ', memo) ELSE memo END"
    ),
}

# Statement lines of the card: every third amount is new, every seventh line is broken in two.
_CARD_AMOUNT = "CASE WHEN id % 3 = 0 THEN amount + 1 ELSE amount END"
CARD_HEAD = (
    "CASE WHEN id % 53 = 0 THEN concat(raw_date, ' GEEN TRANSACTIE')"
    " WHEN id % 59 = 0 THEN concat('31-02-1999 ', raw_description)"
    " ELSE concat(raw_date, ' ', raw_description) END"
)
CARD_TAIL = (
    "concat(card_type, CASE WHEN direction = 'Bij' THEN ' + ' ELSE ' - ' END,"
    f" replace(CAST({_CARD_AMOUNT} AS STRING), '.', ','))"
)
CARD_FILE = "concat('card-', CAST(id % 12 AS STRING))"
CARD_BLOCK = "CAST(floor(id / 1000) AS BIGINT)"


# The columns used of each given table. A stated schema saves the pass over the files that would infer it.
SCHEMAS = {
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "events": "event_id bigint, user_id bigint, event_type string, value double",
    "documents": "doc_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _mapped(source: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return source.select(*[F.expr(sql).alias(name) for name, sql in mapping.items()])


# A query may use a ledger several times; its plan is built once. What is kept are plans, not rows.


@lru_cache(maxsize=8)
def bank_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank ledger with the raw text its ids were made from."""
    orders = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    signups = table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    rows = _mapped(joined, BANK_ORDER).unionByName(_mapped(signups, BANK_SETTLEMENT))
    rows = rows.withColumn("raw_date", F.expr(YMD_TEXT))
    tx_id = bank_tx_id(F.col("raw_date"), F.col("description"), F.col("memo"), F.col("balance_after"))
    return rows.withColumns({"tx_id": tx_id, "ym": F.expr("year(tx_date) * 100 + month(tx_date)")})


@lru_cache(maxsize=8)
def bank_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank_raw(spark, sf_dir).select(*BANK.fieldNames())


@lru_cache(maxsize=8)
def card_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mapped(table(spark, sf_dir, "events"), CARD_EVENT)
    signed = F.when(F.col("direction") == "Bij", F.col("amount")).otherwise(-F.col("amount"))
    rows = rows.withColumns({"raw_date": F.expr(DMY_TEXT), "token": hash_token(signed)})
    tx_id = card_tx_id(F.col("raw_date"), F.col("raw_description"), F.col("card_type"), F.col("token"))
    return rows.withColumns({"tx_id": tx_id, "ym": F.expr("year(tx_date) * 100 + month(tx_date)")})


@lru_cache(maxsize=8)
def card_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_raw(spark, sf_dir).select(*CARD.fieldNames())


@lru_cache(maxsize=8)
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify(bank_ledger(spark, sf_dir), card_ledger(spark, sf_dir))


def bank_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(bank_ledger(spark, sf_dir), BANK_CELLS)


def bank_csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(bank_ledger(spark, sf_dir), BANK_CSV_CELLS)


def card_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement text, one row per line; a broken line has its tail on the next one."""
    rows = card_raw(spark, sf_dir).select(
        "id",
        F.expr(CARD_FILE).alias("file"),
        F.expr(CARD_BLOCK).alias("block"),
        F.expr(CARD_HEAD).alias("head"),
        F.expr(CARD_TAIL).alias("tail"),
    )
    lines = F.when(F.col("id") % 53 == 0, F.array("head"))
    lines = lines.when(F.col("id") % 7 == 0, F.array("head", "tail"))
    exploded = rows.select("file", "block", "id", F.posexplode(lines.otherwise(F.array(F.concat_ws(" ", "head", "tail")))))
    return exploded.select("file", "block", (F.col("id") * 2 + F.col("pos")).alias("seq"), F.col("col").alias("line"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English words for the categories, taken from the ledger's own vocabulary."""
    words = ledger(spark, sf_dir).where("category LIKE '%s%'").select(F.col("category").alias("source")).distinct()
    return words.select(
        F.lit("hoofd").alias("namespace"), "source", F.concat(F.lit("EN "), F.col("source")).alias("text")
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.struct(
        F.concat(F.lit("C"), F.col("label") % 5).alias("category"),
        F.concat(F.lit("s"), F.col("label")).alias("subcategory"),
    )
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("point_id"),
        F.when(F.col("label") % 2 == 0, "Af").otherwise("Bij").alias("direction"),
        payload.alias("payload"),
        "embedding",
    )
