import hashlib
import random
import re
import time
import uuid
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from grootboek.functions import dates, ids, money, text
from grootboek.functions.dates import Cycle

T = "t"


@pytest.mark.parametrize(
    "raw, value",
    [
        ("7.905,18", "7905.18"),
        ("+ 68,35", "68.35"),
        ("-4,40", "-4.40"),
        ("31.8", "31.80"),
        ("", None),
        ("abc", None),
        (None, None),
    ],
)
def test_amounts(one, raw, value):
    assert one(raw, money.parse_amount(F.col(T))) == (Decimal(value) if value else None)


@pytest.mark.parametrize("raw, token", [("2318.47", "2318.47"), ("73.00", "73"), ("-68.30", "-68.3"), ("0.00", "0"), ("-0.00", "0"), ("500.00", "500")])
def test_hash_token(one, raw, token):
    assert one(raw, money.hash_token(F.col(T).cast("decimal(18,2)"))) == token


def test_ids(one):
    cells = ("20230704", "Fietsenmaker", None, "68.35")
    got = one("x", ids.bank_tx_id(*[F.lit(c).cast("string") for c in cells]))
    assert got == hashlib.md5(b"20230704Fietsenmaker68.35").hexdigest()
    assert one("abc", ids.point_id(F.lit("bank"), F.col(T), "shop")) == str(uuid.uuid5(uuid.NAMESPACE_URL, "shop:bank:abc"))
    assert one("A" * 32, ids.valid_tx_id(F.col(T))) == "a" * 32
    assert one("nope", ids.valid_tx_id(F.col(T))) is None
    assert ids.parse_threshold("0.815") == Decimal("0.82") and ids.parse_threshold("7") == ids.DEFAULT_THRESHOLD
    assert ids.parse_threshold("x") == ids.parse_threshold(None) == ids.DEFAULT_THRESHOLD


def test_masking(one):
    assert one("Pomp NL77TEST0444555666 bij 55512399 thuis", text.strip_iban(F.col(T))) == "Pomp … bij … thuis"
    assert one("kNL77TEST0444555666", text.strip_iban(F.col(T))) == "kNL77TEST…"
    assert one("  a\t b c ", text.strip_iban(F.col(T))) == "a b c"
    assert one("kaart ١٢٣٤٥٦٧٨", text.strip_iban(F.col(T))) == "kaart …"
    assert one(None, text.strip_iban(F.col(T))) == ""
    assert len(one("x" * 500, text.index_text(F.col(T)))) == 200


def test_keys(one):
    assert one("Kaas-en/Wijn, Hoek", text.normalize(F.col(T))) == "kaasenwijn hoek"
    assert one("Straße - Σας", text.normalize(F.col(T))) == "strasse σασ"
    assert one("  Bakfiets ", text.merchant_key(F.col(T))) == "bakfiets"


def test_redact(one):
    assert one("Huur NL41PROF0777888999 mei", text.redact(F.col(T))) == "Huur … mei"
    assert one("y" * 80, text.redact(F.col(T))) == "y" * 80
    assert one("y" * 81, text.redact(F.col(T))) == "y" * 79 + "…"
    assert one(None, text.redact(F.col(T))) == ""


def test_anonymise(one):
    rules = text.AnonymiseRules("Voorbeeldnaam", {"NL77TEST0444555666": "Rekening A", "NL41 PROF 0777888999": "Rekening B"})
    got = one("Van nl77 TEST 0444 5556 66 VOORBEELDNAAM en NL41PROF0777888999", text.anonymise(F.col(T), rules))
    assert got == "Van Rekening A <geanonimiseerd> en Rekening B"


def _one_by_one(value, rules):
    """The same by a plain search for each rule."""
    for iban, label in rules.ordered():
        value = re.sub(r"\s*".join(iban), label, value, flags=re.IGNORECASE)
    return value


@pytest.mark.parametrize("seed, n", [(1, 3), (2, 60), (3, 400)])
def test_many_rules_do_what_they_do_one_by_one(spark, seed, n):
    rng = random.Random(seed)

    def iban():
        return rng.choice(["NL", "DE", "LU"]) + f"{rng.randrange(100):02d}" + rng.choice(["BANK", "AB12", "ZZ"]) + f"{rng.randrange(10**10):010d}"

    keys = [iban() for _ in range(n)]
    # Some hold, continue or repeat others.
    keys += [k + "77" for k in keys[:3]] + [keys[0][4:8].replace("A", "NL")[:2].ljust(2, "X") + "12" + keys[1]]
    rules = text.AnonymiseRules("", {k: f"Rekening {i}" for i, k in enumerate(dict.fromkeys(keys))})

    def spelled(k):
        k = k.lower() if rng.random() < 0.3 else k
        return "".join(ch + rng.choice(["", "", "", " ", "  "]) for ch in k)

    values = [" ".join(rng.choice(["van", spelled(rng.choice(keys)), iban(), "x" + rng.choice(keys), "12", "NL 00"]) for _ in range(6)) for _ in range(80)]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    got = [r.a for r in df.select(text.anonymise(F.col("t"), rules).alias("a")).collect()]
    assert got == [_one_by_one(v, rules) for v in values]


def test_the_number_of_rules_hardly_matters(spark):
    df = spark.range(4000).select(F.concat(F.lit("betaling aan NL00BANK"), F.lpad(F.col("id").cast("string"), 10, "0"), F.lit(" in delen, met dank")).alias("t")).repartition(4)
    took = {}
    for n in (10, 10_000):
        rules = text.AnonymiseRules("", {f"NL00BANK{i:010d}": f"Rekening {i}" for i in range(n)})
        column = text.anonymise(F.col("t"), rules)
        df.select(column).limit(1).collect()
        start = time.perf_counter()
        assert df.where(column.contains("Rekening")).count() == min(n, 4000)
        took[n] = time.perf_counter() - start
    assert took[10_000] < 20 * took[10] + 10


def test_case_folds_as_in_the_pattern(one):
    rules = text.AnonymiseRules("", {"SK00KISS0123456789": "Rekening A"})
    assert one("\u017fK00K\u0130\u017fS 0123456789", text.anonymise(F.col(T), rules)) == "Rekening A"


@pytest.mark.parametrize("rule", [{"geen nummer": "Rekening A"}, {"NL77TEST0444555666": "Jan Jansen"}, {"NL77TEST0444555666": "Rekening "}])
def test_rules_that_would_let_names_through_are_refused(rule):
    with pytest.raises(ValueError):
        text.AnonymiseRules("", rule)


def test_labels_and_secrets(one):
    assert one("Rekening A", text.is_account_label(F.col(T))) and not one("Rekening ", text.is_account_label(F.col(T)))
    assert one("nl77 test 0444555666", text.looks_secret(F.col(T))) and not one("spaarrekening", text.looks_secret(F.col(T)))
    for name in ("persoon", "spaarrekening", "ING", "ING Bank N.V.", ""):
        assert one(name, text.is_denied_merchant(F.col(T)))
    for name in ("Oranje Spaarrekening", "Fietsenmaker"):
        assert not one(name, text.is_denied_merchant(F.col(T)))
    assert text.search_needle("  Bakfiets%_  ") == "Bakfiets" and text.search_needle(None) == ""


def test_dates(one):
    assert one("20230704", dates.bank_date(F.col(T))) == date(2023, 7, 4)
    assert one("30-02-2024", dates.card_date(F.col(T))) is None


def test_periods():
    assert dates.default_range(202608) == (202509, 202608)
    assert dates.add_months(202601, -1) == 202512 and dates.add_months(202512, 1) == 202601
    by_pay = Cycle(by_payday=True)
    assert [by_pay.month_of(d) for d in (date(2026, 8, 25), date(2026, 9, 24), date(2025, 12, 25), date(2026, 1, 1))] == [
        202609,
        202609,
        202601,
        202601,
    ]
    assert by_pay.bounds(202609, 202609) == (date(2026, 8, 25), date(2026, 9, 24))
    early = Cycle(True, {202609: date(2026, 8, 22)})
    assert early.month_of(date(2026, 8, 22)) == 202609 and early.month_of(date(2026, 8, 21)) == 202608
    presets = dates.period_presets(date(2026, 9, 9))
    assert presets["this_quarter"] == (202607, 202609) and presets["last_quarter"] == (202604, 202606)
    assert dates.period_presets(date(2026, 9, 25), by_pay)["this_month"] == (202610, 202610)
    assert dates.period_presets(date(2026, 2, 1))["last_quarter"] == (202510, 202512)
