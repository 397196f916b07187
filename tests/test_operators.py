import random
from collections import Counter, defaultdict
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from grootboek.functions.text import AnonymiseRules
from grootboek.operators import corrections, imports, memory, neighbours, review, settle
from grootboek.operators.classify import on_leg, transfer_legs, unify
from grootboek.operators.period import Period
from grootboek.plans import fixtures
from grootboek.skew import lookup
from grootboek.sources.ledgers import CheckFailed

RULES = AnonymiseRules("Voorbeeldnaam", {"NL77TEST0444555666": "Rekening A"})
NO_IDS = "tx_id string"
MEMORY = "text_key string, direction string, memory struct<category:string,subcategory:string,n:bigint,share:double,unanimous:boolean>"


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_equals_join(spark, how):
    rng = random.Random(1)
    keys = [rng.choice(["hot"] * 5 + [None, "a", "b", "c", "absent"]) for _ in range(300)]
    facts = spark.createDataFrame(list(enumerate(keys)), "id int, k string")
    dim = spark.createDataFrame([("hot", 1), ("a", None), ("b", 3), ("z", 4)], "k string, v int")
    got = lookup(facts, dim, "k", spread=["id"], how=how).orderBy("id").collect()
    assert got == facts.join(dim, "k", how).select(*got[0].__fields__).orderBy("id").collect()


# Settlements.


def _greedy(cards, banks):
    used, pairs = set(), []
    for cid, day, amount in sorted(cards, key=lambda c: (c[1], c[0])):
        options = [((b[1] - day).days, b[0]) for b in banks if b[0] not in used and b[2] == amount and 2 <= (b[1] - day).days <= 4]
        bid = min(options)[1] if options else None
        used.add(bid)
        pairs.append((cid, bid))
    return sorted(pairs + [(None, b[0]) for b in banks if b[0] not in used], key=repr)


def _settle(spark, cards, banks, period):
    shape = "id bigint, tx_date date, amount decimal(18,2)"
    extra = {c: F.lit("x") for c in ("account", "direction", "category", "subcategory")}
    left = spark.createDataFrame(cards, shape).withColumns(extra | {"card_type": F.lit("Incasso")})
    right = spark.createDataFrame(banks, shape).withColumns(extra)
    rows = settle.match_settlements(left, right, period).collect()
    return sorted([(r.card_id, r.bank_id) for r in rows], key=repr)


def test_settlement_first_card_wins(spark):
    cards = [(2, date(2026, 3, 3), Decimal(100)), (1, date(2026, 2, 3), Decimal(100))]
    assert _settle(spark, cards, [(9, date(2026, 2, 5), Decimal(100))], Period(202602, 202603)) == [(1, 9), (2, None)]


def test_settlement_window(spark):
    cards = [(1, date(2026, 8, 31), Decimal(50)), (2, date(2026, 9, 5), Decimal(50))]
    assert _settle(spark, cards, [(7, date(2026, 9, 3), Decimal(50))], Period(202608, 202608)) == [(1, 7)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_settlement_equals_greedy(spark, seed, monkeypatch):
    monkeypatch.setattr(settle, "ID_SLICE", 7)
    rng = random.Random(seed)

    def rows(n, amounts):
        return [(i, date(2026, 1, 1) + timedelta(rng.randrange(40)), Decimal(rng.choice(amounts))) for i in rng.sample(range(10 * n), n)]

    cards, banks = rows(250, [5] * 8 + [6, 7]), rows(230, [5] * 8 + [6, 8])
    assert _settle(spark, cards, banks, Period(202501, 202612)) == _greedy(cards, banks)


# Memory.


def _corpus(spark, rows):
    return spark.createDataFrame(rows, "src string, tx_id string, text_key string, direction string, category string, subcategory string")


def test_leave_one_out_equals_loop(spark):
    rng = random.Random(5)
    rows = [("bank", str(i), rng.choice(["a", "b", "c", "d", None]), "Af", rng.choice(["X"] * 9 + ["Y", ""]), "s") for i in range(400)]
    rows += [("cc", "one", "single", "Af", "X", "s")] + [("cc", f"t{i}", "three", "Bij", "X", "s") for i in range(4)]
    got = {(r.src, r.tx_id): r.memory for r in memory.leave_one_out(_corpus(spark, rows)).collect()}
    groups = defaultdict(list)
    for r in rows:
        if r[2] is not None:
            groups[r[2:4]].append(r)
    assert len(got) == len(rows)
    for r in rows:
        others = Counter(o[4:] for o in groups.get(r[2:4], []) if o is not r)
        n = sum(others.values())
        (top, hits), *_ = others.most_common(1) or [(("", ""), 0)]
        expected = (*top, n, hits / n, len(others) == 1) if n >= 3 and hits / n >= 0.8 and all(top) else None
        assert (tuple(got[r[:2]]) if got[r[:2]] else None) == expected


def test_tally_without_proposals(spark):
    rows = _corpus(spark, [("b", "1", "t", "Af", "A", "a")]).withColumn("p", F.lit(None).cast("struct<category:string,subcategory:string>"))
    row = memory.tally(rows, "p").first()
    assert (row.n, row.shown, row.silent, row.category_acc) == (1, 0, 1, None)


# Import.


def _cells(spark, *rows):
    names = ["raw_date", "raw_description", "raw_account", "raw_counter_account", "code", "direction", "raw_amount", "mutation_kind", "raw_memo", "raw_balance"]
    return spark.createDataFrame([("f", i, *r) for i, r in enumerate(rows)], "file string, pos int, " + ", ".join(f"{n} string" for n in names))


def _memory(spark, *rows):
    return spark.createDataFrame([(t, d, (c, s, n, share, share == 1.0)) for t, d, c, s, n, share in rows], MEMORY)


def test_bank_preview(spark, tmp_path):
    raw = _cells(
        spark,
        ("20230704", "Fietsenmaker", "NL77TEST0444555666", "", "BA", "Af", "68,35", "x", "", "412,90"),
        ("20230711", "Voorbeeldnaam NL77TEST0444555666", "XX", "", "OV", "Bij", "8,20", "x", "", "2,00"),
        ("2023", "stuk NL77TEST0444555666", "XX", "", "OV", "Bij", "8,20", "x", "", "2,00"),
        ("20230718", "Atelier", "XX", "", "BA", "Af", "6,40", "x", "", "2,00"),
    )
    known = _memory(spark, ("fietsenmaker", "Af", "Huishouden", "boodschappen", 6, 1.0), ("atelier", "Af", "H", "b", 12, 0.85))
    loaded = spark.createDataFrame([], NO_IDS)
    preview = imports.in_review_order(imports.preview_bank(raw, RULES, loaded, known))
    rows = preview.collect()
    assert [(r.status, r.tone, r.source, r.category) for r in rows] == [
        ("fout", "", "", None),
        ("nieuw", "doubt", "text", "H"),
        ("nieuw", "doubt", "fallback", "Inkomsten"),
        ("nieuw", "sure", "text", "Huishouden"),
    ]
    assert [r.account for r in rows] == ["", "", "", "Rekening A"]
    assert not any("NL77" in str(r) or "Voorbeeld" in str(r) for r in rows)
    again = imports.preview_bank(raw, RULES, preview.select("tx_id"), known)
    assert tuple(imports.preview_counts(again).first()) == (0, 3, 1, 0, 0)


def test_card_preview_refund_follows_charge(spark):
    lines = ["14-10-2023 TUINWERELD BREDA Betaling - 73,45", "16-10-2023 TUINWERELD BREDA Credit + 73,45", "22-10-2023 AFSCHRIJVING OKTOBER Incasso + 318,40", "24-10-2023 KIOSK Credit + 2,15", "27-10-2023 STUK 987650123456789"]
    df = spark.createDataFrame([("f", 0, i, x) for i, x in enumerate(lines)], "file string, block int, seq int, line string")
    known = _memory(spark, ("tuinwereld breda", "Af", "Huishouden", "b", 4, 1.0), ("afschrijving oktober", "Af", "Wrong", "w", 9, 1.0))
    rows = imports.in_review_order(imports.preview_card(df, RULES, spark.createDataFrame([], NO_IDS), known)).collect()
    by_day = {r.tx_date.day: r for r in rows}
    assert rows[0].status == "fout" and rows[0].shown == "27-10-2023 STUK …"
    assert (by_day[16].direction, by_day[16].category, by_day[16].tone) == ("Bij", "Huishouden", "sure")
    assert by_day[16].category == by_day[14].category
    assert (by_day[22].category, by_day[22].source, by_day[22].tone) == ("Aflossing", "regel", "sure")
    assert (by_day[24].category, by_day[24].source) == ("Overige uitgaven", "fallback")


def test_nearest_charge_equals_loop(spark):
    rng = random.Random(3)
    rows = [
        (i, rng.choice(["a", "b"]), "Bij" if i % 4 == 0 else "Af", Decimal(rng.choice([1, 2, 3, 9])), date(2025, 1, 1) + timedelta(rng.randrange(90)), rng.choice("XYZ"), "s")
        for i in range(160)
    ]
    df = spark.createDataFrame(rows, "pos int, description string, direction string, amount decimal(18,2), tx_date date, category string, subcategory string")
    got = {r.pos: (r.charge_category, r.in_doubt) for r in imports.nearest_charge(df.withColumn("file", F.lit("f")), ["file"], "pos").collect()}

    def number(d):
        return d.year * 10000 + d.month * 100 + d.day

    for c in (r for r in rows if r[2] == "Bij"):
        debits = [d for d in rows if d[2] == "Af" and d[1] == c[1]]
        best = min(debits, key=lambda d: (d[3] != c[3], abs(number(d[4]) - number(c[4])), d[0]))
        equal = {d[5] for d in debits if d[3] == c[3]}
        assert got[c[0]] == (best[5], len(equal) > 1)


def test_commit_appends_new_ids_once(spark, tmp_path):
    row = ("20230704", "Atelier", "NL77TEST0444555666", "", "BA", "Af", "68,35", "x", "m", "412,90")
    known, path = _memory(spark, ("x", "Af", "a", "b", 3, 1.0)), str(tmp_path / "bank")
    from grootboek.schema import BANK

    empty = spark.createDataFrame([], BANK)
    staged = str(tmp_path / "staged")
    imports.preview_bank(_cells(spark, row, row), RULES, empty, known).write.parquet(staged)
    preview = spark.read.parquet(staged)
    tx_id = preview.first().tx_id
    overrides = spark.createDataFrame([(tx_id, "Huishouden", "boodschappen", "Atelier NL77TEST0444555666")], "tx_id string, category string, subcategory string, merchant string")
    pairs = spark.createDataFrame([("Huishouden", "boodschappen")], "category string, subcategory string")
    with pytest.raises(CheckFailed):
        imports.commit(preview, overrides, pairs.limit(0), empty, path, "bank")
    assert imports.commit(preview, overrides, pairs, empty, path, "bank") == 1
    stored = spark.read.schema(BANK).parquet(path)
    assert stored.first().merchant == "Atelier …" and stored.first().ym == 202307
    assert imports.commit(preview, overrides, pairs, stored, path, "bank") == 0


def test_new_ids_follow_the_file(spark, tmp_path):
    from grootboek.schema import BANK

    raw = [("20230704", f"Atelier {i}", "NL77TEST0444555666", "", "BA", "Af", "8,20", "x", "m", "2,00") for i in range(30)]
    empty, path, staged = spark.createDataFrame([], BANK), str(tmp_path / "bank"), str(tmp_path / "staged")
    known = _memory(spark, ("x", "Af", "Huishouden", "b", 3, 1.0))
    imports.preview_bank(_cells(spark, *raw), RULES, empty, known).repartition(4).write.parquet(staged)
    preview = spark.read.parquet(staged)
    overrides = preview.select("tx_id", F.lit("Huishouden").alias("category"), F.lit("b").alias("subcategory"), F.lit("").alias("merchant"))
    pairs = spark.createDataFrame([("Huishouden", "b")], "category string, subcategory string")
    assert imports.commit(preview, overrides, pairs, empty, path, "bank") == 30
    stored = spark.read.schema(BANK).parquet(path).orderBy("id").collect()
    assert [r.description for r in stored] == [f"Atelier {i}" for i in range(30)]


# Review.


SUGGEST = "struct<category:string,subcategory:string,score:double,unanimous:boolean,neighbor_n:bigint,source:string>"


def _flag(spark, **given):
    base = {"src": "bank", "tx_id": "1", "category": "Inkomsten", "subcategory": "van spaarrekening", "merchant_name": "De Spaak", "text_key": "spaak", "direction": "Bij", "amount": Decimal(310), "flow_kind": "saving", "corrected": False, "suggest": ("Huishouden", "boodschappen", 0.84, True, 4, "text")}
    merchants = given.pop("merchants", [("de spaak", ("Huishouden", "boodschappen", 260), False)])
    splits, mixed = given.pop("splits", []), given.pop("neighbours_mixed", None)
    shape = ", ".join(f"{k} {'decimal(18,2)' if k == 'amount' else 'boolean' if k == 'corrected' else SUGGEST if k == 'suggest' else 'string'}" for k in base)
    row = spark.createDataFrame([tuple((base | given).values())], shape)
    stats = spark.createDataFrame(merchants, "merchant_key string, majority struct<category:string,subcategory:string,n:bigint>, mixed boolean")
    texts = spark.createDataFrame([(s, 2) for s in splits], "text_key string, labels int")
    return review.flag(row, stats, texts, None if mixed is None else F.lit(mixed)).first()


def test_flags(spark):
    large = _flag(spark)
    assert "shop_saving_large" in large.flags and large.suggest is None and not large.bulk_ok and large.doubt
    small = _flag(spark, amount=Decimal("31.80"))
    assert "shop_saving_small" in small.flags and small.suggest.source == "regel" and small.suggest.score is None and small.bulk_ok
    shop = _flag(spark, subcategory="overig", flow_kind="income", amount=Decimal("7.15"), suggest=None)
    assert shop.flags == ["shop_as_income"] and shop.suggest.subcategory == "boodschappen" and shop.bulk_ok
    other = {"category": "Huishouden", "subcategory": "overig", "flow_kind": "expense", "merchants": []}
    text = _flag(spark, **other)
    assert text.flags == ["knn_mismatch", "overig"] and text.bulk_ok and text.above
    split = _flag(spark, **(other | {"merchants": [("de spaak", None, True)]}), splits=["spaak"])
    assert {"split_text", "mixed_entity"} <= set(split.flags) and not split.bulk_ok and not split.above
    assert "knn_split" in _flag(spark, **other, neighbours_mixed=True).flags
    assert _flag(spark, **other, corrected=True).bulk_ok is False


def test_transfer_legs(spark):
    rows = [("bank", "Rekening B", "Af", "Rekening A", None), ("bank", "Rekening A", "Bij", "Rekening B", None), ("bank", "Rekening B", "Af", "NL77TEST0444555666", None), ("bank", "Rekening A", "Af", None, "spaarrekening")]
    legs = transfer_legs(spark.createDataFrame(rows, "src string, account string, direction string, counter_account string, merchant string"))
    got = [(r.from_account, r.to_account) for r in legs.collect()]
    assert got == [("Rekening B", "Rekening A"), ("Rekening B", "Rekening A"), ("Rekening B", None), ("Rekening A", "spaarrekening")]
    assert on_leg(legs, "Rekening B", None).count() == 1


# Corrections.


def test_bulk_pairs_become_allowed_in_order(spark):
    ledger = spark.createDataFrame([("bank", f"{i:032x}", "expense", "Old", "old", "Shop", None, None, None) for i in range(4)] + [("bank", "f" * 32, "internal", "I", "i", "", None, None, None)], "src string, tx_id string, flow_kind string, category string, subcategory string, merchant string, orig_category string, orig_subcategory string, similarity decimal(6,4)")
    items = [
        (1, "bank", f"{0:032x}", "Huis", "tuin", "", "", None),
        (2, "bank", f"{1:032x}", "Huis", "", "tuin", "Tuin BV", None),
        (3, "bank", f"{2:032X}", "Huis", "tuin", "", "", None),
        (4, "bank", f"{3:032x}", "Interne overboeking", "intern", "", "", None),
        (5, "bank", "f" * 32, "Old", "old", "", "", None),
        (6, "raw", "nope", "Old", "old", "", "", None),
        (7, "bank", f"{3:032x}", "", "", "", "", None),
    ]
    shape = "seq bigint, src string, tx_id string, category string, subcategory string, new_subcategory string, merchant string, similarity decimal(6,4)"
    selected = spark.createDataFrame(items, shape).drop("similarity")
    flagged = ledger.select("src", "tx_id", F.lit(None).cast(SUGGEST).alias("suggest"))
    pairs = spark.createDataFrame([("Old", "old"), ("Interne overboeking", "intern")], "category string, subcategory string")
    bulk = corrections.bulk_items(selected, flagged)
    reasons = {r.seq: r.reason for r in corrections.judge(bulk, ledger, pairs).collect()}
    assert reasons == {1: "pair", 2: None, 3: None, 4: "structural", 5: "missing", 6: "missing"}
    changed, rejects = corrections.apply_corrections(ledger, bulk, pairs)
    rows = {r.tx_id: r for r in changed.collect()}
    assert rejects.count() == 4
    assert (rows[f"{1:032x}"].subcategory, rows[f"{1:032x}"].merchant, rows[f"{1:032x}"].orig_category) == ("tuin", "Tuin BV", "Old")
    undone = {r.tx_id: r for r in corrections.undo_corrections(changed, ledger).collect()}
    assert undone[f"{1:032x}"].category == "Old" and undone[f"{1:032x}"].orig_category is None


def test_move_guard():
    corrections.check_move("Wonen", "Huishouden", "dakgoot")
    for move in (("Wonen", "Wonen", "x"), ("Interne overboeking", "Huishouden", "intern"), ("", "Huishouden", "x")):
        with pytest.raises(corrections.MoveRefused):
            corrections.check_move(*move)


def test_move_over_all_tables(spark):
    shape = "src string, tx_id string, category string, subcategory string"
    ledger = spark.createDataFrame([("bank", "1", "Huis", "tuin"), ("cc", "2", "Huis", "dak"), ("cc", "3", "Wonen", "tuin")], shape)
    suggested = spark.createDataFrame([("bank", "1", "Huis", "tuin")], shape)
    tables = {"ledger": ledger, "suggestions": suggested}
    moved, counts = corrections.move(tables, "Huis", "Wonen", "tuin")
    got = {(r.table_name, r.moment, r.src, r.category): r.n for r in counts.collect()}
    assert got == {
        ("ledger", "before", "bank", "Huis"): 1,
        ("ledger", "before", "cc", "Wonen"): 1,
        ("suggestions", "before", "bank", "Huis"): 1,
        ("ledger", "after", "bank", "Wonen"): 1,
        ("ledger", "after", "cc", "Wonen"): 1,
        ("suggestions", "after", "bank", "Wonen"): 1,
    }
    corrections.check_moved(moved, "Huis", "tuin")
    with pytest.raises(corrections.MoveRefused):
        corrections.check_moved(moved | {"suggestions": suggested}, "Huis", "tuin")
    with pytest.raises(corrections.MoveRefused):
        corrections.move(tables, "Huis", "Huis", "tuin")


# Neighbours.


def test_nearest_exact_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    vectors = [centres[i % 6] + 0.3 * rng.normal(size=8) for i in range(120)] + [np.ones(8)] * 40
    rows = [(f"{i:03d}", "Af" if i % 3 else "Bij", v.astype("float32").tolist(), (f"c{i % 6}", "s")) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "point_id string, direction string, embedding array<float>, payload struct<category:string,subcategory:string>")
    got = {r.point_id: [n.point_id for n in r.neighbours] for r in neighbours.nearest_exact(df, df).collect()}
    units = np.array([np.array(r[2], dtype=float) / np.linalg.norm(np.array(r[2], dtype=float)) for r in rows])
    scores = np.round(units @ units.T, 12)
    for i, r in enumerate(rows):
        same = [j for j in range(len(rows)) if j != i and rows[j][1] == r[1]]
        assert got[r[0]] == [rows[j][0] for j in sorted(same, key=lambda j: (-scores[i, j], rows[j][0]))[:5]]


_POINTS = "point_id string, direction string, embedding array<float>, payload struct<category:string,subcategory:string>"


def _clustered(spark, n, seed, width=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 15, width))
    vectors = [centres[i % len(centres)] + 0.25 * rng.normal(size=width) for i in range(n)]
    rows = [(f"{i:04d}", "Af" if i % 4 else "Bij", v.astype("float32").tolist(), ("c", "s")) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, _POINTS)


def _ids(found):
    return {r.point_id: [(m.point_id, round(m.score, 9)) for m in r.neighbours] for r in found.collect()}


@pytest.mark.parametrize("search", [{}, {"n_cells": 40, "probes": 1}, {"n_cells": 3}, {"n_cells": 1}])
def test_nearest_is_exact_whatever_the_cells(spark, search):
    df = _clustered(spark, 300, 8)
    zeros = spark.createDataFrame([(f"z{i}", "Af", [0.0] * 24, ("c", "s")) for i in range(3)], _POINTS)
    both = df.unionByName(zeros)
    assert _ids(neighbours.nearest(both, both, **search)) == _ids(neighbours.nearest_exact(both, both))


def test_nearest_of_odd_vectors(spark):
    zeros = spark.createDataFrame([(f"z{i}", "Af", [0.0, 0.0], ("c", "s")) for i in range(4)], _POINTS)
    same = spark.createDataFrame([(f"s{i}", "Af", [1.0, 1.0], ("c", "s")) for i in range(30)], _POINTS)
    for df in (zeros, same, zeros.unionByName(same), same.limit(1), same.limit(0)):
        assert _ids(neighbours.nearest(df, df, n_cells=3)) == _ids(neighbours.nearest_exact(df, df))
    assert _ids(neighbours.nearest(zeros, same.limit(0))) == {f"z{i}": [] for i in range(4)}


def test_cells_do_not_multiply_what_moves(spark, monkeypatch):
    """Vectors without clusters are looked for in nearly all cells; what is passed on does not grow with those."""
    rng = np.random.default_rng(3)
    rows = [(f"{i:04d}", "Af", v.astype("float32").tolist(), ("c", "s")) for i, v in enumerate(rng.normal(size=(300, 12)))]
    df = spark.createDataFrame(rows, _POINTS)
    moved, answers = [], neighbours._answers

    def counted(found, *more):
        moved.append(found.count())
        return answers(found, *more)

    monkeypatch.setattr(neighbours, "_answers", counted)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    assert _ids(neighbours.nearest(df, df, n_cells=30, probes=2)) == _ids(neighbours.nearest_exact(df, df))
    assert moved == [300 * 6 * 4] * 2


def test_cells_spare_most_comparisons(spark):
    """On vectors in clusters, bounds leave few cells to look into after the first ones."""
    df = _clustered(spark, 1500, 5)
    vectors = df.select(F.col("point_id").alias("vector_key"), F.lit("").alias("scope"), F.col("embedding").alias("vector"))
    file = neighbours.cells.trained(vectors, 100)
    placed = neighbours.cells.placed_in(file, vectors)
    file = file.with_rings(placed)
    exact = {r.point_id: r.neighbours[-1].score for r in neighbours.nearest_exact(df, df, scope=None).collect()}
    beat = spark.createDataFrame(list(exact.items()), "vector_key string, to_beat double")
    still = placed.join(beat, "vector_key").select(F.size(file.reachable(F.col("vector"), F.col("to_beat"), 5)).alias("n"))
    assert still.agg(F.avg("n")).first()[0] < 0.3 * file.size


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    points = fixtures.points(spark, f"/root/testdata/sf{sf}")
    exact = neighbours.nearest_exact(points, points)
    near = neighbours.recall(neighbours.nearest(points, points, recall=0.95, n_cells=45), exact).first()
    assert near.recall >= 0.9 and near.queries == points.count()
    whole = neighbours.recall(neighbours.nearest(points, points, n_cells=45), exact).first()
    assert whole.recall == 1.0 and whole.neighbours == 5 * whole.queries


def test_doubt_flags_make_the_ledger_once(spark):
    bank, card = fixtures.bank_ledger(spark, "/root/testdata/sf0.001"), fixtures.card_ledger(spark, "/root/testdata/sf0.001")
    ledger, made = unify(bank, card).limit(200).coalesce(1), spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    review.doubt_flags(ledger.mapInArrow(seen, ledger.schema), bank).collect()
    assert made.value == 200


def test_a_page_far_down_and_one_after_a_row(spark):
    rows = [(202400 + i % 12 + 1, "bank" if i % 2 else "card", f"{i:04d}") for i in range(2100)]
    df = spark.createDataFrame(rows, "ym int, src string, tx_id string")
    for newest in (False, True):
        plain = sorted(rows, key=lambda r: r[2], reverse=True)
        plain.sort(key=lambda r: r[1], reverse=newest)
        plain.sort(key=lambda r: -r[0])
        got = review.page(df, 510, newest, size=4).collect()
        assert [tuple(r) for r in got] == plain[2036:2040]
        after = review.page(df, 1, newest, after=plain[2035], size=4).collect()
        assert after == got


def test_neighbours_of_imported_rows(spark):
    near, far = [1.0, 0.1, 0.0], [0.0, 0.1, 1.0]
    points = [(f"p{i}", "Af", near, ("A", "a")) for i in range(4)] + [(f"q{i}", "Af", far, ("AB"[i % 2], "a")) for i in range(4)]
    points += [("b1", "Bij", near, ("C", "c"))]
    corpus = spark.createDataFrame(points, "point_id string, direction string, embedding array<float>, payload struct<category:string,subcategory:string>")
    rows = [("f", 0, "nieuw", "t", "text", "sure", "Af"), ("f", 1, "nieuw", "t", "text", "sure", "Af"), ("f", 2, "nieuw", "t", "regel", "sure", "Af"), ("f", 3, "dubbel", "t", "text", "", "Af"), ("f", 4, "nieuw", "", "text", "sure", "Af"), ("f", 5, "nieuw", "t", "text", "sure", "Bij")]
    preview = spark.createDataFrame(rows, "file string, pos int, status string, shown string, source string, tone string, direction string")
    vectors = spark.createDataFrame([("f", i, v) for i, v in enumerate([near, far, far, far, far, near])], "file string, pos int, embedding array<float>")
    got = {r.pos: r for r in neighbours.import_neighbours(preview, vectors, corpus).collect()}
    assert {p: (r.tone, r.neighbours_mixed) for p, r in got.items()} == {
        0: ("sure", False), 1: ("doubt", True), 2: ("sure", True), 3: ("", False), 4: ("sure", False), 5: ("sure", False)
    }
    assert [n.point_id for n in got[5].neighbours] == ["b1"] and got[3].neighbours is None


def test_proposal(spark):
    shape = "n array<struct<category:string,subcategory:string,score:double>>"
    same = [("H", "b", 0.9), ("H", "b", 0.8), ("H", "b", 0.7)]
    df = spark.createDataFrame([(same,), (same[:1] + [("V", "u", 0.6)],), ([],)], shape)
    a, b, c = [r.p for r in df.select(neighbours.proposal(F.col("n")).alias("p")).collect()]
    assert a.unanimous and not a.mixed and a.category == "H"
    assert b.mixed and not b.unanimous and len(b.split) == 2 and c is None


def test_points(spark):
    points = spark.createDataFrame([("p", [0.0, 1.0], ("H", "s"))], "point_id string, embedding array<float>, payload struct<category:string,subcategory:string>")
    assert neighbours.check_points(points, 2).count() == 1
    with pytest.raises(Exception, match="vector size"):
        neighbours.check_points(points, 3).collect()
