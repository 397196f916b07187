"""Stored tables that change bucket by bucket, and what is kept in them."""

import hashlib
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from grootboek.operators import corrections, imports, memory, review
from grootboek.operators.classify import SEARCHED, search
from grootboek.operators.refresh import SuggestionStore
from grootboek.operators.text_index import TextIndex
from grootboek.sources import checked_copy
from grootboek.sources.bucket_table import BucketTable
from grootboek.sources.checked_copy import CheckedCopy
from grootboek.sources.ledgers import CheckFailed
from grootboek.sources.table_set import TableSet
from grootboek.sources.vector_table import VectorTable

POINTS = "point_id string, embedding array<float>, payload struct<category:string,subcategory:string>"


def _points(spark, ids, category="H"):
    return spark.createDataFrame([(i, [1.0, 0.0], (category, "s")) for i in ids], POINTS)


def _files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("part-*.parquet")}


def _bucket(key):
    return hashlib.md5(key.encode()).hexdigest()[:2]


def test_a_change_leaves_other_buckets_alone(spark, tmp_path):
    ids = [f"p{i}" for i in range(200)]
    path = str(tmp_path / "points")
    table = VectorTable.of(_points(spark, ids), path)
    before = _files(path)
    assert table.upsert(_points(spark, ["p3", "new"], "W")) == 2
    after = _files(path)
    assert all(after[f] == t for f, t in before.items())
    fresh = [f for f in after if f not in before and "/data/2-" in f]
    assert {f.split("bucket=")[1][:2] for f in fresh} == {_bucket("p3"), _bucket("new")}
    assert {g for b, g in table.manifest().numbers.items() if b not in (_bucket("p3"), _bucket("new"))} == {1}
    got = {r.point_id: r.payload.category for r in table.read().collect()}
    assert got == dict.fromkeys(ids, "H") | {"p3": "W", "new": "W"}


def test_patches_and_removals(spark, tmp_path):
    table = VectorTable.of(_points(spark, ["a", "b", "c"]), str(tmp_path / "points"))
    table.patch(spark.createDataFrame([("a", "W", None), ("nobody", "W", "x")], "point_id string, category string, subcategory string"))
    table.remove(spark.createDataFrame([("b",), ("nobody",)], "point_id string"))
    assert {r.point_id: tuple(r.payload) for r in table.read().collect()} == {"a": ("W", "s"), "c": ("H", "s")}
    assert table.one("a").count() == 1 and table.one("b").count() == 0
    with pytest.raises(CheckFailed):
        table.patch(spark.createDataFrame([("a", "x")], "point_id string, description string"))
    with pytest.raises(CheckFailed):
        table.upsert(_points(spark, ["d", "d"]))
    # Nothing to change is no new version.
    version = table.manifest().version
    assert table.remove(spark.createDataFrame([], "point_id string")) == version


def test_a_lookup_opens_one_bucket(spark, tmp_path):
    table = VectorTable.of(_points(spark, [f"p{i}" for i in range(200)]), str(tmp_path / "points"))
    files = table.one("p7").inputFiles()
    assert files and all("bucket=" + _bucket("p7") in f for f in files)


def test_a_change_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    table = VectorTable.of(_points(spark, ["a", "b"]), str(tmp_path / "points"))

    def broken(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(VectorTable, "_commit", broken)
        with pytest.raises(RuntimeError):
            table.upsert(_points(spark, ["a"], "W"))
    assert {r.payload.category for r in table.read().collect()} == {"H"} and table.manifest().version == 1
    table.upsert(_points(spark, ["a"], "W"))
    assert {r.point_id: r.payload.category for r in table.read().collect()} == {"a": "W", "b": "H"}


def test_a_second_writer_and_a_second_table_are_refused(spark, tmp_path):
    table = VectorTable.of(_points(spark, ["a"]), str(tmp_path / "points"))
    with pytest.raises(Exception, match="(?i)exist"):
        VectorTable.of(_points(spark, ["z"]), str(tmp_path / "points"))
    at = table.manifest()
    table.upsert(_points(spark, ["a"], "W"))
    with pytest.raises(Exception, match="(?i)exist"):
        table._commit(at, at.generations, at.version + 1, "")
    assert [r.payload.category for r in table.read().collect()] == ["W"]


def test_empty_tables_grow(spark, tmp_path):
    table = VectorTable.of(_points(spark, []), str(tmp_path / "points"))
    assert table.read().count() == 0
    table.upsert(_points(spark, ["a"]))
    assert [r.point_id for r in table.read().collect()] == ["a"]
    with pytest.raises(ValueError):
        BucketTable.create(_points(spark, []), str(tmp_path / "x"), ["point_id"], digits=9)


# Suggestions.

CORPUS = "src string, tx_id string, text_key string, direction string, category string, subcategory string"


def _corpus(spark, start, n, labels=3):
    rows = []
    for i in range(start, start + n):
        text = None if i % 11 == 0 else f"shop {i % 7}"
        rows.append(("bank" if i % 2 else "cc", f"{i:032x}", text, "Af" if text else None, "H", f"s{(i // 7) % labels if i % 7 < 2 else 0}"))
    return spark.createDataFrame(rows, CORPUS)


def _plain(rows):
    return sorted(map(tuple, rows.collect()), key=repr)


@pytest.mark.parametrize("labels", [1, 2, 5])
def test_refresh_equals_recompute(spark, tmp_path, labels):
    old, new = _corpus(spark, 0, 150, labels), _corpus(spark, 150, 60, labels)
    store = SuggestionStore.create(old, str(tmp_path / "store"), digits=1)
    assert _plain(store.read()) == _plain(memory.suggestions(old).select(*store.read().columns))
    store.refresh("one", new)
    whole = memory.suggestions(old.unionByName(new)).select(*store.read().columns)
    assert _plain(store.read()) == _plain(whole)
    # A correction: rows go out as they were and in as they are.
    was = new.where("text_key = 'shop 0'")
    store.refresh("two", was.withColumn("subcategory", F.lit("other")), was)
    fixed = old.unionByName(new.where("text_key is null or text_key <> 'shop 0'")).unionByName(was.withColumn("subcategory", F.lit("other")))
    assert _plain(store.read()) == _plain(memory.suggestions(fixed).select(*store.read().columns))
    store.refresh("three", was.limit(0), old)
    rest = new.where("text_key is null or text_key <> 'shop 0'").unionByName(was.withColumn("subcategory", F.lit("other")))
    assert _plain(store.read()) == _plain(memory.suggestions(rest).select(*store.read().columns))


def test_a_refresh_that_broke_off_is_repeated(spark, tmp_path, monkeypatch):
    old, new = _corpus(spark, 0, 80), _corpus(spark, 80, 30)
    store = SuggestionStore.create(old, str(tmp_path / "store"), digits=1)
    change = BucketTable.change
    with monkeypatch.context() as m:
        m.setattr(BucketTable, "change", lambda self, *a, **k: change(self, *a, **k) if self.path.endswith("counts") else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.refresh("batch", new)
    for _ in range(2):
        store.refresh("batch", new)
    assert _plain(store.read()) == _plain(memory.suggestions(old.unionByName(new)).select(*store.read().columns))


def test_a_refresh_judges_only_the_texts_it_touches(spark, tmp_path):
    old = _corpus(spark, 0, 200)
    store = SuggestionStore.create(old, str(tmp_path / "store"))
    store.refresh("one", spark.createDataFrame([("bank", "f" * 32, "shop 3", "Af", "H", "s0")], CORPUS))
    generations = store.rows.manifest().numbers
    assert sorted(generations.values()).count(2) == 1 and len(generations) > 5


# The text index.


def _texts(spark):
    rows = [
        ("bank", f"{i:032x}", f"Atelier {i} Straße {'x' * (i % 4)}", None if i % 5 == 0 else f"Shop {i % 9}", "Huis", "tuin" if i % 2 else "")
        for i in range(120)
    ]
    return spark.createDataFrame(rows, "src string, tx_id string, description string, merchant string, category string, subcategory string")


@pytest.mark.parametrize("needle", ["atelier 1", "STRASSE", "raße x", "shop 8", "uis", "tu", "nothing", "Shop 8Huis", "a", " %_ ", "Atelier 77 Straße x"])
def test_indexed_search_equals_a_scan(spark, tmp_path_factory, needle):
    rows = _texts(spark)
    path = str(tmp_path_factory.getbasetemp() / "text-index")
    if not Path(path).exists():
        index = TextIndex.create(rows.limit(0), path, digits=1)
        index.add(rows.where("tx_id < '%032x'" % 90), "a", digits=1)
        index.add(rows.where("tx_id >= '%032x'" % 90), "b", digits=1)
    from grootboek.functions.text import search_needle

    found = TextIndex(spark, path).search(needle)
    text = search_needle(needle)
    want = search(rows, text).select("src", "tx_id") if text else rows.limit(0).select("src", "tx_id")
    assert _plain(found) == _plain(want)


def test_indexed_search_reads_few_texts(spark, tmp_path, monkeypatch):
    from grootboek.operators import text_index

    monkeypatch.setattr(text_index, "SHARD_ROWS", 4)
    index = TextIndex.create(_texts(spark), str(tmp_path / "index"))
    found = index.search("Atelier 77 ")
    texts = [f for f in found.inputFiles() if "/texts/" in f]
    assert found.count() == 1 and len(texts) <= 2
    with pytest.raises(Exception, match="(?i)exist"):
        index.add(_texts(spark), "0")
    assert set(SEARCHED) <= set(_texts(spark).columns)


# Ids and pages.


def test_known_ids_read_few_buckets(spark, tmp_path):
    ids = spark.createDataFrame([(f"{i:032x}",) for i in range(300)], "tx_id string")
    table = BucketTable.create(ids, str(tmp_path / "ids"), ["tx_id"])
    rows = spark.createDataFrame([(f"{7:032x}",), (f"{7:032x}",), ("f" * 32,), ("",), (None,)], "tx_id string")
    found = imports.with_known(rows, table)
    assert sorted((r.tx_id or "", r.known) for r in found.collect()) == [("", False), ("", False), (f"{7:032x}", True), (f"{7:032x}", True), ("f" * 32, False)]
    assert len(found.inputFiles()) <= 3


@pytest.mark.parametrize("newest", [False, True])
def test_page_by_counting_equals_page(spark, newest):
    rows = [(None if i % 97 == 0 else 202400 + i % 5, "bank" if i % 3 else "cc", hashlib.md5(b"%d" % i).hexdigest()) for i in range(3000)]
    df = spark.createDataFrame(rows, "ym int, src string, tx_id string")
    for number in (1, 2, 77, 150, 151, 0):
        want = review.page(df, number, newest).collect()
        got = review.page_at(df, number, newest).orderBy("place").collect()
        assert [(r.ym, r.src, r.tx_id) for r in got] == [tuple(r) for r in want]
        assert [r.place for r in got] == list(range((max(1, number) - 1) * 20 + 1, (max(1, number) - 1) * 20 + 1 + len(got)))


# Copies and moves.


def _ledger(spark, n=60, start=0):
    rows = [
        (i, hashlib.md5(b"%d" % i).hexdigest(), 202401 + i % 3, f"Atelier {i}", Decimal("8.20") + i, "H", "s", Decimal("0.5"))
        for i in range(start, start + n)
    ]
    shape = "id bigint, tx_id string, ym int, description string, amount decimal(18,2), category string, subcategory string, similarity decimal(6,4)"
    return spark.createDataFrame(rows, shape)


def _cells(rows):
    return sorted(map(repr, rows.select("id", "tx_id", "ym", "description", "amount", "category").collect()))


def test_a_copy_goes_on_where_it_stopped(spark, tmp_path):
    source, path = _ledger(spark), str(tmp_path / "copy")
    copy = CheckedCopy(spark, path)
    first = copy.run(source, at_most=4)
    assert set(first.values()) == {"copied"} and len(first) == 4
    with pytest.raises(CheckFailed):
        copy.read()
    # A slice that was half written: files without checks.
    names = sorted({r[0][0] for r in source.select("tx_id").collect()})
    source.limit(3).write.partitionBy("ym").parquet(f"{path}/data/slice={names[4]}")
    before = {f: t for f, t in _files(path).items() if any(f"data/slice={s}/" in f for s in first)}
    second = CheckedCopy(spark, path).run(source)
    assert {s: o for s, o in second.items() if o == "kept"}.keys() == first.keys() and len(second) == len(names)
    assert before.items() <= _files(path).items()
    got = CheckedCopy(spark, path).read()
    assert _cells(got) == _cells(source) and got.where("similarity is not null").isEmpty()
    assert CheckedCopy(spark, path).run(source) == {}


def test_a_slice_whose_source_changed_is_copied_again(spark, tmp_path):
    source, copy = _ledger(spark), CheckedCopy(spark, str(tmp_path / "copy"))
    kept = copy.run(source, at_most=3)
    name = sorted(kept)[0]
    changed = source.withColumn("description", F.when(F.col("tx_id").startswith(name), "new").otherwise(F.col("description")))
    outcomes = copy.run(changed)
    assert outcomes[name] == "copied" and sum(o == "kept" for o in outcomes.values()) == 2
    assert _cells(copy.read()) == _cells(changed)


def test_copies_that_are_refused(spark, tmp_path, monkeypatch):
    source = _ledger(spark, 20)
    with pytest.raises(CheckFailed, match="unique"):
        CheckedCopy(spark, str(tmp_path / "a")).run(source.unionByName(source.limit(1)))
    with pytest.raises(CheckFailed, match="characters"):
        CheckedCopy(spark, str(tmp_path / "b")).run(source.withColumn("tx_id", F.lit("short")))
    # Files that do not hold what the source holds.
    copy, real = CheckedCopy(spark, str(tmp_path / "c")), checked_copy.checks
    calls = []

    def other(rows):
        calls.append(1)
        return real(rows if len(calls) == 1 else rows.withColumn("description", F.lit("lost")))

    monkeypatch.setattr(checked_copy, "checks", other)
    with pytest.raises(CheckFailed, match="differs"):
        copy.run(source)
    assert not copy.committed()


PAIRS = "src string, tx_id string, category string, subcategory string"


def _set(spark, path):
    rows = {
        name: spark.createDataFrame([(src, f"{i:032x}", "Huis" if i % 4 == 0 else "Auto", "tuin") for i in range(40)], PAIRS)
        for name, src in (("bank", "bank"), ("card", "cc"), ("suggestions", "bank"))
    }
    return TableSet.create(rows, path, dict.fromkeys(rows, ["src", "tx_id"]))


def _pairs(tables):
    return {n: sorted((r.category, r["count"]) for r in tables.read(n).groupBy("category").count().collect()) for n in ("bank", "card", "suggestions")}


def test_a_move_changes_all_tables(spark, tmp_path):
    tables = _set(spark, str(tmp_path / "set"))
    counts = corrections.move_stored(tables, ["bank", "card", "suggestions"], "Huis", "Wonen", "tuin").collect()
    assert _pairs(tables) == dict.fromkeys(("bank", "card", "suggestions"), [("Auto", 30), ("Wonen", 10)])
    assert {(r.table_name, r.moment, r.category, r.n) for r in counts} == {
        (n, m, c, 10) for n in ("bank", "card", "suggestions") for m, c in (("before", "Huis"), ("after", "Wonen"))
    }
    # Nothing left to move is no new version.
    corrections.move_stored(tables, ["bank", "card", "suggestions"], "Huis", "Wonen", "tuin")
    assert tables.versions()[0] == 2


def test_a_move_that_breaks_off_between_two_tables_changes_none(spark, tmp_path, monkeypatch):
    tables = _set(spark, str(tmp_path / "set"))
    before, change = _pairs(tables), BucketTable.change

    def breaks(self, *a, **k):
        if self.path.endswith("card"):
            raise RuntimeError("lost")
        return change(self, *a, **k)

    with monkeypatch.context() as m:
        m.setattr(BucketTable, "change", breaks)
        with pytest.raises(RuntimeError):
            corrections.move_stored(tables, ["bank", "card", "suggestions"], "Huis", "Wonen", "tuin")
    assert _pairs(tables) == before and tables.versions()[0] == 1
    # A later move starts from what counts, not from what the broken one left.
    corrections.move_stored(tables, ["bank", "card", "suggestions"], "Auto", "Wonen", "tuin")
    assert _pairs(tables) == dict.fromkeys(("bank", "card", "suggestions"), [("Huis", 10), ("Wonen", 30)])


def test_a_move_that_leaves_rows_behind_is_refused(spark, tmp_path, monkeypatch):
    tables = _set(spark, str(tmp_path / "set"))
    before = _pairs(tables)
    with monkeypatch.context() as m:
        m.setattr(corrections, "relabel", lambda rows, *pair: rows)
        with pytest.raises(corrections.MoveRefused):
            corrections.move_stored(tables, ["bank", "card", "suggestions"], "Huis", "Wonen", "tuin")
    assert _pairs(tables) == before
