import collections

import corpus_pipeline as pipeline
from grootboek.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark):
    docs = table(spark, SF, "documents")
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    n = docs.count()
    whole = {r.doc_id: r for r in docs.collect()}
    assert len(pipeline.STAGES) == 5
    for name, stage in pipeline.STAGES[:4]:
        docs = pipeline.stored(stage(spark, docs, SF), "test")
        assert docs.columns == pipeline.COLUMNS
        rows = docs.collect()
        assert 0 < len(rows) <= n and len({r.doc_id for r in rows}) == len(rows)
        n = len(rows)
        if name in ("quality rules", "quality classifier"):
            good = [i for i, r in labels.items() if r.quality == 1 and not r.toxic and len(whole[i].text.split()) > 25]
            assert sum(i in {r.doc_id for r in rows} for i in good) >= 0.97 * len(good)
            assert all(tuple(r) == tuple(whole[r.doc_id]) for r in rows)
        if name == "near duplicates":
            assert len({r.text for r in rows}) == len(rows)
        assert all(r.n_chars == len(r.text) for r in rows)
    pieces = pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}
    used = collections.Counter()
    for p in pieces:
        used[p.sequence_id] += p.length
    assert max(used.values()) <= 1024


def test_odd_tables(spark, tmp_path):
    row = (1, None, None, None, None, "extra")
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    for name, rows in (("empty", []), ("nulls", [row, row, (None, *row[1:])])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert pipeline.run(spark, f"{tmp_path}/{name}").count() == 0


def test_odd_rows_beside_rows_that_stay(spark):
    """Ties in similarity, null and empty texts, and columns whose names the stage uses itself."""
    words = [f"word{i}" for i in range(90)]
    near = [" ".join([*words[:45], f"x{k}", *words[46:]]) for k in range(3)]
    rows = [(7, near[0]), (5, near[1]), (6, near[2]), (8, None), (9, None), (3, ""), (1, " ".join(f"other{i}" for i in range(60)))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs.selectExpr("*", "1 as node", "2 as fp", "3 as fingerprint", "4 as component_id", "'k' as kept", "5 as cluster")
    got = dict(pipeline.STAGES)["near duplicates"](spark, odd, SF)
    assert got.columns == pipeline.COLUMNS
    # Of the copies the smallest id stays, and one of the texts without words.
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 5]


def test_repeated_rows_leave_one(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(4, text), (4, text), (9, text), (2, " ".join(f"other{i}" for i in range(80))), (None, text)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(pipeline.STAGES)["near duplicates"](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in got) == [2, 4]
