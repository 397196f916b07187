import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from grootboek.llm import max_sketch
from grootboek.llm.max_sketch import Queries, Rule, Search, search

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def _terms(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def _plain(docs, items, k=50):
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(_terms(t))
    out = []
    for item, terms in asked.items():
        found = []
        for doc, c in counts:
            m = 50 + (50 * sum(c.values()) * n) // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in terms
                if c[t]
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, i + 1, None if x[1] else x[2], -x[0]) for i, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def _corpus(seed, n=400):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(600)])
    weights = 1 / np.arange(1, 601)
    docs = [
        (int(i), " ".join(rng.choice(words, int(rng.integers(1, 80)), p=weights / weights.sum()).tolist())) for i in range(n)
    ]
    items = [(int(i), " ".join(rng.choice(words, 12).tolist())) for i in range(15)]
    return docs, items


@pytest.mark.parametrize("rule", [Rule(), Rule(k=3, places=16, strip=4), Rule(k=7, places=256, batch=40)])
def test_search_by_its_definition(spark, rule):
    docs, items = _corpus(rule.places)
    df = spark.createDataFrame(docs, DOCS).repartition(6)
    got = search(df, spark.createDataFrame(items, ITEMS), rule)
    assert sorted(map(tuple, got.collect()), key=repr) == _plain(docs, items, rule.k)


def test_odd_rows(spark):
    docs = [
        (3, "Apple pie"), (3, "Apple pie"), (1, "APPLE  pie, again"), (None, "apple"), (None, None), (5, ""), (6, "..."),
        (7, "É é Ünder 42"), (8, "pie " * 50_000), (9, "nothing here"), (2, "apple pie"),
    ]
    items = [(1, "apple PIE"), (1, "42"), (2, None), (3, ""), (None, "é pie"), (4, "absent"), (5, "apple apple apple")]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' as item", "'y' as term", "1 as score", "2 as rank")
    asked = spark.createDataFrame(items, ITEMS).selectExpr("*", "7 as doc_id", "'z' as terms", "0 as batch")
    got = sorted(map(tuple, search(df, asked).collect()), key=repr)
    assert got == _plain(docs, items)


def test_ties_go_by_id_with_null_last(spark):
    docs = [(i, "same words") for i in (9, 4, 4, 7)] + [(None, "same words"), (1, "other thing")]
    got = search(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(0, "same")], ITEMS), Rule(k=5)).sort("rank")
    assert [(r.rank, r.doc_id) for r in got.collect()] == [(1, 4), (2, 4), (3, 7), (4, 9), (5, None)]


def test_empty_tables(spark):
    docs, items = _corpus(1, 5)
    none_docs, none_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some_docs, some_items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for d, i in ((none_docs, some_items), (some_docs, none_items), (none_docs, none_items)):
        got = search(d, i)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def _task(docs, items, rule):
    counts = [Counter(_terms(t)) for _, t in docs]
    df = Counter(t for c in counts for t in c)
    rows = [{"item_id": i, "terms": " ".join(sorted(set(_terms(t))))} for i, t in items]
    queries = Queries(rows, len(docs), sum(map(sum, (c.values() for c in counts))), {t.encode(): n for t, n in df.items()}, rule)
    return Search(queries)


def test_bounds_are_never_below_scores_and_spare_most_documents():
    docs, items = _corpus(5, 2000)
    task = _task(docs, items, Rule(k=5))
    for at in range(0, len(docs), 100):
        task.add(*map(list, zip(*docs[at : at + 100], strict=True)))
    assert task.n_scored < task.n_bounded / 4
    sketch, exact = task.sketch([Counter(max_sketch.terms_of(t)) for _, t in docs[:50]])
    for places, weights, terms in zip(task.places, task.weights, task.q.weighed, strict=True):
        scores = [sum(w * own.get(t, 0) for t, w in terms) for own in exact]
        assert (weights @ sketch[places] >= np.array(scores)).all()
