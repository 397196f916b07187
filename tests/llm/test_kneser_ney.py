import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from grootboek.llm import kneser_ney as kn

PAD = kn.PAD


def _plain_model(texts, order):
    grams = {order: Counter()}
    for t in texts:
        padded = PAD * (order - 1) + t
        grams[order].update(padded[i : i + order] for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    discounts = {}
    for k, c in grams.items():
        n = Counter(c.values())
        discounts[k] = kn._discounts(n[1], n[2], n[3], n[4])
    by_context = defaultdict(list)
    for k, c in grams.items():
        for g, n in c.items():
            by_context[k, g[:-1]].append(n)

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / (len(grams[1]) + 1)
        seen = by_context.get((k, g[:-1]))
        if not seen:
            return lower
        take = lambda n: discounts[k][min(n, 3) - 1]
        own = max(0.0, grams[k][g] - take(grams[k][g])) / sum(seen) if grams[k][g] else 0.0
        return own + sum(map(take, seen)) / sum(seen) * lower

    return p


def _log_micro(p, text, order):
    padded = PAD * (order - 1) + text
    return sum(round(math.log(p(padded[i : i + order])) * kn.UNIT) for i in range(len(text)))


@pytest.mark.parametrize("head", [0, 40, 1 << 18])
def test_scores_are_those_of_the_plain_model(spark, head):
    rng = random.Random(head)
    word = lambda: rng.choice(["the", "cat", "sat", "on", "mat", "ébène", "😀", "x%%"])
    texts = [" ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    docs = [*texts[:10], "unseen QQQ zzz", "a", "\x02", "ß日本"]
    trained = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model = kn.train(trained, order=3)
    p = _plain_model(texts, 3)
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(docs)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in kn.score(df, model, head).collect()}
    for i, t in enumerate(docs):
        assert got[i].chars == len(t)
        assert abs(got[i].log_micro - _log_micro(p, t, 3)) <= len(t)
    context = PAD + "t"
    letters = {c for t in texts for c in t}
    assert sum(p(context + c) for c in letters) == pytest.approx(1, abs=0.05)


def test_table_finds_all_keys_and_no_others():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 2**63, 5000, dtype=np.uint64))
    table = kn._Table(keys, np.arange(len(keys)))
    values, missing = table.find(np.concatenate([keys[::-1], keys + np.uint64(1)]))
    assert values[: len(keys)].tolist() == list(range(len(keys)))[::-1] and not missing[: len(keys)].any()
    assert missing[len(keys) :].sum() >= len(keys) - 2
    assert kn._Table(keys[:0], keys[:0].astype(int)).find(keys[:3])[1].all()


def test_verdicts(spark):
    rng = random.Random(7)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["%%%Q", "$$ZZ", "||||"]) for _ in range(60))
    rows = [(i, good(), "en") for i in range(200)] + [(i, bad(), "en") for i in range(200, 230)]
    rows += [(300, None, "en"), (301, "", None), (None, good(), None), (302, good() * 300, "xx"), (5, rows[5][1], "en")]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, kept boolean")
    labels = [(i, 1, 0) for i in range(150)] + [(200, 0, 0), (201, 1, 1), (None, 1, 0), (3, 1, None)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kn.classify(df, known, min_held_out=10).collect()}
    assert len(got) == len({r[0] for r in rows})
    assert sum(got[i].kept for i in range(200)) >= 195
    assert not any(got[i].kept for i in range(200, 230))
    assert got[300].perplexity is None and not got[300].kept and not got[301].kept
    assert got[None].kept and got[302].limit == got[1].limit
    assert got[5].chars == 2 * len(rows[5][1])
    assert all(r.kept == (r.chars > 0) for r in kn.classify(df, known.limit(0)).collect())
    assert kn.classify(df.limit(0), known).count() == 0


def test_a_language_with_few_trusted_documents_has_a_limit_of_its_own(spark):
    rng = random.Random(9)
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    plain, odd = ["the", "cat", "sat", "on", "a", "mat"], [f"{a}{b}{c}" for a in "qxzj" for b in "kvwy" for c in "pfgh"]
    rows = [(i, text(plain, 60), "en") for i in range(120)] + [(i, text(odd, 60), "xx") for i in range(200, 240)]
    # English with odd words: within the limit of all languages, but not within its own.
    rows += [(i, text(plain, 30) + " " + text(odd, 15), "en") for i in range(300, 310)]
    rows += [(400, text(plain, 60), "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(110), *range(200, 235)]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kn.classify(df, labels).collect()}
    assert got[0].limit < got[200].limit and got[0].limit < got[400].limit
    assert not any(got[i].kept for i in range(300, 310))
    assert all(got[i].kept for i in range(200, 235)) and got[400].kept


def test_a_table_takes_little_memory_and_finds_every_key():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(1, 1 << 63, 1 << 17, dtype=np.uint64))
    values = rng.integers(-745_000_000, 0, len(keys))
    table = kn._Table(keys, values)
    assert table.keys.nbytes + table.values.nbytes <= 48 * len(keys) + 48
    asked = np.concatenate([keys, keys + np.uint64(1 << 63)])
    found, missing = table.find(asked)
    assert found[: len(keys)].tolist() == values.tolist()
    assert not missing[: len(keys)].any() and missing[len(keys) :].all()
