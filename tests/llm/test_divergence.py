import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from grootboek.llm import divergence
from grootboek.llm.divergence import Rule, audit

FIELDS = "doc_id long, text string, lang string, source string"


def _plain(rows, least, top):
    """The audit by its definition, with whole numbers of any size."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        c.lower() if c.isascii() else c for c in text or ""))) for _, text, lang, source in rows]
    df = Counter((lang, t) for lang, _, terms in docs for t in set(terms))
    counts, whole = defaultdict(Counter), defaultdict(Counter)
    groups = sorted({d[:2] for d in docs})
    for lang, source, terms in docs:
        for t in terms:
            if df[lang, t] >= least:
                counts[lang, source][t] += 1
                whole[lang][t] += 1
    out = []
    for lang, source in groups:
        kept = whole[lang]

        def p(of, t):
            return 1 + 10**9 * (of[t] + 2) // (sum(of.values()) + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        mine = counts[lang, source]
        pairs = [
            (sum(f(p(mine, t), p(counts[lang, s], t)) for t in kept), s) for la, s in groups if la == lang and s != source
        ]
        terms = [(f(p(mine, t), p(kept, t)), t) for t in mine if p(mine, t) > p(kept, t)]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, v, i + 1) for i, (v, item) in enumerate(found[:most])]
    return sorted(out)


def _rows(seed, n=160):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "a", "ß", "É", "zürich", "x1y", "of", "rare", *(f"w{chr(97 + i)}" for i in range(20))]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words, rng.integers(0, 30)).tolist())
        lang = [None, "", "en", "en", "en", "xx"][rng.integers(0, 6)]
        source = None if rng.random() < 0.1 else f"s{min(4, int(rng.exponential(1)))}"
        out.append((i % 50, [text, None, "", "12 34 ..."][0 if rng.random() < 0.8 else rng.integers(1, 4)], lang, source))
    return out + out[:30]


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_audit_by_its_definition(spark, chunk):
    rows = _rows(chunk)
    df = spark.createDataFrame(rows, FIELDS)
    got = sorted(tuple(r) for r in audit(df, Rule(chunk=chunk)).collect())
    assert got == _plain(rows, 10, 10)
    assert {r[2] for r in got} == {"pair", "term"}


def test_clashing_columns_and_many_sources(spark):
    rows = [(i, f"alpha beta {'gamma ' * (i % 3)}", "en", f"s{i % 25:02d}") for i in range(120)]
    df = spark.createDataFrame(rows, FIELDS)
    odd = df.selectExpr("*", "1 as pos", "'x' as term", "'y' as item", "2 as n", "3 as total", "array(1) as by")
    assert sorted(tuple(r) for r in audit(odd).collect()) == _plain(rows, 10, 10)


def test_langs_without_kept_terms_and_lone_sources(spark):
    rows = [(1, "one two", "aa", "s"), (2, None, "aa", "t"), (3, "three", "bb", "s"), (3, "three", "bb", "s")]
    got = sorted(tuple(r) for r in audit(spark.createDataFrame(rows, FIELDS)).collect())
    assert got == [("aa", "s", "pair", "t", 0, 1), ("aa", "t", "pair", "s", 0, 1)]
    assert audit(spark.createDataFrame([], FIELDS)).count() == 0


def test_ties_go_by_item(spark):
    rows = [(i, "zeta alpha É", "en", "s1" if i % 2 else "s2") for i in range(24)] + [(99, "only", "en", "s3")]
    got = audit(spark.createDataFrame(rows, FIELDS)).filter("part = 'pair' and source = 's3'").sort("rank").collect()
    assert [(r["item"], r["rank"]) for r in got] == [("s1", 1), ("s2", 2)]


def test_a_very_long_text(spark):
    text = "word " * 200_000 + "other " * 3
    rows = [(0, text, "en", "a")] + [(i, "word other", "en", "b") for i in range(1, 12)]
    assert sorted(tuple(r) for r in audit(spark.createDataFrame(rows, FIELDS)).collect()) == _plain(rows, 10, 10)


def test_probabilities_of_very_large_counts():
    counts = np.array([0, 1, 10**12, 9 * 10**13 + 7], np.int64)
    total, kept = 10**14, 12345
    want = [1 + 10**9 * (int(c) + 2) // (total + 2 * kept) for c in counts]
    assert divergence.scaled(counts, total, kept).tolist() == want


def test_probabilities_in_sql_are_the_same(spark):
    from pyspark.sql import functions as F

    rows = [(0, 10**14, 12345), (9 * 10**13 + 7, 10**14, 12345), (3, 20, 4)]
    df = spark.createDataFrame(rows, "n long, total long, kept long")
    got = [r.p for r in df.select(divergence.probability(F.col("n"), F.col("total"), F.col("kept")).alias("p")).collect()]
    assert got == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in rows]


def test_equal_counts_stand_together():
    """Sorted rows need far fewer runs than terms."""
    rng = np.random.default_rng(1)
    keys = sorted({tuple((g, int(n)) for g, n in enumerate(rng.poisson(0.4, 5)) if n) for _ in range(3000)} - {()})
    _, pos, sizes, ends, counts = divergence.encoded("en", [list(k) for k in keys], [2] * len(keys))
    sizes = np.frombuffer(sizes, np.int64)
    assert len(sizes) == 5 and sizes.sum() == len(np.frombuffer(ends, np.int64)) == len(np.frombuffer(counts, np.int64))
    assert sizes.sum() < 3 * len(keys) and np.frombuffer(ends, np.int64)[-1] == 2 * len(keys)
