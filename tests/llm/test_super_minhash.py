import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from grootboek.llm import super_minhash
from grootboek.llm.super_minhash import Rule, linked, near_duplicates, signatures
from grootboek.llm.words import STEP, mixed

DOCS = "doc_id long, text string"


def _plain_signature(elements, size):
    """Element by element, with no early stop."""
    out = [2**64 - 1] * size
    for e in elements:
        order = list(range(size))
        for j in range(size):
            drawn = int(mixed(np.array([(int(e) + (j + 1) * STEP) % 2**64], np.uint64))[0])
            pick = j + ((drawn & 0xFFFFFFFF) * (size - j) >> 32)
            order[j], order[pick] = order[pick], order[j]
            out[order[j]] = min(out[order[j]], j << 32 | drawn >> 32)
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 9, 60, 400])
def test_signature_by_its_definition(n):
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, 2**63, k, np.int64).view(np.uint64)) for k in (n, 3, max(0, n - 1))]
    got = signatures(sets, 24)
    for s, row in zip(sets, got, strict=True):
        assert row.tolist() == _plain_signature(s, 24)


def test_signatures_estimate_similarity_with_less_variance():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(150):
        both, a, b = (rng.integers(0, 2**63, k, np.int64).view(np.uint64) for k in (24, 8, 8))
        x, y = signatures([np.unique(np.concatenate([both, s])) for s in (a, b)], 128)
        errors.append((x == y).mean() - 24 / 40)
    independent = 0.6 * 0.4 / 128
    assert abs(np.mean(errors)) < 0.02 and np.var(errors) < 0.75 * independent


def _sets(docs):
    out = []
    for i, text in docs:
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        out.append((i, {" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()))
    return out


def _plain(docs):
    sets = _sets(docs)
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                label[root(i)] = root(j)
    out = []
    for i, (doc, s) in enumerate(sets):
        ids = [d for k, (d, _) in enumerate(sets) if root(k) == root(i) and d is not None]
        least = min(ids) if ids else None
        out.append((doc, len(s), least, doc == least))
    return sorted(out, key=repr)


def _family(rng, base, n, changes):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def _corpus(seed):
    rng = random.Random(seed)
    texts = []
    for n, length, changes in ((60, 120, 3), (25, 60, 4), (12, 200, 16), (40, 30, 2)):
        texts += _family(rng, [f"w{rng.randrange(5000)}" for _ in range(length)], n, changes)
    texts += [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 90))) for _ in range(60)]
    texts += texts[:20] + ["One two", "one  TWO", "one two three", "one"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("rule", [Rule(), Rule(tile=8, hubs=2), Rule(tile=16, hubs=3, elements=400)])
def test_components_by_brute_force(spark, rule):
    docs = _corpus(rule.tile)
    got = near_duplicates(spark.createDataFrame(docs, DOCS).repartition(5), ["doc_id"], rule)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == _plain(docs)


def test_a_chain_in_a_cluster_of_many_tiles_is_followed(spark):
    """Neighbours in the chain link, its ends do not; tiles are far smaller than the chain."""
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[4 * i : 4 * i + 80])) for i in range(80)]
    got = near_duplicates(spark.createDataFrame(docs, DOCS), ["doc_id"], Rule(tile=6, hubs=1))
    assert sorted(map(tuple, got.collect()), key=repr) == _plain(docs)
    assert got.select("component_id").distinct().count() == 1


def test_exactly_at_the_limit(spark):
    base = [f"w{i}" for i in range(84)]  # 81 shingles
    cases = [(0, base), (1, [*base[:75], *(f"y{i}" for i in range(9))]), (2, [*base[:-18]]), (3, [*base[:-17]])]
    docs = [(i, " ".join(w)) for i, w in cases]
    got = near_duplicates(spark.createDataFrame(docs, DOCS), ["doc_id"])
    assert sorted(map(tuple, got.collect()), key=repr) == _plain(docs)


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    docs = [
        (5, "a b c d e"), (5, "a b c d e"), (5, "something else altogether now"), (3, "A B\tc\nD  e"), (None, "a b c d e"),
        (None, None), (7, None), (8, ""), (9, "  \n"), (None, "only null here my friend"), (10, long), (11, long + " end"),
        (None, "only null here my friend"), (12, "É é ü"), (13, "é é ü"),
    ]
    df = spark.createDataFrame(docs, DOCS)
    odd = df.selectExpr("*", "1 as node", "2 as key", "3 as least", "'x' as set", "4 as cluster", "5 as n_shingles")
    got = near_duplicates(odd, ["doc_id"]).collect()
    want = _plain(docs)
    want = sorted([(d, n, c, True if d is None and c is None else k) for d, n, c, k in want], key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert near_duplicates(spark.createDataFrame([], DOCS), ["doc_id"]).count() == 0


def test_one_set_on_a_third_of_all_rows(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "the very same words again and again").otherwise(
            F.concat_ws(" ", *[F.concat(F.lit("w"), F.xxhash64("id", F.lit(k)).cast("string")) for k in range(6)])
        ).alias("text"),
    )
    got = near_duplicates(docs, ["doc_id"])
    assert got.filter("kept").count() == 2001
    assert got.filter("doc_id % 3 = 0 and component_id = 0").count() == 1000


def test_linked_between_two_sides():
    sets = [np.arange(a, a + 20, dtype=np.uint64) for a in (0, 1, 2, 100)]
    assert len(linked(sets, 80)) == 2
    assert linked(sets, 80, np.array([1, 1, 2, 2])) and all(b == 2 for _, b in linked(sets, 80, np.array([1, 1, 2, 2])))
    assert super_minhash.set_key(sets[0]) != super_minhash.set_key(sets[1])
