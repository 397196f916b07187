import random

import numpy as np
import pytest
import xxhash

from grootboek.llm import simhash
from grootboek.llm.components import components


def _plain_components(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            least = min(label[a], label[b])
            if label[a] != least or label[b] != least:
                label[a] = label[b] = least
                changed = True
    return label


def _plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "   ", "One", "a b c", "A b C d", "a b c d e f g h a b c d É é ß"])
def test_fingerprint_follows_its_definition(text):
    assert simhash.fingerprint(text) % 2**64 == _plain_fingerprint(text)


def test_hash_is_sparks(spark):
    row = spark.sql("select xxhash64('one two three four') h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest("one two three four", 42)


def _clusters(seed, n, spread):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, max(1, n // 12), dtype=np.uint64)
    out = []
    for _ in range(n):
        value = int(rng.choice(centres))
        for b in rng.integers(0, 64, rng.integers(0, spread)):
            value ^= 1 << int(b)
        out.append(value)
    return sorted(set(out))


@pytest.mark.parametrize("tile", [4, 64, 4096])
def test_links_give_all_components(spark, tile):
    values = _clusters(tile, 240, 6)
    # One crowded group of near copies, far larger than a tile.
    values = sorted(set(values) | {values[0] ^ (1 << a) ^ (1 << b) for a in range(8) for b in range(8)})
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 4]
    signed = {v: v - 2**64 if v >= 2**63 else v for v in values}
    df = spark.createDataFrame([(signed[v],) for v in values], "fp long")
    found = simhash.linked(df, tile=tile)
    edges = [(r.u, r.v) for r in found.collect()]
    got = _plain_components(signed.values(), edges)
    assert got == _plain_components(signed.values(), [(signed[a], signed[b]) for a, b in pairs])
    labels = {r.node: r.label for r in components(found).collect()}
    assert labels == {n: x for n, x in got.items() if n in labels}
    assert {n for e in edges for n in e if e[0] != e[1]} == set(labels)


def test_components_of_a_chain_a_star_and_nothing(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    odd = [(7000, 7000), (None, 3), (59, 60), (60, 59)]
    df = spark.createDataFrame(chain + star + odd, "u long, v long")
    labels = {r.node: r.label for r in components(df).collect()}
    assert labels == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1050), 1000)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_documents_of_every_kind(spark):
    words = " ".join(f"w{i}" for i in range(300))
    rows = [
        (5, words, "x"),
        (3, words.replace("w7 ", "v7 "), "y"),
        (3, words.replace("w7 ", "v7 "), "z"),
        (9, "something else entirely here", None),
        (None, None, None),
        (2, "", "q"),
        (4, " ", "q"),
        (None, "alone in the world without id", "q"),
        (8, words * 40, "long"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(df, ["doc_id"]).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    prints = {r[0]: _plain_fingerprint(r[1]) for r in rows if r[0] is not None}
    pairs = [(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {k: r.component_id for k, r in by.items()} == _plain_components(prints, pairs)
    assert {k: int(r.fingerprint, 16) for k, r in by.items()} == prints
    assert by[4].component_id == 2
    assert by[2].fingerprint == "0" * 16 and by[4].fingerprint == "0" * 16
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["2", "None"]
    assert [r.is_first for r in got if r.doc_id == 3] == [True, True]
    assert sum(r.is_first for r in got if r.doc_id in (2, 4)) == 1
    empty = simhash.near_duplicates(df.limit(0), ["doc_id"])
    assert empty.columns[0] == "doc_id" and empty.count() == 0


def test_near_copies_by_similarity(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**8)}" for _ in range(n)]

    def shingles(words):
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    rows, pairs = [], []
    for i in range(120):
        words = fresh(300)
        copy = list(words)
        # Each changed word spoils five shingles: 0.8 is reached by up to six of them.
        for at in rng.sample(range(10, 290), rng.randrange(1, 7)):
            copy[at] = "changed"
        a, b = shingles(words), shingles(copy)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        if len(a & b) / len(a | b) >= 0.8:
            pairs.append(2 * i)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in simhash.near_duplicates(df, ["doc_id"], similar=simhash.Similar()).collect()}
    assert all(r.component_id in (r.doc_id, r.doc_id - r.doc_id % 2) for r in got.values())
    found = sum(got[i + 1].component_id == i for i in pairs)
    assert len(pairs) > 100 and found >= 0.99 * len(pairs)
    # Nothing links that is not that similar.
    assert sum(got[2 * i + 1].component_id == 2 * i for i in range(120)) <= len(pairs)
    kept = {r.doc_id for r in simhash.first_of_each(df.withColumn("fingerprint", df.doc_id), ["doc_id", "text"]).collect()}
    assert kept == {i for i, r in got.items() if r.is_first}


def test_pairs_below_the_limit_stay(spark):
    """Pairs of similarity 0.70 to 0.79 are no copies, those from 0.8 on are, and families are followed exactly."""
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**8)}" for _ in range(n)]
    texts = []
    for i in range(150):
        words = fresh(250)
        copy = list(words)
        for at in rng.sample(range(8, 240, 6), 2 + i % 8):
            copy[at] = "changed"
        texts += [words, copy]
    base = fresh(200)
    for _ in range(60):
        copy = list(base)
        for at in rng.sample(range(200), rng.randrange(0, 7)):
            copy[at] = f"x{rng.randrange(10**6)}"
        texts.append(copy)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, ["doc_id"], similar=simhash.Similar()).collect()}
    want = _plain_components(range(len(texts)), pairs)
    assert all(want[got[i]] == want[i] for i in want)
    assert sum(got[i] != want[i] for i in want) <= 2


def test_stars_are_components_already(spark, monkeypatch):
    from grootboek.llm import components as module

    def another_round(edges):
        raise AssertionError("nothing is left to join")

    monkeypatch.setattr(module, "_large_star", another_round)
    stars = spark.createDataFrame([(5, 1), (1, 7), (9, 8), (5, 1), (3, 3)], "u long, v long")
    assert {(r.node, r.label) for r in components(stars).collect()} == {(1, 1), (5, 1), (7, 1), (8, 8), (9, 8)}


def test_tiles_of_the_same_nodes_give_the_same_links():
    from grootboek.llm import simhash

    nodes, fps = [40, 7, 30, 12, 99], [0b0011, 0b0111, 0b0001, 0b1111, -1]
    found = set()
    for order in ([0, 1, 2, 3, 4], [3, 4, 2, 1, 0], [1, 3, 0, 2, 4]):
        u, v = simhash._compare([[nodes[i] for i in order]], [None], [[fps[i] for i in order]], 4, "bigint")
        found |= set(zip(u, v, strict=True))
    assert found == {(40, 7), (30, 7), (12, 7)}
