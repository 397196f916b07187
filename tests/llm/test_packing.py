import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from grootboek.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _best_fit(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(size - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_rank_once_and_gapless(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 64, 1024])
    counts = Counter({rng.randint(1, size): rng.randint(1, rng.choice([3, 60])) for _ in range(rng.randint(1, 50))})
    used, ranks = defaultdict(list), defaultdict(list)
    for length, first, last, sequence, _, per, offset in packing.plan(counts.items(), size):
        for k in range(last - first + 1):
            used[sequence + k // per].append((offset + k % per * length, length))
            ranks[length].append(first + k)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    plain = _best_fit(list(counts.elements()), size)
    assert len(used) <= plain + max(1, plain // 50)


def test_rows_of_every_kind(spark):
    rng = random.Random(1)
    texts = ["some words " * rng.randrange(60) for _ in range(200)] + [None, "", "long text here " * 3000, "x " * 1024]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "y"), (None, "no id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(5)
    got = packing.pack(df, PATH, group=16).collect()
    library = Tokenizer.from_file(PATH)
    expected = []
    for i, text, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, n in enumerate(packing.cut(len(ids), 1024)):
            expected.append((i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
        assert at == len(ids)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(expected, key=repr)
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        ends = [a + n for a, n in sorted(places)]
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(used) <= _best_fit([e[3] for e in expected], 1024) + 1
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_pieces_of_equal_rows_and_of_one_text_are_spread(spark):
    rows = [(1, "the same row")] * 3000 + [(2, "long text here " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    parts = packing.pieces(df, PATH, 1024, 2).selectExpr("doc_id", "part % 16 p").groupBy("doc_id", "p").count().collect()
    for doc in (1, 2):
        counts = [r["count"] for r in parts if r.doc_id == doc]
        assert len(counts) == 16 and max(counts) < 2 * sum(counts) / 16
    got = packing.pack(df, PATH, group=64).select("doc_id", "sequence_id", "offset", "length").collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) == sum(r["count"] for r in parts)
