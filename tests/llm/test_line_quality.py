import itertools
import random
import re

import numpy as np

from grootboek.llm import line_quality as lq


def _plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    repeated = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            repeated.update(range(i, i + 8))
    n = len(words)
    failed = n < 20 or 100 * len(repeated) > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(repeated), failed


def _zero():
    return lq.LineField(np.zeros((lq.N_FEATURES, 2)), np.zeros((2, 2)))


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7):
        field = lq.LineField(rng.normal(size=(lq.N_FEATURES, 2)), rng.normal(size=(2, 2)))
        features = np.stack([rng.integers(a, b, n) for a, b in zip(lq._OFFSETS, lq._OFFSETS[1:])], axis=1)
        emission = field.emission[features].sum(axis=1)

        def score(path, emission=emission, field=field):
            steps = sum(field.transition[a, b] for a, b in itertools.pairwise(path))
            return sum(emission[i, s] for i, s in enumerate(path)) + steps

        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert field.content(features).tolist() == [s == lq.CONTENT for s in best]


def test_base_rule_and_rows_of_every_kind(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t\n ", "a b c", "é#*$%&|<> w\n" * 4, "word " * 30_000, "x " * 19, "x y " * 10]
    texts += [" ".join(rng.choices("abc", k=rng.randrange(40))) for _ in range(60)]
    texts += ["\n".join(rng.choices(["a b", "c d e", "", " "], k=12)) for _ in range(20)]
    texts.append(" ".join(f"w{i % 40}" for i in range(100)))
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(3, texts[3], False), (None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept boolean")
    got = lq.judge(df, ["doc_id"], _zero()).collect()
    for (i, text, _), r in zip(rows, got, strict=True):
        if len(text or "") < 10_000:
            assert (r.doc_id, *tuple(r)[1:7]) == (i, *_plain(text))
        assert r.kept == (not r.base_failed)
    assert lq.judge(df.limit(0), ["doc_id"], _zero()).count() == 0


def test_fitted_field_tells_lines_apart(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    good = lambda: " ".join(word() for _ in range(rng.randrange(12, 40))) + "."
    bad = lambda: " ".join(rng.choice(["%%% ", "$$$", "###"]) + word().upper() for _ in range(20))
    rows, labels = [], []
    for i in range(300):
        ok = rng.random() < 0.6
        rows.append((i, "\n".join((good if ok else bad)() for _ in range(rng.randrange(1, 6)))))
        labels.append((i, int(ok), 0))
    rows.append((900, good() + "\n" + bad() + "\n" + good() + "\n" + good()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    field = lq.fit(df, known, train_docs=150)
    kept = {r.doc_id: r for r in lq.judge(df, ["doc_id"], field).collect()}
    right = sum(kept[i].kept == bool(q) for i, q, _ in labels[200:])
    assert right >= 98
    assert kept[900].kept
    none = lq.fit(df, known.limit(0))
    assert not none.emission.any() and not none.transition.any()


def test_a_repeated_id_gives_one_row_to_the_sample(spark, monkeypatch):
    rows = [(i, f"line {i} of good text.\nmore of it here.") for i in range(5)] + [(9, f"| menu | {i} |\n" * (i + 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([*((i, 1) for i in range(5)), (9, 0)], "doc_id long, quality int")
    sizes = []
    whole = lq._maximise
    monkeypatch.setattr(lq, "_maximise", lambda chains, *rest: (sizes.append(len(chains)), whole(chains, *rest))[1])
    lq.fit(df, known, rounds=2)
    assert sizes == [6]
