import re

import pytest

from grootboek.llm import licenses


@pytest.mark.parametrize(
    ("expression", "names", "free"),
    [
        ("mit", ["mit"], 1.0),
        ("mit or gpl-3.0-only", ["gpl-3.0-only", "mit"], 1.0),
        ("mit and gpl-3.0-only", ["gpl-3.0-only", "mit"], 0.25),
        ("gpl-2.0-only with classpath-exception-2.0", ["gpl-2.0-only"], 0.5),
        ("gpl-2.0-only with classpath-exception-2.0 and mit", ["gpl-2.0-only", "mit"], 0.5),
        ("mit or gpl-2.0 and nonsense", ["gpl-2.0", "mit", "nonsense"], 1.0),
        ("(mit or gpl-2.0) and mpl-2.0", ["gpl-2.0", "mit", "mpl-2.0"], 0.5),
        ("((bsd-3-clause))", ["bsd-3-clause"], 1.0),
        ("apache-2.0 */", ["apache-2.0"], 1.0),
        ("apache-2.0 -->", ["apache-2.0"], 1.0),
    ],
)
def test_expressions(expression, names, free):
    assert licenses.parse(expression) == (names, free)


@pytest.mark.parametrize("expression", ["", "and", "mit or", "(mit", "mit with (x)", "or mit", "()"])
def test_no_expressions(expression):
    assert licenses.parse(expression) is None


def test_rows_of_every_kind(spark):
    texts = [
        None,
        "",
        "!!! ???",
        "CC BY cc-by cc_by; All Rights, Reserved",
        "GNU Lesser General Public License\nSPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nend",
        "cc by cc by",
        "SPDX-License-Identifier: MIT AND\nSPDX License Identifier without colon",
        "É ß word " * 60_000 + "all rights reserved",
    ]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "y"), (None, "mit license", "z")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string"), ["doc_id"]).collect()
    assert len(got) == len(rows)
    for (i, text, _), r in zip(rows, got, strict=True):
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = {
            p: [k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()] for p in licenses.BASE
        }
        flat = [k for v in places.values() for k in v]
        expected = (i, len(words), len(flat), min(flat, default=None), max(flat, default=None))
        assert tuple(r)[:5] == expected
        assert r.base_labels == ",".join(sorted({licenses.BASE[p] for p, v in places.items() if v}))
        assert 0 <= r.score <= 1
    assert got[4].labels == "gpl,lgpl,spdx:apache-2.0,spdx:gpl-2.0-only,spdx:mit"
    assert got[4].score == 0.25 and got[4].expression == "(mit or gpl-2.0-only) and apache-2.0"
    assert got[6].labels == "spdx:unreadable" and got[6].score == 0
    assert got[-1].labels == "mit" and got[-1].score == 1
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0
