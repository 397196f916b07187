import gzip
from collections import defaultdict

import pytest

from grootboek.llm import warc
from grootboek.llm.common import scratch


def test_chunked_framing_round_trip_and_faults():
    for text in ["", "a", "é" * 5000, "0\r\n\r\n" * 900]:
        assert warc.dechunked(warc.chunked(text, 7).encode()) == text.encode()
    for broken in [b"", b"5\r\nabc", b"3\r\nabcX\r\n0\r\n\r\n", b"zz\r\n"]:
        with pytest.raises(ValueError):
            warc.dechunked(broken)


def test_rows_of_every_kind(spark):
    trap = "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"
    bodies = ["<p>a</p>", "", None, trap, "é😀" * 100_000, "<p>a</p>", trap, "only here\n\n\r\n"]
    rows = [(10 + i, f"http://x/{i}\r\nEvil: 1", b, 1) for i, b in enumerate(bodies)]
    rows += [(3, None, "<p>a</p>", 1), (None, "u", "<p>a</p>", 1), (17, "u", bodies[7], 1), (None, "u", "null id", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = warc.round_trip(df).collect()
    ids = defaultdict(list)
    for i, _, body, _ in rows:
        ids[body or ""] += [i] if i is not None else []
    expected = []
    for i, _, body, _ in rows:
        raw = (body or "").encode()
        first = min(ids[body or ""], default=None)
        again = first is not None and i != first
        kind = "revisit" if again else "response"
        expected.append((i, len(raw), warc.payload_digest(raw), kind, first if again else None))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_segments_are_put_together_across_files_and_checked(spark):
    body = "".join(f"line {i} é\n" for i in range(9000))
    df = spark.createDataFrame([(1, "u", body), (2, "u", "small")], "page_id long, url string, html string")
    path = scratch(spark, "warc-test")
    warc.write(df, path, segment=5000, records_per_file=3)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    assert len(files) > 5
    whole = b"".join(gzip.decompress(f.content) for f in files)
    assert whole.count(b"WARC-Type: continuation") > 10
    rows = {r.page: r for r in warc.read(spark, path).collect()}
    assert bytes(rows["1"].payload).decode() == body and rows["1"].error is None

    lost = spark.createDataFrame([(whole.replace(b"WARC-Segment-Number: 4", b"WARC-Segment-Number: 99"),)], "value binary")
    broken = scratch(spark, "warc-test")
    lost.selectExpr("decode(value, 'utf-8') as value").write.option("compression", "gzip").option("lineSep", "\r\n").text(broken)
    rows = {r.page: r for r in warc.read(spark, broken).collect()}
    assert rows["1"].payload is None and rows["1"].error == "segments missing"
    assert bytes(rows["2"].payload) == b"small"


def test_hot_payload_and_one_reading(spark, monkeypatch):
    rows = [(i, "u", ("hot " * 400) if i % 3 == 0 else f"page {i} " * 30) for i in range(6000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    reads, spread = [], []
    read, lookup = warc.read, warc.lookup
    monkeypatch.setattr(warc, "read", lambda *a: reads.append(a) or read(*a))
    monkeypatch.setattr(warc, "lookup", lambda facts, dim, *a: spread.append(dim.count()) or lookup(facts, dim, *a))
    result = warc.round_trip(df)
    got = result.collect()
    assert sum(r.record_type == "revisit" for r in got) == 1999
    assert {r.payload_bytes for r in got if r.page_id % 3 == 0} == {1600} and len(got) == 6000
    # Both joins that meet hot keys can be split; the payloads are read once and not again for the result.
    assert spread == [1, 4001] and len(reads) == 1
    assert not any("warc-" in name for name in result.inputFiles())
