"""WARC archives: writing them, with revisits, segments and chunked framing, and reading them back with segments
reassembled."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grootboek.llm.common import explode_texts, scratch, stored
from grootboek.skew import lookup

VERSION = "WARC/1.1"
END = "\r\n"
#: An HTTP body is sent in chunks of about so many characters.
CHUNK = 4096

PARTS = (
    "record_id string, origin_id string, segment int, total long, type string, target string, digest string, "
    "refers_to string, block binary"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: str, size: int = CHUNK) -> str:
    """Chunked transfer framing. Chunks end between characters, so that a record stays valid text."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out.append(f"{len(part.encode()):x}{END}{part}{END}")
    return "".join(out) + f"0{END}{END}"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body. Raises ValueError when the framing is broken or ends early."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def _record(kind: str, record_id: str, block: str, more: dict[str, object]) -> str:
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": "2000-01-01T00:00:00Z", **more}
    head = "".join(f"{k}: {v}{END}" for k, v in fields.items() if v is not None)
    return f"{VERSION}{END}{head}Content-Length: {len(block.encode())}{END}{END}{block}"


def _clean(value: str | None) -> str | None:
    """A header value must stay on its line."""
    return None if value is None else re.sub(r"[\r\n]+", " ", value).strip()


def _records(page: object, url: str | None, html: str | None, first: object, digest: str, segment: int) -> list[str]:
    payload = html or ""
    http = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Transfer-Encoding: chunked{END}{END}"
    origin = uuid.uuid4().urn
    about = {
        "WARC-Target-URI": _clean(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Page-ID": page,
        "Content-Type": "application/http; msgtype=response",
    }
    if first is not None:
        about |= {"WARC-Refers-To-Page-ID": first, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        return [_record("revisit", origin, http, about)]
    block = http + chunked(payload)
    blocks = [block[at : at + segment] for at in range(0, len(block), segment)]
    if len(blocks) == 1:
        return [_record("response", origin, block, about)]
    out = [_record("response", origin, blocks[0], about | {"WARC-Segment-Number": 1})]
    for k, part in enumerate(blocks[1:], 2):
        more = {"WARC-Segment-Origin-ID": f"<{origin}>", "WARC-Segment-Number": k}
        if k == len(blocks):
            more["WARC-Segment-Total-Length"] = len(block.encode())
        out.append(_record("continuation", uuid.uuid4().urn, part, more))
    return out


def write(pages: DataFrame, path: str, min_bytes: int = 0, segment: int = 32_768, records_per_file: int = 1024) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html; null html: empty payload) into gzipped WARC files.

    Of rows with equal payloads of at least ``min_bytes``, those with the smallest page_id are responses and the others
    revisits that hold no payload. A null page_id counts as the largest; smaller payloads are all responses. Repeated
    rows are written each for itself. Pages meet the first of their payload by ``lookup``, so one that a third of them
    have can be split over tasks. Blocks longer than ``segment`` characters go on in continuation records.
    """
    text = F.coalesce("html", F.lit(""))
    keyed = pages.select(
        F.col("page_id").cast("string").alias("page"),
        F.col("page_id").alias("id"),
        "url",
        "html",
        F.when(F.octet_length(text) >= min_bytes, F.sha1(text.cast("binary"))).alias("same"),
    )
    firsts = keyed.filter("same is not null").groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    several = firsts.filter("n > 1 and first is not null").select("same", "first")
    joined = lookup(keyed, several, "same", ["page", "url"]).select(
        "page",
        "url",
        F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string")).alias("first"),
        "html",
    )

    def start():
        def work(columns):
            out = []
            for page, url, first, html in zip(*columns, strict=True):
                digest = payload_digest((html or "").encode())
                # A record ends with two line ends; the writer adds the second one.
                out += [r + END for r in _records(page, url, html, first, digest, segment)]
            return [out]

        return work

    lines = explode_texts(joined, ["page", "url", "first", "html"], "value string", start)
    writer = lines.write.option("compression", "gzip").option("lineSep", END)
    writer.option("maxRecordsPerFile", records_per_file).text(path)


def _parse(content: bytes) -> list[tuple]:
    """The records of one archive file."""
    out, at = [], 0
    while (at := _skip(content, at)) < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split(END)
        if not version.startswith("WARC/"):
            raise ValueError("no record where one should start")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = content[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError("record is cut short")
        total = fields.get("warc-segment-total-length")
        out.append(
            (
                fields["warc-record-id"],
                fields.get("warc-segment-origin-id", fields["warc-record-id"]),
                int(fields.get("warc-segment-number", 0)),
                None if total is None else int(total),
                fields["warc-type"],
                fields.get("warc-page-id"),
                fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                fields.get("warc-refers-to-page-id"),
                block,
            )
        )
        at = end + 4 + size
    return out


def _skip(content: bytes, at: int) -> int:
    while content[at : at + 2] == b"\r\n":
        at += 2
    return at


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``, whole: page (text of the page id), type, digest, refers_to, payload
    (null for revisits) and error.

    Continuation records are grouped by the record they go on from and put in order of their numbers. ``error`` says why
    a payload could not be restored: segments missing, a total length or digest that does not match, broken framing. A
    file is read by one task, so ``write`` bounds the records of a file; records too long for that are what segments
    are for.
    """

    def start():
        import gzip

        def work(columns):
            rows = [row for (content,) in zip(*columns, strict=True) for row in _parse(gzip.decompress(content))]
            return [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(9)]

        return work

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path)
    records = explode_texts(files, ["content"], PARTS, start)
    single = records.filter("segment = 0").select(
        "type", "target", "digest", "refers_to", "block", F.lit(None).cast("string").alias("broken")
    )
    ordered = F.array_sort(F.collect_list(F.struct("segment", "total", "type", "target", "digest", "block")))
    joined = records.filter("segment > 0").groupBy("origin_id").agg(ordered.alias("s"))
    whole = F.aggregate("s", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["block"]))
    last = F.element_at("s", -1)
    several = joined.select(
        F.col("s")[0]["type"].alias("type"),
        F.col("s")[0]["target"].alias("target"),
        F.col("s")[0]["digest"].alias("digest"),
        F.lit(None).cast("string").alias("refers_to"),
        whole.alias("block"),
        F.when((F.col("s")[0]["segment"] != 1) | (last["segment"] != F.size("s")), "segments missing")
        .when(~last["total"].eqNullSafe(F.octet_length(whole).cast("long")), "total length")
        .alias("broken"),
    )

    def finish():
        def one(kind, digest, block, broken):
            if broken or kind == "revisit":
                return None, broken
            try:
                head, _, body = block.partition(b"\r\n\r\n")
                payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            except ValueError as error:
                return None, str(error)
            return (payload, None) if payload_digest(payload) == digest else (None, "digest")

        def work(columns):
            kinds, targets, digests, refers, blocks, broken = columns
            made = [one(*x) for x in zip(kinds, digests, blocks, broken, strict=True)]
            return [targets, kinds, digests, refers, [m[0] for m in made], [m[1] for m in made]]

        return work

    columns = ["type", "target", "digest", "refers_to", "block", "broken"]
    fields = "page string, type string, digest string, refers_to string, payload binary, error string"
    return explode_texts(single.unionByName(several), columns, fields, finish)


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back: page_id, payload_bytes, payload_digest,
    record_type and refers_to, one row per row of ``pages``. A revisit has the length of the payload that it refers to.
    """
    path = scratch(pages.sparkSession, "warc")
    write(pages, path)
    # Stored without payloads: it is used twice, and the archives are unzipped and parsed once.
    found = stored(
        read(pages.sparkSession, path).select(
            F.col("page").cast("long").alias("page_id"),
            F.octet_length("payload").cast("long").alias("own_bytes"),
            F.col("digest").alias("payload_digest"),
            F.col("type").alias("record_type"),
            F.col("refers_to").cast("long").alias("refers_to"),
        ),
        "records",
    )
    sizes = (
        found.filter("record_type = 'response' and page_id is not null")
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.max("own_bytes").alias("of_bytes"))
    )
    return lookup(found, sizes, ["refers_to", "payload_digest"], ["page_id", "payload_digest"]).select(
        "page_id",
        F.coalesce("own_bytes", "of_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )
