"""Best-fit packing planned on a histogram of lengths: best fit runs over counts, and pieces take the planned slots by
joining on their rank within their length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grootboek.llm.common import explode_texts, stored
from grootboek.llm.tokens import byte_tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long"
#: Numbers that pieces of one length are spread over before they are grouped for ranking.
SPREAD = 1 << 20
PLAN = "length long, first long, last long, sequence long, step long, per_sequence long, offset long"


def cut(n: int, size: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: whole ones of ``size``, after a shorter first one where it does not divide."""
    short = n % size
    return [short] * (short > 0) + [size] * (n // size)


def pieces(documents: DataFrame, tokenizer: str, size: int, end: int) -> DataFrame:
    """The pieces of every document's ids, ``end`` after the last one.

    ``part`` spreads pieces of one length over many groups for ranking, also those of equal rows or of one long text: it
    comes from the row and a running number in the task. The result must be stored before it is used twice.
    """
    source = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("part"))

    def start():
        tokens = byte_tokens(tokenizer)
        last = np.array([end], "<u4")
        number = count()

        def work(columns):
            rows = []
            for doc, text, part in zip(*columns, strict=True):
                ids = np.concatenate([tokens.encode(text), last]) if text else last
                at = 0
                for k, length in enumerate(cut(len(ids), size)):
                    spread = zlib.crc32(f"{part} {next(number)}".encode()) % SPREAD
                    rows.append((doc, k, at, length, zlib.crc32(ids[at : at + length].tobytes()), spread))
                    at += length
            return list(zip(*rows, strict=True))

        return work

    return explode_texts(source, ["doc_id", "text", "part"], PIECES, start)


class _Open:
    """Sequences with room, as runs of consecutive numbers, by how much room they have."""

    def __init__(self):
        self.runs: dict[int, deque[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def put(self, room: int, first: int, count: int) -> None:
        if room <= 0 or count <= 0:
            return
        if room not in self.runs:
            self.runs[room] = deque()
            insort(self.rooms, room)
        self.runs[room].append((first, count))

    def tightest(self, length: int) -> int | None:
        at = bisect_left(self.rooms, length)
        return self.rooms[at] if at < len(self.rooms) else None

    def take(self, room: int, most: int) -> tuple[int, int]:
        """The first run with this room, or as much of it as asked for."""
        first, count = self.runs[room].popleft()
        if count > most:
            self.runs[room].appendleft((first + most, count - most))
            count = most
        if not self.runs[room]:
            del self.runs[room]
            self.rooms.remove(room)
        return first, count


def plan(counts: Iterable[tuple[int, int]], size: int) -> list[tuple]:
    """Best-fit decreasing over a histogram of (length, count), in runs of equal moves.

    A row (length, first, last, sequence, step, per_sequence, offset) says: pieces of ``length`` with the ranks
    ``first`` to ``last`` go to sequences from number ``sequence`` on, ``per_sequence`` to each, from ``offset`` on.
    Every length in turn, longest first, goes where it leaves the least room. The work and the plan depend on the
    lengths that occur, at most ``size``, not on how many pieces there are.
    """
    rows, open_, next_sequence = [], _Open(), 0
    for length, count in sorted(counts, reverse=True):
        rank = 0
        while count:
            room = open_.tightest(length)
            if room is None:
                fit = size // length
                n, room, first = max(1, count // fit), size, next_sequence
                fit = min(fit, count)
                next_sequence += n
            else:
                fit = min(room // length, count)
                first, n = open_.take(room, max(1, count // fit))
            rows.append((length, rank, rank + n * fit - 1, first, 1, fit, size - room))
            open_.put(room - fit * length, first, n)
            rank += n * fit
            count -= n * fit
    return rows


def pack(
    documents: DataFrame, tokenizer: str, size: int = 1024, end: int = 2, group: int = 4096
) -> DataFrame:
    """Every piece of every document and its place: ``sequence_id`` and ``offset``, gapless from 0 in each sequence.

    Longer documents than ``size`` ids are cut; their first piece may be shorter. A null or empty text is the id
    ``end`` alone. Repeated rows are packed each for itself; null ids make pieces like any other; other columns are
    ignored. An empty table has no pieces.

    Only the histogram (at most ``size`` rows) goes to the driver, and only the plan, whose size depends on it alone,
    is sent to every task. Pieces are ranked in groups of about ``group`` rows of one length, so that no length, however
    common, is ranked in one task.
    """
    spark = documents.sparkSession
    cut_pieces = stored(pieces(documents, tokenizer, size, end), "pieces")
    histogram = [(r.length, r.n) for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()]
    planned = spark.createDataFrame(plan(histogram, size), PLAN)
    sizes = F.broadcast(
        spark.createDataFrame([(length, max(1, n // group)) for length, n in histogram], "length long, groups long")
    )
    grouped = cut_pieces.join(sizes, "length").withColumn("part", F.pmod("part", "groups")).drop("groups")
    of_length = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        grouped.groupBy("length", "part")
        .agg(F.count("*").alias("n"))
        .select("length", "part", F.coalesce(F.sum("n").over(of_length), F.lit(0)).alias("before"))
    )
    in_part = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = grouped.withColumn("place", F.row_number().over(in_part)).join(before, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place") - 1).drop("before", "place", "part")
    slots = F.broadcast(planned.withColumnRenamed("length", "slot_length"))
    nth = F.col("rank") - F.col("first")
    return ranked.join(
        slots, (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("first"), F.col("last"))
    ).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("offset") + F.pmod(nth, F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
    )
