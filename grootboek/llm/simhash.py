"""SimHash near-duplicates: tiles of fingerprints are compared exactly by exclusive-or and bit counts, and tile pairs
whose population counts differ by more than the radius are skipped."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grootboek.llm import super_minhash
from grootboek.llm.common import explode_texts, map_texts, small, stored
from grootboek.llm.components import components
from grootboek.llm.words import mixed

#: Words to a shingle, seed of the hash and differing bits that still link. Fixed values of the near-duplicate query.
SHINGLE, SEED, RADIUS = 4, 42, 4
BITS = 64
#: Rows of a tile that are compared with the other tile at a time.
STRIP = 256


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles, as a signed number of 64 bits; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = [0, *(gaps[: len(gaps) - shingle + 1] + 1).tolist()]
        ends = [*gaps[shingle - 1 :].tolist(), len(joined)]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and the fingerprint ``fp`` (long) of each whole text."""
    return map_texts(documents, keep, text, "fp long", lambda: lambda texts: [[fingerprint(t) for t in texts]])


def masks(radius: int, blocks: int) -> list[int]:
    """Masks of which every pair within the radius agrees on at least one.

    The bits form ``blocks`` blocks. Differing bits spoil at most ``radius`` of them, so some ``blocks - radius`` blocks
    are equal. More blocks make longer keys, thus smaller groups, but more of them.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(chosen)) for chosen in combinations(parts, blocks - radius)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of ``n`` numbers by the links (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(values: np.ndarray, second: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints, as two lists of their places: never more links than
    fingerprints. ``values`` has a row of 64-bit words for each. With ``second``, which says of each fingerprint whether
    it is of the second tile, only links between the tiles count.

    Fingerprints are put in order of population count; strips whose counts differ by more than the radius are not
    compared.
    """
    counts = np.bitwise_count(values).sum(axis=1, dtype=np.int32)
    order = np.argsort(counts, kind="stable")
    values, counts = values[order], counts[order]
    sides = None if second is None else second[order]
    label, strip = np.arange(len(values)), max(1, STRIP // values.shape[1])
    for at in range(0, len(values), strip):
        end = min(at + strip, len(values))
        last = np.searchsorted(counts, counts[end - 1] + radius, side="right")
        apart = np.zeros((end - at, last - at), np.int16)
        for word in values.T:
            apart += np.bitwise_count(word[at:end, None] ^ word[None, at:last])
        a, b = np.nonzero(apart <= radius)
        keep = a < b
        if sides is not None:
            keep &= sides[at + a] != sides[at + b]
        a, b = a[keep] + at, b[keep] + at
        if len(a):
            known = np.flatnonzero(label != np.arange(len(label)))
            label = _forest(len(label), np.concatenate([known, a]), np.concatenate([label[known], b]))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return order[moved], order[label[moved]]


def linked(distinct: DataFrame, radius: int = RADIUS, blocks: int = 5, tile: int = 2048) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` (long) that make the same components as all pairs within the
    radius: fingerprints are compared that agree on one of the ``masks``, which misses no pair."""
    by_mask = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius, blocks)]))
    rows = distinct.select(F.col("fp").alias("node"), "fp", by_mask.alias("band", "value"))
    return compared(rows.withColumn("pop", F.bit_count("fp")), radius, BITS, tile)


def compared(rows: DataFrame, radius: int, bits: int, tile: int = 2048) -> DataFrame:
    """Links (u, v) between nodes with fingerprints within the radius, among the rows (band, value, node, fp, pop) that
    agree on band and value. They make the same components as all such pairs.

    A group of at most ``tile`` rows is one tile. A larger one is cut into tiles by population count and hash, and
    every two of its tiles whose counts can be within the radius are compared in a group of their own, so no task gets
    more than two tiles at once.
    """
    rows = rows.withColumn("pop", F.floor(F.col("pop") / (radius + 1)).cast("int"))
    sizes = rows.groupBy("band", "value", "pop").agg(F.count("*").alias("n"))
    tiles_of = F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / tile).cast("int").alias("n"))))
    large = (
        sizes.groupBy("band", "value")
        .agg(F.sum("n").alias("n"), tiles_of.alias("tiles"))
        .filter(F.col("n") > tile)
        .select("band", "value", "tiles")
    )
    rows = rows.join(large, ["band", "value"], "left")
    kind = rows.schema["fp"].dataType.simpleString()
    small_groups = (
        rows.filter("tiles is null")
        .groupBy("band", "value")
        .agg(F.collect_list(F.struct("node", "fp")).alias("of"))
        .filter(F.size("of") > 1)
        .select("of.node", "of.fp", F.lit(None).cast("array<boolean>").alias("second"))
    )
    return explode_texts(
        small_groups.unionByName(_tile_pairs(rows.filter("tiles is not null"), bits // (radius + 1))),
        ["node", "second", "fp"],
        "u long, v long",
        lambda: lambda columns: _compare(*columns, radius, kind),
    )


def _tile_pairs(rows: DataFrame, highest: int) -> DataFrame:
    """Both tiles of every pair to compare. A tile is (class of population counts, number). Counts within the radius are
    of one class or of neighbouring ones."""
    own = F.pmod(F.xxhash64("node"), F.col("tiles")[F.col("pop")]).cast("int")
    near = F.flatten(
        F.transform(
            F.sequence(F.greatest(F.lit(0), F.col("pop") - 1), F.least(F.lit(highest), F.col("pop") + 1)),
            lambda p: F.transform(
                F.when(F.col("tiles")[p].isNull(), F.array().cast("array<int>")).otherwise(
                    F.sequence(F.lit(0), F.col("tiles")[p] - 1)
                ),
                lambda i: F.struct(p.alias("pop"), i.alias("tile")),
            ),
        )
    )
    placed = rows.withColumn("mine", F.struct("pop", own.alias("tile"))).withColumn("other", F.explode(near))
    first, last = F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")
    second = F.when(F.col("mine") != F.col("other"), F.col("mine") > F.col("other"))
    return (
        placed.select("band", "value", first, last, F.struct(second.alias("second"), "node", "fp").alias("row"))
        .groupBy("band", "value", "low", "high")
        .agg(F.collect_list("row").alias("of"))
        .select("of.node", "of.fp", F.when(F.col("low") != F.col("high"), F.col("of.second")).alias("second"))
    )


def _compare(nodes: list, seconds: list, fps: list, radius: int, kind: str) -> list:
    """Links from each node to the smallest one that it is joined with in a tile: tiles with the same nodes, as those of
    near copies are in many bands, then give the same links."""
    ends: list[list] = [[], []]
    for node, second, fp in zip(nodes, seconds, fps, strict=True):
        if kind == "binary":
            values = np.frombuffer(b"".join(fp), np.uint64).reshape(len(fp), -1)
        else:
            values = np.array(fp, np.int64).view(np.uint64)[:, None]
        moved, root = links(values, None if second is None else np.array(second, bool), radius)
        centres, ids = np.unique(root), np.array(node, np.int64)
        own, of = ids[np.concatenate([moved, centres])], np.concatenate([root, centres])
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, of, own)
        end = least[of]
        ends[0] += own[own != end].tolist()
        ends[1] += end[own != end].tolist()
    return ends


@dataclass(frozen=True)
class Similar:
    """Near copies by similarity: SimHashes of ``words`` times 64 bits over different shingles of ``shingle`` words find
    candidates, whose sets of shingles are then compared as a whole: they link at ``percent`` of their union.

    Two sets with the Jaccard similarity s differ in a share acos(2 s / (1 + s)) / pi of the bits: 68 of 448 for s = 0.8,
    with a deviation of 8, so ``radius`` is four of those further out. No part of the bits need agree at that distance,
    so fingerprints are compared when one of ``bands`` choices of ``band_bits`` bits agrees; at s = 0.8 that misses about
    one pair in a thousand, and copies of copies are reached over each other. ``bands`` may take bits several times: the
    first ones take each bit once, in order, the next ones in another order.
    """

    words: int = 7
    shingle: int = 5
    radius: int = 100
    bands: int = 64
    band_bits: int = 13
    percent: int = 80

    def band_places(self) -> np.ndarray:
        """The bits of each band, a row each."""
        bits, each = self.words * BITS, self.words * BITS // self.band_bits
        orders = [np.arange(bits) if i == 0 else np.random.default_rng(i).permutation(bits) for i in range(-(-self.bands // each))]
        return np.concatenate([o[: each * self.band_bits].reshape(each, -1) for o in orders])[: self.bands]


def long_fingerprint(base: np.ndarray, rule: Similar) -> bytes:
    """The SimHash of a set of shingles, given by their hashes; zeros for an empty one."""
    if not len(base):
        return bytes(8 * rule.words)
    counts = np.zeros(rule.words * BITS, np.int64)
    for at in range(0, len(base), 1 << 12):
        part = base[at : at + (1 << 12), None] + (np.arange(rule.words, dtype=np.uint64) << np.uint64(40))
        bits = np.unpackbits(mixed(part).view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(base), bitorder="little").tobytes()


def _bands(nodes: DataFrame, rule: Similar) -> DataFrame:
    def start():
        weights, places = 1 << np.arange(rule.band_bits), rule.band_places()

        def work(columns):
            ids, fps = columns
            raw = np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1)
            bits = np.unpackbits(raw, axis=1, bitorder="little")
            values = (bits[:, places] @ weights).ravel()
            pops = np.repeat(np.bitwise_count(raw).sum(axis=1), rule.bands)
            again = np.repeat(np.arange(len(fps)), rule.bands).tolist()
            bands = np.tile(np.arange(rule.bands), len(fps))
            return [bands, values, [ids[i] for i in again], [fps[i] for i in again], pops.astype(np.int32)]

        return work

    return explode_texts(nodes, ["node", "fp"], "band int, value int, node long, fp binary, pop int", start)


def near_duplicates(
    documents: DataFrame, keep: list[str], radius: int = RADIUS, blocks: int = 5, similar: Similar | None = None
) -> DataFrame:
    """The ``keep`` columns, which hold ``doc_id``, and of each row its ``fingerprint`` (hexadecimal digits), the
    ``component_id`` (smallest doc_id that links of at most ``radius`` differing bits reach, its own included) and
    ``is_first``, true for the rows of that document. With ``similar``, links are as that says, and the fingerprint is
    that of the whole set of shingles: equal sets have it alike.

    Texts without words have the fingerprint 0 and link like others. Rows with the same doc_id are documents of their
    own; equal fingerprints are one node however many rows have them. A null doc_id counts as the largest, so a
    component has a null id only if it has no other. Only keys, fingerprints and ids are shuffled, never texts, when
    ``keep`` holds no text.
    """
    if similar:
        rows = map_texts(documents, keep, "text", "fp long, bits binary", lambda: lambda texts: _keyed(texts, similar))
        rows = stored(rows, "fingerprints")
        firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("bits").alias("bits"))
        bands = _bands(firsts.select(F.col("fp").alias("node"), F.col("bits").alias("fp")), similar)
        near = stored(compared(bands, similar.radius, similar.words * BITS), "near")
        rule = super_minhash.Rule(shingle=similar.shingle, percent=similar.percent)
        edges = super_minhash.links(documents, rows.withColumnRenamed("fp", "node"), rule, near)
    else:
        rows = stored(fingerprints(documents, keep), "fingerprints")
        firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
        edges = linked(firsts.select("fp"), radius, blocks)
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
    nodes = components(stored(edges, "links"))
    labelled = nodes.withColumnRenamed("node", "fp").join(firsts, "fp")
    # A null id must not win, and of rows with one id the smallest fingerprint does.
    smallest = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp"))
    best = labelled.groupBy("label").agg(smallest.alias("best"))
    of_linked = labelled.join(best, "label").select(
        "fp", F.col("best.first").alias("component_id"), F.col("best.fp").alias("best_fp")
    )
    of_each = firsts.join(of_linked, "fp", "left").select(
        "fp",
        F.coalesce("component_id", "first").alias("component_id"),
        F.coalesce("best_fp", "fp").alias("best_fp"),
    )
    # Stored, so that the join below reads two plain sides and a very common fingerprint can be split.
    of_each = stored(of_each, "components")
    return rows.join(of_each, "fp").select(
        *keep,
        shown.alias("fingerprint"),
        "component_id",
        (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("best_fp"))).alias("is_first"),
    )


def _keyed(texts: list, rule: Similar) -> list[list]:
    """Of each text the key of its set of shingles, and its fingerprint."""
    sets = super_minhash.shingle_sets(texts, rule.shingle)
    return [[super_minhash.set_key(s) for s in sets], [long_fingerprint(s, rule) for s in sets]]


def _set_keys(texts: list, rule: Similar) -> list[int]:
    return [super_minhash.set_key(s) for s in super_minhash.shingle_sets(texts, rule.shingle)]


def first_of_each(documents: DataFrame, keep: list[str], similar: Similar = Similar()) -> DataFrame:
    """The ``keep`` columns, which hold ``doc_id`` and ``text``, of one row for each group of near copies by similarity:
    the row of the smallest doc_id, and one of them where several rows have that id and fingerprint.

    Which rows go is decided on ids and fingerprints. The texts stay where they are if the ids to drop are few enough
    to be sent to every task, and are joined by id otherwise. Only rows with a repeated id are fingerprinted again.
    """
    rows = stored(near_duplicates(documents, ["doc_id"], similar=similar), "groups")
    by_id = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.max("is_first").alias("first"), F.count("*").alias("n"))
    special = stored(by_id.filter("not first or n > 1").select("_id", "first"), "special")
    same_id = F.col("doc_id").eqNullSafe(F.col("_id"))
    some = documents.select(*keep)
    once = some.join(small(special, special.count()), same_id, "left_anti")
    several = special.filter("first").select("_id")
    again = map_texts(
        some.join(small(several, several.count()), same_id, "left_semi"),
        keep,
        "text",
        "fingerprint string",
        lambda: lambda texts: [[f"{key % (1 << BITS):016x}" for key in _set_keys(texts, similar)]],
    )
    firsts = rows.filter("is_first").select(F.col("doc_id").alias("_id"), F.col("fingerprint").alias("_fp")).distinct()
    kept = again.join(firsts, same_id & (F.col("fingerprint") == F.col("_fp")), "left_semi")
    return once.unionByName(kept.dropDuplicates(["doc_id", "fingerprint"]).select(*keep))
