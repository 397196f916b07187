"""Near copies by SuperMinHash: signatures of correlated permutation ranks, banding, verification on the full sets, and
grouping by union-find."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grootboek.llm.common import explode_texts, map_texts, small, stored
from grootboek.llm.components import components
from grootboek.llm.words import STEP, Runs, Words, mixed

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Rule:
    """Sets of ``shingle``-word shingles link when ``100 * intersection >= percent * union``.

    A signature has ``bands`` times ``rows`` values. Sets of similarity 0.8 agree in no band with a chance of
    (1 - 0.8 ** rows) ** bands: 5 in a million. A tile has about ``tile`` sets or ``elements`` shingles; ``hubs`` sets
    of a cluster of several tiles are compared with all of its tiles.
    """

    shingle: int = 4
    percent: int = 80
    bands: int = 40
    rows: int = 6
    tile: int = 1024
    elements: int = 1 << 20
    hubs: int = 32

    @property
    def size(self) -> int:
        return self.bands * self.rows


def shingle_sets(texts: list, shingle: int) -> list[np.ndarray]:
    """Of each text, its different shingles as sorted hashes; a shorter text is one shingle, one without words none."""
    words = Words.read(texts)
    ends = [*words.first[1:].tolist(), len(words.hashes)]
    made = []
    for a, b in zip(words.first.tolist(), ends, strict=True):
        size = min(shingle, b - a)
        made.append(np.unique(Runs(words.hashes[a:b]).hash(np.arange(b - a - size + 1), size)) if size else words.hashes[:0])
    return made


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """The SuperMinHash signatures of sets of hashes, a row each.

    Every element has a random permutation of the places of the signature, and in round j the element offers the place
    that is j-th in it the value j plus a fraction; a place keeps the least it is offered. Each element thus offers each
    place another rank, which is what lowers the variance. A place that has a value is not improved by a later round, so
    a set stops as soon as all its places have one: after a round or two where it has many elements. Permutations are
    shuffled as far as rounds get.

    A value is the round in the upper 32 bits and the fraction in the lower ones. A set without elements keeps the
    greatest value everywhere.
    """
    result = np.full((len(sets), size), _NONE)
    flat = result.reshape(-1)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate([*sets, np.empty(0, np.uint64)])
    order = None
    for j in range(size):
        drawn = mixed(elements + np.uint64(((j + 1) * STEP) & 0xFFFFFFFFFFFFFFFF))
        pick = (j + (((drawn & _LOW) * np.uint64(size - j)) >> np.uint64(32))).astype(np.int64)
        rows = np.arange(len(elements))
        place = pick if order is None else order[rows, pick].astype(np.int64)
        np.minimum.at(flat, of * size + place, (np.uint64(j) << np.uint64(32)) | (drawn >> np.uint64(32)))
        open_ = (result == _NONE).any(axis=1)
        alive = open_[of]
        if not alive.any():
            break
        if order is None:
            elements, of, pick = elements[alive], of[alive], pick[alive]
            order = np.tile(np.arange(size, dtype=np.uint16), (len(elements), 1))
            rows = np.arange(len(elements))
            order[rows, pick] = order[:, j]
        else:
            order[rows, pick] = order[:, j]
            if not alive.all():
                elements, of, order = elements[alive], of[alive], order[alive]
    return result


def _band_keys(signature: np.ndarray, rule: Rule) -> list[int]:
    raw, width = signature.tobytes(), 8 * rule.rows
    return [
        int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(raw[b * width : (b + 1) * width], b)).view(np.int64)))
        for b in range(rule.bands)
    ]


def set_key(elements: np.ndarray) -> int:
    """Equal sets, and no others, have the same key."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(elements.tobytes(), 13)).astype(np.int64))


def keyed(documents: DataFrame, keep: list[str], rule: Rule) -> DataFrame:
    """The ``keep`` columns, ``n_shingles`` and the ``node`` (key of the set) of each whole text; null without words."""

    def start():
        def work(texts):
            sets = shingle_sets(texts, rule.shingle)
            return [[len(s) for s in sets], [set_key(s) if len(s) else None for s in sets]]

        return work

    return map_texts(documents, keep, "text", "n_shingles long, node long", start)


def banded(documents: DataFrame, rule: Rule) -> DataFrame:
    """(node, key): the keys of all bands of every set that is not empty; a repeated set repeats in a task only if its
    rows are in different pieces."""

    def start():
        def work(columns):
            sets = {set_key(s): s for s in shingle_sets(columns[0], rule.shingle) if len(s)}
            keys = [_band_keys(row, rule) for row in signatures(list(sets.values()), rule.size)]
            return [np.repeat(np.array(list(sets), np.int64), rule.bands), np.array(keys, np.int64).reshape(-1)]

        return work

    return explode_texts(documents, ["text"], "node long, key long", start, piece_bytes=1 << 20)


def candidates(bands: DataFrame) -> DataFrame:
    """(u, v): every set that shares a band with others, with the first of those; connected as all of them are."""
    each = bands.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("most")).filter("v <> most")
    return bands.join(each.select("key", "v"), "key").select(F.col("node").alias("u"), "v").filter("u <> v").distinct()


# Verification.


def linked(sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, by their whole intersections. ``sides`` marks, of each set, whether it
    is of the first or second kind (1, 2) or of both (3); only pairs of a first and a second one are compared.

    Intersections of all pairs are products of the matrix of sets and shingles, taken over a slice of the shingles at a
    time; shingles of one set alone cannot meet and are left out.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    every, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    of = np.repeat(np.arange(n), size)[shared[column]]
    column = number[column[shared[column]]]
    by_column = np.argsort(column, kind="stable")
    of, column = of[by_column], column[by_column]
    common = np.zeros((n, n), np.float32)
    step = max(256, (1 << 22) // max(n, 1))
    for low in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, (low, low + step))
        block = np.zeros((n, min(step, int(shared.sum()) - low)), np.float32)
        block[of[a:b], column[a:b] - low] = 1
        common += block @ block.T
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    for i in range(n):
        meet = common[i, i + 1 :].astype(np.int64)
        hit = 100 * meet >= percent * (size[i] + size[i + 1 :] - meet)
        if sides is not None:
            hit &= ((sides[i] & 1) & (sides[i + 1 :] >> 1) | (sides[i] >> 1) & (sides[i + 1 :] & 1)).astype(bool)
        for j in (np.flatnonzero(hit) + i + 1).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                forest.append((i, j))
    return forest


def verified(grouped: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) inside groups of sets: rows of ``of``, an array of (node, set, side)."""

    def start():
        def work(columns):
            u, v = [], []
            for group in columns[0]:
                nodes = [x["node"] for x in group]
                sets = [np.frombuffer(x["set"], np.uint64) for x in group]
                sides = np.array([x["side"] for x in group])
                for i, j in linked(sets, percent, None if (sides == 3).all() else sides):
                    u.append(nodes[i])
                    v.append(nodes[j])
            return [u, v]

        return work

    return explode_texts(grouped, ["of"], "u long, v long", start, piece_rows=64)


def _sets_of(documents: DataFrame, rows: DataFrame, clusters: DataFrame, rule: Rule) -> DataFrame:
    """(node, cluster, n_shingles, set) of the sets in clusters, made again from the text of their first document."""
    wanted = rows.groupBy("node").agg(F.min("doc_id").alias("first")).join(clusters, "node")
    wanted = stored(wanted, "wanted")
    ids = wanted.select(F.col("first").alias("_id")).distinct()
    source = documents.select("doc_id", "text").join(
        small(ids, ids.count()), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"
    )

    def start():
        def work(columns):
            sets = {set_key(s): s.tobytes() for s in shingle_sets(columns[0], rule.shingle) if len(s)}
            return [list(sets), list(sets.values())]

        return work

    made = explode_texts(source, ["text"], "node long, set binary", start, piece_bytes=2 << 20)
    once = made.join(small(wanted.drop("first"), wanted.count()), "node").groupBy("node", "cluster")
    return once.agg(F.first("set").alias("set")).withColumn("n_shingles", (F.length("set") / 8).cast("long"))


def links(documents: DataFrame, rows: DataFrame, rule: Rule, near: DataFrame | None = None) -> DataFrame:
    """(u, v): links between sets that make the same components as all links.

    Sets that share a band, or are joined by the stored edges ``near`` instead, over each other, are a cluster. A cluster of one tile is compared within it, all pairs. A
    larger one is cut into tiles by hash; each is compared within itself and with the cluster's hubs, the sets that share
    bands with most others. Only sets that are then outside the cluster's largest group are still compared with all
    tiles. What is shuffled for a family of very many copies of few texts thus grows with its sets, not with its pairs.
    """
    if near is None:
        near = stored(candidates(stored(banded(documents, rule), "bands")), "candidates")
    clusters = components(near).withColumnRenamed("label", "cluster")
    sets = stored(_sets_of(documents, rows, stored(clusters, "clusters"), rule), "sets")
    sizes = sets.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("elements"))
    tiles = F.ceil(F.greatest(F.col("n") / rule.tile, F.col("elements") / rule.elements)).cast("int")
    sizes = stored(sizes.select("cluster", tiles.alias("tiles")), "tiles")
    placed = sets.join(small(sizes, sizes.count()), "cluster")
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    entry = F.struct("node", "set", "side")

    def tiled(parts: DataFrame, *keys: str) -> DataFrame:
        return parts.groupBy("cluster", *keys).agg(F.collect_list(entry).alias("of")).filter(F.size("of") > 1)

    both = placed.withColumn("side", F.lit(3))
    own = both.withColumn("tile", tile)
    large = sizes.filter("tiles > 1")
    if large.isEmpty():
        return stored(verified(tiled(own, "tile"), rule.percent), "links")
    large_nodes = clusters.join(small(large.select("cluster"), large.count()), "cluster", "left_semi")
    degree = near.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    order = Window.partitionBy("cluster").orderBy(F.desc("degree"), "node")
    hubs = large_nodes.join(degree, "node").withColumn("place", F.row_number().over(order))
    hubs = stored(hubs.filter(F.col("place") <= rule.hubs).select("node"), "hubs")
    of_hubs = both.join(small(hubs, hubs.count()), "node")
    shown = of_hubs.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    shown = shown.filter(F.col("tile") != tile)
    first = stored(verified(tiled(own.unionByName(shown), "tile"), rule.percent), "links")
    # The largest group of each cluster of several tiles, and the sets outside it.
    known = components(first).withColumnRenamed("label", "group")
    grouped = stored(
        large_nodes.join(known, "node", "left").select("cluster", "node", F.coalesce("group", "node").alias("group")), "groups"
    )
    counts = grouped.groupBy("cluster", "group").agg(F.count("*").alias("n"))
    main = counts.groupBy("cluster").agg(F.max_by("group", F.struct("n", "group")).alias("main"))
    rest = stored(grouped.join(small(main, large.count()), "cluster").filter("group <> main").select("node"), "rest")
    n_rest = rest.count()
    if not n_rest:
        return first
    of_rest = both.join(small(rest, n_rest), "node")
    per = of_rest.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("elements"))
    per = per.select("cluster", F.ceil(F.greatest(F.col("n") / rule.tile, F.col("elements") / rule.elements)).cast("int").alias("parts"))
    per = stored(per, "parts")
    per_small = small(per, per.count())
    apart = of_rest.join(per_small, "cluster").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    apart = apart.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("side", F.lit(1))
    whole = both.join(per_small, "cluster").withColumn("tile", tile).withColumn("side", F.lit(2))
    whole = whole.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    second = stored(verified(tiled(apart.unionByName(whole), "tile", "part"), rule.percent), "links")
    return first.unionByName(second)


def near_duplicates(documents: DataFrame, keep: list[str], rule: Rule = Rule()) -> DataFrame:
    """The ``keep`` columns, which hold ``doc_id``, and of each row ``n_shingles`` (size of its set), ``component_id``
    (the smallest doc_id that links reach, its own included) and ``kept``, true where that is its own.

    Whole texts are read; ASCII letters count as small ones. Null texts and texts without words have an empty set, which
    links with nothing, not even its like. Rows with the same doc_id are documents of their own, linked only by their
    sets. Equal sets are one node however many rows have them. A null doc_id counts as the largest, so a component has a
    null id, and keeps its rows, only if it has no other. An empty table has no rows. Sets are compared by hashes of 64
    bits; texts and sets are not shuffled but for one of each set that shares a band with another.
    """
    rows = stored(keyed(documents, keep, rule), "keys")
    found = stored(components(links(documents, rows, rule)), "components")
    firsts = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    of_label = found.join(firsts, "node")
    best = of_label.groupBy("label").agg(F.min("first").alias("least"))
    of_linked = of_label.join(best, "label").select("node", "least")
    # Stored, so that the join below reads two plain sides and a very common set can be split.
    of_each = firsts.join(of_linked, "node", "left").select("node", F.coalesce("least", "first").alias("least"))
    of_each = stored(of_each, "least")
    spread = rows.filter("node is not null").join(of_each, "node")
    none = rows.filter("node is null").withColumn("least", F.col("doc_id"))
    columns = [*keep, "n_shingles", F.col("least").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("least")).alias("kept")]
    return spread.select(*columns).unionByName(none.select(*columns))
