"""Nearest neighbours by cosine, proposals drawn from them, and the vector table they are read from.

The search uses an inverted file of cells (``cells``) and is exact unless told otherwise:

1. Equal vectors are one vector. It keeps its ``k + 1`` lowest point ids; no further copy can enter a top ``k``.
2. Every vector is in the cell of its nearest centroid.
3. Queries and points of a scope are dealt to a grid of blocks by hash. Every block of queries meets every block of points
   once, in a task of its own; a row moves as often as the grid is wide, whatever the number of cells.
4. In a block, queries that lie near each other are compared, exactly, with all vectors in the cells nearest to them.
   What they find there gives a score to beat.
5. Cells whose vectors, by their distances from the centroid, may reach that score are looked into as well. With a
   ``recall`` that step is left out, and the number of cells in step 4 is chosen on a sample to reach that recall.

A block passes on ``k + 1`` vectors per query. ``nearest_exact`` compares every query with every vector of its scope.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grootboek.checkpoints import checkpointed
from grootboek.functions.ids import point_id
from grootboek.functions.text import index_text, strip_iban, text_or_empty
from grootboek.operators import cells
from grootboek.operators.cells import unit_rows
from grootboek.operators.classify import without_structural
from grootboek.schema import PAYLOAD
from grootboek.skew import lookup
from grootboek.sources.ledgers import CheckFailed
from grootboek.vocabulary import DEFAULT, Vocabulary

NEIGHBOURS = 5
UNANIMOUS_MIN = 3
#: So many queries are compared at once, with four times as many points.
BLOCK_ROWS = 1024
#: The queries and the points of a scope are dealt to so many blocks, where that many rows are in each, and to more only
#: where a block would hold more numbers than ``BLOCK_VALUES``. What is shuffled grows with the rows until then.
QUERY_BLOCKS, POINT_BLOCKS = 8, 4
BLOCK_VALUES = 1 << 23
#: So many pairs are scored again at once in double precision.
PAIRS = 1 << 14
#: Queries that the number of cells for a recall is chosen on: those with the lowest hashes, so their number is bounded.
TRIAL_QUERIES = 256
#: Scores are equal when they agree to so many decimals; products of different blocks differ in the last ones.
DECIMALS = 12

_VECTOR = ["scope", "vector_key"]
_HIT = "scope string, vector_key string, hit_key string, first_id string, score double"


def _distinct_vectors(rows: DataFrame, id_column: str, scope: str | None, keep: int) -> DataFrame:
    """One row per (scope, vector) with its ``keep`` lowest ids. The rank filter also applies before the shuffle."""
    keyed = rows.select(
        (F.col(scope) if scope else F.lit("")).alias("scope"),
        F.md5(F.col("embedding").cast("string").cast("binary")).alias("vector_key"),
        F.col(id_column).cast("string").alias("point_id"),
        (F.to_json("payload") if "payload" in rows.columns else F.lit("")).alias("payload"),
        F.col("embedding").alias("vector"),
    )
    order = Window.partitionBy(*_VECTOR).orderBy("point_id")
    lowest = keyed.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= keep)
    members = F.array_sort(F.collect_list(F.struct("point_id", "payload")))
    return lowest.groupBy(*_VECTOR).agg(
        F.min_by("vector", "_rank").alias("vector"), members.alias("members")
    )


def _best(asked: np.ndarray, units: np.ndarray, need: int, cell: np.ndarray | None, look: cells.Look | None):
    """The places (query, point) and scores of the ``need`` best ``units`` of each query; among equal scores those that
    come first. ``cell`` is that of each point, and ``look`` says which cells a query looks into; without it, all."""
    if look is None:
        order = np.arange(len(asked))
        spans = None
    else:
        order = np.argsort(look.own(asked), kind="stable")
        cell = np.where(cell == cells.ZERO_CELL, look.file.size, cell)
        by_cell = np.argsort(cell, kind="stable")
        spans = np.split(by_cell, np.searchsorted(cell[by_cell], np.arange(1, look.file.size + 1)))
    single = units.astype(np.float32)
    found = []
    for at in range(0, len(asked), BLOCK_ROWS):
        rows = order[at : at + BLOCK_ROWS]
        top = _Top(asked[rows], units, single, need)
        if look is None:
            top.meet(np.arange(len(units)))
        else:
            near = look.first(asked[rows])
            met = near.any(axis=0)
            inside = np.concatenate([spans[c] for c in np.flatnonzero(met)])
            top.meet(inside, None if look.whole else near[:, cell[inside]])
            if look.whole:
                more = look.file.open_cells(asked[rows], top.score[:, -1]).any(axis=0) & ~met
                if more.any():
                    top.meet(np.concatenate([spans[c] for c in np.flatnonzero(more)]))
        row, place = np.nonzero(top.at >= 0)
        found.append((rows[row], top.at[row, place], top.score[row, place]))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


class _Top:
    """The best points so far of some queries. Products in single precision say which pairs can be among them, and only
    those are scored."""

    def __init__(self, asked: np.ndarray, units: np.ndarray, single: np.ndarray, need: int):
        self.asked, self.units, self.single, self.need = asked, units, single, need
        self.asked_single = asked.astype(np.float32)
        self.score = np.full((len(asked), need), -np.inf)
        self.at = np.full((len(asked), need), -1)
        # More than twice what a sum of so many products of numbers up to 1 loses in single precision.
        self.slack = (asked.shape[1] + 8) * 2.0**-22

    def meet(self, points: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """Compares all queries with the ``points`` (places), or the pairs ``allowed``."""
        step = 4 * BLOCK_ROWS
        for at in range(0, len(points), step):
            part = points[at : at + step]
            may = None if allowed is None else allowed[:, at : at + step]
            about = self.asked_single @ self.single[part].T
            if may is not None:
                about[~may] = -np.inf
            beat = self.score[:, -1]
            if len(part) > self.need and np.isneginf(beat).any():
                beat = np.maximum(beat, np.partition(about, len(part) - self.need, axis=1)[:, len(part) - self.need] - self.slack)
            hit = about >= (beat - self.slack).astype(np.float32)[:, None]
            pairs = np.flatnonzero(hit if may is None else hit & may)
            if len(pairs):
                self._take(pairs // len(part), part[pairs % len(part)])

    def _take(self, row: np.ndarray, at: np.ndarray) -> None:
        score = np.empty(len(row))
        for i in range(0, len(row), PAIRS):
            pairs = slice(i, i + PAIRS)
            score[pairs] = np.einsum("ij,ij->i", self.asked[row[pairs]], self.units[at[pairs]])
        old = np.nonzero(self.at >= 0)
        row = np.concatenate([old[0], row])
        at = np.concatenate([self.at[old], at])
        score = np.concatenate([self.score[old], np.round(score, DECIMALS)])
        order = np.lexsort((at, -score, row))
        row, at, score = row[order], at[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.need
        self.score[row[kept], place[kept]] = score[kept]
        self.at[row[kept], place[kept]] = at[kept]


def _compare(probes: DataFrame, points: DataFrame, need: int, look: cells.Look | None = None) -> DataFrame:
    """The ``need`` best vectors per query of every block of points, from bounded blocks of queries and points."""
    block = ["scope", "part", "group"]

    def blocks(rows: DataFrame, most: int, count: str) -> DataFrame:
        sizes = rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"))
        few = F.least(F.ceil(F.col("n") / BLOCK_ROWS), F.lit(most))
        bounded = F.ceil(F.col("n") * F.col("width") / BLOCK_VALUES)
        return sizes.select("scope", F.greatest(few, bounded).cast("int").alias(count))

    # One row per scope: how many blocks of points and of queries meet there.
    shape = checkpointed(blocks(points, POINT_BLOCKS, "parts").join(blocks(probes, QUERY_BLOCKS, "groups"), "scope"))

    def place(count: str) -> Column:
        return F.pmod(F.xxhash64("vector_key"), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    cell = F.col("cell") if look else F.lit(0)
    left = lookup(probes.select(*_VECTOR, "vector"), shape, "scope", ["vector_key"], how="inner")
    left = left.withColumn("group", place("groups")).withColumn("part", every("parts"))
    right = points.select(*_VECTOR, "first_id", cell.alias("cell"), "vector")
    right = lookup(right, shape, "scope", ["vector_key"], how="inner")
    right = right.withColumn("part", place("parts")).withColumn("group", every("groups"))

    def best(queries: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or corpus.empty:
            return pd.DataFrame({c: [] for c in ("scope", "vector_key", "hit_key", "first_id", "score")})
        # In the order of ids, which puts lower ids first among equals.
        corpus = corpus.sort_values("first_id")
        found = _best(unit_rows(queries["vector"]), unit_rows(corpus["vector"]), need, corpus["cell"].to_numpy(), look)
        asked, hits, score = found
        return pd.DataFrame(
            {
                "scope": queries["scope"].to_numpy()[asked],
                "vector_key": queries["vector_key"].to_numpy()[asked],
                "hit_key": corpus["vector_key"].to_numpy()[hits],
                "first_id": corpus["first_id"].to_numpy()[hits],
                "score": score,
            }
        )

    pairs = (
        left.select(*block, "vector_key", "vector")
        .groupBy(*block)
        .cogroup(right.select(*block, "vector_key", "first_id", "cell", "vector").groupBy(*block))
    )
    return pairs.applyInPandas(best, _HIT)


def _answers(found: DataFrame, vectors: DataFrame, need: int) -> DataFrame:
    """The best vectors per query over all blocks of points, with their members: ``near``, best first."""
    order = Window.partitionBy(*_VECTOR).orderBy(F.desc("score"), "first_id")
    best = found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= need)
    named = vectors.select(F.col("scope").alias("hit_scope"), F.col("vector_key").alias("hit"), "members")
    same = (F.col("scope") == F.col("hit_scope")) & (F.col("hit_key") == F.col("hit"))
    members = F.explode("members").alias("m")
    flat = best.join(named, same).select(*_VECTOR, "score", members)
    # Equal scores of different vectors interleave by id.
    entry = F.struct((-F.col("score")).alias("far"), "m.point_id", "score", "m.payload")
    near = F.transform(
        F.array_sort(F.collect_list(entry)),
        lambda e: F.struct(e["score"].alias("score"), e["point_id"].alias("point_id"), e["payload"].alias("payload")),
    )
    return flat.groupBy(*_VECTOR).agg(near.alias("near"))


def _search(queries: DataFrame, points: DataFrame, k: int, scope: str | None, compare) -> DataFrame:
    """``compare`` finds, for the vectors asked about, the best ``k + 1`` vectors among the candidates."""
    need = k + 1
    vectors = checkpointed(_distinct_vectors(points, "point_id", scope, need))
    keyed = queries.select(
        "point_id",
        (F.col(scope) if scope else F.lit("")).alias("scope"),
        F.md5(F.col("embedding").cast("string").cast("binary")).alias("vector_key"),
    )
    asked = checkpointed(_distinct_vectors(queries, "point_id", scope, 1).select(*_VECTOR, "vector"))
    candidates = vectors.select(*_VECTOR, "vector", F.col("members")[0]["point_id"].alias("first_id"))
    answers = _answers(compare(asked, candidates, need), vectors, need)
    joined = lookup(keyed, answers, _VECTOR, spread=["point_id"])
    own = F.col("point_id").cast("string")
    others = F.filter(F.coalesce("near", F.array()), lambda n: n["point_id"] != own)
    return joined.select("point_id", F.slice(others, 1, k).alias("neighbours"))


def nearest(
    queries: DataFrame,
    points: DataFrame,
    k: int = NEIGHBOURS,
    scope: str | None = "direction",
    recall: float | None = None,
    n_cells: int | None = None,
    probes: int | None = None,
) -> DataFrame:
    """The ``k`` most similar points of each query within the same ``scope``, without the query itself.

    ``queries`` and ``points`` have ``point_id``, ``embedding``, the scope column if any, and ``points`` a ``payload``
    struct. The result is ``point_id`` and ``neighbours``, an array of ``score``, ``point_id`` and ``payload`` (JSON),
    best first, lower ids first among equals; fewer than ``k`` only where the scope has fewer. A vector of zeros has the
    score 0 with all.

    With a ``recall`` the result is approximate: that share of the true neighbours is expected, by a trial on
    ``TRIAL_QUERIES`` of the queries. ``n_cells`` (about the square root of the number of vectors) and ``probes`` (cells
    that a query looks into at first) change the work, not the result.
    """

    def compare(asked: DataFrame, candidates: DataFrame, need: int) -> DataFrame:
        file = cells.trained(candidates, n_cells)
        if file is None:
            return _all_with_all(asked, candidates, need)
        placed = checkpointed(cells.placed_in(file, candidates))
        file = file.with_rings(placed)
        first = probes or max(1, round(file.size**0.5))
        if recall is None:
            return _compare(asked, placed, need, cells.Look(file, first, True))
        enough = _probes_for(recall, file, placed, first, asked, need)
        return _compare(asked, placed, need, cells.Look(file, enough, False))

    return _search(queries, points, k, scope, compare)


def _probes_for(recall: float, file: cells.CellFile, placed: DataFrame, first: int, asked: DataFrame, need: int) -> int:
    """How many of the nearest cells hold ``recall`` of the true neighbours of a sample of queries."""
    trial = checkpointed(asked.orderBy(F.xxhash64(*_VECTOR), *_VECTOR).limit(TRIAL_QUERIES))
    found = _compare(trial, placed, need, cells.Look(file, first, True))
    order = Window.partitionBy(*_VECTOR).orderBy(F.desc("score"), "first_id")
    best = found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= need)
    cell_of = placed.select(F.col("scope").alias("_scope"), F.col("vector_key").alias("_key"), "cell")
    same = (F.col("scope") == F.col("_scope")) & (F.col("hit_key") == F.col("_key"))
    # The query itself is in its nearest cell; it is no neighbour.
    hits = best.where(F.col("hit_key") != F.col("vector_key")).join(cell_of, same).select(*_VECTOR, "cell")
    ranked = hits.join(trial, _VECTOR).select(file.rank_of(F.col("vector"), F.col("cell")).alias("rank"))
    counts = sorted((r["rank"], r["count"]) for r in ranked.groupBy("rank").count().collect())
    total, held = sum(n for _, n in counts), 0
    for rank, n in counts:
        held += n
        if held >= recall * total:
            return rank
    return file.size


def nearest_exact(
    queries: DataFrame, points: DataFrame, k: int = NEIGHBOURS, scope: str | None = "direction"
) -> DataFrame:
    """``nearest`` without cells: every block of queries is compared with every block of points, in quadratic time."""
    return _search(queries, points, k, scope, _all_with_all)


def _all_with_all(asked: DataFrame, candidates: DataFrame, need: int) -> DataFrame:
    return _compare(asked, candidates, need)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many queries there are, how many neighbours they have in ``exact``, and the share ``recall`` of those
    that ``found`` has as well."""
    true = exact.select("point_id", F.transform("neighbours", lambda n: n["point_id"]).alias("_true"))
    got = found.select("point_id", F.transform("neighbours", lambda n: n["point_id"]).alias("_got"))
    both = true.join(got, "point_id", "left")
    shared = F.size(F.array_intersect("_true", F.coalesce("_got", F.array().cast("array<string>"))))
    sums = both.agg(
        F.count(F.lit(1)).alias("queries"),
        F.coalesce(F.sum(F.size("_true")), F.lit(0)).alias("neighbours"),
        F.coalesce(F.sum(shared), F.lit(0)).alias("_shared"),
    )
    share = F.when(F.col("neighbours") > 0, F.col("_shared") / F.col("neighbours")).otherwise(1.0)
    return sums.select("queries", "neighbours", share.alias("recall"))


def labelled(found: DataFrame) -> DataFrame:
    """Neighbours with their labels read from the payload."""
    label = F.transform(
        "neighbours",
        lambda n: F.struct(
            F.coalesce(F.get_json_object(n["payload"], "$.category"), F.lit("")).alias("category"),
            F.coalesce(F.get_json_object(n["payload"], "$.subcategory"), F.lit("")).alias("subcategory"),
            n["score"].alias("score"),
            n["point_id"].alias("point_id"),
        ),
    )
    return found.withColumn("neighbours", label)


def proposal(neighbours: Column) -> Column:
    """What labelled neighbours suggest: the closest one's label, and whether they agree. NULL without neighbours.

    ``split`` lists the labels with their counts, most frequent first. The array is short, so this stays in the row.
    """
    labels = F.transform(
        neighbours, lambda n: F.struct(n["category"].alias("category"), n["subcategory"].alias("subcategory"))
    )
    counts = F.transform(
        F.array_distinct(labels),
        lambda d: F.struct(
            (-F.size(F.filter(labels, lambda x: x == d))).alias("minus_n"),
            d["category"].alias("category"),
            d["subcategory"].alias("subcategory"),
        ),
    )
    split = F.transform(
        F.array_sort(counts),
        lambda c: F.struct(
            c["category"].alias("category"), c["subcategory"].alias("subcategory"), (-c["minus_n"]).alias("n")
        ),
    )
    same = F.size(counts) == 1
    hit = F.struct(
        neighbours[0]["category"].alias("category"),
        neighbours[0]["subcategory"].alias("subcategory"),
        neighbours[0]["score"].alias("score"),
        (same & (F.size(neighbours) >= UNANIMOUS_MIN)).alias("unanimous"),
        F.size(neighbours).alias("neighbor_n"),
        (~same).alias("mixed"),
        split.alias("split"),
    )
    return F.when(F.size(neighbours) > 0, hit)


def doubt_mixed(preview: DataFrame, found: DataFrame, on: list[str], v: Vocabulary = DEFAULT) -> DataFrame:
    """Attach labelled neighbours to new import rows. Neighbours that disagree put a row in doubt, unless a rule decided it.

    A staged preview is not changed by this; it only affects what the reviewer sees.
    """
    joined = preview.join(found.select(*on, "neighbours"), on, "left")
    fresh = (F.col("status") == v.status_new) & (text_or_empty(F.col("shown")) != "")
    mixed = F.coalesce(proposal(F.col("neighbours"))["mixed"], F.lit(False)) & fresh
    doubted = mixed & (F.col("source") != v.source_rule)
    return joined.withColumns(
        {
            "neighbours": F.when(fresh, F.col("neighbours")),
            "neighbours_mixed": mixed,
            "tone": F.when(doubted, v.tone_doubt).otherwise(F.col("tone")),
        }
    )


def import_neighbours(
    preview: DataFrame,
    vectors: DataFrame,
    points: DataFrame,
    on: tuple[str, ...] = ("file", "pos"),
    v: Vocabulary = DEFAULT,
    **search: float,
) -> DataFrame:
    """A preview with the neighbours of its new rows, and doubt where those disagree.

    ``vectors`` has the keys ``on`` and ``embedding`` of rows to import; ``points`` are those of the ledger. Only new
    rows with a text are looked up, each among points of its own direction. ``search`` goes to ``nearest``.
    """
    fresh = preview.where((F.col("status") == v.status_new) & (text_or_empty(F.col("shown")) != ""))
    key = F.concat_ws("\u0001", F.lit("import"), *on)
    asked = fresh.join(vectors.select(*on, "embedding"), list(on)).select(
        *on, key.alias("point_id"), "direction", "embedding"
    )
    found = labelled(nearest(asked.drop(*on), points, **search))
    return doubt_mixed(preview, asked.select(*on, "point_id").join(found, "point_id"), list(on), v)


# What the vector table holds; ``sources.vector_table`` stores it.


def index_rows(ledger: DataFrame, prefix: str = "ledger") -> DataFrame:
    """Rows to embed: point id, text without personal data, and the payload. Structural rows stay out."""
    payload = F.struct(
        "src",
        "tx_id",
        text_or_empty(F.col("category")).alias("category"),
        text_or_empty(F.col("subcategory")).alias("subcategory"),
        strip_iban(F.col("merchant")).alias("merchant"),
        text_or_empty(F.col("direction")).alias("direction"),
        text_or_empty(F.col("account")).alias("account"),
        F.coalesce(F.year("tx_date"), F.lit(0)).alias("year"),
        F.coalesce(F.month("tx_date"), F.lit(0)).alias("month"),
        "flow_kind",
        F.lit(False).alias("corrected"),
    )
    return without_structural(ledger).select(
        point_id(F.col("src"), F.col("tx_id"), prefix).alias("point_id"),
        index_text(F.col("description")).alias("index_text"),
        payload.alias("payload"),
    )


def build_points(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Index rows with the vector computed for their point id. Text is dropped."""
    return rows.drop("index_text").join(vectors.select("point_id", "embedding"), "point_id")


def check_points(points: DataFrame, size: int) -> DataFrame:
    """``points``, checked when read: a payload field that is not allowed or a vector of another size fails the job."""
    extra = set(points.schema["payload"].dataType.fieldNames()) - set(PAYLOAD)
    if extra:
        raise CheckFailed(f"payload fields not allowed: {', '.join(sorted(extra))}")
    right = F.coalesce(F.size("embedding") == size, F.lit(False))
    checked = F.when(right, F.col("embedding")).otherwise(F.raise_error(F.lit("vector size mismatch")))
    return points.withColumn("embedding", checked)
