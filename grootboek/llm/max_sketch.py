"""Exact ranked search with hashed max-sketches: a document's impacts fold into the maxima of a few thousand places; what
a query reads there bounds its score, and documents are scored exactly in the order of their bounds until none can enter
the best."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grootboek.llm.common import explode_texts, stored
from grootboek.llm.gathering import gathered

#: Bytes of a term, with A-Z in lower case: digits, letters and all that is not ASCII. Fixed values of the ranking.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: The unit of an impact, and what a weight and a length are multiplied by. Fixed values of the ranking.
UNIT, WEIGHT, SHARE = 1_000_000_000, 1000, 50
FOUND = "item long, doc_id long, score long"


@dataclass(frozen=True)
class Rule:
    """``k`` best documents for an item. A sketch has ``places`` places (a power of two); ``strip`` documents are scored
    at a time; items are searched together while they hold at most ``batch`` different terms in all."""

    k: int = 50
    places: int = 4096
    strip: int = 16
    batch: int = 200_000


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


# Items, as packed lists of their different terms.


def numbered(items: DataFrame, rule: Rule) -> DataFrame:
    """(batch, item_id, terms): the different terms of all rows of an item, joined by spaces, and the batch in which it
    is searched. Items without terms are left out."""

    def start():
        def work(columns):
            ids, lists = columns
            made = [b" ".join(sorted({t for text in texts for t in terms_of(text)})).decode() for texts in lists]
            return [ids, made, [t.count(" ") + 1 for t in made]]

        return work

    texts = items.groupBy("item_id").agg(F.collect_set("text").alias("texts"))
    made = explode_texts(texts, ["item_id", "texts"], "item_id long, terms string, n long", start)
    made = stored(made.filter("terms <> ''"), "items")
    batches = max(1, -(-(made.agg(F.sum("n")).first()[0] or 0) // rule.batch))
    return made.select(F.pmod(F.xxhash64("item_id"), F.lit(batches)).alias("batch"), "item_id", "terms")


# Statistics of the documents.


def statistics(documents: DataFrame, wanted) -> tuple[int, int, dict[bytes, int]]:
    """How many documents have a term, how many terms they have in all, and in how many each of the ``wanted`` (sent to
    all tasks) occurs. Tasks sum over their documents."""

    def start():
        vocabulary, df, sums = wanted.value, Counter(), [0, 0]

        def work(columns):
            for text in columns[0]:
                words = terms_of(text)
                if words:
                    sums[0] += 1
                    sums[1] += len(words)
                    df.update(vocabulary.intersection(words))

        def rest():
            return [[None, "", *(t.decode() for t in df)], [*sums, *df.values()]]

        return work, rest

    rows = gathered(documents, ["text"], "term string, n long", start).groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in rows}
    n, length = counts.pop(None, 0), counts.pop("", 0)
    return n, length, {t.encode(): c for t, c in counts.items()}


# Sketches, bounds and scores.


def impacts(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return UNIT * tf // (1000 * tf + 20 * m)


class Queries:
    """The items of a batch, ready to be looked up: of each, its terms with their weights and places."""

    def __init__(self, rows: list, n: int, length: int, df: dict[bytes, int], rule: Rule):
        self.ids, self.n, self.length, self.rule = [r["item_id"] for r in rows], n, length, rule
        self.weighed = []
        for r in rows:
            terms = [(t, math.floor(WEIGHT * math.log((2 * n + 2) / (2 * df[t] + 1)))) for t in r["terms"].encode().split() if t in df]
            self.weighed.append([(t, w) for t, w in terms if w > 0])


class Search:
    """The search of a batch of items in the documents of one task. What it has found so far raises the score to beat."""

    def __init__(self, queries: Queries):
        self.q, rule = queries, queries.rule
        # Places are by Python's own hash of bytes, which is one and the same within a process; sketches never leave it.
        self.mask = rule.places - 1
        self.places = [np.array([hash(t) & self.mask for t, _ in of], np.int64) for of in queries.weighed]
        self.weights = [np.array([w for _, w in of], np.int64) for of in queries.weighed]
        self.asked = {t for of in queries.weighed for t, _ in of}
        self.best: list[list[tuple]] = [[] for _ in queries.ids]
        self.to_beat = [1] * len(queries.ids)
        self.n_scored = self.n_bounded = 0

    def add(self, ids: list, texts: list) -> None:
        """Looks at some more documents."""
        counts = [Counter(terms_of(t)) for t in texts]
        some = [i for i, c in enumerate(counts) if c]
        if not some:
            return
        ids, counts = [ids[i] for i in some], [counts[i] for i in some]
        sketch, exact = self.sketch(counts)
        del counts
        for item, (places, weights) in enumerate(zip(self.places, self.weights, strict=True)):
            if len(places):
                bounds = weights @ sketch[places]
                self.rescore(item, ids, bounds, exact)

    def sketch(self, counts: list[Counter]) -> tuple[np.ndarray, list[dict]]:
        """Of each document, the greatest impact at each place (places by documents), and the impacts of asked terms."""
        lengths = [sum(c.values()) for c in counts]
        m = [SHARE + SHARE * n * self.q.n // self.q.length for n in lengths]
        sizes = [len(c) for c in counts]
        of = np.repeat(np.arange(len(counts)), sizes)
        tf = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in counts])
        at = np.concatenate([np.fromiter(map(hash, c), np.int64, len(c)) for c in counts]) & self.mask
        impact = impacts(tf, np.repeat(np.array(m, np.int64), sizes))
        sketch = np.zeros((self.q.rule.places, len(counts)), np.int64)
        np.maximum.at(sketch.ravel(), at * len(counts) + of, impact)
        exact = []
        for c, own in zip(counts, m, strict=True):
            exact.append({t: UNIT * c[t] // (1000 * c[t] + 20 * own) for t in self.asked.intersection(c)})
        return sketch, exact

    def rescore(self, item: int, ids: list, bounds: np.ndarray, exact: list[dict]) -> None:
        """Scores documents in the order of their bounds, until the next bound is below the score to beat."""
        rule, terms, best = self.q.rule, self.q.weighed[item], self.best[item]
        open_ = np.flatnonzero(bounds >= self.to_beat[item])
        self.n_bounded += len(bounds)
        order = open_[np.argsort(-bounds[open_], kind="stable")]
        for at in range(0, len(order), rule.strip):
            part = order[at : at + rule.strip].tolist()
            if bounds[part[0]] < self.to_beat[item]:
                break
            self.n_scored += len(part)
            for d in part:
                own = exact[d]
                score = sum(w * own[t] for t, w in terms if t in own)
                if score >= self.to_beat[item]:
                    best.append((-score, ids[d] is None, ids[d] or 0))
            if len(best) >= rule.k:
                best.sort()
                del best[rule.k :]
                if len(best) == rule.k:
                    self.to_beat[item] = -best[-1][0]

    def found(self) -> list | None:
        made = [[], [], []]
        for item, best in enumerate(self.best):
            for minus, none, doc in best:
                for column, value in zip(made, (item, None if none else doc, -minus), strict=True):
                    column.append(value)
        return made if made[0] else None


def search(documents: DataFrame, items: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``rule.k`` best rows of ``documents`` (doc_id, text) for each item of ``items``
    (item_id, text), by score and then by doc_id, null last; fewer where fewer have a score above 0.

    Whole texts are searched. Null and empty texts have no terms: such documents are not found and not counted, such
    items find nothing. Repeated documents are found each for itself. Rows of one item_id, null included, are one item
    with all their terms. Empty tables give no rows.

    A task reads its documents piece by piece and keeps only the best of each item, so what leaves it does not grow with
    its documents. Items go to the tasks in batches of bounded size; each batch reads the documents twice, once for the
    statistics. The best of all tasks are ranked in two steps, the first by item and part of the documents.
    """
    spark = documents.sparkSession
    asked, results = numbered(items, rule), []
    for batch in [r[0] for r in asked.select("batch").distinct().sort("batch").collect()]:
        rows = asked.filter(F.col("batch") == batch).select("item_id", "terms").collect()
        wanted = spark.sparkContext.broadcast(frozenset(t for r in rows for t in r["terms"].encode().split()))
        n, length, df = statistics(documents, wanted)
        wanted.destroy()
        if n:
            results.append(_found(documents, Queries(rows, n, length, df, rule)))
    result = "item_id long, rank int, doc_id long, score long"
    if not results:
        return spark.createDataFrame([], result)
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    for keys in (["item_id", "part"], ["item_id"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("part", part).withColumn("rank", rank).filter(F.col("rank") <= rule.k)
    return found.select("item_id", "rank", "doc_id", "score")


def _found(documents: DataFrame, queries: Queries) -> DataFrame:
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(queries)

    def start():
        search = Search(sent.value)
        return (lambda columns: search.add(*columns)), search.found

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stored(gathered(source, ["doc_id", "text"], FOUND, start), "found")
    sent.destroy()
    ids = spark.createDataFrame([(i, x) for i, x in enumerate(queries.ids)], "item long, item_id long")
    return found.join(F.broadcast(ids), "item").select("item_id", "doc_id", "score")
