"""Quality classifier: an interpolated modified Kneser-Ney model over character n-grams, counted on trusted text; joins
with its sharded counts give the perplexity of every document, and quantiles for each language the limit."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grootboek.llm.common import explode_texts, give_back, small, stored

#: Stands before a text, ``order - 1`` times.
PAD = "\x02"
#: Log probabilities are added up as whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Characters that a task works on at once, and n-grams that it gathers before it passes them on.
SLICE, GATHER = 1 << 18, 1 << 19


def _slices(texts: list) -> Iterator[range]:
    """Runs of texts with about ``SLICE`` characters."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE:
            yield range(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield range(first, len(texts))


@dataclass
class _Grams:
    """The n-grams of a few texts, one for each character: key, place in ``codes`` and text they are from."""

    codes: np.ndarray
    keys: np.ndarray
    places: np.ndarray
    of: np.ndarray
    order: int

    @classmethod
    def read(cls, texts: list, order: int) -> _Grams:
        pad = PAD * (order - 1)
        whole = "".join([pad + (t or "") for t in texts]) + pad
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t or "") for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes + order - 1)[:-1]])
        of = np.repeat(np.arange(len(texts)), sizes)
        places = np.arange(len(of)) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        return cls(codes, keys_of(codes, order)[places], places, of, order)

    def strings(self, which: np.ndarray) -> list[str]:
        windows = self.codes[self.places[which][:, None] + np.arange(self.order)]
        return [w.tobytes().decode("utf-32-le") for w in np.ascontiguousarray(windows)]


def keys_of(codes: np.ndarray, order: int) -> np.ndarray:
    """A key of 64 bits for every run of ``order`` codes."""
    n = len(codes) - order + 1
    keys = np.zeros(n, np.uint64)
    for i in range(order):
        keys *= _MULTIPLIER
        keys += codes[i : i + n]
    return keys ^ (keys >> np.uint64(29))


class _Table:
    """Keys to whole numbers, for looking up many keys at once. Every task holds one: 12 bytes a slot, two to four slots a
    key. Millionths of a double's logarithm fit in 4 bytes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        waiting, step = np.arange(len(keys)), 0
        while len(waiting):
            slots = self._slots(keys[waiting], step)
            free = self.keys[slots] == 0
            _, first = np.unique(slots[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[slots[chosen]], self.values[slots[chosen]] = keys[waiting[chosen]], values[waiting[chosen]]
            waiting = np.delete(waiting, chosen)
            step += 1

    def _slots(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((keys * _MULTIPLIER >> self.shift) + np.uint64(step)) & self.mask

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys were not found."""
        values = np.zeros(len(keys), np.int64)
        missing = np.ones(len(keys), bool)
        open_, step = np.arange(len(keys)), 0
        while len(open_):
            slots = self._slots(keys[open_], step)
            there = self.keys[slots]
            hit = there == keys[open_]
            values[open_[hit]] = self.values[slots[hit]]
            missing[open_[hit]] = False
            open_ = open_[~hit & (there != 0)]
            step += 1
        return values, missing


def count_grams(texts: DataFrame, order: int) -> DataFrame:
    """(g, n): how often each n-gram occurs in the column ``text``. A task adds up its own before the shuffle."""

    def run(batches):
        held: list[tuple] = []

        def merged():
            keys = np.concatenate([h[0] for h in held])
            unique, first, of = np.unique(keys, return_index=True, return_inverse=True)
            counts = np.bincount(of, np.concatenate([h[1] for h in held])).astype(np.int64)
            return unique, counts, np.concatenate([h[2] for h in held])[first]

        def out():
            _, counts, windows = merged()
            grams = [w.tobytes().decode("utf-32-le") for w in windows]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(counts, pa.int64())], ["g", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                values = batch.column(0).slice(at, 512).to_pylist()
                for part in _slices(values):
                    grams = _Grams.read(values[part.start : part.stop], order)
                    keys, first, counts = np.unique(grams.keys, return_index=True, return_counts=True)
                    held.append((keys, counts, grams.codes[grams.places[first][:, None] + np.arange(order)]))
                    if sum(len(h[0]) for h in held) > GATHER:
                        held[:] = [merged()]
                        if len(held[0][0]) > GATHER // 2:
                            yield from out()
        if held:
            yield from out()
        give_back()

    rows = texts.select("text").mapInArrow(run, "g string, n long")
    return rows.groupBy("g").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Counts of a Kneser-Ney model as tables, one row per n-gram or context, and its discounts.

    ``grams``: (k, g, n): n-grams of every order k; n counts occurrences for the highest order, else different
    characters in front. ``contexts``: (k, c, gamma, total): what is left for lower orders after the context c.
    """

    order: int
    grams: DataFrame
    contexts: DataFrame
    discounts: dict[int, tuple[float, float, float]]
    n_characters: int

    def _discount(self, k: int):
        one, two, more = self.discounts[k]
        return F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)

    def probabilities(self, wanted: DataFrame) -> DataFrame:
        """(g, p) for every different n-gram ``g`` of the highest order in ``wanted``.

        From order 1 up, n-grams meet their counts, their contexts and the next lower order in joins on the n-gram.
        """
        need = {self.order: stored(wanted.select("g").distinct(), "wanted")}
        for k in range(self.order - 1, 0, -1):
            need[k] = stored(need[k + 1].select(F.expr("substring(g, 2)").alias("g")).distinct(), "wanted")
        lower = None
        for k in range(1, self.order + 1):
            counts = self.grams.filter(F.col("k") == k).select("g", "n")
            rows = need[k].withColumn("c", F.expr(f"substring(g, 1, {k - 1})")).join(counts, "g", "left")
            left_over = self.contexts.filter(F.col("k") == k).select("c", "gamma", "total")
            if k == 1:
                rows = rows.crossJoin(F.broadcast(left_over.drop("c").limit(1)))
                rows = rows.withColumn("lower", F.lit(1.0 / (self.n_characters + 1)))
            else:
                rows = rows.join(left_over, "c", "left").withColumn("suffix", F.expr("substring(g, 2)"))
                rows = rows.join(lower, "suffix")
            own = F.greatest(F.lit(0.0), F.col("n") - self._discount(k)) / F.col("total")
            p = F.coalesce(own, F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("lower")
            name = "g" if k == self.order else "suffix"
            # Stored order by order: each plan stays small, which the driver's memory needs.
            lower = stored(rows.select(F.col("g").alias(name), p.alias("p" if k == self.order else "lower")), "order")
        return lower


def train(texts: DataFrame, order: int = 5) -> Model | None:
    """A model of the whole column ``text``; None if it has no characters."""
    spark = texts.sparkSession
    highest = stored(count_grams(texts, order), "grams")
    by_order = {order: highest}
    for k in range(order - 1, 0, -1):
        by_order[k] = by_order[k + 1].groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("n"))
    grams = None
    for k, df in by_order.items():
        rows = df.select(F.lit(k).alias("k"), "g", "n")
        grams = rows if grams is None else grams.unionByName(rows)
    grams = stored(grams, "model")
    sizes = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
    found = {r.k: r for r in grams.groupBy("k").agg(*sizes, F.count("*").alias("all")).collect()}
    if not found:
        return None
    discounts = {k: _discounts(r.n1, r.n2, r.n3, r.n4) for k, r in found.items()}
    rows = spark.createDataFrame([(k, *d) for k, d in discounts.items()], "k int, d1 double, d2 double, d3 double")
    contexts = (
        grams.withColumn("c", F.expr("substring(g, 1, k - 1)"))
        .groupBy("k", "c")
        .agg(
            F.sum("n").alias("total"),
            F.count_if(F.col("n") == 1).alias("n1"),
            F.count_if(F.col("n") == 2).alias("n2"),
            F.count_if(F.col("n") > 2).alias("n3"),
        )
        .join(F.broadcast(rows), "k")
        .withColumn("gamma", (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total"))
        .select("k", "c", "gamma", "total")
    )
    return Model(order, grams, stored(contexts, "contexts"), discounts, found[1]["all"])


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from how many n-grams were counted once to four times; fixed ones where that is too few."""
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))


def _micro(p) -> F.Column:
    return F.round(F.log(p) * UNIT).cast("long")


def score(documents: DataFrame, model: Model | None, head: int = 1 << 18) -> DataFrame:
    """(doc_id, lang, chars, log_micro): characters and summed log probability of each doc_id's texts.

    The ``head`` most frequent n-grams of the model, a fixed number, are sent to every task, which scores them where the
    text is. All other n-grams of the documents travel, counted per document, to the sharded counts and back as sums.
    """
    order = model.order if model else 5
    table = None
    if model:
        top = _most_frequent(model.grams.filter(F.col("k") == order), head)
        packed = _packed(model.probabilities(top).select("g", _micro(F.col("p")).alias("m")), order).collect()
        keys, values = (np.frombuffer(b"".join(r[i] for r in packed), t) for i, t in ((0, np.uint64), (1, np.int64)))
        table = documents.sparkSession.sparkContext.broadcast((keys, values))
    source = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    fields = "doc_id long, lang string, g string, n long, log_micro long"

    def run(batches):
        find = _Table(*table.value).find if table else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, langs, texts = (batch.column(i).slice(at, 512).to_pylist() for i in range(3))
                for part in _slices(texts):
                    yield _scored(find, order, *(x[part.start : part.stop] for x in (ids, langs, texts)))
        give_back()

    rows = stored(source.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, fields), "scores")
    tail = rows.filter("g is not null")
    totals = rows.filter("g is null").select("doc_id", "lang", F.col("n").alias("chars"), "log_micro")
    if model:
        known = model.probabilities(tail).select("g", _micro(F.col("p")).alias("m"))
        more = tail.join(known, "g").select(
            "doc_id", F.lit(None).cast("string").alias("lang"), F.lit(0).alias("chars"), (F.col("n") * F.col("m")).alias("log_micro")
        )
        totals = totals.unionByName(more)
    return totals.groupBy("doc_id").agg(
        F.min("lang").alias("lang"), F.sum("chars").alias("chars"), F.sum("log_micro").alias("log_micro")
    )


def _most_frequent(grams: DataFrame, most: int) -> DataFrame:
    """The n-grams counted so often that there are at most ``most`` of them, found from a histogram of the counts'
    logarithms, which has a few hundred cells whatever the corpus."""
    cell = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r.cell, r.m) for r in grams.groupBy(cell.alias("cell")).agg(F.count("*").alias("m")).collect()), reverse=True)
    total, least = 0, None
    for c, m in sizes:
        total += m
        if total > most:
            break
        least = c
    return grams.filter(F.lit(False) if least is None else cell >= least)


def _packed(scored: DataFrame, order: int) -> DataFrame:
    """(keys, values): n-grams as keys and their scores, many to a row."""

    def start():
        def work(columns):
            codes = np.frombuffer("".join(columns[0]).encode("utf-32-le"), np.uint32)
            return [[keys_of(codes, order)[::order].tobytes()], [np.array(columns[1], np.int64).tobytes()]]

        return work

    return explode_texts(scored, ["g", "m"], "keys binary, values binary", start, piece_rows=1 << 16)


def _scored(find, order: int, ids: list, langs: list, texts: list) -> pa.RecordBatch:
    """A row with the sum over the head for each text, and one for each n-gram of a text that is not in the head."""
    grams = _Grams.read(texts, order)
    if find:
        values, missing = find(grams.keys)
    else:
        values, missing = np.zeros(len(grams.keys), np.int64), np.zeros(len(grams.keys), bool)
    sums = np.zeros(len(texts), np.int64)
    np.add.at(sums, grams.of, values)
    away = np.flatnonzero(missing)
    order_ = away[np.lexsort((grams.keys[away], grams.of[away]))]
    new = np.ones(len(order_), bool)
    new[1:] = (np.diff(grams.of[order_]) != 0) | (grams.keys[order_][1:] != grams.keys[order_][:-1])
    first = order_[new]
    counts = np.diff(np.append(np.flatnonzero(new), len(order_)))
    owners = grams.of[first].tolist()
    columns = [
        [*ids, *(ids[i] for i in owners)],
        [*langs, *([None] * len(owners))],
        [*([None] * len(texts)), *grams.strings(first)],
        [*(len(t or "") for t in texts), *counts.tolist()],
        [*sums.tolist(), *([0] * len(owners))],
    ]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = ["doc_id", "lang", "g", "n", "log_micro"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def classify(
    documents: DataFrame,
    labels: DataFrame,
    order: int = 5,
    quantile: float = 0.995,
    held_out: int = 5,
    prior_chars: int = 200,
    min_held_out: int = 50,
) -> DataFrame:
    """The verdict on every doc_id: lang, chars, perplexity, limit and kept.

    Trusted are the documents with the label quality 1 and not toxic. One in ``held_out`` of them, by a hash of the id,
    is kept from training; ``limit`` is the ``quantile`` of their adjusted perplexities in the language. A language with
    under ``min_held_out`` of them is cross-fitted: each of its trusted documents counts, scored by a model that was
    trained without its part. Only a language without any gets the quantile of all languages. Adjusting adds ``prior_chars`` characters of average
    perplexity, since short texts scatter. A document is kept if its adjusted perplexity is within the limit.

    Rows with one doc_id (null is one, too) are judged together. Without characters the perplexity is null and the
    document is not kept. Without trusted text nothing is known against any text, and all with characters are kept. A
    null language is a language. Other columns are ignored.
    """
    trusted = (
        labels.filter("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .filter("quality > 0 and toxic = 0")
        .select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(held_out)).cast("int").alias("part"))
    )
    trusted = small(trusted, trusted.count())
    texts = documents.select("doc_id", "text").join(trusted, "doc_id")

    def scored(rows: DataFrame, part: int) -> DataFrame:
        return stored(score(rows, train(texts.filter(F.col("part") != part).select("doc_id", "text"), order)), "perplexity")

    scores = scored(documents, 0)
    known = scores.join(trusted, "doc_id").filter("chars > 0")
    shown = known.filter("part = 0")
    mean = shown.agg((F.sum("log_micro") / F.sum("chars")).alias("m")).first().m or 0.0
    adjusted = (F.lit(prior_chars * mean) + F.col("log_micro")) / (F.col("chars") + prior_chars)
    cell = F.floor(-adjusted / UNIT * 1000).cast("long")
    overall = _limits(shown.select(F.lit(None).cast("string").alias("lang"), cell.alias("cell")), quantile)
    everywhere = {r.cell for r in overall.collect()}
    fallback = F.lit(everywhere.pop() if everywhere else None).cast("long")
    # One row for each language that has few held-out documents.
    few = known.groupBy("lang").agg(F.count_if(F.col("part") == 0).alias("held")).filter(F.col("held") < min_held_out)
    few = stored(few.select(F.col("lang").alias("l")), "languages")
    asked = known.join(F.broadcast(few), F.col("lang").eqNullSafe(F.col("l")), "left_semi").filter("part > 0")
    asked = stored(asked.select("doc_id", "part"), "cross-fitted")
    for part in sorted(r.part for r in asked.select("part").distinct().collect()):
        ids = asked.filter(F.col("part") == part).select("doc_id")
        shown = shown.unionByName(scored(documents.join(small(ids, ids.count()), "doc_id", "left_semi"), part).withColumn("part", F.lit(part)))
    limits = _limits(shown.select("lang", cell.alias("cell")), quantile)
    rows = scores.join(F.broadcast(limits.withColumnRenamed("lang", "l")), F.col("lang").eqNullSafe(F.col("l")), "left")
    most = F.coalesce(limits["cell"], fallback)
    return rows.select(
        "doc_id",
        "lang",
        "chars",
        F.when(F.col("chars") > 0, F.exp(-F.col("log_micro") / F.col("chars") / UNIT)).alias("perplexity"),
        F.exp((most + 1) / 1000).alias("limit"),
        ((F.col("chars") > 0) & F.coalesce(cell <= most, F.lit(True))).alias("kept"),
    )


def _limits(shown: DataFrame, quantile: float) -> DataFrame:
    """(lang, cell): the quantile in each language, from a histogram of cells.

    A language has at most a few thousand cells, whatever the number of documents, so their running sum is a small
    window for each language.
    """
    cells = shown.groupBy("lang", "cell").agg(F.count("*").alias("n"))
    up_to = F.expr("sum(n) over (partition by lang order by cell rows unbounded preceding)")
    whole = F.expr("sum(n) over (partition by lang)")
    reached = cells.select("lang", "cell", up_to.alias("up_to"), whole.alias("whole"))
    return (
        reached.filter(F.col("up_to") >= F.col("whole") * quantile)
        .groupBy("lang")
        .agg(F.min("cell").alias("cell"))
    )
