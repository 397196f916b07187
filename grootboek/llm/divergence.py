"""Source divergence audit: the counts of terms in each source are run-length columns over a vocabulary that is ordered
so that equal counts stand together; two columns are compared run by run."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grootboek.llm.common import explode_texts, small, stored
from grootboek.llm.gathering import gathered

#: Bytes that are letters of a term, with A-Z in lower case; all others part terms. Fixed values of the audit.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The unit of a probability, and what is added to every count. Fixed values of the audit.
UNIT, PRIOR = 1_000_000_000, 2
#: A task passes its counts on when it holds so many.
HELD = 100_000
#: Groups to a row of the table of sizes that may be sent to every task.
FEW = 200_000
RESULT = ["lang", "source", "part", "item", "value", "rank"]


@dataclass(frozen=True)
class Rule:
    """Terms in at least ``least`` rows of their lang are kept; ``top`` terms are listed for each group. A chunk of the
    columns has up to ``chunk`` different rows."""

    least: int = 10
    top: int = 10
    chunk: int = 4096


def counted(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): how often a term occurs in a group and in how many of its rows, summed within tasks
    as far as memory allows; a term may have several such rows."""

    def start():
        held: dict[tuple, dict] = {}

        def rest():
            rows = [(*group, term.decode(), *x) for group, terms in held.items() for term, x in terms.items()]
            held.clear()
            return [list(c) for c in zip(*rows, strict=True)] or None

        def work(columns):
            for lang, source, text in zip(*columns, strict=True):
                terms = held.setdefault((lang, source), {})
                counts: dict[bytes, int] = {}
                for word in text.encode().translate(LETTERS).split():
                    counts[word] = counts.get(word, 0) + 1
                for word, n in counts.items():
                    known = terms.get(word)
                    if known is None:
                        terms[word] = [n, 1]
                    else:
                        known[0] += n
                        known[1] += 1
            return rest() if sum(map(len, held.values())) > HELD else None

        return work, rest

    fields = "lang string, source string, term string, n long, df long"
    return gathered(documents, ["lang", "source", "text"], fields, start)


def groups(documents: DataFrame) -> DataFrame:
    """(lang, source, pos): all groups that occur; ``pos`` counts from 1 in a lang, from its smallest group."""
    sizes = documents.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    order = Window.partitionBy("lang").orderBy("rows", "source")
    return sizes.withColumn("pos", F.row_number().over(order)).drop("rows")


def vocabulary(counts: DataFrame, known: DataFrame, rule: Rule) -> DataFrame:
    """(lang, term, n, by): the kept terms, their count in the lang, and in each group that has them (pos, n).

    ``by`` is no longer than a lang has sources, and the audit has a row for every pair of those.
    """
    placed = counts.join(known, ["lang", "source"]).select("lang", "term", "pos", "n", "df")
    # Dealt by the term alone, so that both sums below need no other shuffle.
    each = placed.repartition("lang", "term").groupBy("lang", "term", "pos").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    by = F.sort_array(F.collect_list(F.struct("pos", "n")), asc=False)
    whole = each.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"), by.alias("by"))
    return whole.filter(F.col("df") >= rule.least).select("lang", "term", "n", "by")


def sizes_of(terms: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, pos, total) for every group and (lang, kept, all) for every lang: the sum of counts over kept
    terms there, and the number of kept terms."""
    totals = (
        terms.select("lang", F.explode("by").alias("b"))
        .groupBy("lang", F.col("b.pos").alias("pos"))
        .agg(F.sum("b.n").alias("total"))
    )
    of_groups = known.join(totals, ["lang", "pos"], "left").fillna(0, ["total"])
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("all"))
    of_langs = known.select("lang").distinct().join(kept, "lang", "left").fillna(0, ["kept", "all"])
    return of_groups.select("lang", "source", "pos", "total"), of_langs


def probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * kept)), in decimals, which do not overflow."""
    above = (n + PRIOR).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.expr("1L") + F.call_function("div", above, (total + PRIOR * kept).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


# Run-length columns.


def columns(terms: DataFrame, langs: DataFrame, rule: Rule) -> DataFrame:
    """(lang, pos, sizes, ends, counts): chunks of the vocabulary as run-length columns, packed.

    Terms with the same counts in all groups are one row with a weight. Rows are in the order of their counts, those of
    the smallest group first, whose few different counts make long runs; larger groups change within them. Of each group
    with a count in the chunk, ``sizes`` has the number of runs, and ``ends`` and ``counts`` have each run's end, in
    terms, and its count. A lang has one chunk without rows besides, so that all its groups are compared.
    """
    # Descending positions as negative numbers: arrays then sort as the columns would, zeros included.
    key = F.array_sort(F.transform("by", lambda b: F.struct((-b["pos"]).alias("back"), b["n"].alias("n"))))
    alike = stored(terms.select("lang", key.alias("key")).groupBy("lang", "key").agg(F.count("*").alias("weight")), "alike")
    # The range is cut by the head of the key and its hash, so that bounds stay short and no two rows are equal.
    head = [F.col("lang"), F.slice("key", 1, 8), F.xxhash64("key")]
    ordered = alike.repartitionByRange(*head).sortWithinPartitions("lang", "key")

    def start():
        def work(parts):
            made: list[list] = [[], [], [], [], []]
            lang, keys, weights = parts
            cuts = [i for i in range(1, len(lang)) if lang[i] != lang[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(lang)], strict=True):
                for column, value in zip(made, encoded(lang[a], keys[a:b], weights[a:b]), strict=True):
                    column.append(value)
            return made

        return work

    fields = "lang string, pos binary, sizes binary, ends binary, counts binary"
    source = ordered.select("lang", F.transform("key", lambda k: F.array(-k["back"].cast("long"), k["n"])).alias("key"), "weight")
    chunks = explode_texts(source, ["lang", "key", "weight"], fields, start, piece_rows=rule.chunk)
    none = [F.lit(b"").alias(c) for c in ("pos", "sizes", "ends", "counts")]
    return chunks.unionByName(langs.select("lang", *none))


def encoded(lang: str, keys: list, weights: list) -> tuple:
    """A chunk of rows as run-length columns: each row has (pos, count) pairs and a weight."""
    flat = np.array([pair for key in keys for pair in key], np.int64).reshape(-1, 2)
    row = np.repeat(np.arange(len(keys)), [len(key) for key in keys])
    ends = np.cumsum(np.array(weights, np.int64))
    pos, place = np.unique(flat[:, 0], return_inverse=True)
    sizes, of_ends, of_counts = [], [], []
    for g in range(len(pos)):
        mine = place == g
        column = np.zeros(len(keys), np.int64)
        column[row[mine]] = flat[mine, 1]
        last = np.append(np.flatnonzero(column[1:] != column[:-1]), len(keys) - 1)
        sizes.append(len(last))
        of_ends.append(ends[last])
        of_counts.append(column[last])
    packed = [np.concatenate(x).astype(np.int64).tobytes() if len(x) else b"" for x in (of_ends, of_counts)]
    return lang, pos.astype(np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), *packed


def scaled(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """The probabilities of counts, exactly: a division in three steps of a thousand, so that 64 bits suffice."""
    below = total + PRIOR * kept
    whole, left = np.divmod(counts + PRIOR, below)
    for _ in range(3):
        digits, left = np.divmod(left * 1000, below)
        whole = whole * 1000 + digits
    return 1 + whole


def compared(chunks: DataFrame, sizes: DataFrame, langs: DataFrame, n_groups: int) -> DataFrame:
    """(lang, a, b, value): the divergence of every two groups of a lang, a < b, summed over all its chunks.

    The boundaries of two columns' runs are merged; between two of them neither count changes, so that the divergence is
    reckoned once and multiplied by the number of terms. A task sums over its chunks.
    """
    listed = (
        sizes.groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "total"))).alias("g"))
        .join(langs, "lang")
        .select("lang", "g.total", "kept")
    )
    given = chunks.join(small(listed, n_groups, FEW), "lang")

    def start():
        held: dict[str, np.ndarray] = {}

        def rest():
            made = [[], [], [], []]
            for lang, sums in held.items():
                a, b = np.triu_indices(len(sums), 1)
                for column, values in zip(made, ([lang] * len(a), (a + 1).tolist(), (b + 1).tolist(), sums[a, b].tolist()), strict=True):
                    column += values
            held.clear()
            return made if made[0] else None

        def work(parts):
            for lang, pos, run_sizes, ends, counts, totals, kept in zip(*parts, strict=True):
                n = len(totals)
                sums = held.setdefault(lang, np.zeros((n, n), np.int64))
                add_chunk(sums, *(np.frombuffer(x, np.int64) for x in (pos, run_sizes, ends, counts)), totals, kept)
            return rest() if sum(x.size for x in held.values()) > 1 << 21 else None

        return work, rest

    wanted = ["lang", "pos", "sizes", "ends", "counts", "total", "kept"]
    partial = gathered(given, wanted, "lang string, a int, b int, value long", start, piece_rows=16)
    return partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def add_chunk(sums, pos, sizes, ends, counts, totals: list, kept: int) -> None:
    """Adds a chunk's divergences to ``sums``, which has a row and a column for each group of the lang."""
    if not len(ends):
        return
    bounds = np.cumsum(np.append(0, sizes))
    own = {int(p) - 1: slice(a, b) for p, a, b in zip(pos, bounds, bounds[1:], strict=False)}
    width = int(ends[bounds[1] - 1])
    runs = []
    for g, total in enumerate(totals):
        if g in own:
            runs.append((ends[own[g]], scaled(counts[own[g]], total, kept)))
        else:
            runs.append((np.array([width]), scaled(np.zeros(1, np.int64), total, kept)))
    for a in range(len(totals)):
        ends_a, p = runs[a]
        for b in range(a + 1, len(totals)):
            ends_b, q = runs[b]
            if len(ends_b) == 1:
                merged, p_at, q_at = ends_a, p, q
            elif len(ends_a) == 1:
                merged, p_at, q_at = ends_b, p, q
            else:
                merged = np.unique(np.concatenate([ends_a, ends_b]))
                p_at, q_at = p[np.searchsorted(ends_a, merged)], q[np.searchsorted(ends_b, merged)]
            apart = p_at - q_at
            sums[a, b] += int((apart * apart // (p_at + q_at) * np.diff(merged, prepend=0)).sum())


# The audit.


def audit(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the terms of each (lang, source) group are from those of every
    other source of the lang (part ``pair``, all ranks), and the terms that it has more of than its lang (part ``term``,
    the first ``rule.top``). Higher values come first, equal ones by item.

    Null texts, langs and sources are empty strings. Every row is a document of its own, repeated ones too. A group
    without terms is compared like any other; in a lang without kept terms all pairs have the value 0. A lang with one
    source has no pairs. An empty table has no rows.
    """
    rows = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    known = stored(groups(rows), "groups")
    n_groups = known.count()
    known = small(known, n_groups, FEW)
    terms = stored(vocabulary(counted(rows), known, rule), "vocabulary")
    sizes, langs = (stored(x, "sizes") for x in sizes_of(terms, known))
    chunks = stored(columns(terms, langs, rule), "columns")
    pairs = compared(chunks, sizes, langs, n_groups)
    return _pairs(stored(pairs, "pairs"), sizes, n_groups).unionByName(_terms(terms, sizes, langs, n_groups, rule))


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _pairs(pairs: DataFrame, sizes: DataFrame, n_groups: int) -> DataFrame:
    both = pairs.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"), "value")
    names = [
        small(sizes.select("lang", F.col("pos").alias(c), F.col("source").alias(name)), n_groups, FEW)
        for c, name in (("a", "source"), ("b", "item"))
    ]
    named = both.select("lang", "e.a", "e.b", "value").join(names[0], ["lang", "a"]).join(names[1], ["lang", "b"])
    return _ranked(named, "pair")


def _terms(terms: DataFrame, sizes: DataFrame, langs: DataFrame, n_groups: int, rule: Rule) -> DataFrame:
    each = terms.select("lang", "term", F.col("n").alias("of_lang"), F.explode("by").alias("b"))
    flat = each.select("lang", "term", "of_lang", "b.pos", "b.n").filter("n > 0")
    given = small(sizes.join(langs, "lang"), n_groups, FEW)
    p, q = probability(F.col("n"), F.col("total"), F.col("kept")), probability(F.col("of_lang"), F.col("all"), F.col("kept"))
    scored = flat.join(given, ["lang", "pos"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    over = scored.filter("p > q").withColumn("value", divergence(F.col("p"), F.col("q")))
    return _ranked(over, "term", rule.top)
