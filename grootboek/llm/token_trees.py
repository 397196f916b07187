"""Edit-aware token counts: a segment tree per document holds characters and tokens of stretches of pre-tokens; an edit
re-encodes only the stretches that it touches, with boundary context, and updates the sums above them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grootboek.llm.common import explode_texts
from grootboek.llm.tokens import byte_tokens

TREE = "chars array<int>, tokens array<int>"
#: A leaf holds pre-tokens of about so many characters.
LEAF = 192
#: A space or line feed between two characters that are no white space always starts a new pre-token.
_CUT = re.compile(r"(?<=\S)[ \n](?=\S)")


class Tree:
    """Sums over the leaves of a text. Node i stands over nodes 2i and 2i + 1; the leaves are the second half."""

    def __init__(self, chars: list[int], tokens: list[int], count: Callable[[str], int]):
        self.chars, self.tokens, self.count = chars, tokens, count
        self.leaves = len(chars) // 2
        #: Characters encoded by edits so far.
        self.encoded = 0

    @classmethod
    def build(cls, text: str, count: Callable[[str], int], leaf: int = LEAF) -> Tree:
        edges = [0]
        while m := _CUT.search(text, edges[-1] + leaf):
            edges.append(m.start())
        edges.append(len(text))
        parts = [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        size = 1
        while size < len(parts):
            size *= 2
        pad = [0] * (size - len(parts))
        tree = cls([0] * size + [len(p) for p in parts] + pad, [0] * size + [count(p) for p in parts] + pad, count)
        for i in range(size - 1, 0, -1):
            tree._add_up(i)
        return tree

    def _add_up(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a place, or the last one, and where the leaf starts."""
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            # An empty right half has nothing to go to.
            if place - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node, start

    def _set(self, first: int, last: int, chars: int, tokens: int) -> None:
        """The first of some neighbouring leaves takes all, the others become empty; only nodes above them change."""
        for leaf in range(first, last + 1):
            self.chars[leaf] = self.tokens[leaf] = 0
        self.chars[first], self.tokens[first] = chars, tokens
        while first > 1:
            first, last = first // 2, last // 2
            for node in range(first, last + 1):
                self._add_up(node)

    def edit(self, text: str, start: int, end: int, new: str) -> str:
        """The text with ``text[start:end]`` replaced, and the tree brought up to date."""
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        edited = text[:start] + new + text[end:]
        first, low = self.leaf_at(start)
        last, at = self.leaf_at(end)
        high = at + self.chars[last] + len(edited) - len(text)
        while low > 0 and not _CUT.match(edited, low):
            first, low = self.leaf_at(low - 1)
        while high < len(edited) and not _CUT.match(edited, high):
            last, at = self.leaf_at(high - len(edited) + len(text))
            high = at + self.chars[last] + len(edited) - len(text)
        region = edited[low:high]
        self.encoded += len(region)
        self._set(first, last, len(region), self.count(region))
        return edited


def _counter(tokenizer: str) -> Callable[[str], int]:
    encode = byte_tokens(tokenizer).encode
    return lambda text: len(encode(text)) if text else 0


def trees(documents: DataFrame, keep: list[str], tokenizer: str) -> DataFrame:
    """The ``keep`` columns, ``text`` (null: empty) and its tree, as ``chars`` and ``tokens`` of all nodes; node 1 is
    the whole text. The tokens are those of the tokenizers library with ``add_special_tokens=False``."""
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)

    def start():
        count = _counter(tokenizer)

        def work(columns):
            texts = [t or "" for t in columns[-1]]
            made = [Tree.build(t, count) for t in texts]
            return [*columns[:-1], texts, [t.chars for t in made], [t.tokens for t in made]]

        return work

    return explode_texts(documents, [*keep, "text"], f"{kinds}, text string, {TREE}", start)


def edited(rows: DataFrame, keep: list[str], tokenizer: str) -> DataFrame:
    """The rows of ``trees``, with an array ``edits`` of (start, end, new) each, after their edits.

    Edits happen in the order of the array, each on the text as the ones before have left it; ``start`` and ``end`` are
    places in characters, moved into the text where they lie outside, and an ``end`` before ``start`` is ``start``. A
    null array or edit changes nothing; a null ``new`` deletes. More columns: ``n_before``, ``n_after`` (tokens),
    ``n_edits`` and ``n_encoded`` (characters that edits had to encode). The tree is that of the edited text, so that
    the result can be stored and edited again.
    """
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    fields = f"{kinds}, text string, {TREE}, n_before long, n_after long, n_edits long, n_encoded long"

    def start():
        count = _counter(tokenizer)

        def one(chars, tokens, edits, text):
            tree = Tree(chars, tokens, count)
            before, done = tree.total(), 0
            for e in edits or []:
                if e is not None and e["start"] is not None and e["end"] is not None:
                    text = tree.edit(text, e["start"], e["end"], e["new"] or "")
                    done += 1
            return text, tree.chars, tree.tokens, before, tree.total(), done, tree.encoded

        def work(columns):
            *kept, chars, tokens, edits, texts = columns
            made = [one(*x) for x in zip(chars, tokens, edits, texts, strict=True)]
            return [*kept, *(list(c) for c in zip(*made, strict=True))]

        return work

    return explode_texts(rows, [*keep, "chars", "tokens", "edits", "text"], fields, start)


def spread_edits(key: Column, length: Column, news: list[str], longest: int = 40) -> Column:
    """An array of one edit per entry of ``news``, at places and of lengths that depend on a hash of the key."""

    def one(i: int, new: str) -> Column:
        start = F.pmod(F.xxhash64(key, F.lit(i)), length + 1).cast("int")
        size = F.pmod(F.xxhash64(key, F.lit(-1 - i)), F.lit(longest)).cast("int")
        return F.struct(start.alias("start"), (start + size).alias("end"), F.lit(new).alias("new"))

    return F.array(*[one(i, new) for i, new in enumerate(news)])
