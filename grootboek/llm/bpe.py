"""Byte-pair encoding with a priority queue of merge ranks over a doubly linked list of symbols, and decoding by
concatenating vocabulary strings.

The vocabulary is that of a public tokenizer file with word ends: lower case, white space dropped.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from grootboek.llm.common import Recent, map_texts

#: White space as the tokenizer's patterns see it; Python's own splitting knows four control characters more.
_SPACE = regex.compile(r"\p{White_Space}+")
_CONTROL = regex.compile(r"[\x1c-\x1f]")
#: Words of the vocabulary's pre-tokenizer. Fixed values.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
WORD_END = "</w>"
FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else the next free one from 256 on."""
    prints = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b for b in range(256)]
    return [chr(b if prints[b] else 256 + prints[:b].count(False)) for b in range(256)]


class Vocabulary:
    """Symbols, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.ids: dict[str, int] = dict(content["model"]["vocab"])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.strings = {i: s for s, i in (self.ids | self.special).items()}
        ids = self.ids
        #: Rank and resulting symbol of each pair that merges.
        self.merges = {
            (ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(content["model"]["merges"])
        }
        self.letters = byte_letters()
        longest_first = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.find_special = regex.compile(f"({'|'.join(longest_first)})") if longest_first else None

    def symbols(self, word: str) -> list[int]:
        letters = [self.letters[b] for b in word.encode()]
        letters[-1] += WORD_END
        return [self.ids[x] for x in letters if x in self.ids]

    def encode_word(self, word: str) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until none is left.

        The queue holds (rank, place) of pairs as they were when pushed; an entry is stale when the pair at its place
        has changed since, and is skipped.
        """
        symbols = self.symbols(word)
        n = len(symbols)
        merges = self.merges
        pair_rank = [-1] * n
        queue = []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                pair_rank[i] = found[0]
                queue.append((found[0], i))
        if not queue:
            return symbols
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            rank, i = heapq.heappop(queue)
            if pair_rank[i] != rank:
                continue
            j = after[i]
            symbols[i] = merges[symbols[i], symbols[j]][1]
            symbols[j] = pair_rank[j] = pair_rank[i] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((symbols[i], symbols[k]))
                if found:
                    pair_rank[i] = found[0]
                    heapq.heappush(queue, (found[0], i))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], symbols[i]))
                pair_rank[h] = found[0] if found else -1
                if found:
                    heapq.heappush(queue, (found[0], h))
        return [s for s in symbols if s >= 0]

    def decode(self, ids: list[int]) -> str:
        """The strings of the ids, one space between them."""
        return " ".join(map(self.strings.__getitem__, ids))


def chunks(text: str) -> list[str]:
    """Runs without white space after composing (NFC) and lower-casing; no word of the pre-tokenizer crosses them."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("\N{GREEK CAPITAL LETTER SIGMA}", "\N{GREEK SMALL LETTER SIGMA}")
    text = text.lower()
    return [c for c in _SPACE.split(text) if c] if not text.isascii() or _CONTROL.search(text) else text.split()


class Encoder:
    """Encodes texts with a bounded memo of what was encoded lately, for words and for chunks of words."""

    def __init__(self, path: str, words: int = 250_000, chunks: int = 150_000):
        self.vocabulary = Vocabulary(path)
        self.words = Recent(self.vocabulary.encode_word, words)
        self.chunks = Recent(self._chunk, chunks)

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal and the decoded text of a chunk."""
        ids = [i for w in _WORD.findall(chunk) for i in (self.words.one(w) if len(w) < 64 else self.vocabulary.encode_word(w))]
        return len(ids), " ".join(map(str, ids)), self.vocabulary.decode(ids)

    def parts(self, text: str) -> list[tuple[int, str, str]]:
        find = self.vocabulary.find_special
        if find is None or "<|" not in text:
            return self._plain(text)
        out = []
        for k, piece in enumerate(find.split(text)):
            if k % 2:
                out.append((1, str(self.vocabulary.special[piece]), piece))
            else:
                out += self._plain(piece)
        return out

    def _plain(self, text: str) -> list[tuple[int, str, str]]:
        found = chunks(text)
        if len(text) > 64 * (len(found) + 1):  # long runs without white space are not worth remembering
            return [self._chunk(c) if len(c) > 256 else self.chunks.one(c) for c in found]
        return self.chunks.many(found)

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.parts(text) for i in p[1].split()]


@lru_cache(1)
def encoder_for(path: str) -> Encoder:
    """One encoder a worker process, so that its memo outlasts a task."""
    return Encoder(path)


def digests(documents: DataFrame, keep: list[str], path: str, text: str = "text") -> DataFrame:
    """The ``keep`` columns and, of each whole text: ``n_tokens``, ``ids_sha256`` (SHA-256 of the decimal ids, joined by
    one space) and ``decoded_sha256`` (of the text decoded from the ids).

    A null or empty text has no tokens, and the digests are those of the empty text. ``path``: the vocabulary file,
    which every machine has. Repeated rows are encoded each for itself; other columns are ignored.
    """

    def start():
        encoder = encoder_for(path)

        def one(text: str | None) -> tuple[int, str, str]:
            parts = [p for p in encoder.parts(text or "") if p[0]]
            ids, decoded = " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in (ids, decoded)]
            return sum([p[0] for p in parts]), *digest

        return lambda texts: [list(c) for c in zip(*map(one, texts), strict=True)]

    return map_texts(documents, keep, text, FIELDS, start)
