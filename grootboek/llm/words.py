"""Words of many texts at once, as hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STEP = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(STEP, -1, 1 << 64))
_MULTIPLIER = np.uint64(STEP)
#: Words are hashed in segments of so many bytes: eight bytes a byte, several times over, are needed meanwhile.
SEGMENT = 1 << 18
_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


@dataclass
class Words:
    """The words of some texts, cut at ASCII white space, each as a hash of 64 bits of its ASCII-lower-case bytes.

    ``starts``: where words begin in the joined bytes; ``of``: the text that a word is in; ``first``: each text's first
    word.
    """

    hashes: np.ndarray
    starts: np.ndarray
    of: np.ndarray
    first: np.ndarray

    @classmethod
    def read(cls, texts: list) -> Words:
        raws = [(t or "").encode() for t in texts]
        raw = np.frombuffer(b" ".join(raws).lower() + b" ", np.uint8)
        space = _IS_SPACE[raw]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        starts, ends = edge[::2], edge[1::2]
        offsets = np.cumsum([0, *(len(r) + 1 for r in raws)])[:-1]
        of = np.searchsorted(offsets, starts, side="right") - 1
        hashes = np.empty(len(starts), np.uint64)
        cuts = np.searchsorted(starts, np.arange(0, len(raw) + SEGMENT, SEGMENT))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            if a < b:
                runs = Runs(raw[starts[a] : ends[b - 1]].astype(np.uint64) + np.uint64(1))
                hashes[a:b] = runs.hash(starts[a:b] - starts[a], ends[a:b] - starts[a:b])
        return cls(hashes, starts, of, np.searchsorted(of, np.arange(len(texts))))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Runs:
    """Hashes of runs of numbers, each from two prefix sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        up, down = np.full(n + 1, _MULTIPLIER), np.full(n + 1, _BACK)
        up[0] = down[0] = 1
        self.down = np.multiply.accumulate(down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * np.multiply.accumulate(up)[:n], out=self.sums[1:])

    def hash(self, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return mixed((self.sums[starts + size] - self.sums[starts]) * self.down[starts])
