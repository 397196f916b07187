"""Ids of a byte-level vocabulary: those of the tokenizers library, made by the faster tiktoken where both agree."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from grootboek.llm.bpe import byte_letters

#: The byte-level pre-tokenizer's words. Fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Both libraries know the letters, digits and spaces below this place alike; beyond it their Unicode versions differ.
_BEYOND = re.compile("[^\x00-ͷ]")


class ByteTokens:
    """Texts to ids, as the tokenizers library encodes them with ``add_special_tokens=False``."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        vocabulary = model["vocab"]
        ranks = {bytes(map(byte.__getitem__, s)): i for s, i in vocabulary.items()}
        merged = [vocabulary[a + b] for a, b in model["merges"]]
        # A merge's rank must be the id that it makes; otherwise the slower library does all.
        self.fast = (
            tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            if merged == sorted(merged)
            else None
        )

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or _BEYOND.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(array("I", self.fast.encode_ordinary(text)), "<u4")


@lru_cache(1)
def byte_tokens(path: str) -> ByteTokens:
    """One a worker process: reading the vocabulary takes longer than a small task."""
    return ByteTokens(path)
