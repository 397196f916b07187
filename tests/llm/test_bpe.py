import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from grootboek.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "",
    "   ",
    "ΑΣ ΟΔΟΣ Σ İstanbul I'm you'LL don't 's'S",
    "a\x1cb \x1d c \x85a b",
    "<|startoftext|>a b<|endoftext|> <|endoftext|",
    "é Å ﬁ ñ 日本語 😀👍🏽 123４５ ²",
    "a" * 5000 + " " + "ab" * 3000 + "<|endoftext|>" + "!" * 900,
]


def test_ids_and_texts_are_the_librarys():
    rng = random.Random(5)
    alphabet = "ab'sS tΣé<|endoftext|> \n\t!?12 \x1f日😀"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(2000)]
    library, encoder = Tokenizer.from_file(PATH), bpe.Encoder(PATH, words=50, chunks=20)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids
        assert encoder.vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_rows_of_every_kind(spark):
    rows = [(i, t, 1) for i, t in enumerate([*ODD, None])] + [(2, ODD[2], 1), (None, "x y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    library = Tokenizer.from_file(PATH)
    got = bpe.digests(df, ["doc_id"], PATH).collect()
    for (i, text, _), r in zip(rows, got, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        texts = (" ".join(map(str, ids)), decoded)
        assert tuple(r) == (i, len(ids), *(hashlib.sha256(t.encode()).hexdigest() for t in texts))
    assert bpe.digests(df.limit(0), ["doc_id"], PATH).count() == 0
