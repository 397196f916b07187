import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from grootboek.llm import token_trees
from grootboek.llm.tokens import ByteTokens, byte_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "ab cd's  é\n\t12.!? <|endoftext|> ß日😀"


def _text(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def test_ids_are_the_librarys():
    rng = random.Random(3)
    library, own = Tokenizer.from_file(PATH), ByteTokens(PATH)
    for text in ["", "<|endoftext|>", *(_text(rng, rng.randrange(60)) for _ in range(2000))]:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [1, 16, 192])
def test_edits_give_the_count_of_the_edited_text(leaf):
    rng = random.Random(leaf)
    count = lambda t: len(byte_tokens(PATH).encode(t))
    for _ in range(150):
        text = _text(rng, rng.randrange(400))
        tree = token_trees.Tree.build(text, count, leaf)
        assert tree.total() == count(text)
        for _ in range(8):
            a = rng.randrange(-3, len(text) + 5)
            b = a + rng.randrange(-2, 30)
            new = _text(rng, rng.randrange(12))
            low = min(max(a, 0), len(text))
            plain = text[:low] + new + text[min(max(b, low), len(text)) :]
            text = tree.edit(text, a, b, new)
            assert text == plain and tree.total() == count(text) and tree.chars[1] == len(text)


def test_an_edit_encodes_little():
    count = lambda t: len(byte_tokens(PATH).encode(t))
    text = "some words in a row " * 20_000
    tree = token_trees.Tree.build(text, count)
    tree.edit(text, 200_000, 200_010, "other")
    assert tree.encoded < 1000


def test_rows_of_every_kind(spark):
    edits = "array<struct<start:int,end:int,new:string>>"
    rows = [
        (1, "one two three", [(0, 3, "1"), (2, 2, None), None]),
        (1, "one two three", []),
        (None, None, None),
        (2, "", [(5, 9, "now there is text"), (None, 2, "x")]),
        (3, "word " * 50_000, [(100_000, 100_004, "")]),
    ]
    df = spark.createDataFrame([(*r, 7) for r in rows], f"doc_id long, text string, edits {edits}, chars int")
    done = token_trees.edited(token_trees.trees(df, ["doc_id", "edits"], PATH), ["doc_id"], PATH).collect()
    library = Tokenizer.from_file(PATH)
    assert {(r.doc_id, r.text) for r in done} >= {(1, "1 two three"), (None, ""), (2, "now there is text")}
    for r in done:
        assert r.n_after == len(library.encode(r.text, add_special_tokens=False).ids) == r.tokens[1]
    assert sorted(r.n_edits for r in done) == [0, 0, 1, 1, 2]
    assert token_trees.trees(df.limit(0), ["doc_id", "edits"], PATH).count() == 0
