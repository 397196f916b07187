"""Licence scans: an Aho-Corasick pass finds notice phrases and identifier tags; the expression after a tag is parsed
by the shunting-yard method and evaluated."""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from grootboek.llm.common import map_texts

#: Phrases every scan counts. Fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases and their labels.
NOTICES = {
    "mit license": "mit",
    "apache license": "apache",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "bsd license": "bsd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
}
TAG = "spdx license identifier"
#: How freely text under a licence may be reused: 1 permissive, 0.5 with conditions on changed copies, 0.25 with
#: conditions on everything joined to it, 0 not at all. By the first name that an identifier starts with.
FREEDOM = {
    "cc0": 1.0,
    "public-domain": 1.0,
    "unlicense": 1.0,
    "mit": 1.0,
    "bsd": 1.0,
    "isc": 1.0,
    "zlib": 1.0,
    "apache": 1.0,
    "cc-by-nc": 0.0,
    "cc-by-nd": 0.0,
    "cc-by-sa": 0.5,
    "cc-by": 1.0,
    "mpl": 0.5,
    "epl": 0.5,
    "lgpl": 0.5,
    "agpl": 0.25,
    "gpl": 0.25,
    "reserved": 0.0,
}
#: Linking exceptions turn conditions on everything into conditions on changed copies.
WITH_EXCEPTION = 0.5
BINDS = {"or": 1, "and": 2, "with": 3}

FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "expression string"
)

_SPACED = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_PART = re.compile(r"\s*([()]|[0-9a-z.+:-]+)")


def freedom(name: str) -> float:
    """Of a licence identifier; unknown names count as not free."""
    for known, value in FREEDOM.items():
        if name == known or name.startswith((known + "-", known + "+")):
            return value
    return 0.0


def parse(expression: str) -> tuple[list[str], float] | None:
    """Identifiers and freedom of a licence expression in lower case, or None if it is none.

    ``or`` is as free as its freer side, ``and`` as its stricter one; ``with`` binds closest, then ``and``. Reading
    ends where the line stops being an expression, as in a closing comment mark.
    """
    output: list[float] = []
    waiting: list[str] = []
    names: list[str] = []

    def apply() -> bool:
        operator = waiting.pop()
        if operator == "(" or len(output) < 2:
            return False
        right, left = output.pop(), output.pop()
        if operator == "or":
            output.append(max(left, right))
        elif operator == "and":
            output.append(min(left, right))
        else:
            output.append(max(left, WITH_EXCEPTION))
        return True

    at, operand, exception = 0, True, False
    while m := _PART.match(expression, at):
        part = m[1]
        if operand:
            if part == ")" or part in BINDS or (exception and part == "("):
                return None
            if part == "(":
                waiting.append("(")
            else:
                if not any(c.isalnum() for c in part):
                    break
                output.append(0.0 if exception else freedom(part))
                names += [] if exception else [part]
                operand = exception = False
        elif part == ")":
            while waiting and waiting[-1] != "(":
                if not apply():
                    return None
            if not waiting:
                break
            waiting.pop()
        elif part in BINDS:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[part]:
                if not apply():
                    return None
            waiting.append(part)
            operand, exception = True, part == "with"
        else:
            break
        at = m.end()
    if operand:
        return None
    while waiting:
        if not apply():
            return None
    return (sorted(set(names)), output[0]) if len(output) == 1 else None


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def _expression_after(raw: bytes, word: int) -> str | None:
    """What follows the tag whose last word has this number, to the end of its line; None without a colon."""
    end = next(m.end() for i, m in enumerate(_WORD.finditer(raw)) if i == word)
    line = raw[end:].split(b"\n", 1)[0].decode("utf-8", "replace").strip()
    return line[1:].strip().lower() if line.startswith(":") else None


def _scan(found: ahocorasick.Automaton, text: str | None) -> tuple:
    raw = (text or "").encode()
    words = raw.translate(_SPACED).split()
    spaced = f" {b' '.join(words).decode()} "
    n_base, first, last = 0, None, None
    base: set[str] = set()
    labels: set[str] = set()
    free: list[float] = []
    read: list[str] = []
    for end, phrase in found.iter(spaced):
        start = end - len(phrase) - 1
        if phrase in BASE:
            n_base += 1
            place = spaced.count(" ", 0, start)
            first = place if first is None else min(first, place)
            last = place if last is None else max(last, place)
            base.add(BASE[phrase])
            free.append(freedom(BASE[phrase]))
        if phrase in NOTICES:
            labels.add(NOTICES[phrase])
            free.append(freedom(NOTICES[phrase]))
        if phrase == TAG:
            line = _expression_after(raw, spaced.count(" ", 0, start) + TAG.count(" "))
            value = None if line is None else parse(line)
            if value is None:
                labels.add("spdx:unreadable")
                free.append(0.0)
            else:
                labels.update(f"spdx:{x}" for x in value[0])
                free.append(value[1])
                read.append(line)
    return (
        len(words),
        n_base,
        first,
        last,
        ",".join(sorted(base)),
        ",".join(sorted(base | labels)),
        min(free, default=0.0),
        "\n".join(read) or None,
    )


def scan(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and what each whole text says about its licence.

    ``n_words``: words of ASCII letters (lower-cased), digits and characters beyond ASCII. ``n_base``, ``first_word``,
    ``last_word``, ``base_labels``: all places of the base phrases, overlapping ones included. ``labels`` adds further
    notices and the identifiers of licence expressions. ``score``: the strictest of all notices, as freedom of reuse
    from 0 to 1; 0 without any. ``expression``: the readable expressions, one a line, else null.

    A null or empty text has no words and empty labels. Repeated rows are scanned each for itself; other columns of the
    input are ignored. A tag whose expression cannot be read is labelled ``spdx:unreadable`` and counts as not free.
    """

    def start():
        found = _automaton()
        return lambda texts: [list(c) for c in zip(*(_scan(found, t) for t in texts), strict=True)]

    return map_texts(documents, keep, text, FIELDS, start)
