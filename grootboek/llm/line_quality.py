"""Quality rules: a linear-chain conditional random field labels every line as content or boilerplate by Viterbi
decoding; the share of words in content lines decides whether a document stays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grootboek.llm.common import explode_texts, map_texts

#: The base rule. Fixed values.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines long, n_content_lines long, content_share double"
)

CONTENT, BOILERPLATE = 0, 1
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_BARS = b"|"
_MARKS = b"!?"

#: Each line has one value of each of these features: the number of thresholds that it reaches.
STEPS = {
    "words": (2, 4, 8, 16, 40),
    "chars_per_word": (3, 5, 8, 12),
    "symbols_per_word": (0.02, 0.1, 0.3, 0.7),
    "upper_per_char": (0.03, 0.1, 0.4),
    "digits_per_char": (0.02, 0.1, 0.3),
    "bars_per_word": (0.02, 0.2),
    "marks_per_word": (0.05, 0.2, 0.6),
    "repeats_per_word": (0.1, 0.3, 0.5, 0.8),
    "same_line_before": (1,),
    "ends_sentence": (1,),
    "first_or_last": (1, 2),
}
_OFFSETS = np.cumsum([0] + [len(v) + 1 for v in STEPS.values()])
N_FEATURES = int(_OFFSETS[-1])


@dataclass(frozen=True)
class LineField:
    """Weights of the field: per feature value and label, and per pair of neighbouring labels."""

    emission: np.ndarray
    transition: np.ndarray

    def content(self, features: np.ndarray) -> np.ndarray:
        """Which lines are content, on the best path of labels. A tie goes to content."""
        scores = self.emission[features].sum(axis=1)
        n, (stay_c, c_to_b), (b_to_c, stay_b) = len(scores), *self.transition.tolist()
        c, b = scores[0].tolist()
        back = []
        for here_c, here_b in scores[1:].tolist():
            from_c, from_b = c + stay_c >= b + b_to_c, c + c_to_b > b + stay_b
            back.append((from_c, from_b))
            c, b = (
                (c + stay_c if from_c else b + b_to_c) + here_c,
                (c + c_to_b if from_b else b + stay_b) + here_b,
            )
        is_content = c >= b
        path = np.empty(n, bool)
        path[-1] = is_content
        for i in range(n - 2, -1, -1):
            is_content = back[i][0] if is_content else back[i][1]
            path[i] = is_content
        return path


def _line_values(lines: list[bytes]) -> tuple[np.ndarray, list[int], int]:
    """Feature values of the lines that have a word, their word counts, and how many repeat an earlier line."""
    seen: set[bytes] = set()
    rows, sizes, dups = [], [], 0
    for raw in lines:
        words = raw.split()
        if not words:
            continue
        n, size = len(words), len(raw)
        chars = sum(map(len, words))
        again = raw in seen
        seen.add(raw)
        dups += again
        sizes.append(n)
        rows.append(
            (
                n,
                chars / n,
                (size - len(raw.translate(None, SYMBOLS))) / n,
                (size - len(raw.translate(None, _UPPER))) / chars,
                (size - len(raw.translate(None, _DIGITS))) / chars,
                (size - len(raw.translate(None, _BARS))) / n,
                (size - len(raw.translate(None, _MARKS))) / n,
                1 - len(set(words)) / n,
                again,
                words[-1][-1:] in b".!?",
                0,
            )
        )
    values = np.array(rows, float).reshape(-1, len(STEPS))
    if len(values):
        values[[0, -1], -1] = 1, 2
    return values, sizes, dups


def _features(values: np.ndarray) -> np.ndarray:
    places = np.empty(values.shape, np.int32)
    for i, steps in enumerate(STEPS.values()):
        places[:, i] = np.searchsorted(steps, values[:, i], side="right") + _OFFSETS[i]
    return places


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` (a power of two) words that occur at least twice, the first one included.

    Windows are numbered by doubling: equal numbers of two halves make equal windows, so there is no hash to collide.
    """
    n = len(words)
    if n <= window or len(set(words)) > n - window:
        # Two equal windows need at least ``window`` places whose word occurs elsewhere too, or they overlap.
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    size = 1
    while size < window:
        pairs = ids[:-size] * n + ids[size:]
        kinds, ids = np.unique(pairs, return_inverse=True)
        size *= 2
        if len(kinds) > len(ids) - (window - size + 1):  # equal windows share so many shorter ones
            return 0
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges)[:n] > 0).sum())


def _judge(field: LineField, min_share: float, text: str | None) -> tuple:
    raw = (text or "").encode()
    words = raw.split()
    lines = raw.split(b"\n")
    values, sizes, dups = _line_values(lines)
    n, repeats = len(words), repeated_words(words)
    chars = len((text or "").translate(_NO_SPACE)) if not raw.isascii() else sum(map(len, words))
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    content = field.content(_features(values)) if sizes else np.empty(0, bool)
    share = float(np.dot(content, sizes)) / n if n else 0.0
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    kept = not failed and share >= min_share
    return n, chars, symbols, dups, repeats, failed, kept, len(sizes), int(content.sum()), share


_NO_SPACE = {c: None for c in (32, *range(9, 14))}


def fit(
    documents: DataFrame,
    labels: DataFrame,
    train_docs: int = 4000,
    train_lines: int = 64,
    rounds: int = 150,
    penalty: float = 1e-3,
) -> LineField:
    """A field fitted on labelled documents: lines of good ones are content, lines of bad ones boilerplate.

    The sample is bounded: at most ``train_docs`` labelled documents, half of either kind, by a hash of the id, and at
    most ``train_lines`` evenly spaced lines of each. Of rows with one id, the one with the smallest hash of its features
    counts. Without documents of both kinds all weights are 0, which
    makes every line content. Fitting maximises the penalised likelihood of the label sequences.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    kinds = [
        known.filter(condition).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs // 2)
        for condition in ("good > 0", "good <= 0")
    ]
    chosen = kinds[0].unionByName(kinds[1])

    def start():
        def work(columns):
            ids, good, texts = columns
            out = []
            for text in texts:
                values, _, _ = _line_values((text or "").encode().split(b"\n"))
                features = _features(values)
                if len(features) > train_lines:
                    step = np.linspace(0, len(features) - 1, train_lines).astype(int)
                    features = features[step]
                out.append(features.ravel().tolist())
            return [ids, good, out]

        return work

    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    columns = ["doc_id", "good", "text"]
    features = explode_texts(sample, columns, "doc_id long, good int, features array<int>", start).filter("size(features) > 0")
    one = features.groupBy("doc_id", "good").agg(F.min_by("features", F.xxhash64("features")).alias("features"))
    chains = sorted((int(r.good > 0), r.features) for r in one.collect())
    y = [1 - good for good, _ in chains]
    if len(set(y)) < 2:
        return LineField(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    x = [np.array(f).reshape(-1, len(STEPS)) for _, f in chains]
    return _maximise(x, np.array(y), rounds, penalty)


def _maximise(chains: list[np.ndarray], y: np.ndarray, rounds: int, penalty: float) -> LineField:
    """Gradient ascent with momentum; all chains advance together, one place at a time.

    ``y``: the label that all lines of a chain have. Both kinds weigh alike, however many chains they have.
    """
    n, longest = len(chains), max(map(len, chains))
    lengths = np.array([len(c) for c in chains])
    order = np.argsort(-lengths, kind="stable")
    chains, y, lengths = [chains[i] for i in order], y[order], lengths[order]
    alive = [int((lengths > t).sum()) for t in range(longest)]
    at = [np.stack([chains[i][t] for i in range(alive[t])]) for t in range(longest)]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) / lengths
    emission, transition = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    speed_e, speed_t = np.zeros_like(emission), np.zeros_like(transition)
    truth = np.eye(2)[y]
    for _ in range(rounds):
        scores = [emission[f].sum(axis=1) for f in at]
        forward = [scores[0]]
        for t in range(1, longest):
            forward.append(scores[t] + np.logaddexp.reduce(forward[-1][: alive[t], :, None] + transition, axis=1))
        backward = [np.zeros((a, 2)) for a in alive]
        for t in range(longest - 2, -1, -1):
            a = alive[t + 1]
            backward[t][:a] = np.logaddexp.reduce(transition + (scores[t + 1] + backward[t + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(forward[0] + backward[0], axis=1)
        up_e, up_t = -penalty * emission, -penalty * transition
        for t in range(longest):
            a = alive[t]
            gap = (truth[:a] - np.exp(forward[t] + backward[t] - total[:a, None])) * weight[:a, None]
            for k in range(len(STEPS)):
                np.add.at(up_e, at[t][:, k], gap)
            if t:
                pair = forward[t - 1][:a, :, None] + transition + (scores[t] + backward[t])[:, None, :]
                pair = np.exp(pair - total[:a, None, None])
                both = truth[:a, :, None] * truth[:a, None, :]
                up_t += ((both - pair) * weight[:a, None, None]).sum(axis=0)
        speed_e, speed_t = 0.9 * speed_e + up_e, 0.9 * speed_t + up_t
        emission, transition = emission + 0.5 * speed_e, transition + 0.5 * speed_t
    return LineField(emission, transition)


def judge(
    documents: DataFrame, keep: list[str], field: LineField, min_share: float = 0.5, text: str = "text"
) -> DataFrame:
    """The ``keep`` columns and the verdict on each whole text.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``: the base rule.
    ``n_content_lines`` of ``n_lines`` lines with words are content; ``content_share`` is their share of the words.
    ``kept``: the base rule holds and the share is at least ``min_share``.

    A null or empty text has no words and is not kept. Repeated rows are judged each for itself; other columns are
    ignored.
    """

    def start():
        return lambda texts: [list(c) for c in zip(*(_judge(field, min_share, t) for t in texts), strict=True)]

    return map_texts(documents, keep, text, FIELDS, start)
