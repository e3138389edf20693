"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate.

Every line with a word is a position of the chain with two states. Viterbi decoding finds the best
labelling of a text's lines; the share of its words in content lines decides retention, next to
fixed base rules.

Only texts are labelled, so the states of lines are learnt: a first field starts from the label of a
line's text; then, in turn, every training text is decoded, under the constraint that most words of
a bad text lie in boilerplate and most words of a good one in content, and the field is fitted to
these states by its exact likelihood gradient. Lines of one text can so get different states.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.scratch import free_names, text_of

#: Fixed by the contract.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, REPEATED_PERCENT, WINDOW = 10, 20, 5
_WHITE = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
#: Names of the line features.
FEATURES = (
    "one words symbols shouting digits few_words repeated same_words marks_at_ends"
).split()


def _share(line: bytes, kind: bytes, size: int) -> float:
    return (len(line) - len(line.translate(None, kind))) / size


def line_features(lines: list[bytes], by_line: list[list[bytes]]) -> np.ndarray:
    """Features of the lines of one text which have a word."""
    seen: set[bytes] = set()
    rows = []
    for line, its_words in zip(lines, by_line, strict=True):
        words = len(its_words)
        if not words:
            continue
        size = len(line)
        upper = _share(line, _UPPER, size)
        lower = _share(line, _LOWER, size)
        rows.append(
            (
                1.0,
                min(words, 40) / 40,
                min(1.0, 8 * _share(line, SYMBOLS, size)),
                upper / (upper + lower) if upper + lower > 0 else 0.0,
                _share(line, _DIGITS, size),
                float(words < 4),
                float(line in seen),
                1 - len(set(its_words)) / words,
                min(1.0, 4 * line.count(b"!! ") / words),
            )
        )
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, len(FEATURES))


@dataclass(frozen=True)
class LineModel:
    """Weight of each feature for the state boilerplate, and scores of the four transitions."""

    weights: np.ndarray
    transitions: np.ndarray

    def labels(self, features: np.ndarray) -> list[int]:
        """Viterbi: 1 for boilerplate, 0 for content (also on a tie)."""
        (t00, t01), (t10, t11) = self.transitions.tolist()
        back: list[tuple[int, int]] = []
        content, boiler = 0.0, 0.0
        for i, score in enumerate((features @ self.weights).tolist()):
            if i:
                from_c, from_b = content + t00 >= boiler + t10, content + t01 >= boiler + t11
                back.append((0 if from_c else 1, 0 if from_b else 1))
                content, boiler = (
                    content + t00 if from_c else boiler + t10,
                    (content + t01 if from_b else boiler + t11) + score,
                )
            else:
                boiler = score
        out = [int(boiler > content)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1] if len(features) else []

    @staticmethod
    def keep_all() -> LineModel:
        return LineModel(np.zeros(len(FEATURES)), np.zeros((2, 2)))

    @staticmethod
    def fit(
        texts: list[tuple[np.ndarray, np.ndarray, int]],
        rounds: int = 4,
        steps: int = 150,
        ridge: float = 1e-4,
        longest: int = 60,
    ) -> LineModel:
        """Fit to texts given as (line features, words of the lines, 1 if the text is bad).

        Chains of more than `longest` lines are trained on in pieces of that length.
        """
        texts = [t for t in texts if len(t[0])]
        if len({bad for _, _, bad in texts}) < 2:
            return LineModel.keep_all()
        states = [np.full(len(x), bad) for x, _, bad in texts]
        pieces = [(i, at) for i, (x, _, _) in enumerate(texts) for at in range(0, len(x), longest)]
        n, wide = len(pieces), min(longest, max(len(x) for x, _, _ in texts))
        x, inside = np.zeros((n, wide, len(FEATURES))), np.zeros((n, wide), bool)
        for row, (i, at) in enumerate(pieces):
            part = texts[i][0][at : at + longest]
            x[row, : len(part)], inside[row, : len(part)] = part, True
        bad = np.array([texts[i][2] for i, _ in pieces])
        # A text counts once, whatever its length, and both labels count alike.
        weight = np.array([1 / len(texts[i][0]) for i, _ in pieces])
        total = np.bincount([t[2] for t in texts], minlength=2)
        weight *= np.where(bad == 1, len(texts) / (2 * total[1]), len(texts) / (2 * total[0]))
        at = np.zeros(len(FEATURES) + 4)
        for turn in range(rounds):
            y = np.zeros((n, wide), np.int64)
            for row, (i, first) in enumerate(pieces):
                part = states[i][first : first + longest]
                y[row, : len(part)] = part
            # Later fits start near their end.
            at = _climbed(at, x, inside, y, weight, steps if turn == 0 else steps // 2, ridge, turn == 0)
            model = LineModel(at[: len(FEATURES)], at[len(FEATURES) :].reshape(2, 2))
            new = [model.constrained(*t) for t in texts]
            if turn and all((a == b).all() for a, b in zip(states, new, strict=True)):
                break
            states = new
        return model

    def constrained(self, features: np.ndarray, words: np.ndarray, bad: int) -> np.ndarray:
        """Best labelling of a labelled text; lines which speak least against it turn until it fits.

        At least half of the words must lie in lines of the state which the text's label says.
        """
        states = np.array(self.labels(features))
        lean = (features @ self.weights) * (1 if bad else -1)
        for line in np.argsort(-lean, kind="stable"):
            if 2 * words[states == bad].sum() >= words.sum():
                break
            states[line] = bad
        return states


def _climbed(at, x, inside, y, weight, steps: int, ridge: float, lines_only: bool) -> np.ndarray:
    """Maximum likelihood from `at` on; with `lines_only` the transitions stay as they are."""
    speed, power = np.zeros_like(at), np.zeros_like(at)
    total = weight.sum()
    for step in range(1, steps + 1):
        slope = _slope(at, x, inside, y, weight) / total + ridge * at
        if lines_only:
            slope[x.shape[2] :] = 0
        speed, power = 0.9 * speed + 0.1 * slope, 0.99 * power + 0.01 * slope**2
        at = at - 0.2 * (speed / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.99**step)) + 1e-8)
    return at


def _slope(at, x, inside, y, weight) -> np.ndarray:
    """Gradient of the negative log-likelihood of the states y (n, t): expected minus observed counts."""
    size = x.shape[2]
    scores = np.zeros((*inside.shape, 2))
    scores[:, :, 1] = x @ at[:size]
    trans = at[size:].reshape(2, 2)
    ahead = np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]
    for t in range(1, x.shape[1]):
        paths = np.logaddexp(ahead[:, t - 1, 0, None] + trans[0], ahead[:, t - 1, 1, None] + trans[1])
        ahead[:, t] = np.where(inside[:, t, None], paths + scores[:, t], ahead[:, t - 1])
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    behind, pairs = np.zeros_like(scores), np.zeros((2, 2))
    for t in range(x.shape[1] - 2, -1, -1):
        on = inside[:, t + 1]
        next_ = scores[:, t + 1] + behind[:, t + 1]
        joint = ahead[:, t, :, None] + trans[None] + next_[:, None, :] - total[:, None, None]
        pairs += (np.exp(np.minimum(joint, 0)) * (weight * on)[:, None, None]).sum(axis=0)
        paths = np.logaddexp(trans[:, 0] + next_[:, 0, None], trans[:, 1] + next_[:, 1, None])
        behind[:, t] = np.where(on[:, None], paths, 0.0)
    likely = np.exp(np.minimum(ahead[:, :, 1] + behind[:, :, 1] - total[:, None], 0)) * inside
    excess = (likely - y * inside) * weight[:, None]
    both = inside[:, 1:] & inside[:, :-1]
    np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), -np.broadcast_to(weight[:, None], both.shape)[both])
    return np.concatenate((np.einsum("nt,ntf->f", excess, x), pairs.ravel()))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words which lie in a window found twice or more in the text, its first place included."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    key, length = ids, 1
    while length < window:
        step = min(length, window - length)
        # Two overlapping or adjacent runs of equal length name the longer one exactly.
        key = key[: len(key) - step] * (int(key.max()) + 1) + key[step:]
        length += step
        values, key, times = np.unique(key, return_inverse=True, return_counts=True)
        if len(values) == len(key):
            return 0
    edges = np.zeros(len(words) + 1, np.int64)
    hit = np.flatnonzero(times[key] > 1)
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def _measure(text: str, model: LineModel) -> tuple[int, ...]:
    raw = text.encode("utf-8", "replace")
    lines = raw.split(b"\n")
    by_line = [line.split() for line in lines]
    words = [w for line in by_line for w in line]
    counts = [len(line) for line in by_line]
    seen: set[bytes] = set()
    again = 0
    for line, n in zip(lines, counts, strict=True):
        if n:
            again += line in seen
            seen.add(line)
    labels = model.labels(line_features(lines, by_line))
    with_words = [n for n in counts if n]
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, _WHITE))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        again,
        repeated_words(words),
        sum(n for n, label in zip(with_words, labels, strict=True) if label == 0),
        len(labels),
        sum(labels),
    )


_COUNTS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words content_words n_lines n_boilerplate_lines"
).split()


def _measured(text: Column, model: LineModel) -> Column:
    @F.pandas_udf(", ".join(f"{c} long" for c in _COUNTS))
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([_measure(t, model) for t in texts], columns=_COUNTS, dtype="int64")

    return measure(text)


def fit_line_model(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    texts_per_label: int = 500,
) -> LineModel:
    """Fit on at most `texts_per_label` whole texts of each label, chosen by a hash of their id.

    An id with both labels counts as bad, one with several texts by the text of least hash, so reruns
    take the same rows. Without labelled rows of both kinds all lines count as content.
    """
    chosen = None
    for label in (0, 1):
        some = (
            labels.where((F.col(label_col) == label) & F.col(id_col).isNotNull())
            .select(F.col(id_col).alias("_id"), F.lit(1 - label).alias("_bad"))
            .distinct()
            .orderBy(F.xxhash64("_id"), "_id")
            .limit(texts_per_label)
        )
        chosen = some if chosen is None else chosen.union(some)
    chosen = chosen.groupBy("_id").agg(F.max("_bad").alias("_bad"))

    @F.pandas_udf("x binary, words binary")
    def features(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            lines = text.encode("utf-8", "replace").split(b"\n")
            by_line = [line.split() for line in lines]
            words = np.array([len(w) for w in by_line if w], np.int64)
            rows.append((line_features(lines, by_line).tobytes(), words.tobytes()))
        return pd.DataFrame(rows, columns=["x", "words"])

    # Two lists of bounded size; their ids are unique, so that a broadcast holds no more.
    once = (
        docs.select(F.col(id_col).alias("_id"), text_of(docs, text_col).alias("_text"))
        .join(F.broadcast(chosen), "_id")
        .groupBy("_id", "_bad")
        .agg(F.min(F.struct(F.xxhash64("_text"), "_text"))["_text"].alias("_text"))
    )
    rows = once.select("_id", "_bad", features("_text").alias("f")).select("_id", "_bad", "f.*").collect()
    rows.sort(key=lambda r: r["_id"])
    return LineModel.fit(
        [
            (
                np.frombuffer(r["x"], np.float64).reshape(-1, len(FEATURES)),
                np.frombuffer(r["words"], np.int64),
                r["_bad"],
            )
            for r in rows
        ]
    )


def assess(
    docs: DataFrame,
    model: LineModel,
    text_col: str = "text",
    least_content: float = 0.5,
    out: str = "_quality",
) -> DataFrame:
    """`docs` with the column `out`: counts, `base_failed`, `content_share` and `kept`.

    Null texts count as empty; a text without words has content share 0 and fails the base rules.
    Rows are judged one by one, so repeated rows get equal verdicts. Other columns are untouched; a
    column named `out` is replaced.
    """
    [working] = free_names(docs, "_m")
    measured = docs.withColumn(working, _measured(text_of(docs, text_col), model))
    m = F.col(working)
    failed = (m["n_words"] < LEAST_WORDS) | (
        100 * m["n_repeat_words"] > REPEATED_PERCENT * m["n_words"]
    )
    share = F.when(m["n_words"] > 0, m["content_words"] / m["n_words"]).otherwise(0.0)
    return measured.withColumn(
        out,
        F.struct(
            *[m[c].alias(c) for c in _COUNTS],
            failed.alias("base_failed"),
            share.alias("content_share"),
            (~failed & (share >= least_content)).alias("kept"),
        ),
    ).drop(working)
