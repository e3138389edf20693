"""Toxicity by a bidirectional gated recurrent network over characters and words, in numpy.

A word is read twice: through a hashed table of word vectors, and letter by letter through a
bidirectional GRU. A second bidirectional GRU reads overlapping windows of words, attention pools
its states, and a logistic unit scores the window. A text's score is that of its worst window;
all windows of the whole text are scored.

Training is weakly supervised: only texts are labelled. Windows of toxic texts which hold the
strongest words and letter groups of the toxic side start as examples (if none stands out, the
strongest window of every toxic text); later rounds take the windows which the network itself finds
worst. Two numbers calibrate the worst window's logit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.llm.scratch import text_of

_WORDS = re.compile(r"\w+")
#: Letters of a token; longer words are cut into several tokens, so no letter is lost.
LETTERS = 16
#: Half a window, so that every phrase of up to 17 tokens lies whole in some window.
WINDOW, STRIDE = 32, 16
#: Word vectors are learned for at most so many words, each of them in several texts; all other
#: words are read by their letters alone.
WORD_ROWS, TEXTS_PER_WORD = 4096, 6
LETTER_ROWS = 256
#: Tokens whose input sums a worker keeps, and windows scored at once.
KEPT_TOKENS, WINDOWS_AT_ONCE = 150_000, 2048
#: Standard deviations by which a word or letter group stands out in toxic texts at the start.
STANDS_OUT = 8.0
#: Steps of a training round, however few examples there are.
LEAST_STEPS = 60


def tokens_of(text: str) -> list[str]:
    words = _WORDS.findall(text.lower())
    if words and len(max(words, key=len)) > LETTERS:
        words = [w[i : i + LETTERS] for w in words for i in range(0, len(w), LETTERS)]
    return words


def _letters(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter rows (LETTERS, n) and whether a place holds a letter."""
    size = np.array([len(t) for t in tokens])
    points = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.arange(LETTERS)[:, None] < size
    rows = np.zeros((len(tokens), LETTERS), np.int64)
    rows[inside.T] = points % LETTER_ROWS
    return rows.T, inside


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -30, 30)))


def _run(x: np.ndarray, inside: np.ndarray, u: np.ndarray, keep: bool = False):
    """GRU over time-major input sums x (t, n, 3h); returns states (t, n, h) and what backward needs."""
    steps, n, three = x.shape
    h = three // 3
    state, states, saved = np.zeros((n, h), x.dtype), np.empty((steps, n, h), x.dtype), []
    for t in range(steps):
        back = state @ u
        gates = _sigmoid(x[t, :, : 2 * h] + back[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = 2 * _sigmoid(2 * (x[t, :, 2 * h :] + r * back[:, 2 * h :])) - 1
        on = inside[t][:, None]
        after = np.where(on, new + z * (state - new), state)
        if keep:
            saved.append((state, z, r, new, back[:, 2 * h :], on))
        states[t] = state = after
    return states, saved


def _run_back(grad: np.ndarray, saved: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input sums and of u, from those of the states."""
    steps, n, h = grad.shape
    gx, gu = np.zeros((steps, n, 3 * h), grad.dtype), np.zeros_like(u)
    carry = np.zeros((n, h), grad.dtype)
    for t in range(steps - 1, -1, -1):
        state, z, r, new, back_new, on = saved[t]
        total = carry + grad[t]
        moved = total * on
        g_new = moved * (1 - z) * (1 - new**2)
        g_z = moved * (state - new) * z * (1 - z)
        g_r = g_new * back_new * r * (1 - r)
        g_back = np.concatenate((g_z, g_r, g_new * r), axis=1)
        gx[t] = np.concatenate((g_z, g_r, g_new), axis=1)
        gu += state.T @ g_back
        carry = total * ~on + moved * z + g_back @ u.T
    return gx, gu


@dataclass
class ToxicModel:
    """Weights; `slope` and `shift` turn the worst window's logit into a score."""

    weights: dict[str, np.ndarray]
    row_of: dict[str, int]
    slope: float = 1.0
    shift: float = 0.0

    @staticmethod
    def start(row_of: dict[str, int], seed: int = 7, word: int = 8, letter: int = 8, small: int = 6, wide: int = 8) -> ToxicModel:
        rng = np.random.default_rng(seed)

        def w(*shape: int) -> np.ndarray:
            return (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

        weights = {
            "word": np.zeros((len(row_of) + 1, word), np.float32),  # row 0: unknown words
            "letter": (0.5 * rng.normal(size=(LETTER_ROWS, letter))).astype(np.float32),
            "pool": w(2 * wide, 8),
            "ask": w(8),
            "out": w(2 * wide),
            "bias": np.zeros(1, np.float32),
        }
        for side in "fb":
            weights |= {
                f"letter_in_{side}": w(letter, 3 * small),
                f"letter_u_{side}": w(small, 3 * small),
                f"in_{side}": w(word + 2 * small, 3 * wide),
                f"in_bias_{side}": np.zeros(3 * wide, np.float32),
                f"u_{side}": w(wide, 3 * wide),
            }
        return ToxicModel(weights, row_of)

    def _token_vectors(self, tokens: list[str], keep: bool = False):
        p = self.weights
        rows, inside = _letters(tokens)
        last, saved = [], {}
        for side in "fb":
            order = slice(None) if side == "f" else slice(None, None, -1)
            x = (p["letter"] @ p[f"letter_in_{side}"])[rows[order]]
            states, saved[side] = _run(x, inside[order], p[f"letter_u_{side}"], keep)
            last.append(states[-1])
        words = np.array([self.row_of.get(t, 0) for t in tokens], np.int64)
        return np.concatenate([p["word"][words], *last], axis=1), (rows, words, saved)

    def input_sums(self, tokens: list[str]) -> np.ndarray:
        """What tokens add to the gates of both directions: (n, 2, 3h)."""
        vectors, _ = self._token_vectors(tokens)
        p = self.weights
        return np.stack([vectors @ p[f"in_{s}"] + p[f"in_bias_{s}"] for s in "fb"], axis=1)

    def _windows(self, sums: np.ndarray, at: np.ndarray, inside: np.ndarray, keep: bool = False):
        """Logits of windows given as token rows (t, n)."""
        p = self.weights
        forward, saved_f = _run(sums[at, 0], inside, p["u_f"], keep)
        backward, saved_b = _run(sums[at[::-1], 1], inside[::-1], p["u_b"], keep)
        states = np.concatenate((forward, backward[::-1]), axis=2)
        looked = np.tanh(states @ p["pool"])
        ask = np.where(inside, looked @ p["ask"], -1e9)
        share = np.exp(ask - ask.max(axis=0))
        share *= inside
        share /= np.maximum(share.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", share, states)
        logits = pooled @ p["out"] + p["bias"]
        return logits, (saved_f, saved_b, states, looked, share, pooled)

    def logits(self, sums: np.ndarray, at: np.ndarray, inside: np.ndarray) -> np.ndarray:
        out = [
            self._windows(sums, at[:, i : i + WINDOWS_AT_ONCE], inside[:, i : i + WINDOWS_AT_ONCE])[0]
            for i in range(0, at.shape[1], WINDOWS_AT_ONCE)
        ]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def slopes(
        self, tokens: list[str], at: np.ndarray, inside: np.ndarray, y: np.ndarray, known=None
    ):
        """Loss and gradients of all weights over windows of `tokens` (rows `at`).

        `known` says of which tokens the word vector is shown; the others are read by letters.
        """
        p = self.weights
        vectors, (rows, words, letter_saved) = self._token_vectors(tokens, True)
        size = p["word"].shape[1]
        if known is not None:
            vectors[:, :size] *= known[:, None]
        sums = np.stack([vectors @ p[f"in_{s}"] + p[f"in_bias_{s}"] for s in "fb"], axis=1)
        logits, (saved_f, saved_b, states, looked, share, pooled) = self._windows(
            sums, at, inside, True
        )
        probability = _sigmoid(logits)
        loss = -np.mean(np.log(np.where(y > 0, probability, 1 - probability) + 1e-7))
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g_logit = ((probability - y) / len(y)).astype(np.float32)
        g["bias"][0], g["out"] = g_logit.sum(), pooled.T @ g_logit
        g_pooled = g_logit[:, None] * p["out"]
        g_states = share[:, :, None] * g_pooled
        g_share = np.einsum("nh,tnh->tn", g_pooled, states)
        g_ask = share * (g_share - (share * g_share).sum(axis=0))
        g["ask"] = np.einsum("tn,tnk->k", g_ask, looked)
        g_look = g_ask[:, :, None] * p["ask"] * (1 - looked**2)
        g["pool"] = np.einsum("tnh,tnk->hk", states, g_look)
        g_states += g_look @ p["pool"].T
        wide = states.shape[2] // 2
        g_vectors = np.zeros_like(vectors)
        for side, part, saved, where in (
            ("f", g_states[:, :, :wide], saved_f, at),
            ("b", g_states[::-1, :, wide:], saved_b, at[::-1]),
        ):
            gx, g[f"u_{side}"] = _run_back(part, saved, p[f"u_{side}"])
            g_sums = np.zeros((len(tokens), gx.shape[2]), np.float32)
            np.add.at(g_sums, where.ravel(), gx.reshape(-1, gx.shape[2]))
            g[f"in_{side}"], g[f"in_bias_{side}"] = vectors.T @ g_sums, g_sums.sum(axis=0)
            g_vectors += g_sums @ p[f"in_{side}"].T
        seen = g_vectors[:, :size] if known is None else g_vectors[:, :size] * known[:, None]
        np.add.at(g["word"], words, seen)
        g["word"][0] = 0
        small = (vectors.shape[1] - size) // 2
        for n, side in enumerate("fb"):
            order = slice(None) if side == "f" else slice(None, None, -1)
            grad = np.zeros((LETTERS, len(tokens), small), np.float32)
            grad[-1] = g_vectors[:, size + n * small : size + (n + 1) * small]
            gx, g[f"letter_u_{side}"] = _run_back(grad, letter_saved[side], p[f"letter_u_{side}"])
            g_rows = np.zeros((LETTER_ROWS, gx.shape[2]), np.float32)
            np.add.at(g_rows, rows[order].ravel(), gx.reshape(-1, gx.shape[2]))
            g[f"letter_in_{side}"] = p["letter"].T @ g_rows
            g["letter"] += g_rows @ p[f"letter_in_{side}"].T
        return loss, g


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token rows (WINDOW, n) of all windows of texts laid end to end, inside flags, and text."""
    count = np.maximum(0, np.ceil((lengths - WINDOW) / STRIDE)).astype(np.int64) + 1
    count[lengths == 0] = 0
    text = np.repeat(np.arange(len(lengths)), count)
    first = np.cumsum(lengths) - lengths
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = first[text] + nth * STRIDE
    at = start + np.arange(WINDOW)[:, None]
    inside = at < (first + lengths)[text]
    return np.where(inside, at, 0), inside, text


def _signs(token: str) -> set[str]:
    framed = f"^{token}$"
    return {framed} | {framed[i : i + 5] for i in range(len(framed) - 4)}


def _first_guess(texts: list[list[str]], y: np.ndarray) -> dict[str, float]:
    """How far each token's strongest sign stands out in toxic texts, in standard deviations."""
    tokens = {t for text in texts for t in text}
    signs = {t: _signs(t) for t in tokens}
    held = [Counter(), Counter()]
    for text, label in zip(texts, y.tolist(), strict=True):
        held[label].update(set().union(*[signs[t] for t in set(text)]) if text else ())
    n = np.bincount(y, minlength=2)
    odds = {}
    for sign, found in held[1].items():
        usual = n[1] * (held[0][sign] + 0.5) / (n[0] + 1)
        odds[sign] = (found - usual) / np.sqrt(usual + 1)
    return {t: max(odds.get(s, 0.0) for s in signs[t]) for t in tokens}


def fit(
    texts: list[str],
    labels: list[int],
    rounds: tuple[int, ...] = (3, 3, 2),
    batch: int = 256,
    examples: int = 1500,
    seed: int = 7,
    toxic_share: float | None = None,
) -> ToxicModel:
    """Train on labelled texts; `examples` bounds the toxic windows of a round.

    `toxic_share` is the share of toxic texts where scores will be used, if it is not that of
    `texts`; scores are shifted to it.
    """
    rng, y = np.random.default_rng(seed), np.array(labels, np.int64)
    words = [tokens_of(t) for t in texts]
    held = Counter(t for text in words for t in set(text))
    common = sorted((t for t, n in held.items() if n >= TEXTS_PER_WORD), key=lambda t: (-held[t], t))
    model = ToxicModel.start({t: i + 1 for i, t in enumerate(common[:WORD_ROWS])}, seed)
    if len(set(labels)) < 2:
        return ToxicModel(model.weights, model.row_of, 0.0, -4.0)
    known = sorted({t for text in words for t in text})
    row = {t: i for i, t in enumerate(known)}
    flat = np.array([row[t] for text in words for t in text], np.int64)
    at, inside, text = windows_of(np.array([len(t) for t in words]))
    at = flat[at]
    # Every fourth text is left for the calibration, unless toxic texts with words are only there.
    spared = np.arange(len(y)) % 4 == 3
    if not (y[text] * ~spared[text]).any():
        spared[:] = False
    toxic = (y[text] == 1) & ~spared[text]
    guess = _first_guess([w for w, s in zip(words, spared, strict=True) if not s], y[~spared])
    strength = np.array([guess.get(t, 0.0) for t in known])
    worth = np.where(inside, strength[at], 0.0).max(axis=0)
    first = worth > STANDS_OUT
    if not (toxic & first).any():  # rare insults or few texts: the strongest window of each text
        order = np.lexsort((-worth, text))
        first[order[np.unique(text[order], return_index=True)[1]]] = True
    speed = {k: np.zeros_like(v) for k, v in model.weights.items()}
    power = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for turn, epochs in enumerate(rounds):
        if turn:
            sums = model.input_sums(known)
            worth = model.logits(sums, at, inside)
        # Windows of toxic texts which stand out by their words or, later, by the network; of the
        # others the worst and some more.
        bad = np.flatnonzero((y[text] == 0) & ~spared[text])
        known_bad = worth > np.quantile(worth[bad], 0.995) if turn and len(bad) else first
        good = rng.permutation(np.flatnonzero(toxic & (first | known_bad)))[:examples]
        hard = bad[np.argsort(-worth[bad], kind="stable")[: len(good)]]
        bad = np.union1d(rng.permutation(bad)[: 4 * len(good)], hard)
        if not len(good):
            break
        chosen = np.concatenate((good, bad))
        parts = max(1, len(chosen) // batch)
        for _ in range(max(epochs, -(-LEAST_STEPS // parts))):
            for part in np.array_split(rng.permutation(chosen), parts):
                used, where = np.unique(at[:, part], return_inverse=True)
                _, g = model.slopes(
                    [known[i] for i in used], where.reshape(WINDOW, -1), inside[:, part],
                    toxic[part].astype(np.float32), rng.random(len(used)) < 0.5,
                )
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                step += 1
                for k, v in model.weights.items():
                    short = g[k] / max(1.0, norm)
                    speed[k] = 0.9 * speed[k] + 0.1 * short
                    power[k] = 0.99 * power[k] + 0.01 * short**2
                    v -= 0.008 * (speed[k] / (1 - 0.9**step)) / (
                        np.sqrt(power[k] / (1 - 0.99**step)) + 1e-6
                    )
    worth = model.logits(model.input_sums(known), at, inside)
    worst = np.full(len(y), -20.0)
    np.maximum.at(worst, text, worth)
    apart = spared if spared.any() else ~spared
    model.slope, model.shift = _calibrated(worst[apart], y[apart])
    if toxic_share and 0 < toxic_share < 1:
        here = y.mean()
        model.shift += np.log(toxic_share / (1 - toxic_share)) - np.log(here / (1 - here))
    return model


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on one number, with a weak pull to slope 1."""
    design = np.stack((np.clip(x, -20, 20), np.ones(len(x))), axis=1)
    at, pull = np.array([1.0, 0.0]), np.diag([1.0, 0.01])
    for _ in range(100):
        p = _sigmoid(design @ at)
        slope = design.T @ (p - y) + pull @ (at - [1.0, 0.0])
        curve = (design * (p * (1 - p))[:, None]).T @ design + pull
        move = np.linalg.solve(curve, slope)
        at = at - move * min(1.0, 1.0 / np.abs(move).max(initial=1e-9))
    return float(at[0]), float(at[1])


class Scorer:
    """Scores texts of a partition; keeps the input sums of known tokens, within a bound."""

    def __init__(self, model: ToxicModel):
        self.model = model
        self.row: dict[str, int] = {}
        self.sums = np.zeros((0, 2, model.weights["in_bias_f"].size), np.float32)

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Score and number of windows of each text."""
        out = []
        group, size = [], 0
        for text in texts:
            group.append(tokens_of(text))
            size += len(group[-1])
            if size >= 200_000:
                out.append(self._score(group))
                group, size = [], 0
        out.append(self._score(group))
        return np.concatenate(out)

    def _score(self, group: list[list[str]]) -> np.ndarray:
        if not group:
            return np.zeros((0, 2))
        if len(self.row) > KEPT_TOKENS:
            self.row, self.sums = {}, self.sums[:0]
        fresh = list(set().union(*group) - self.row.keys())
        if fresh:
            self.row.update(zip(fresh, range(len(self.row), len(self.row) + len(fresh)), strict=True))
            parts = [
                self.model.input_sums(fresh[i : i + 8192]) for i in range(0, len(fresh), 8192)
            ]
            self.sums = np.concatenate((self.sums, *parts))
        row = self.row
        flat = np.array([row[t] for tokens in group for t in tokens], np.int64)
        lengths = np.array([len(t) for t in group])
        scores = np.zeros((len(group), 2))
        worst = np.full(len(group), -np.inf)
        at, inside, text = windows_of(lengths)
        if len(flat):
            logits = self.model.logits(self.sums, flat[at], inside)
            np.maximum.at(worst, text, logits)
        scores[:, 1] = np.bincount(text, minlength=len(group))
        read = lengths > 0
        scores[read, 0] = _sigmoid(
            self.model.slope * np.clip(worst[read], -20, 20) + self.model.shift
        )
        return scores


def scored(spark: SparkSession, text: Column, model: ToxicModel) -> Column:
    """Struct (score, windows) of a text column; a text without words scores 0."""
    # Plain values: a broadcast is read in workers which may not have the package.
    shared = spark.sparkContext.broadcast((model.weights, model.row_of, model.slope, model.shift))

    @F.pandas_udf("score double, windows bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(ToxicModel(*shared.value))
        for texts in batches:
            out = scorer(texts.tolist())
            yield pd.DataFrame({"score": out[:, 0], "windows": out[:, 1].astype("int64")})

    return of(F.coalesce(text, F.lit("")))


def held_out(doc_id: Column) -> Column:
    """Rows which no fit may use, fixed by the contract: crc32 of the id modulo 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    toxic_texts: int = 800,
    other_texts: int = 1400,
    characters: int = 20_000,
) -> ToxicModel:
    """Fit on a bounded sample of labelled texts that are not held out, chosen by a hash of the id.

    At most `toxic_texts` + `other_texts` texts; longer ones than `characters` are left out of the
    fit. Repeated ids and rows are chosen by label and hash, so reruns take the same. Without both labels every text with words gets a score of a few hundredths.
    """
    free = labels.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull())
    chosen = None
    for label, most in ((1, toxic_texts), (0, other_texts)):
        some = (
            free.where(F.col(label_col) == label)
            .select(F.col(id_col).alias("_id"), F.lit(label).alias("_y"))
            .distinct()
            .orderBy(F.xxhash64("_id"), "_id")
            .limit(most)
        )
        chosen = some if chosen is None else chosen.union(some)
    # An id with both labels counts as toxic, one with several texts by the one of least hash.
    chosen = chosen.groupBy("_id").agg(F.max("_y").alias("_y"))
    texts = docs.select(F.col(id_col).alias("_id"), text_of(docs, text_col).alias("_text")).where(
        F.length("_text") <= characters
    )
    rows = (
        texts.join(F.broadcast(chosen), "_id")
        .groupBy("_id", "_y")
        .agg(F.min(F.struct(F.xxhash64("_text"), "_text"))["_text"].alias("_text"))
        .collect()  # bounded by the two limits
    )
    rows.sort(key=lambda r: r["_id"])
    share = free.where(F.col(label_col).isin(0, 1)).agg(F.avg(label_col)).first()[0]
    return fit([r["_text"] for r in rows], [r["_y"] for r in rows], toxic_share=share)
