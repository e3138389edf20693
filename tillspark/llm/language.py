"""Language of texts: averaged embeddings of hashed subwords, a linear softmax, calibrated rejection.

Every run of letters gives its letter groups of two to four, its ends marked, and itself; each is
hashed to a row of a table of vectors. The mean vector of all of a text's subwords goes through one
linear layer. Both are trained together by stochastic gradient descent in numpy; a step shows a
random part of each text's subwords, so that short texts are learnt as well as long ones.

Scores are calibrated on spared texts: the logits are scaled by a power of the number of subwords,
as the mean of many is surer than that of a few. The same texts give the least score at which
accepted predictions keep to a stated share of errors; below it a prediction counts as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillspark.llm.toxicity import held_out

#: Candidates for words; those without a letter (numerals such as a superscript two) are passed over.
_RUNS = re.compile(r"[^\W\d_]+")
#: Rows of the table of subword vectors, and their length.
ROWS, WIDTH = 1 << 16, 16
SIZES = (2, 3, 4)
#: Distinct words whose sums a task keeps.
KEPT_WORDS = 200_000
#: Parts into which the rows of a language are dealt when those to learn from are chosen.
RANKED_PARTS = 64
#: Answer for texts without a letter.
UNKNOWN = "und"


def _hashed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(ROWS)).astype(np.int64)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all subwords of `words`, and the number of the word each belongs to.

    Runs without a letter have none.
    """
    framed = [f"\2{w}\3" if any(map(str.isalpha, w)) else "" for w in words]
    size = np.array([len(w) for w in framed], np.int64)
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    end = np.cumsum(size)
    rows, of = [], []
    with np.errstate(over="ignore"):
        key = points.copy()
        for n in range(2, max(SIZES) + 1):
            key = key[:-1] * np.uint64(0x100000001B3) + points[n - 1 :]
            if n in SIZES:
                inside = np.arange(len(key)) + n <= end[word[: len(key)]]
                rows.append(_hashed(key[inside] + np.uint64(n)))
                of.append(word[: len(key)][inside])
        some = size > 0
        if some.any():
            # The whole word: a sum over its letters, each weighted by its place.
            place = np.arange(len(points)) - np.repeat(end - size, size)
            weight = (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            whole = np.add.reduceat(points * weight ^ (weight >> np.uint64(7)), (end - size)[some])
            rows.append(_hashed(whole))
            of.append(np.flatnonzero(some))
    return np.concatenate(rows), np.concatenate(of)


def _runs(text: str) -> list[str]:
    return _RUNS.findall(text.lower())


def text_rows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of a whole text's subwords, and how often each occurs."""
    words, times = np.unique(np.array(_runs(text), dtype=object), return_counts=True)
    rows, of = subwords(words.tolist())
    count = np.bincount(rows, weights=times[of] if len(of) else None, minlength=1)
    found = np.flatnonzero(count)
    return found.astype(np.int32), count[found].astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class LanguageModel:
    """`table` holds what a subword adds to the logits; `scale` is (a, b): logits times exp(a) * n ** b.

    Predictions with a score below `least` count as rejected.
    """

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    scale: tuple[float, float] = (0.0, 0.0)
    least: float = 0.0

    def logits(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Calibrated logits of texts from the sums over their subwords, and how many these are."""
        n = np.maximum(n, 1)[:, None]
        return (sums / n + self.bias) * np.exp(self.scale[0]) * n ** self.scale[1]


def _drawn(rng, rows: np.ndarray, ends: np.ndarray, many: int) -> np.ndarray:
    """`many` subwords of a text, each as likely as it is frequent; `ends` are running counts."""
    return rows[np.searchsorted(ends, rng.random(many) * ends[-1], side="right")]


def fit(
    texts: list[tuple[np.ndarray, np.ndarray]],
    labels: list[str],
    steps: int = 900,
    batch: int = 64,
    speed: float = 8.0,
    shown: tuple[int, ...] = (8, 24, 72, 216),
    allowed_errors: float = 0.01,
    seed: int = 11,
) -> LanguageModel:
    """Train on texts given as (rows, counts); every fourth of a language is spared for calibration.

    `shown` are the numbers of subwords which a step shows of a text. Without any text nothing can
    be predicted; with one language all texts are of it.
    """
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    if len(languages) < 2:
        flat = np.zeros((ROWS, len(languages)), np.float32)
        return LanguageModel(languages, flat, np.zeros(len(languages)))
    y = np.array([languages.index(label) for label in labels])
    nth = np.zeros(len(y), np.int64)
    for k in range(len(languages)):
        nth[y == k] = np.arange((y == k).sum())
    spared = nth % 4 == 3
    ends = [np.cumsum(c, dtype=np.float64) for _, c in texts]
    taught = [np.flatnonzero((y == k) & ~spared) for k in range(len(languages))]
    vectors = ((rng.random((ROWS, WIDTH)) - 0.5) * (2 / WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    for step in range(steps):
        of = rng.integers(len(languages), size=batch)
        chosen = [taught[k][int(rng.random() * len(taught[k]))] for k in of]
        many = rng.choice(shown, size=batch)
        rows = np.concatenate([_drawn(rng, texts[t][0], ends[t], m) for t, m in zip(chosen, many, strict=True)])
        mean = np.add.reduceat(vectors[rows], np.cumsum(many) - many) / many[:, None]
        excess = _softmax(mean @ layer + bias)
        excess[np.arange(batch), of] -= 1
        pace = np.float32(speed * (1 - step / steps) / batch)
        back = (excess @ layer.T / many[:, None]).astype(np.float32)
        layer -= pace * (mean.T @ excess).astype(np.float32)
        bias -= 0.1 * pace * excess.sum(axis=0).astype(np.float32)
        np.add.at(vectors, rows, -pace * batch * np.repeat(back, many, axis=0))
    model = LanguageModel(languages, vectors @ layer, bias)
    tried = np.flatnonzero(spared) if spared.any() else np.arange(len(y))
    sums, n, truth = [], [], []
    for t in tried:
        rows, counts = texts[t]
        sums.append(counts @ model.table[rows])
        n.append(ends[t][-1])
        for m in shown:
            if m < n[-1]:
                sums.append(model.table[_drawn(rng, rows, ends[t], m)].sum(axis=0))
                n.append(m)
        truth += [y[t]] * (len(sums) - len(truth))
    return _calibrated(model, np.array(sums), np.array(n), np.array(truth), allowed_errors)


def _calibrated(model: LanguageModel, sums, n, truth, allowed_errors: float) -> LanguageModel:
    """Scale of least log loss on a grid; least score at which few enough accepted ones are wrong."""
    best = None
    for a in np.linspace(-3, 4, 29):
        for b in np.linspace(0, 1, 11):
            tried = LanguageModel(model.languages, model.table, model.bias, (float(a), float(b)))
            chance = _softmax(tried.logits(sums, n))
            loss = -np.log(chance[np.arange(len(truth)), truth] + 1e-6).mean()
            if best is None or loss < best[0] - 1e-12:
                best = loss, tried, chance
    _, model, chance = best
    score, right = chance.max(axis=1), chance.argmax(axis=1) == truth
    order = np.argsort(-score, kind="stable")
    errors = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    kept = np.flatnonzero(errors <= allowed_errors)
    least = float(score[order][kept[-1]]) if len(kept) else 1.0
    return LanguageModel(model.languages, model.table, model.bias, model.scale, least)


class _Reader:
    """Predicts the texts of a task; keeps the sums of known words, within a bound."""

    def __init__(self, model: LanguageModel):
        self.model, self.place = model, {}
        self.sums = np.zeros((0, len(model.languages) + 1))

    def __call__(self, texts: list[str]) -> pd.DataFrame:
        parts, group, held = [], [], 0
        for text in texts:
            group.append(_runs(text))
            held += len(group[-1])
            if held >= 300_000:
                parts.append(self._read(group))
                group, held = [], 0
        parts.append(self._read(group))
        return pd.concat(parts)

    def _read(self, group: list[list[str]]) -> pd.DataFrame:
        model, place = self.model, self.place
        if len(place) > KEPT_WORDS:
            place.clear()
            self.sums = self.sums[:0]
        fresh = list(set().union(*group) - place.keys())
        if fresh:
            place.update(zip(fresh, range(len(place), len(place) + len(fresh)), strict=True))
            rows, of = subwords(fresh)
            added = np.zeros((len(fresh), self.sums.shape[1]))
            for k in range(len(model.languages)):
                added[:, k] = np.bincount(of, weights=model.table[rows, k], minlength=len(fresh))
            added[:, -1] = np.bincount(of, minlength=len(fresh))
            self.sums = np.concatenate((self.sums, added))
        size = np.array([len(words) for words in group], np.int64)
        flat = np.array([place[w] for words in group for w in words], np.int64)
        total = np.zeros((len(group), self.sums.shape[1]))
        some = size > 0
        if some.any():
            total[some] = np.add.reduceat(self.sums[flat], (np.cumsum(size) - size)[some])
        read = (total[:, -1] > 0) & bool(model.languages)
        name = np.full(len(group), UNKNOWN, dtype=object)
        score = np.zeros(len(group))
        if read.any():
            chance = _softmax(model.logits(total[read, :-1], total[read, -1]))
            name[read] = np.array(model.languages, dtype=object)[chance.argmax(axis=1)]
            score[read] = chance.max(axis=1)
        return pd.DataFrame(
            {"lang_pred": name, "score": score, "accepted": read & (score >= model.least), "n_subwords": total[:, -1].astype("int64")}
        )


def identified(spark: SparkSession, text: Column, model: LanguageModel) -> Column:
    """Struct (lang_pred, score, accepted, n_subwords) of a text column.

    Null texts, and those without a letter, are `und` with score 0 and not accepted. Every whole text
    is read; equal texts get equal answers. A tie goes to the first language by name.
    """
    # Plain values: a broadcast is read in workers which may not have the package.
    shared = spark.sparkContext.broadcast(
        (model.languages, model.table, model.bias, model.scale, model.least)
    )

    @F.pandas_udf("lang_pred string, score double, accepted boolean, n_subwords long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        read = _Reader(LanguageModel(*shared.value))
        for texts in batches:
            yield read(texts.tolist())

    return of(F.coalesce(text, F.lit("")))


def fit_on(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    texts_per_language: int = 400,
    most_languages: int = 1000,
) -> LanguageModel:
    """Fit on at most `texts_per_language` whole texts of each language, chosen by a hash of id and text.

    Held-out rows, rows without id, language or letter are not used. Of rows with equal id and text one
    counts, by the least language. More than `most_languages` languages are refused, which bounds
    what is collected and broadcast.
    """
    free = docs.where(~held_out(docs[id_col])).select(
        docs[id_col].alias("_id"),
        docs[label_col].cast("string").alias("_lang"),
        F.xxhash64(docs[text_col]).alias("_digest"),
        docs[text_col].alias("_text"),
    )
    free = free.where("_id is not null and _lang is not null and _text is not null")
    rank = F.struct(F.xxhash64("_id", "_digest").alias("h"), "_id", "_digest")
    # First within parts of a language, so that no task ranks more than the parts' leaders of one.
    part = F.pmod(F.xxhash64("_digest", "_id"), F.lit(RANKED_PARTS))
    keys = free.select("_lang", "_id", "_digest", part.alias("_part"))
    for by in (("_lang", "_part"), ("_lang",)):
        nth = F.row_number().over(Window.partitionBy(*by).orderBy(rank))
        keys = keys.withColumn("_nth", nth).where(F.col("_nth") <= texts_per_language)
    chosen = keys.groupBy("_id", "_digest").agg(F.min("_lang").alias("_lang"))
    held = chosen.select("_lang").distinct().limit(most_languages + 1).count()
    if held > most_languages:
        raise ValueError(f"more than {most_languages} languages")

    @F.pandas_udf("rows binary, counts binary")
    def features(texts: pd.Series) -> pd.DataFrame:
        found = [text_rows(t) for t in texts]
        return pd.DataFrame(
            {"rows": [r.tobytes() for r, _ in found], "counts": [c.tobytes() for _, c in found]}
        )

    # At most texts_per_language times most_languages keys.
    read = (
        free.select("_id", "_digest", "_text")
        .join(F.broadcast(chosen), ["_id", "_digest"])
        .select("_id", "_digest", "_lang", features("_text").alias("x"))
        .select("_id", "_digest", "_lang", "x.*")
        .collect()
    )
    once = {(r["_id"], r["_digest"]): r for r in read if r["rows"]}
    rows = [once[k] for k in sorted(once)]
    return fit(
        [(np.frombuffer(r["rows"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in rows],
        [r["_lang"] for r in rows],
    )
