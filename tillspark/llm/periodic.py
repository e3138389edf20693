"""Runs: maximal stretches of words which repeat with a period, found by string synchronising sets.

For every dyadic scale t = 1, 2, 4, ... a synchronising set holds positions chosen by the hash of the
t words which start there: position i is in it if, among the t + 1 windows from i to i + t which are
not themselves highly periodic (period at most t / 3), the least hash is that of the first or the
last. The choice looks at 2 t words only, so equal contexts choose equally, and any 3 t - 1 words
without such a small period hold a chosen position among their first t. A run of period q, t <= q <
2 t, and at least four periods therefore holds two chosen positions q apart with equal contexts of
2 t words, and no nearer pair: neighbours with equal contexts propose their distance as a period.
The highly periodic windows, which are found by the next place of their first half, propose the
small periods which a scale leaves out. Proposals are extended both ways by doubling and reported
once, with their smallest period.

Kempa and Kociumaka, "String Synchronizing Sets" (2019). Equal stretches are told by exact names
(pairs of names of halves, renumbered at each scale); hashes only order them. A position whose
words recur nowhere in its text is left out of larger scales.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.scratch import WORD, text_of

_WORD = re.compile(WORD)
#: Words of texts searched at once; a longer text is searched alone.
WORDS_AT_ONCE = 200_000
#: Fixed by the contract: least length of a run, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_FAR = np.iinfo(np.int64).max


def _renamed(key: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the keys at positions `at` (ascending) which occur twice or more; -1 - i elsewhere.

    Second result: the next position of the same name, or _FAR.
    """
    name = -1 - np.arange(size)
    after = np.full(size, _FAR)
    if not len(at):
        return name, after
    order = np.argsort(key, kind="stable")
    sorted_key, place = key[order], at[order]
    same = sorted_key[1:] == sorted_key[:-1]
    group = np.concatenate(([0], np.cumsum(~same)))
    again = np.concatenate((same, [False])) | np.concatenate(([False], same))
    name[place[again]] = group[again]
    after[place[:-1][same]] = place[1:][same]
    return name, after


def _mixed(name: np.ndarray) -> np.ndarray:
    """A 63-bit hash of names, one to one up to its last shift; the least is chosen."""
    x = name.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Least of `width` values from each position on; past the end nothing counts."""
    out, span = values, 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out, np.concatenate((out[step:], np.full(step, _FAR)))[: len(out)])
        span += step
    return out


def _ahead(values: np.ndarray, step: int, fill: int) -> np.ndarray:
    """values[i + step], `fill` past the end."""
    if step >= len(values):
        return np.full(len(values), fill)
    return np.concatenate((values[step:], np.full(step, fill)))


def find_runs(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Runs (start, end, period) of texts laid end to end, ascending by start and period.

    `words` are word numbers of at least 0, `text` the number of the text of each word, ascending.
    """
    size = len(words)
    if size < LEAST_WORDS:
        return np.zeros((0, 3), np.int64)
    here = np.arange(size)
    # Names differ between texts, so that no stretch of one equals that of another.
    name, after = _renamed(text.astype(np.int64) * (int(words.max()) + 1) + words, here, size)
    names = [name]
    proposed: list[tuple[np.ndarray, np.ndarray]] = []
    scale = 1
    earlier_after = after  # next place of the window of half a scale
    while True:
        name = names[-1]
        live = np.flatnonzero(name >= 0)
        live = live[live + scale < size]
        live = live[name[live + scale] >= 0]
        key = name[live] * (size + 1) + name[live + scale]
        context, context_after = _renamed(key, live, size)
        # Highly periodic windows: the first half recurs at a distance of at most a third.
        periodic = np.zeros(size, bool)
        if scale >= 4:
            half = scale // 2
            near = np.flatnonzero(earlier_after < _FAR)
            apart = earlier_after[near] - near
            near, apart = near[3 * apart <= scale], apart[3 * apart <= scale]
            inside = near + scale <= size
            near, apart = near[inside], apart[inside]
            halves = names[-2]
            tail = halves[near + half - apart] == halves[near + half]
            near, apart = near[tail], apart[tail]
            periodic[near] = True
            first = np.ones(len(near), bool)
            first[1:] = (near[1:] != near[:-1] + 1) | (apart[1:] != apart[:-1])
            proposed.append((near[first], apart[first]))
        whole = here + scale <= size
        identity = np.where(periodic | ~whole, _FAR, _mixed(name))
        least = _least_of(identity, scale + 1)
        chosen = (least < _FAR) & ((least == identity) | (least == _ahead(identity, scale, _FAR)))
        # Chosen positions with equal contexts are chosen together, so the next place of the same
        # context is the next chosen one.
        first = np.flatnonzero(chosen & (context_after < _FAR))
        apart = context_after[first] - first
        good = (apart >= scale) & (apart < 2 * scale)
        proposed.append((first[good], apart[good]))
        if not (context >= 0).any():
            break
        earlier_after = after
        after = context_after
        names.append(context)
        scale *= 2
    start = np.concatenate([p[0] for p in proposed])
    period = np.concatenate([p[1] for p in proposed])
    return _extended(names, start, period, size)


def _extended(names: list[np.ndarray], start: np.ndarray, period: np.ndarray, size: int) -> np.ndarray:
    """Proposals extended to both sides while words a period apart agree; long enough ones, once."""
    if len(start):
        start, period = np.unique(np.stack((start, period)), axis=1)
    right, left = start.copy(), start.copy()
    for level in range(len(names) - 1, -1, -1):
        step, name = 1 << level, names[level]
        for _ in range(2 if level == len(names) - 1 else 1):
            fits = right + period + step <= size
            at = np.where(fits, right, 0)
            same = fits & (name[at] == name[np.where(fits, right + period, 0)]) & (name[at] >= 0)
            right += step * same
            fits = left >= step
            at = np.where(fits, left - step, 0)
            same = fits & (name[at] == name[at + np.where(fits, period, 0)]) & (name[at] >= 0)
            left -= step * same
    end = right + period
    enough = end - left >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    left, end, period = left[enough], end[enough], period[enough]
    order = np.lexsort((period, end, left))
    left, end, period = left[order], end[order], period[order]
    # The smallest period of a stretch divides all others that are a quarter of its length or less.
    first = np.ones(len(left), bool)
    first[1:] = (left[1:] != left[:-1]) | (end[1:] != end[:-1])
    out = np.stack((left[first], end[first], period[first]), axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of(texts: list[list[str]]) -> list[tuple[list[tuple[int, int, int]], np.ndarray]]:
    """Of each text, given as its words: runs (start, length, period), and which words stay.

    Of every run the first period stays; a word which any run holds after that goes.
    """
    number: dict[str, int] = {}
    lengths = np.array([len(t) for t in texts], np.int64)
    flat = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int64)
    first = np.cumsum(lengths) - lengths
    found = find_runs(flat, np.repeat(np.arange(len(texts)), lengths))
    gone = np.zeros(len(flat) + 1, np.int64)
    np.add.at(gone, found[:, 0] + found[:, 2], 1)
    np.add.at(gone, found[:, 1], -1)
    stays = np.cumsum(gone[:-1]) == 0
    of_text = np.searchsorted(first, found[:, 0], side="right") - 1
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (start, end, period), t in zip(found.tolist(), of_text.tolist(), strict=True):
        # Empty texts share their first position with the next one: the last of equals holds words.
        runs[t].append((start - int(first[t]), end - start, period))
    return [(r, stays[f : f + n]) for r, f, n in zip(runs, first.tolist(), lengths.tolist(), strict=True)]


def collapsed_runs(text: Column) -> Column:
    """Struct (n_words, runs, collapsed) of a text column.

    `runs` are (start, length, period) in words, by start, then period; `collapsed` are the words
    which stay, joined by one space. A null or empty text, or one of white space, has no words, no
    runs and an empty rest. Texts are taken one by one, so equal texts have equal results.
    """

    @F.pandas_udf("n_words long, runs array<struct<start:long, length:long, period:long>>, collapsed string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows, group, held = [], [], 0
            for text in texts:
                group.append(_WORD.findall(text))
                held += len(group[-1])
                if held >= WORDS_AT_ONCE:
                    rows.extend(_rows(group))
                    group, held = [], 0
            rows.extend(_rows(group))
            yield pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])

    return of(F.coalesce(text, F.lit("")))


def _rows(group: list[list[str]]) -> Iterator[tuple]:
    for words, (runs, stays) in zip(group, runs_of(group), strict=True):
        told = [{"start": s, "length": n, "period": p} for s, n, p in runs]
        kept = words if not runs else [w for w, s in zip(words, stays.tolist(), strict=True) if s]
        yield len(words), told, " ".join(kept)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; then smallest start, then period.

    Null where there is none. `runs` are in the order of start and period.
    """

    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of the contract's input: of every tenth text, by digest of its id, the end is made periodic.

    With n words and h the crc32 of the id: from word a = h // 10 mod n on, words repeat with the
    period 1 + (n - a) // (3 + h // 10 mod 8). A null id leaves its text as it is; null texts are
    empty.
    """
    digest = F.crc32(docs[id_col].cast("string").cast("binary"))
    words = F.regexp_extract_all(text_of(docs, text_col), F.lit(WORD), F.lit(0))
    held = docs.select(
        docs[id_col].alias(id_col),
        text_of(docs, text_col).alias(text_col),
        digest.alias("_h"),
        F.when(digest % 10 == 0, words).alias("_words"),
    )
    g, n = F.floor(F.col("_h") / 10), F.size("_words").cast("long")
    a = g % F.greatest(n, F.lit(1))
    period = 1 + F.floor((n - a) / (3 + g % 8))
    unit = F.slice("_words", (a + 1).cast("int"), period.cast("int"))
    times = F.ceil((n - a) / period).cast("int")
    end = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), (n - a).cast("int"))
    repeated = F.concat(F.slice("_words", F.lit(1), a.cast("int")), end)
    return held.select(
        id_col, F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col(text_col)).alias(text_col)
    )
