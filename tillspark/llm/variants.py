"""Spelling variants: pairs of words one edit apart, found by composing finite-state machines.

The vocabulary is a minimised acyclic acceptor A; T is the transducer which copies a word but for
one inserted, deleted or replaced code point. Accepted paths of A o T o A are the near pairs. A
state of the composition is (state of A, state of A, edit taken or not); its paths are enumerated
one partition of initial states at a time. An initial state stands for half a word: two words one
edit apart agree in the first half (read forwards) or in the second (read backwards), so every
pair lies in a partition of words which share one half, and only that partition's acceptor is
built. Partitions of more than `MOST` words are cut at the next letter until none is left, so no
task holds more, whatever the vocabulary.

Sizes: words are sent to four partitions each (two lengths of partner, two directions).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.scratch import keep, text_of

#: Words of a partition; larger ones are cut at the next letter.
MOST = 20_000
#: Fixed by the contract: letters of a run, least code points of a word, least occurrences, and how
#: many times more often than the word its form must occur.
RUN = r"[A-Za-zÀ-ÿ]"
LEAST_LETTERS, LEAST_TIMES, TIMES_MORE = 7, 2, 10
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Acceptor:
    """Minimal deterministic acceptor of sorted distinct words; state 0 .. n-1, `start` the first."""

    def __init__(self, words: list[str]):
        self.moves: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        open_: list[tuple[list[bool], dict[str, int]]] = [([False], {})]
        last = ""

        def close(down_to: int) -> None:
            """States below depth `down_to` of the last word are complete: merge equal ones."""
            while len(open_) > down_to + 1:
                (final,), moves = open_.pop()
                sign = (final, *moves.items())
                state = known.get(sign)
                if state is None:
                    state = known[sign] = len(self.moves)
                    self.moves.append(moves)
                    self.final.append(final)
                open_[-1][1][last[len(open_) - 1]] = state

        for word in words:
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            close(same)
            open_.extend(([False], {}) for _ in range(len(word) - same))
            open_[-1][0][0] = True
            last = word
        close(0)
        self.start = len(self.moves)
        self.moves.append(open_[0][1])
        self.final.append(open_[0][0][0])


def _tails(a: Acceptor, p: int, q: int, barred: str | None) -> Iterator[str]:
    """Words accepted from both states, not starting with `barred`: paths after the edit."""
    moves, final = a.moves, a.final
    if final[p] and final[q]:
        yield ""
    stack = [("", p, q)]
    while stack:
        read, p, q = stack.pop()
        of_p, of_q = moves[p], moves[q]
        for c in of_p.keys() & of_q.keys():
            if c == barred and not read:
                continue
            p2, q2 = of_p[c], of_q[c]
            if final[p2] and final[q2]:
                yield read + c
            if moves[p2] and moves[q2]:
                stack.append((read + c, p2, q2))


def near_pairs(words: list[str], replace: bool = True, at_start: bool = False) -> Iterator[tuple[str, str]]:
    """Unordered pairs of the sorted distinct `words` which differ by exactly one code point.

    `replace` admits replaced code points besides inserted ones; `at_start` only admits an edit at
    the first place at which two words differ being the very first.
    """
    a = Acceptor(words)
    moves, final = a.moves, a.final
    stack = [("", a.start)]
    while stack:
        read, state = stack.pop()
        out = moves[state]
        places = sorted(out.items())
        for i, (c, to) in enumerate(places):
            next_moves, next_final = moves[to], final[to]
            # c is inserted: the shorter word goes on from `state`, the longer one from `to`.
            if (next_final and final[state]) or not out.keys().isdisjoint(next_moves):
                for tail in _tails(a, state, to, c):
                    yield read + tail, read + c + tail
            if replace:
                for d, other in places[i + 1 :]:
                    if to == other or (next_final and final[other]) or not next_moves.keys().isdisjoint(moves[other]):
                        for tail in _tails(a, to, other, None):
                            yield read + c + tail, read + d + tail
            if not at_start and next_moves:
                stack.append((read + c, to))


def _partition_pairs(back: bool, size: int, depth: int, cross: bool, words: list[str]) -> Iterator[tuple]:
    """Near pairs of one partition which no other partition reports.

    Its words, of `size` or `size` + 1 letters, share their first `depth` ones in reading direction.
    Pairs which agree in the first half are reported forwards only; replaced letters are looked for
    in partitions of even size, which hold both lengths.
    """
    turned = sorted(w[::-1] for w in words) if back else words
    head = turned[0][:depth]
    half = size // 2
    for x, y in near_pairs([w[depth:] for w in turned], size % 2 == 0, cross):
        x, y = head + x, head + y
        if back:
            x, y = x[::-1], y[::-1]
            if x[:half] == y[:half]:
                continue
        yield x, y


def _sent(words: DataFrame) -> DataFrame:
    """Every word once for each partition it belongs to: (back, size, depth, cross, key, word, n)."""
    length = F.length("word")
    both = (
        words.withColumn("size", F.explode(F.array(length, length - 1)))
        .where("size >= 0")
        .withColumn("back", F.explode(F.array(F.lit(False), F.lit(True))))
    )
    half = F.floor(F.col("size") / 2).cast("int")
    return _keyed(
        both.withColumn("depth", F.when(F.col("back"), F.col("size") - half).otherwise(half)).withColumn(
            "cross", F.lit(False)
        )
    )


def _keyed(sent: DataFrame) -> DataFrame:
    turned = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    head = turned.substr(F.lit(1), F.col("depth"))
    tail = F.reverse(F.reverse(turned).substr(F.lit(1), F.col("size") - 1 - F.col("depth")))
    # A letter which no head holds parts the two; the tail is what follows the edit.
    key = F.when(F.col("cross"), F.concat(head, F.lit("\n"), tail)).otherwise(head)
    return sent.withColumn("key", key)


_PLACE = ["back", "size", "depth", "cross", "key"]


def _partitions(words: DataFrame, most: int) -> DataFrame:
    """Partitions with all their words: none holds over `most`, but for those bounded by the alphabet.

    A larger partition becomes one for each next letter, and one for each tail that its words may
    have after an edit at that letter; the latter hold at most a letter or two besides what they share.
    """
    sent, done = _sent(words), None
    while True:
        large = (
            sent.where("not cross and depth < size")
            .groupBy(_PLACE)
            .count()
            .where(F.col("count") > most)
            .drop("count")
        )
        large = keep(large, "large-partitions")
        if large.isEmpty():
            return sent if done is None else done.unionByName(sent)
        cold = sent.join(large, _PLACE, "left_anti")
        done = cold if done is None else done.unionByName(cold)
        hot = sent.join(large, _PLACE, "left_semi")
        deeper = hot.withColumn("depth", F.col("depth") + 1)
        across = hot.withColumn("cross", F.lit(True)).where("depth < size")
        sent = _keyed(deeper.unionByName(across))


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, other, other_n) for every ordered pair of distinct words one code point apart.

    `words` has distinct non-null `word` and `n`. Each pair is found once, in one partition, and
    turned into two rows.
    """

    @F.pandas_udf("array<struct<a:int, b:int>>")
    def pairs(back: pd.Series, size: pd.Series, depth: pd.Series, cross: pd.Series, held: pd.Series) -> pd.Series:
        out = []
        for b, s, d, c, its in zip(back, size, depth, cross, held, strict=True):
            its = list(its)
            place = {w: i for i, w in enumerate(its)}
            out.append([{"a": place[x], "b": place[y]} for x, y in _partition_pairs(b, s, d, c, its)])
        return pd.Series(out, dtype=object)

    groups = (
        _partitions(words, most)
        .groupBy(_PLACE)
        .agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("held"))
        .where("size(held) > 1")
    )
    found = groups.withColumn(
        "pairs", pairs("back", "size", "depth", "cross", F.col("held.word"))
    ).select("held", F.explode("pairs").alias("p"))
    a, b = F.col("held")[F.col("p.a")], F.col("held")[F.col("p.b")]
    return found.select(F.explode(F.array(F.struct(a, b), F.struct(b, a))).alias("e")).select(
        F.col("e.col1.word").alias("word"),
        F.col("e.col2.word").alias("other"),
        F.col("e.col2.n").alias("other_n"),
    )


def group_variants(words: DataFrame, times: int = TIMES_MORE, most: int = MOST) -> DataFrame:
    """`word, form, root, n, n_near, form_n` for a table of distinct words and their counts.

    A word's form is its near word of largest n (on a tie the first in code-point order), if that n
    is at least `times` the word's; the root is the end of the chain of forms. A chain multiplies n
    at each step, so it has at most 18 steps and five rounds of pointer doubling reach its end. Null
    words are left out; an empty table gives an empty result; other columns are dropped.
    """
    if times < 2:
        raise ValueError("a form must occur at least twice as often as its word")
    words = keep(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words, most).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best")
    )
    is_form = -F.col("best.m") >= times * F.col("n")
    forms = keep(
        words.join(near, "word", "left").select(
            "word",
            F.when(is_form, F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, -F.col("best.m")).alias("form_n"),
        ),
        "forms",
    )
    chain = forms.where("form is not null").select("word", F.col("form").alias("root"))
    changed = True
    while changed:
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("farther"))
        chain = keep(
            chain.join(ahead, "root", "left").select(
                "word", F.coalesce("farther", "root").alias("root"), F.col("farther").isNotNull().alias("moved")
            ),
            "chain",
        )
        changed = not chain.where("moved").isEmpty()
        chain = chain.drop("moved")
    return forms.join(chain, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`word, n`: letter runs of whole texts, thinned of one code point where the contract's digest says so.

    Null texts have none; a null id deletes nothing. Rows are taken one by one, so repeated rows
    count as often as they occur. Runs of less than seven code points cannot become words.
    """
    runs = F.regexp_extract_all(text_of(docs, text_col), F.lit(RUN + "{%d,}" % LEAST_LETTERS), F.lit(0))
    each = docs.select(F.col(id_col).cast("string").alias("_of"), F.explode(runs).alias("_run"))
    low = each.select("_of", F.translate("_run", _CAPITALS, _SMALL).alias("_run"))
    digest = F.crc32(F.concat("_of", F.lit(":"), "_run").cast("binary"))
    at = (digest % F.length("_run")).cast("int")
    cut = F.concat(F.col("_run").substr(F.lit(1), at), F.col("_run").substr(at + 2, F.length("_run")))
    return (
        low.select(F.when(digest % 31 == 0, cut).otherwise(F.col("_run")).alias("word"))
        .where(F.length("word") >= LEAST_LETTERS)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= LEAST_TIMES)
    )
