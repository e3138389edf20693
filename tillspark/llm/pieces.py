"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

All words of a batch lie in one flat array of symbols. A round finds the best pair of every word
(segmented minimum of the pair ranks), merges its leftmost occurrences in all words at once, and
compacts the array; words without a pair left drop out. Rounds go on until no pair remains.

Greedy BPE merges one pair at a time: best score first, leftmost among equals. Occurrences of a
word's best pair are merged in one round only up to the first whose merge makes a new pair that is
as good or better, because the sequential order would take that pair next. The result is the same
ids for every text. Words are cut where no piece of the vocabulary spans two neighbouring
characters; merges cannot cross such a point, so very long unbroken texts fall into short words.

Token ids travel as packed little-endian unsigned 32-bit integers (binary columns).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
NONE = np.iinfo(np.int32).max
#: Piece kinds of the model file, fixed by its format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
#: Words whose ids a worker keeps, and characters which are merged in one flat array.
CACHED_WORDS, FLAT_CHARACTERS = 200_000, 300_000

_SEGMENTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, message[at : at + size]
        at += size


@dataclass(frozen=True)
class Vocabulary:
    """What encoding and decoding need of a model file; its size is that of the vocabulary."""

    pieces: list[bytes]  # bytes which each id stands for when decoded
    kinds: np.ndarray
    characters: dict[str, int]  # symbol of each character which pieces are made of
    pair_keys: np.ndarray  # left symbol * symbols + right symbol, sorted
    pair_ids: np.ndarray
    pair_ranks: np.ndarray
    spanned: np.ndarray  # pairs of character symbols which occur inside a piece, sorted
    spanned_ranks: np.ndarray  # rank and id of the piece which such a pair makes by itself
    spanned_ids: np.ndarray
    symbols: int
    byte_ids: list[int]  # id of each byte, empty without byte fallback
    unknown: int
    begin: int
    end: int
    prefix: bool

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read a BPE model with identity normalisation; others are refused."""
        with open(path, "rb") as file:
            model = list(_fields(file.read()))
        rows = [dict(_fields(v)) for n, v in model if n == 1]
        trainer = dict(_fields(next((v for n, v in model if n == 2), b"")))
        normalizer = dict(_fields(next((v for n, v in model if n == 3), b"")))
        if trainer.get(3, 1) != 2 or normalizer.get(2) or normalizer.get(4, 1):
            raise ValueError("Only BPE models which leave texts as they are can be read")
        names = [row[1].decode() for row in rows]
        scores = [struct.unpack("<f", row.get(2, bytes(4)))[0] for row in rows]
        kinds = np.array([row.get(3, NORMAL) for row in rows], np.int8)
        if (kinds == USER_DEFINED).any():
            raise ValueError("Models with user-defined pieces cannot be read")
        known = {n: i for i, n in enumerate(names) if kinds[i] == NORMAL}
        # Words are cut before every run of spaces, so no piece may reach over such a place.
        if any(re.search(f"[^{SPACE}]{SPACE}", n) for n in known):
            raise ValueError("Models with a space inside a piece cannot be read")
        order = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        symbol = dict(known)
        for name in known:
            for c in name:
                symbol.setdefault(c, len(names) + len(symbol) - len(known))
        total = len(names) + len(symbol) - len(known)
        pairs = sorted(
            (symbol[name[:k]] * total + symbol[name[k:]], i)
            for name, i in known.items()
            for k in range(1, len(name))
            if name[:k] in symbol and name[k:] in symbol
        )
        made = dict(pairs)
        spans = sorted({
            symbol[x] * total + symbol[y]
            for name in known
            for x, y in zip(name, name[1:], strict=False)
        })
        ids = np.array([i for _, i in pairs], np.int32)
        byte_ids = [i for i, k in enumerate(kinds) if k == BYTE]
        decoded = [n.replace(SPACE, " ").encode() for n in names]
        for i, k in enumerate(kinds):
            if k == BYTE:
                decoded[i] = bytes([int(names[i][1:-1], 16)])
            elif k == CONTROL:
                decoded[i] = b""
            elif k == UNKNOWN:
                decoded[i] = bytes(trainer.get(44, b" \xe2\x81\x87 "))
        return Vocabulary(
            pieces=decoded,
            kinds=kinds,
            characters={c: s for c, s in symbol.items() if len(c) == 1},
            pair_keys=np.array([k for k, _ in pairs], np.int64),
            pair_ids=ids,
            pair_ranks=np.array([order[scores[i]] for i in ids], np.int32),
            spanned=np.array(spans, np.int64),
            spanned_ranks=np.array(
                [order[scores[made[k]]] if k in made else NONE for k in spans], np.int32
            ),
            spanned_ids=np.array([made.get(k, 0) for k in spans], np.int32),
            symbols=total,
            byte_ids=byte_ids if len(byte_ids) == 256 else [],
            unknown=int(np.flatnonzero(kinds == UNKNOWN)[0]),
            begin=trainer.get(41, 1),
            end=trainer.get(42, 2),
            prefix=bool(normalizer.get(3, 1)),
        )


class Encoder:
    """Encodes texts of a partition; keeps the ids of frequent words, within a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.of_character = np.full(0x110000, -1, np.int32)
        for c, s in vocabulary.characters.items():
            self.of_character[ord(c)] = s
        self.ids_of: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Packed ids of every text, with begin and end ids."""
        out: list[bytes] = []
        group, size = [], 0
        for text in texts:
            marked = text.replace(" ", SPACE)
            if self.v.prefix and marked:
                marked = SPACE + marked
            group.append(_SEGMENTS.findall(marked))
            size += len(marked)
            if size >= 4 * FLAT_CHARACTERS:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group)

    def _encode(self, group: list[list[str]]) -> list[bytes]:
        first, last = struct.pack("<I", self.v.begin), struct.pack("<I", self.v.end)
        ids_of = self._learn(set().union(*group))
        return [b"".join([first, *[ids_of[w] for w in words], last]) for words in group]

    def _learn(self, distinct: set[str]) -> dict[str, bytes]:
        if len(self.ids_of) > CACHED_WORDS:
            self.ids_of = {}
        found = {w: self.ids_of[w] for w in distinct if w in self.ids_of}
        batch, size = [], 0
        for w in distinct - found.keys():
            batch.append(w)
            size += len(w)
            if size >= FLAT_CHARACTERS:
                found.update(zip(batch, self.encode_words(batch), strict=True))
                batch, size = [], 0
        if batch:
            found.update(zip(batch, self.encode_words(batch), strict=True))
        self.ids_of.update((w, i) for w, i in found.items() if len(w) < 64)
        return found

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the merge of each pair; rank NONE where there is no such piece."""
        keys = left.astype(np.int64) * self.v.symbols + right
        at = np.minimum(np.searchsorted(self.v.pair_keys, keys), len(self.v.pair_keys) - 1)
        hit = (self.v.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(hit, self.v.pair_ranks[at], NONE), self.v.pair_ids[at]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbol, owner, points = self._merge(self.of_character[points], owner, points)
        fallback = (symbol < 0) | (symbol >= len(self.v.pieces))
        if not fallback.any():
            ids, count = symbol.astype("<u4"), np.bincount(owner, minlength=len(words))
        elif not self.v.byte_ids:
            ids = np.where(fallback, self.v.unknown, symbol).astype("<u4")
            count = np.bincount(owner, minlength=len(words))
        else:
            at = np.flatnonzero(fallback)
            spelt = [chr(p).encode("utf-8", "replace") for p in points[at]]
            times = np.ones(len(symbol), np.int64)
            times[at] = [len(b) for b in spelt]
            ids = np.repeat(symbol, times).astype("<u4")
            byte = np.array(self.v.byte_ids, "<u4")
            ids[np.repeat(fallback, times)] = byte[np.frombuffer(b"".join(spelt), np.uint8)]
            count = np.bincount(np.repeat(owner, times), minlength=len(words))
        packed, ends = ids.tobytes(), 4 * np.cumsum(count)
        return [
            packed[a:b] for a, b in zip((ends - 4 * count).tolist(), ends.tolist(), strict=True)
        ]

    def _merge(self, symbol, owner, points):
        """Merge rounds; returns the final symbols with owner and first character, in order."""
        n = len(symbol)
        place = np.arange(n)
        joined = owner[1:] == owner[:-1]
        keys = symbol[:-1].astype(np.int64) * self.v.symbols + symbol[1:]
        at = np.minimum(np.searchsorted(self.v.spanned, keys), len(self.v.spanned) - 1)
        joined &= (self.v.spanned[at] == keys) & (symbol[:-1] >= 0) & (symbol[1:] >= 0)
        part = np.concatenate(([0], np.cumsum(~joined)))
        rank, piece = np.full(n, NONE, np.int32), np.zeros(n, np.int32)
        rank[:-1] = np.where(joined, self.v.spanned_ranks[at], NONE)
        piece[:-1] = self.v.spanned_ids[at]
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(part)))
            live = np.repeat(best < NONE, size)
            if not live.all():
                ended.append((place[~live], symbol[~live]))
                place, symbol, part, rank, piece = (
                    x[live] for x in (place, symbol, part, rank, piece)
                )
                if not len(place):
                    break
                size, best = size[best < NONE], best[best < NONE]
            goal = np.repeat(best, size)
            merged = self._chosen(symbol, part, rank, piece, goal)
            symbol[merged] = piece[merged]
            kept = np.ones(len(symbol), bool)
            kept[merged + 1] = False
            moved = (np.cumsum(kept) - 1)[merged]
            place, symbol, part, rank, piece = (x[kept] for x in (place, symbol, part, rank, piece))
            changed = np.zeros(len(symbol), bool)
            changed[moved] = True
            changed[moved[moved > 0] - 1] = True
            fresh = np.flatnonzero(changed)
            rank[fresh] = NONE
            fresh = fresh[fresh + 1 < len(symbol)]
            fresh = fresh[part[fresh] == part[fresh + 1]]
            rank[fresh], piece[fresh] = self._ranks(symbol[fresh], symbol[fresh + 1])
        where = np.concatenate([p for p, _ in ended])
        order = np.argsort(where)
        where = where[order]
        return np.concatenate([s for _, s in ended])[order], owner[where], points[where]

    def _chosen(self, symbol, part, rank, piece, goal) -> np.ndarray:
        """Positions to merge in this round."""
        wanted = rank == goal
        at = np.flatnonzero(wanted)
        # Overlapping occurrences: every second one of a run, from its left end.
        run = np.concatenate(([True], (np.diff(at) > 1) | (part[at[1:]] != part[at[:-1]])))
        in_run = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[in_run % 2 == 0]
        own = part[at]
        before = np.maximum(at - 1, 0)
        left = np.where((at > 0) & (part[before] == own), symbol[before], -1)
        touching = np.concatenate(([False], (np.diff(at) == 2) & (own[1:] == own[:-1])))
        left[touching] = piece[at[:-1]][touching[1:]]
        after = np.minimum(at + 2, len(symbol) - 1)
        right = np.where((at + 2 < len(symbol)) & (part[after] == own), symbol[after], -1)
        new = np.minimum(self._ranks(left, piece[at])[0], self._ranks(piece[at], right)[0])
        stops = np.cumsum(new <= goal[at])
        before_it = np.concatenate(([0], stops[:-1]))
        first = np.concatenate(([True], own[1:] != own[:-1]))
        at_start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        return at[before_it == before_it[at_start]]


def decode_ids(vocabulary: Vocabulary, packed: bytes) -> str:
    """Text of packed ids, as the library's decode gives it."""
    ids = np.frombuffer(packed, "<u4")
    ids = ids[vocabulary.kinds[ids] != CONTROL]
    if not len(ids):
        return ""
    pieces = vocabulary.pieces
    raw = b"".join([pieces[i] for i in ids.tolist()])
    leading = vocabulary.prefix and vocabulary.kinds[ids[0]] == NORMAL and raw[:1] == b" "
    # A wrong byte is replaced by itself, not with the bytes around it.
    return (raw[1:] if leading else raw).decode("utf-8", "sp_replace")


def _replace_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


def _plain(vocabulary: Vocabulary) -> dict:
    """Plain values for a broadcast, which is read in workers that may not have the package."""
    return {f.name: getattr(vocabulary, f.name) for f in fields(vocabulary)}


def encoded(spark: SparkSession, text: Column, vocabulary: Vocabulary) -> Column:
    """Packed ids of a text column (null: like empty), begin and end ids included."""
    shared = spark.sparkContext.broadcast(_plain(vocabulary))

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(Vocabulary(**shared.value))
        for texts in batches:
            yield pd.Series(encoder(texts.tolist()), dtype=object)

    return encode(F.coalesce(text, F.lit("")))


def decoded(spark: SparkSession, packed: Column, vocabulary: Vocabulary) -> Column:
    """Text of a column of packed ids (null: empty text)."""
    shared = spark.sparkContext.broadcast(_plain(vocabulary))

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import codecs

        codecs.register_error("sp_replace", _replace_one)
        known = Vocabulary(**shared.value)
        for ids in batches:
            yield pd.Series([decode_ids(known, i) for i in ids], dtype=object)

    return decode(F.coalesce(packed, F.lit(b"")))


def round_trip(spark: SparkSession, text: Column, vocabulary: Vocabulary) -> Column:
    """(ids, text): the packed ids of a text and what they decode to, in one pass of one worker."""
    shared = spark.sparkContext.broadcast(_plain(vocabulary))

    @F.pandas_udf("ids binary, text string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import codecs

        codecs.register_error("sp_replace", _replace_one)
        known = Vocabulary(**shared.value)
        encoder = Encoder(known)
        for texts in batches:
            ids = encoder(texts.tolist())
            del texts
            back = [decode_ids(known, i) for i in ids]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "text": back})

    return both(F.coalesce(text, F.lit("")))


def token_count(packed: Column) -> Column:
    return (F.octet_length(packed) / 4).cast("long")


def token_ids(packed: Column) -> Column:
    """The packed ids as array<long>, natively."""
    digits = F.lower(F.hex(packed))

    def one(i: Column) -> Column:
        at = i * 8 + 1
        parts = [F.substring(digits, at + 2 * k, F.lit(2)) for k in (3, 2, 1, 0)]
        return F.conv(F.concat(*parts), 16, 10).cast("long")

    count = token_count(packed)
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), one)).otherwise(
        F.array().cast("array<long>")
    )
