"""SimHash near-duplicates: multi-index hashing over 64-bit fingerprints.

A fingerprint is cut into segments. Two fingerprints which differ in at most `radius` bits agree
up to `radius // segments` bits in one of the first segments (pigeonhole), so it is enough to look
up, for each such segment, the small Hamming ball around its value in a table of segment values,
and to verify the whole distance of what is found. Equal fingerprints are counted once before the
search, so a group of copies is one row of it. With two segments of 32 bits a table cell holds
about N / 2^32 distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.components import components
from tillspark.llm.scratch import keep, row_key, text_of

#: Fixed by the contract: seed of the shingle hash.
SEED = 42
BITS = 64


def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    """Majority of the bits of XXH64 over the text's word shingles, repeats included."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(words_per_shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [
        digest(joined[s:e], SEED)
        for s, e in zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)
    ]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at : at + (1 << 14)], np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint_column(text: Column, words_per_shingle: int = 3) -> Column:
    """The fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words_per_shingle) for t in texts], dtype="int64")

    return of(text)


def _balls(bits: int, radius: int) -> list[int]:
    """Masks of at most `radius` set bits among `bits`."""
    return [
        sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)
    ]


def _segments(bits: int, segments: int, radius: int) -> list[tuple[int, int, list[int]]]:
    """(shift, width, masks to probe) of each segment; some segment is that near by pigeonhole."""
    width, near, rest = bits // segments, radius // segments, radius % segments
    out = []
    for i in range(segments):
        wide = width if i < segments - 1 else bits - width * (segments - 1)
        within = near if i <= rest else near - 1
        if within >= 0:
            out.append((i * width, wide, _balls(wide, within)))
    return out


def hamming_links(prints: DataFrame, column: str, radius: int = 3, segments: int = 2) -> DataFrame:
    """(a, b): all pairs of different values of `column` at most `radius` bits apart.

    `prints` holds distinct values; `segments` is at least 2. A pair whose segments differ by a mask is found from the side
    which has a zero at the mask's lowest bit, so each segment finds it once.
    """
    def probes(number: int, part: Column, masks: list[int]) -> Column:
        balls = F.array(*[F.lit(m).cast("long") for m in masks])
        return F.transform(
            F.filter(balls, lambda m: part.bitwiseAND(m).bitwiseAND(-m) == 0),
            lambda m: F.struct(
                F.lit(number).alias("segment"),
                part.bitwiseXOR(m).alias("cell"),
                (m == 0).alias("same"),
            ),
        )

    looked_up, probing = [], []
    for number, (shift, width, masks) in enumerate(_segments(BITS, segments, radius)):
        part = F.shiftrightunsigned(F.col(column), shift).bitwiseAND(F.lit((1 << width) - 1))
        looked_up.append(F.struct(F.lit(number).alias("segment"), part.alias("cell")))
        probing.append(probes(number, part, masks))
    value = F.col(column)
    stored = prints.select(value.alias("b"), F.inline(F.array(*looked_up)))
    asked = prints.select(value.alias("a"), F.inline(F.flatten(F.array(*probing))))
    return (
        asked.join(stored, ["segment", "cell"])
        .where((~F.col("same") | (F.col("a") < F.col("b"))))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
        .select("a", "b")
    )


def _named(distinct: DataFrame, radius: int, segments: int) -> DataFrame:
    """Add `component`, the same value for linked fingerprints, to a table of distinct ones."""
    groups = components(hamming_links(distinct.select("simhash"), "simhash", radius, segments))
    return distinct.join(groups, distinct["simhash"] == groups["node"], "left").select(
        "simhash", "least", F.coalesce("component", "simhash").alias("component")
    )


def representatives(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 3,
    segments: int = 2,
    words_per_shingle: int = 3,
) -> DataFrame:
    """(_key, _rows): one row of every group of near-duplicates, and how many rows equal it.

    `_key` is `row_key` of the row with the smallest id, fingerprint and key of its group; null ids
    come last. Ids need not be unique: rows which share one are told apart by their keys.
    """
    prints = keep(
        docs.select(
            docs[id_col].alias("doc_id"),
            fingerprint_column(text_of(docs, text_col), words_per_shingle).alias("simhash"),
            row_key(docs).alias("_key"),
        ),
        "simhash-rows",
    )
    counted = prints.groupBy("simhash", "doc_id", "_key").agg(F.count("*").alias("_rows"))
    order = F.struct(F.isnull("doc_id").alias("_last"), "doc_id", "simhash", "_key", "_rows")
    distinct = counted.groupBy("simhash").agg(F.min(order).alias("least"))
    named = _named(distinct, radius, segments)
    return named.groupBy("component").agg(F.min("least").alias("least")).select("least._key", "least._rows")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 3,
    segments: int = 2,
    words_per_shingle: int = 3,
) -> DataFrame:
    """(doc_id, simhash, component_id) of every row; ids of near-duplicates share a component.

    Null and texts without words have fingerprint zero and link like any other. `component_id` is
    the smallest id reachable over fingerprints at most `radius` bits apart; null only if all ids
    of a group are null. Repeated rows and extra columns do no harm; an empty table stays empty.
    """
    prints = keep(
        docs.select(
            docs[id_col].alias("doc_id"),
            fingerprint_column(text_of(docs, text_col), words_per_shingle).alias("simhash"),
        ),
        "simhash",
    )
    distinct = prints.groupBy("simhash").agg(F.min("doc_id").alias("least"))
    named = _named(distinct, radius, segments)
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = named.join(first, "component").select("simhash", "component_id")
    return prints.join(of_print, "simhash").select("doc_id", "simhash", "component_id")
