"""Intermediate tables of the operators, and the reading of input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.sources.workspace import materialize, new_folder

#: White space which separates words, and a word, as Java patterns.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, column: str = "text"):
    """The text, empty where it is null."""
    return F.coalesce(docs[column], F.lit(""))


def word_count(text):
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, lengthened where the table has such a column, so that none of its own is lost."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def row_key(df: DataFrame):
    """128 bits of a digest over all columns of a row: equal only for rows equal in every column."""

    def part(name: str):
        value = F.col(f"`{name}`").cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.substring(F.sha2(F.concat(*[part(c) for c in df.columns]), 256), 1, 32)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value which is computed once; inside a lambda a plain one would be for each item."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _summed(values: Column, first: Column) -> Column:
    """`first`, then `first` and the sums of the values before each; for short arrays."""
    return F.aggregate(
        values,
        F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, v: F.struct(
            (acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")
        ),
        lambda acc: acc["out"],
    )


def sums_before(values: Column) -> Column:
    """For each element of an array<bigint> the sum of those before it.

    Arrays cannot be appended to in place, so this is done in stretches of about the root of the size:
    a hundred thousand elements take thirty million steps, not ten thousand million.
    """
    zero = F.lit(0).cast("long")

    def of(v: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        cut = F.transform(F.sequence(F.lit(0), F.size(v) - 1, step), lambda i: F.slice(v, i + 1, step))
        whole = lambda part: F.aggregate(part, zero, lambda a, x: a + x)
        return bound(
            cut,
            lambda parts: F.flatten(
                F.zip_with(parts, _summed(F.transform(parts, whole), zero), _summed)
            ),
        )

    return bound(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<bigint>")))


#: Characters of a block of a text that is cut at many places.
BLOCK = 512


def blocks_of(text: Column) -> Column:
    """The text in blocks of BLOCK characters, for `cut_out`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut_out(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start (from 0) to end (exclusive) of a text in blocks; only their blocks are read."""
    first = F.floor(start / BLOCK).cast("int")
    count = F.floor((end - 1) / BLOCK).cast("int") - first + 1
    whole = F.array_join(F.slice(blocks, first + 1, F.greatest(count, F.lit(0))), "")
    inside = F.substring(whole, (start - first.cast("long") * BLOCK + 1).cast("int"), (end - start).cast("int"))
    return F.when(end > start, inside).otherwise("")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage, survives lost executors."""
    return materialize(df, new_folder(df.sparkSession, f"llm-{label}"))
