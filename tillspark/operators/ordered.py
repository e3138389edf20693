"""Global order without a one-task window: running totals, tiles, average ranks, quantiles.

A window without PARTITION BY moves every row to one task, and a window over a hot key moves
that key to one task. Here rows are first put into order-preserving buckets. The bucket limits
come from a hash-selected sample of the order keys, so they are the same on every attempt, and
any limits give the right result; they only decide the balance. Each bucket is then numbered on
its own and shifted by the totals of the buckets before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tillspark.functions.columns import known

_scratch: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


def keep(df: DataFrame) -> DataFrame:
    """Persist an intermediate which is read several times (spilling to disk)."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    if (frames := _scratch.get()) is not None:
        frames.append(kept)
    return kept


@contextmanager
def scratch() -> Iterator[None]:
    """Release the intermediates of all operators called inside, on leaving.

    Run the actions inside the block. Without it, intermediates stay cached for the session.
    """
    token = _scratch.set([])
    try:
        yield
    finally:
        for df in _scratch.get() or []:
            df.unpersist()
        _scratch.reset(token)


#: The number of buckets follows the rows; a table of any size has at least LEAST_BUCKETS.
ROWS_PER_BUCKET = 1_000_000
LEAST_BUCKETS = 4
SAMPLE_PER_BUCKET = 16


def _bucket_limits(df: DataFrame, key: Column, rows: int, buckets: int) -> Column:
    """Sorted array literal with the first order key of every bucket but the first."""
    every = max(1, rows // (buckets * SAMPLE_PER_BUCKET))
    picked = df.select(key.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0)
    step = F.greatest(F.lit(1), F.floor(F.size("s") / F.lit(buckets)).cast("int"))
    limits = picked.agg(F.sort_array(F.collect_list("k")).alias("s")).select(
        F.filter("s", lambda _, i: (i > 0) & (i % step == 0)).alias("limits")
    )
    # One row with about one key per bucket.
    text = limits.select(F.to_json("limits")).first()[0]
    return F.from_json(F.lit(text), T.ArrayType(picked.schema["k"].dataType))


def _bucket_of(key: Column, limits: Column, depth: int) -> Column:
    """Number of limits not above the key, by binary search."""

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        goes_right = F.get(limits, mid) <= key
        narrowed = F.struct(
            F.when(goes_right, mid + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(goes_right, acc["hi"]).otherwise(mid).alias("hi"),
        )
        return F.when(acc["lo"] < acc["hi"], narrowed).otherwise(acc)

    start = F.struct(F.lit(0).alias("lo"), F.size(limits).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, halve, lambda a: a["lo"])


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    totals: dict[str, Column],
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add inclusive running sums over an ascending, unique order, optionally per key.

    `df` is evaluated more than once; pass something already aggregated, persisted or written.
    """
    rows = df.count()
    buckets = max(LEAST_BUCKETS, math.ceil(rows / rows_per_bucket))
    named = df.withColumn("_k", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    for name, weight in totals.items():
        named = named.withColumn(f"_w_{name}", weight)
    by = list(by)
    limits = _bucket_limits(named, F.col("_k"), rows, buckets)
    depth = math.ceil(math.log2(SAMPLE_PER_BUCKET * buckets)) + 1
    placed = named.withColumn("_b", _bucket_of(F.col("_k"), limits, depth))
    sizes = placed.groupBy(*by, "_b").agg(*[F.sum(f"_w_{n}").alias(f"_t_{n}") for n in totals])
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_r_{c}") for c in [*by, "_b"]],
        *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in totals],
    )
    inside = W.partitionBy(*by, "_b").orderBy("_k").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    for name in totals:
        placed = placed.withColumn(f"_i_{name}", F.sum(f"_w_{name}").over(inside))
    match = F.lit(True)
    for c in [*by, "_b"]:
        match = match & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    joined = placed.join(offsets, match)
    for name in totals:
        # COALESCE keeps the type: the first bucket has no offset
        shifted = F.col(f"_i_{name}") + F.coalesce(F.col(f"_o_{name}"), F.lit(0))
        joined = joined.withColumn(name, shifted.cast(placed.schema[f"_i_{name}"].dataType))
    helpers = ["_k", "_b", *[f"_r_{c}" for c in [*by, "_b"]]]
    for name in totals:
        helpers += [f"_w_{name}", f"_i_{name}", f"_o_{name}"]
    return joined.drop(*helpers)


def row_numbers(
    df: DataFrame,
    order: Sequence[Column],
    name: str = "row_number",
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """1-based position in a unique ascending order."""
    one = F.lit(1).cast("bigint")
    return running_totals(df, order, {name: one}, by, rows_per_bucket)


def tile(position: Column, rows: Column, tiles: int) -> Column:
    """NTILE from a position and a row count: the first rows % tiles tiles get one more row."""
    small = F.floor(rows / tiles)
    extra = rows % tiles
    in_large = extra * (small + 1)
    return (
        F.when(position <= in_large, F.floor((position - 1) / (small + 1)))
        .otherwise(extra + F.try_divide(position - in_large - 1, small).cast("bigint"))
        .cast("int")
        + 1
    )


def value_ranks(
    df: DataFrame,
    column: str,
    by: Sequence[str] = (),
    counts: dict[str, Column] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per distinct value: how often it occurs and the average rank it shares.

    `counts` adds further conditional counts per value (NULL and NaN in `column` are left out).
    """
    extra = {name: F.sum(c.cast("bigint")).alias(name) for name, c in (counts or {}).items()}
    real = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    present = F.col(column).isNotNull() & (~F.isnan(column) if real else F.lit(True))
    per_value = keep(
        df.where(present)
        .groupBy(*by, column)
        .agg(F.count(F.lit(1)).alias("n"), *extra.values())
    )
    return _ranked(per_value, column, by, rows_per_bucket)


def _ranked(
    per_value: DataFrame, column: str, by: Sequence[str], rows_per_bucket: int
) -> DataFrame:
    run = running_totals(
        per_value, [F.col(column)], {"upto": F.col("n")}, by, rows_per_bucket
    )
    return run.withColumn("average_rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)


def count_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Distinct values of columns and how often they occur: (by..., column, _v, n).

    Repeated values shrink on the map side; NULL and NaN are left out.
    """
    cells = [
        F.struct(F.lit(c).alias("column"), known(F.col(c)).alias("_v")) for c in columns
    ]
    long = df.select(*by, F.inline(F.array(*cells)))
    return long.where("_v IS NOT NULL").groupBy(*by, "column", "_v").agg(
        F.count(F.lit(1)).alias("n")
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Exact, linearly interpolated quantiles as rows (by..., column, probability, value).

    Values are counted before they are ordered, so repeated values shrink on the map side and
    no single task holds the values of a column.
    """
    return counted_quantiles(count_values(df, columns, by), probabilities, by, rows_per_bucket)


def counted_quantiles(
    counted: DataFrame,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """The same quantiles from values which `count_values` has counted."""
    by = list(by)
    ranked = _ranked(keep(counted), "_v", [*by, "column"], rows_per_bucket)
    sizes = ranked.groupBy(*by, "column").agg(F.sum("n").alias("_size"))
    sized = ranked.select(*by, "column", "_v", "n", "upto").join(
        sizes.select(*[F.col(c).alias(f"_s_{c}") for c in [*by, "column"]], "_size"),
        _all_equal([*by, "column"], "_s_"),
    )
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    first = F.col("upto") - F.col("n")
    hits = (
        sized.withColumn("probability", F.explode(wanted))
        .withColumn("_at", (F.col("_size") - 1) * F.col("probability"))
        .withColumn("_lo", F.floor("_at"))
        .withColumn("_hi", F.ceil("_at"))
    )
    holds = lambda i: (i >= first) & (i < F.col("upto"))
    hits = hits.where(holds(F.col("_lo")) | holds(F.col("_hi")))
    return (
        hits.groupBy(*by, "column", "probability")
        .agg(
            F.max(F.when(holds(F.col("_lo")), F.col("_v"))).alias("_a"),
            F.max(F.when(holds(F.col("_hi")), F.col("_v"))).alias("_z"),
            F.max(F.col("_at") - F.col("_lo")).alias("_f"),
        )
        .select(
            *by,
            "column",
            "probability",
            (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f")).alias("value"),
        )
    )


def _all_equal(names: Sequence[str], prefix: str) -> Column:
    match = F.lit(True)
    for c in names:
        match = match & F.col(c).eqNullSafe(F.col(prefix + c))
    return match


def wide_quantiles(
    quantiles: DataFrame, names: dict[float, str], by: Sequence[str] = ()
) -> DataFrame:
    """Turn the rows of `exact_quantiles` into one row per key and column."""
    return quantiles.groupBy(*by, "column").agg(
        *[
            F.max(F.when(F.col("probability") == F.lit(float(p)), F.col("value"))).alias(name)
            for p, name in names.items()
        ]
    )
