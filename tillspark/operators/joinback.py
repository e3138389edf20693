"""Joining facts about groups back to their rows when a few groups are very large.

The rows of a large group would all meet in one task. Groups above `hot_rows` rows, known by the size
which they were counted with, are dealt to as many parts as they need; their one fact row is
repeated for each part. There are at most rows / hot_rows such groups, so the list which tells
rows about them is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.functions.columns import same

#: Rows of a group which one task takes.
HOT_ROWS = 1_000_000


def join_back(
    rows: DataFrame,
    groups: DataFrame,
    keys: Mapping[str, str],
    size: str,
    how: str = "left",
    hot_rows: int | None = None,
) -> DataFrame:
    """`rows` joined (left, left_semi or inner) with the one row in `groups` of the same key values.

    `keys` maps columns of `rows` to those of `groups`; NULL equals NULL. `size` is the column of
    `groups` with the number of rows of a group. Rows of a large group are dealt by the hash of all
    their columns, so they should differ in one, such as a line id; equal rows stay together.
    """
    most = F.lit(hot_rows or HOT_ROWS)
    of_row = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    of_group = F.xxhash64(*[F.col(f"`{k}`") for k in keys.values()])
    hot = F.broadcast(
        groups.where(F.col(size) > most)
        .groupBy(of_group.alias("_hot"))
        .agg(F.max(F.ceil(F.col(size) / most)).alias("_parts"))
    )
    dealt = (
        rows.withColumn("_spread", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
        .withColumn("_hash", of_row)
        .join(hot, F.col("_hash") == F.col("_hot"), "left")
        .withColumn("_part", F.pmod("_spread", F.coalesce("_parts", F.lit(1))))
        .drop("_spread", "_hot", "_parts")
    )
    repeated = (
        groups.withColumn("_group_hash", of_group)
        .join(hot, F.col("_group_hash") == F.col("_hot"), "left")
        .withColumn("_group_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        .drop("_hot", "_parts")
    )
    match = (
        (F.col("_hash") == F.col("_group_hash"))
        & (F.col("_part") == F.col("_group_part"))
        & same(dealt, repeated, dict(keys))
    )
    return dealt.join(repeated, match, how).drop("_hash", "_part", "_group_hash", "_group_part")
