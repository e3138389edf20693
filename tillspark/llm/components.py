"""Connected components of a link table, by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). All state is a table of
links in the shared folder; the driver sees one row of counts per round. Minimum labels combine
on the map side; in the joins back to a star's centre its links are dealt to salted parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.sources.workspace import materialize, new_folder, remove


def _with_least(rows: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """Rows (a, b) with `m`, the least `b` of their `a`, and the table (a, m).

    With two or more `salts` a hub of many links is dealt to so many parts throughout: its rows meet
    the minimum by part, and only one row per part meets by `a` alone.
    """
    if salts < 2:
        least = rows.groupBy("a").agg(F.min("b").alias("m"))
        return rows.join(least, "a"), least
    salted = rows.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(salts)))
    parts = salted.groupBy("a", "s").agg(F.min("b").alias("p"))
    least = parts.groupBy("a").agg(F.min("p").alias("m"))
    of_part = parts.select("a", "s").join(least, "a")
    return salted.join(of_part, ["a", "s"]).drop("s"), least


def _large_star(links: DataFrame, salts: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node's neighbourhood."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tied, _ = _with_least(both, salts)
    return tied.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(links: DataFrame, salts: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    tied, least = _with_least(links, salts)
    smaller = tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return smaller.union(least.select("a", F.col("m").alias("b")))


#: Links for each part into which a hub's links are dealt; so many may meet in one task.
LINKS_PER_SALT = 100_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over `links`, for each node with a link.

    Links may be repeated, in either direction, or join a node to itself; nulls are ignored. Nodes
    without any link to another are not returned. An empty table gives an empty result.
    """
    spark = links.sparkSession
    edges = (
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )

    def written(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = new_folder(spark, "llm-star")
        table = materialize(df, path)
        state = table.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        return table, path, tuple(state)

    now, path, state = written(edges)
    while True:
        salts = -(-state[0] // LINKS_PER_SALT)
        after, new_path, new_state = written(_small_star(_large_star(now, salts), salts).distinct())
        remove(spark, path)
        now, path = after, new_path
        if new_state == state:
            heads = now.select(F.col("b").alias("a"), "b").distinct()
            return now.union(heads).toDF("node", "component")
        state = new_state
