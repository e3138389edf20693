"""Near-duplicate embeddings by lattice hashing.

Each table projects unit vectors at random into blocks of 8 dimensions and decodes every block to
the nearest point of the E8 lattice; the points are the table's cell. Besides its own cell, a
vector probes neighbouring cells: of all 240 shortest lattice steps in every block, those which
lead nearest to it. Vectors which meet in a cell are candidates, and their cosine is verified in
double precision. Equal vectors are counted once before the search.

Nothing below the threshold is ever linked. Above it, a pair is missed if its vectors meet in no
table; see `measured_recall` for the share found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.components import components
from tillspark.llm.scratch import keep


@dataclass(frozen=True)
class Lattice:
    tables: int = 10
    blocks: int = 2
    probes: int = 6
    #: Stretch of the projections: smaller means wider cells, more candidates, fewer misses.
    scale: float = 0.8
    seed: int = 20

    def projection(self, dimension: int) -> np.ndarray:
        rng = np.random.default_rng([self.seed, dimension])
        return rng.normal(size=(self.tables, dimension, 8 * self.blocks)) * self.scale


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with even sum: round, then fix the parity where it costs least."""
    near = np.rint(x)
    miss = x - near
    at = np.abs(miss).argmax(axis=-1)[..., None]
    other = np.take_along_axis(near, at, -1) + np.where(np.take_along_axis(miss, at, -1) >= 0, 1, -1)
    flipped = near.copy()
    np.put_along_axis(flipped, at, other, -1)
    return np.where(near.sum(axis=-1, keepdims=True) % 2 == 0, near, flipped)


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by one half; last axis of 8."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(-1) < ((x - whole) ** 2).sum(-1)
    return np.where(closer[..., None], half, whole)


def shortest_e8() -> np.ndarray:
    """The 240 shortest vectors: two entries of +-1, or eight of +-1/2 with evenly many minuses."""
    pairs = [
        s * np.eye(8)[i] + t * np.eye(8)[j]
        for i in range(8)
        for j in range(i)
        for s in (1, -1)
        for t in (1, -1)
    ]
    signs = [np.array([-0.5 if m >> k & 1 else 0.5 for k in range(8)]) for m in range(256)]
    return np.array(pairs + [v for v in signs if (v < 0).sum() % 2 == 0])


def cells(unit: np.ndarray, lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """Own cell (n, tables) and probed cells (n, tables, probes) of unit vectors, as hashes."""
    steps = shortest_e8()
    mixer = np.random.default_rng([lattice.seed, 1]).integers(
        1, 2**62, size=8 * lattice.blocks, dtype=np.int64
    ) * 2 + 1
    own, probed = [], []
    for project in lattice.projection(unit.shape[1]):
        y = (unit @ project).reshape(len(unit), lattice.blocks, 8)
        point = nearest_e8(y)
        # |r - v|^2 = |r|^2 + 2 - 2 r.v: the largest products are the nearest neighbours.
        gain = ((y - point) @ steps.T).reshape(len(unit), -1)
        best = np.argpartition(-gain, lattice.probes, axis=1)[:, : lattice.probes]
        code = (2 * point).astype(np.int64).reshape(len(unit), -1) @ mixer
        turn = (2 * steps).astype(np.int64) @ mixer.reshape(lattice.blocks, 8).T  # (240, blocks)
        own.append(code)
        probed.append(code[:, None] + turn[best % len(steps), best // len(steps)])
    return np.stack(own, 1), np.stack(probed, 1)


def _cell_column(unit: Column, lattice: Lattice) -> Column:
    @F.pandas_udf("own array<bigint>, probed array<array<bigint>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            own = np.empty(len(vectors), object)
            probed = np.empty(len(vectors), object)
            sizes = vectors.map(len).to_numpy()
            for size in np.unique(sizes):
                for at in np.array_split(
                    np.flatnonzero(sizes == size), 1 + (sizes == size).sum() // 2000
                ):
                    home, near = cells(np.stack(vectors.iloc[at].to_list()), lattice)
                    for i, h, n in zip(at, home, near, strict=True):
                        own[i], probed[i] = h, list(n)
            yield pd.DataFrame({"own": own, "probed": probed})

    return of(unit)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value which is computed once; inside a lambda a plain one would be for each item."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit_vector(vector: Column) -> Column:
    """The vector at length 1 in double precision; null if it has no direction."""
    sound = F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v) < float("inf"))
    )
    squares = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)

    def scaled(x: Column) -> Column:
        most = F.array_max(F.transform(x, lambda v: F.abs(v)))
        return _with(most, lambda m: F.when(m > 0, F.transform(x, lambda v: v / m)))

    def at_length_one(x: Column) -> Column:
        return _with(F.sqrt(squares(x)), lambda n: F.transform(x, lambda v: v / n))

    doubles = F.transform(vector, lambda v: v.cast("double"))
    unit = _with(doubles, lambda x: _with(scaled(x), at_length_one))
    return F.when(sound & (F.size(vector) > 0), unit)


def _cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def linked_pairs(distinct: DataFrame, threshold: float, lattice: Lattice) -> DataFrame:
    """(a, b), a < b: classes of `distinct` (class, unit) found with cosine >= threshold."""
    placed = keep(
        distinct.select("class", F.size("unit").alias("n"), _cell_column(F.col("unit"), lattice).alias("c")),
        "cells",
    )
    stored = placed.select("n", F.posexplode("c.own").alias("t", "cell"), F.col("class").alias("b"))
    asked = placed.select(
        "n",
        F.posexplode(
            F.zip_with("c.own", "c.probed", lambda o, p: F.struct(o.alias("own"), p.alias("probed")))
        ).alias("t", "x"),
        F.col("class").alias("a"),
    ).select(
        "n",
        "t",
        "a",
        F.explode(F.concat(F.array("x.own"), F.col("x.probed"))).alias("cell"),
    )
    pairs = keep(
        asked.join(stored, ["n", "t", "cell"])
        .where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "candidates",
    )
    left = distinct.select(F.col("class").alias("a"), F.col("unit").alias("u"))
    right = distinct.select(F.col("class").alias("b"), F.col("unit").alias("v"))
    return (
        pairs.join(left, "a").join(right, "b").where(_cosine(F.col("u"), F.col("v")) >= threshold)
    ).select("a", "b")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    lattice: Lattice | None = None,
) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    `n_links` counts the other vectors linked directly, equal ones included. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing; vectors of different
    length neither. Ids are keys: rows which share an id and differ in the vector share their
    links. A row without id links with nothing, has component null and is kept. An empty table
    stays empty.
    """
    lattice = lattice or Lattice()
    rows = keep(
        vectors.select(vectors[id_col].alias("vec_id"), unit_vector(vectors[vector_col]).alias("unit")).select(
            "vec_id",
            "unit",
            F.when(
                F.col("unit").isNotNull() & F.col("vec_id").isNotNull(),
                # Two independent 64-bit hashes stand for the vector.
                F.struct(
                    F.xxhash64("unit").alias("x"), F.xxhash64(F.lit(7), F.reverse("unit")).alias("y")
                ),
            ).alias("same"),
        ),
        "vectors",
    )
    classes = keep(
        rows.where("same IS NOT NULL")
        .groupBy("same")
        .agg(F.min("vec_id").alias("class"), F.count("*").alias("n"), F.first("unit").alias("unit")),
        "classes",
    )
    links = keep(linked_pairs(classes.select("class", "unit"), threshold, lattice), "links")
    both = links.union(links.select("b", "a")).toDF("class", "other")
    others = both.join(classes.select(F.col("class").alias("other"), "n"), "other")
    degree = others.groupBy("class").agg(F.sum("n").alias("linked"))
    groups = components(links).toDF("class", "component_id")
    known = (
        classes.select("same", "class", "n")
        .join(degree, "class", "left")
        .join(groups, "class", "left")
        .select(
            "same",
            (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "class").alias("component_id"),
        )
    )
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", "same").join(known, "same", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def measured_recall(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    lattice: Lattice | None = None,
    queries: int = 200,
) -> float:
    """Share of the true links of `queries` vectors, chosen by hash, which the search finds.

    The chosen vectors are compared with all rows by brute force, so `queries` bounds the work.
    """
    rows = keep(
        vectors.select(
            vectors[id_col].alias("class"), unit_vector(vectors[vector_col]).alias("unit")
        ).where("unit IS NOT NULL AND class IS NOT NULL"),
        "recall",
    )
    chosen = rows.orderBy(F.xxhash64("class"), "class").limit(queries)
    pairs = F.broadcast(chosen.select(F.col("class").alias("q"), F.col("unit").alias("u")))
    true = keep(
        rows.join(pairs, (F.col("q") != F.col("class")) & (F.size("u") == F.size("unit")))
        .where(_cosine(F.col("u"), F.col("unit")) >= threshold)
        .select(F.least("q", "class").alias("a"), F.greatest("q", "class").alias("b"))
        .distinct(),
        "true-links",
    )
    found = linked_pairs(rows, threshold, lattice or Lattice())
    total = true.count()
    return true.join(found, ["a", "b"], "left_semi").count() / total if total else 1.0
