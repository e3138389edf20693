"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by the key (hash of the text, id), so equal texts lie side by side and a group of
any size can still be cut. The shard boundaries are keys. They are found without sorting: each
round counts the exact bytes below evenly spaced probes in the key intervals which still hold a
boundary, and narrows those intervals, until a boundary is within the tolerance or its interval
holds a single key. Then rows are dealt to their shards in one exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillspark.llm.scratch import free_names, keep

#: Bytes which a document takes besides its text, fixed by the contract.
OVERHEAD = 16
#: Probes laid over one open interval in a round; with s boundaries a round returns at most
#: s x PROBES rows.
PROBES = 256
_HASH_BITS = 62
#: Leading bits of the hash which pick the row of the boundary table.
_CELL_BITS = 12


@dataclass
class _Open:
    """A boundary which is looked for in the keys low..high; `below` bytes lie under low."""

    goal: float
    low: int
    high: int
    below: int


def text_hash(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - _HASH_BITS)


def _narrow(
    keyed: DataFrame, key: str, searches: list[_Open], tolerance: float, last: bool = False
) -> list[tuple[int, int, bool]]:
    """For each search (key, bytes below the key, whether it is within the tolerance).

    A key which is not within the tolerance is shared by several rows that reach over the goal. If
    one row does, the boundary is the nearer side of it; `last` takes any rows of a key for one.
    """
    done: dict[int, tuple[int, int, bool]] = {}
    while len(done) < len(searches):
        pending = [i for i in range(len(searches)) if i not in done]
        spans = sorted({(searches[i].low, searches[i].high) for i in pending})
        kind = "decimal(20,0)"
        # Intervals are disjoint or equal: they come from one grid per round.
        span = F.lit(None).cast("int")
        cell = F.lit(None).cast(kind)
        for n, (low, high) in enumerate(spans):
            width = -(-(high - low + 1) // PROBES)
            inside = (F.col(key) >= F.lit(str(low)).cast(kind)) & (
                F.col(key) <= F.lit(str(high)).cast(kind)
            )
            span = F.when(inside, n).otherwise(span)
            offset = (F.col(key) - F.lit(str(low)).cast(kind)).cast(kind)
            cell = F.when(inside, F.floor(offset / F.lit(str(width)).cast(kind)).cast(kind)).otherwise(
                cell
            )
        counts: dict[int, list[tuple[int, int, int]]] = {}
        for row in (
            keyed.select(span.alias("span"), cell.alias("cell"), "size")
            .where("span IS NOT NULL")
            .groupBy("span", "cell")
            .agg(F.sum("size").alias("size"), F.count("*").alias("n"))
            .collect()  # at most PROBES rows an interval, of which there are as many as boundaries
        ):
            counts.setdefault(row["span"], []).append((int(row["cell"]), row["size"], row["n"]))
        for i in pending:
            s = searches[i]
            n = spans.index((s.low, s.high))
            width = -(-(s.high - s.low + 1) // PROBES)
            at, below = s.low, s.below
            for c, size, rows in sorted(counts.get(n, [])):
                at = s.low + c * width
                if below + size >= s.goal:
                    break
                below += size
            else:
                done[i] = (s.high + 1, below, True)
                continue
            if s.goal - below <= tolerance:
                done[i] = (at, below, True)
            elif below + size - s.goal <= tolerance:
                done[i] = (at + width, below + size, True)
            elif rows == 1 or width == 1 and last:
                before = s.goal - below <= below + size - s.goal
                done[i] = (at, below, True) if before else (at + width, below + size, True)
            elif width == 1:
                done[i] = (at, below, False)
            else:
                searches[i] = _Open(s.goal, at, min(at + width - 1, s.high), below)
    return [done[i] for i in range(len(searches))]


def boundaries(keyed: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int | None]]:
    """First key (hash, id or null for "any id") of each shard but the first.

    `keyed` is a written table with hash, id and size. `tolerance` is a part of a shard's bytes.
    """
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    share = total / shards
    goals = [share * n for n in range(1, shards)]
    allowed = max(share * tolerance, 1.0)
    wide = keyed.withColumn("hash", F.col("hash").cast("decimal(20,0)"))
    found = _narrow(
        wide, "hash", [_Open(g, 0, (1 << _HASH_BITS) - 1, 0) for g in goals], allowed
    )
    out: list[tuple[int, int | None]] = [(h, None) for h, _, _ in found]
    # Boundaries inside one hash value, a large group of equal texts, are found among its ids.
    for hash_ in sorted({h for h, _, fits in found if not fits}):
        inside = [i for i, (h, _, fits) in enumerate(found) if h == hash_ and not fits]
        group = keyed.where(F.col("hash") == hash_).select(
            F.coalesce("id", F.lit(-(2**63))).cast("decimal(20,0)").alias("id"), "size"
        )
        low, high = (int(x) for x in group.agg(F.min("id"), F.max("id")).first())
        keys = _narrow(
            group, "id", [_Open(goals[i], low, high, found[i][1]) for i in inside], allowed, True
        )
        for i, (id_, _, _) in zip(inside, keys, strict=True):
            out[i] = (hash_, id_)
    return out


def _shard_of(
    docs: DataFrame,
    limits: list[tuple[int, int | None]],
    hash_: str,
    id_: str,
    working: tuple[str, str, str],
) -> DataFrame:
    """Add `_shard`: the number of limits at or below a row's key (columns `hash_` and `id_`).

    Limits go into a table by the leading bits of their hash: 2^12 rows and the limits, whatever
    the size of the data. A row compares its key with the limits of its own cell only.
    """
    spark = docs.sparkSession
    shift = _HASH_BITS - _CELL_BITS
    smallest = -(2**63) - 1
    rows, below = [], 0
    by_cell: dict[int, list[tuple[int, int]]] = {}
    for h, i in limits:
        by_cell.setdefault(min(h >> shift, (1 << _CELL_BITS)), []).append(
            (h, smallest if i is None else i)
        )
    for cell in range(1 << _CELL_BITS):
        inside = by_cell.get(cell, [])
        rows.append((cell, below, [(h, str(i)) for h, i in inside]))
        below += len(inside)
    of_cell, under, edges = working
    table = spark.createDataFrame(
        rows, f"{of_cell} int, {under} int, {edges} array<struct<h: bigint, i: string>>"
    )
    own = F.coalesce(F.col(id_), F.lit(-(2**63))).cast("decimal(20,0)")
    reached = F.filter(
        F.col(edges),
        lambda x: (x["h"] < F.col(hash_))
        | ((x["h"] == F.col(hash_)) & (x["i"].cast("decimal(20,0)") <= own)),
    )
    return (
        docs.withColumn(of_cell, F.shiftright(F.col(hash_), shift).cast("int"))
        .join(F.broadcast(table), of_cell)  # 4,096 rows and one entry per shard
        .withColumn("_shard", F.col(under) + F.size(reached))
        .drop(*working)
    )


def shard(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 0.001,
) -> DataFrame:
    """`docs` with `_size`, `_shard` (0 to shards - 1) and `_slot` (gapless from 0 in its shard).

    Bytes of a shard differ from an equal share by at most twice `tolerance` of it, or the size of
    the documents at its boundaries. Null texts are empty texts; a null id orders first. Rows with
    equal id and equal text are one key and stay together, in any order. An empty table stays
    empty. All other columns are kept; input columns named `_size`, `_shard` or `_slot` are replaced.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    hash_, id_, cell, below, edges = free_names(docs, "_hash", "_id", "_cell", "_below", "_limits")
    sized = docs.withColumns(
        {
            "_size": (F.octet_length(text) + OVERHEAD).cast("long"),
            hash_: text_hash(text),
            id_: docs[id_col].cast("long"),
        }
    )
    keyed = keep(
        sized.select(F.col(hash_).alias("hash"), F.col(id_).alias("id"), F.col("_size").alias("size")),
        "shard-keys",
    )
    limits = boundaries(keyed, shards, tolerance)
    dealt = _shard_of(sized, limits, hash_, id_, (cell, below, edges))
    slots = W.partitionBy("_shard").orderBy(hash_, id_, "_size")
    return dealt.withColumn("_slot", (F.row_number().over(slots) - 1).cast("long")).drop(hash_, id_)
