"""Finding repeated keys by their hash before any key is moved.

Counting rows per wide key shuffles every key, though nearly all are there once. Here 64-bit hashes
are counted first: a key which occurs twice has a hash which occurs twice. Only rows with such a hash
are then compared by their real keys, so a collision costs a look and changes no result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.sources.workspace import materialize, new_folder

#: A list of hashes up to this length (16 bytes each) goes to every task.
LIST_ROWS = 2_000_000

#: In place of a longer list goes a filter of this many bits, in words of 64, whatever the rows.
FILTER_BITS = 1 << 27


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{k}`") for k in keys])


def shared_hashes(df: DataFrame, keys: Sequence[str], differ: Column | None = None) -> DataFrame:
    """Hashes of the keys of more than one row, written, as (_shared); one pass over `df`.

    With `differ`, only those whose rows have more than one value of it.
    """
    grouped = df.groupBy(key_hash(keys).alias("_shared"))
    if differ is None:
        found = grouped.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    else:
        found = grouped.agg(F.min(differ).alias("_a"), F.max(differ).alias("_z")).where(
            F.col("_a") < F.col("_z")
        )
    return materialize(found.select("_shared"), new_folder(df.sparkSession, "hashes"))


def _place(hashed: Column) -> Column:
    """Bit of the filter for a hash."""
    return F.pmod(hashed, F.lit(FILTER_BITS).cast("bigint"))


def filter_words(found: DataFrame) -> DataFrame:
    """The filter as (_word, _bits), written: the bit of every hash in `found` is set."""
    placed = found.select(_place(F.col("_shared")).alias("_place"))
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(_place % 64 AS INT))")
    words = placed.groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return materialize(words, new_folder(found.sparkSession, "words"))


def listed(
    df: DataFrame, keys: Sequence[str], differ: Column | None = None, list_rows: int | None = None
) -> tuple[DataFrame | bool, Column | None]:
    """What goes to every task, and how a row with a shared hash meets one row of it; others meet none.

    In place of both stands False where no hash is shared, and True where all rows are to be compared. With
    more than `list_rows` shared hashes the filter tells rows apart: n / FILTER_BITS of the single rows, for n
    hashes, pass for shared ones then. Only with hashes for half of the bits it is given up.
    """
    found = shared_hashes(df, keys, differ)
    n = found.count()
    if not n:
        return False, None
    if n <= (LIST_ROWS if list_rows is None else list_rows):
        return F.broadcast(found), key_hash(keys) == F.col("_shared")
    if n <= FILTER_BITS // 2:
        place = _place(key_hash(keys))
        is_set = F.getbit("_bits", (place % 64).cast("int")) == 1
        return F.broadcast(filter_words(found)), (F.shiftright(place, 6) == F.col("_word")) & is_set
    return True, None


def split(
    df: DataFrame, keys: Sequence[str], differ: Column | None = None, list_rows: int | None = None
) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows whose keys are there once, and all others; together they are `df`.

    The first frame is None where nothing is known to be single, the second where no hash is
    shared. NULL is a key like any other. The second frame may have a few more single rows, see `listed`.
    """
    few, match = listed(df, keys, differ, list_rows)
    if isinstance(few, bool):
        return (None, df) if few else (df, None)
    return df.join(few, match, "left_anti"), df.join(few, match, "left_semi")


def repeated_rows(
    df: DataFrame, keys: Sequence[str], list_rows: int | None = None
) -> DataFrame:
    """Every row whose keys repeat, and at most a few others, whose hash only is shared."""
    rest = split(df, keys, None, list_rows)[1]
    return df.where(F.lit(False)) if rest is None else rest
