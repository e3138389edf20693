"""Scans with a declared schema, and multi-part ingestion with line lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillspark.operators.checks import CheckFailed

# Fixed value: what Spark puts in place of bytes which are not UTF-8.
REPLACEMENT = "\ufffd"

# Quotes are doubled and blanks kept, so text survives a round trip unchanged.
CSV = {
    "header": True,
    "encoding": "UTF-8",
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_frame(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan Parquet, CSV or JSON by suffix.

    A missing path, an unknown suffix, an empty frame, a malformed record and, for text formats,
    bytes which are not UTF-8 all fail. CSV and JSON need a declared schema.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in ("parquet", "csv", "json"):
        raise CheckFailed(f"Unknown file type: {path}")
    if suffix != "parquet" and schema is None:
        raise CheckFailed(f"Text input needs a declared schema: {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == "parquet":
        df = reader.parquet(path)
    elif suffix == "csv":
        df = reader.options(**CSV).csv(path, mode="FAILFAST")
    else:
        df = reader.json(path, mode="FAILFAST", encoding="UTF-8")
    if df.isEmpty():
        raise CheckFailed(f"Empty dataset: {path}")
    if suffix != "parquet":
        require_utf8(df, path)
    return df


def require_utf8(df: DataFrame, label: str) -> None:
    """Stop when a text column holds the replacement character, the trace of broken bytes."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return
    broken = reduce(lambda a, b: a | b, [F.col(f"`{c}`").contains(REPLACEMENT) for c in texts])
    if df.where(broken).limit(1).count():
        raise CheckFailed(f"Not valid UTF-8: {label}")


def read_parts(
    spark: SparkSession,
    parts: dict[str, str],
    schema: T.StructType | None = None,
    row_column: str | None = None,
) -> DataFrame:
    """Read named parts and tag every line with part, row and `line_id` = part:row.

    Parquet rows are numbered by file name and position, which holds for any split of the scan.
    Other formats carry no stable position, so they must bring a row column.
    """
    frames = []
    for name, path in parts.items():
        df = read_frame(spark, path, schema)
        if row_column is not None:
            row = F.col(row_column)
        elif path.rstrip("/").lower().endswith(".parquet"):
            row = F.concat(
                F.col("_metadata.file_name"),
                F.lit("#"),
                F.lpad(F.col("_metadata.row_index").cast("string"), 15, "0"),
            )
        else:
            raise CheckFailed(f"{path}: give the column which numbers the rows")
        columns = [F.col(f"`{c}`") for c in df.columns if c != row_column]
        frames.append(
            df.select(
                *columns,
                F.lit(name).alias("source_sheet"),
                row.alias("source_row"),
                F.concat_ws(":", F.lit(name), row.cast("string")).alias("line_id"),
            )
        )
    return reduce(DataFrame.unionByName, frames)
