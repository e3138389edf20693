"""Small hand-made frames."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.schema import RAW_SCHEMA, SourceSchema

SCHEMA = SourceSchema(date_min="2009-12-01", date_max="2011-12-09 23:59:59")
UK = "United Kingdom"


def raw_frame(spark: SparkSession, rows: list[tuple], sheets: list[str] | None = None) -> DataFrame:
    """Rows of the eight business columns plus lineage; row numbers start at 2."""
    sheets = sheets or ["test"] * len(rows)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in RAW_SCHEMA)
    full = [(*r, s, i + 2, f"{s}:{i + 2}") for i, (r, s) in enumerate(zip(rows, sheets, strict=True))]
    return spark.createDataFrame(full, ddl + ", source_sheet string, source_row bigint, line_id string")


FIRST, THIRD = datetime(2010, 1, 1, 10), datetime(2010, 1, 3)


def source_rows() -> list[tuple]:
    return [
        ("100", "001", " First  item ", 2.0, FIRST, 10.0, "00001", UK),
        ("100", "002", "SECOND", 3.0, FIRST, 5.0, "00001", UK),
        ("C101", "001", "FIRST", -1.0, FIRST, 10.0, "00001", UK),
        ("102", "003", None, 4.0, THIRD, 2.0, None, UK),
        ("103", "004", "FREE", 1.0, THIRD, 0.0, "00002", UK),
        ("104", "005", "BAD PRICE", 1.0, THIRD, -2.0, "00003", "Germany"),
    ]


def daily_frame(spark: SparkSession, days: int = 150, first: date = date(2010, 1, 1)) -> DataFrame:
    rows = [(first + timedelta(i), 100.0 + i, (100 + i) % 11 + 1) for i in range(days)]
    return spark.createDataFrame(rows, "date date, gross_sales double, orders bigint")


def lines_of(spark: SparkSession, rows: list[tuple], sheets=None) -> DataFrame:
    from tillspark.operators import cleaning, transform

    flagged = cleaning.flag_lines(raw_frame(spark, rows, sheets), SCHEMA)
    return transform.derive_lines(cleaning.standardize(cleaning.accepted(flagged, SCHEMA)))


def as_dict(df: DataFrame) -> dict:
    return df.first().asDict()


def one(df: DataFrame, name: str):
    return df.select(F.col(name)).first()[0]
