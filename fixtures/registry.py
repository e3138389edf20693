"""What the driver runs: query name -> job over the input folder, and its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtures.mart import Mart, mart

Job = Callable[[SparkSession, str], DataFrame]

JOBS: dict[str, Callable[[Mart], DataFrame]] = {}
SQL: dict[str, str] = {}


class _Lazily(dict):
    """Table lookup which derives a table when a question first asks for it."""

    def __init__(self, m: Mart):
        super().__init__()
        self._mart = m

    def __missing__(self, name: str) -> DataFrame:
        return self._mart[name]


def star_of(m: Mart) -> dict[str, DataFrame]:
    return _Lazily(m)


def register(name: str, sql: str | None = None):
    """Register a job over the derived tables, with its twin if SQL can express it."""

    def keep(job: Callable[[Mart], DataFrame]):
        if name in JOBS:
            raise ValueError(f"{name} is registered twice")
        JOBS[name] = job
        if sql is not None:
            SQL[name] = sql
        return job

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round all doubles, for results whose last bits depend on the order of summation."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def plain(df: DataFrame) -> DataFrame:
    """Dates and moments as ISO text, booleans as 0/1, so both engines return the same types."""

    def column(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(f.name)
        if isinstance(f.dataType, T.TimestampNTZType):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f.name)
        if isinstance(f.dataType, T.BooleanType):
            return c.cast("int").alias(f.name)
        return c

    return df.select(*[column(f) for f in df.schema])


def _load() -> None:
    from fixtures import (  # noqa: F401  importing them registers their jobs
        jobs_exports,
        jobs_forecast,
        jobs_questions,
        jobs_reports,
        jobs_statistics,
        jobs_tables,
    )


def queries() -> dict[str, Job]:
    _load()

    def bind(job: Callable[[Mart], DataFrame]) -> Job:
        return lambda spark, sf_dir: job(mart(spark, sf_dir))

    return {name: bind(job) for name, job in JOBS.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
