"""Reporting views over the star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.functions.columns import count_if, flag, total

DAILY_MEASURES = ["gross_sales", "net_value", "cancellation_value", "orders", "recorded_lines"]


def v_daily(fact: DataFrame, dates: DataFrame) -> DataFrame:
    """Calendar day totals; days without lines are zero.

    Lines are aggregated before they meet the calendar, so the join sees one row per day.
    """
    per_day = fact.groupBy("date").agg(
        total("gross_sales").alias("gross_sales"),
        total("net_value").alias("net_value"),
        total("cancellation_value").alias("cancellation_value"),
        F.count_distinct(F.when(F.col("is_sale") == 1, F.col("invoice_id"))).alias("orders"),
        F.count("line_id").alias("recorded_lines"),
    )
    return dates.select("date", "weekday").join(per_day, "date", "left").na.fill(0, DAILY_MEASURES)


def v_monthly(daily: DataFrame) -> DataFrame:
    """Months as sums of days: an invoice with lines on two days counts on both."""
    whole = (F.min("date") == F.trunc(F.min("date"), "MM")) & (
        F.max("date") == F.last_day(F.max("date"))
    )
    return daily.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        total("gross_sales").alias("gross_sales"),
        total("net_value").alias("net_value"),
        total("cancellation_value").alias("cancellation_value"),
        F.sum("orders").alias("orders"),
        flag(whole).alias("complete_month"),
    )


def v_invoices(fact: DataFrame) -> DataFrame:
    """One row per invoice, customer and country."""
    return fact.groupBy("invoice_id", "customer_id", "country_id").agg(
        F.min("date").alias("date"),
        total("gross_sales").alias("gross_sales"),
        total("cancellation_value").alias("cancellation_value"),
        count_if(F.col("is_sale") == 1).alias("sale_lines"),
        F.sum(F.when(F.col("is_sale") == 1, F.col("quantity")).otherwise(0)).alias("sale_units"),
    )


def register_views(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Register the star and its three views for `spark.sql` and return all of them."""
    fact = tables["fact_sales"]
    daily = v_daily(fact, tables["dim_date"])
    every = {
        **tables,
        "v_daily": daily,
        "v_monthly": v_monthly(daily),
        "v_invoices": v_invoices(fact),
    }
    for name, df in every.items():
        df.createOrReplaceTempView(name)
    return every
