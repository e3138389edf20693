"""Named measures which can be evaluated under any filter and grouping of the star."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillspark.functions.columns import MONEY, count_if, money, ratio, total
from tillspark.schema import UNKNOWN

Tables = dict[str, DataFrame]


def _sale() -> Column:
    return F.col("is_sale") == 1


def _where(cond: Column, value: str) -> Column:
    return F.when(cond, F.col(value))


# Measures which are one aggregate over the (filtered) fact lines.
LINE_MEASURES: dict[str, Callable[[], Column]] = {
    "gross_sales": lambda: total("gross_sales"),
    "signed_transaction_value": lambda: total("net_value"),
    "cancellation_value": lambda: total("cancellation_value"),
    "cancellation_to_sales_ratio": lambda: ratio(total("cancellation_value"), total("gross_sales")),
    "sale_units": lambda: F.sum(_where(_sale(), "quantity")),
    "sale_invoices": lambda: F.count_distinct(_where(_sale(), "invoice_id")),
    "average_invoice_value": lambda: ratio(
        total("gross_sales"), F.count_distinct(_where(_sale(), "invoice_id"))
    ),
    "known_buyers": lambda: F.count_distinct(
        _where(_sale() & (F.col("customer_id") != UNKNOWN), "customer_id")
    ),
    "anonymous_sales": lambda: total(_where(F.col("customer_id") == UNKNOWN, "gross_sales")),
    "anonymous_sales_share": lambda: ratio(
        total(_where(F.col("customer_id") == UNKNOWN, "gross_sales")), total("gross_sales")
    ),
    "accepted_lines": lambda: F.count(F.lit(1)),
    "ambiguous_repeat_lines": lambda: count_if(F.col("ambiguous_duplicate") == 1),
    "zero_price_lines": lambda: count_if(F.col("unit_price") == 0),
    "non_cancellation_adjustment_value": lambda: total(
        _where(F.col("is_adjustment") == 1, "net_value")
    ),
}

# Measures over the table of evaluated forecasts; only calendar filters apply to them.
FORECAST_MEASURES: dict[str, Callable[[], Column]] = {
    "forecast_mae": lambda: F.avg(F.abs(F.col("target") - F.col("selected"))),
    "forecast_rmse": lambda: F.sqrt(F.avg(F.pow(F.col("target") - F.col("selected"), F.lit(2)))),
    "forecast_wape": lambda: ratio(
        F.sum(F.abs(F.col("target") - F.col("selected"))), F.sum("target")
    ),
    "seasonal_baseline_mae": lambda: F.avg(F.abs(F.col("target") - F.col("seasonal_naive"))),
    "mae_improvement_over_seasonal": lambda: F.avg(
        F.abs(F.col("target") - F.col("seasonal_naive"))
    )
    - F.avg(F.abs(F.col("target") - F.col("selected"))),
}

_DIMENSIONS = [
    ("dim_country", "country_id", ["country"]),
    ("dim_date", "date", ["year", "month_number", "weekday"]),
    ("dim_product", "product_id", ["description"]),
]


def _with_dimensions(fact: DataFrame, t: Tables, text: Sequence[str]) -> DataFrame:
    """Join only those dimensions whose attributes are asked for; `month` comes from the date."""
    for name, key, attributes in _DIMENSIONS:
        wanted = [a for a in attributes if a in text]
        if wanted:
            fact = fact.join(t[name].select(key, *wanted), key, "left")
    return fact.withColumn("month", F.date_format("date", "yyyy-MM")) if "month" in text else fact


def measure(
    t: Tables,
    names: Sequence[str],
    by: Sequence[str] = (),
    where: Callable[[DataFrame], Column] | None = None,
    uses: Sequence[str] = (),
) -> DataFrame:
    """Evaluate line measures per group.

    `where` builds a condition from the joined frame; `uses` names the dimension attributes it
    needs beyond those in `by`.
    """
    df = _with_dimensions(t["fact_sales"], t, [*by, *uses])
    if where is not None:
        df = df.where(where(df))
    return df.groupBy(*by).agg(*[LINE_MEASURES[n]().alias(n) for n in names])


def forecast_measure(
    evaluation: DataFrame, names: Sequence[str], by: Sequence[Column] = ()
) -> DataFrame:
    """Evaluate forecast measures, grouped by calendar columns only."""
    return evaluation.groupBy(*by).agg(*[FORECAST_MEASURES[n]().alias(n) for n in names])


def average_daily_sales(daily: DataFrame, by: Sequence[Column] = (), where: Column | None = None):
    """Mean recorded sales per selected calendar day; days without records count as zero."""
    days = daily if where is None else daily.where(where)
    return days.groupBy(*by).agg(
        (total("gross_sales") / F.count(F.lit(1))).alias("average_daily_recorded_sales")
    )


def trailing_week_sales(daily: DataFrame, where: Column | None = None) -> DataFrame:
    """Sales of the seven days ending at each selected day, reaching before the selection."""
    w = W.orderBy(F.unix_date("date")).rangeBetween(-6, 0)  # one row per calendar day
    run = daily.select(
        "date", F.sum(money("gross_sales")).over(w).cast("double").alias("trailing_seven_day_sales")
    )
    return run if where is None else run.where(where)


def cumulative_in_selection(daily: DataFrame, where: Column | None = None) -> DataFrame:
    """Running sales over the selected days only."""
    days = daily if where is None else daily.where(where)
    w = W.orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    return days.select(
        "date", F.sum(money("gross_sales")).over(w).cast("double").alias("cumulative_sales")
    )


def country_contribution(
    t: Tables,
    by: Sequence[str] = (),
    where: Callable[[DataFrame], Column] | None = None,
    uses: Sequence[str] = (),
    countries: Sequence[str] | None = None,
) -> DataFrame:
    """Share of each country in all countries' sales; other groupings and filters stay in force.

    `countries` restricts the rows shown, never the denominator.
    """
    df = _with_dimensions(t["fact_sales"], t, ["country", *by, *uses])
    if where is not None:
        df = df.where(where(df))
    per = df.groupBy(*by, "country").agg(F.sum(money("gross_sales")).alias("v"))
    # few rows are left: one per country and group
    whole = F.sum("v").over(W.partitionBy(*by)).cast("double")
    shown = per.select(
        *by,
        "country",
        F.col("v").cast("double").alias("gross_sales"),
        ratio(F.col("v").cast("double"), whole).alias("country_sales_contribution"),
    )
    return shown if countries is None else shown.where(F.col("country").isin(*countries))


def frequency_bands(fact: DataFrame, edges: Sequence[int]) -> DataFrame:
    """Known customers by number of sale invoices; band i ends at edges[i], the last is open."""
    per = (
        fact.where(_sale() & (F.col("customer_id") != UNKNOWN))
        .groupBy("customer_id")
        .agg(
            F.count_distinct("invoice_id").alias("orders"),
            F.sum(money("gross_sales")).alias("v"),
        )
    )
    low, band = 1, None
    for edge in edges:
        label = f"{low}" if low == edge else f"{low}-{edge}"
        cond = F.col("orders") <= edge
        band = F.when(cond, label) if band is None else band.when(cond, label)
        low = edge + 1
    return per.groupBy(band.otherwise(f"{low}+").alias("band")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("v").cast("double").alias("gross_sales")
    )


def top_customers(fact: DataFrame, k: int = 10) -> DataFrame:
    """The k identified customers with the greatest sales, ties by id."""
    return (
        fact.where(_sale() & (F.col("customer_id") != UNKNOWN))
        .groupBy("customer_id")
        .agg(F.sum(F.col("gross_sales").cast(MONEY)).cast("double").alias("gross_sales"))
        .orderBy(F.desc("gross_sales"), "customer_id")
        .limit(k)
    )
