"""The 22 business questions, their catalogue and the metric layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtures.oracle import money, over, question_sql, total
from fixtures.registry import JOBS, SQL, plain, register, star_of
from tillspark.operators import metrics
from tillspark.plans import questions


def _question(run):
    return lambda m: run(star_of(m))


for _name, _entry in questions.CATALOGUE.items():
    JOBS[f"question_{_name}"] = _question(_entry.run)
JOBS["question_prices_20_lines"] = lambda m: questions.prices(star_of(m), min_lines=20)
SQL.update(question_sql())


def written_answers(m):
    """All 22 answers, each run and written once for the jobs which read them."""
    return m.once("answers", lambda: questions.write_answers(star_of(m), f"{m.folder}/answers"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@register(
    "question_catalogue",
    " UNION ALL ".join(
        f"""SELECT {_quoted(name)} AS name, {_quoted(entry.question)} AS question,
              {_quoted(entry.importance)} AS importance, {_quoted(entry.action)} AS action,
              COUNT(*) AS output_rows FROM ({SQL[f"question_{name}"]})"""
        for name, entry in questions.CATALOGUE.items()
    ),
)
def _(m):
    return questions.catalogue_frame(m.spark, written_answers(m)).drop("interpretation")


@register("question_interpretations")
def _(m):
    return questions.catalogue_frame(m.spark, written_answers(m))


LINE_SQL = {
    "gross_sales": total("gross_sales"),
    "signed_transaction_value": total("net_value"),
    "cancellation_value": total("cancellation_value"),
    "cancellation_to_sales_ratio": f"{total('cancellation_value')} / NULLIF({total('gross_sales')}, 0)",
    "sale_units": "CAST(SUM(CASE WHEN is_sale = 1 THEN quantity END) AS BIGINT)",
    "sale_invoices": "COUNT(DISTINCT CASE WHEN is_sale = 1 THEN invoice_id END)",
    "average_invoice_value": f"{total('gross_sales')} / "
    "NULLIF(COUNT(DISTINCT CASE WHEN is_sale = 1 THEN invoice_id END), 0)",
    "known_buyers": "COUNT(DISTINCT CASE WHEN is_sale = 1 AND customer_id <> 'UNKNOWN' THEN customer_id END)",
    "anonymous_sales": total("CASE WHEN customer_id = 'UNKNOWN' THEN gross_sales END"),
    "anonymous_sales_share": total("CASE WHEN customer_id = 'UNKNOWN' THEN gross_sales END")
    + f" / NULLIF({total('gross_sales')}, 0)",
    "accepted_lines": "COUNT(*)",
    "ambiguous_repeat_lines": "CAST(SUM(ambiguous_duplicate) AS BIGINT)",
    "zero_price_lines": "CAST(SUM(CASE WHEN unit_price = 0 THEN 1 ELSE 0 END) AS BIGINT)",
    "non_cancellation_adjustment_value": total("CASE WHEN is_adjustment = 1 THEN net_value END"),
}
LINE_LIST = ", ".join(f"{q} AS {n}" for n, q in LINE_SQL.items())


@register("measures_total", over(f"SELECT {LINE_LIST} FROM fact_sales"))
def _(m):
    return metrics.measure(star_of(m), list(metrics.LINE_MEASURES))


@register(
    "measures_by_country_and_year",
    over(
        f"SELECT country, year, {LINE_LIST} FROM fact_sales JOIN dim_country USING (country_id) "
        "JOIN dim_date USING (date) WHERE weekday < 5 GROUP BY country, year"
    ),
)
def _(m):
    return metrics.measure(
        star_of(m),
        list(metrics.LINE_MEASURES),
        by=["country", "year"],
        where=lambda df: df["weekday"] < 5,
        uses=["weekday"],
    )


@register(
    "measure_average_daily_sales",
    over(
        f"SELECT CAST(MONTH(date) AS INTEGER) AS month_number, "
        f"{total('gross_sales')} / COUNT(*) AS average_daily_recorded_sales "
        "FROM v_daily WHERE date >= DATE '1996-01-01' GROUP BY 1"
    ),
)
def _(m):
    return metrics.average_daily_sales(
        m["v_daily"],
        [F.month("date").alias("month_number")],
        F.col("date") >= F.lit("1996-01-01").cast("date"),
    )


@register(
    "measure_trailing_week_sales",
    over(
        f"""SELECT * FROM (SELECT STRFTIME(date, '%Y-%m-%d') AS date,
              CAST(SUM({money('gross_sales')}) OVER (ORDER BY v_daily.date
                   RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS DOUBLE)
              AS trailing_seven_day_sales FROM v_daily) WHERE date >= '1996-03-04'"""
    ),
)
def _(m):
    chosen = F.col("date") >= F.lit("1996-03-04").cast("date")
    return plain(metrics.trailing_week_sales(m["v_daily"], chosen))


@register(
    "measure_cumulative_in_selection",
    over(
        f"""SELECT STRFTIME(date, '%Y-%m-%d') AS date,
              CAST(SUM({money('gross_sales')}) OVER (ORDER BY v_daily.date) AS DOUBLE) AS cumulative_sales
            FROM v_daily WHERE MONTH(date) = 12"""
    ),
)
def _(m):
    return plain(metrics.cumulative_in_selection(m["v_daily"], F.month("date") == 12))


@register(
    "measure_country_contribution",
    over(
        f"""SELECT year, country, CAST(v AS DOUBLE) AS gross_sales,
              CAST(v AS DOUBLE) / NULLIF(CAST(SUM(v) OVER (PARTITION BY year) AS DOUBLE), 0)
                AS country_sales_contribution
            FROM (SELECT year, country, SUM({money('gross_sales')}) AS v FROM fact_sales
                  JOIN dim_country USING (country_id) JOIN dim_date USING (date)
                  GROUP BY year, country)"""
    ),
)
def _(m):
    return metrics.country_contribution(star_of(m), by=["year"])


@register(
    "purchase_frequency_bands",
    over(
        f"""SELECT CASE WHEN orders <= 1 THEN '1' WHEN orders <= 5 THEN '2-5'
                        WHEN orders <= 10 THEN '6-10' ELSE '11+' END AS band,
              COUNT(*) AS customers, CAST(SUM(v) AS DOUBLE) AS gross_sales
            FROM (SELECT customer_id, COUNT(DISTINCT invoice_id) AS orders,
                         SUM({money('gross_sales')}) AS v FROM fact_sales
                  WHERE is_sale = 1 AND customer_id <> 'UNKNOWN' GROUP BY customer_id) GROUP BY 1"""
    ),
)
def _(m):
    return metrics.frequency_bands(m["fact_sales"], [1, 5, 10])


@register(
    "top_identified_customers",
    over(
        f"""SELECT customer_id, {total('gross_sales')} AS gross_sales FROM fact_sales
            WHERE is_sale = 1 AND customer_id <> 'UNKNOWN' GROUP BY customer_id
            ORDER BY gross_sales DESC, customer_id LIMIT 10"""
    ),
)
def _(m):
    return metrics.top_customers(m["fact_sales"], 10)


