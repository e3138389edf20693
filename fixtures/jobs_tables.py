"""Validation, cleaning, transformation and star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtures.oracle import money, over, total
from fixtures.registry import plain, register, star_of
from fixtures.retail_lines import SCHEMA
from tillspark.operators import checks, cleaning, star, transform


ISO = "STRFTIME({0}, '%Y-%m-%d') AS {0}"
MOMENT = "STRFTIME({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


def _count(cond: str) -> str:
    return f"CAST(COALESCE(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END), 0) AS BIGINT)"


ISSUES = {
    "rows": "COUNT(*)",
    "Invoice:null": _count("invoice IS NULL"),
    "StockCode:null": _count("stock_code IS NULL"),
    "Quantity:null": _count("quantity IS NULL"),
    "InvoiceDate:null": _count("invoice_date IS NULL"),
    "Price:null": _count("price IS NULL"),
    "Country:null": _count("country IS NULL"),
    "Quantity:invalid_numeric": _count("quantity IS NULL OR NOT ISFINITE(quantity)"),
    "Price:invalid_numeric": _count("price IS NULL OR NOT ISFINITE(price)"),
    "invalid_date": _count("invoice_date IS NULL"),
    "out_of_date_range": _count(
        f"invoice_date < TIMESTAMP '{SCHEMA.date_min}' OR invoice_date > TIMESTAMP '{SCHEMA.date_max}'"
    ),
    "negative_price": _count("price < 0"),
    "fractional_quantity": _count("quantity % 1 <> 0"),
    "blank_country": _count("TRIM(country) = ''"),
}


@register(
    "validate_source",
    over(
        " UNION ALL ".join(
            f"SELECT source_sheet, '{n}' AS metric, {q} AS value FROM raw_lines GROUP BY source_sheet"
            for n, q in ISSUES.items()
        )
    ),
)
def _(m):
    return checks.validate_source(m["source"], SCHEMA, [SCHEMA.sheet])


@register(
    "part_report",
    over(
        """SELECT source_sheet AS part, COUNT(*) AS rows, '' AS blocking FROM raw_lines
           GROUP BY source_sheet
           UNION ALL SELECT 'without price', COUNT(*), 'missing columns: Price' FROM raw_lines
           UNION ALL SELECT 'without lines', COUNT(*), 'no rows' FROM raw_lines
             WHERE line_id IS NULL
           UNION ALL SELECT 'loaded twice', 2 * COUNT(*), 'line_id is not a key' FROM raw_lines
           UNION ALL SELECT 'one lost key', COUNT(*), 'line_id is not a key' FROM raw_lines"""
    ),
)
def _(m):
    """Both sheets, and the same lines broken in four ways: every part is reported."""
    source = m["source"]
    first = source.agg(F.min("line_id")).scalar()
    parts = {s: source.where(F.col(SCHEMA.sheet) == s) for s in ("sheet_1", "sheet_2")}
    parts["without price"] = source.drop("Price")
    parts["without lines"] = source.where(F.col("line_id").isNull())
    parts["loaded twice"] = source.unionByName(source)
    parts["one lost key"] = source.withColumn("line_id", F.nullif("line_id", first))
    return checks.part_report(parts, SCHEMA)


@register(
    "lineage_key_violations",
    over(
        """SELECT CAST(SUM(CASE WHEN line_id IS NULL THEN n ELSE 0 END) AS BIGINT) AS null_keys,
                  CAST(SUM(n - 1) AS BIGINT) AS repeated_keys
           FROM (SELECT line_id, COUNT(*) AS n FROM raw_lines GROUP BY line_id)"""
    ),
)
def _(m):
    return checks.key_violations(m["source"], "line_id")


@register(
    "invoice_key_violations",
    over(
        """SELECT CAST(SUM(CASE WHEN invoice IS NULL THEN n ELSE 0 END) AS BIGINT) AS null_keys,
                  CAST(SUM(n - 1) AS BIGINT) AS repeated_keys
           FROM (SELECT invoice, COUNT(*) AS n FROM raw_lines GROUP BY invoice)"""
    ),
)
def _(m):
    return checks.key_violations(m["source"], "Invoice")


@register("overlap_copies", over("SELECT line_id, source_sheet FROM marked WHERE overlap_copy"))
def _(m):
    marked = cleaning.mark_overlap_copies(m["source"], SCHEMA)
    return marked.where("overlap_copy").select("line_id", "source_sheet")


@register(
    "quarantined_lines",
    over(
        f"""SELECT line_id, source_sheet, invoice, stock_code, description, quantity,
                   {MOMENT.format('invoice_date')}, price, customer, country, quarantine_reason
            FROM reasoned WHERE quarantine_reason <> ''"""
    ),
)
def _(m):
    return plain(
        m["quarantine"].select(
            "line_id",
            "source_sheet",
            F.col("Invoice").alias("invoice"),
            F.col("StockCode").alias("stock_code"),
            F.col("Description").alias("description"),
            F.col("Quantity").alias("quantity"),
            F.col("InvoiceDate").alias("invoice_date"),
            F.col("Price").alias("price"),
            F.col("Customer ID").alias("customer"),
            F.col("Country").alias("country"),
            "quarantine_reason",
        )
    )


@register(
    "accepted_lines",
    over(
        """SELECT line_id, source_sheet, invoice, stock_code, description, customer, country,
                  CAST(ambiguous_duplicate AS INTEGER) AS ambiguous_duplicate,
                  CAST(is_cancellation AS INTEGER) AS is_cancellation,
                  CAST(is_adjustment AS INTEGER) AS is_adjustment FROM accepted"""
    ),
)
def _(m):
    return plain(
        m["accepted"].select(
            "line_id",
            "source_sheet",
            F.col("Invoice").alias("invoice"),
            F.col("StockCode").alias("stock_code"),
            F.col("Description").alias("description"),
            F.col("Customer ID").alias("customer"),
            F.col("Country").alias("country"),
            "ambiguous_duplicate",
            "is_cancellation",
            "is_adjustment",
        )
    )


def _changed(c: str) -> str:
    return _count(f"COALESCE({c}, '') <> COALESCE(raw_{c}, '')")


@register(
    "cleaning_log",
    over(
        f"""SELECT COUNT(*) AS original_rows, {_count("quarantine_reason = ''")} AS accepted_rows,
              {_count("quarantine_reason <> ''")} AS quarantined_rows,
              CAST(0 AS BIGINT) AS removed_rows,
              {_count('r1')} AS reason_overlapping_sheet_copy, {_count('r2')} AS reason_missing_required,
              {_count('r3')} AS reason_invalid_numeric, {_count('r4')} AS reason_negative_price,
              {_count('r5')} AS reason_fractional_quantity, {_count('r6')} AS reason_invalid_date,
              {_changed('invoice')} AS corrected_invoice_id,
              {_changed('stock_code')} AS corrected_product_id,
              {_changed('description')} AS corrected_description,
              {_changed('country')} AS corrected_country,
              (SELECT COUNT(*) FROM accepted WHERE customer = 'UNKNOWN') AS unknown_customers,
              (SELECT COUNT(*) FROM accepted WHERE description = 'UNKNOWN') AS unknown_descriptions,
              (SELECT COUNT(*) FROM accepted WHERE ambiguous_duplicate)
                AS ambiguous_duplicate_rows_retained
            FROM reasoned"""
    ),
)
def _(m):
    return cleaning.cleaning_log(m["flagged"], m["accepted"], SCHEMA)


@register(
    "row_reconciliation",
    over(
        f"""SELECT {_count("quarantine_reason = ''")} AS accepted_rows,
              {_count("quarantine_reason <> ''")} AS quarantined_rows,
              (SELECT COUNT(*) FROM raw_lines) AS source_rows,
              CASE WHEN COUNT(*) = (SELECT COUNT(*) FROM raw_lines) THEN 1 ELSE 0 END AS reconciled
            FROM reasoned"""
    ),
)
def _(m):
    return cleaning.reconcile_rows(m["source"], m["flagged"])


@register(
    "derived_lines",
    over(
        f"""SELECT line_id, invoice_id, product_id, description, customer_id, country, quantity,
                   unit_price, {MOMENT.format('invoice_date')}, {ISO.format('date')}, month, weekday,
                   hour, net_value, gross_sales, cancellation_value,
                   CAST(is_sale AS INTEGER) AS is_sale FROM lines"""
    ),
)
def _(m):
    return plain(
        m["lines"].select(
            "line_id",
            "invoice_id",
            "product_id",
            "description",
            "customer_id",
            "country",
            "quantity",
            "unit_price",
            "invoice_date",
            "date",
            "month",
            "weekday",
            "hour",
            "net_value",
            "gross_sales",
            "cancellation_value",
            "is_sale",
        )
    )


def _daily(keys: str) -> str:
    """Daily series SQL; `keys` is '' or 'country, '."""
    part = f"PARTITION BY {keys[:-2]} " if keys else ""
    joined = "USING (country, date)" if keys else "USING (date)"
    return over(
        f"""SELECT {keys}STRFTIME(date, '%Y-%m-%d') AS date, gross_sales, net_value,
              cancellation_value, observed_lines, orders,
              CASE WHEN observed_lines > 0 THEN 1 ELSE 0 END AS has_records,
              CAST(SUM({money('gross_sales')}) OVER week AS DOUBLE) / COUNT(*) OVER week
                AS rolling_7_sales,
              CAST(SUM({money('gross_sales')}) OVER run AS DOUBLE) AS cumulative_sales,
              gross_sales / NULLIF(LAG(gross_sales) OVER run, 0) - 1 AS daily_growth
            FROM filled_days
            WINDOW week AS ({part}ORDER BY filled_days.date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
                   run AS ({part}ORDER BY filled_days.date)""",
        filled_days=f"""
            SELECT {keys}date, COALESCE(gross_sales, 0) AS gross_sales,
              COALESCE(net_value, 0) AS net_value,
              COALESCE(cancellation_value, 0) AS cancellation_value,
              COALESCE(observed_lines, 0) AS observed_lines, COALESCE(orders, 0) AS orders
            FROM (SELECT {keys}CAST(UNNEST(GENERATE_SERIES(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP),
                         INTERVAL 1 DAY)) AS DATE) AS date
                  FROM (SELECT {keys}MIN(date) AS a, MAX(date) AS z FROM lines
                        {"GROUP BY " + keys[:-2] if keys else ""}))
            LEFT JOIN (SELECT {keys}date, {total('gross_sales')} AS gross_sales,
                         {total('net_value')} AS net_value,
                         {total('cancellation_value')} AS cancellation_value,
                         COUNT(*) AS observed_lines,
                         COUNT(DISTINCT CASE WHEN is_sale THEN invoice_id END) AS orders
                       FROM lines GROUP BY {keys}date) {joined}""",
    )


@register("daily_series", _daily(""))
def _(m):
    return plain(m["daily"])


@register("daily_series_by_country", _daily("country, "))
def _(m):
    return plain(m["country_daily"])


@register(
    "calendar_contiguity",
    over(
        """SELECT country, span AS rows, span AS distinct_days, span AS span_days, 1 AS contiguous
           FROM (SELECT country, CAST(DATE_DIFF('day', MIN(date), MAX(date)) + 1 AS BIGINT) AS span
                 FROM lines GROUP BY country)"""
    ),
)
def _(m):
    return checks.calendar_gaps(m["country_daily"], ["country"])


@register(
    "recorded_days_contiguity",
    over(
        """SELECT country, n AS rows, n AS distinct_days, span AS span_days,
                  CASE WHEN n = span THEN 1 ELSE 0 END AS contiguous
           FROM (SELECT country, COUNT(DISTINCT date) AS n,
                        CAST(DATE_DIFF('day', MIN(date), MAX(date)) + 1 AS BIGINT) AS span
                 FROM lines GROUP BY country)"""
    ),
)
def _(m):
    return checks.calendar_gaps(m["lines"].select("country", "date").distinct(), ["country"])


def _wide(m):
    return transform.monthly_country_wide(m["lines"], transform.country_names(m["dim_country"]))


#: Names of the source's countries, which are the columns of the matrix.
COUNTRIES = [f"NATION_{i}" for i in range(25)]


@register(
    "monthly_country_wide",
    over(
        "SELECT month, "
        + ", ".join(
            f"""COALESCE(CAST(SUM({money('gross_sales')}) FILTER (WHERE country = '{c}') AS DOUBLE), 0)
                AS "{c}" """
            for c in COUNTRIES
        )
        + " FROM lines GROUP BY month"
    ),
)
def _(m):
    return _wide(m)


@register(
    "monthly_country_long",
    over(
        f"""SELECT month, country, COALESCE(v, 0) AS gross_sales
            FROM (SELECT DISTINCT month FROM lines) CROSS JOIN (SELECT country FROM dim_country)
            LEFT JOIN (SELECT month, country, {total('gross_sales')} AS v FROM lines
                       GROUP BY month, country) USING (month, country)"""
    ),
)
def _(m):
    return transform.monthly_country_long(_wide(m))


@register("dim_product", over("SELECT * FROM dim_product"))
def _(m):
    return m["dim_product"]


@register("dim_customer", over("SELECT * FROM dim_customer"))
def _(m):
    return m["dim_customer"]


@register("dim_country", over("SELECT * FROM dim_country"))
def _(m):
    return m["dim_country"]


@register(
    "dim_date", over(f"SELECT {ISO.format('date')}, year, month_number, weekday FROM dim_date")
)
def _(m):
    return plain(m["dim_date"])


@register(
    "fact_sales",
    over(
        f"SELECT * EXCLUDE (date, invoice_date), {ISO.format('date')}, {MOMENT.format('invoice_date')} "
        "FROM fact_sales"
    ),
)
def _(m):
    return plain(m["fact_sales"])


DIMS = dict(star.DIMENSION_KEYS)
_ORPHANS = {
    t: f"(SELECT COUNT(*) FROM fact_sales WHERE {k} NOT IN (SELECT {k} FROM {t}))"
    for t, k in DIMS.items()
}


@register(
    "primary_key_violations",
    over(
        " UNION ALL ".join(
            f"SELECT '{t}' AS name, CAST(0 AS BIGINT) AS null_keys, "
            f"CAST(COUNT(*) - COUNT(DISTINCT {k}) AS BIGINT) AS repeated_keys FROM {t}"
            for t, k in {**DIMS, "fact_sales": "line_id"}.items()
        )
    ),
)
def _(m):
    report = None
    for name, key in {**DIMS, "fact_sales": "line_id"}.items():
        part = checks.key_violations(m[name], key).withColumn("name", F.lit(name))
        report = part if report is None else report.unionByName(part)
    return report


@register(
    "foreign_key_orphans",
    over(
        " UNION ALL ".join(
            f"SELECT '{t}' AS dimension, COUNT(*) AS orphan_rows FROM fact_sales "
            f"WHERE {k} NOT IN (SELECT {k} FROM {t})"
            for t, k in DIMS.items()
        )
    ),
)
def _(m):
    return checks.foreign_key_report(m["fact_sales"], {t: (m[t], k) for t, k in DIMS.items()})


@register(
    "orphans_without_first_country",
    over(
        "SELECT 'dim_country' AS dimension, COUNT(*) AS orphan_rows FROM fact_sales WHERE country_id = 1"
    ),
)
def _(m):
    rest = m["dim_country"].where("country_id > 1")
    return checks.foreign_key_report(m["fact_sales"], {"dim_country": (rest, "country_id")})


_FACT_CHECKS = {
    "unit_price >= 0": "unit_price < 0",
    "gross_sales >= 0": "gross_sales < 0",
    "cancellation_value >= 0": "cancellation_value < 0",
    "is_sale in (0, 1)": "is_sale NOT IN (0, 1)",
    "is_cancellation in (0, 1)": "is_cancellation NOT IN (0, 1)",
    "is_adjustment in (0, 1)": "is_adjustment NOT IN (0, 1)",
    "ambiguous_duplicate in (0, 1)": "ambiguous_duplicate NOT IN (0, 1)",
    "hour between 0 and 23": "hour NOT BETWEEN 0 AND 23",
}
_COLUMNS = {
    "fact_sales": "line_id invoice_id product_id customer_id country_id date invoice_date quantity "
    "unit_price net_value gross_sales cancellation_value is_sale is_cancellation is_adjustment "
    "ambiguous_duplicate hour",
    "dim_product": "product_id description",
    "dim_customer": "customer_id",
    "dim_country": "country country_id",
    "dim_date": "date year month_number weekday",
}
_PAIRS = (
    [(t, f"{c} not null", f"{c} IS NULL") for t, cs in _COLUMNS.items() for c in cs.split()]
    + [("fact_sales", n, c) for n, c in _FACT_CHECKS.items()]
    + [("dim_date", "weekday between 0 and 6", "weekday NOT BETWEEN 0 AND 6")]
)


@register(
    "constraint_violations",
    over(
        " UNION ALL ".join(
            f"SELECT '{t}' AS \"table\", '{n}' AS \"constraint\", {_count(c)} AS violations FROM {t}"
            for t, n, c in _PAIRS
        )
        + " UNION ALL SELECT 'dim_country', 'country unique', COUNT(country) - COUNT(DISTINCT country)"
        " FROM dim_country"
    ),
)
def _(m):
    return checks.constraint_violations({t: m[t] for t in _COLUMNS})


@register(
    "value_reconciliation",
    over(
        f"""SELECT COUNT(*) AS rows_before, {total('net_value')} AS value_before,
              (SELECT COUNT(*) FROM fact_sales) AS rows_after,
              (SELECT {total('net_value')} FROM fact_sales) AS value_after, 1 AS reconciled
            FROM lines"""
    ),
)
def _(m):
    return checks.reconcile_values(m["lines"], m["fact_sales"], "net_value")


@register(
    "integration_report",
    over(
        f"""SELECT COUNT(*) AS input_rows, (SELECT COUNT(*) FROM fact_sales) AS output_rows,
              {total('net_value')} AS signed_value_before,
              (SELECT {total('net_value')} FROM fact_sales) AS signed_value_after,
              {" + ".join(_ORPHANS.values())} AS orphan_rows,
              {", ".join(f"(SELECT COUNT(*) FROM {t}) AS {t}_rows" for t in DIMS)}
            FROM lines"""
    ),
)
def _(m):
    return star.integration_report(m["lines"], star_of(m))


@register(
    "case_collisions",
    over(
        """SELECT LOWER(product_id) AS folded_id, COUNT(*) AS codes, MIN(product_id) AS first_code
           FROM dim_product GROUP BY 1 HAVING COUNT(*) > 1"""
    ),
)
def _(m):
    return star.case_collisions(m["dim_product"])


@register(
    "product_keys",
    over(
        "SELECT *, ROW_NUMBER() OVER (ORDER BY product_id) AS product_key FROM dim_product"
    ),
)
def _(m):
    return star.product_keys(m["dim_product"])


@register("v_daily", over(f"SELECT * EXCLUDE (date), {ISO.format('date')} FROM v_daily"))
def _(m):
    return plain(m["v_daily"])


@register("v_monthly", over("SELECT * FROM v_monthly"))
def _(m):
    return m["v_monthly"]


@register("v_invoices", over(f"SELECT * EXCLUDE (date), {ISO.format('date')} FROM v_invoices"))
def _(m):
    return plain(m["v_invoices"])


@register(
    "output_audit",
    over(
        """SELECT 'fact rows equal accepted rows' AS "check",
             ABS((SELECT COUNT(*) FROM fact_sales) - (SELECT COUNT(*) FROM accepted)) AS violations """
        + " ".join(f"UNION ALL SELECT 'orphans of {t}', {q}" for t, q in _ORPHANS.items())
    ),
)
def _(m):
    return checks.audit_outputs(m["lines"], star_of(m))
