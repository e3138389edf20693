"""Profiles, missingness, duplicates, outliers and exploratory tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtures.oracle import COHORT_PARTS, QUESTIONS, money, over, total
from fixtures.registry import plain, register, rounded, star_of
from fixtures.retail_lines import SCHEMA
from tillspark.operators import eda, outliers, profile
from tillspark.plans import questions

RAW = {
    "Invoice": ("invoice", "string"),
    "StockCode": ("stock_code", "string"),
    "Description": ("description", "string"),
    "Quantity": ("quantity", "double"),
    "InvoiceDate": ("invoice_date", "timestamp_ntz"),
    "Price": ("price", "double"),
    "Customer ID": ("customer", "string"),
    "Country": ("country", "string"),
    "source_sheet": ("source_sheet", "string"),
    "source_row": ("line_id", "string"),
    "line_id": ("line_id", "string"),
}
ACCEPTED = {
    **{n: c for n, c in RAW.items() if n != "source_row"},
    "ambiguous_duplicate": ("ambiguous_duplicate", "boolean"),
    "is_cancellation": ("is_cancellation", "boolean"),
    "is_adjustment": ("is_adjustment", "boolean"),
}
BUSINESS = [RAW[c][0] for c in SCHEMA.required]
NUMBERS = {"Quantity": "quantity", "Price": "price"}


def _r(x: str) -> str:
    return f"ROUND({x}, 6)"


def _missing(table: str, columns: dict, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", COUNT(*) - COUNT({c}) AS missing_count,
              {_r(f"(COUNT(*) - COUNT({c})) * 100 / COUNT(*)")} AS missing_pct,
              COUNT(DISTINCT {c}) AS unique_count, '{t}' AS dtype{extra} FROM {table}"""
        for n, (c, t) in columns.items()
    )


@register("missing_summary", over(_missing("raw_lines", RAW)))
def _(m):
    return rounded(profile.missing_summary(m["source"]))


@register(
    "missing_comparison",
    over(
        _missing("raw_lines", {n: c for n, c in RAW.items() if n != "source_row"}, ", 'before' AS state")
        + " UNION ALL "
        + _missing("accepted", ACCEPTED, ", 'after' AS state")
    ),
)
def _(m):
    return rounded(
        profile.compare_missing(m["source"].drop("source_row"), m["accepted"].drop("source_row"))
    )


def _describe(table: str, columns: dict, probs: list[float], by: str = "") -> str:
    marks = lambda c: ", ".join(
        f"{_r(f'QUANTILE_CONT({c}, {p})')} AS p{p * 100:g}" for p in probs
    )
    return " UNION ALL ".join(
        f"""SELECT {by}'{n}' AS "column", COUNT({c}) AS count, {_r(f'AVG({c})')} AS mean,
              {_r(f'STDDEV_SAMP({c})')} AS std, CAST(MIN({c}) AS DOUBLE) AS min,
              CAST(MAX({c}) AS DOUBLE) AS max, {_r(f'SKEWNESS({c})')} AS skewness,
              {_r(f'KURTOSIS({c})')} AS kurtosis, {marks(f'CAST({c} AS DOUBLE)')}
            FROM {table} {"GROUP BY " + by[:-2] if by else ""}"""
        for n, c in columns.items()
    )


@register("numeric_profile", over(_describe("raw_lines", NUMBERS, [0.01, 0.25, 0.5, 0.75, 0.99])))
def _(m):
    return rounded(profile.describe(m["source"], list(NUMBERS), (0.01, 0.25, 0.5, 0.75, 0.99)))


@register(
    "numeric_profile_by_country",
    over(_describe("raw_lines", NUMBERS, [0.25, 0.5, 0.75], "country, ")),
)
def _(m):
    df = m["source"].withColumnRenamed("Country", "country")
    return rounded(profile.describe(df, list(NUMBERS), by=["country"]))


def _corr(table: str, columns: dict) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {_r(f'CORR({x}, {y})')} AS r FROM {table}"
        for a, x in columns.items()
        for b, y in columns.items()
    )


@register("correlation_matrix", over(_corr("raw_lines", NUMBERS)))
def _(m):
    return rounded(profile.correlations(m["source"], list(NUMBERS)))


@register(
    "constant_columns",
    over(
        " UNION ALL ".join(
            f"""SELECT '{n}' AS "column" FROM raw_lines HAVING COUNT(DISTINCT {c}) <= 1"""
            for n, (c, _t) in RAW.items()
        )
    ),
)
def _(m):
    return profile.constant_columns(profile.missing_summary(m["source"]))


@register(
    "high_cardinality_columns",
    over(
        " UNION ALL ".join(
            f"""SELECT '{n}' AS "column" FROM raw_lines HAVING COUNT(DISTINCT {c}) > 0.5 * COUNT(*)"""
            for n, (c, _t) in RAW.items()
        )
    ),
)
def _(m):
    rows = m["source"].agg(F.count(F.lit(1))).scalar()
    return profile.high_cardinality(profile.missing_summary(m["source"]), rows)


@register(
    "date_coverage",
    over(
        """SELECT 'InvoiceDate' AS "column", STRFTIME(MIN(invoice_date), '%Y-%m-%d %H:%M:%S') AS first,
                  STRFTIME(MAX(invoice_date), '%Y-%m-%d %H:%M:%S') AS last FROM raw_lines"""
    ),
)
def _(m):
    return profile.date_coverage(m["source"])


@register(
    "top_categories",
    over(
        " UNION ALL ".join(
            f"""SELECT * FROM (SELECT '{n}' AS "column",
                  CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c} NULLS FIRST) AS INTEGER) AS rank,
                  {c} AS value, COUNT(*) AS n FROM raw_lines GROUP BY {c}) WHERE rank <= 10"""
            for n, (c, t) in RAW.items()
            if t == "string"
        )
    ),
)
def _(m):
    source = m["source"]
    texts = profile.text_columns(source)
    return profile.top_categories(profile.value_counts(source, texts), texts)


@register("profile_shape", over("SELECT COUNT(*) AS rows, 11 AS columns FROM raw_lines"))
def _(m):
    return profile.profile(m["source"])["shape"]


@register(
    "missing_customer_by_country",
    over(
        f"""SELECT country AS "Country", COUNT(*) AS size,
              {_r('AVG(CASE WHEN customer IS NULL THEN 1 ELSE 0 END)')} AS mean
            FROM raw_lines GROUP BY country"""
    ),
)
def _(m):
    return rounded(profile.missing_rate_by(m["source"], "Customer ID", F.col("Country")))


@register(
    "missing_customer_by_month",
    over(
        f"""SELECT STRFTIME(invoice_date, '%Y-%m') AS month, COUNT(*) AS size,
              {_r('AVG(CASE WHEN customer IS NULL THEN 1 ELSE 0 END)')} AS mean
            FROM raw_lines GROUP BY 1"""
    ),
)
def _(m):
    month = F.date_format("InvoiceDate", "yyyy-MM").alias("month")
    return rounded(profile.missing_rate_by(m["source"], "Customer ID", month))


_JOINT = {"Description": "description", "Customer ID": "customer", "Country": "country"}


@register(
    "joint_missingness",
    over(
        " UNION ALL ".join(
            f"""SELECT '{a}' AS a, '{b}' AS b,
                  {_r(f"COUNT(*) FILTER (WHERE {x} IS NULL AND {y} IS NULL) * 100 / COUNT(*)")} AS pct
                FROM raw_lines"""
            for a, x in _JOINT.items()
            for b, y in _JOINT.items()
        )
    ),
)
def _(m):
    return rounded(profile.joint_missingness(m["source"], list(_JOINT)))


@register("seeded_sample")
def _(m):
    return profile.hashed_sample(m["source"].drop("source_row"), "line_id", 1000)


def _surplus(keys: str) -> str:
    return f"""(SELECT CAST(SUM(n - 1) AS BIGINT)
                FROM (SELECT COUNT(*) AS n FROM raw_lines GROUP BY {keys}))"""


@register(
    "duplicate_summary",
    over(
        f"""SELECT COUNT(*) AS rows, {_surplus(", ".join(BUSINESS))} AS exact_business_row_repeats,
              {_surplus('invoice')} AS repeated_invoice_rows,
              {_surplus('line_id')} AS duplicate_line_ids FROM raw_lines"""
    ),
)
def _(m):
    return profile.duplicate_summary(m["source"], SCHEMA.required)


@register(
    "near_repeats",
    over(
        """SELECT CAST(SUM(n) AS BIGINT) AS near_repeat_rows FROM (
             SELECT COUNT(*) AS n FROM raw_lines
             GROUP BY invoice, stock_code, quantity, price, customer HAVING COUNT(*) > 1)"""
    ),
)
def _(m):
    keys = ["Invoice", "StockCode", "Quantity", "Price", "Customer ID"]
    return profile.near_repeats(m["source"], keys)


@register(
    "repeat_examples",
    over(
        f"""SELECT line_id, source_sheet FROM (
              SELECT *, COUNT(*) OVER (PARTITION BY {", ".join(BUSINESS)}) AS n FROM raw_lines)
            WHERE n > 1 ORDER BY source_sheet, line_id LIMIT 200"""
    ),
)
def _(m):
    order = ["source_sheet", "source_row"]
    rows = profile.repeat_examples(m["source"], SCHEMA.required, order)
    return rows.select("line_id", "source_sheet")


def _outlier_parts(by: str = "") -> dict[str, str]:
    """`bounds` and `judged` relations; `by` is '' or 'country'."""
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    link = f"USING ({by})" if by else "ON TRUE"
    stats = ", ".join(
        f"""QUANTILE_CONT({c}, 0.25) AS {c}_q1, QUANTILE_CONT({c}, 0.75) AS {c}_q3,
            QUANTILE_CONT({c}, 0.01) AS {c}_p01, QUANTILE_CONT({c}, 0.99) AS {c}_p99,
            MEDIAN({c}) AS {c}_median, AVG({c}) AS {c}_mean, STDDEV_SAMP({c}) AS {c}_sd"""
        for c in NUMBERS.values()
    )
    mads = ", ".join(f"MEDIAN(ABS({c} - {c}_median)) AS {c}_mad" for c in NUMBERS.values())
    flags = ", ".join(
        f"""COALESCE({c} < {c}_q1 - 1.5 * ({c}_q3 - {c}_q1)
                  OR {c} > {c}_q3 + 1.5 * ({c}_q3 - {c}_q1), FALSE) AS {c}_iqr,
            COALESCE({c}_sd > 0 AND ABS({c} - {c}_mean) > 3 * {c}_sd, FALSE) AS {c}_zscore,
            COALESCE({c}_mad > 0 AND 0.6745 * ABS({c} - {c}_median) / NULLIF({c}_mad, 0) > 3.5, FALSE)
              AS {c}_mad_flag,
            COALESCE({c} < {c}_p01 OR {c} > {c}_p99, FALSE) AS {c}_percentile,
            {c} IS NULL OR NOT ISFINITE({c}) AS {c}_nonfinite"""
        for c in NUMBERS.values()
    )
    mids = f"SELECT {keys}{stats} FROM raw_lines {group}"
    return {
        "mids": mids,
        "mads": f"SELECT {keys}{mads} FROM raw_lines JOIN mids {link} {group}",
        "judged": f"SELECT *, {flags} FROM raw_lines JOIN mids {link} JOIN mads {link}",
    }


_METHODS = {
    "iqr": "iqr",
    "zscore": "zscore",
    "mad": "mad_flag",
    "percentile": "percentile",
    "nonfinite": "nonfinite",
}


@register(
    "outlier_limits",
    over(
        " UNION ALL ".join(
            f"""SELECT '{n}' AS "column", """
            + ", ".join(
                f"{_r(f'{c}_{s}')} AS {s}"
                for s in ["q1", "q3", "p01", "p99", "median", "mad", "mean", "sd"]
            )
            + " FROM mids JOIN mads ON TRUE"
            for n, c in NUMBERS.items()
        ),
        **_outlier_parts(),
    ),
)
def _(m):
    wide = outliers.limits(m["source"], list(NUMBERS))
    long = wide.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in NUMBERS]))
        .alias("e")
    )
    return rounded(long.select("e.column", "e.s.*"))


def _summary_sql(parts: dict[str, str]) -> str:
    return over(
        " UNION ALL ".join(
            f"""SELECT '{n}' AS "column", '{k}' AS method,
                  COUNT(*) FILTER (WHERE {c}_{s}) AS rows,
                  {_r(f'COUNT(*) FILTER (WHERE {c}_{s}) / COUNT(*)')} AS fraction FROM judged"""
            for n, c in NUMBERS.items()
            for k, s in _METHODS.items()
        ),
        **parts,
    )


def _flags(m, by=()):
    df = m["source"]
    return outliers.outlier_flags(
        df, list(NUMBERS), outliers.limits(df, list(NUMBERS), by), by
    )


@register("outlier_summary", _summary_sql(_outlier_parts()))
def _(m):
    return rounded(outliers.outlier_summary(_flags(m), list(NUMBERS)))


@register("outlier_summary_within_country", _summary_sql(_outlier_parts("country")))
def _(m):
    return rounded(outliers.outlier_summary(_flags(m, ["Country"]), list(NUMBERS)))


@register(
    "outlier_line_flags",
    over(
        """SELECT line_id, CAST(quantity_iqr AS INTEGER) AS "Quantity_iqr",
             CAST(price_iqr AS INTEGER) AS "Price_iqr",
             CAST(COALESCE(price < 0, FALSE) AS INTEGER) AS negative_price,
             CAST(COALESCE(price = 0, FALSE) AS INTEGER) AS zero_price FROM judged""",
        **_outlier_parts(),
    ),
)
def _(m):
    return plain(outliers.line_flags(_flags(m), list(NUMBERS)))


@register(
    "outlier_rate_by_country",
    over(
        f"""SELECT country AS "Country", COUNT(*) AS size,
              {_r('AVG(CASE WHEN quantity_iqr THEN 1 ELSE 0 END)')} AS mean
            FROM judged GROUP BY country""",
        **_outlier_parts(),
    ),
)
def _(m):
    return rounded(outliers.iqr_rate_by(_flags(m), "Quantity", "Country"))


# ---- exploratory tables -----------------------------------------------------------------


def _positive(m):
    return eda.positive_invoices(m["v_invoices"], m["dim_country"])


@register(
    "invoices_with_country",
    over(
        """SELECT invoice_id, customer_id, country_id, STRFTIME(date, '%Y-%m-%d') AS date, gross_sales,
                  cancellation_value, sale_lines, sale_units, country
           FROM v_invoices JOIN dim_country USING (country_id)"""
    ),
)
def _(m):
    return plain(eda.invoices_with_country(m["v_invoices"], m["dim_country"]))


@register("customer_summary", over("SELECT * FROM customers"))
def _(m):
    return m["customers"]


@register(
    "invoice_segments",
    over(
        f"""SELECT country, COUNT(*) AS size, {_r(f"{total('gross_sales')} / COUNT(*)")} AS mean,
              {_r('MEDIAN(gross_sales)')} AS median, {_r('STDDEV_SAMP(gross_sales)')} AS std,
              {_r('SKEWNESS(gross_sales)')} AS skew FROM positive GROUP BY country"""
    ),
)
def _(m):
    return rounded(eda.segment_stats(_positive(m)))


@register(
    "seasonality",
    over(
        f"""SELECT CAST(MONTH(date) AS INTEGER) AS month_number, weekday,
              {_r(f"{total('gross_sales')} / COUNT(*)")} AS mean, COUNT(*) AS size
            FROM v_daily GROUP BY 1, 2"""
    ),
)
def _(m):
    return rounded(eda.seasonality(m["daily"]))


_MEASURES = {c: c for c in eda.INVOICE_MEASURES}


@register("invoice_profile", over(_describe("positive", _MEASURES, [0.01, 0.5, 0.9, 0.99])))
def _(m):
    return rounded(profile.describe(_positive(m), eda.INVOICE_MEASURES, (0.01, 0.5, 0.9, 0.99)))


@register("invoice_pearson", over(_corr("positive", _MEASURES)))
def _(m):
    return rounded(profile.correlations(_positive(m), eda.INVOICE_MEASURES))


def rank_parts(table: str, columns: list[str]) -> dict[str, str]:
    cells = ", ".join(
        f"RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2 AS r_{c}"
        for c in columns
    )
    return {"ranked": f"SELECT {cells} FROM {table}"}


@register(
    "invoice_spearman",
    over(
        _corr("ranked", {c: f"r_{c}" for c in eda.INVOICE_MEASURES}),
        **rank_parts("positive", eda.INVOICE_MEASURES),
    ),
)
def _(m):
    return rounded(eda.spearman(_positive(m), eda.INVOICE_MEASURES))


@register(
    "daily_autocorrelation",
    over(
        " UNION ALL ".join(
            f"""SELECT {k} AS lag, {_r('CORR(gross_sales, before)')} AS r FROM (
                  SELECT gross_sales, LAG(gross_sales, {k}) OVER (ORDER BY date) AS before FROM v_daily)"""
            for k in (1, 7, 14, 28)
        )
    ),
)
def _(m):
    return rounded(eda.autocorrelation(m["daily"]))


@register(
    "daily_summary",
    over(
        f"""SELECT {_r(f"{total('gross_sales')} / COUNT(*)")} AS mean_daily_gross_sales,
              COUNT(*) FILTER (WHERE gross_sales = 0) AS zero_sales_days,
              MIN(gross_sales) AS least_day, MAX(gross_sales) AS greatest_day FROM v_daily"""
    ),
)
def _(m):
    return rounded(eda.daily_summary(m["daily"]))


@register(
    "invoice_histogram",
    over(
        f"""SELECT CAST(k AS INTEGER) AS bin, {_r('lo + k * (hi - lo) / 50')} AS low,
              {_r('lo + (k + 1) * (hi - lo) / 50')} AS high, COUNT(bin) AS n
            FROM (SELECT UNNEST(RANGE(50)) AS k) JOIN ends ON TRUE LEFT JOIN binned ON bin = k
            GROUP BY k, lo, hi""",
        ends="SELECT MIN(LOG10(gross_sales)) AS lo, MAX(LOG10(gross_sales)) AS hi FROM positive",
        binned="""SELECT LEAST(FLOOR((LOG10(gross_sales) - lo) / (hi - lo) * 50), 49) AS bin
                  FROM positive JOIN ends ON TRUE""",
    ),
)
def _(m):
    return rounded(eda.histogram(_positive(m), "log_sales", 50))


_TOP6 = """SELECT country FROM positive GROUP BY country ORDER BY COUNT(*) DESC, country LIMIT 6"""


@register(
    "country_box_stats",
    over(
        f"""SELECT country, {_r('q1')} AS q1, {_r('median')} AS median, {_r('q3')} AS q3,
              COUNT(*) AS n,
              {_r('MIN(CASE WHEN v >= q1 - (q3 - q1) * 1.5 THEN v END)')} AS whisker_low,
              {_r('MAX(CASE WHEN v <= q3 + (q3 - q1) * 1.5 THEN v END)')} AS whisker_high
            FROM kept JOIN marks USING (country) GROUP BY country, q1, median, q3""",
        top6=_TOP6,
        kept="SELECT country, LOG10(gross_sales) AS v FROM positive SEMI JOIN top6 USING (country)",
        marks="""SELECT country, QUANTILE_CONT(v, 0.25) AS q1, MEDIAN(v) AS median,
                   QUANTILE_CONT(v, 0.75) AS q3 FROM kept GROUP BY country""",
    ),
)
def _(m):
    return rounded(eda.box_stats(_positive(m), "log_sales", "country"))


@register("sampled_country_quartiles")
def _(m):
    return eda.sampled_quartiles(_positive(m))


@register("sampled_invoice_pairs")
def _(m):
    return eda.sampled_pairs(_positive(m))


@register(
    "cohort_matrix",
    over(
        """SELECT cohort, months_since_first, observed_retention
           FROM (SELECT DISTINCT cohort FROM cells)
           CROSS JOIN (SELECT CAST(UNNEST(RANGE(0, (SELECT MAX(months_since_first) + 1 FROM cells)))
                         AS INTEGER) AS months_since_first)
           LEFT JOIN (SELECT cohort, CAST(months_since_first AS INTEGER) AS months_since_first,
                        observed_retention FROM cells) USING (cohort, months_since_first)""",
        **COHORT_PARTS,
        cells=QUESTIONS["cohorts"],
    ),
)
def _(m):
    wide = eda.cohort_matrix(questions.cohorts(star_of(m)))
    months = [c for c in wide.columns if c != "cohort"]
    long = wide.unpivot("cohort", months, "months_since_first", "observed_retention")
    return long.withColumn("months_since_first", F.col("months_since_first").cast("int"))


@register(
    "leading_products_share",
    over(
        f"""SELECT {_r('SUM(sales_share)')} AS leading_share, COUNT(*) AS products
            FROM (SELECT * FROM c ORDER BY gross_sales DESC, product_id LIMIT 20)""",
        c=QUESTIONS["contributions"],
    ),
)
def _(m):
    return rounded(eda.leading_share(questions.contributions(star_of(m))))


@register(
    "top_ten_countries",
    over("SELECT * FROM c ORDER BY gross_sales DESC, country LIMIT 10", c=QUESTIONS["country"]),
)
def _(m):
    return questions.country(star_of(m)).limit(10)


@register(
    "market_mix",
    over(
        """SELECT month, market,
             CAST(v AS DOUBLE) * 100 / NULLIF(CAST(SUM(v) OVER (PARTITION BY month) AS DOUBLE), 0)
               AS share_pct
           FROM (SELECT month, COALESCE(l.country, 'Other countries') AS market, SUM(v) AS v
                 FROM per LEFT JOIN leaders l USING (country) GROUP BY 1, 2)""",
        per=f"SELECT month, country, SUM({money('gross_sales')}) AS v FROM lines GROUP BY 1, 2",
        leaders="""SELECT country FROM per GROUP BY country
                   ORDER BY SUM(v) DESC, country LIMIT 4""",
    ),
)
def _(m):
    return eda.market_mix(m["lines"])
