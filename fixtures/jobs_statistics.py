"""Contrast tests, intervals and the statistics report."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtures.jobs_reports import _corr, _r, rank_parts
from fixtures.oracle import over
from fixtures.registry import register, rounded
from fixtures.retail_lines import CONTRAST_COUNTRY
from tillspark.operators import eda, resampling, stats
from tillspark.operators.features import drop_last_day


def _groups(m):
    return stats.contrast_groups(m["customers"], CONTRAST_COUNTRY)


@register(
    "contrast_sizes",
    over(
        f"""SELECT COUNT(*) FILTER (WHERE countries = 1 AND country = '{CONTRAST_COUNTRY}') AS n_inside,
              COUNT(*) FILTER (WHERE countries = 1 AND country <> '{CONTRAST_COUNTRY}') AS n_outside,
              COUNT(*) FILTER (WHERE countries > 1) AS excluded_multi_country FROM customers"""
    ),
)
def _(m):
    return stats.contrast_sizes(m["customers"], CONTRAST_COUNTRY)


@register(
    "welch_test",
    over(
        f"""SELECT n_a, n_b, {_r('mean_a')} AS mean_a, {_r('mean_b')} AS mean_b,
              {_r('mean_a - mean_b')} AS mean_difference,
              {_r('(mean_a - mean_b) / SQRT(va / n_a + vb / n_b)')} AS statistic,
              {_r('''POWER(va / n_a + vb / n_b, 2) / (POWER(va / n_a, 2) / (n_a - 1)
                     + POWER(vb / n_b, 2) / (n_b - 1))''')} AS degrees,
              {_r('''(mean_a - mean_b) / SQRT(((n_a - 1) * va + (n_b - 1) * vb)
                     / (n_a + n_b - 2))''')} AS cohen_d
            FROM (SELECT CAST(COUNT(*) FILTER (WHERE inside) AS DOUBLE) AS n_a,
                         CAST(COUNT(*) FILTER (WHERE NOT inside) AS DOUBLE) AS n_b,
                         AVG(average_order) FILTER (WHERE inside) AS mean_a,
                         AVG(average_order) FILTER (WHERE NOT inside) AS mean_b,
                         VAR_SAMP(average_order) FILTER (WHERE inside) AS va,
                         VAR_SAMP(average_order) FILTER (WHERE NOT inside) AS vb FROM eligible)"""
    ),
)
def _(m):
    return rounded(stats.welch(_groups(m), "average_order").drop("var_a", "var_b", "p_value"))


@register(
    "mann_whitney_test",
    over(
        f"""SELECT rows, n_a, n_b, rank_sum, ties, u AS statistic,
              {_r('''(GREATEST(u, n_a * n_b - u) - n_a * n_b / 2 - 0.5)
                / SQRT(n_a * n_b / 12 * ((rows + 1) - ties / (rows * (rows - 1))))''')} AS z,
              {_r('2 * u / (n_a * n_b) - 1')} AS rank_biserial
            FROM (SELECT *, rank_sum - n_a * (n_a + 1) / 2 AS u FROM sums)""",
        ranked="""SELECT inside, average_order,
                    RANK() OVER (ORDER BY average_order)
                      + (COUNT(*) OVER (PARTITION BY average_order) - 1) / 2 AS r FROM eligible""",
        sums="""SELECT CAST(COUNT(*) AS DOUBLE) AS rows,
                  CAST(COUNT(*) FILTER (WHERE inside) AS DOUBLE) AS n_a,
                  CAST(COUNT(*) FILTER (WHERE NOT inside) AS DOUBLE) AS n_b,
                  SUM(r) FILTER (WHERE inside) AS rank_sum,
                  (SELECT CAST(SUM(n * n * n - n) AS DOUBLE) FROM (
                     SELECT COUNT(*) AS n FROM eligible GROUP BY average_order)) AS ties FROM ranked""",
    ),
)
def _(m):
    return rounded(stats.mann_whitney(_groups(m), "average_order").drop("p_value"))


@register("contrast_tests_holm")
def _(m):
    return stats.contrast_tests(_groups(m))


@register(
    "orders_vs_average_order",
    over(
        f"""SELECT {_r('CORR(orders, average_order)')} AS pearson_r,
              (SELECT {_r('CORR(r_orders, r_average_order)')} FROM ranked) AS spearman_r FROM eligible""",
        **rank_parts("eligible", ["orders", "average_order"]),
    ),
)
def _(m):
    return rounded(stats.association(_groups(m), "orders", "average_order"))


@register(
    "customer_spearman",
    over(
        _corr("ranked", {c: f"r_{c}" for c in ("orders", "average_order", "gross_sales")}),
        **rank_parts("customers", ["orders", "average_order", "gross_sales"]),
    ),
)
def _(m):
    return rounded(eda.spearman(m["customers"], ["orders", "average_order", "gross_sales"]))


def _mixed(x: str) -> str:
    """The integer hash of resampling.mixed as one expression of a column."""
    x = f"({x} & 4294967295)"
    for _ in range(2):
        x = f"((xor({x} >> 16, {x}) * {resampling.MULTIPLIER}) & 4294967295)"
    return f"xor({x} >> 16, {x})"


def _stream(source: str, seed: int, *parts: str) -> str:
    """`source` with columns base and step, one nested query per part."""
    query = f"SELECT *, {_mixed(f'CAST({seed} AS BIGINT)')} AS h FROM {source}"
    for part in parts:
        query = f"SELECT * REPLACE ({_mixed(f'(h + {part})')} AS h) FROM ({query})"
    return f"SELECT * RENAME (h AS base), {_mixed('(h + 1)')} | 1 AS step FROM ({query})"


_REPS, _BITS, _CHUNK = 1000, resampling.BLOCK_BITS, resampling.DRAWS_PER_STREAM

# The same draws: positions counted per block first, then drawn inside the blocks.
_DRAWN = {
    "placed": f"""SELECT CAST(inside AS BIGINT) AS g, average_order AS x,
                ROW_NUMBER() OVER (PARTITION BY inside ORDER BY average_order) - 1 AS i FROM eligible
              WHERE average_order IS NOT NULL""",
    "sizes": "SELECT g, COUNT(*) AS n FROM placed GROUP BY g",
    "blocks": f"SELECT g, i >> {_BITS} AS b, COUNT(*) AS rows FROM placed GROUP BY g, i >> {_BITS}",
    "streams": _stream(
        f"""(SELECT g, n, rep, UNNEST(RANGE((n - 1) // {_CHUNK} + 1)) AS c
             FROM (SELECT g, n, UNNEST(RANGE({_REPS})) AS rep FROM sizes))""",
        42, "g", "rep", "c",
    ),
    "first_draws": f"""SELECT g, rep, n, base, {_mixed('(base + i * step)')} AS u FROM (
                    SELECT *, UNNEST(RANGE(1, LEAST({_CHUNK}, n - c * {_CHUNK}) + 1)) AS i FROM streams)""",
    "quota": f"""SELECT g, rep, b, COUNT(*) AS m FROM (
                   SELECT g, rep,
                     ((u * 2147483648 + ({_mixed('(u + base)')} >> 1)) % n) >> {_BITS} AS b FROM first_draws)
                 GROUP BY g, rep, b""",
    "inner_streams": _stream("quota", 43, "g", "rep", "b"),
    "second_draws": f"""SELECT d.g, d.rep, (d.b << {_BITS}) + ((u * rows) >> 32) AS i FROM (
                          SELECT g, rep, b, {_mixed('(base + i * step)')} AS u FROM (
                            SELECT *, UNNEST(RANGE(1, m + 1)) AS i FROM inner_streams)) AS d
                        JOIN blocks AS k ON k.g = d.g AND k.b = d.b""",
    "means": """SELECT s.g, rep, SUM(x) / MAX(n) AS mean FROM second_draws AS s
                JOIN placed AS p ON p.g = s.g AND p.i = s.i
                JOIN sizes AS z ON z.g = s.g GROUP BY s.g, rep""",
    "repeated": """SELECT rep, SUM(mean) FILTER (WHERE g = 1) - SUM(mean) FILTER (WHERE g = 0) AS v
                   FROM means GROUP BY rep""",
    "interval": """SELECT QUANTILE_CONT(v, 0.025) AS low, QUANTILE_CONT(v, 0.975) AS high,
                     COUNT(v) AS repetitions FROM repeated""",
}


@register(
    "bootstrap_difference_interval",
    over(f"SELECT {_r('low')} AS low, {_r('high')} AS high, repetitions FROM interval", **_DRAWN),
)
def _(m):
    groups = _groups(m)
    return rounded(resampling.bootstrap_difference(groups, "average_order", groups["inside"]))


@register(
    "block_bootstrap_interval",
    over(
        f"""SELECT {_r('QUANTILE_CONT(v, 0.025)')} AS low, {_r('QUANTILE_CONT(v, 0.975)')} AS high,
              COUNT(v) AS repetitions
            FROM (SELECT rep, CAST(SUM(gross) AS DOUBLE) / MAX(n) AS v FROM picked GROUP BY rep)""",
        history="""SELECT CAST(gross_sales AS DECIMAL(38, 4)) AS gross,
                     ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS n FROM v_daily
                   WHERE date < (SELECT MAX(date) FROM v_daily)""",
        places=_stream(
            """(SELECT n, rep, UNNEST(RANGE((n - 1) // 7 + 1)) AS j
                FROM (SELECT MAX(n) AS n, UNNEST(RANGE(1000)) AS rep FROM history))""",
            42, "rep",
        ),
        days=f"""SELECT n, rep, first + UNNEST(RANGE(LEAST(7, n - j * 7))) AS i
                 FROM (SELECT *, ({_mixed('(base + j * step)')} * (n - 6)) >> 32 AS first FROM places)""",
        picked="SELECT days.rep, days.n, gross FROM days JOIN history ON history.i = days.i",
    ),
)
def _(m):
    return rounded(resampling.block_bootstrap_mean(drop_last_day(m["daily"])))


@register("statistics_report")
def _(m):
    return stats.statistics_report(m["customers"], m["daily"], CONTRAST_COUNTRY)


@register(
    "contrast_interval_table",
    over(
        f"""SELECT {_r('center')} AS center, {_r('low')} AS low, {_r('high')} AS high,
              {_r('GREATEST(0, center - low)')} AS below, {_r('GREATEST(0, high - center)')} AS above
            FROM interval, (SELECT AVG(average_order) FILTER (WHERE inside)
                              - AVG(average_order) FILTER (WHERE NOT inside) AS center FROM eligible)""",
        **_DRAWN,
    ),
)
def _(m):
    groups = _groups(m)
    center = stats.welch(groups, "average_order").select("mean_difference")
    ends = resampling.bootstrap_difference(groups, "average_order", groups["inside"])
    row = center.withColumn("e", ends.select(F.struct("low", "high")).scalar())
    return rounded(
        eda.interval_table(F.col("mean_difference"), F.col("e.low"), F.col("e.high"), row)
    )


@register(
    "monthly_completeness",
    over(
        """SELECT COUNT(*) AS months, COUNT(*) FILTER (WHERE complete_month = 0) AS incomplete_months
           FROM v_monthly"""
    ),
)
def _(m):
    return eda.month_completeness(m["v_monthly"])
