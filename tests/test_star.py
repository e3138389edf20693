import pytest
from pyspark.sql import functions as F

from fixtures import registry
from tests.data import FIRST, UK, as_dict, lines_of, source_rows
from tillspark.operators import checks, metrics, star, transform
from tillspark.plans import questions, views
from tillspark.schema import STAR_SCHEMAS


@pytest.fixture(scope="module")
def lines(spark):
    return lines_of(spark, source_rows()).cache()


@pytest.fixture(scope="module")
def tables(lines):
    built = {n: df.cache() for n, df in star.build_star(lines).items()}
    return {**built, **{k: v for k, v in views.register_views(built).items() if k not in built}}


def test_gross_net_and_cancellation(lines):
    sums = as_dict(lines.agg(*[F.sum(c).alias(c) for c in ("gross_sales", "net_value", "cancellation_value")]))
    assert sums == {"gross_sales": 43.0, "net_value": 33.0, "cancellation_value": 10.0}


def test_positive_cancellation_is_no_sale(spark):
    row = lines_of(spark, [("C1", "1", "x", 2.0, FIRST, 5.0, "1", UK)]).first()
    assert not row["is_sale"] and row["gross_sales"] == 0 and row["cancellation_value"] == 0
    assert row["net_value"] == 10


def test_daily_calendar(lines):
    days = transform.daily_series(lines).orderBy("date").collect()
    assert len(days) == 3
    assert [d["has_records"] for d in days] == [True, False, True]
    assert days[1]["gross_sales"] == 0 and days[1]["orders"] == 0
    assert days[-1]["cumulative_sales"] == 43
    assert days[1]["daily_growth"] == -1 and days[2]["daily_growth"] is None


def test_star_schema_and_constraints(lines, tables):
    for name, schema in STAR_SCHEMAS.items():
        assert dict(tables[name].dtypes) == {f.name: f.dataType.simpleString() for f in schema}
    star.require_star(lines, tables)
    only = {n: tables[n] for n in STAR_SCHEMAS}
    assert checks.constraint_violations(only).agg(F.sum("violations")).first()[0] == 0
    report = as_dict(star.integration_report(lines, tables))
    assert (report["input_rows"], report["output_rows"], report["orphan_rows"]) == (5, 5, 0)
    assert report["dim_date_rows"] == 3


def test_latest_description_wins(spark):
    rows = [("1", "A", "old", 1.0, FIRST, 1.0, "1", UK), ("2", "A", "new", 1.0, FIRST, 1.0, "1", UK)]
    assert star.dim_product(lines_of(spark, rows)).first()["description"] == "new"


def test_key_failures(tables):
    fact, countries = tables["fact_sales"], tables["dim_country"]
    with pytest.raises(checks.CheckFailed):
        checks.require_foreign_key(fact, countries.limit(0), "country_id")
    with pytest.raises(checks.CheckFailed):
        checks.require_primary_key(fact, "invoice_id")
    with pytest.raises(checks.CheckFailed):
        checks.require_primary_key(countries.select(F.lit(None).alias("k")), "k")
    broken = fact.withColumn("unit_price", -F.col("unit_price"))
    found = checks.constraint_violations({"fact_sales": broken}).where("violations > 0").collect()
    assert [r["constraint"] for r in found] == ["unit_price >= 0"]


def test_all_questions_run(tables):
    assert len(questions.CATALOGUE) == 22
    answers = questions.run_all(tables)
    for name, df in answers.items():
        df.collect(), questions.headline(name, df).collect()
    assert answers["overview"].first()["gross_sales"] == 43
    said = questions.headline("prices", answers["prices"].where("false")).collect()
    assert len(said) <= 1


def test_views_register_for_sql(spark, tables):
    assert spark.sql("SELECT SUM(recorded_lines) FROM v_daily").first()[0] == 5


def test_sales_measures(tables):
    got = as_dict(metrics.measure(tables, list(metrics.LINE_MEASURES)))
    assert got["gross_sales"] == 43 and got["sale_invoices"] == 2 and got["known_buyers"] == 1
    assert got["anonymous_sales"] == 8 and got["zero_price_lines"] == 1
    days = metrics.trailing_week_sales(tables["v_daily"], F.dayofmonth("date") == 3).collect()
    assert [d["trailing_seven_day_sales"] for d in days] == [43]
    run = metrics.cumulative_in_selection(tables["v_daily"], F.dayofmonth("date") > 1)
    assert [d["cumulative_sales"] for d in run.orderBy("date").collect()] == [0, 8]
    one = metrics.average_daily_sales(tables["v_daily"]).first()[0]
    assert one == pytest.approx(43 / 3)


def test_country_denominator_ignores_country_choice(tables):
    shown = metrics.country_contribution(tables, countries=["nowhere", UK]).collect()
    assert [r["country_sales_contribution"] for r in shown] == [1.0]


def test_case_collisions_get_own_keys(spark):
    products = spark.createDataFrame([("7w", "a"), ("7W", "b"), ("8", "c")], "product_id string, description string")
    assert star.case_collisions(products).count() == 1
    assert {r["product_id"]: r["product_key"] for r in star.product_keys(products).collect()} == {
        "7W": 1, "7w": 2, "8": 3,
    }


def test_wide_months_show_every_cell(spark):
    registry.queries()
    lines = spark.createDataFrame(
        [("2010-01", "A", 1.5), ("2010-01", "B", 2.0), ("2010-02", "B", 4.0)],
        "month string, country string, gross_sales double",
    )
    wide = registry.JOBS["monthly_country_wide"](
        {"lines": lines, "dim_country": lines.select("country").distinct()}
    )
    assert wide.columns == ["month", "A", "B"]
    assert sorted(map(tuple, wide.collect())) == [("2010-01", 1.5, 2.0), ("2010-02", 0.0, 4.0)]
