import pytest
from pyspark.sql import functions as F

from fixtures.mart import Mart
from fixtures.retail_lines import LINE, heavy_orders, joined_lines
from fixtures.retail_lines import SCHEMA as cleaning_schema
from tillspark.operators import cleaning, transform
from tillspark.sources.workspace import materialize


@pytest.fixture
def tables(spark, tmp_path):
    """Small order tables: one order with most lines and copies, unknown and repeated keys, nulls."""

    def line(order, part, number):
        return (order, part, 1, number, 2.0, 10.0, 0.0, 0.01, "N", "O")

    lines = [line(1, 1, 1)] * 5 + [line(1, 2, 2)] * 3 + [line(1, 9, 3)] + [line(2, 1, 1)] * 2
    lines += [line(3, 2, 1), line(4, 1, 1), line(None, 1, 1), line(9, 1, 1), line(2, None, 2), (2, 1, 1, None, *[None] * 6)]
    kinds = "bigint bigint bigint int double double double double string string".split()
    ddl = ", ".join(f"{c} {k}" for c, k in zip(LINE, kinds, strict=False))
    frames = {
        "lineitem": spark.createDataFrame(lines, ddl).withColumn("l_shipdate", F.lit("2000-01-01").cast("timestamp_ntz")),
        "orders": spark.createDataFrame(
            [(1, 1), (2, 1), (2, 2), (3, 7), (4, None), (None, 1)], "o_orderkey bigint, o_custkey bigint"
        ).withColumn("o_orderdate", F.lit("1999-01-01").cast("timestamp_ntz")),
        "customer": spark.createDataFrame([(1, 0), (2, 1), (None, 1)], "c_custkey bigint, c_nationkey int"),
        "part": spark.createDataFrame(
            [(1, "a", "x"), (2, "b", "y"), (2, "c", "z"), (None, "d", "w")], "p_partkey bigint, p_brand string, p_name string"
        ),
        "nation": spark.createDataFrame([(0, "N0"), (1, "N1")], "n_nationkey int, n_name string"),
    }
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return frames, str(tmp_path)


def test_lines_meet_their_facts_whatever_the_path(spark, tables):
    frames, folder = tables
    assert heavy_orders(frames["lineitem"], 0.5) == [1]
    want = None
    for options in ({}, {"share": 0.5}, {"share": 0.01}, {"list_rows": 0}, {"list_rows": 0, "share": 0.5}):
        joined = joined_lines(spark, folder, **options)
        got = sorted(map(str, joined.collect()))
        want = want or got
        assert got == want and "rn" in joined.columns
    per = {(r["l_orderkey"], r["l_partkey"]): r["rows"] for r in joined.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("rows")).collect()}
    assert per == {(1, 1): 5, (1, 2): 6, (2, 1): 6}  # repeated orders and parts multiply, as in any join
    assert sorted(r["rn"] for r in joined.where("l_partkey = 1 AND l_orderkey = 1").collect()) == [1, 2, 3, 4, 5]


def test_lines_are_moved_once(spark, tables):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joined_lines(spark, tables[1], share=1.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("hashpartitioning(l_orderkey") == 1 and "hashpartitioning(l_partkey" not in plan


def test_derived_values_are_not_written(spark, tables):
    m = Mart(spark, tables[1])
    written, lines = m["line_rows"].columns, m["lines"]
    assert "line_id" in written and not {"net_value", "gross_sales", "month", "source_row"} & set(written)
    want = transform.derive_lines(cleaning.standardize(m["accepted"]))
    assert lines.columns == want.columns and lines.count() == want.count() > 0
    assert lines.exceptAll(want).isEmpty()


def test_cleaned_lines_are_said_on_read(spark, tables):
    """Neither accepted lines nor ids are written, and all is as the operators say it."""
    m = Mart(spark, tables[1])
    flagged, lines = m["flagged"], m["lines"]
    assert lines.count() > 0 and set(m.tables) & set(m.recipes) == {"joined"}
    assert not {"line_id", "source_row"} & set(spark.read.parquet(f"{m.folder}/flagged_rows").columns)
    plain = cleaning.flag_lines(m["source"], cleaning_schema)
    assert flagged.columns == plain.columns and flagged.exceptAll(plain).isEmpty() and plain.exceptAll(flagged).isEmpty()
    want = transform.derive_lines(cleaning.standardize(cleaning.accepted(plain, cleaning_schema)))
    assert lines.columns == want.columns and lines.exceptAll(want).isEmpty() and want.exceptAll(lines).isEmpty()


def test_cleaning_is_compiled_and_passes_over_the_source_twice(spark, tables, monkeypatch):
    """The JVM compiles no method over 8,000 bytes; hashes and the one write each read the joined lines."""
    written = {}

    def spy(df, path):
        written[path.rsplit("/", 1)[-1].split("-")[0]] = df
        return materialize(df, path)

    for module in ("fixtures.mart", "tillspark.operators.cleaning", "tillspark.operators.repeats"):
        monkeypatch.setattr(f"{module}.materialize", spy)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        m = Mart(spark, tables[1])
        assert m["flagged"].count() > 0 and {"flagged_rows", "equal", "hashes"} <= set(written)
        stages = written["flagged_rows"]._jdf.queryExecution().debug().codegenToSeq()
        assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) <= 8000
        assert not any("joined" in f for f in written["equal"].inputFiles())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
