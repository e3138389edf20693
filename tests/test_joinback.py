import pytest
from pyspark.sql import functions as F

from tests.data import SCHEMA, raw_frame, source_rows
from tillspark.operators import cleaning
from tillspark.operators.joinback import join_back


@pytest.fixture
def plain_shuffles(spark):
    """Nothing is rebalanced at run time, and no side is broadcast unless told to."""
    held = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _loads(df):
    held = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(held) / (sum(held) / 16)


@pytest.fixture
def lines(spark):
    """A hundred thousand equal lines, as many different ones, missing keys among them."""
    return spark.range(200_000).selectExpr(
        "id", "IF(id % 2 = 0, 'same', CAST(id AS STRING)) AS a", "IF(id % 2 = 0 OR id % 7 = 0, NULL, id % 5) AS b"
    )


def test_a_hot_line_is_dealt_over_all_tasks(spark, plain_shuffles, lines):
    marked = cleaning.mark_repeats(lines, ["a", "b"], "again", hot_rows=1000)
    assert _loads(marked) < 2
    assert _loads(cleaning.mark_repeats(lines, ["a", "b"], "again")) > 5  # one part: the case to avoid
    told = marked.groupBy("again").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d")).collect()
    assert {r["again"]: (r["n"], r["d"]) for r in told} == {True: (100_000, 100_000), False: (100_000, 100_000)}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_parts_do_not_change_the_join(spark, lines, how):
    rows = lines.where("id < 3000")
    groups = rows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1 OR b = 3").selectExpr("a AS x", "b AS y", "n")
    outs = [
        sorted(join_back(rows, groups, {"a": "x", "b": "y"}, "n", how, hot).select("id").collect())
        for hot in (None, 7, 100)
    ]
    assert outs[0] == outs[1] == outs[2] and len(outs[0]) == (3000 if how == "left" else len(set(outs[0])))


def test_empty_tables_and_missing_keys(spark, lines):
    none = lines.where("false")
    assert cleaning.mark_repeats(none, ["a", "b"]).count() == 0
    gone = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id long, a string")
    told = {r["id"]: r["again"] for r in cleaning.mark_repeats(gone, ["a"], "again", hot_rows=1).collect()}
    assert told == {1: True, 2: True, 3: False}


def test_overlap_marks_do_not_depend_on_the_parts(spark):
    rows = [source_rows()[0]] * 9 + [source_rows()[1]] * 2 + source_rows()
    raw = raw_frame(spark, rows)
    both = raw.unionByName(
        raw.limit(6).withColumns({SCHEMA.sheet: F.lit("z"), SCHEMA.order: F.concat(F.lit("z:"), F.col(SCHEMA.order))})
        if dict(raw.dtypes)[SCHEMA.order] == "string"
        else raw.limit(6).withColumn(SCHEMA.sheet, F.lit("z"))
    )
    marks = [
        sorted(
            (r[SCHEMA.sheet], str(r[SCHEMA.order]), r["overlap_copy"])
            for r in cleaning.mark_overlap_copies(both, SCHEMA, hot_rows=hot).collect()
        )
        for hot in (None, 2)
    ]
    assert marks[0] == marks[1] and sum(m[2] for m in marks[0]) > 0
