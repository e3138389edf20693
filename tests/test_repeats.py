"""Repeated keys found by hash: single rows are not moved, and neither a collision nor a long list changes a result."""

import pytest
from pyspark.sql import functions as F

from fixtures.retail_lines import LINE, numbered_lines
from tests.data import SCHEMA, raw_frame, source_rows
from tillspark.operators import checks, cleaning, profile, repeats
from tillspark.plans import questions
from tillspark.schema import STAR_SCHEMAS


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(params=["hash", "collisions", "long list"])
def how(request, monkeypatch):
    """As it is, with two hashes for all keys, and with no list sent to the tasks."""
    if request.param == "collisions":
        whole = repeats.key_hash
        few = lambda keys: F.pmod(whole(keys), F.lit(2).cast("bigint"))
        monkeypatch.setattr(repeats, "key_hash", few)
        monkeypatch.setattr(checks, "key_hash", few)
    if request.param == "long list":
        monkeypatch.setattr(repeats, "LIST_ROWS", 0)
    return request.param


@pytest.fixture
def rows(spark):
    pairs = [(1, "a"), (2, "a"), (3, None), (4, None), (5, "b"), (6, "c"), (7, "d")]
    return spark.createDataFrame(pairs, "id long, k string")


def test_single_rows_are_not_moved(spark):
    unique = spark.range(1000).selectExpr("id", "CAST(id AS STRING) AS k")
    assert "Join" not in _plan(cleaning.mark_repeats(unique, ["k"]))
    raw = raw_frame(spark, source_rows())
    marked = cleaning.mark_overlap_copies(raw, SCHEMA)
    assert "Join" not in _plan(marked) and "Aggregate" not in _plan(marked)
    assert "Generate" not in _plan(profile.missing_summary(unique))


def test_marks_and_counts(spark, rows, how):
    marks = {r["id"]: r["again"] for r in cleaning.mark_repeats(rows, ["k"], "again").collect()}
    assert marks == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False}
    assert profile.near_repeats(rows, ["k"]).first()[0] == 4
    assert checks.key_violations(rows, "k").first().asDict() == {"null_keys": 2, "repeated_keys": 2}
    assert checks.key_violations(rows, "id").first().asDict() == {"null_keys": 0, "repeated_keys": 0}
    assert tuple(profile.duplicate_summary(rows, ["k"], "k", "id").first()) == (7, 2, 2, 0)
    found = {r["column"]: tuple(r)[1:4] for r in profile.missing_summary(rows).collect()}
    assert found == {"id": (0, 0.0, 7), "k": (2, 200 / 7, 4)}
    assert profile.missing_summary(rows.where("false")).count() == 0
    assert profile.near_repeats(rows.where("false"), ["k"]).first()[0] == 0


def test_counted_and_plain_summaries_agree(spark, rows, how):
    many = rows.select("id", "k", (F.col("id") % 2 - 0.5).alias("x"), F.lit(None).cast("string").alias("none"))
    plain = profile.missing_summary(many)
    counted = profile.missing_summary(many, profile.value_counts(many))
    assert plain.dtypes == counted.dtypes
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, counted.collect()))


def test_overlap_copies(spark, how):
    first = source_rows()[0]
    rows = [first, first, first, first, first, source_rows()[1], source_rows()[1]]
    raw = raw_frame(spark, rows, ["a", "a", "b", "b", "b", "a", "a"])
    surplus = cleaning.mark_overlap_copies(raw, SCHEMA).where("overlap_copy")
    assert sorted(r["line_id"] for r in surplus.collect()) == ["b:4", "b:5"]


def test_parts_with_repeated_keys(spark, how):
    raw = raw_frame(spark, source_rows())
    lost = raw.withColumn("line_id", F.when(F.col("source_row") > 2, F.col("line_id")))
    report = checks.part_report(
        {"whole": raw, "twice": raw.unionByName(raw), "lost": lost, "none": raw.where("false")}, SCHEMA
    )
    n = len(source_rows())
    assert {r["part"]: (r["rows"], r["blocking"]) for r in report.collect()} == {
        "whole": (n, ""),
        "twice": (2 * n, "line_id is not a key"),
        "lost": (n, "line_id is not a key"),
        "none": (0, "no rows"),
    }


def test_copies_of_lines_are_numbered(spark, how):
    one = spark.range(1).select(*[F.lit(1).alias(c) for c in LINE])
    lines = one.unionAll(one).unionAll(one).unionAll(one.withColumn("l_orderkey", F.lit(2)))
    lines = lines.unionAll(one.withColumn("l_orderkey", F.lit(None).cast("int")))
    got = sorted((str(r["l_orderkey"]), r["rn"]) for r in numbered_lines(lines).collect())
    assert got == [("1", 1), ("1", 2), ("1", 3), ("2", 1), ("None", 1)]
    assert numbered_lines(lines.where("false")).count() == 0


def test_long_lists_do_not_move_single_rows(spark):
    """More shared hashes than the list may hold: a filter of fixed size still leaves single rows where they are."""
    rows = spark.range(6000).selectExpr("id", "CAST(IF(id < 1000, id DIV 2, id) AS STRING) AS k")
    once, rest = repeats.split(rows, ["k"], None, 100)
    assert once is not None and once.unionAll(rest).exceptAll(rows).isEmpty()
    found = {r["id"] for r in rest.collect()}
    assert found >= set(range(1000)) and len(found) < 1100 and once.count() + len(found) == 6000
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(k" not in plan
    marked = cleaning.mark_repeats(rows, ["k"], "again", list_rows=100)
    assert marked.where("again = (id < 1000)").count() == 6000


def test_a_full_filter_compares_all_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(repeats, "FILTER_BITS", 2)
    once, rest = repeats.split(rows, ["k"], None, 0)
    assert once is None and rest.count() == 7
    assert cleaning.mark_repeats(rows, ["k"], "again", list_rows=0).where("again").count() == 4


def test_every_bit_of_a_word(spark):
    """Bits 0 to 63, the sign bit too: hashes in one word are told apart."""
    every = spark.range(128).selectExpr("id AS _shared")
    words = {r["_word"]: r["_bits"] for r in repeats.filter_words(every.where("_shared % 64 IN (0, 63)")).collect()}
    assert words == {0: -(2**63) + 1, 1: -(2**63) + 1}


def test_duplicate_sensitivity_moves_repeated_lines_only(spark, how):
    def facts(*lines):
        named = "invoice_id string, customer_id string, unit_price double, gross_sales double"
        held = spark.createDataFrame(lines, named)
        rest = [f for f in STAR_SCHEMAS["fact_sales"] if f.name not in held.columns]
        return {"fact_sales": held.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest])}

    twice = [("1", "a", 2.0, 2.0), ("1", "a", 2.0, 2.0), ("1", "a", 2.0, 3.0), (None, None, 0.0, 1.5), (None, None, -0.0, 1.5)]
    single = [("2", "a", 2.0, 2.0), ("3", None, 4.0, None), ("4", "b", None, 0.25)]
    ask = lambda *lines: tuple(questions.duplicate_sensitivity(facts(*lines)).first())
    assert ask(*twice, *single) == (6 + 3 + 2.25, 2 + 1.5 + 2.25, 4 + 1.5)
    assert ask(*twice) == (9.0, 3.5, 5.5)
    assert ask(*single) == (2.25, 2.25, 0.0)
    if how == "hash":
        assert "Aggregate [invoice_id" not in _plan(questions.duplicate_sensitivity(facts(*single)))
