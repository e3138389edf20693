import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tests.data import FIRST, SCHEMA, UK, as_dict, raw_frame, source_rows
from tillspark.operators import checks, cleaning


@pytest.fixture(scope="module")
def flagged(spark):
    return cleaning.flag_lines(raw_frame(spark, source_rows()), SCHEMA).cache()


def test_negative_price_is_quarantined_and_cancellation_kept(flagged):
    accepted = {r["Invoice"]: r for r in cleaning.accepted(flagged, SCHEMA).collect()}
    assert cleaning.accepted(flagged, SCHEMA).count() == 5
    [bad] = cleaning.quarantined(flagged).collect()
    assert bad["quarantine_reason"] == "negative_price;"
    assert bad["reasons"] == ["negative_price"]
    assert accepted["C101"]["is_cancellation"] and not accepted["C101"]["is_adjustment"]


def test_ids_text_and_unknown_members(flagged):
    rows = {r["line_id"]: r for r in cleaning.accepted(flagged, SCHEMA).collect()}
    assert rows["test:2"]["Description"] == "First item"
    assert rows["test:2"]["Customer ID"] == "00001"
    assert rows["test:5"]["Description"] == "UNKNOWN" == rows["test:5"]["Customer ID"]


def test_log_adds_up(flagged):
    log = as_dict(cleaning.cleaning_log(flagged, cleaning.accepted(flagged, SCHEMA), SCHEMA))
    assert (log["original_rows"], log["accepted_rows"], log["quarantined_rows"]) == (6, 5, 1)
    assert log["corrected_description"] == 1
    assert log["unknown_customers"] == log["unknown_descriptions"] == 1


def test_suffix_blank_customer_and_unicode_space(spark):
    rows = [
        ("1.0", "00 1", "a \tb", 1.0, FIRST, 1.0, "00012.0", UK),
        ("2", "2", " ", 1.0, FIRST, 1.0, " ", UK),
    ]
    lines = cleaning.standardize(
        cleaning.accepted(cleaning.flag_lines(raw_frame(spark, rows), SCHEMA), SCHEMA)
    )
    a, b = lines.orderBy("line_id").collect()
    assert (a["invoice_id"], a["product_id"], a["customer_id"]) == ("1", "00 1", "00012")
    assert a["description"] == "a b"
    assert (b["customer_id"], b["description"]) == ("", "UNKNOWN")


def test_repeats_inside_a_sheet_stay_and_are_marked(spark):
    rows = [source_rows()[0]] * 2 + [source_rows()[1]]
    kept = cleaning.accepted(cleaning.flag_lines(raw_frame(spark, rows), SCHEMA), SCHEMA)
    assert [r["ambiguous_duplicate"] for r in kept.orderBy("line_id").collect()] == [True, True, False]


def test_two_and_three_copies_leave_three(spark):
    rows = [source_rows()[0]] * 5
    flagged = cleaning.flag_lines(raw_frame(spark, rows, ["a", "a", "b", "b", "b"]), SCHEMA)
    lost = cleaning.quarantined(flagged).orderBy("line_id").collect()
    assert [r["line_id"] for r in lost] == ["b:4", "b:5"]
    assert {r["quarantine_reason"] for r in lost} == {"overlapping_sheet_copy;"}


def test_several_reasons_in_order(spark):
    rows = [
        ("1", " ", "x", 1.5, FIRST, 1.0, None, UK),
        ("2", "2", "x", None, FIRST, float("nan"), None, UK),
        ("3", "3", "x", float("inf"), None, -1.0, None, None),
    ]
    text = [
        r["quarantine_reason"]
        for r in cleaning.flag_lines(raw_frame(spark, rows), SCHEMA).orderBy("line_id").collect()
    ]
    assert text == [
        "missing_required;fractional_quantity;",
        "missing_required;invalid_numeric;fractional_quantity;",
        "missing_required;invalid_numeric;negative_price;fractional_quantity;invalid_date;",
    ]


def test_unparsable_text_is_quarantined_not_fatal(spark):
    raw = raw_frame(spark, source_rows()[:2]).withColumns(
        {
            "InvoiceDate": F.when(F.col("StockCode") == "001", "broken").otherwise("2010-01-01 10:00"),
            "Quantity": F.when(F.col("StockCode") == "002", "many").otherwise("2"),
        }
    )
    reasons = {
        r["StockCode"]: r["quarantine_reason"] for r in cleaning.flag_lines(raw, SCHEMA).collect()
    }
    assert reasons["001"] == "missing_required;invalid_date;"
    assert reasons["002"] == "missing_required;invalid_numeric;fractional_quantity;"


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 40])
def test_overlap_equals_plain_windows_with_a_hot_line(spark, rows_per_bucket):
    """One line makes up a third of all rows; three sheets hold different numbers of copies."""
    rng = random.Random(5)
    rows, sheets = [], []
    for i in range(600):
        code = "hot" if i % 3 == 0 else f"p{rng.randrange(40)}"
        rows.append(("1", code, None, 1.0, FIRST, 1.0, None, UK))
        sheets.append(rng.choices(["s1", "s2", "s3"], [1, 3, 5])[0])
    raw = raw_frame(spark, rows, sheets)
    got = cleaning.mark_overlap_copies(raw, SCHEMA, rows_per_bucket).where("overlap_copy")
    keys = list(SCHEMA.required)
    occ = F.row_number().over(W.partitionBy("source_sheet", *keys).orderBy("source_row"))
    place = F.row_number().over(W.partitionBy(*keys, "occ").orderBy("source_sheet", "source_row"))
    want = raw.withColumn("occ", occ).withColumn("place", place).where("place > 1")
    assert {r["line_id"] for r in got.collect()} == {r["line_id"] for r in want.collect()}


def test_reconciliation(spark, flagged):
    found = as_dict(cleaning.reconcile_rows(raw_frame(spark, source_rows()), flagged))
    assert found["reconciled"] == 1 and found["accepted_rows"] == 5


def test_validation_counts_per_part(spark):
    raw = raw_frame(spark, source_rows(), ["a"] * 3 + ["b"] * 3)
    found = {
        (r["source_sheet"], r["metric"]): r["value"]
        for r in checks.validate_source(raw, SCHEMA, ["source_sheet"]).collect()
    }
    assert found["a", "rows"] == found["b", "rows"] == 3
    assert found["b", "negative_price"] == 1 and found["a", "negative_price"] == 0
    assert found["b", "fractional_quantity"] == 0


def test_validation_blocks(spark):
    raw = raw_frame(spark, source_rows())
    with pytest.raises(checks.CheckFailed):
        checks.validate_source(raw.drop("Price"), SCHEMA)
    with pytest.raises(checks.CheckFailed):
        checks.validate_source(raw.limit(0), SCHEMA)
    with pytest.raises(checks.CheckFailed):
        checks.require_lineage(raw.unionByName(raw), SCHEMA)
    checks.require_lineage(raw, SCHEMA)


def test_all_parts_are_reported_before_the_stop(spark):
    raw = raw_frame(spark, source_rows())
    parts = {
        "good": raw,
        "empty and narrow": raw.drop("Price", "Country").limit(0),
        "without key": raw.drop(SCHEMA.key),
    }
    report = checks.part_report(parts, SCHEMA)
    got = {r["part"]: r["blocking"] for r in report.collect()}
    assert got["empty and narrow"] == "missing columns: Country, Price; no rows"
    assert got["without key"] == f"missing columns: {SCHEMA.key}" and got["good"] == ""
    checks.require_parts(report.where("part = 'good'"))
    with pytest.raises(checks.CheckFailed, match="empty and narrow.*without key"):
        checks.require_parts(report)
    with pytest.raises(checks.CheckFailed):
        checks.part_report({}, SCHEMA)


@pytest.mark.parametrize("list_rows", [None, 0])
def test_clean_lines_is_flag_then_accept(spark, list_rows):
    """Equal as raw lines, equal only once cleaned, equal but for a rejected copy, and lines with no equal."""
    first, second, third = source_rows()[:3]
    spaced = (*first[:2], "First item", *first[3:])
    bad = source_rows()[5]
    nan = (*second[:3], float("nan"), *second[4:])
    rows = [first, first, first, spaced, second, third, third, bad, bad, nan, nan]
    sheets = ["a", "b", "b", "b", "a", "a", "a", "a", "b", "a", "a"]
    raw = raw_frame(spark, rows, sheets).withColumn("src", F.struct("line_id"))
    flagged, lines = cleaning.clean_lines(raw, SCHEMA, list_rows)
    want = cleaning.flag_lines(raw, SCHEMA)
    assert flagged.columns == want.columns and sorted(map(str, flagged.collect())) == sorted(map(str, want.collect()))
    want = cleaning.accepted(want, SCHEMA)
    assert lines.columns == want.columns and sorted(map(str, lines.collect())) == sorted(map(str, want.collect()))
    assert lines.where("ambiguous_duplicate").count() == 5


def test_lines_without_an_equal_are_neither_moved_nor_written(spark):
    raw = raw_frame(spark, source_rows())
    for df in cleaning.clean_lines(raw, SCHEMA):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and "parquet" not in plan


def test_cleaned_texts_need_no_second_look(spark):
    odd = ["5 .0", "5.0.0", ".0", "7 .0.0 ", "a\u00a0\u2003b", "\n", "x.0\n", "1.0a", "é.0", "0", None, "\u3000.0"]
    first = source_rows()[0]
    rows = [(a, b, a, *first[3:6], b, UK) for a in odd for b in odd]
    kept = cleaning.accepted(cleaning.flag_lines(raw_frame(spark, rows), SCHEMA), SCHEMA).cache()
    got, want = cleaning.standardize(kept, cleaned=True), cleaning.standardize(kept)
    plain = lambda c: F.regexp_replace(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), r"\.0$", "")
    ids = {"invoice_id": "Invoice", "product_id": "StockCode", "customer_id": "Customer ID"}
    told = kept.select("line_id", *[plain(F.col(f"`{c}`")).alias(name) for name, c in ids.items()])
    assert got.columns == want.columns and got.count() == 100
    assert got.exceptAll(want).isEmpty() and got.select(told.columns).exceptAll(told).isEmpty()
