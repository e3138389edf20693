"""Cleaning with quarantine: every source line ends up either accepted or quarantined."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillspark.functions.columns import (
    clean_id,
    clean_text,
    count_if,
    flag,
    is_nonfinite,
    number,
    same,
    timestamp,
    without_suffix,
)
from tillspark.operators.joinback import join_back
from tillspark.operators.ordered import ROWS_PER_BUCKET, keep, row_numbers
from tillspark.operators.repeats import listed, split
from tillspark.schema import COLUMN_MAP, UNKNOWN, SourceSchema
from tillspark.sources.workspace import materialize, new_folder

# Rule labels in the order in which they appear in a reason string.
RULES = [
    "overlapping_sheet_copy",
    "missing_required",
    "invalid_numeric",
    "negative_price",
    "fractional_quantity",
    "invalid_date",
]


def mark_overlap_copies(
    raw: DataFrame,
    schema: SourceSchema,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    hot_rows: int | None = None,
    list_rows: int | None = None,
) -> DataFrame:
    """Add `overlap_copy`: surplus copies of a raw line which an earlier sheet already holds.

    The n-th copy inside a sheet is surplus when an earlier sheet has at least n copies, so the
    greatest multiplicity of any sheet survives. Sheets count in the order of their names.

    Counting comes first, by the hash of a line, and only lines whose hash is seen in two sheets are
    looked at again; the others are not moved. Positions inside a sheet are needed just where a sheet holds more copies
    than all earlier ones; there the last surplus copy is found with bucketed numbering, and what is
    known of a line meets its copies in as many parts as there are `hot_rows` of them. So one line
    copied a billion times does not become one task.
    """
    keys, sheet, order = list(schema.required), schema.sheet, schema.order
    # sheets are compared by 64-bit hash here: a text buffer would force a sort-based aggregate
    rest, suspects = split(raw, keys, F.xxhash64(sheet), list_rows)
    none = None if rest is None else rest.withColumn("overlap_copy", F.lit(False))
    if suspects is None:
        return none
    if none is not None:
        suspects = materialize(suspects, new_folder(raw.sparkSession, "suspects"))
    marked = _mark_suspects(suspects, keys, sheet, order, rows_per_bucket, hot_rows)
    return marked if none is None else none.unionByName(marked)


def _mark_suspects(
    raw: DataFrame,
    keys: list[str],
    sheet: str,
    order: str,
    rows_per_bucket: int,
    hot_rows: int | None,
) -> DataFrame:
    """`mark_overlap_copies` by the lines themselves; a line comes with all its copies."""
    earlier = W.partitionBy(*keys).orderBy(sheet).rowsBetween(W.unboundedPreceding, -1)
    per_sheet = keep(
        raw.groupBy(*keys, sheet)
        .agg(F.count(F.lit(1)).alias("_here"))
        .withColumn("_before", F.max("_here").over(earlier))
        .where(F.col("_before").isNotNull())
    )
    partly = per_sheet.where(F.col("_before") < F.col("_here")).select(
        *[F.col(c).alias(f"_p_{c}") for c in [*keys, sheet]],
        F.col("_before").alias("_keep_after"),
        F.col("_here").alias("_size"),
    )
    in_sheet = {c: f"_p_{c}" for c in [*keys, sheet]}
    numbered = row_numbers(
        keep(
            join_back(raw, partly, in_sheet, "_size", "inner", hot_rows).select(
                *keys, sheet, order, "_keep_after"
            )
        ),
        [F.col(order)],
        "_nth",
        [*keys, sheet],
        rows_per_bucket,
    )
    last_surplus = numbered.where(F.col("_nth") == F.col("_keep_after")).select(
        *[F.col(c).alias(f"_l_{c}") for c in [*keys, sheet]], F.col(order).alias("_last_surplus")
    )
    groups = per_sheet.join(
        last_surplus, same(per_sheet, last_surplus, {c: f"_l_{c}" for c in [*keys, sheet]}), "left"
    ).select(
        *[F.col(c).alias(f"_g_{c}") for c in [*keys, sheet]],
        (F.col("_before") >= F.col("_here")).alias("_all"),
        "_last_surplus",
        F.col("_here").alias("_size"),
    )
    back = {c: f"_g_{c}" for c in [*keys, sheet]}
    return join_back(raw, groups, back, "_size", "left", hot_rows).select(
        raw["*"],
        F.coalesce(F.col("_all") | (F.col(order) <= F.col("_last_surplus")), F.lit(False)).alias(
            "overlap_copy"
        ),
    )


def _nan_as_null(raw: DataFrame) -> DataFrame:
    for name, kind in raw.dtypes:
        if kind in ("double", "float"):  # NaN and NULL are one missing value
            raw = raw.withColumn(name, F.when(~F.isnan(name), F.col(name)))
    return raw


def _parsed(schema: SourceSchema) -> dict[str, Column]:
    """The source columns as cleaning leaves them, from those of the same names."""
    return {
        **{c: F.nullif(clean_text(F.col(c)), F.lit("")) for c in schema.text},
        **{c: number(F.col(c)) for c in schema.numeric},
        schema.date: timestamp(F.col(schema.date)),
        "Customer ID": F.col("Customer ID").cast("string"),
    }


def _filled(description: Column, customer: Column) -> dict[str, Column]:
    """UNKNOWN members of accepted lines."""
    return {
        "Description": F.coalesce(description, F.lit(UNKNOWN)),
        # only NULL becomes UNKNOWN: a blank id stays a blank id
        "Customer ID": F.coalesce(clean_id(customer), F.lit(UNKNOWN)),
    }


def flag_lines(
    raw: DataFrame, schema: SourceSchema, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Normalise the source columns and add `reasons` and `quarantine_reason` to every line.

    Rules overlap, so a line can carry several reasons. `text_corrected` tells which text
    columns changed. Downstream steps read this frame repeatedly: write or persist it.
    """
    return _flagged(mark_overlap_copies(_nan_as_null(raw), schema, rows_per_bucket), schema)


def _flagged(
    marked: DataFrame, schema: SourceSchema, new: dict[str, Column] | None = None
) -> DataFrame:
    """`flag_lines` of lines with their `overlap_copy`, each on its own; `new` holds what is parsed already."""
    new = _parsed(schema) if new is None else new
    changed = [
        (F.coalesce(new[c], F.lit("")) != F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c)
        for c in schema.text
    ]
    parsed = marked.withColumn("text_corrected", F.struct(*changed)).withColumns(new)
    quantity, price, moment = F.col("Quantity"), F.col("Price"), F.col(schema.date)
    missing = F.lit(False)
    for c in schema.not_null:
        missing = missing | F.col(c).isNull()
    low, high = timestamp(F.lit(schema.date_min)), timestamp(F.lit(schema.date_max))
    hits: dict[str, Column] = {
        "overlapping_sheet_copy": F.col("overlap_copy"),
        "missing_required": missing,
        "invalid_numeric": is_nonfinite(quantity) | is_nonfinite(price),
        "negative_price": F.coalesce(price < 0, F.lit(False)),
        # a missing or infinite quantity has no whole value either
        "fractional_quantity": F.coalesce(quantity % 1 != 0, F.lit(True)),
        "invalid_date": F.coalesce(~moment.between(low, high), F.lit(True)),
    }
    text = F.concat(*[F.when(hits[r], F.lit(r + ";")).otherwise("") for r in RULES])
    # a filter is interpreted, not compiled: only lines with a reason meet it
    listed_reasons = F.filter(
        F.array(*[F.when(hits[r], F.lit(r)) for r in RULES]), lambda r: r.isNotNull()
    )
    reasons = F.when(text != "", listed_reasons).otherwise(F.array().cast("array<string>"))
    return parsed.withColumns({"reasons": reasons, "quarantine_reason": text}).drop("overlap_copy")


def quarantined(flagged: DataFrame) -> DataFrame:
    """Lines with at least one reason; nothing is dropped."""
    return flagged.where(F.col("quarantine_reason") != "").drop("text_corrected")


def accepted(flagged: DataFrame, schema: SourceSchema) -> DataFrame:
    """Lines without a reason, with UNKNOWN members and the three line flags."""
    return _line_flags(mark_repeats(_accepted(flagged), list(schema.required)))


def _accepted(flagged: DataFrame) -> DataFrame:
    """Lines without a reason, with UNKNOWN members; each on its own."""
    return (
        flagged.where(F.col("quarantine_reason") == "")
        .drop("quarantine_reason", "reasons", "text_corrected")
        .withColumns(_filled(F.col("Description"), F.col("Customer ID")))
    )


def _line_flags(told: DataFrame) -> DataFrame:
    cancelled = F.upper("Invoice").startswith("C")
    return told.withColumns(
        {
            "is_cancellation": cancelled,
            "is_adjustment": (F.col("Quantity") < 0) & ~cancelled,
        }
    )


def clean_lines(
    raw: DataFrame,
    schema: SourceSchema,
    list_rows: int | None = None,
    write: Callable[[DataFrame], DataFrame] = lambda flagged: flagged,
) -> tuple[DataFrame, DataFrame]:
    """`flag_lines` of `raw` and `accepted` of that; only lines which may have an equal are written.

    Hashes are counted once, of the keys as accepted lines have them. Raw lines which are equal are
    equal then too, so a line whose hash is its own is neither a surplus copy nor repeated, and all it
    takes is said line by line on every read, from what `write` makes of the flagged ones. The others, which
    come with all their equals, go through both operators; they are written as they came, by the same pass.

    Columns are parsed once for hash and flags: parsed again behind the join they made one generated method
    of over 8,000 bytes, which the JVM never compiles.
    """
    raw = _nan_as_null(raw)
    at = {c: f"_parsed_{c}" for c in _parsed(schema)}
    parsed = raw.withColumns({at[c]: new for c, new in _parsed(schema).items()})
    filled = _filled(F.col(at["Description"]), F.col(at["Customer ID"]))
    keyed = parsed.withColumns({f"_filled_{c}": new for c, new in filled.items()})
    keys = [f"_filled_{c}" if c in filled else at.get(c, c) for c in schema.required]
    helpers = [*at.values(), *[f"_filled_{c}" for c in filled]]

    def told(lines: DataFrame) -> DataFrame:
        unmarked = lines.withColumn("overlap_copy", F.lit(False))
        return _flagged(unmarked, schema, {c: F.col(name) for c, name in at.items()}).drop(*helpers)

    few, match = listed(keyed, keys, None, list_rows)
    flagged, kept, rest = [], [], None
    if few is False:
        alone = write(told(keyed))
    elif few is True:
        alone, rest = None, raw
    else:
        shared, came = F.col("_is_shared").isNotNull(), [f"`{c}`" for c in schema.required]
        found = keyed.join(F.broadcast(few.withColumn("_is_shared", F.lit(True))), match, "left")
        both = told(found.withColumn("_came", F.when(shared, F.struct(*came))).drop(*few.columns))
        same_as_raw = [c for c in raw.columns if c not in schema.required]
        both = write(
            both.select(
                *[
                    c if c in same_as_raw else F.when(~shared, F.col(f"`{c}`")).alias(c)
                    for c in both.columns
                    if c not in ("_is_shared", "_came")
                ],
                shared.alias("_is_shared"),
                "_came",
            )
        )
        alone = both.where(~F.col("_is_shared")).drop("_is_shared", "_came")
        rest = both.where("_is_shared").select(
            *[c if c in same_as_raw else f"_came.`{c}`" for c in raw.columns]
        )
        rest = materialize(rest, new_folder(raw.sparkSession, "equal"))
    if alone is not None:
        flagged.append(alone)
        kept.append(_line_flags(_accepted(alone).withColumn("ambiguous_duplicate", F.lit(False))))
    if rest is not None:
        marked = materialize(flag_lines(rest, schema), new_folder(raw.sparkSession, "marked"))
        flagged.append(marked)
        kept.append(accepted(marked, schema))
    return reduce(DataFrame.unionByName, flagged), reduce(DataFrame.unionByName, kept)


def mark_repeats(
    df: DataFrame,
    keys: list[str],
    name: str = "ambiguous_duplicate",
    hot_rows: int | None = None,
    list_rows: int | None = None,
) -> DataFrame:
    """True on every row which shares all key values with another row.

    Rows whose hash is theirs alone are not moved. The keys of the others are counted (map-side combine)
    and joined back in parts of `hot_rows` rows, so a heavily repeated row is gathered in no task,
    neither of a window nor of a join.
    """
    once, rest = split(df, keys, None, list_rows)
    first = None if once is None else once.withColumn(name, F.lit(False))
    if rest is None:
        return first
    if first is not None:
        rest = materialize(rest, new_folder(df.sparkSession, "repeats"))
    repeated = (
        rest.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_n", F.lit(True).alias("_repeat"))
    )
    told = join_back(rest, repeated, {k: f"_r_{k}" for k in keys}, "_n", "left", hot_rows).select(
        rest["*"], F.coalesce("_repeat", F.lit(False)).alias(name)
    )
    return told if first is None else first.unionByName(told)


def cleaning_log(flagged: DataFrame, lines: DataFrame, schema: SourceSchema) -> DataFrame:
    """One row of totals: rows, hits per rule, corrected texts, unknown members.

    `flagged` is the output of `flag_lines`, `lines` that of `accepted`.
    """
    kept = F.col("quarantine_reason") == ""
    first = flagged.agg(
        F.count(F.lit(1)).alias("original_rows"),
        count_if(kept).alias("accepted_rows"),
        count_if(~kept).alias("quarantined_rows"),
        F.lit(0).cast("bigint").alias("removed_rows"),
        *[count_if(F.array_contains("reasons", r)).alias(f"reason_{r}") for r in RULES],
        *[
            count_if(F.col(f"text_corrected.{c}")).alias(f"corrected_{COLUMN_MAP[c]}")
            for c in schema.text
        ],
        count_if(kept & (F.col("Customer ID").isNull() | (clean_id(F.col("Customer ID")) == UNKNOWN)))
        .alias("unknown_customers"),
        count_if(kept & (F.coalesce("Description", F.lit(UNKNOWN)) == UNKNOWN)).alias(
            "unknown_descriptions"
        ),
    )
    second = lines.agg(
        count_if(F.col("ambiguous_duplicate")).alias("ambiguous_duplicate_rows_retained")
    )
    return first.withColumn(
        "ambiguous_duplicate_rows_retained",
        second.scalar(),
    )


def reconcile_rows(source: DataFrame, flagged: DataFrame) -> DataFrame:
    """Accepted + quarantined must equal the input; returns the counts and the verdict."""
    kept = F.col("quarantine_reason") == ""
    return flagged.agg(
        count_if(kept).alias("accepted_rows"), count_if(~kept).alias("quarantined_rows")
    ).withColumn(
        "source_rows", source.agg(F.count(F.lit(1))).scalar()
    ).withColumn(
        "reconciled",
        flag(F.col("accepted_rows") + F.col("quarantined_rows") == F.col("source_rows")),
    )


def standardize(lines: DataFrame, cleaned: bool = False) -> DataFrame:
    """Snake-case names, text ids, whole quantities, double prices, zone-free timestamps.

    `cleaned` tells that texts are as `accepted` leaves them: blanks need no second look then, save those
    which a suffix leaves behind.
    """
    renamed = lines.withColumnsRenamed(COLUMN_MAP)
    text = F.trim if cleaned else clean_text
    return renamed.withColumns(
        {
            **{
                c: without_suffix(text(F.col(c))) for c in ["invoice_id", "product_id", "customer_id"]
            },
            **{c: text(F.col(c)) for c in ["country", "description"]},
            "quantity": F.col("quantity").cast("bigint"),
            "unit_price": F.col("unit_price").cast("double"),
            "invoice_date": F.col("invoice_date").cast("timestamp_ntz"),
        }
    )
