"""Retail source lines shaped from the order tables, in Spark and in DuckDB SQL.

Both engines use the same text; only the numbering of identical copies differs, where Spark
counts copies instead of sorting them in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillspark.operators.repeats import LIST_ROWS, split
from tillspark.schema import COLUMN_MAP, SourceSchema

SCHEMA = SourceSchema(date_min="1995-01-02 00:00:00", date_max="2001-07-31 23:59:59")
CONTRAST_COUNTRY = "NATION_0"
TABLES = ["lineitem", "orders", "customer", "part", "nation"]
LINE = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]
COPIES_PER_CHUNK = 100_000

NUMBERED_DUCKDB = f"""
SELECT *, ROW_NUMBER() OVER (PARTITION BY {", ".join(LINE)} ORDER BY l_orderkey) AS rn
FROM lineitem"""

# What names a source line inside its sheet.
SRC_KEY = """\
CONCAT(CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING), ':',
                CAST(l_partkey AS STRING), ':', CAST(l_suppkey AS STRING), ':',
                CAST(CAST(FLOOR(l_quantity * 10) AS BIGINT) AS STRING), ':',
                CAST(CAST(FLOOR(l_extendedprice * 100) AS BIGINT) AS STRING), ':',
                CAST(CAST(FLOOR(l_discount * 1000 + 0.5) AS BIGINT) AS STRING), ':',
                CAST(CAST(FLOOR(l_tax * 1000 + 0.5) AS BIGINT) AS STRING), ':',
                l_returnflag, l_linestatus, ':',
                CAST(CAST(l_shipdate AS DATE) AS STRING), ':', CAST(rn AS STRING))"""

# What a source line says, over lines which have met their order, customer, part and nation.
SAID = f"""\
  SELECT CONCAT(CASE WHEN l_returnflag = 'R' AND l_orderkey % 5 = 0 THEN 'C' ELSE '' END,
                CAST(l_orderkey AS STRING)) AS invoice,
         CASE WHEN l_partkey % 997 = 3 THEN ' '
              WHEN l_partkey % 50 = 0 THEN CONCAT(LPAD(CAST(l_partkey AS STRING), 6, '0'), 'a')
              WHEN l_partkey % 50 = 1 THEN CONCAT(LPAD(CAST(l_partkey - 1 AS STRING), 6, '0'), 'A')
              ELSE LPAD(CAST(l_partkey AS STRING), 6, '0') END AS stock_code,
         CASE WHEN l_partkey % 150 = 0 THEN NULL
              WHEN l_partkey % 4 = 0 THEN CONCAT('  ', p_brand, '   ', p_name, ' ')
              ELSE CONCAT(p_brand, ' ', p_name) END AS description,
         CASE WHEN l_returnflag = 'R' AND l_orderkey % 5 = 0 AND l_orderkey % 400 <> 0 THEN -l_quantity
              WHEN l_orderkey % 333 = 0 THEN -l_quantity
              WHEN l_orderkey % 1009 = 0 THEN l_quantity + 0.5
              ELSE l_quantity END AS quantity,
         o_orderdate + CAST(l_orderkey % 24 AS INT) * INTERVAL '1' HOUR AS invoice_date,
         CASE WHEN l_partkey % 1500 = 11 THEN NULL
              WHEN l_partkey % 199 = 0 THEN 0.0
              WHEN l_partkey % 499 = 7 THEN -1.0 * FLOOR(l_extendedprice * 100 / l_quantity) / 100
              ELSE FLOOR(l_extendedprice * 100 / l_quantity) / 100 END AS price,
         CASE WHEN o_custkey % 5 = 0 THEN NULL
              WHEN o_custkey % 7 = 0 THEN CONCAT(CAST(o_custkey AS STRING), '.0')
              ELSE CAST(o_custkey AS STRING) END AS customer,
         n_name AS country,
         {SRC_KEY} AS src_key,
         l_orderkey
"""

SHAPED = f"""
WITH base AS (
  SELECT l.*, o.o_custkey, o.o_orderdate, c.c_nationkey
  FROM numbered l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey
), shaped AS (
{SAID}  FROM base JOIN part ON l_partkey = p_partkey
  JOIN nation ON n_nationkey = (CASE WHEN l_orderkey % 101 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END)
), sheeted AS (
  SELECT 'sheet_1' AS source_sheet, 0 AS copy, * FROM shaped WHERE invoice_date <  TIMESTAMP '1998-03-10 00:00:00'
  UNION ALL
  SELECT 'sheet_2', 0, * FROM shaped WHERE invoice_date >= TIMESTAMP '1998-03-01 00:00:00'
  UNION ALL
  SELECT 'sheet_2', 1, * FROM shaped WHERE invoice_date >= TIMESTAMP '1998-03-01 00:00:00' AND l_orderkey % 97 = 0
)
SELECT CONCAT(source_sheet, ':', src_key, ':', CAST(copy AS STRING)) AS line_id, * FROM sheeted
"""

# The sheets of a line, as the end of SHAPED has them: (sheet, copy, condition).
SHEETS = [
    ("sheet_1", 0, "invoice_date < TIMESTAMP '1998-03-10 00:00:00'"),
    ("sheet_2", 0, "invoice_date >= TIMESTAMP '1998-03-01 00:00:00'"),
    ("sheet_2", 1, "invoice_date >= TIMESTAMP '1998-03-01 00:00:00' AND l_orderkey % 97 = 0"),
]

def numbered_lines(lineitem: DataFrame, list_rows: int | None = None) -> DataFrame:
    """Lines with a number among identical copies; copies are counted, then spread again.

    Lines without a copy, found by their hash, are not moved.
    """
    once, copied = split(lineitem.select(*LINE), LINE, None, list_rows)
    first = None if once is None else once.withColumn("rn", F.lit(1).cast("bigint"))
    if copied is None:
        return first
    counted = copied.groupBy(*LINE).agg(F.count(F.lit(1)).alias("n"))
    chunks = counted.select(
        *LINE,
        "n",
        F.explode(F.sequence(F.lit(1).cast("bigint"), "n", F.lit(COPIES_PER_CHUNK).cast("bigint")))
        .alias("start"),
    )
    spread = chunks.repartition(*LINE, "start").select(
        *LINE,
        F.explode(
            F.sequence("start", F.least("n", F.col("start") + (COPIES_PER_CHUNK - 1)))
        ).alias("rn"),
    )
    return spread if first is None else first.unionByName(spread)


#: An order with more than this share of all lines is kept out of the shared exchange.
HEAVY_SHARE = 0.001


def heavy_orders(lineitem: DataFrame, share: float = HEAVY_SHARE) -> list[int]:
    """Keys of all orders with more than `share` of the lines; fewer than 1 / share."""
    keys = lineitem.select("l_orderkey")
    maybe = keys.stat.freqItems(["l_orderkey"], share).first()[0]  # none is missed, some are no such orders
    per_order = keys.where(F.col("l_orderkey").isin(maybe)).groupBy("l_orderkey").count()
    return [r[0] for r in per_order.where(F.col("count") > share * keys.count()).collect()]


def narrow(df: DataFrame, list_rows: int | None = None) -> DataFrame:
    """`df`, sent to every task where it has at most `list_rows` rows; else the planner decides."""
    return F.broadcast(df) if df.count() <= (LIST_ROWS if list_rows is None else list_rows) else df


def joined_lines(
    spark: SparkSession, sf_dir: str, list_rows: int | None = None, share: float = HEAVY_SHARE
) -> DataFrame:
    """Numbered lines with what they take from order, customer, part and nation.

    Orders meet their customers first. Lines are then moved once, by their order: copies have the same
    one, so this exchange serves their numbers and the join. Lines of very large orders are
    numbered by `numbered_lines` and meet their few orders where they are.
    """
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    lines = frames.pop("lineitem").select(*LINE).where("l_orderkey IS NOT NULL")
    orders = frames["orders"].select("o_orderkey", "o_custkey", "o_orderdate")
    customers = narrow(frames["customer"].select("c_custkey", "c_nationkey"), list_rows)
    orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    match = F.col("l_orderkey") == F.col("o_orderkey")
    heavy = heavy_orders(lines, share)
    is_heavy = F.col("l_orderkey").isin(heavy)
    copies = W.partitionBy(*LINE).orderBy("l_orderkey")
    ordered = (
        lines.where(~is_heavy)
        .repartition("l_orderkey")
        .withColumn("rn", F.row_number().over(copies).cast("bigint"))
        .join(orders, match)
    )
    if heavy:
        few = narrow(orders.where(F.col("o_orderkey").isin(heavy)), list_rows)
        apart = numbered_lines(lines.where(is_heavy), list_rows).join(few, match)
        ordered = ordered.unionByName(apart)
    parts = narrow(frames["part"].select("p_partkey", "p_brand", "p_name"), list_rows)
    return spark.sql(
        """
        SELECT b.*, p_brand, p_name, n_name
        FROM {ordered} b JOIN {parts} ON l_partkey = p_partkey
        JOIN {nation} ON n_nationkey =
          (CASE WHEN l_orderkey % 101 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END)
        """,
        ordered=ordered,
        parts=parts,
        nation=frames["nation"],
    ).drop("c_nationkey", "p_partkey", "n_nationkey")


def line_id(sheet: str, src_key: str, copy: str) -> Column:
    return F.concat(sheet, F.lit(":"), src_key, F.lit(":"), F.col(copy).cast("string"))


def source_lines(joined: DataFrame, with_src: bool = False) -> DataFrame:
    """The raw frame with declared column names; order inside a sheet is `source_row`.

    Works on `joined_lines` line by line, so its texts need not be written. With `with_src` a line also
    has `src`, the columns which its `line_id` is made of.
    """
    shaped = joined.sparkSession.sql(
        f"{SAID}, STRUCT({', '.join(LINE)}, rn) AS src FROM {{joined}}", joined=joined
    )
    held = F.filter(
        F.array(
            *[
                F.when(F.expr(when), F.struct(F.lit(name).alias("source_sheet"), F.lit(n).alias("copy")))
                for name, n, when in SHEETS
            ]
        ),
        lambda sheet: sheet.isNotNull(),
    )
    sheeted = shaped.select("*", F.inline(held)).withColumn(
        "line_id", line_id("source_sheet", "src_key", "copy")
    )
    raw_names = {
        "invoice": "Invoice",
        "stock_code": "StockCode",
        "description": "Description",
        "quantity": "Quantity",
        "invoice_date": "InvoiceDate",
        "price": "Price",
        "customer": "Customer ID",
        "country": "Country",
    }
    assert list(raw_names.values()) == list(COLUMN_MAP)
    return sheeted.select(
        *[F.col(a).alias(b) for a, b in raw_names.items()],
        "source_sheet",
        F.col("line_id").alias("source_row"),
        "line_id",
        *([F.col("src").withField("copy", F.col("copy")).alias("src")] if with_src else []),
    )


def named_by_src(rows: DataFrame, after: str = "source_sheet") -> DataFrame:
    """Rows with `line_id`, said from `src`, in its place."""
    at = rows.columns.index(after) + 1
    plain = rows.columns
    said = rows.select("*", "src.*").withColumn("src_key", F.expr(SRC_KEY))
    return said.select(*plain[:at], line_id(after, "src_key", "copy").alias("line_id"), *plain[at:])
