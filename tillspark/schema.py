"""Declared source schema, column names and the feature allowlist."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Source headers and the names used after standardisation.
COLUMN_MAP = {
    "Invoice": "invoice_id",
    "StockCode": "product_id",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_date",
    "Price": "unit_price",
    "Customer ID": "customer_id",
    "Country": "country",
}

# Model inputs in their published order.
FEATURES = [
    "weekday",
    "month",
    "day_of_year_sin",
    "day_of_year_cos",
    "lag_1",
    "lag_7",
    "lag_14",
    "lag_28",
    "rolling_7",
    "rolling_28",
    "rolling_std_7",
    "lag_orders_1",
    "trend_7_28",
]
CATEGORICAL = ["weekday", "month"]
NUMERIC = [c for c in FEATURES if c not in CATEGORICAL]

# Fixed value: the member which stands for a missing customer or description.
UNKNOWN = "UNKNOWN"

RAW_SCHEMA = T.StructType(
    [
        T.StructField("Invoice", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.DoubleType()),
        T.StructField("InvoiceDate", T.TimestampNTZType()),
        T.StructField("Price", T.DoubleType()),
        T.StructField("Customer ID", T.StringType()),
        T.StructField("Country", T.StringType()),
    ]
)

FLAGS = ["is_sale", "is_cancellation", "is_adjustment", "ambiguous_duplicate"]

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "moment": T.TimestampNTZType(),
}


def _struct(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


STAR_SCHEMAS = {
    "fact_sales": _struct(
        line_id="string",
        invoice_id="string",
        product_id="string",
        customer_id="string",
        country_id="int",
        date="date",
        invoice_date="moment",
        quantity="bigint",
        unit_price="double",
        net_value="double",
        gross_sales="double",
        cancellation_value="double",
        is_sale="int",
        is_cancellation="int",
        is_adjustment="int",
        ambiguous_duplicate="int",
        hour="int",
    ),
    "dim_product": _struct(product_id="string", description="string"),
    "dim_customer": _struct(customer_id="string"),
    "dim_country": _struct(country="string", country_id="int"),
    "dim_date": _struct(date="date", year="int", month_number="int", weekday="int"),
}


@dataclass(frozen=True)
class SourceSchema:
    """What a source part must look like; the date bounds are inclusive."""

    date_min: str = "2009-12-01"
    date_max: str = "2011-12-09 23:59:59"
    required: tuple[str, ...] = tuple(COLUMN_MAP)
    not_null: tuple[str, ...] = (
        "Invoice",
        "StockCode",
        "Quantity",
        "InvoiceDate",
        "Price",
        "Country",
    )
    numeric: tuple[str, ...] = ("Quantity", "Price")
    date: str = "InvoiceDate"
    sheet: str = "source_sheet"
    order: str = "source_row"
    key: str = "line_id"
    text: tuple[str, ...] = field(default=("Invoice", "StockCode", "Description", "Country"))
