"""From invoice text fields to invoice rows, and the validation report."""

from pyspark.sql import functions as F

from ..functions.dates import month_start
from ..functions.ratios import unit_price
from ..sources.invoice_files import PRESENT

REQUIRED = ("VIN", "Litres", "EUR_Amount")

# Fixed values for columns a drop does not have
DEFAULTS = {
    "VIN": "UNKNOWN", "Litres": 0.0, "EUR_Amount": 0.0, "InvoiceNumber": None,
    "SupplierName": "UNKNOWN", "FuelType": "DIESEL", "Location": "UNKNOWN",
}
NUMBERS = ("Litres", "EUR_Amount")
NULL_LIMIT_PERCENT = 10
EMPTY = "Dataset is empty"


def _typed(column):
    return F.col(column).try_cast("double") if column in NUMBERS else F.col(column)


def present(df, column):
    """Whether the row's file has the column; a plain True or False where the frame decides."""
    if column not in df.columns:
        return False
    return F.array_contains(PRESENT, column) if PRESENT in df.columns else True


def _or_default(df, column, default):
    there = present(df, column)
    if isinstance(there, bool):
        return F.col(column) if there else default
    return F.when(there, F.col(column)).otherwise(default)


def with_defaults(df):
    """Add absent columns with their default; columns that are present keep their NULLs.

    Where files with differing columns share a frame, each row follows its own file.
    """
    def default(column, value):
        kind = "double" if column in NUMBERS and column not in df.columns else "string"
        return F.lit(value).cast(kind)

    return df.withColumns(
        {c: _or_default(df, c, default(c, v)) for c, v in DEFAULTS.items()
         if present(df, c) is not True}
    )


def with_month(df, today=None):
    """Invoice date as a date (today's where the drop has none) and its month."""
    day = F.current_date() if today is None else F.lit(today).cast("date")
    there = present(df, "InvoiceDate")
    if there is not False:
        given = F.to_date(F.col("InvoiceDate").try_cast("timestamp"))
        day = given if there is True else F.when(there, given).otherwise(day)
    return df.withColumn("InvoiceDate", day).withColumn(
        "InvoiceMonth", month_start(F.col("InvoiceDate"))
    )


def clean_number(value):
    """Missing or non-positive numbers become 0."""
    return F.when(value > 0, value).otherwise(0.0)


def transform(df, processed_time, source="CSV_IMPORT"):
    """Full invoice row; ``SourceFile`` and ``FileTime`` are kept when the reader supplied them."""
    rows = with_month(with_defaults(df))
    rows = rows.withColumns({c: clean_number(_typed(c)) for c in NUMBERS})
    return rows.select(
        "VIN",
        "InvoiceDate",
        "InvoiceMonth",
        "Litres",
        "EUR_Amount",
        unit_price(F.col("EUR_Amount"), F.col("Litres")).alias("EUR_per_Litre"),
        "InvoiceNumber",
        "SupplierName",
        "FuelType",
        "Location",
        processed_time.alias("ProcessedTime"),
        F.lit(source).alias("DataSource"),
        F.col("SourceFile") if "SourceFile" in df.columns
        else F.lit(None).cast("string").alias("SourceFile"),
        *[c for c in ("FileTime",) if c in df.columns],
    )


def validation_report(df, by=()):
    """One row per file (or whatever ``by`` names) with all findings, from one aggregation.

    A whole file is refused for any finding: an absent column, no rows, more than ten percent
    NULLs in a required column, negative numbers, repeated invoice numbers.
    """
    by = list(by)
    known = [c for c in REQUIRED if c in df.columns]
    numbers = [c for c in NUMBERS if c in df.columns]
    aggregates = [F.count(F.lit(1)).alias("rows")]
    aggregates += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in known]
    # a group holds rows of one file; a group without rows misses what the frame misses
    for c in REQUIRED:
        there = present(df, c)
        there = F.lit(there) if isinstance(there, bool) else there
        lacking = F.bool_or(~there) if c in known else F.lit(True)
        aggregates.append(F.coalesce(lacking, F.lit(False)).alias(f"lacks_{c}"))
    aggregates += [F.count_if(_typed(c) < 0).alias(f"negative_{c}") for c in numbers]
    if "InvoiceNumber" in df.columns:
        aggregates.append(
            (F.count("InvoiceNumber") - F.count_distinct("InvoiceNumber")).alias("duplicates")
        )
    else:
        aggregates.append(F.lit(0).alias("duplicates"))
    found = df.groupBy(*by).agg(*aggregates)

    absent = F.concat_ws(", ", *[F.when(F.col(f"lacks_{c}"), F.lit(f"'{c}'")) for c in REQUIRED])
    messages = [
        F.when(absent != "", F.concat(F.lit("Missing required columns: ["), absent, F.lit("]")))
    ]
    messages.append(F.when(F.col("rows") == 0, F.lit(EMPTY)))
    for c in known:
        percent = F.try_divide(F.col(f"null_{c}"), F.col("rows")) * 100
        messages.append(
            F.when(
                ~F.col(f"lacks_{c}") & (percent > NULL_LIMIT_PERCENT),
                F.concat(F.lit(f"Column {c} has "), F.format_number(percent, 1),
                         F.lit("% null values")),
            )
        )
    for c, noun in (("Litres", "litres"), ("EUR_Amount", "amounts")):
        if c in numbers:
            messages.append(
                F.when(
                    F.col(f"negative_{c}") > 0,
                    F.concat(F.lit("Found "), F.col(f"negative_{c}").cast("string"),
                             F.lit(f" records with negative {noun}")),
                )
            )
    messages.append(
        F.when(
            F.col("duplicates") > 0,
            F.concat(F.lit("Found "), F.col("duplicates").cast("string"),
                     F.lit(" duplicate invoice numbers")),
        )
    )
    errors = F.array_compact(F.array(*messages))
    return found.select("*", errors.alias("errors")).withColumn(
        "is_valid", F.size("errors") == 0
    ).drop(*[f"lacks_{c}" for c in REQUIRED])
