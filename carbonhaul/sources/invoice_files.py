"""Invoice files with differing delimiters and headers.

All files are one scan of lines. A file's header is its first line that is not blank, found by aggregation;
what its names mean is worked out on the small table of headers, one row a file, and joined back to the
lines. Lines are split by Spark's CSV parser under their file's delimiter, and columns taken by position.
No Python runs on the executors, and the driver sees neither headers nor contents.

A line that repeats its file's header is a header wherever it stands. A line longer than ``LONGEST_LINE``
bytes is skipped by the reader, so a file that is one endless line fills no worker and counts as empty.
"""

from functools import reduce

from pyspark.sql import functions as F

from ..schemas import INVOICE_DROP_COLUMNS, struct
from ..session import materialized

EXTENSIONS = "*.{csv,tsv,txt}"

# Which header belongs to which column. Every group of a rule needs one of its
# words in the header; rules are tried in this order.
ALIASES = (
    ("VIN", (("vin", "vehicle"),)),
    ("InvoiceDate", (("invoice",), ("date", "month"))),
    ("Litres", (("litre", "liter", "volume"),)),
    ("EUR_Amount", (("eur", "euro", "amount", "cost"),)),
    ("InvoiceNumber", (("invoice",), ("number",))),
    ("SupplierName", (("supplier", "vendor", "provider"),)),
    ("FuelType", (("fuel",), ("type",))),
    ("Location", (("location", "station", "site"),)),
)
COMPUTED = ("eur_per_litre",)

# Formats of the table files
CSV_FORMATS = {
    "header": "true", "dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd HH:mm:ss",
}

#: columns that the row's own file has, as opposed to the frame
PRESENT = "columns_present"
# as scans spell it; a listing's path may be spelled otherwise
SOURCE_FILE = "_metadata.file_path AS SourceFile"

FILE_SCHEMA = struct("path string, modificationTime timestamp, length bigint, content binary")
LONGEST_LINE = 16 << 20


def list_files(spark, folder):
    """Path, size and time of every invoice file below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", EXTENSIONS)
        .load(folder)
        .selectExpr("path", "length", "modificationTime", SOURCE_FILE)
    )


def stream_files(spark, folder, max_files=None):
    """The same listing as a stream: the checkpoint remembers which files were processed."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", EXTENSIONS)
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder).selectExpr("path", "length", SOURCE_FILE)


def lines(spark, source):
    """value, SourceFile, FileTime and place of all lines below a folder, or of a list of paths.

    ``place`` orders the lines of a file's first block.
    """
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", EXTENSIONS)
        .option("mapreduce.input.linerecordreader.line.maxlength", LONGEST_LINE)
        .text(source)
        .selectExpr(
            "rtrim('\r', value) AS value", SOURCE_FILE,
            "_metadata.file_modification_time AS FileTime",
            "_metadata.file_block_start = 0 AS first_block",
            "monotonically_increasing_id() AS place",
        )
        .where("trim(value) <> ''")
    )


def delimiter(header):
    """Tab or semicolon where the header has one, else comma."""
    return F.when(header.contains("\t"), "\t").when(header.contains(";"), ";").otherwise(",")


def canonical(names):
    """Per column that the headers ``names`` (an array) have, its position from 1, else null.

    A header that is a column's own name wins; otherwise the first header a rule matches does.
    """
    plain = F.transform(names, lambda n: F.lower(F.trim(F.regexp_replace(F.trim(n), '^"+|"+$', ""))))
    own = [c.lower() for c in INVOICE_DROP_COLUMNS]

    def has(name, group):
        return reduce(lambda a, b: a | b, [name.contains(word) for word in group])

    def rule(name):
        found = F.when(name.isin(*own, *COMPUTED), F.lit(None).cast("string"))
        for column, groups in ALIASES:
            found = found.when(reduce(lambda a, b: a & b, [has(name, g) for g in groups]), column)
        return found

    by_rule = F.transform(plain, rule)
    return {
        c: F.nullif(F.coalesce(
            F.nullif(F.array_position(plain, c.lower()), F.lit(0)), F.array_position(by_rule, c)
        ), F.lit(0)).cast("int")
        for c in INVOICE_DROP_COLUMNS
    }


def headers(found):
    """One row a file: SourceFile, header, separator, width, and the position of every column."""
    first = found.where("first_block").groupBy("SourceFile").agg(
        F.min_by("value", "place").alias("header")
    )
    bare = F.regexp_replace("header", "^\ufeff", "")
    split = first.withColumn("separator", delimiter(F.col("header"))).withColumn(
        "names", F.split(bare, F.col("separator"))
    )
    return split.select(
        "SourceFile", "header", "separator", F.size("names").alias("width"),
        F.struct(*[p.alias(c) for c, p in canonical(F.col("names")).items()]).alias("at"),
    )


def read_files(spark, source):
    """All files of ``source`` (a folder, or a list of paths) as one frame of text columns with
    ``SourceFile`` and ``FileTime``.

    ``columns_present`` names the columns that a row's own file has, so that nothing later depends
    on which files are read together.
    """
    found = lines(spark, source)
    known = materialized(headers(found))
    # one number: how many fields the parser has to tell apart
    width = known.agg(F.coalesce(F.max("width"), F.lit(1))).first()[0]
    fields = ", ".join(f"c{i} string" for i in range(width))

    def parsed(separator):
        options = {
            "sep": separator, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
            "maxColumns": str(max(20480, width)),
        }
        row = F.from_csv("value", fields, options)
        return F.array(*[row[f"c{i}"] for i in range(width)])

    values = (
        F.when(F.col("separator") == "\t", parsed("\t"))
        .when(F.col("separator") == ";", parsed(";"))
        .otherwise(parsed(","))
    )
    rows = found.join(known, "SourceFile").where("value <> header").select(
        "SourceFile", "FileTime", "at", F.explode(F.array(values)).alias("fields")
    )
    return rows.select(
        *[F.get("fields", F.col("at")[c] - 1).alias(c) for c in INVOICE_DROP_COLUMNS],
        F.array_compact(F.array(*[
            F.when(F.col("at")[c].isNotNull(), F.lit(c)) for c in INVOICE_DROP_COLUMNS
        ])).alias(PRESENT),
        "SourceFile", "FileTime",
    )


def without_rows(files, raw):
    """``SourceFile`` of every listed file of which ``raw`` holds no row."""
    return files.select("SourceFile").join(raw.select("SourceFile"), "SourceFile", "left_anti")


def read_table_csv(spark, path, schema):
    """A CSV with known columns: no inference, fixed date and time formats."""
    return spark.read.schema(schema).options(**CSV_FORMATS).csv(path)


