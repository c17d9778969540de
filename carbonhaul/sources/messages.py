"""Trip-end messages: JSON text from files or a topic."""

from pyspark.sql import functions as F

from ..operators.constraints import pinned
from ..schemas import MESSAGE_SCHEMA


def json_lines_stream(spark, folder, max_files=1000):
    """A stream of text files with one message per line."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def kafka_stream(spark, servers, topic, max_offsets=None, **options):
    """A topic as a stream; needs the Kafka connector on the class path.

    Offsets live in the query's checkpoint and advance after the batch is written.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def parse(lines, column="value"):
    """Message fields as text plus ``malformed``; a bad line never fails the batch.

    A line must be one JSON object. All fields are read as text, see ``MESSAGE_SCHEMA``. Each
    line is parsed once, whatever is filtered later.
    """
    parsed = F.from_json(
        F.col(column),
        MESSAGE_SCHEMA,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    fields = [f.name for f in MESSAGE_SCHEMA if f.name != "_corrupt"]
    malformed = (
        F.col("m").isNull()
        | F.col("m._corrupt").isNotNull()
        | ~F.ltrim(F.col(column)).startswith("{")
    )
    return pinned(lines.select(F.col(column), parsed.alias("m"))).select(
        F.col(column).alias("raw"),
        malformed.alias("malformed"),
        *[F.when(~malformed, F.col(f"m.{f}")).alias(f) for f in fields],
    )
