"""What several operators share: tables, staged frames, byte-wise words, hash values."""

from __future__ import annotations

import io
import os
import zipfile
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Rows per Arrow batch. Texts may be long: a batch of this many stays in the tens of MB.
BATCH_ROWS = 256

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: 0-9, a-z and every byte of a character beyond ASCII, after A-Z are lower-cased
WORD_BYTES = rb"[0-9a-z\x80-\xff]+"


_SHIPPED = set()


def ship_package(spark):
    """Give this package's code to the Python workers, by way of the shared folder."""
    context, top = spark.sparkContext, Path(__file__).resolve().parents[1]
    if context.applicationId in _SHIPPED:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for source in sorted(top.rglob("*.py")):
            archive.write(source, source.relative_to(top.parent))
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "code") + f"/{top.name}.zip")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(path)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(files.makeQualified(path).toString())
    _SHIPPED.add(context.applicationId)


#: the shuffle files of a finished query go, without waiting for the driver's garbage collection
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def text_session(spark):
    """Small Arrow batches for frames that carry whole texts; the code where it is needed."""
    ship_package(spark)
    if spark.conf.get(CLEANUP, None) != "true":
        spark.conf.set(CLEANUP, "true")
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != str(BATCH_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark, sf_dir, name):
    return text_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df, name):
    """The frame written to the shared folder and read back: computed once, lineage cut, columns
    prunable, and still there when an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df):
    """Delete the files of a ``staged`` frame after its last reader."""
    spark = df.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = hadoop.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


def spread(column):
    """60 well-mixed bits of a value's text; null counts as empty."""
    digest = F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def spread_sql(column):
    return f"CAST('0x' || substr(md5(coalesce(CAST({column} AS VARCHAR), '')), 1, 15) AS BIGINT)"


def fold(column, parts):
    """crc32 of the value's text, modulo ``parts``; null counts as empty."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


def lowered(text):
    """UTF-8 bytes with A-Z lower-cased; null counts as empty. bytes.lower and bytes.split touch
    ASCII only, so ``lowered(text).split()`` gives the words ``[^\\x20\\x09-\\x0D]+``."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def schema(text):
    return T.StructType.fromDDL(text)


def tokenizer_file(name):
    """Path of a public tokenizer's file; ``TOKENIZER_DIR`` names another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
