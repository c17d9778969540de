"""Served tables of a stream: whole days in versioned folders, and a pointer that is swapped last.

::

    <path>/versions/<version>/<part>/window_date=<day>/...
    <path>/_pointer/<number>

A batch writes the days it changes, all their rows, into a folder of its own; no folder is ever written
twice. Then a new pointer names the version of every day. Pointers are numbered, and a reader takes the
last one, so a batch that was cut off leaves nothing but a folder that no pointer names, and its repetition
starts from the days as they were. What a batch has published and repeats is published again, with the same rows. A
second writer finds its pointer's number taken and fails.

The parts of a table (sums per vehicle and what is added up from them) are named by the same pointer, so
readers see both from the same batch. Folders that neither the last two pointers name are removed, so a reader
that began before the last swap can finish.

A pointer has one line a calendar day.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

KEPT_POINTERS = 2


class ServedDays:
    """One served table; its ``parts`` are written and read under the same pointer."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder):
        if not self._files.exists(self._at(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._at(folder)))

    def pointers(self):
        """Numbers of the pointers, ascending."""
        return [int(n) for n in self._names("_pointer") if n.isdigit()]

    def days(self, number=None):
        """{day: version} of a pointer, by default the last one."""
        numbers = self.pointers()
        if not numbers:
            return {}
        name = f"_pointer/{numbers[-1] if number is None else number:012d}"
        stream = self._files.open(self._at(name))
        try:
            # read to the end, not to a line's: Hadoop's own helper does it on any file system
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return dict(line.split("\t") for line in text.splitlines())

    def read(self, part, schema, days=None):
        """The rows of a part, with ``window_date``; None where no day has been published."""
        current = self.days()
        wanted = sorted(set(current) if days is None else set(current) & set(days))
        if not wanted:
            return None
        folders = [
            f"{self.path}/versions/{current[day]}/{part}/window_date={day}" for day in wanted
        ]
        # a day may have no rows of this part
        there = [f for f in folders if self._files.exists(self._hadoop.Path(f))]
        fields = [f for f in schema if f.name != "window_date"]
        if not there:
            return None
        # the day is taken from the folder's name: versions differ, so there is no common base path
        day = F.to_date(F.regexp_extract(F.col("_metadata.file_path"), r"window_date=([0-9-]+)/", 1))
        rows = self.spark.read.schema(T.StructType(fields)).parquet(*there)
        return rows.select("*", day.alias("window_date"))

    def publish(self, days, write):
        """Replace ``days`` by what ``write(folder)`` puts below the version's folder."""
        version = uuid.uuid4().hex
        folder = f"{self.path}/versions/{version}"
        write(folder)
        current = self.days()
        self._swap({**current, **dict.fromkeys(map(str, days), version)})
        self._clean()

    def _swap(self, days):
        number = max(self.pointers(), default=0) + 1
        draft = self._at(f"_pointer/_draft-{uuid.uuid4().hex}")
        stream = self._files.create(draft)
        try:
            stream.write("".join(f"{d}\t{v}\n" for d, v in sorted(days.items())).encode())
        finally:
            stream.close()
        target = self._at(f"_pointer/{number:012d}")
        if self._files.exists(target) or not self._files.rename(draft, target):
            raise RuntimeError(f"{self.path}: pointer {number} was written by somebody else")

    def _clean(self):
        numbers = self.pointers()
        named = set()
        for number in numbers[-KEPT_POINTERS:]:
            named |= {(v, d) for d, v in self.days(number).items()}
        versions = {v for v, _ in named}
        for number in numbers[:-KEPT_POINTERS]:
            self._files.delete(self._at(f"_pointer/{number:012d}"), False)
        for version in self._names("versions"):
            if version not in versions:
                self._files.delete(self._at(f"versions/{version}"), True)
                continue
            for part in self._names(f"versions/{version}"):
                for name in self._names(f"versions/{version}/{part}"):
                    day = name.partition("window_date=")[2]
                    if day and (version, day) not in named:
                        self._files.delete(self._at(f"versions/{version}/{part}/{name}"), True)


def write_days(rows, folder):
    """Rows with ``window_date``, one folder a day."""
    rows.hint("rebalance", "window_date").write.partitionBy("window_date").parquet(folder)


def read(spark, path, part="rows", schema=None):
    """All rows of a served table's part; the schema is read from a file where none is given."""
    served = ServedDays(spark, path)
    if schema is None:
        current = served.days()
        for day, version in sorted(current.items()):
            folder = f"{path}/versions/{version}/{part}/window_date={day}"
            if served._files.exists(served._hadoop.Path(folder)):
                schema = spark.read.parquet(folder).schema
                break
        else:
            raise FileNotFoundError(f"{path} has no published day")
    return served.read(part, schema)
