"""Typed tables below a folder: scan, overwrite, append, upsert."""

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.constraints import REASONS, check_reasons, conform, split, with_reasons
from ..operators.merge import latest_per_key, replace_rows
from ..schemas import TABLES, WRITE_TIMES
from ..session import materialized


def _folder(spark, path):
    """(file system, path) of a folder on whatever storage its scheme names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def stored(spark, path, schema):
    """The files below ``path``, or None where nothing has been written yet."""
    system, folder = _folder(spark, path)
    return spark.read.schema(schema).parquet(path) if system.exists(folder) else None


def _observed(counter, name):
    """A number counted by a pass that has ended."""
    try:
        return counter.get[name]
    except Py4JJavaError:
        # a plan known to have no rows is reduced to nothing, and its counter with it
        return 0


def _among(column, values):
    """Rows whose value is one of ``values``, of which one may be None."""
    known = F.col(column).isin([v for v in values if v is not None])
    return known | F.col(column).isNull() if None in values else known


class TableStore:
    """Parquet tables described by :data:`carbonhaul.schemas.TABLES`.

    For catalogs with row-level operations use ``operators.merge.merge_catalog_table`` instead of
    :meth:`upsert`; that also makes concurrent writers safe. This class allows one writer.

    Rows that break NOT NULL, a CHECK or the primary key are not written; :meth:`refused` has them. They
    are counted in the pass that writes the others, so a batch without any is computed once. A rewrite is staged beside the tables and then published. A
    publication that was cut off is completed from the staged rows by the next write or by
    :meth:`recover`; until then readers may miss rows of the partitions concerned.
    """

    def __init__(self, spark, root, specs=TABLES):
        self.spark, self.root, self.specs = spark, root, specs

    def path(self, name):
        return f"{self.root}/{name}"

    def exists(self, name):
        return stored(self.spark, self.path(name), self.specs[name].schema) is not None

    def read(self, name):
        return self.spark.read.schema(self.specs[name].schema).parquet(self.path(name))

    def _write(self, df, name, mode):
        """Write and return the number of rows, counted on the way through."""
        spec = self.specs[name]
        counter = Observation()
        df = df.observe(counter, F.count(F.lit(1)).alias("rows"))
        if spec.partition_by:
            # AQE splits a hot partition value over several tasks and packs small ones
            df = df.hint("rebalance", *spec.partition_by)
        writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        if spec.partition_by:
            writer = writer.partitionBy(*spec.partition_by)
        writer.parquet(self.path(name))
        return _observed(counter, "rows")

    def admit(self, df, name):
        """(accepted, quarantined) rows under the table's declared rules."""
        spec = self.specs[name]
        return split(with_reasons(conform(df, spec), spec))

    def refused(self, name):
        """Rows that writes have refused, with their reasons; None where there are none. A row that
        a repeated write refused again is listed once."""
        fields = [T.StructField(f.name, f.dataType) for f in self.specs[name].schema]
        fields.append(T.StructField(REASONS, T.ArrayType(T.StringType())))
        rows = stored(self.spark, f"{self.root}/_refused/{name}", T.StructType(fields))
        return None if rows is None else rows.dropDuplicates(
            [f.name for f in fields if f.name not in WRITE_TIMES]
        )

    def _checked(self, df, name, key=(), taken=None):
        """(rows that may be written, function to call when they were written, which puts the others
        to :meth:`refused`)."""
        spec = self.specs[name]
        rows = conform(df, spec)
        counter = Observation()
        tagged = check_reasons(rows, spec, key, taken)
        _, refused = split(tagged)
        counted, _ = split(
            tagged.observe(counter, F.count_if(F.size(REASONS) > 0).alias("refused"))
        )

        def keep_refused():
            if _observed(counter, "refused"):
                refused.write.mode("append").parquet(f"{self.root}/_refused/{name}")

        return (counted, keep_refused) if spec.required or spec.checks or key else (rows, lambda: None)

    def _staging(self, name):
        return f"{self.root}/_staging/{name}"

    def _replace(self, rows, name):
        """Stage the rows, then put them in place of the partitions they belong to."""
        rows.write.mode("overwrite").parquet(self._staging(name))
        return self._publish(name)

    def _publish(self, name):
        staging = self._staging(name)
        staged = self.spark.read.schema(self.specs[name].schema).parquet(staging)
        written = self._write(staged, name, "overwrite")
        system, folder = _folder(self.spark, staging)
        system.delete(folder, True)
        return written

    def recover(self, name):
        """Complete a publication that was cut off; forget rows that were not staged completely."""
        system, folder = _folder(self.spark, self._staging(name))
        if not system.exists(folder):
            return
        if system.exists(_folder(self.spark, f"{self._staging(name)}/_SUCCESS")[1]):
            self._publish(name)
        else:
            system.delete(folder, True)

    def overwrite(self, df, name):
        """Replace the partitions present in ``df`` (the whole table if it has none)."""
        self.recover(name)
        rows, keep_refused = self._checked(df, name, self.specs[name].primary_key)
        written = self._write(rows, name, "overwrite")
        keep_refused()
        return written

    def append(self, df, name):
        """Add rows; one whose primary key the table has already is refused."""
        self.recover(name)
        key = self.specs[name].primary_key
        taken = self.read(name) if key and self.exists(name) else None
        if taken is not None:
            # the table changes below: what is refused must not depend on what was just written
            taken = materialized(taken.select(*key))
        rows, keep_refused = self._checked(df, name, key, taken)
        written = self._write(rows, name, "append")
        keep_refused()
        return written

    def upsert(self, df, name, order_by=(), distinct=False):
        """Update rows with equal merge keys, insert the others.

        Of several rows with a key the greatest by ``order_by`` (or the table's own order) counts, be
        it stored or new: the same rows in other batches leave the same table. Without an order the
        batch replaces stored rows. ``distinct`` says that ``df`` has one row per key already.
        Only partitions in which a key is matched, or to which its row moves, are rewritten; rows with
        new keys are added to the others as files of their own. So a batch costs what it brings and
        changes, and a look at the stored keys, but no copy of the table. Running the same batch
        twice leaves the table as after the first run.
        """
        self.recover(name)
        spec = self.specs[name]
        keys = list(spec.merge_keys)
        source, keep_refused = self._checked(df, name)
        order = tuple(order_by) or spec.order_by
        if order:
            # rows that are equal in it are told apart by what they hold, not by when they came
            order = (*order, *[c for c in source.columns if c not in (*order, *keys, *WRITE_TIMES)])
        if not distinct:
            source = latest_per_key(source, keys, order or keys)
        if not self.exists(name):
            written = self._write(source, name, "overwrite")
            keep_refused()
            return written
        # the table changes below: what depends on it is settled first, also for lost executors
        source, target = materialized(source), self.read(name)
        keep_refused()
        part = spec.partition_by[0] if spec.partition_by else None
        own = list(dict.fromkeys([*keys, part] if part else keys))
        matched = materialized(target.select(*own).join(source.select(*keys), keys, "left_semi"))
        if matched.isEmpty():
            return self._write(source, name, "append")
        if part:
            moved = source.join(matched.select(*keys).distinct(), keys, "left_semi")
            # at most one value per calendar day or month
            touched = [r[0] for r in matched.select(part).union(moved.select(part)).distinct().collect()]
            target = target.where(_among(part, touched))
        if order:
            held = target.join(source.select(*keys), keys, "left_semi").select(*source.columns)
            source = materialized(latest_per_key(held.unionByName(source), keys, order))
        if not part:
            return self._replace(replace_rows(target, source, keys), name)

        inside = F.coalesce(_among(part, touched), F.lit(False))
        rows = self._replace(replace_rows(target, source.where(inside), keys), name)
        # a partition whose rows all moved elsewhere is not in the written set
        filled = {r[0] for r in source.where(inside).select(part).distinct().collect()}
        lost = [v for v in touched if v not in filled]
        if lost:
            self._drop_stale(name, part, lost, source, keys)
        # after the rewrite: what is cut off in between is added when the batch is repeated
        return rows + self._write(source.where(~inside), name, "append")

    def _drop_stale(self, name, part, values, source, keys):
        """Remove partitions that still hold only rows the batch has moved away."""
        stale = (
            self.read(name).where(_among(part, values))
            .join(source.select(*keys, F.lit(True).alias("_moved")), keys, "left")
            .groupBy(part).agg(F.bool_and(F.coalesce("_moved", F.lit(False))).alias("gone"))
            .where("gone")
        )
        for row in stale.collect():
            value = "__HIVE_DEFAULT_PARTITION__" if row[0] is None else row[0]
            system, folder = _folder(self.spark, f"{self.path(name)}/{part}={value}")
            system.delete(folder, True)

    def optimize(self, name, files, where=None):
        """Rewrite the table (or the partitions ``where`` selects) in ``files`` files ordered by
        the clustering columns, so that a vehicle's rows lie in few files of each partition."""
        spec = self.specs[name]
        rows = self.read(name) if where is None else self.read(name).where(where)
        columns = [*spec.partition_by, *[c for c in spec.cluster_by if c not in spec.partition_by]]
        if not spec.partition_by:
            rows = materialized(rows)
        writer = (
            cluster(rows, columns, files).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
        )
        if spec.partition_by:
            writer = writer.partitionBy(*spec.partition_by)
        writer.parquet(self.path(name))

    def row_counts(self, names=None):
        """Rows per table as one UNION ALL."""
        frames = [
            self.read(n).agg(F.count(F.lit(1)).alias("RowCount")).select(
                F.lit(n).alias("TableName"), "RowCount"
            )
            for n in (names or self.specs)
        ]
        return reduce(lambda a, b: a.unionByName(b), frames)

    def analyze(self, name):
        """Register the folder as a catalog table and compute its statistics."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} USING parquet LOCATION '{self.path(name)}'"
        )
        if self.specs[name].partition_by:
            self.spark.sql(f"MSCK REPAIR TABLE {name}")
        self.spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")


def cluster(df, columns, files):
    """Range partition and sort, so that file and row-group minima and maxima prune scans on
    the leading columns."""
    return df.repartitionByRange(files, *columns).sortWithinPartitions(*columns)


def trips_between(trips, first, last):
    """Trips starting in [first, last): the partition column gets its own predicate, which the
    generated column would not receive from the timestamp filter."""
    first, last = F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")
    return trips.where(
        (F.col("StartTimeUTC") >= first)
        & (F.col("StartTimeUTC") < last)
        & (F.col("TripDate") >= F.to_date(first))
        & (F.col("TripDate") <= F.to_date(last))
    )

