"""Streaming jobs: sources to tables, with checkpoints for progress.

A batch is written before its progress is recorded, so after a failure it runs again; writes are
keyed or addressed by the batch number, which makes the repetition harmless.
"""

from pyspark.sql import functions as F

from ..operators import invoice_intake, trip_intake
from ..operators.constraints import REASONS, split
from ..operators.merge import latest_per_key, replace_rows
from ..schemas import FUEL_INVOICES, TRIP_FACTS
from ..sources import invoice_files, messages
from ..sources.tables import stored
from .serving import ServedDays, write_days


def trigger_options(interval=None):
    """Process what is there and stop, or go on at a fixed interval."""
    return {"processingTime": interval} if interval else {"availableNow": True}


def _quarantine(rejected, path, batch_id):
    """Rejected rows of one batch; a repeated batch replaces its own folder."""
    rejected.withColumn(REASONS, F.concat_ws(",", REASONS)).write.mode("overwrite").json(
        f"{path}/batch_id={batch_id}"
    )


def ingest_messages(lines, store, quarantine, checkpoint, interval=None):
    """Message lines -> validated trips, upserted into the trip table by trip number.

    A table that keeps message times (``order_by``) holds the newest message of a trip, however
    the messages are spread over batches. Without them the last batch counts.
    """
    ordered = bool(store.specs[TRIP_FACTS.name].order_by)

    def load(batch, batch_id):
        checked = trip_intake.with_reasons(trip_intake.typed(messages.parse(batch)))
        checked = checked.persist()
        try:
            accepted, rejected = split(checked)
            _quarantine(rejected.select("raw", REASONS), quarantine, batch_id)
            if not ordered:
                accepted = latest_per_key(accepted, ["tripId"], ["timestamp", "messageId"])
            rows = trip_intake.trip_rows(
                accepted, F.current_timestamp(), F.col("timestamp").alias("MessageTime")
            )
            store.upsert(rows, TRIP_FACTS.name, distinct=not ordered)
        finally:
            checked.unpersist()

    return (
        lines.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_options(interval))
        .start()
    )


def load_invoice_files(spark, files, store, quarantine, batch_id):
    """One batch of files: read, report per file, upsert the valid files' rows.

    Rows the table's rules refuse (no litres, no amount) go to quarantine, as does every row of
    a file with findings; a file without rows leaves its finding there.
    """
    # the listing, used for the paths and for files without rows: the source is listed once
    files = files.persist()
    # as many as the job's batches have files at most
    paths = [r[0] for r in files.select("path").collect()]
    if not paths:
        files.unpersist()
        return
    raw = invoice_files.read_files(spark, paths)
    report = invoice_intake.validation_report(raw, by=["SourceFile"])
    findings = report.where(~F.col("is_valid")).select("SourceFile", "errors")
    marked = raw.join(findings, "SourceFile", "left").persist()
    try:
        rows = invoice_intake.transform(
            marked.where("errors IS NULL"), F.current_timestamp()
        )
        accepted, refused = store.admit(rows, FUEL_INVOICES.name)
        bad_rows = refused.select(F.to_json(F.struct(
            *[c for c in refused.columns if c != REASONS])).alias("raw"), REASONS)
        bad_files = marked.where("errors IS NOT NULL").select(
            F.to_json(F.struct(*raw.columns)).alias("raw"), F.col("errors").alias(REASONS)
        )
        no_rows = invoice_files.without_rows(files, raw).select(
            F.to_json(F.struct("SourceFile")).alias("raw"),
            F.array(F.lit(invoice_intake.EMPTY)).alias(REASONS),
        )
        _quarantine(
            bad_rows.unionByName(bad_files).unionByName(no_rows), quarantine, batch_id
        )
        store.upsert(accepted, FUEL_INVOICES.name)
    finally:
        marked.unpersist()
        files.unpersist()


def ingest_invoice_files(spark, folder, store, quarantine, checkpoint, max_files=1000,
                         interval=None):
    """New files of a folder -> invoices. Seen files are remembered by the checkpoint;
    ``max_files`` bounds a batch, so a large backlog is worked off in several."""
    listing = invoice_files.stream_files(spark, folder, max_files)
    return (
        listing.writeStream.foreachBatch(
            lambda batch, batch_id: load_invoice_files(
                batch.sparkSession, batch, store, quarantine, batch_id
            )
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_options(interval))
        .start()
    )


def copy_into(spark, folder, schema, store, name, checkpoint):
    """Load the CSV files of a folder that have not been loaded before.

    ``schema`` names the columns the files hold; the table's other columns take their defaults.
    """
    rows = (
        spark.readStream.schema(schema)
        .options(**invoice_files.CSV_FORMATS)
        .csv(folder)
    )
    return (
        rows.writeStream.foreachBatch(lambda batch, _: store.upsert(batch, name))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def archive(frame, path, checkpoint, interval=None):
    """Append-mode output to parquet: rows, or windows that can no longer change."""
    return (
        frame.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_options(interval))
        .start()
    )


def _published(spark, folder, batch_id):
    """(file system, staging folder, final folder, whether the batch is there) of a batch's folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    staging = hadoop.Path(f"{folder}/_staging/{batch_id}")
    final = hadoop.Path(f"{folder}/batch_id={batch_id}")
    system = final.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, staging, final, system.exists(final)


def _swap_in(system, staging, final):
    if not system.rename(staging, final):
        raise RuntimeError(f"{final} could not be published")


def fan_out(frame, root, first, others, checkpoint, interval=None):
    """One stream to several append-only outputs: the source is read and parsed once a batch.

    ``frame`` goes to ``root/first``; ``others`` {name: function} derive theirs from the rows just written
    there. A batch is one folder in each output, renamed into place when it is complete, the first
    output's last. So readers see whole batches, and a batch that is repeated leaves what is published as
    it is.
    """

    def write(batch, batch_id):
        spark = batch.sparkSession
        system, staging, final, there = _published(spark, f"{root}/{first}", batch_id)
        if there:
            return
        batch.write.mode("overwrite").parquet(staging.toString())
        rows = spark.read.schema(batch.schema).parquet(staging.toString())
        for name, derive in others.items():
            files, own, target, done = _published(spark, f"{root}/{name}", batch_id)
            if not done:
                derive(rows).write.mode("overwrite").parquet(own.toString())
                _swap_in(files, own, target)
        _swap_in(system, staging, final)

    return (
        frame.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_options(interval))
        .start()
    )


def publish(frame, checkpoint, servers, topic, key=None, interval=None):
    """Append-mode output to a topic as JSON; needs the Kafka connector on the class path."""
    value = F.to_json(F.struct("*")).alias("value")
    columns = [value] if key is None else [F.col(key).cast("string").alias("key"), value]
    return (
        frame.select(*columns)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_options(interval))
        .start()
    )


def _days_of(rows):
    """The calendar days of a batch's windows."""
    return [r[0] for r in rows.select("window_date").distinct().collect()]


def _merged(served, part, fresh, days, keys):
    """All rows of the days: the batch's in place of stored ones with their keys."""
    old = served.read(part, fresh.schema, map(str, days))
    # update mode emits one row per key and batch
    return fresh if old is None else replace_rows(old, fresh, keys)


def _start_updates(frame, write, checkpoint, interval):
    return (
        frame.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_options(interval))
        .start()
    )


def serve(frame, path, keys, checkpoint, interval=None):
    """Update-mode output: the newest row per key, in versioned days (:mod:`.serving`).

    A batch changes few days; these are written anew and swapped in. ``keys`` include
    ``window_start``, so a row never changes its day.
    """

    def write(batch, batch_id):
        fresh = batch.withColumn("window_date", F.to_date("window_start")).persist()
        try:
            days = _days_of(fresh)
            if days:
                served = ServedDays(batch.sparkSession, path)
                merged = _merged(served, "rows", fresh, days, keys)
                served.publish(days, lambda folder: write_days(merged, f"{folder}/rows"))
        finally:
            fresh.unpersist()

    return _start_updates(frame, write, checkpoint, interval)


def serve_totals(sums, totals, path, keys, start, checkpoint, interval=None):
    """Update-mode sums per vehicle, and the totals of every window, open ones too.

    A batch writes the sums of the days it touches (part ``vehicles``), adds them up (part ``rows``) and
    swaps both in at once. ``start`` names the totals' column with the start of the window, which lies
    within one day.
    """

    def write(batch, batch_id):
        begun = batch.withColumn("window_start", F.col("window.start"))
        fresh = begun.withColumn("window_date", F.to_date("window_start")).persist()
        try:
            days = _days_of(fresh)
            if days:
                served = ServedDays(batch.sparkSession, path)
                merged = _merged(served, "vehicles", fresh, days, ["window_start", *keys])

                def both(folder):
                    write_days(merged, f"{folder}/vehicles")
                    written = stored(batch.sparkSession, f"{folder}/vehicles", fresh.schema)
                    write_days(
                        totals(written).withColumn("window_date", F.to_date(start)), f"{folder}/rows"
                    )

                served.publish(days, both)
        finally:
            fresh.unpersist()

    return _start_updates(sums, write, checkpoint, interval)


def finish(query, timeout=None):
    """Wait for an ``availableNow`` run; raises what the run raised."""
    query.awaitTermination(timeout)
    return query
