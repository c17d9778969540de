"""Key-based upsert expressed with an aggregate, an anti join and a union."""

from functools import reduce

from pyspark.sql import functions as F


def latest_per_key(df, keys, order_by):
    """Keep the greatest row per key by ``order_by``; later columns break ties.

    A row with a NULL key equals nothing, so each of those stays a group of its own. The
    maximum is partial before the shuffle, so a key with very many copies costs one row per
    task and never gathers in one place.
    """
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    payload = [c for c in df.columns if c not in order_by]
    row = F.struct(*order_by, *payload)
    alone = F.when(~complete, F.monotonically_increasing_id())
    return (
        df.withColumn("_alone", alone)
        .groupBy(*keys, "_alone")
        .agg(F.max(row).alias("_row"))
        .select(*[F.col("_row")[c].alias(c) for c in df.columns])
    )


def merge(target, source, keys, order_by):
    """Upsert ``source`` into ``target``; of several source rows with a key the latest counts."""
    return replace_rows(target, latest_per_key(source, keys, order_by), keys)


def replace_rows(target, fresh, keys):
    """Rows of ``target`` without a partner in ``fresh``, then all of ``fresh``, which has one row
    per key.

    Equality is SQL equality: NULL keys never match. Spark broadcasts the key list when it is
    small; otherwise AQE splits hot partitions of the anti join's left side.
    """
    kept = target.join(fresh.select(*keys), list(keys), "left_anti")
    return kept.select(*target.columns).unionByName(fresh, allowMissingColumns=True)


def merge_catalog_table(source, table, keys):
    """The same upsert on a catalog whose tables support row-level operations."""
    condition = reduce(
        lambda a, b: a & b, [F.col(f"target.{k}") == F.col(f"source.{k}") for k in keys]
    )
    (
        source.alias("source")
        .mergeInto(f"{table} AS target", condition)
        .whenMatched().updateAll()
        .whenNotMatched().insertAll()
        .merge()
    )
