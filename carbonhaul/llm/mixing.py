"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a target from its weight, at most three times what it has; what a full source
leaves over goes to the others by weight. A source is then taken whole as often as its target
allows, and once more from those documents whose hash lies under a threshold.

The threshold is found without sorting: tokens are summed by source and hash bucket, the bucket in
which the budget runs out is refined by the next bits of the hash, and so on until it holds a single
hash value, which is taken if that comes nearer to the target. Every level is one pass over a narrow
table with partial sums, so a source with a third of all rows costs one row per bucket and task.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows
that share a doc_id share their hash and are taken together; a source of size 0 has target 0; no
document is taken more than three times; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import spread, spread_sql, staged, table

WEIGHTS = (5, 2, 1)
CAP = 3
HASH_BITS, LEVEL_BITS = 60, 12
SALTS = 32
NON_SPACE = r"[^\x20\x09-\x0D]+"


def measured(docs):
    """doc_id, source, size and hash of every row."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count(F.col("text"), F.lit(NON_SPACE)), F.lit(0)).cast("long").alias("size"),
        spread(F.col("doc_id")).alias("h"),
    )


def _keyed(df):
    """A key without nulls, and a salt so that no source is a single join key."""
    return df.withColumn(
        "source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    )


def targets(sizes, weights=WEIGHTS, cap=CAP):
    """One row per source: source_key, source_size, target, whole copies, rest of the target.

    The capped sources are those with the smallest size for their weight, so one ordered pass over
    the sources (not the documents) finds the level at which the others are filled.
    """
    listed = (
        _keyed(sizes)
        .groupBy("source_key", "source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn(
            "weight",
            F.element_at(
                F.array(*[F.lit(w) for w in weights]),
                ((F.col("rank") - 1) % len(weights) + 1).cast("int"),
            ).cast("long"),
        )
    )
    big = "decimal(38,0)"
    everything = Window.partitionBy().rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    order = Window.orderBy((F.lit(float(cap)) * F.col("source_size") / F.col("weight")), "rank")
    levels = (
        listed.withColumn("total", F.sum("source_size").over(everything))
        .withColumn(
            "free",
            F.col("total")
            - F.sum(F.col("source_size") * cap).over(order.rowsBetween(Window.unboundedPreceding, 0))
            + F.col("source_size") * cap,
        )
        .withColumn(
            "open_weight", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
        )
        .withColumn(
            "full",
            F.col("free").cast(big) * F.col("weight").cast("decimal(10,0)")
            > (F.col("source_size") * cap).cast(big) * F.col("open_weight").cast("decimal(18,0)"),
        )
    )
    level = F.when(~F.col("full"), F.col("free").cast("double") / F.col("open_weight").cast("double"))
    target = F.when(F.col("full"), F.col("source_size").cast("double") * float(cap)).otherwise(
        F.col("weight").cast("double")
        * F.first(level, ignorenulls=True).over(
            order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        )
    )
    whole = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(0).cast("long")
    return (
        levels.withColumn("target", target)
        .withColumn("whole", whole)
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("source_key", "source_size", "target", "whole", "rest")
    )


def _salted(df, other):
    """Join documents to their source's row, every source spread over ``SALTS`` keys."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return (
        _keyed(df)
        .withColumn("salt", F.pmod(F.col("h"), F.lit(SALTS)).cast("int"))
        .join(other.withColumn("salt", salts), ["source_key", "salt"])
        .drop("salt")
    )


def thresholds(sizes, weights=WEIGHTS, cap=CAP):
    """``targets`` with ``cut``: rows whose hash lies below it are taken once more."""
    state = staged(
        targets(sizes, weights, cap).withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("before", F.lit(0).cast("long")), "mix-targets"
    )
    kept = state.columns
    for bits in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        inside = _salted(sizes, state).where(
            F.shiftright("h", HASH_BITS - bits + LEVEL_BITS) == F.col("prefix")
        )
        buckets = (
            inside.groupBy("source_key", F.shiftright("h", HASH_BITS - bits).alias("bucket"))
            .agg(F.sum("size").alias("tokens"))
            .join(state, "source_key")
        )
        w = Window.partitionBy("source_key").orderBy("bucket")
        upto = F.col("before") + F.sum("tokens").over(w)
        crossing = (
            buckets.withColumn("upto", upto)
            .where(F.col("upto") > F.col("rest"))
            .groupBy("source_key")
            .agg(F.min(F.struct("bucket", "upto", "tokens")).alias("edge"))
        )
        state = staged(
            state.join(crossing, "source_key", "left").select(
                *[c for c in kept if c not in ("prefix", "before")],
                # -1: the budget is not used up, everything is taken
                F.coalesce(F.col("edge.bucket"), F.lit(-1)).alias("prefix"),
                F.coalesce(F.col("edge.upto") - F.col("edge.tokens"), F.col("before")).alias("before"),
                F.coalesce(F.col("edge.upto"), F.col("before")).alias("after"),
            ),
            "mix-level",
        )
    nearer = (F.col("after") - F.col("rest")) < (F.col("rest") - F.col("before"))
    cut = F.when(F.col("prefix") < 0, F.lit(1 << HASH_BITS)).otherwise(
        F.col("prefix") + nearer.cast("long")
    )
    return state.select("source_key", "source_size", "target", "whole", cut.alias("cut"))


def times(cap=CAP):
    """How often a row joined to its threshold is taken."""
    return F.least(F.lit(cap), F.col("whole") + (F.col("h") < F.col("cut")).cast("long"))


def mixed(sizes, weights=WEIGHTS, cap=CAP):
    """``measured`` rows with their source's size and target, and the words taken."""
    cuts = thresholds(sizes, weights, cap)
    return _salted(sizes, cuts).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times(cap)).alias("taken")
    )


def repeated(docs, weights=WEIGHTS, cap=CAP):
    """The mix itself: every document as often as it is taken, columns unchanged."""
    cuts = thresholds(staged(measured(docs), "mix-sizes"), weights, cap)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), "source", spread(F.col("doc_id")).alias("h"))
    copies = F.explode(F.array_repeat(F.lit(0), times(cap).cast("int")))
    return _salted(rows, cuts).select("row", copies.alias("copy")).select("row.*")


def op8_mix_sources(spark, sf_dir):
    """The mix of all documents by source weight."""
    return mixed(staged(measured(table(spark, sf_dir, "documents")), "mix-sizes"))


def op8_sql():
    return rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         {spread_sql('doc_id')} AS h FROM documents),
ranked AS (
  SELECT *, CAST(([5, 2, 1])[(rank - 1) % 3 + 1] AS BIGINT) AS weight FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sized GROUP BY source)),
filled AS (
  SELECT *, sum(source_size) OVER () - sum(source_size * 3) OVER o + source_size * 3 AS free,
         sum(weight) OVER (ORDER BY 3 * CAST(source_size AS DOUBLE) / weight, rank
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM ranked WINDOW o AS (ORDER BY 3 * CAST(source_size AS DOUBLE) / weight, rank
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
level AS (
  SELECT min_by(CAST(free AS DOUBLE) / CAST(open_weight AS DOUBLE), 3 * CAST(source_size AS DOUBLE) / weight)
         AS level FROM filled WHERE free * weight <= source_size * 3 * open_weight),
aimed AS (
  SELECT source, source_size,
         CASE WHEN free * weight > source_size * 3 * open_weight THEN CAST(source_size AS DOUBLE) * 3
              ELSE CAST(weight AS DOUBLE) * level END AS target FROM filled, level),
split AS (
  SELECT *, target - whole * source_size AS rest FROM (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
    FROM aimed)),
units AS (
  SELECT source, h, tokens, sum(tokens) OVER (PARTITION BY source ORDER BY h) AS upto
  FROM (SELECT source, h, sum(size) AS tokens FROM sized GROUP BY source, h)),
cuts AS (
  SELECT s.source, min(u.h) AS h, min_by(u.upto, u.h) AS upto, min_by(u.tokens, u.h) AS tokens
  FROM split s JOIN units u ON u.source IS NOT DISTINCT FROM s.source AND u.upto > s.rest GROUP BY s.source)
SELECT d.doc_id, d.size, s.source_size, s.target,
       CAST(d.size * least(3, s.whole + CASE WHEN c.h IS NULL OR d.h < c.h THEN 1
            WHEN d.h = c.h AND c.upto - s.rest < s.rest - (c.upto - c.tokens) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN split s ON d.source IS NOT DISTINCT FROM s.source
LEFT JOIN cuts c ON c.source IS NOT DISTINCT FROM s.source"""
