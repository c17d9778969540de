"""Apply and check what a table definition declares."""

from functools import reduce

from pyspark.sql import functions as F

REASONS = "reject_reasons"


def reasons(rules):
    """Names of the violated rules: {name: condition that must hold} -> array column.

    A condition that is NULL counts as violated.
    """
    return F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(condition, F.lit(False)), F.lit(None).cast("string")).otherwise(
                    F.lit(name)
                )
                for name, condition in rules.items()
            ]
        )
    )


def pinned(df):
    """The same rows, with a one-element explode on top.

    A filter moves below a projection by substituting the projected expressions, as often as it
    mentions them. Above expressions that are long or costly (a parser, a list of rules) that
    repeats the work many times; a generator's output stops the move.
    """
    return df.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")


def split(df):
    """(accepted, quarantined) of a frame that carries the reasons column."""
    return (
        df.where(F.size(REASONS) == 0).drop(REASONS),
        df.where(F.size(REASONS) > 0),
    )


def conform(df, spec):
    """Project onto the table's columns: absent ones take their default, generated ones are
    always computed, all are cast to the declared type."""
    present = set(df.columns)

    def source(column):
        if column in present:
            return F.col(column)
        return F.expr(spec.defaults.get(column, "NULL"))

    plain = df.select(
        *[source(f.name).cast(f.dataType).alias(f.name)
          for f in spec.schema if f.name not in spec.generated]
    )
    computed = plain.select(
        "*", *[F.expr(sql).alias(column) for column, sql in spec.generated.items()]
    )
    return computed.select(*[F.col(f.name).cast(f.dataType) for f in spec.schema])


def rules(spec):
    """All declared conditions: NOT NULL columns and CHECKs."""
    return {
        **{f"not_null_{c}": F.col(c).isNotNull() for c in spec.required},
        **{name: F.expr(sql) for name, sql in spec.checks.items()},
    }


def with_reasons(df, spec):
    return pinned(df.withColumn(REASONS, reasons(rules(spec))))


def check_violations(df, spec):
    """One row per CHECK with the number of refused rows; a single pass over the table."""
    counted = df.agg(
        *[
            F.count_if(~F.coalesce(F.expr(sql), F.lit(False))).alias(name)
            for name, sql in spec.checks.items()
        ]
    )
    return counted.select(
        F.lit(spec.name).alias("table_name"),
        F.explode(
            F.map_from_arrays(
                F.array(*[F.lit(n) for n in spec.checks]),
                F.array(*[F.col(n) for n in spec.checks]),
            )
        ).alias("constraint_name", "violations"),
    )


def check_reasons(df, spec, key=(), taken=None):
    """The rows with the names of the rules they break (NOT NULL, CHECK), and ``primary_key`` where
    several rows have the ``key`` or ``taken`` (stored rows) has it."""
    broken = rules(spec)
    key = list(key)
    if not key:
        return pinned(df.withColumn(REASONS, reasons(broken)))
    twice = key_violations(df, key).select(*key)
    twice = twice if taken is None else twice.unionByName(taken.select(*key)).distinct()
    marked = df.join(twice.withColumn("_twice", F.lit(True)), key, "left").select(
        *df.columns, "_twice"
    )
    broken["primary_key"] = F.col("_twice").isNull()
    return pinned(marked.withColumn(REASONS, reasons(broken)).drop("_twice"))


def key_violations(df, key):
    """Key values held by more than one row (partial counts precede the shuffle)."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def union_all(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)
