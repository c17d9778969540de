"""Blocks of vectors for searches of a stated query set against all rows.

Every row has a number of its own, by whose hash rows are dealt into blocks of bounded size. Every pair of
a query block and a candidate block is one group, so a task holds two bounded blocks, whatever the table's size; each
group keeps only the best rows of its block for every query, and a window over those merges them.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; rows
that repeat a vec_id are rows like others: each is a candidate for all but itself, and each of them that is a
query has its own answer, under the same query_id; a query is compared with the vectors of its own
length only; a null vec_id takes no part; empty vectors take no part; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

#: rows of one block of candidates and of one block of queries
BLOCK = 4096


def valid_vectors(df):
    """row (a number), vec_id, embedding (array<double>), dim of the rows that take part.

    To be staged before use: the numbers are then fixed.
    """
    v = F.col("embedding")
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return (
        df.select("vec_id", v.cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .where(F.coalesce(finite, F.lit(False)))
        .select(
            F.monotonically_increasing_id().alias("row"), "vec_id", "embedding",
            F.size("embedding").alias("dim"),
        )
    )


def block_search(vectors, is_query, search, best, block=BLOCK):
    """The ``best`` rows of ``search(query_rows, queries, rows, ids, matrix)`` for every query.

    ``search`` gets one block of each side as numpy arrays and yields (query index, ids, scores)
    with the block's best rows. ``vectors`` is a staged frame of ``valid_vectors``.
    """
    n, n_queries = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_queries // block))
    kind = search.score_type
    dealt = F.xxhash64("row")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    candidates = vectors.select(
        "dim", F.pmod(dealt, F.lit(blocks)).cast("int").alias("cb"), every(query_blocks).alias("qb"),
        "row", "vec_id", "embedding",
    )
    queries = vectors.where(is_query).select(
        "dim", every(blocks).alias("cb"), F.pmod(dealt, F.lit(query_blocks)).cast("int").alias("qb"),
        "row", "vec_id", "embedding",
    )

    def pair(left, right):
        import pyarrow as pa

        names = ["query_row", "query_id", "vec_id", "score"]
        types = [pa.int64()] * 3 + [pa.int64() if kind == "long" else pa.float64()]
        found = [[], [], [], []]
        if left.num_rows and right.num_rows:
            query_rows, query_ids, queries = _matrix(left)
            rows, ids, matrix = _matrix(right)
            for q, some, scores in search(query_rows, queries, rows, ids, matrix):
                found[0].append(np.full(len(some), query_rows[q], dtype="int64"))
                found[1].append(np.full(len(some), query_ids[q], dtype="int64"))
                found[2].append(some)
                found[3].append(scores)
        columns = [np.concatenate(x) if x else np.empty(0, "int64") for x in found]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    keys = ["dim", "cb", "qb"]
    near = (
        queries.groupBy(*keys)
        .cogroup(candidates.groupBy(*keys))
        .applyInArrow(pair, f"query_row long, query_id long, vec_id long, score {kind}")
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (
        near.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= best)
        .select("query_id", "rank", "vec_id", "score")
    )


def _matrix(table):
    flat = table.column("embedding").combine_chunks()
    rows, ids = (table.column(c).to_numpy() for c in ("row", "vec_id"))
    return rows, ids, flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
