"""Exact top-k search by aggregation of sorted lists without random access.

The components of a block's vectors stand in one list each, of which the ends are known as if it were
sorted: the best and the worst contribution that a row not yet met in it can have. For a query the lists are read
one after the other, those first whose contributions differ most. Every row then has a lower bound (what
was read of it, and the worst of the lists still unread) and an upper bound (the best of those).
Reading ends when few rows are left whose upper bound reaches the k-th best lower bound; no outsider
can qualify. The scores of the rest are resolved, and ties go to the smaller id.

A query carries its k-th best score from block to block. Blocks are made of rows of similar length, the
longest first, so that bounds are high early; a block whose lists cannot reach the score together is not
read at all.

Scores are integers, ``floor(scale * x)`` of each component. They are exact for any size of component: blocks
whose sums could pass 2**53 are computed with Python's integers, and scores are clipped to 64 bits.
For defined cases see ``vectors``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .common import staged, table
from .vectors import block_search, valid_vectors

#: shares of a query's lists after which bounds are compared
STEPS = (0.25, 0.5, 0.625, 0.75, 0.8125, 0.875, 0.9375, 1.0)
#: rows of a task's group, and of the blocks that are read one after the other
GROUP, BLOCK = 16384, 4096


def scaled(matrix, scale):
    """Integer vectors; Python integers where 64-bit floats could not hold every sum."""
    values = np.floor(matrix * float(scale))
    high = np.abs(values).max(initial=0.0)
    if matrix.shape[1] * high * high < 2.0**53:
        return values.astype("int64")
    return np.array([[int(x) for x in row] for row in values], dtype=object)


def resolved(ids, scores, k):
    """The k best by score, then by smaller id."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Lists:
    """The lists of one block's components, with their ends."""

    def __init__(self, rows):
        self.values = np.ascontiguousarray(rows.T, dtype="float64")
        self.low, self.high = self.values.min(axis=1), self.values.max(axis=1)

    def ends(self, query):
        """Best and worst contribution of every list."""
        one, other = query * self.low, query * self.high
        return np.maximum(one, other), np.minimum(one, other)

    def qualified(self, query, k, floor, own, steps):
        """(numbers of the rows that may be among the k best with a score of at least ``floor``, the
        lists read for them)."""
        best, worst = self.ends(query)
        if best.sum() < floor:
            return np.empty(0, "int64"), 0
        order = np.argsort(worst - best, kind="stable")
        known = np.zeros(self.values.shape[1])
        if own is not None:
            known[own] = -np.inf
        alive, read = None, 0
        for share in steps:
            end = max(read + 1, int(round(len(order) * share)))
            some = order[read:end]
            if not len(some):
                continue
            values = self.values[some] if alive is None else self.values[np.ix_(some, alive)]
            known += query[some] @ values
            read = end
            left = order[read:]
            if len(known) > k:
                kth = np.partition(known, len(known) - k)[len(known) - k] + worst[left].sum()
                floor = max(floor, kth)
            able = np.flatnonzero(known + best[left].sum() >= floor)
            # rows that cannot qualify are not followed further, once that saves work
            if alive is None and len(able) > len(known) // 2:
                continue
            alive = able if alive is None else alive[able]
            known = known[able]
            if len(alive) <= 2 * k:
                break
        if alive is None:
            alive = np.flatnonzero(known + best[left].sum() >= floor)
        return alive, read


class NoRandomAccess:
    """Search of one group; see ``vectors.block_search``."""

    score_type = "long"

    def __init__(self, k, scale, steps=STEPS, block=BLOCK):
        self.k, self.scale, self.steps, self.block = k, scale, steps, block

    def __call__(self, query_rows, queries, rows, ids, matrix):
        values, asked = scaled(matrix, self.scale), scaled(queries, self.scale)
        if values.dtype == object or asked.dtype == object:
            yield from self._wide(query_rows, asked, rows, ids, values)
            return
        lengths = (values.astype("float64") ** 2).sum(axis=1)
        order = np.argsort(-lengths, kind="stable")
        asked = asked.astype("float64")
        best = [(np.empty(0, "int64"), np.empty(0, "int64")) for _ in query_rows]
        for start in range(0, len(order), self.block):
            part = order[start : start + self.block]
            lists, block_ids = Lists(values[part]), ids[part]
            at = {r: i for i, r in enumerate(rows[part].tolist())}
            for q, own in enumerate(query_rows.tolist()):
                known_ids, known = best[q]
                floor = known[-1] if len(known) == self.k else -np.inf
                some, _ = lists.qualified(asked[q], self.k, floor, at.get(own), self.steps)
                some = some[some != at.get(own, -1)]
                if not len(some):
                    continue
                scores = (asked[q] @ lists.values[:, some]).astype("int64")
                best[q] = resolved(
                    np.concatenate((known_ids, block_ids[some])), np.concatenate((known, scores)), self.k
                )
        yield from ((q, *found) for q, found in enumerate(best))

    def _wide(self, query_rows, asked, rows, ids, values):
        low, high = -(2**63), 2**63 - 1
        for q, own in enumerate(query_rows.tolist()):
            found = sorted(
                (-min(high, max(low, sum(a * b for a, b in zip(asked[q], x)))), int(i))
                for r, i, x in zip(rows, ids, values) if r != own
            )[: self.k]
            yield q, np.array([i for _, i in found], "int64"), np.array([-s for s, _ in found], "int64")


def top_k(embeddings, is_query, k=10, scale=1024):
    """query_id, rank, vec_id, score of the k best rows for every query."""
    vectors = staged(valid_vectors(embeddings), "topk-vectors")
    return block_search(vectors, is_query, NoRandomAccess(k, scale), k, GROUP)


def op9_exact_top_k(spark, sf_dir):
    """The ten best rows for every hundredth vector."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10"""
