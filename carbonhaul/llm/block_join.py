"""Nearest neighbours by a block matrix join over int8 codes.

Every vector is scaled to length one and coded in int8 with its own scale; the length of what the
code misses is kept. The product of two tiles of codes gives all cosines of a query tile and a
candidate tile, each within a bound that follows from the two misses: for u = u' + e and
v = v' + f, |u.v - u'.v'| <= |e| + |f| (1 + |e|). A candidate survives if its upper bound reaches
the k-th best lower bound; survivors are recomputed in double precision from the original vectors
and merged into a heap for each query. So nothing is lost to the codes: recall is one.

Tiles are multiplied as float32, which holds every sum of int8 products below 2**24 exactly; longer
vectors use float64. For defined cases see ``vectors``; zero vectors take no part.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import functions as F

from .common import staged, table
from .vectors import block_search, valid_vectors

#: queries and candidates of one tile
TILE_QUERIES, TILE_ROWS = 256, 2048
#: above the rounding of double precision itself
SLACK = 1e-9


def coded(matrix):
    """int8 codes, their scales, and the length of what they miss of the unit vectors."""
    peak = np.abs(matrix).max(axis=1, keepdims=True)
    unit = matrix / peak  # first by the largest component: squares cannot overflow or vanish
    unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype("int8")
    missed = unit - codes * scale[:, None]
    return codes, scale, np.sqrt((missed * missed).sum(axis=1))


def cosines(query, rows):
    """Cosines in double precision, summed component by component."""
    dot, length, own = np.zeros(len(rows)), np.zeros(len(rows)), 0.0
    for d in range(len(query)):
        column = rows[:, d]
        dot += query[d] * column
        length += column * column
        own += query[d] * query[d]
    with np.errstate(all="ignore"):
        score = dot / (np.sqrt(own) * np.sqrt(length))
    bad = ~np.isfinite(score)
    if bad.any():  # squares beyond double precision: scale by the largest components first
        a = query / np.abs(query).max()
        b = rows[bad] / np.abs(rows[bad]).max(axis=1, keepdims=True)
        score[bad] = (b * a).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))
    return score


class QuantisedTiles:
    """Search of one block; see ``vectors.block_search``."""

    score_type = "double"

    def __init__(self, k):
        self.k = k

    def __call__(self, query_rows, queries, rows, ids, matrix):
        wide = "float32" if matrix.shape[1] * 127 * 127 < 2**24 else "float64"
        row_codes, row_scale, row_missed = coded(matrix)
        asked, ask_scale, ask_missed = coded(queries)
        for first in range(0, len(queries), TILE_QUERIES):
            tile = slice(first, first + TILE_QUERIES)
            heaps = [[] for _ in range(first, min(first + TILE_QUERIES, len(queries)))]
            for start in range(0, len(ids), TILE_ROWS):
                part = slice(start, start + TILE_ROWS)
                near = asked[tile].astype(wide) @ row_codes[part].astype(wide).T
                near = near * ask_scale[tile, None] * row_scale[None, part]
                slack = ask_missed[tile, None] + row_missed[None, part] * (1 + ask_missed[tile, None])
                self._merge(
                    heaps, near, slack + SLACK, query_rows[tile], queries[tile], rows[part], ids[part],
                    matrix[part],
                )
            for q, heap in enumerate(heaps):
                best = sorted(heap, reverse=True)
                yield (
                    first + q,
                    np.array([-i for _, i in best], "int64"),
                    np.array([s for s, _ in best], "float64"),
                )

    def _merge(self, heaps, near, slack, query_rows, queries, rows, ids, matrix):
        lower, upper = near - slack, near + slack
        for q, heap in enumerate(heaps):
            others = rows != query_rows[q]
            floor = heap[0][0] if len(heap) == self.k else -np.inf
            bounds = lower[q][others]
            if len(bounds) > self.k:
                floor = max(floor, np.partition(bounds, len(bounds) - self.k)[len(bounds) - self.k])
            able = np.flatnonzero(others & (upper[q] >= floor))
            for score, i in zip(cosines(queries[q], matrix[able]).tolist(), ids[able].tolist()):
                entry = (score, -i)
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)


def nearest(embeddings, is_query, k=5):
    """query_id, rank, vec_id, score of the k rows with the largest cosine for every query."""
    nonzero = F.exists("embedding", lambda x: x != 0)
    vectors = staged(valid_vectors(embeddings).where(nonzero), "ann-vectors")
    return block_search(vectors, is_query, QuantisedTiles(k), k)


def op10_nearest_neighbours(spark, sf_dir):
    """The five nearest rows for every fiftieth vector."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS length FROM v),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b)
           / (q.length * c.length) AS score
  FROM n q JOIN n c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5"""
