"""A hash tree over a dataset, with the place of every leaf found by rank in bitmaps.

Each row is a leaf; per source, leaves stand in ascending order of doc_id, every 16 consecutive nodes
become one of the next level, and the sources' roots give the root of all in the same way.

The place of a leaf is a count of smaller ids, so nothing is sorted by id. Every task turns its ids
into one compressed bitmap per source and range of 65,536 ids: a bit field where it holds many, a list
of 16-bit numbers where it holds few, and beside it how often an id is repeated. The bitmaps of
a range are merged by "or". A merged bitmap has a directory of the bits before each 64-bit word,
and a directory over the ranges has the ids before each range. A row's
place is the sum of both and the bits of its word below it. Bitmaps and rows of one range
meet in one stream, bitmap first, so no row carries a bitmap.

Levels are reduced by the key (source, place / 16), each group an array of at most 16 slots. So a
source with a third of all rows is spread like all others. The other nodes of a run stand to the
left or to the right; from the root downwards every run gets the list of these pairs, from which
proofs and folded roots follow within a row.

Defined cases: null columns count as ``-``; a null doc_id comes before all others and is not tampered
with; a null source is a source of its own and the first one. Rows that repeat a doc_id within a source
follow each other in order of their leaves; repeated rows are leaves of their own, and ranked in one task for each
doc_id. Texts of any length are hashed in place. An empty table has no leaves and no root. Further columns
are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.ordering import positions
from .common import fold, lower_ascii, schema, staged, table

FANOUT = 16
#: an id's upper bits name its bitmap, its lower 16 bits are the place in it
LOW_BITS = 16
#: ids from which on a bit field is smaller than a list
DENSE = 4096
#: ids a task gathers before it hands out its bitmaps
GATHERED = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(column):
    """A value with its length in bytes in front."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs):
    """key (of the source), doc_id, leaf and tampered leaf (null where nothing is changed)."""
    text = F.col("text")
    hashed = lambda last: F.unhex(
        F.sha2(F.concat(*[framed(F.col(c)) for c in FIELDS[:-1]], framed(last)).cast("binary"), 256)
    )
    chosen = F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) == 0)
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        hashed(text).alias("leaf"),
        F.when(chosen, hashed(lower_ascii(text))).alias("tampered"),
    )


class Bitmap:
    """The ids of one range: present ones as a list or a bit field, and extra occurrences."""

    def __init__(self, lows, again, extra):
        self.lows, self.again, self.extra = lows, again, extra

    @classmethod
    def of(cls, lows, counts):
        several = counts > 1
        return cls(lows, lows[several], counts[several] - 1)

    def packed(self):
        head = np.array([len(self.lows), len(self.again)], "<u4").tobytes()
        if len(self.lows) > DENSE:
            bits = np.zeros(1 << LOW_BITS, bool)
            bits[self.lows] = True
            body = np.packbits(bits, bitorder="little").tobytes()
        else:
            body = self.lows.astype("<u2").tobytes()
        return head + body + self.again.astype("<u2").tobytes() + self.extra.astype("<i8").tobytes()

    @classmethod
    def unpacked(cls, data):
        n, repeated = np.frombuffer(data, "<u4", 2).tolist()
        if n > DENSE:
            body = np.frombuffer(data, "u1", (1 << LOW_BITS) // 8, 8)
            lows, at = np.flatnonzero(np.unpackbits(body, bitorder="little")), 8 + len(body)
        else:
            lows, at = np.frombuffer(data, "<u2", n, 8).astype("int64"), 8 + 2 * n
        again = np.frombuffer(data, "<u2", repeated, at).astype("int64")
        return cls(lows, again, np.frombuffer(data, "<i8", repeated, at + 2 * repeated))

    @property
    def total(self):
        return len(self.lows) + int(self.extra.sum())


class Merger:
    """The "or" of bitmaps; an id present on both sides is one more repetition."""

    def __init__(self):
        self.bits = np.zeros(1 << LOW_BITS, bool)
        self.extra = {}

    def add(self, other):
        both = other.lows[self.bits[other.lows]]
        self.bits[other.lows] = True
        for low in both.tolist():
            self.extra[low] = self.extra.get(low, 0) + 1
        for low, n in zip(other.again.tolist(), other.extra.tolist()):
            self.extra[low] = self.extra.get(low, 0) + n

    def result(self):
        again = np.array(sorted(self.extra), "int64")
        return Bitmap(
            np.flatnonzero(self.bits), again, np.array([self.extra[x] for x in again.tolist()], "int64")
        )


class Directory:
    """Rank queries on one bitmap."""

    def __init__(self, bitmap):
        bits = np.zeros(1 << LOW_BITS, bool)
        bits[bitmap.lows] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype("int64")
        self.before = np.concatenate(([0], np.cumsum(ones)[:-1]))
        self.again = bitmap.again
        self.extra_before = np.concatenate(([0], np.cumsum(bitmap.extra)))

    def rank(self, lows):
        """(leaves before the id, whether the id is repeated) for numbers in the bitmap."""
        word, bit = lows >> 6, (lows & 63).astype("u8")
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        rank = self.before[word] + np.bitwise_count(below)
        at = np.searchsorted(self.again, lows)
        repeated = np.zeros(len(lows), bool)
        inside = at < len(self.again)
        repeated[inside] = self.again[at[inside]] == lows[inside]
        return rank + self.extra_before[at], repeated


BITMAP = "key string, high long, total long, repeated long, data binary"


def _bitmap_batch(found):
    import pyarrow as pa

    rows = [(k, h, b.total, len(b.again), b.packed()) for k, h, b in found]
    columns = list(zip(*rows)) or [()] * 5
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)],
        ["key", "high", "total", "repeated", "data"],
    )


def _gather(batches):
    """A task's ids as bitmaps, handed out every ``GATHERED`` ids."""
    waiting, n = {}, 0

    def done():
        found = []
        for (key, high), parts in waiting.items():
            lows, counts = np.unique(np.concatenate(parts), return_counts=True)
            found.append((key, high, Bitmap.of(lows, counts)))
        return _bitmap_batch(found)

    for batch in batches:
        keys = batch.column("key").dictionary_encode()
        ids = batch.column("doc_id")
        missing = np.asarray(ids.is_null())
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        code = keys.indices.to_numpy(zero_copy_only=False)
        names = keys.dictionary.to_pylist()
        high, low = values >> LOW_BITS, values & ((1 << LOW_BITS) - 1)
        order = np.lexsort((high, missing, code))
        edges = np.flatnonzero(
            np.diff(code[order]) | np.diff(missing[order]) | np.diff(high[order])
        ) + 1
        for some in np.split(order, edges):
            if len(some):
                first = some[0]
                place = (names[code[first]], None if missing[first] else int(high[first]))
                waiting.setdefault(place, []).append(low[some])
        n += len(values)
        if n >= GATHERED:
            yield done()
            waiting, n = {}, 0
    yield done()


def _merge(batches):
    """Bitmaps in order of their range to one a range."""
    place, merger = None, None
    for batch in batches:
        found = []
        columns = [batch.column(c).to_pylist() for c in ("key", "high", "data")]
        for key, high, data in zip(*columns):
            if merger is None or place != (key, high):
                if merger is not None:
                    found.append((*place, merger.result()))
                place, merger = (key, high), Merger()
            merger.add(Bitmap.unpacked(data))
        yield _bitmap_batch(found)
    if merger is not None:
        yield _bitmap_batch([(*place, merger.result())])


def bitmaps(docs):
    """One merged bitmap for every source and range of ids, with the leaves before the range
    (``base``) and of the whole source (``size``)."""
    ids = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
    )
    merged = staged(
        ids.mapInArrow(_gather, schema(BITMAP))
        .repartition("key", "high").sortWithinPartitions("key", "high")
        .mapInArrow(_merge, schema(BITMAP)),
        "manifest-bitmaps",
    )
    # a source has one row for 65,536 ids here, without the bitmaps
    upto = Window.partitionBy("key").orderBy(F.col("high").asc_nulls_first())
    ranges = merged.select(
        "key", "high",
        (F.sum("total").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"),
        F.sum("total").over(Window.partitionBy("key")).alias("size"),
    )
    same = (F.col("m.key") == F.col("r.key")) & F.col("m.high").eqNullSafe(F.col("r.high"))
    return merged.alias("m").join(ranges.alias("r"), same).select(
        "m.key", "m.high", "r.base", "r.size", "m.repeated", "m.data"
    )


PLACED = "key string, size long, place long, repeated boolean, doc_id long, leaf binary, tampered binary"


def _rank(batches):
    """A range's bitmap, then its rows: rows with their places."""
    import pyarrow as pa

    directory, base, size = None, 0, 0
    for batch in batches:
        heads = np.flatnonzero(np.asarray(batch.column("data").is_valid()))
        lows = batch.column("doc_id").fill_null(0).to_numpy() & ((1 << LOW_BITS) - 1)
        heads = set(heads.tolist())
        edges = sorted(heads | {0, batch.num_rows})
        for start, stop in zip(edges, edges[1:]):
            if start in heads:
                head = batch.slice(start, 1).to_pylist()[0]
                directory = Directory(Bitmap.unpacked(head["data"]))
                base, size = head["base"], head["size"]
                start += 1
            if stop == start:
                continue
            rows, low = batch.slice(start, stop - start), lows[start:stop]
            rank, repeated = directory.rank(low)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("key"), pa.array(np.full(len(low), size, "int64")),
                    pa.array(base + rank), pa.array(repeated), rows.column("doc_id"),
                    rows.column("leaf"), rows.column("tampered"),
                ],
                ["key", "size", "place", "repeated", "doc_id", "leaf", "tampered"],
            )


def placed(docs):
    """key, size, place, doc_id, leaf, tampered of every row."""
    found = staged(bitmaps(docs), "manifest-ranges")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = found.select(
        "key", "high", "base", "size", "data", none("long", "doc_id"), none("binary", "leaf"),
        none("binary", "tampered"),
    )
    rows = leaves(docs).select(
        "key", F.shiftright("doc_id", LOW_BITS).alias("high"), none("long", "base"),
        none("long", "size"), none("binary", "data"), "doc_id", "leaf", "tampered",
    )
    several = found.agg(F.coalesce(F.sum("repeated"), F.lit(0))).first()[0]
    if several:  # the rows are needed twice
        rows = staged(rows, "manifest-leaves")
    ranked = (
        heads.unionByName(rows)
        .repartition("key", "high")
        .sortWithinPartitions("key", "high", F.col("data").isNull())
        .mapInArrow(_rank, schema(PLACED))
    )
    if not several:
        return ranked.drop("repeated")
    nth = F.row_number().over(Window.partitionBy("key", "doc_id").orderBy("leaf")) - 1
    again = ranked.where("repeated").withColumn("place", F.col("place") + nth)
    return ranked.where("NOT repeated").unionByName(again).drop("repeated")


def _hex(column):
    return F.lower(F.hex(column))


def _runs(nodes, *more):
    """Nodes (key, size, place, node) as arrays of slots, one row a run."""
    slot = F.struct((F.col("place") % FANOUT).cast("int").alias("slot"), "node", *more)
    return nodes.groupBy(
        "key", "size", F.shiftright("place", FANOUT.bit_length() - 1).alias("run")
    ).agg(F.array_sort(F.collect_list(slot)).alias("slots"))


def _parents(runs):
    """The nodes of the next level."""
    text = F.array_join(F.transform("slots", lambda s: _hex(s["node"])), "")
    return runs.select(
        "key", F.ceil(F.col("size") / FANOUT).cast("long").alias("size"),
        F.col("run").alias("place"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("node"),
    )


def reduce_levels(lowest, name):
    """(levels from the lowest upwards, roots by key) of runs ``lowest``.

    A level is a frame of runs of which each becomes a node; a key with a single node left is done
    and has it as its root.
    """
    levels = [lowest]
    roots = lowest.where("size = 1").select("key", F.col("slots")[0]["node"].alias("node"))
    while True:
        nodes = staged(_parents(levels[-1].where("size > 1")), f"{name}-nodes")
        roots = roots.unionByName(nodes.where("size = 1").select("key", "node"))
        if nodes.where("size > 1").isEmpty():
            return levels, staged(roots, f"{name}-roots")
        levels.append(staged(_runs(nodes.where("size > 1")), f"{name}-runs"))


def _step(slots, slot):
    """What stands left and right of a slot."""
    joined = lambda keep: F.array_join(
        F.transform(F.filter(slots, keep), lambda s: _hex(s["node"])), ""
    )
    return F.struct(
        joined(lambda s: s["slot"] < slot).alias("left"), joined(lambda s: s["slot"] > slot).alias("right")
    )


def _below(runs):
    """The nodes of runs that know the steps above them: key, place, path, root."""
    return runs.select("key", "run", "slots", "path", "root", F.explode("slots").alias("own")).select(
        "key",
        (F.col("run") * FANOUT + F.col("own.slot")).alias("place"),
        F.concat(F.array(_step(F.col("slots"), F.col("own.slot"))), F.col("path")).alias("path"),
        "root",
    )


def with_paths(levels, crowned):
    """The lowest runs with the steps from the node they become to the top, and the key's root.

    ``crowned`` gives a key's last run its path (the steps above the key's own root) and root.
    """
    known = None
    for level in reversed(levels):
        runs = crowned(level.where(f"size <= {FANOUT}"))
        if known is not None:
            runs = runs.unionByName(
                level.where(f"size > {FANOUT}").join(
                    known.withColumnRenamed("place", "run"), ["key", "run"]
                ).select(*runs.columns)
            )
        known = _below(runs)
    return runs


@dataclass
class Manifest:
    """The tree: runs of leaves per source, the levels above them, and the same over the sources."""

    levels: list
    subroots: object
    top_levels: list
    root: str | None


def manifest(docs):
    """The tree over ``docs``, all levels staged."""
    lowest = staged(
        _runs(placed(docs).withColumnRenamed("leaf", "node"), "doc_id", "tampered"), "manifest-runs"
    )
    levels, subroots = reduce_levels(lowest, "manifest")
    n = subroots.count()
    order = positions(subroots, "key").select("key", F.col("before").alias("place"))
    sources = subroots.join(order, "key").select(
        F.lit("all").alias("key"), F.lit(n).cast("long").alias("size"), "place", "node",
        F.col("key").alias("source_key"),
    )
    top_levels, roots = reduce_levels(staged(_runs(sources, "source_key"), "manifest-sources"), "top")
    root = roots.select(_hex(F.col("node"))).first()
    return Manifest(levels, subroots, top_levels, root[0] if root else None)


def proofs(tree):
    """doc_id, leaf, tampered, subroot, and path: the (left, right) steps from each leaf to the root."""
    none = F.array().cast("array<struct<left:string,right:string>>")
    end = lambda runs: runs.select("*", none.alias("path"), F.lit(tree.root).cast("string").alias("root"))
    tops = with_paths(tree.top_levels, end).select(
        F.explode("slots").alias("own"), "slots", "path", "size"
    ).select(
        F.col("own.source_key").alias("key"), _path().alias("path"),
        _hex(F.col("own.node")).alias("root"),
    )
    return with_paths(tree.levels, lambda runs: runs.join(tops, "key")).select(
        F.explode("slots").alias("own"), "slots", "path", "size", "root"
    ).select(
        F.col("own.doc_id").alias("doc_id"), _hex(F.col("own.node")).alias("leaf"),
        _hex(F.col("own.tampered")).alias("tampered"), F.col("root").alias("subroot"),
        _path().alias("path"),
    )


def _path():
    """The steps of one slot; a node that is alone is its own root, without a step."""
    own = F.array(_step(F.col("slots"), F.col("own.slot")))
    return F.when(F.col("size") > 1, F.concat(own, F.col("path"))).otherwise(F.col("path"))


def folded(leaf, path):
    """The root that follows from a leaf and its steps."""
    up = lambda node, s: F.sha2(
        F.concat(s["left"], node, s["right"]).cast("binary"), 256
    )
    return F.aggregate(path, leaf, up)


def proof_hash(path):
    siblings = F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
    return F.sha2(siblings.cast("binary"), 256)


def op12_merkle_manifest(spark, sf_dir):
    """Every document's leaf and proof, and whether its row, tampered with or not, fits the root."""
    tree = manifest(table(spark, sf_dir, "documents"))
    found = proofs(tree).select(
        "doc_id", "leaf", "subroot", F.lit(tree.root).cast("string").alias("root"),
        proof_hash(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_sql():
    framed_sql = " || ".join(
        f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in FIELDS
    )
    tampered = framed_sql.replace(
        "strlen(CAST(text AS VARCHAR)) || ':' || text",
        "strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
    )
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1
           THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS x(i))),
hashed AS (
  SELECT doc_id, source, sha256({framed_sql}) AS leaf, sha256({tampered}) AS lower_leaf,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
             list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 5 = 0 AS chosen
  FROM documents, crc),
placed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS row,
         coalesce('=' || source, '-') AS key,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
tree AS (
  SELECT key, 0 AS level, place, leaf AS node, count(*) OVER (PARTITION BY key) AS size FROM placed
  UNION ALL
  SELECT key, level + 1, place // 16, sha256(string_agg(node, '' ORDER BY place)),
         CAST((any_value(size) + 15) // 16 AS BIGINT)
  FROM tree WHERE size > 1 GROUP BY key, level, place // 16),
subroots AS (SELECT key, node FROM tree WHERE size = 1),
crown AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY key) - 1 AS place, node, count(*) OVER () AS size, key
  FROM subroots
  UNION ALL
  SELECT level + 1, place // 16, sha256(string_agg(node, '' ORDER BY place)),
         CAST((any_value(size) + 15) // 16 AS BIGINT), NULL
  FROM crown WHERE size > 1 GROUP BY level, place // 16),
root AS (SELECT node AS root FROM crown WHERE size = 1),
climb AS (
  SELECT p.row, p.key, false AS high, 0 AS level, p.place, '' AS siblings, t.size,
         CASE WHEN p.chosen THEN p.lower_leaf ELSE p.leaf END AS folded
  FROM placed p JOIN tree t ON t.key = p.key AND t.level = 0 AND t.place = p.place
  UNION ALL
  SELECT row, key, high, level + 1, place // 16, siblings || lefts || rights, (size + 15) // 16,
         sha256(lefts || folded || rights) FROM (
    SELECT c.row, c.key, c.high, c.level, c.place, c.siblings, c.size, c.folded,
           coalesce(string_agg(t.node, '' ORDER BY t.place) FILTER (t.place < c.place), '') AS lefts,
           coalesce(string_agg(t.node, '' ORDER BY t.place) FILTER (t.place > c.place), '') AS rights
    FROM climb c JOIN tree t ON t.key = c.key AND t.level = c.level AND t.place // 16 = c.place // 16
    WHERE c.size > 1 GROUP BY ALL)),
crowned AS (
  SELECT c.row, 0 AS level, k.place, c.siblings, k.size, c.folded
  FROM climb c JOIN crown k ON k.key = c.key AND k.level = 0 WHERE c.size = 1
  UNION ALL
  SELECT row, level + 1, place // 16, siblings || lefts || rights, (size + 15) // 16,
         sha256(lefts || folded || rights) FROM (
    SELECT c.row, c.level, c.place, c.siblings, c.size, c.folded,
           coalesce(string_agg(t.node, '' ORDER BY t.place) FILTER (t.place < c.place), '') AS lefts,
           coalesce(string_agg(t.node, '' ORDER BY t.place) FILTER (t.place > c.place), '') AS rights
    FROM crowned c JOIN crown t ON t.level = c.level AND t.place // 16 = c.place // 16
    WHERE c.size > 1 GROUP BY ALL))
SELECT p.doc_id, p.leaf, s.node AS subroot, r.root, sha256(c.siblings) AS proof_sha256,
       c.folded AS folded_root, c.folded = r.root AS verified
FROM placed p JOIN crowned c ON c.row = p.row AND c.size = 1 JOIN subroots s ON s.key = p.key CROSS JOIN root r"""
