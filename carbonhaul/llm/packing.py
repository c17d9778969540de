"""Best-fit packing of documents into sequences by linear grouping.

Lengths are whole numbers up to the capacity, so the documents' histogram has at most ``capacity``
rows and the whole plan is made from it, whatever the number of documents:

1. Lengths above a share of the capacity are sorted and split into groups of equal cardinality; each is
   rounded up to the largest of its group. What fills a sequence alone is left out.
2. The packing of these few sizes is optimised over configurations (fillings of one sequence): a
   linear programme whose columns are made by a knapsack, rounded to whole sequences.
3. The slots of a configuration get actual lengths of their group, largest first.
4. What is left over, and the small ones, go best-fit into the room that remains, longest first.

Where small documents abound, a high share leaves most to best-fit and wastes next to nothing; where
they are scarce, a low share lets the configurations do the work. Both plans are made (seconds, from
the histogram alone) and the one with fewer sequences is taken.

A plan is a list of runs: sequences with the same lengths in the same places. Documents find their
place by their rank among those of equal length: a number within the writing task, plus the counts
of earlier tasks. A length that a third of all documents share is ranked in as many tasks as it was
written by.

Defined cases: a null or empty text is one piece that holds the end id; repeated rows are packed
each for itself; ties in length are broken by task and order of reading; an empty table gives no
sequences; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, table
from .tokens import PIECES, pieces

CAPACITY = 2048
#: lengths of at most this part of the capacity are small, by plan
SMALL = (2, 5)
#: groups of large lengths, and rounds of new configurations
GROUPS, ROUNDS = 96, 100


def grouped(lengths, counts, groups=GROUPS):
    """Group number of each length (descending), by equal cardinality."""
    total, before = sum(counts), 0
    numbers = []
    for count in counts:
        numbers.append(before * groups // total)
        before += count
    dense = {g: i for i, g in enumerate(dict.fromkeys(numbers))}
    return [dense[g] for g in numbers]


def best_fillings(sizes, worth, capacity):
    """For each size the filling of one sequence that holds it and is worth most: worths, counts."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    sizes = np.asarray(sizes)
    for room in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        values = best[room - sizes[fits]] + worth[fits]
        i = int(values.argmax())
        if values[i] > best[room - 1]:
            best[room], taken[room] = values[i], fits[i]
        else:
            best[room] = best[room - 1]
    counts = np.zeros((len(sizes), len(sizes)), dtype="int64")
    for i, size in enumerate(sizes):
        counts[i, i] += 1
        room = capacity - size
        while room > 0:
            if taken[room] < 0:
                room -= 1
                continue
            counts[i, taken[room]] += 1
            room -= sizes[taken[room]]
    return best[capacity - sizes] + worth, counts


def configurations(sizes, demand, capacity, rounds=ROUNDS):
    """Configurations and how often each is used: a basis of the linear programme.

    Starts from sequences of a single size and replaces columns while a better filling exists; any
    round's basis is a valid plan, so the limit on rounds costs sequences, never documents.
    """
    k, ones, demand = len(sizes), np.ones(len(sizes)), np.asarray(demand, float)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        worths, columns = best_fillings(sizes, ones @ inverse, capacity)
        if worths.max() <= 1 + 1e-7:
            break
        use = inverse @ demand
        for i in np.argsort(-worths, kind="stable"):
            if worths[i] <= 1 + 1e-7:
                break
            step = inverse @ columns[i]
            if step.sum() <= 1 + 1e-7:  # no longer better than what came in before it
                continue
            ratio = np.where(step > 1e-9, np.maximum(use, 0) / np.maximum(step, 1e-9), np.inf)
            out = int(ratio.argmin())
            basis[:, out] = columns[i]
            # the inverse and the uses after one column is replaced
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
            use = use - step * ratio[out]
            use[out] = ratio[out]
    use = np.linalg.solve(basis, demand)
    return basis.round().astype("int64").T, np.maximum(use, 0)


def whole_uses(columns, use, demand):
    """Whole uses that never ask for more than there is."""
    left = np.array(demand, dtype="int64")
    whole = []
    for column, times in zip(columns, use):
        fits = int(min(left[column > 0] // column[column > 0]))
        n = min(int(times + 1e-9), fits)
        whole.append(n)
        left -= column * n
    for i in np.argsort([int(u) - u for u in use], kind="stable"):
        column = columns[i]
        if use[i] - int(use[i]) > 0.05 and (column <= left).all():
            whole[i] += 1
            left -= column
    return whole


class Room:
    """Runs by the room that is left in their sequences."""

    def __init__(self, capacity):
        self.capacity, self.runs, self.sizes = capacity, {}, []

    def add(self, lengths, count, room):
        if room not in self.runs:
            self.runs[room] = []
            bisect.insort(self.sizes, room)
        self.runs[room].append((lengths, count))

    def best_fit(self, length, count):
        """Put ``count`` documents where they leave least room."""
        while count:
            at = bisect.bisect_left(self.sizes, length)
            if at == len(self.sizes):
                lengths, n, room = (), -(-count // max(1, self.capacity // length)), self.capacity
            else:
                room = self.sizes[at]
                lengths, n = self.runs[room].pop()
                if not self.runs[room]:
                    del self.runs[room]
                    del self.sizes[at]
            used = min(n, count)
            if n > used:
                self.add(lengths, n - used, room)
            self.add((*lengths, length), used, room - length)
            count -= used


def plan(histogram, capacity=CAPACITY, groups=GROUPS, small=SMALL, rounds=ROUNDS):
    """Runs (lengths, number of sequences) that hold the documents of {length: count}."""
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    made = [_plan(histogram, capacity, groups, share, rounds) for share in small]
    return min(made, key=lambda runs: sum(n for _, n in runs))


def _plan(histogram, capacity, groups, small, rounds):
    left = {length: n for length, n in histogram.items() if n}
    room = Room(capacity)
    if capacity in left:
        room.add((capacity,), left.pop(capacity), 0)
    large = sorted((x for x in left if x > capacity // small), reverse=True)
    if large:
        numbers = grouped(large, [left[x] for x in large], groups)
        members = {}
        for length, g in zip(large, numbers):
            members.setdefault(g, []).append(length)
        sizes = [members[g][0] for g in sorted(members)]
        demand = [sum(left[x] for x in members[g]) for g in sorted(members)]
        columns, use = configurations(sizes, demand, capacity, rounds)
        for column, n in zip(columns, whole_uses(columns, use, demand)):
            _substitute(room, left, members, column, n, capacity)
    for length in sorted((x for x, n in left.items() if n), reverse=True):
        room.best_fit(length, left[length])
    return [run for runs in room.runs.values() for run in runs]


def _substitute(room, left, members, column, n, capacity):
    """Fill ``n`` sequences of a configuration with actual lengths, largest first."""
    wanted = [(int(g), int(m)) for g, m in enumerate(column) if m]
    while n and wanted:
        lengths, used = [], n
        for g, m in wanted:
            while not left.get(members[g][0]):
                members[g].pop(0)
            used = min(used, left[members[g][0]] // m)
        if used:
            for g, m in wanted:
                left[members[g][0]] -= m * used
                lengths += [members[g][0]] * m
        else:  # a group's length runs out inside a sequence
            used = 1
            for g, m in wanted:
                for _ in range(m):
                    while not left.get(members[g][0]):
                        members[g].pop(0)
                    left[members[g][0]] -= 1
                    lengths.append(members[g][0])
        room.add(tuple(lengths), used, capacity - sum(lengths))
        n -= used


class Places:
    """Sequence and offset of the documents of each length by their rank."""

    SHIFT = 44

    def __init__(self, runs):
        rows, filled, sequence = [], {}, 0
        for lengths, n in runs:
            offset = 0
            for length in lengths:
                start = filled.get(length, 0)
                rows.append((length, start, sequence, offset))
                filled[length] = start + n
                offset += length
            sequence += n
        rows.sort()
        columns = np.array(rows, dtype="int64").reshape(-1, 4).T
        self.keys = (columns[0] << self.SHIFT) + columns[1]
        self.start, self.sequence, self.offset = columns[1:]

    def find(self, lengths, ranks):
        at = np.searchsorted(self.keys, (lengths << self.SHIFT) + ranks, "right") - 1
        return self.sequence[at] + ranks - self.start[at], self.offset[at]


NUMBER = "task int, nth long"


def number(batches):
    """Number the rows of equal length within a task."""
    import pyarrow as pa

    task, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        nth = []
        for length in batch.column("length").to_pylist():
            nth.append(seen.get(length, 0))
            seen[length] = nth[-1] + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([task] * len(nth), pa.int32()), pa.array(nth, pa.int64())],
            names=[*batch.schema.names, "task", "nth"],
        )


def with_checksums(batches):
    """The unsigned crc32 of the ids in their place."""
    import pyarrow as pa

    for batch in batches:
        sums = [zlib.crc32(ids) for ids in batch.column("token_ids").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(sums, pa.int64())],
            names=[*batch.schema.names[:-1], "ids_crc32"],
        )


def pack(rows, capacity=CAPACITY, groups=GROUPS, small=SMALL, rounds=ROUNDS):
    """``rows`` (any frame with ``length``) with ``sequence_id`` and ``offset``.

    The rows are staged once, with their numbers; sequences are gapless from offset 0.
    """
    out = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(NUMBER).fields])
    return placed(rows.mapInArrow(number, out), capacity, groups, small, rounds)


def placed(numbered, capacity=CAPACITY, groups=GROUPS, small=SMALL, rounds=ROUNDS):
    """Rows numbered by ``number``, with their places instead of the numbers."""
    own = numbered.drop("task", "nth").schema
    numbered = staged(numbered, "packing-pieces")
    counts = numbered.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = staged(
        counts.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-counts"
    )
    histogram = dict(counts.groupBy("length").agg(F.sum("n")).collect())  # at most ``capacity`` rows
    places = Places(plan(histogram, capacity, groups, small, rounds))
    ranked = numbered.join(counts.drop("n"), ["length", "task"]).select(
        *own.names, (F.col("nth") + F.col("earlier")).alias("rank")
    )

    def put(batches):
        import pyarrow as pa

        for batch in batches:
            sequence, offset = places.find(
                batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    out = [*own.fields, *T.StructType.fromDDL("sequence_id long, offset long").fields]
    return ranked.mapInArrow(put, T.StructType(out))


def packed_documents(docs, capacity=CAPACITY, vocabulary="byte_bpe_50k"):
    """Every document's pieces with their token ids and their places."""
    found = pieces(docs, capacity, vocabulary, then=number, columns=f"{PIECES}, {NUMBER}")
    return placed(found, capacity)


def op1_packing(spark, sf_dir):
    """All documents in sequences of at most 2048 tokens."""
    return packed(table(spark, sf_dir, "documents"))


def packed(docs, capacity=CAPACITY):
    """Places of all pieces, with a checksum for the ids."""
    columns = f"{PIECES.replace('token_ids binary', 'ids_crc32 long')}, {NUMBER}"
    found = pieces(
        docs, capacity, then=lambda batches: number(with_checksums(batches)), columns=columns
    )
    return placed(found, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
