"""Token ids in binary files of word-aligned Simple-8b blocks.

A 64-bit word holds a selector in its upper four bits and as many ids as fit its width in the others:
one of 60 bits, two of 30, ... sixty of one bit. At every place the selector that takes most ids is
chosen. An escape stands for a run: one id of 32 bits and how often it follows itself, where the run is
longer than a packing. Ids too wide for a packing have a word to themselves.

Files hold segments, each of them readable on its own, all numbers little-endian and 64 bits wide:

=========  =======================================================================================
magic      ``TOKENS8B``
sizes      numbers of documents, blocks and words
documents  their doc_ids; their numbers of ids; 1 where the doc_id is null, else 0
blocks     their numbers of ids, at most ``BLOCK``, and the words they start at; a block belongs to
           one document
words      the coded ids
trailer    ``\\nEND8B\\n\\n``
=========  =======================================================================================

Words are aligned to eight bytes in the file and never span two blocks, so a reader takes any block by
its offset, and decodes all words of one selector at once.

Spark sorts the documents by ranges of doc_id and writes each range to files whose names are in order. A
segment is a row of the text writer, whose line separator is the trailer, so commits, retries and
lost executors are handled as for any table, on any file system. Texts are encoded after
the sort, once. ``index`` gives the number of ids before each file.

Defined cases: a null or empty text has no ids but the end id; a null doc_id comes first; rows that
repeat a doc_id stand in the order in which they were read, over several files if they are many; a text of any
length is one document, cut into blocks; an empty table gives no segment and no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import schema, scratch_path, staged, table
from .tokens import encoder

MAGIC, TRAILER = b"TOKENS8B", b"\nEND8B\n\n"
#: ids of a word by selector, each of 60 // count bits
COUNTS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
WIDTHS = tuple(60 // n for n in COUNTS)
#: the escape, and the bits of its number of repetitions
RUN, RUN_BITS = 15, 28
TAKEN = np.array((*COUNTS, 0, 0))
#: selectors whose windows are looked at from every place, and not only where the one before fits
WHOLE_WINDOWS = 4
#: ids of a block, at most; ids from which on a segment is closed; segments of a file
BLOCK, SEGMENT_IDS, FILE_SEGMENTS = 1 << 16, 1 << 19, 32
#: ids packed at once, so that their arrays stay in the processor's cache
STRIDE = 1 << 16


def _steps(ids, ends):
    """The selector of a word that starts at each place, and the ids that it takes."""
    n, place = len(ids), np.arange(len(ids), dtype="i4")
    left = np.repeat(ends.astype("i4"), np.diff(ends, prepend=0)) - place
    choice = np.zeros(n, "i1")
    # the largest id of the next so many; what fits in many fits in fewer
    window = ids.astype("u2") if ids.max() < 1 << 16 else ids
    for selector in range(1, WHOLE_WINDOWS):
        window = np.maximum(window[:-1], window[1:])
        fits = (window >> WIDTHS[selector] == 0) & (left[: len(window)] >= COUNTS[selector])
        choice[: len(window)][fits] = selector
    some = np.flatnonzero(choice == WHOLE_WINDOWS - 1)
    largest = ids[some]
    for i in range(1, COUNTS[WHOLE_WINDOWS - 1]):
        largest = np.maximum(largest, ids[some + i])
    for selector in range(WHOLE_WINDOWS, len(COUNTS)):
        inside = left[some] >= COUNTS[selector]
        some, largest = some[inside], largest[inside]
        for i in range(COUNTS[selector - 1], COUNTS[selector]):
            largest = np.maximum(largest, ids[some + i])
        fits = largest >> WIDTHS[selector] == 0
        some, largest = some[fits], largest[fits]
        if not len(some):
            break
        choice[some] = selector
    # runs end where the id changes, or the block ends
    last = np.ones(n, bool)
    last[:-1] = ids[1:] != ids[:-1]
    last[ends[ends > 0] - 1] = True
    edges = np.flatnonzero(last).astype("i4") + 1
    alike = np.repeat(edges, np.diff(edges, prepend=0)) - place
    step = TAKEN[choice]
    runs = alike > step
    choice[runs], step[runs] = RUN, alike[runs]
    return choice, step


def packed(ids, ends):
    """Simple-8b words (uint64) of ids below 2**32, and the words at which the blocks start.

    ``ends`` are the places at which the blocks end, in order.
    """
    ids, ends = np.ascontiguousarray(ids, "u4"), np.asarray(ends, "i8")
    n = len(ids)
    if n >= 1 << RUN_BITS:
        raise ValueError("pack fewer ids at a time")
    if not n:
        return np.empty(0, "u8"), np.zeros(len(ends), "i8")
    choice, step = _steps(ids, ends)
    place = np.arange(n)
    starts, at, jump = [], 0, (place + step).tolist()
    while at < n:
        starts.append(at)
        at = jump[at]
    starts = np.array(starts)
    selector = choice[starts]
    words = np.empty(len(starts), "u8")
    for s in np.unique(selector).tolist():
        where = np.flatnonzero(selector == s)
        at = starts[where]
        if s == RUN:
            body = ids[at] | (step[at].astype("u8") << np.uint64(32))
        else:
            body = ids[at].astype("u8")
            for i in range(1, COUNTS[s]):
                body |= ids[at + i].astype("u8") << np.uint64(i * WIDTHS[s])
        words[where] = body | (np.uint64(s) << np.uint64(60))
    return words, np.searchsorted(starts, ends - np.diff(ends, prepend=0))


def unpacked(words):
    """The ids (uint32) of Simple-8b words."""
    words = np.asarray(words, "u8")
    selector = (words >> np.uint64(60)).astype("i8")
    counts = TAKEN[selector]
    run = selector == RUN
    counts[run] = (words[run] >> np.uint64(32)).astype("i8") & ((1 << RUN_BITS) - 1)
    starts = np.cumsum(counts) - counts
    ids = np.empty(int(counts.sum()), "u4")
    for s in np.unique(selector).tolist():
        where = np.flatnonzero(selector == s)
        body, at = words[where], starts[where]
        if s == RUN:
            lengths = counts[where]
            inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            ids[np.repeat(at, lengths) + inside] = np.repeat(body.astype("u4"), lengths)
        else:
            mask = np.uint64((1 << WIDTHS[s]) - 1)
            for i in range(COUNTS[s]):
                ids[at + i] = (body >> np.uint64(i * WIDTHS[s])) & mask
    return ids


def segment(doc_ids, parts):
    """The bytes of a segment, without its trailer, of documents and their ids as bytes."""
    sizes = np.array([len(p) // 4 for p in parts], "i8")
    blocks = [
        min(BLOCK, size - at) for size in sizes.tolist() for at in range(0, max(size, 1), BLOCK)
    ]
    ends = np.cumsum(np.array(blocks, "i8"))
    ids = np.frombuffer(b"".join(parts), "<u4")
    words, offsets, done, first = [], [], 0, 0
    # bounded steps, always whole blocks
    while first < len(blocks):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + STRIDE, "right")))
        some, starts = packed(ids[base : ends[last - 1]], ends[first:last] - base)
        words.append(some)
        offsets.append(starts + done)
        done, first = done + len(some), last
    missing = np.array([d is None for d in doc_ids], "i8")
    columns = (
        np.array([len(sizes), len(blocks), done], "<i8"),
        np.array([0 if d is None else d for d in doc_ids], "<i8"), sizes.astype("<i8"),
        missing.astype("<i8"), np.array(blocks, "<i8"), np.concatenate(offsets).astype("<i8"),
        np.concatenate(words).astype("<u8"),
    )
    return MAGIC + b"".join(c.tobytes() for c in columns)


class Segment:
    """A segment in a file's bytes, from ``at`` on."""

    def __init__(self, data, at):
        if bytes(data[at : at + 8]) != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        documents, blocks, words = np.frombuffer(data, "<i8", 3, at + 8).tolist()
        at += 32
        self.doc_ids, self.sizes, self.missing = np.frombuffer(data, "<i8", 3 * documents, at).reshape(3, -1)
        at += 24 * documents
        self.block_sizes, self.offsets = np.frombuffer(data, "<i8", 2 * blocks, at).reshape(2, -1)
        at += 16 * blocks
        self.words = np.frombuffer(data, "<u8", words, at)
        self.end = at + 8 * words + len(TRAILER)
        if bytes(data[self.end - len(TRAILER) : self.end]) != TRAILER:
            raise ValueError(f"the segment before byte {self.end} has no trailer")

    def block(self, number):
        """The ids of one block, without decoding others."""
        stop = self.offsets[number + 1] if number + 1 < len(self.offsets) else len(self.words)
        return unpacked(self.words[self.offsets[number] : stop])


def segments(data):
    """The segments of a file."""
    at = 0
    while at < len(data):
        found = Segment(data, at)
        yield found
        at = found.end


def write_files(docs, path, vocabulary="byte_bpe_50k", end_id=2, file_segments=FILE_SEGMENTS):
    """Write the ids of all documents in ascending doc_id order below ``path``/ids."""

    def encoded(batches):
        import pyarrow as pa

        to_ids, end = encoder(vocabulary), array("I", [end_id]).tobytes()
        doc_ids, parts, n = [], [], 0

        def closed():
            return pa.RecordBatch.from_arrays(
                [pa.array([segment(doc_ids, parts)], pa.binary())], ["segment"]
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = to_ids.encode(text or "") + end
                doc_ids.append(doc)
                parts.append(ids)
                n += len(ids) // 4
                if n >= SEGMENT_IDS:
                    yield closed()
                    doc_ids, parts, n = [], [], 0
        if doc_ids:
            yield closed()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        # tells rows of the same doc_id apart, so that many of them are not one range
        F.monotonically_increasing_id().alias("row"),
    )
    order = (F.col("doc_id").asc_nulls_first(), F.col("row").asc())
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    (
        ranges.mapInArrow(encoded, schema("segment binary"))
        .select(F.col("segment").cast("string"))
        .write.option("lineSep", TRAILER.decode())
        .option("maxRecordsPerFile", file_segments)
        .text(f"{path}/ids")
    )


def _files(spark, path):
    return spark.read.format("binaryFile").load(f"{path}/ids").select(
        F.regexp_extract("path", r"[^/]*$", 0).alias("file"), "content"
    )


def _starts(totals):
    """``totals`` (file, documents, ids), one row a file, with the ids of all files before each."""
    part = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    split = F.regexp_extract("file", r"-c(\d+)", 1).cast("long")
    # one row a file, not a document
    before = Window.orderBy(part, split).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("*", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))


def index(spark, path):
    """One row a file: file, documents, ids, and start, the ids of all files before it; from the
    segments' headers alone."""

    def totals(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[], [], []]
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = [(len(s.sizes), int(s.sizes.sum())) for s in segments(data.as_buffer())]
                for column, value in zip(out, (name, *map(sum, zip((0, 0), *found)))):
                    column.append(value)
            types = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], ["file", "documents", "ids"]
            )

    found = _files(spark, path).mapInArrow(totals, schema("file string, documents long, ids long"))
    return _starts(found)


def read_files(spark, path, with_ids=False):
    """doc_id, start, n_tokens and ids_crc32 of all documents, with their ids (binary) on request."""

    def decoded(batches):
        import pyarrow as pa

        names = ["file", "inside", "doc_id", "n_tokens", "ids_crc32", *["ids"] * with_ids]
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                inside = 0
                for s in segments(data.as_buffer()):
                    ids = unpacked(s.words).astype("<u4", copy=False).data.cast("B")
                    ends = np.cumsum(s.sizes)
                    starts = ends - s.sizes
                    cuts = list(zip((4 * starts).tolist(), (4 * ends).tolist()))
                    columns = [
                        pa.array([name] * len(cuts), pa.string()), pa.array(inside + starts),
                        pa.array(s.doc_ids.copy(), mask=s.missing.astype(bool)),
                        pa.array(s.sizes.copy()),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in cuts], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([bytes(ids[a:b]) for a, b in cuts], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)
                    inside += int(s.sizes.sum())

    out = "file string, inside long, doc_id long, n_tokens long, ids_crc32 long"
    found = _files(spark, path).mapInArrow(decoded, schema(out + ", ids binary" * with_ids))
    # decoded once, for the rows and for the totals of the files
    found = staged(found, "token-rows")
    totals = found.groupBy("file").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("ids")
    )
    starts = _starts(totals).select("file", F.col("start").alias("file_start"))
    return found.join(starts, "file").select(
        "doc_id", (F.col("file_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32",
        *["ids"] * with_ids,
    )


def op13_token_files(spark, sf_dir):
    """All documents' ids written to files and read back."""
    path = scratch_path(spark, "token-files")
    write_files(table(spark, sf_dir, "documents"), path)
    return read_files(spark, path)
