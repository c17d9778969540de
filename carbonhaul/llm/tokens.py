"""Token ids of a byte-level BPE vocabulary, and documents cut into pieces.

The vocabulary's splitter never joins what stands on both sides of a space, except that the space
goes with a following character other than white space. So a text is cut at these spaces, every
such word is encoded once per worker, and its ids are looked up from then on. New words are encoded
by tiktoken from the same vocabulary's ranks; texts with one of the characters on which the
libraries' white space differs go to the tokenizer itself. The store of words is bounded.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import lru_cache

from pyspark.sql import functions as F

from .common import schema, tokenizer_file

#: words kept by one worker, and the longest word that is kept
KEPT_WORDS, KEPT_LENGTH = 500_000, 48
#: the splitter of the vocabulary, as published with it
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNCOMMON = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]").search
SPACE_BEFORE_SPACE = re.compile(r" (?!\S)").search
WORD_STARTS = re.compile(r" (?=\S)").split


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file(f"{vocabulary}.json"))
        # a special token's string in a text is ordinary text
        self.tokenizer.encode_special_tokens = True
        with open(tokenizer_file(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.word_ids = tiktoken.Encoding(
            vocabulary, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.known = {}

    def encode(self, text):
        if UNCOMMON(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        words = WORD_STARTS(text) if SPACE_BEFORE_SPACE(text) else text.split(" ")
        known, first = self.known, array("I", self.word_ids(words[0])).tobytes()
        del words[0]
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > KEPT_WORDS:
                known.clear()
                new = set(words)
            passing = {}
            for word in new:
                ids = array("I", self.word_ids(" " + word)).tobytes()
                (known if len(word) <= KEPT_LENGTH else passing)[word] = ids
            if passing:
                return first + b"".join(
                    [passing[w] if w in passing else known[w] for w in words]
                )
        return first + b"".join(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def encoder(vocabulary):
    """One encoder per worker process."""
    return WordEncoder(vocabulary)


PIECES = "doc_id long, piece int, start long, length long, token_ids binary"


def pieces(docs, capacity, vocabulary="byte_bpe_50k", end_id=0, then=None, columns=PIECES):
    """doc_id, piece, start, length, token_ids of every document's pieces.

    A document's ids end with ``end_id``. Only longer ones are cut, into pieces of ``capacity``
    ids; the first piece takes what is left over, so that all others fill a sequence. ``then`` goes on
    with a task's batches of pieces in the same worker and makes ``columns`` of them: a second Python
    operator above would take a second worker, with its own memory, for each running task.
    """

    def cut(batches):
        import pyarrow as pa

        to_ids = encoder(vocabulary)
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            out = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = to_ids.encode(text or "") + end
                total = len(ids) // 4
                stop = (total - 1) % capacity + 1
                start = number = 0
                while start < total:
                    row = (doc, number, start, stop - start, ids[4 * start : 4 * stop])
                    for column, value in zip(out, row):
                        column.append(value)
                    start, stop, number = stop, stop + capacity, number + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)],
                names=["doc_id", "piece", "start", "length", "token_ids"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if then is None:
        return narrow.mapInArrow(cut, schema(PIECES))
    return narrow.mapInArrow(lambda batches: then(cut(batches)), schema(columns))
