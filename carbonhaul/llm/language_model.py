"""Likelihood of texts over the lattice of subword segmentations.

The vocabulary of a public tokenizer is taken as it is; its pieces' scores are learnt from the
training documents, as counts of the vocabulary's own segmentation of every word, weighted by the
word's count. A text's probability is then the sum over all segmentations of its words into pieces,
by a forward recursion in log space, and one end symbol. Pieces never cross white space, so a
text's log probability is a sum over its words, and the recursion runs once for every distinct word
of the corpus. Characters beyond the vocabulary have their byte pieces.

Words are counted over all documents with partial sums per task. The ``HOT`` most frequent words
(a fixed number whatever the corpus) are broadcast with their values and summed where the text is
read; all others go through a join on the word. So a word with a third of all tokens is never a
join key, and the word table itself, which grows with the corpus, is never broadcast.

Defined cases: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text is its end
symbol; a null doc_id counts as empty text for the fold; repeated rows are counted and scored each
for itself; unknown words get the smoothed probability of none; without training documents the
smoothed values hold; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import functions as F

from .common import fold, lowered, schema, staged, table, tokenizer_file

FOLDS = 10
SMOOTHING = 0.1
#: words whose values are broadcast
HOT = 200_000
#: words a task counts before it hands them on
HELD = 300_000
VOCABULARY = "piece_bpe_32k.model"


def word_counts(docs):
    """word, count: tokens in training documents; 0 for words of held-out ones only."""

    def count(batches):
        import pyarrow as pa

        def batch_of(words):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())],
                names=["word", "count"],
            )

        words = Counter()
        for batch in batches:
            for text, held_out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = lowered(text).split()
                if held_out:
                    for word in found:
                        words.setdefault(word, 0)
                else:
                    words.update(found)
                if len(words) > HELD:
                    yield batch_of(words)
                    words = Counter()
        yield batch_of(words)

    rows = docs.select("text", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"))
    return rows.mapInArrow(count, "word binary, count long").groupBy("word").agg(
        F.sum("count").alias("count")
    )


@lru_cache(maxsize=2)
def segmenter(vocabulary):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(vocabulary))


def piece_counts(words, vocabulary):
    """id, count of the pieces of all training tokens: at most one row per piece of the vocabulary."""

    def count(batches):
        import pyarrow as pa

        pieces = segmenter(vocabulary)
        total = np.zeros(pieces.get_piece_size(), "int64")
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            for ids, n in zip(pieces.encode(texts, num_threads=1), batch.column(1).to_pylist()):
                for i in ids:
                    total[i] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(total[some])], names=["id", "count"]
        )

    return (
        words.where("count > 0").select("word", "count")
        .mapInArrow(count, "id int, count long").groupBy("id").agg(F.sum("count").alias("count"))
    )


class Lattice:
    """Marginal log10 probabilities of words over all their segmentations."""

    def __init__(self, counts, ends, vocabulary):
        pieces = segmenter(vocabulary)
        usable = [
            i for i in range(pieces.get_piece_size())
            if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_unused(i))
        ]
        total = sum(counts.get(i, 0) for i in usable) + ends + SMOOTHING * (len(usable) + 1)
        self.pieces, self.bytes = {}, [0.0] * 256
        for i in usable:
            score = math.log((counts.get(i, 0) + SMOOTHING) / total)
            name = pieces.id_to_piece(i)
            if pieces.is_byte(i):
                self.bytes[int(name[3:5], 16)] = score
            else:
                self.pieces[name] = score
        self.longest = max(map(len, self.pieces), default=1)
        self.end = math.log((ends + SMOOTHING) / total) / math.log(10)

    def word(self, word):
        """log10 of the summed probability of all segmentations of a white-space word."""
        text = "▁" + word.decode("utf-8", "replace")
        get, exp, log, longest, single = self.pieces.get, math.exp, math.log, self.longest, self.bytes
        forward = [0.0]
        for j in range(1, len(text) + 1):
            # by the bytes of the last character, always possible
            best = forward[j - 1] + sum([single[b] for b in text[j - 1].encode("utf-8", "replace")])
            terms = [best]
            for i in range(max(0, j - longest), j):
                score = get(text[i:j])
                if score is not None:
                    score += forward[i]
                    terms.append(score)
                    if score > best:
                        best = score
            forward.append(best + log(sum([exp(t - best) for t in terms])))
        return forward[-1] / log(10)


def word_values(words, lattice, denominator):
    """word, count, base and lattice log10 probability of every distinct word."""

    def value(batches):
        import pyarrow as pa

        for batch in batches:
            counts = batch.column(1).to_numpy()
            base = np.log10((counts + SMOOTHING) / denominator)
            scores = [lattice.word(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(base), pa.array(scores, pa.float64())],
                names=["word", "count", "base", "score"],
            )

    return words.select("word", "count").mapInArrow(
        value, "word binary, count long, base double, score double"
    )


SUMMED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, "
    "score double, rest array<struct<word: binary, n: long>>"
)


def summed(docs, hot):
    """Every row's sums over the broadcast words, and its other words with their counts."""

    def add(batches):
        import pyarrow as pa

        index, counts, base, score = hot.value
        number = TaskContext.get().partitionId() << 40
        rest_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        for batch in batches:
            known, bases, scores, sizes, rests = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                words = lowered(text).split()
                at, times, rest = [], [], []
                for word, n in Counter(words).items():
                    i = index.get(word)
                    if i is None:
                        rest.append({"word": word, "n": n})
                    else:
                        at.append(i)
                        times.append(n)
                at, times = np.array(at, "int64"), np.array(times, "int64")
                sizes.append(len(words))
                known.append(int(times[counts[at] > 0].sum()))
                bases.append(float(times @ base[at]))
                scores.append(float(times @ score[at]))
                rests.append(rest)
            rows = np.arange(number, number + batch.num_rows, dtype="int64")
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows), batch.column(0), batch.column(2), pa.array(sizes, pa.int64()),
                    pa.array(known, pa.int64()), pa.array(bases, pa.float64()),
                    pa.array(scores, pa.float64()), pa.array(rests, rest_type),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rest"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
    )
    return rows.mapInArrow(add, schema(SUMMED))


def likelihoods(docs, vocabulary=VOCABULARY, hot=HOT):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    words = staged(word_counts(docs), "lm-words")
    ends = docs.where(fold(F.col("doc_id"), FOLDS) != 0).count()
    tokens, distinct = words.agg(
        F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("count") > 0)
    ).first()
    train_tokens = tokens + ends
    denominator = train_tokens + SMOOTHING * (distinct + (ends > 0) + 1)
    pieces = dict(piece_counts(words, vocabulary).collect())  # one row per piece at most
    lattice = Lattice(pieces, ends, vocabulary)
    values = staged(word_values(words, lattice, denominator), "lm-values")
    top = values.orderBy(F.desc("count"), "word").limit(hot).toArrow()
    names = top.column("word").to_pylist()
    table_of_hot = spark.sparkContext.broadcast((
        {w: i for i, w in enumerate(names)},
        *(top.column(c).to_numpy() for c in ("count", "base", "score")),
    ))
    rows = staged(summed(docs, table_of_hot), "lm-rows")
    rest = rows.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.n")
    n = F.col("n").cast("double")
    more = (
        rest.join(values, "word")
        .groupBy("row")
        .agg(
            F.sum(n * F.col("base")).alias("more_base"),
            F.sum(n * F.col("score")).alias("more_score"),
            F.sum(F.when(F.col("count") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        )
    )
    end_base = math.log10((ends + SMOOTHING) / denominator)
    zero = F.lit(0.0)
    return rows.drop("rest").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        (F.col("n_tokens") + 1).alias("n_tokens"),
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) + end_base).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero) + lattice.end).alias("score"),
    )


def op6_lattice_likelihood(spark, sf_dir):
    """Base and lattice log10 probability of every document."""
    return likelihoods(table(spark, sf_dir, "documents"))
