"""Toxicity by non-negative learning from positive and unlabelled texts.

Only rows that are confirmed toxic count as labelled; every training document, whatever its label,
is a sample of unlabelled text. With the share ``prior`` of toxic documents (that of the labelled
training rows), the risk of calling a clean text toxic is estimated as the risk over unlabelled
texts less ``prior`` times that over toxic ones. That difference cannot be negative for a true
model; where a batch makes it so, the step goes back instead of on, which keeps a flexible model
from memorising the positives.

Features are the distinct words of a text and their first letters, counted over all training
documents. Only a part of the toxic documents is confirmed, so a feature that occurs in toxic
documents alone is found in confirmed ones to that part; features are kept whose share of confirmed
documents surely reaches half of it, the most over-represented first. The linear model over them
is trained with numpy on a bounded sample: of the training rows those whose hash of doc_id and text is
smallest, ``POSITIVES`` confirmed and ``UNLABELLED`` others expected, never more than ``LIMIT``. Rows
that are equal in both are one row of the sample with their number as its weight. Counts of features, the prior, and the
scores cover all rows.

Defined cases: A-Z are lower-cased; a null or empty text has no features and gets the model's
score for none; a text of any length counts each feature once, and is read whole; without a confirmed toxic training
row every score is 0; features that tie are taken in the order of their bytes; rows that share a doc_id
share their fold and their labels (toxic if one of them says so), and each is scored by its own
text; repeated rows are scored alike; null labels are no labels; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from .common import WORD_BYTES, fold, lowered, schema, spread, staged, table

FOLDS = 5
#: expected numbers of confirmed toxic and of all training texts in the training sample
POSITIVES, UNLABELLED = 6_000, 20_000
#: rows of the training sample, in the order of their hash, that reach the driver at most
LIMIT = 2 * (POSITIVES + UNLABELLED)
#: features of the model, and in how many toxic texts one occurs at least
FEATURES, LEAST = 2_048, 4
#: part of the documents with a feature that must be toxic, by the lower end of its estimate
PURITY = 0.5
#: lengths of the first letters (bytes) that are features beside whole words
STARTS = (4, 5, 6)
#: features a task counts before it hands them on
HELD = 100_000
#: ids that are sent to every executor as they are; more of them are joined by shuffle
SMALL_IDS = 500_000

EPOCHS, BATCH, RATE, DECAY = 30, 2048, 0.05, 1e-4

find_words = re.compile(WORD_BYTES).findall


def features(text):
    """Distinct features of a text: ``=word`` and ``^start``."""
    words = set(find_words(lowered(text)))
    found = {b"=" + w for w in words}
    for n in STARTS:
        found |= {b"^" + w[:n] for w in words if len(w) >= n}
    return found


def training_rows(docs, labels):
    """doc_id, text, positive of the documents whose labels may be learnt."""
    toxic = (
        labels.where((F.col("toxic") == 1) & (fold(F.col("doc_id"), FOLDS) != 0))
        .select("doc_id").distinct().withColumn("positive", F.lit(1))
    )
    toxic = staged(toxic, "toxic-ids")
    if toxic.count() <= SMALL_IDS:
        toxic = F.broadcast(toxic)
    rows = docs.select("doc_id", "text").where(fold(F.col("doc_id"), FOLDS) != 0)
    return rows.join(toxic, "doc_id", "left").select(
        "doc_id", "text", F.coalesce("positive", F.lit(0)).alias("positive")
    )


def feature_counts(rows):
    """feature, positive, total: the documents each feature occurs in."""

    def count(batches):
        import pyarrow as pa

        def batch_of(total, positive):
            names = list(total)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.binary()),
                    pa.array([positive[x] for x in names], pa.int64()),
                    pa.array([total[x] for x in names], pa.int64()),
                ],
                names=["feature", "positive", "total"],
            )

        total, positive = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = features(text)
                total.update(found)
                if label:
                    positive.update(found)
                if len(total) > HELD:
                    yield batch_of(total, positive)
                    total, positive = Counter(), Counter()
        yield batch_of(total, positive)

    return (
        rows.select("text", "positive")
        .mapInArrow(count, "feature binary, positive long, total long")
        .groupBy("feature")
        .agg(F.sum("positive").alias("positive"), F.sum("total").alias("total"))
    )


def fit(docs, labels):
    """(features, weights, bias) of the model, or None without a confirmed toxic text."""
    rows = training_rows(docs, labels)
    learnt = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0))
    prior = learnt.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    n_all, n_toxic = rows.agg(F.count("*"), F.sum("positive")).first()
    if not n_toxic:
        return None
    share = F.lit(n_toxic / n_all)
    confirmed = n_toxic / (prior * n_all)
    # Wilson's lower bound, one standard deviation below
    n, q = F.col("total"), F.col("positive") / F.col("total")
    lower = (q + 0.5 / n - F.sqrt(q * (1 - q) / n + 0.25 / (n * n))) / (1 + 1 / n)
    over = F.col("positive") * F.log(F.col("positive") / (F.col("total") * share))
    chosen = (
        feature_counts(rows).where((F.col("positive") >= LEAST) & (lower >= PURITY * confirmed))
        .orderBy(F.desc(over), "feature").limit(FEATURES).select("feature").collect()
    )
    names = [bytes(r.feature) for r in chosen]
    index = {name: i for i, name in enumerate(names)}
    if not names:
        return names, np.zeros(0), math.log(max(prior, 1e-9) / max(1 - prior, 1e-9))

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            found = [
                np.array(sorted(index[x] for x in features(t).intersection(index)), "int32").tobytes()
                for t in batch.column(0).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()), *batch.columns[1:]],
                names=["found", "positive", "unlabelled", "n"],
            )

    def below(bound, n):
        return F.col("h") < min(1 << 60, int((1 << 60) * bound / max(1, n)))

    own = F.concat_ws(
        ":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")),
    )
    sample = (
        rows.withColumn("h", spread(own))
        .select(
            "h", "text", ((F.col("positive") == 1) & below(POSITIVES, n_toxic)).alias("positive"),
            below(UNLABELLED, n_all).alias("unlabelled"),
        )
        .where("positive OR unlabelled")
        .groupBy("h")
        .agg(F.first("text").alias("text"), F.first("positive").alias("positive"),
             F.first("unlabelled").alias("unlabelled"), F.count(F.lit(1)).alias("n"))
        .orderBy("h").limit(LIMIT).select("text", "positive", "unlabelled", "n")
    )
    out = schema("found binary, positive boolean, unlabelled boolean, n long")
    got = sample.mapInArrow(encode, out).toArrow()
    columns = (got.column(c).to_pylist() for c in ("found", "positive", "unlabelled", "n"))
    # order by content: the sample arrives in any order
    found = sorted(zip(*columns))
    positive = [(np.frombuffer(x, "int32"), n) for x, p, _, n in found if p]
    unlabelled = [(np.frombuffer(x, "int32"), n) for x, _, u, n in found if u]
    if not positive or not unlabelled:
        return names, np.zeros(len(names)), math.log(max(prior, 1e-9) / max(1 - prior, 1e-9))
    return names, *train(positive, unlabelled, len(names), prior)


def dense(rows, width):
    x = np.zeros((len(rows), width), "float32")
    for i, row in enumerate(rows):
        x[i, row] = 1.0
    return x


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def risk(w, toxic, unlabelled, prior):
    """(non-negative risk with the sigmoid loss, the step's direction).

    Both samples are (matrix, weights). Where the estimated risk of calling a clean text toxic is below zero,
    it counts as zero, and the step leads to a greater one.
    """
    x_p, n_p = toxic
    x_u, n_u = unlabelled
    p, u = sigmoid(x_p @ w[:-1] + w[-1]), sigmoid(x_u @ w[:-1] + w[-1])
    mean_p, mean_u = np.average(p, weights=n_p), np.average(u, weights=n_u)
    missed, clean = prior * (1 - mean_p), mean_u - prior * mean_p
    g_toxic = _gradient(x_p, p * (1 - p), n_p)
    g_clean = _gradient(x_u, u * (1 - u), n_u) - prior * g_toxic
    if clean >= 0:
        return missed + clean, g_clean - prior * g_toxic
    return missed, -g_clean


def train(positive, unlabelled, width, prior, epochs=EPOCHS, seed=7):
    """Weights and bias that minimise the non-negative risk, of texts as (feature numbers, weight)."""
    prior = min(max(prior, 1e-3), 0.5)
    rng = np.random.default_rng(seed)
    w, state = np.zeros(width + 1), [np.zeros(width + 1), np.zeros(width + 1)]
    w[-1] = -1.0
    steps = 0
    batches = max(1, -(-len(unlabelled) // BATCH))

    def part_of(rows, numbers):
        some = [rows[i] for i in numbers]
        return dense([x for x, _ in some], width), np.array([n for _, n in some], "float64")

    for _ in range(epochs):
        order = rng.permutation(len(unlabelled))
        for part in np.array_split(order, batches):
            some = rng.integers(0, len(positive), min(BATCH, max(64, len(positive))))
            _, step = risk(w, part_of(positive, some), part_of(unlabelled, part), prior)
            step[:-1] += DECAY * w[:-1]
            steps += 1
            state[0] = 0.9 * state[0] + 0.1 * step
            state[1] = 0.999 * state[1] + 0.001 * step * step
            w -= RATE * (state[0] / (1 - 0.9**steps)) / (
                np.sqrt(state[1] / (1 - 0.999**steps)) + 1e-8
            )
    return w[:-1], float(w[-1])


def _gradient(x, slope, weights):
    slope = slope * weights / weights.sum()
    return np.append(x.T @ slope.astype(x.dtype), slope.sum()).astype("float64")


def scored(docs, model):
    """doc_id, score of every row."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    probability = scorer(model)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(probability, batch.column(1).to_pylist()), pa.float64())],
                names=["doc_id", "score"],
            )

    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    return docs.select("doc_id", "text").mapInArrow(score, schema(out))


def scorer(model):
    """Text to probability, for use in tasks."""
    names, weights, bias = model
    known = {n: float(w) for n, w in zip(names, weights)}

    def probability(text):
        # summed in a fixed order: equal texts score alike
        z = bias + math.fsum(known[x] for x in features(text).intersection(known))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))

    return probability


def without_toxic(docs, labels):
    """The documents whose score is below one half, columns unchanged."""
    model = fit(docs, labels)
    if model is None:
        return docs
    probability = scorer(model)

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(probability, na_action=None)

    score = score.asNondeterministic()  # once per row
    return docs.where(score(F.col("text")) < 0.5)


def op7_toxicity(spark, sf_dir):
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
