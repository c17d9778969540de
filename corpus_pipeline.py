"""The corpus pipeline: clean, deduplicate, mix and pack the documents.

Every stage works on all rows its predecessor kept, written as Parquet in the shared folder. All but
the last return the columns of ``documents``:

1. toxicity: documents that the model rejects go (``carbonhaul/llm/toxicity.py``).
2. near_duplicates: of each group linked by five-word shingles, at 80 percent similarity or more,
   the document with the smallest id stays, once (``carbonhaul/llm/parity_join.py``). Rows without a
   doc_id stay.
3. mixture: sources come near their target sizes, with documents repeated or left out
   (``carbonhaul/llm/mixing.py``).
4. packing: the places of all pieces in sequences of 2048 tokens (``carbonhaul/llm/packing.py``).

An empty table passes through all stages. No SQL can express the tokens and the trained model, so
``ORACLE_SQL`` is None and the stages are tested against plain Python.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from carbonhaul.llm import mixing, packing, parity_join, toxicity
from carbonhaul.llm.common import staged, table, text_session
from carbonhaul.session import prepare

#: near-duplicate stage
NGRAM, PERCENT = 5, 80


def remove_toxic(spark, docs, sf_dir):
    text_session(prepare(spark))
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark, docs, sf_dir):
    text_session(prepare(spark))
    found = staged(parity_join.joined(docs, NGRAM, PERCENT), "pipeline-components")
    own = found.where("component_id = doc_id").select("doc_id")
    # ids that stand in several rows are rare: only their rows are compared
    several = staged(own.groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-ids")
    # a row without an id equals nothing, so it stays; few documents go, so texts seldom move
    gone = staged(
        found.groupBy("doc_id").agg(F.bool_or(F.col("component_id") == F.col("doc_id")).alias("stays"))
        .where("NOT stays").select("doc_id"), "pipeline-gone"
    )
    if gone.count() <= parity_join.SMALL_IDS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if several.isEmpty():
        return kept
    once = kept.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("row")
    )
    return kept.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(
        once.select("doc_id", "row.*").select(*docs.columns)
    )


def mix_sources(spark, docs, sf_dir):
    text_session(prepare(spark))
    return mixing.repeated(docs)


def pack_sequences(spark, docs, sf_dir):
    text_session(prepare(spark))
    return packing.packed(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
