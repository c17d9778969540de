"""Queries of this package and, where SQL can express them, their SQL."""

import corpus_pipeline

from ..session import prepare
from . import (
    block_join,
    language_model,
    licences,
    manifest,
    mixing,
    packing,
    parity_join,
    repair,
    sharding,
    token_files,
    topk,
    toxicity,
    url_filter,
)

QUERIES = {
    "op1_packing": (packing.op1_packing, None),
    "op2_url_verdicts": (url_filter.op2_url_verdicts, url_filter.op2_sql()),
    "op3_shard_placement": (sharding.op3_shard_placement, sharding.op3_sql()),
    "op4_jaccard_join": (parity_join.op4_jaccard_join, parity_join.OP4_SQL),
    "op5_license_scan": (licences.op5_license_scan, None),
    "op6_lattice_likelihood": (language_model.op6_lattice_likelihood, None),
    "op7_toxicity": (toxicity.op7_toxicity, None),
    "op8_mix_sources": (mixing.op8_mix_sources, mixing.op8_sql()),
    "op9_exact_top_k": (topk.op9_exact_top_k, topk.OP9_SQL),
    "op10_nearest_neighbours": (block_join.op10_nearest_neighbours, block_join.OP10_SQL),
    "op11_conversation_repair": (repair.op11_conversation_repair, repair.op11_sql()),
    "op12_merkle_manifest": (manifest.op12_merkle_manifest, manifest.op12_sql()),
    "op13_token_files": (token_files.op13_token_files, None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}


def queries():
    def prepared(fn):
        def run(spark, sf_dir):
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        return run

    return {name: prepared(fn) for name, (fn, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
