"""The queries of this folder: each operator over its whole table, and SQL for those that it can express."""

from __future__ import annotations

from . import exact_copies, mixing, nra, packing, preference, quality, sharding, simhash, spelling, surrogates, toxicity, url_lists, whitening
from .common import read
from .oracles import ORACLES


def _on(table, operator):
    return lambda spark, sf_dir: operator(read(spark, sf_dir, table))


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_temporal_url_lists": _on("pages", url_lists.judged_pages),
    "op2_preference_pairs": _on("conversations", preference.formatted_conversations),
    "op3_hypergeometric_shards": _on("documents", sharding.shard_documents),
    "op4_nra_top_k": _on("embeddings", nra.top_scores),
    "op5_surrogates": _on("documents", surrogates.surrogate_documents),
    "op6_recurrent_toxicity": lambda spark, sf_dir: toxicity.scored_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")),
    "op7_minimum_bin_slack": _on("documents", packing.pack_documents),
    "op8_bk_tree_near_duplicates": _on("documents", simhash.fingerprint_components),
    "op9_adaptive_quality": _on("documents", quality.judged_documents),
    "op10_water_filling_mix": _on("documents", mixing.mix_documents),
    "op11_spelling_variants": _on("documents", spelling.spelling_variants),
    "op12_exact_copies": _on("documents", exact_copies.marked_documents),
    "op13_lanczos_whitening": _on("embeddings", whitening.whitened_embeddings),
    "pipeline": _pipeline,
}
