"""Registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import chat, divergence, imatch, jaccard, langid, mix, pack, quality, shards, simhash, tokencount, tokenfile, trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_imatch": imatch.op1_imatch,
        "op2_pack_cut": pack.op2_pack_cut,
        "op3_token_counts": tokencount.op3_token_counts,
        "op4_token_files": tokenfile.op4_token_files,
        "op5_chat_trees": chat.op5_chat_trees,
        "op6_jaccard_join": jaccard.op6_jaccard_join,
        "op7_shard_hypergeometric": shards.op7_shard_hypergeometric,
        "op8_langid_centroids": langid.op8_langid_centroids,
        "op9_mix_poisson": mix.op9_mix_poisson,
        "op10_quality_rules": quality.op10_quality_rules,
        "op11_simhash": simhash.op11_simhash,
        "op12_prefix_trie": trie.op12_prefix_trie,
        "op13_divergence": divergence.op13_divergence,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_trees": chat.chat_sql(), "op6_jaccard_join": jaccard.jaccard_sql(), "op9_mix_poisson": mix.mix_sql(), "op10_quality_rules": quality.quality_sql(), "op12_prefix_trie": trie.trie_sql(), "op13_divergence": divergence.divergence_sql()}
