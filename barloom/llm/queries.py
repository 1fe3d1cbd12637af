"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from barloom.llm import bpe, lexical, media_gif, merkle, mixing, ngram_join, packing, pii, pipeline, quality, sharding, suffix_dedup, suffix_tree_lm, toxicity


def queries() -> dict:
    return {
        "pipeline": pipeline.run,
        "op1_mixing_sources": mixing.op1_mixing_sources,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_gif_media": media_gif.op3_gif_media,
        "op4_suffix_tree_lm": suffix_tree_lm.op4_suffix_tree_lm,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_packing": packing.op6_packing,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_pii": pii.op8_pii,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_sharding": sharding.op10_sharding,
        "op11_lexical_search": lexical.op11_lexical_search,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_bpe": bpe.op13_bpe,
    }


def oracle_sql() -> dict:
    return {"op1_mixing_sources": mixing.OP1_SQL, "op11_lexical_search": lexical.OP11_SQL, "op12_merkle_manifest": merkle.OP12_SQL}
