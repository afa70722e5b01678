"""The registered queries of this subpackage and their oracles."""

from __future__ import annotations

from . import alignment, gridjoin, lm, maxscore, negatives, packing, pieces, quality, sharding, simhash, substring, tokenfile, toxicity


def queries():
    return {
        "op1_packing": packing.op1_packing,
        "op2_token_files": tokenfile.op2_token_files,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_substring_dedup": substring.op4_substring_dedup,
        "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
        "op6_exact_topk": maxscore.op6_exact_topk,
        "op7_lm_scoring": lm.op7_lm_scoring,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_sharding": sharding.op9_sharding,
        "op10_sentencepiece": pieces.op10_sentencepiece,
        "op11_embedding_near_dedup": gridjoin.op11_embedding_near_dedup,
        "op12_cross_tokenizer": alignment.op12_cross_tokenizer,
        "op13_hard_negatives": negatives.op13_hard_negatives,
    }


def oracle_sql():
    return {
        "op4_substring_dedup": substring.OP4_SQL,
        "op6_exact_topk": maxscore.OP6_SQL,
        "op9_sharding": sharding.OP9_SQL,
        "op11_embedding_near_dedup": gridjoin.OP11_SQL,
        "op13_hard_negatives": negatives.OP13_SQL,
    }
