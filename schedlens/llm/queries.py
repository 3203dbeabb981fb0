"""The registered corpus queries and the SQL that checks them."""

from __future__ import annotations

from schedlens.llm import (
    ann, exact_dedup, jaccard_join, license_scan, lm_score, merkle, packing, phrases, pii, quality, sentencepiece_chunks,
    simhash, token_shards,
)

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_quality": quality.op4_quality,
    "op5_ann": ann.op5_ann,
    "op6_simhash": simhash.op6_simhash,
    "op7_sentencepiece": sentencepiece_chunks.op7_sentencepiece,
    "op8_packing": packing.op8_packing,
    "op9_pii": pii.op9_pii,
    "op10_token_shards": token_shards.op10_token_shards,
    "op11_merkle": merkle.op11_merkle,
    "op12_jaccard_join": jaccard_join.op12_jaccard_join,
    "op13_phrases": phrases.op13_phrases,
}

ORACLE = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_license_scan": license_scan.ORACLE,
    "op8_packing": packing.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op12_jaccard_join": jaccard_join.ORACLE,
    "op13_phrases": phrases.ORACLE,
}
