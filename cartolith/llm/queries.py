"""The registered queries of this subpackage and their SQL."""

from cartolith.llm import embedding_dedup, exact_dedup, fingerprints, jaccard_join, language_id, merkle, packing, phrases, quality, secrets, sharding, source_mix, toxicity

QUERIES = {
    "op1_ngram_jaccard_join": jaccard_join.op1_ngram_jaccard_join,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_source_mix": source_mix.op6_source_mix,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_sharding": sharding.op9_sharding,
    "op10_packing": packing.op10_packing,
    "op11_phrases": phrases.op11_phrases,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_fingerprints": fingerprints.op13_fingerprints,
}

ORACLE_SQL = {
    "op1_ngram_jaccard_join": jaccard_join.SQL,
    "op2_embedding_dedup": embedding_dedup.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op9_sharding": sharding.SQL,
    "op11_phrases": phrases.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_fingerprints": fingerprints.SQL,
}
