"""Queries of this subpackage, and SQL for those that SQL can express."""

from pathline.llm import audit, contamination, counts, jaccard, pieces, pii, quality, secrets, shards, simhash, substrings, urls, whitening


def pipeline(spark, sf_dir: str):
    """`corpus_pipeline.run`, looked up when it is called: the operators stand without it."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_token_counts": counts.op3_token_counts,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_pii": pii.op5_pii,
    "op6_url_filters": urls.op6_url_filters,
    "op7_sharding": shards.op7_sharding,
    "op8_ngram_jaccard_join": jaccard.op8_ngram_jaccard_join,
    "op9_benchmark_decontamination": contamination.op9_benchmark_decontamination,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_simhash_near_dedup": simhash.op12_simhash_near_dedup,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
    "pipeline": pipeline,
}
ORACLES = {"op6_url_filters": urls.OP6_SQL, "op7_sharding": shards.OP7_SQL, "op1_substring_dedup": substrings.OP1_SQL, "op2_secret_scans": secrets.OP2_SQL, "op4_quality_rules": quality.OP4_SQL, "op8_ngram_jaccard_join": jaccard.OP8_SQL, "op9_benchmark_decontamination": contamination.OP9_SQL, "op11_filter_audit": audit.OP11_SQL}
