"""The queries of the training-data operators, and SQL that gives the same rows where SQL can express them."""

from veritally.llm import bpe, divergence, exact, language, mixing, neighbours, quality, secrets, simhash, suffix, tokenfile, trie, urlfilter

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_url_filter": urlfilter.op2_url_filter,
    "op3_token_file": tokenfile.op3_token_file,
    "op4_exact_dedup": exact.op4_exact_dedup,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_language_id": language.op8_language_id,
    "op9_bpe_round_trip": bpe.op9_bpe_round_trip,
    "op10_suffix_dedup": suffix.op10_suffix_dedup,
    "op11_nearest_vectors": neighbours.op11_nearest_vectors,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_conversation_trie": trie.op13_conversation_trie,
}

ORACLE_SQL = {"op2_url_filter": urlfilter.OP2_SQL, "op4_exact_dedup": exact.OP4_SQL, "op6_secret_scan": secrets.OP6_SQL, "op12_source_divergence": divergence.OP12_SQL, "op13_conversation_trie": trie.OP13_SQL}
