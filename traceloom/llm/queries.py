"""Registered queries of the operators, and the SQL that must agree with them where SQL can say it."""

from . import (bpe_tree, hmm, lexical_search, line_dedup, minhash, packing, quality_model, quality_rules, secrets, simhash,
               token_counts, vector_search, whitening)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_byte_bpe": bpe_tree.op2_byte_bpe,
    "op3_packing": packing.op3_packing,
    "op4_near_duplicates": minhash.op4_near_duplicates,
    "op5_quality": quality_model.op5_quality,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_top_k": vector_search.op8_top_k,
    "op9_secrets": secrets.op9_secrets,
    "op10_lm_scores": hmm.op10_lm_scores,
    "op11_whitening": whitening.op11_whitening,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_simhash": simhash.op13_simhash,
}

ORACLE = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op8_top_k": vector_search.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
}
