"""The numbered corpus queries and the SQL of those that SQL can express."""

from __future__ import annotations

from lumenframe.llm import alignment, decontaminate, language_id, ngram_join, packing, phrases, quality_classifier, quality_rules, substring_dedup, suffix_dedup, token_files, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_language_id": language_id.op7_language_id,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
    "op12_phrase_collocations": phrases.op12_phrase_collocations,
    "op13_token_files": token_files.op13_token_files,
}

ORACLES = {
    "op2_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op3_substring_dedup": substring_dedup.ORACLE_SQL,
    "op8_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op10_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op12_phrase_collocations": phrases.ORACLE_SQL,
}
