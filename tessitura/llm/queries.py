"""The queries of this subpackage, by name."""

from __future__ import annotations

from tessitura.llm import decontaminate, differencing, embeddings, lang_id, ngram_join, packing, periodic_runs, repeats, suffix_tree_lm, toxicity, url_filters, vector_codes, warc

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
    "op4_suffix_tree_scoring": suffix_tree_lm.op4_suffix_tree_scoring,
    "op5_warc_derivatives": warc.op5_warc_derivatives,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_suffix_array_dedup": repeats.op7_suffix_array_dedup,
    "op8_embedding_near_dedup": embeddings.op8_embedding_near_dedup,
    "op9_toxicity_crf": toxicity.op9_toxicity_crf,
    "op10_language_id": lang_id.op10_language_id,
    "op11_exponion_codes": vector_codes.op11_exponion_codes,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_differencing_packing": differencing.op13_differencing_packing,
}
#: Where SQL can express a query.
ORACLE_SQL = {
    "op3_ngram_jaccard_join": ngram_join.SQL,
    "op5_warc_derivatives": warc.SQL,
    "op6_url_filters": url_filters.SQL,
    "op8_embedding_near_dedup": embeddings.SQL,
    "op11_exponion_codes": vector_codes.SQL,
    "op12_periodic_runs": periodic_runs.SQL,
}
