"""Queries of the training-data operators: whole tables, production parameters, full results."""

from newsdesk.llm import alignment, decontaminate, langid, main_text, minhash, packing, periodic, pieces, pii, repeats, spotsigs, toxicity, warc

QUERIES = {
    "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
    "op4_html_extraction": main_text.op4_html_extraction,
    "op10_warc": warc.op10_warc,
    "op2_document_fingerprints": spotsigs.op2_document_fingerprints,
    "op3_language_id": langid.op3_language_id,
    "op5_suffix_array_dedup": repeats.op5_suffix_array_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_pii": pii.op8_pii,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_sentencepiece": pieces.op12_sentencepiece,
    "op13_token_alignment": alignment.op13_token_alignment,
}
ORACLES = {
    "op1_minhash_near_dedup": minhash.ORACLE,
    "op10_warc": warc.ORACLE,
    "op9_benchmark_decontamination": decontaminate.ORACLE,
}
