"""The queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from docsift.llm import decontam, dedup, htmltext, langid, mixing, pii, quality, quotes, tokens, urls

QUERIES = {
    "op1_quotation_linking": quotes.op1_quotation_linking,
    "op2_language_id": langid.op2_language_id,
    "op3_mixing": mixing.op3_mixing,
    "op4_fm_decontamination": decontam.op4_fm_decontamination,
    "op5_url_reputation": urls.op5_url_reputation,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_ngram_jaccard": dedup.op7_ngram_jaccard,
    "op8_feistel_pii": pii.op8_feistel_pii,
    "op9_quality_forest": quality.op9_quality_forest,
    "op10_html_crf": htmltext.op10_html_crf,
    "quotations_of_requoted": quotes.quotations_of_requoted,
}
ORACLES = {"op1_quotation_linking": quotes.ORACLE, "op3_mixing": mixing.ORACLE, "op4_fm_decontamination": decontam.ORACLE, "op5_url_reputation": urls.ORACLE, "op7_ngram_jaccard": dedup.ORACLE, "quotations_of_requoted": quotes.REQUOTED_ORACLE}
