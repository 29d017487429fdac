"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tensorloom.llm import decontamination, neardup, packing, quality, sharding, tiff, toxicity, urls, warc, wordpiece

QUERIES = {
    "op1_toxicity_grammar": toxicity.query,
    "op2_minhash_near_duplicates": neardup.query,
    "op3_token_counts": wordpiece.query,
    "op4_warc_segments": warc.query,
    "op5_best_fit_packing": packing.query,
    "op6_kd_tree_shards": sharding.query,
    "op7_qgram_decontamination": decontamination.query,
    "op8_weak_label_quality": quality.query,
    "op9_url_filter": urls.query,
    "op10_tiff_pages": tiff.query,
}
ORACLES = {
    "op9_url_filter": urls.oracle(),
}
