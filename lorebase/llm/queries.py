"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, fill_in_middle, langid, line_dedup, ngram_join, pii, quality, secrets, sentencepiece_codec, sharding, spelling, substring_dedup, warc

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_secret_scan": secrets.query,
    "op3_sentencepiece": sentencepiece_codec.query,
    "op4_pii": pii.query,
    "op5_warc": warc.query,
    "op6_sharding": sharding.query,
    "op7_language_id": langid.query,
    "op8_line_dedup": line_dedup.query,
    "op9_quality_rules": quality.query,
    "op10_decontamination": decontaminate.query,
    "op11_substring_dedup": substring_dedup.query,
    "op12_fill_in_middle": fill_in_middle.query,
    "op13_spelling_variants": spelling.query,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE,
    "op2_secret_scan": secrets.ORACLE,
    "op5_warc": warc.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op9_quality_rules": quality.ORACLE,
    "op11_substring_dedup": substring_dedup.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
