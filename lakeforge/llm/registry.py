"""Queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import bpe, decontamination, exact_dedup, fim, language_id, ngram_join, packing, quality, secrets, suffix_dedup, toxicity, vector_codes, warc_fixity

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_quality": quality.op3_quality,
    "op4_bpe": bpe.op4_bpe,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_language_id": language_id.op6_language_id,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_secrets": secrets.op8_secrets,
    "op9_warc_fixity": warc_fixity.op9_warc_fixity,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_fim": fim.op11_fim,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_packing": packing.op13_packing,
}
ORACLES = {
    "op1_ngram_join": ngram_join.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op5_suffix_dedup": suffix_dedup.SQL,
    "op9_warc_fixity": warc_fixity.SQL,
    "op10_decontamination": decontamination.SQL,
    "op11_fim": fim.SQL,
    "op12_vector_codes": vector_codes.SQL,
}
