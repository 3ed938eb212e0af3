"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from sensorloom.llm import (
    op1_extraction,
    op10_warc,
    op11_recompression,
    op12_whitening,
    op13_spelling,
    op2_training_order,
    op3_language,
    op4_decontamination,
    op5_minhash,
    op6_embeddings,
    op7_quality,
    op8_mixing,
    op9_token_counts,
)

QUERIES = {
    "op1_extraction": op1_extraction.op1_extraction,
    "op2_training_order": op2_training_order.op2_training_order,
    "op3_language": op3_language.op3_language,
    "op4_decontamination": op4_decontamination.op4_decontamination,
    "op5_minhash": op5_minhash.op5_minhash,
    "op6_embeddings": op6_embeddings.op6_embeddings,
    "op7_quality": op7_quality.op7_quality,
    "op8_mixing": op8_mixing.op8_mixing,
    "op9_token_counts": op9_token_counts.op9_token_counts,
    "op10_warc": op10_warc.op10_warc,
    "op11_recompression": op11_recompression.op11_recompression,
    "op12_whitening": op12_whitening.op12_whitening,
    "op13_spelling": op13_spelling.op13_spelling,
    "language_of_pages": op3_language.op3_language_of_pages,
}

ORACLES = {
    "op4_decontamination": op4_decontamination.ORACLE,
    "op8_mixing": op8_mixing.ORACLE,
    "op10_warc": op10_warc.ORACLE,
}
