"""Registered queries of these operators."""

from __future__ import annotations

import corpus_pipeline

from . import (
    bilinear_lm,
    collocations,
    cover_search,
    decontaminate,
    divergence,
    licenses,
    line_dedup,
    minhash_dedup,
    mixing,
    pseudonyms,
    suffix_dedup,
    token_file,
    toxicity,
)

QUERIES = {
    "op1_minhash_dedup": minhash_dedup.op1,
    "op2_toxicity": toxicity.op2,
    "op3_pseudonyms": pseudonyms.op3,
    "op4_token_file": token_file.op4,
    "op5_cover_search": cover_search.op5,
    "op6_bilinear_lm": bilinear_lm.op6,
    "op7_source_mixing": mixing.op7,
    "op8_suffix_dedup": suffix_dedup.op8,
    "op9_licenses": licenses.op9,
    "op10_decontaminate": decontaminate.op10,
    "op11_collocations": collocations.op11,
    "op12_divergence": divergence.op12,
    "op13_line_dedup": line_dedup.op13,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op5_cover_search": cover_search.SQL5,
    "op10_decontaminate": decontaminate.SQL10,
    "op11_collocations": collocations.SQL11,
    "op12_divergence": divergence.SQL12,
    "op13_line_dedup": line_dedup.SQL13,
}
