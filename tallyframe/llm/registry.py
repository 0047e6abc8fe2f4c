"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

import corpus_pipeline
from tallyframe.llm import (chat_format, decontaminate, divergence, hamming_ann, merkle, mixing, near_dup, pieces, pitman_yor,
                            quality, secrets, vector_dup, warc_derive)

MODULES = {
    "op1_secret_scan": secrets,
    "op2_source_mix": mixing,
    "op3_chat_format": chat_format,
    "op4_pu_quality": quality,
    "op5_multi_index_ann": hamming_ann,
    "op6_warc_derive": warc_derive,
    "op7_sentencepiece": pieces,
    "op8_vector_near_dup": vector_dup,
    "op9_minhash_near_dup": near_dup,
    "op10_pitman_yor_lm": pitman_yor,
    "op11_merkle_manifest": merkle,
    "op12_decontaminate": decontaminate,
    "op13_source_divergence": divergence,
}
QUERIES = {name: m.query for name, m in MODULES.items()} | {"pipeline": corpus_pipeline.run}
ORACLES = {name: m.SQL for name, m in MODULES.items() if getattr(m, "SQL", None)}
