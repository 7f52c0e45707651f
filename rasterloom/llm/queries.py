"""Queries of this subpackage and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from . import decontam, lm, packing, pii, search, sharding, simhash, substring, tokencount, toxicity

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_packing": packing.query,
    "op3_toxicity": toxicity.query,
    "op4_substring": substring.query,
    "op5_token_counts": tokencount.query,
    "op6_pii": pii.query,
    "op7_decontamination": decontam.query,
    "op8_simhash": simhash.query,
    "op9_search": search.query,
    "op10_lm": lm.query,
}
ORACLES = {
    "op4_substring": substring.ORACLE,
    "op7_decontamination": decontam.ORACLE,
    "op9_search": search.ORACLE,
}
