"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from facetloom.llm import bpe, fingerprint, jaccard, language, license, mixing, neighbours, quality, rollup, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_language": language.op2_language,
    "op3_mixing": mixing.op3_mixing,
    "op4_warc": warc.op4_warc,
    "op5_license": license.op5_license,
    "op6_bpe": bpe.op6_bpe,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_fingerprint": fingerprint.op8_fingerprint,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_rollup": rollup.op10_rollup,
}

#: Trained models, byte-pair merges, links over whole texts and minima of hashes have no SQL that ends in time: tests/llm holds them against brute force.
ORACLES = {
    "op3_mixing": mixing.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_license": license.OP5_SQL,
    "op10_rollup": rollup.OP10_SQL,
}
