"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import alignment, lines, mixing, nbsvm, pieces, quality, secrets, sharding, simhash, toxicity, variants, warc, weighted

QUERIES = {
    "op2_fingerprints": weighted.op2_fingerprints,
    "op1_line_dedup": lines.op1_line_dedup,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_warc": warc.op4_warc,
    "op5_sharding": sharding.op5_sharding,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_simhash": simhash.op7_simhash,
    "op8_quality": quality.op8_quality,
    "op9_mixing": mixing.op9_mixing,
    "op10_secrets": secrets.op10_secrets,
    "op11_alignment": alignment.op11_alignment,
    "op12_variants": variants.op12_variants,
    "op13_quality_classifier": nbsvm.op13_quality_classifier,
}

ORACLES = {"op4_warc": warc.OP4_SQL, "op9_mixing": mixing.OP9_SQL, "op12_variants": variants.OP12_SQL}
