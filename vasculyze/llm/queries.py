"""The corpus operators' queries, one each over its whole tables, and their SQL where SQL expresses them."""

from __future__ import annotations

from . import decontam, fingerprint, hpylm, jaccard, langid, mix, quality, tokenbin, toxicity, warc

QUERIES = {
    "op1_mix_sources": mix.op1,
    "op2_quality_bayes": quality.op2,
    "op3_pitman_yor": hpylm.op3,
    "op4_language_id": langid.op4,
    "op5_toxicity": toxicity.op5,
    "op6_token_shards": tokenbin.op6,
    "op7_warc_archive": warc.op7,
    "op8_jaccard_join": jaccard.op8,
    "op9_decontaminate": decontam.op9,
    "op10_fingerprints": fingerprint.op10,
}

ORACLE_SQL = {"op7_warc_archive": warc.OP7_SQL}
