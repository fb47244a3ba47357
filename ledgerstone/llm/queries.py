"""The training-data queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, ann, chat, decontam, divergence, langid, mixing, ngram_join, pii, rules, secrets, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_ann": ann.op2_ann,
    "op3_pii": pii.op3_pii,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_langid": langid.op5_langid,
    "op6_chat": chat.op6_chat,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_decontam": decontam.op9_decontam,
    "op10_secrets": secrets.op10_secrets,
    "op11_quality": rules.op11_quality,
    "op12_alignment": alignment.op12_alignment,
    "op13_divergence": divergence.op13_divergence,
}
ORACLES = {
    "op1_warc": warc.ORACLE,
    "op4_ngram_join": ngram_join.ORACLE,
    "op6_chat": chat.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op10_secrets": secrets.ORACLE,
    "op11_quality": rules.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
