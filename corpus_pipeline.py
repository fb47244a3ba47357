"""Corpus pipeline: toxicity, near copies, benchmark leaks, secrets, then the mix. Each stage reads what the last one wrote."""

from __future__ import annotations

from ledgerstone.llm import decontam, mixing, ngram_join, secrets, toxicity
from ledgerstone.llm.common import drop, materialise, table


def reject_toxic(spark, docs, sf_dir):
    """Documents predicted toxic go; learned from the labels of documents in docs. Null and empty texts stay, repeats fare alike; without labels all stay."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark, docs, sf_dir):
    """One document of each class of near copies stays: that of least id, one with an id if any has, one row of repeated ones. Texts without words all stay."""
    return ngram_join.keep_one(docs)


def remove_leaks(spark, docs, sf_dir):
    """Documents that hold a benchmark item go. Null and empty texts hold none; without items all stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark, docs, sf_dir):
    """Secrets in texts give way to a mark; all documents stay, null texts stay null."""
    return secrets.redact(docs)


def mix_sources(spark, docs, sf_dir):
    """How many words the mix takes of each document; null texts have none, null sources are one source, ties go by a hash."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", keep_one_of_each),
    ("decontamination", remove_leaks),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]
ORACLE_SQL = None  # stages 1 to 3 learn, hash and align: tests compare them with brute force


def run(spark, sf_dir):
    """The rows of the last stage. Each stage's table goes once the next one's is written."""
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if held is not None:
            drop(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
