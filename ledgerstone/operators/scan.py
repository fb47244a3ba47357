"""Phrase scans of paragraphs, repeated openers, routing by cues, rescans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extract import phrase_scores
from ..functions.text import phrase_pattern, sentences, strip


def ids_of(id_col) -> list[str]:
    return [id_col] if isinstance(id_col, str) else list(id_col)


def paragraphs(docs: DataFrame, text="text", id_col="doc_id") -> DataFrame:
    """id, paragraph (from 0), body: blank lines part paragraphs; empty ones are left out. id_col: a column or several."""
    return docs.select(*ids_of(id_col), F.posexplode(F.split(text, r"\n[ \t]*\n\s*")).alias("paragraph", "body")).withColumn("body", strip(F.col("body"))).filter("body <> ''")


def phrase_scan(docs: DataFrame, classes: dict[str, tuple[str, ...]], text="text", id_col="doc_id") -> DataFrame:
    """id, paragraph, class, n: how often phrases of a class stand in a paragraph."""
    found = F.array(*(F.struct(F.lit(name).alias("class"), sum((F.regexp_count("body", F.lit(phrase_pattern(p))) for p in words), F.lit(0)).cast("long").alias("n")) for name, words in classes.items()))
    ids = ids_of(id_col)
    return paragraphs(docs, text, id_col).select(*ids, "paragraph", F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("x")).select(*ids, "paragraph", "x.*")


def repeated_openers(docs: DataFrame, least=3, share=0.5, text="text", id_col="doc_id") -> DataFrame:
    """id, paragraph, opener, n, of: paragraphs in which at least `share` of `least` or more sentences begin with the same word."""
    first = F.transform(sentences(F.col("body"), 1, None), lambda s: F.lower(F.regexp_extract(s, r"(?U)\A\W*(\w+)", 1)))
    opened = paragraphs(docs, text, id_col).select(id_col, "paragraph", F.explode(first).alias("opener"))
    counted = opened.groupBy(id_col, "paragraph", "opener").agg(F.count("*").alias("n"))
    best = counted.groupBy(id_col, "paragraph").agg(F.min(F.struct((-F.col("n")).alias("minus"), "opener")).alias("best"), F.sum("n").alias("of"))
    out = best.select(id_col, "paragraph", F.col("best.opener").alias("opener"), (-F.col("best.minus")).alias("n"), "of")
    return out.filter((F.col("of") >= least) & (F.col("n") >= share * F.col("of")))


def route(docs: DataFrame, cues: dict[str, tuple[str, ...]], text="text", id_col="doc_id") -> DataFrame:
    """id, primary, secondary: the domains with most cue phrases, ties by name; null without any."""
    scored = F.map_entries(phrase_scores(F.lit(""), F.col(text), cues, 1 << 30))
    order = F.array_sort(F.transform(F.filter(scored, lambda e: e["value"] > 0), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("name"))))
    return docs.select(id_col, order.alias("o")).select(id_col, F.get("o", F.lit(0))["name"].alias("primary"), F.get("o", F.lit(1))["name"].alias("secondary"))


def new_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings after a revision that weren't there before."""
    return after.exceptAll(before.select(*after.columns))


def recent(sources: DataFrame, year: int, window=10) -> DataFrame:
    return sources.filter(F.col("year").between(year - window, year))
