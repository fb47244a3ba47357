"""The corpus audit: documents to records, records to strata, strata to a selection."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import V1_STRATA, V2_STRATA, Audit, roles
from ..functions import extract, text
from ..functions.lexicon import Names, Themes, fold, word_edges
from ..functions.rows import COUNTS, STRINGS, sliced
from ..operators import quality, sections, select, strata
from ..sources.work import materialise


FIELDS = {"word_count": ("bigint", pa.int64()), "char_count": ("bigint", pa.int64()), "section_names": STRINGS, "section_coverage": ("double", pa.float64()), "theme_scores": COUNTS, "datasets": STRINGS, "metrics": STRINGS, "code_urls": STRINGS}
LAST = {"abstract_excerpt": ("string", pa.string())}


class Reader:
    """What a record holds of a text, in one pass: cleaned once, folded once, sentences split once for all roles that read the same sections."""

    def __init__(self, audit: Audit, fallback: bool, only=None, whole_names=False):
        self.audit, self.fallback, self.whole_names, self.scanner = audit, fallback, whole_names, sections.Scanner()
        self.themes, self.stop = Themes(audit.lexicon), frozenset(audit.not_datasets)
        self.datasets, self.metrics = Names(audit.datasets), Names(audit.metrics, edges=word_edges)
        every = fields(audit)
        self.wanted = list(every if only is None else (f for f in every if f in only))
        groups = {}
        for r in roles(audit.phrases):
            if r.name in self.wanted:
                groups.setdefault((r.sections, r.max_chars, r.name == "method_claims"), []).append(r)
        self.groups = [(*key, extract.Scorer(tuple(rs)), [r.name for r in rs]) for key, rs in groups.items()]
        self.parses = bool(groups) or bool({"section_names", "section_coverage", "abstract_excerpt"} & set(self.wanted))

    def scores(self, title: str, body: str) -> dict[str, int]:
        if self.audit.phrase_mode:
            return self.themes.scores(fold(f"{title}\n{body[:50_000]}"))
        hay = f"{title}\n{body[:30_000]}".lower()
        return {theme: sum(hay.count(w.lower()) for w in words) for theme, words in self.audit.lexicon.items()}

    def read(self, title: str | None, raw: str | None) -> dict:
        body = text.cleaned(raw or "")
        parsed = sections.slices(body, self.scanner.headings(body)) if self.parses else {}
        head, most = (body, None) if self.whole_names else (body[:120_000], 30)
        low = fold(head) if "datasets" in self.wanted or "metrics" in self.wanted else ""
        abstract = parsed.get("abstract") or parsed.get("front_matter") or ""
        ways = {
            "word_count": lambda: len(body.split()),
            "char_count": lambda: len(body),
            "section_names": lambda: sorted(parsed),
            "section_coverage": lambda: sections.share(parsed),
            "theme_scores": lambda: list(self.scores(title or "", body).items()),
            "datasets": lambda: extract.ordered_names(self.datasets.found(head, low), extract.named(head), self.stop, most),
            "metrics": lambda: self.metrics.found(head, low),
            "code_urls": lambda: extract.code_links_in(head),
            "abstract_excerpt": lambda: " ".join(abstract.split())[:1800],
        }
        found = {f: ways[f]() for f in self.wanted if f in ways}
        for names, most, with_abstract, scorer, wanted in self.groups:
            said = "\n".join(parsed[n] for n in names if parsed.get(n))[:most]
            said = body if self.fallback and "full" in parsed else f"{abstract}\n{said}" if with_abstract else said
            found |= zip(wanted, scorer.best(extract.sentences_in(said)))
        return found


def fields(audit: Audit) -> dict:
    """What is read of a text: the types of the columns, in both spellings."""
    return FIELDS | {r.name: STRINGS for r in roles(audit.phrases)} | LAST


def records(docs: DataFrame, audit: Audit, fallback=True, only=None, keep=(), whole_names=False) -> DataFrame:
    """A record for each document: counts, sections, themes, entities, evidence. docs: doc_id, title, text, and content_sha256 and source_path if known.

    No text is shuffled, and a text is read in one pass by one Arrow function, which hands on some rows at a time. fallback: roles read the whole text
    if no heading is found. Null texts are empty, null titles too where themes are sought. only: the columns read of texts that are wanted, and fulltext_sha256
    if it is; others are left out and cost nothing. keep: columns of docs that stay beside them. whole_names: entities are those of the whole text, and all data sets stay; else those of its beginning, and 30.
    """
    have, reader = set(docs.columns), Reader(audit, fallback, None if only is None else {*only, *({"theme_scores"} if "themes" in only else ())}, whole_names)
    every = fields(audit)
    some = {n: every[n] for n in reader.wanted}
    own = [F.col("doc_id").alias("paper_id"), "title", *keep, (F.col("source_path") if "source_path" in have else F.lit(None).cast("string")).alias("source_path")]
    if only is None or "fulltext_sha256" in only:
        own.append((F.col("content_sha256") if "content_sha256" in have else F.sha2("text", 256)).alias("fulltext_sha256"))
    base = docs.select(*own, "text")
    said = base.columns[:-1]

    def run(batches):
        for part in sliced(batches):
            rows = [reader.read(*r) for r in zip(part["title"].to_pylist(), part["text"].to_pylist())]
            yield pa.record_batch([*(part[c] for c in said), *(pa.array([r[n] for r in rows], kind) for n, (_, kind) in some.items())], names=[*said, *some])

    kinds = [*((c, base.schema[c].dataType.simpleString()) for c in said), *((n, kind) for n, (kind, _) in some.items())]
    rows = base.mapInArrow(run, ", ".join(f"`{n}` {kind}" for n, kind in kinds))
    if "section_coverage" in some:
        rows = rows.withColumn("section_coverage", F.round("section_coverage", 3))
    rows = rows.withColumn("themes", extract.active_themes(F.col("theme_scores"))) if "theme_scores" in some else rows
    first = ["paper_id", "title", F.lit(audit.year).cast("int").alias("year"), F.lit(audit.venue).cast("string").alias("venue")]
    return rows.select(*first, *(c for c in rows.columns if c not in ("paper_id", "title", *keep)), *keep)


def feature_text(rows: DataFrame) -> DataFrame:
    evidence = F.concat("research_problem", "method_claims", "main_results")
    return rows.select("paper_id", F.concat_ws(" ", "title", "abstract_excerpt", F.array_join(evidence, " ")).alias("features"))


def with_strata(rows: DataFrame, audit: Audit, columns=("*",), **options) -> DataFrame:
    """The columns of rows, paper_id among them, with cluster_id and distance; -1 and 0 where a record has no known term. They are shuffled. options: what strata() takes."""
    stop = audit.stop_words if audit.stop_words is not None else tuple(StopWordsRemover.loadDefaultStopWords("english"))
    found = strata.strata(feature_text(rows), "features", audit.strata, seed=audit.seed, id_col="paper_id", stop=stop, **options)
    return rows.select(*columns).join(found, "paper_id", "left").withColumns({"cluster_id": F.coalesce("cluster_id", F.lit(-1)), "distance": F.coalesce("distance", F.lit(0.0))})


def narrow(rows: DataFrame) -> DataFrame:
    return rows.select("paper_id", "title", F.col("cluster_id").alias("stratum"), F.col("selection_score").alias("score"), "themes")


def with_records(parsed: DataFrame, picked: DataFrame) -> DataFrame:
    """The records of the rows picked, which are written first: so few are sent to the records instead of all records being shuffled."""
    return parsed.join(materialise(picked, "picked"), "paper_id")


def v2(parsed: DataFrame, audit: Audit, **options) -> DataFrame:
    """Quality gate, strata, capped scores, quotas, round robin. parsed: records, materialised. Ranks are those of insertion; score_rank is beside them. options replace V2_STRATA's."""
    ok = with_strata(quality.gate(parsed, audit.least_words, audit.least_coverage), audit, ("paper_id", "title", "themes", quality.v2_score(audit.direct).alias("selection_score")), **V2_STRATA | options)
    ok = materialise(ok, "eligible", "zstd")
    chosen = select.v2_selection(narrow(ok), audit.target, audit.quotas, "paper_id")
    return with_records(parsed, ok.join(chosen.select("paper_id", "selected_rank", "score_rank"), "paper_id").select("paper_id", "cluster_id", "distance", "selection_score", "selected_rank", "score_rank"))


def v1(parsed: DataFrame, audit: Audit, **options) -> DataFrame:
    """No gate; strata of all records, uncapped scores with centrality, quotas by stratum, then the best of the rest. Fails if the result isn't audit.target rows. options replace V1_STRATA's."""
    k = min(50, max(20, parsed.count() // 45))
    ok = with_strata(parsed, replace(audit, strata=k), ("paper_id", "title", "themes", quality.v1_record(audit.direct).alias("own")), **V1_STRATA | options)
    ok = materialise(ok.withColumn("selection_score", quality.v1_placed(F.col("own"), F.col("distance"))), "scored", "zstd")
    chosen = select.v1_selection(narrow(ok), audit.target, k, "paper_id", whole=True)
    return with_records(parsed, ok.join(chosen.select("paper_id", "selected_rank"), "paper_id").select("paper_id", "cluster_id", "distance", "selection_score", "selected_rank"))
