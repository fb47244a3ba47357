"""Queries of the whole audit over papers: documents laid out with headings, so that sections, roles, records, scores, gates and files have something to read. And their SQL."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from ..config import EXPECTED_SECTIONS, SECTION_PATTERNS, Audit, Quota, Weight, roles
from ..operators import quality, sections, select, summary
from ..schemas import REGISTRY_COLUMNS
from ..sources import corpus, sinks
from ..sources.work import materialise, remove_spread, work_path
from . import audit as plan
from .registry import table

# --- inputs --------------------------------------------------------------------------------------------------------------------------

NAMES = ("Apache", "KITTI", "License")
METRICS = ("version", "License", "F1")
PHRASES = ("tion", "the ", "der ", "que")
AUDIT = Audit(
    lexicon={"english": ("the", "of", "and"), "french": ("que", "les"), "german": ("der", "die", "und"), "spanish": ("los", "del")},
    phrases={name: PHRASES[i % 2 :] for i, name in enumerate(r.name for r in roles({}))},
    datasets=NAMES, metrics=METRICS, direct=(Weight("english", 2.0, 40), Weight("french", 3.0, 30), Weight("german", 2.5, 20), Weight("spanish", 1.5)),
    quotas=(Quota("german", 12), Quota("spanish", 8), Quota("french", 10)), target=60, least_words=200, least_coverage=0.6, year=2024, venue="made up",
)

# The same layout in both engines: a fifth of the text a section; headings vary with the id.
LAYOUT = """concat('A study of things', chr(10),
  CASE doc_id % 4 WHEN 0 THEN concat('Abstract', chr(10)) WHEN 1 THEN concat('ABSTRACT.', chr(10)) WHEN 2 THEN concat('Summary', chr(10)) ELSE concat('abstract of it', chr(10)) END, substr(t, 1, n), chr(10),
  CASE doc_id % 3 WHEN 0 THEN concat('1.', chr(10), 'Introduction') WHEN 1 THEN '1 Introduction' ELSE 'Introduction' END, chr(10), substr(t, 1 + n, n), chr(10),
  CASE WHEN doc_id % 5 = 0 THEN 'Our way' ELSE 'Proposed Method' END, chr(10), substr(t, 1 + 2 * n, n), chr(10),
  'Experiments', chr(10), 'We use the KITTI dataset and the Large benchmark with the Zeta', CAST(doc_id % 3 AS {text}), ' dataset, see https://github.com/a/b', CAST(doc_id % 7 AS {text}), '. The result is 93.', CAST(doc_id % 9 AS {text}), ' points in this evaluation. ', substr(t, 1 + 3 * n, n), chr(10),
  CASE WHEN doc_id % 6 = 0 THEN concat('Limitations', chr(10)) ELSE '' END, 'Conclusion', chr(10), substr(t, 1 + 4 * n, n), chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('References', chr(10), 'None.') ELSE '' END)"""


def papers(spark, d):
    """doc_id, title, text. Every eleventh paper is its document as it is, without headings."""
    docs = table(spark, d, "documents").selectExpr("doc_id", "source", "coalesce(text, '') AS t", "CAST(length(coalesce(text, '')) DIV 5 AS INT) AS n")
    text = F.expr(f"CASE WHEN doc_id % 11 = 0 THEN t ELSE {LAYOUT.format(text='STRING')} END")
    return docs.select("doc_id", F.concat(F.lit("Study "), F.col("doc_id").cast("string")).alias("title"), text.alias("text"), "source")


def parsed(spark, d):
    from ..functions import text

    base = papers(spark, d).select("doc_id", text.clean(F.col("text")).alias("body"))
    return base.withColumn("heads", sections.headings(F.col("body")))


def records(spark, d, only=None, keep=(), whole_names=False):
    return plan.records(papers(spark, d), AUDIT, only=only, keep=keep, whole_names=whole_names)


GATE = ("word_count", "section_coverage", "method_claims", "experiment_protocol", "main_results")  # what the gate looks at


def scored(spark, d):
    """Records with the sources as strata and the second audit's score."""
    return records(spark, d, keep=("source",)).withColumnRenamed("source", "cluster_id").withColumn("selection_score", quality.v2_score(AUDIT.direct))


# --- queries -------------------------------------------------------------------------------------------------------------------------


def section_positions(spark, d):
    return parsed(spark, d).select("doc_id", F.explode("heads").alias("h")).select("doc_id", F.col("h.name").alias("name"), F.col("h.start").cast("long").alias("start"))


def section_slices(spark, d):
    found = parsed(spark, d).select("doc_id", F.explode(sections.sections(F.col("body"), F.col("heads"))).alias("name", "text"))
    return found.select("doc_id", "name", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha256"))


def audit_evidence(spark, d):
    names = [r.name for r in roles(AUDIT.phrases)]
    held = records(spark, d, names).select("paper_id", F.explode(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n))))).alias("role", "e"))
    return held.select("paper_id", "role", F.posexplode("e").alias("i", "sentence")).select(F.col("paper_id").alias("doc_id"), "role", (F.col("i") + 1).cast("long").alias("rank"), "sentence")


def audit_records(spark, d):
    r = records(spark, d, ("word_count", "char_count", "section_names", "section_coverage", "themes", "datasets", "metrics", "code_urls", "abstract_excerpt", "fulltext_sha256"))
    joined = (F.array_join(F.col(c), " | ").alias(c) for c in ("section_names", "themes", "datasets", "metrics", "code_urls"))
    return r.select("paper_id", "title", "year", "venue", "fulltext_sha256", "word_count", "char_count", "section_coverage", *joined, F.sha2("abstract_excerpt", 256).alias("excerpt_sha256"))


def feature_texts(spark, d):
    return plan.feature_text(records(spark, d, ("abstract_excerpt", "research_problem", "method_claims", "main_results"))).select("paper_id", F.sha2("features", 256).alias("sha256"))


def record_scores(spark, d):
    r = records(spark, d).withColumn("distance", (F.col("paper_id") % 7) / 2.0)
    scores = {"direct": quality.weighted(F.col("theme_scores"), AUDIT.direct), "capped": quality.capped_sum(F.col("theme_scores")).cast("long"), "density": quality.density().cast("long"), "reproducibility": quality.reproducibility().cast("long")}
    scores |= {"centrality": F.round(quality.centrality(F.col("distance")), 6), "v1": quality.v1_score(AUDIT.direct, F.col("distance")), "v2_evidence": F.round(quality.v2_evidence(), 6), "v2": quality.v2_score(AUDIT.direct)}
    return r.select("paper_id", *(c.alias(n) for n, c in scores.items()))


def quality_gate(spark, d):
    return quality.gate(records(spark, d, GATE), AUDIT.least_words, AUDIT.least_coverage).select("paper_id", "word_count")


def eligible_summary(spark, d):
    return summary.measures(quality_gate(spark, d), "word_count").select("n", "least", "median")


EVIDENCE = ("method_claims", "experiment_protocol", "main_results", "ablation_evidence", "limitation_evidence")


def evidence_counts(spark, d):
    return summary.non_empty(records(spark, d, EVIDENCE), EVIDENCE)


def top_datasets(spark, d):
    """Names are sought in whole texts, and every name counts."""
    return summary.most_common(records(spark, d, ("datasets",), whole_names=True), "datasets", 4).withColumnRenamed("item", "dataset")


def stratum_histogram(spark, d):
    return summary.histogram(papers(spark, d), "source")


SHARDS = 1024  # folders at the top of a corpus, so that none holds too many


def own_folder():
    """The folder that only a document's file is in."""
    i = F.col("doc_id").cast("string")
    return F.concat(i, F.lit("_Study_number_"), i)


def file_name():
    """Where a document's file is in a corpus."""
    return F.concat(F.coalesce(F.pmod("doc_id", F.lit(SHARDS)), F.lit(0)).cast("string"), F.lit("/"), own_folder(), F.lit("/text.txt"))


def corpus_scan(spark, d):
    """Raw files, some of them damaged or blank, written and scanned: what is found in each, and dead letters."""
    content = F.when(F.col("doc_id") % 13 == 0, F.encode(F.lit(" \n"), "UTF-8")).when(F.col("doc_id") % 10 == 0, F.concat(F.encode("t", "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode("t", "UTF-8"))
    raw = spark.read.parquet(f"{d}/documents.parquet").withColumn("t", F.coalesce("text", F.lit("")))
    folder = work_path(spark, "corpus")
    sinks.copy_raw(raw.select(file_name().alias("name"), content.alias("content")), folder).write.format("noop").mode("overwrite").save()
    some = F.regexp_extract("text", r"(?U)([^\s\x1c-\x1f])", 1)  # of a text only whether it is blank is looked at again
    found = materialise(corpus.text_files(spark, folder).select("source_path", "doc_id", "title", "content_sha256", "intact", F.length("text").cast("long").alias("chars"), some.alias("text")), "scanned")
    remove_spread(spark, folder)
    good, bad = corpus.dead_letters(corpus.unique_ids(corpus.at_least(found, 1)))
    ids = F.regexp_extract("source_path", r"/(\d+)_Study", 1).cast("long").alias("doc_id")
    rows = good.select(F.col("doc_id").cast("long").alias("doc_id"), "title", "content_sha256", "intact", "chars", F.lit(None).cast("string").alias("error"))
    lost = bad.select(ids, F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("content_sha256"), F.lit(None).cast("boolean").alias("intact"), F.lit(None).cast("long").alias("chars"), "error")
    return rows.unionByName(lost)


@cache
def _written(spark, d):
    """The folder of an audit's files over papers, written once a session: strata are sources, the selection is the second audit's."""
    r = materialise(quality.gate(scored(spark, d), AUDIT.least_words, AUDIT.least_coverage), "gated")
    n = r.count()
    chosen = select.v2_selection(plan.narrow(r), min(n, AUDIT.target), AUDIT.quotas, "paper_id")
    chosen = materialise(r.join(chosen.select("paper_id", "selected_rank", "score_rank"), "paper_id"), "chosen")
    out = work_path(spark, "audit")
    every = papers(spark, d)
    sinks.write_outputs(every.select(F.col("doc_id").alias("paper_id")), chosen, every.select("doc_id", "text"), out, None, AUDIT.quotas, n, quality.directly_relevant(F.col("theme_scores"), strong=("spanish",), pairs=(("english", "german"),)))
    return out


def audit_csv(spark, d):
    rows = spark.read.option("header", "true").csv(f"{_written(spark, d)}/registry.csv")
    return rows.select(F.col("paper_id").cast("long").alias("paper_id"), F.col("selected_rank").cast("long").alias("selected_rank"), "title", F.col("word_count").cast("long").alias("word_count"), F.col("selection_score").cast("double").alias("selection_score"), "themes", "datasets", "code_urls", "fulltext_sha256")


def audit_jsonl(spark, d):
    """Records and chunks read back: rank, chunk, and how many sentences of evidence a record holds."""
    out = _written(spark, d)
    shape = "paper_id long, selected_rank long, title string, main_results array<string>"
    whole = spark.read.schema(shape).json(f"{out}/evidence.jsonl")
    parts = spark.read.schema("paper_id long, chunk int").option("basePath", f"{out}/evidence_chunks").json(f"{out}/evidence_chunks")
    return whole.join(parts, "paper_id").select("paper_id", "selected_rank", F.col("chunk").cast("long").alias("chunk"), F.size("main_results").cast("long").alias("results"))


def audit_copies(spark, d):
    """Each copied file with the manifest's sum and the sum of the bytes that are there."""
    out = _written(spark, d)
    sums = spark.read.text(f"{out}/checksums").select(F.substring_index("value", "  ", 1).alias("stated"), F.regexp_extract("value", r"fulltext/(\d+)\.txt$", 1).cast("long").alias("paper_id"))
    files = spark.read.format("binaryFile").load(f"{out}/fulltext").select(F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("long").alias("paper_id"), F.sha2("content", 256).alias("found"))
    return files.join(sums, "paper_id", "full").select("paper_id", "stated", "found")


def audit_direct(spark, d):
    rows = spark.read.schema("paper_id long, selection_score double, title string").json(f"{_written(spark, d)}/direct.jsonl")
    return rows.select("paper_id", "selection_score")


def audit_summaries(spark, d):
    """The figures of the quality and the summary file: name, value."""
    out = _written(spark, d)
    found = []
    for file in ("quality", "summary"):
        whole = spark.read.option("multiLine", "true").json(f"{out}/{file}.json")
        for c, kind in whole.dtypes:
            if kind == "bigint":
                found.append(whole.select(F.lit(f"{file}.{c}").alias("name"), F.col(c).alias("value")))
            elif kind.startswith("struct") and c in ("quotas", "quotas_met", "themes"):
                found += [whole.select(F.lit(f"{file}.{c}.{k}").alias("name"), F.col(f"{c}.{k}").alias("value")) for k in whole.schema[c].dataType.names]
    lines = spark.read.text(f"{out}/report.md").filter("value like '## %'").agg(F.count("*").alias("value")).select(F.lit("report.headings").alias("name"), "value")
    for f in found:
        lines = lines.unionByName(f)
    return lines


def registry_header(spark, d):
    """The columns of a new registry: place, name."""
    path = sinks.registry_path(work_path(spark, "project"))
    sinks.init_registry(spark, path)
    sinks.init_registry(spark, path, force=True)
    head = spark.read.text(path).select(F.posexplode(F.split("value", "\t")).alias("i", "name"))
    return head.select((F.col("i") + 1).cast("long").alias("place"), "name")


QUERIES = {
    f.__name__: f
    for f in (
        section_positions, section_slices, audit_evidence, audit_records, feature_texts, record_scores, quality_gate, eligible_summary, evidence_counts, top_datasets, stratum_histogram, corpus_scan,
        audit_csv, audit_jsonl, audit_copies, audit_direct, audit_summaries, registry_header,
    )
}

# --- their SQL -----------------------------------------------------------------------------------------------------------------------

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12)"


def clean_sql(c):
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(replace(replace({c}, chr(0), ' '), chr(13), chr(10)), '-\n([a-z])', '\1', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {BLANKS})"


PAPERS = f"""base AS (SELECT doc_id, source, coalesce(text, '') AS t, (length(coalesce(text, '')) // 5)::INT AS n FROM documents),
papers AS (SELECT doc_id, source, 'Study ' || doc_id AS title, CASE WHEN doc_id % 11 = 0 THEN t ELSE {LAYOUT.format(text="VARCHAR")} END AS text FROM base),
body AS (SELECT doc_id, source, title, text, {clean_sql("text")} AS body FROM papers)"""
HEADS = f"""ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(body, chr(10)) AS l FROM body)),
lo AS (SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place, line || coalesce(chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i), '') AS two FROM ln),
short AS (SELECT * FROM lo WHERE length(trim(line, {BLANKS})) <= {sections.HEADING}),
hit AS ({' UNION ALL '.join(f"SELECT doc_id, '{name}' AS name, {i} AS idx, min(place + length(regexp_extract(two, '(?is)^(.*?){p}', 1))) AS start FROM short WHERE regexp_matches(two, '(?is){p}') AND length(regexp_extract(two, '(?is)^(.*?){p}', 1)) < length(line) GROUP BY doc_id" for name, ps in SECTION_PATTERNS.items() for i, p in enumerate(ps))}),
heads AS (SELECT doc_id, name, arg_min(start, idx)::BIGINT AS start FROM hit GROUP BY ALL)"""
SLICES = f"""cut AS (SELECT doc_id, name, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start, name), length(body)) AS stop, body FROM heads JOIN body USING (doc_id)),
sec AS (SELECT doc_id, name, trim(substr(body, start + 1, stop - start), {BLANKS}) AS text FROM cut WHERE stop > start
  UNION ALL SELECT doc_id, 'front_matter', trim(substr(any_value(body), 1, min(start)), {BLANKS}) FROM cut GROUP BY doc_id HAVING min(start) > 0
  UNION ALL SELECT doc_id, 'full', body FROM body WHERE doc_id NOT IN (SELECT doc_id FROM heads)),
wide AS (SELECT doc_id, {', '.join(f"max(text) FILTER (name = '{n}') AS s_{n}" for n in (*SECTION_PATTERNS, 'front_matter', 'full'))} FROM sec GROUP BY doc_id),
abst AS (SELECT *, coalesce(nullif(s_abstract, ''), nullif(s_front_matter, ''), '') AS abstract FROM wide)"""


def _role_text(r):
    parts = f"substr(array_to_string(list_filter([{', '.join(f's_{s}' for s in r.sections)}], lambda x: x <> ''), chr(10)), 1, {r.max_chars})"
    return f"CASE WHEN s_full IS NOT NULL THEN s_full ELSE {'abstract || chr(10) || ' if r.name == 'method_claims' else ''}{parts} END"


def _score(r):
    hits = " + ".join(f"CASE WHEN contains(lower(s), '{p}') THEN 10000 ELSE 0 END" for p in r.phrases)
    number = r" + CASE WHEN regexp_matches(s, '(?:\b\d+(?:\.\d+)?\s*%|\b\d+\.\d+\b)') THEN 15000 ELSE 0 END" if r.number_bonus else ""
    return f"WHEN '{r.name}' THEN {hits}{number}"


ROLES = roles(AUDIT.phrases)
PICKED = rf"""rt AS ({' UNION ALL '.join(f"SELECT doc_id, '{r.name}' AS role, {r.cap} AS cap, {_role_text(r)} AS text FROM abst" for r in ROLES)}),
sent AS (SELECT doc_id, role, cap, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS place FROM (
  SELECT doc_id, role, cap, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9) || '•-')), lambda x: length(x) BETWEEN 35 AND 600) AS s FROM rt)),
pts AS (SELECT *, CASE role {' '.join(map(_score, ROLES))} END + CASE WHEN contains(lower(s), 'we ') OR contains(lower(s), 'our ') THEN 2000 ELSE 0 END - place * 5 AS score FROM sent),
once AS (SELECT *, row_number() OVER (PARTITION BY doc_id, role, substr(regexp_replace(lower(s), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'), 1, 160) ORDER BY score DESC, length(s), place) AS copy FROM pts WHERE score > 0),
picked AS (SELECT doc_id, role, s AS sentence, row_number() OVER (PARTITION BY doc_id, role ORDER BY score DESC, length(s), place) AS rank, cap FROM once WHERE copy = 1 QUALIFY rank <= cap)"""


def _phrases(words):
    return " + ".join(f"len(regexp_extract_all(hay, '(^|[^A-Za-z0-9]){w}($|[^A-Za-z0-9])'))" for w in words)


def _known(names):
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(head, '(?i)(^|[^A-Za-z0-9]){n}($|[^A-Za-z0-9])') THEN '{n}' END" for n in names) + "], lambda x: x IS NOT NULL)"


STOPPED = ", ".join(f"'{w}'" for w in AUDIT.not_datasets)
DATASETS = rf"list_distinct(list_concat({_known(AUDIT.datasets)}, list_filter(regexp_extract_all(head, '\b([A-Z][A-Za-z0-9+\-]{{2,20}})\s+(?:dataset|benchmark)\b', 1), lambda x: lower(x) NOT IN ({STOPPED}))))"
THEME_LIST = f"[{', '.join(f'{{n: {t}, t: {chr(39)}{t}{chr(39)}}}' for t in AUDIT.lexicon)}]"
RECORDS = rf"""hay AS (SELECT *, lower(regexp_replace(title || chr(10) || substr(body, 1, 50000), '([^A-Za-z0-9])', '\1\1', 'g')) AS hay, substr(body, 1, 120000) AS head FROM body),
ent AS (SELECT doc_id, source, title, text, body, {', '.join(f'{_phrases(w)} AS {t}' for t, w in AUDIT.lexicon.items())},
  {DATASETS} AS ds,
  list_filter([{', '.join(f"CASE WHEN regexp_matches(head, '(?i){chr(92)}b{n}{chr(92)}b') THEN '{n}' END" for n in AUDIT.metrics)}], lambda x: x IS NOT NULL) AS metrics,
  list_distinct(list_filter(list_transform(regexp_extract_all(head, 'https?://[^\s\]\[)>(]+'), lambda u: rtrim(u, '.,;')), lambda u: regexp_matches(lower(u), 'github\.com|gitlab\.com|huggingface\.co|project'))) AS urls FROM hay),
names AS (SELECT doc_id, string_agg(name, ' | ' ORDER BY name) AS section_names, round(count(*) FILTER (name IN ({', '.join(f"'{n}'" for n in EXPECTED_SECTIONS)})) / {float(len(EXPECTED_SECTIONS))}::DOUBLE, 3) AS section_coverage FROM sec GROUP BY doc_id),
ev AS (SELECT doc_id, {', '.join(f"count(*) FILTER (role = '{r.name}') AS {r.name}" for r in ROLES)} FROM picked GROUP BY doc_id),
rec AS (SELECT ent.*, section_names, section_coverage, abstract, CASE WHEN body = '' THEN 0 ELSE len(regexp_split_to_array(body, '\s+')) END::BIGINT AS word_count, length(body) AS char_count,
  list_transform(list_sort(list_transform(list_filter({THEME_LIST}, lambda x: x.n > 0), lambda x: {{m: -x.n, t: x.t}})), lambda x: x.t) AS theme_list,
  list_slice(list_transform(list_sort(list_transform(ds, lambda x: {{l: lower(x), v: x}})), lambda x: x.v), 1, 30) AS datasets, list_slice(list_sort(urls), 1, 12) AS code_urls,
  {', '.join(f'coalesce(ev.{r.name}, 0) AS {r.name}' for r in ROLES)} FROM ent JOIN names USING (doc_id) JOIN abst USING (doc_id) LEFT JOIN ev USING (doc_id))"""
DIRECT = " + ".join(f"{w.weight}::DOUBLE * {f'least({w.theme}, {w.cap})' if w.cap else w.theme}" for w in AUDIT.direct)
V1, V2 = quality.V1, quality.V2
SCORES = f"""sc AS (SELECT *, 0::DOUBLE + {DIRECT} AS direct, {' + '.join(f'least({t}, 8)' for t in AUDIT.lexicon)} AS capped, {' + '.join(quality.V1_EVIDENCE)} AS density, least(len(datasets), 4) + 2 * least(len(code_urls), 2) AS reproducibility,
  1::DOUBLE / (1::DOUBLE + (doc_id % 7) / 2::DOUBLE) AS centrality,
  {V2['coverage']}::DOUBLE * section_coverage + (0::DOUBLE + {' + '.join(f'{w}::DOUBLE * {c}' for c, w in quality.V2_EVIDENCE.items())}) + {V2['datasets']}::DOUBLE * least(len(datasets), 5) + {V2['code_urls']}::DOUBLE * least(len(code_urls), 2) + least(word_count / {V2['words']}::DOUBLE, {V2['most_words']}::DOUBLE) AS v2_evidence FROM rec),
fin AS (SELECT *, round({V1['direct']}::DOUBLE * direct + {V1['capped']}::DOUBLE * capped + {V1['coverage']}::DOUBLE * section_coverage + {V1['density']}::DOUBLE * density + {V1['again']}::DOUBLE * reproducibility + {V1['centrality']}::DOUBLE * centrality, 4) AS v1, round(direct + v2_evidence, 4) AS v2 FROM sc)"""
ALL = f"WITH {PAPERS}, {HEADS}, {SLICES}, {PICKED}, {RECORDS}"
GATED = f"gated AS (SELECT * FROM fin WHERE word_count >= {AUDIT.least_words} AND section_coverage >= {AUDIT.least_coverage} AND method_claims > 0 AND experiment_protocol > 0 AND main_results > 0)"


def _chosen():
    """The second audit's selection over gated records: phases of quotas, then rounds over sources."""
    sql, before = f"{ALL}, {SCORES}, {GATED}", "SELECT NULL::BIGINT AS doc_id WHERE false"
    for i, q in enumerate(AUDIT.quotas, 1):
        sql += f""", q{i} AS (SELECT doc_id, {i} AS phase, row_number() OVER (ORDER BY v2 DESC, lower(title), doc_id) AS step FROM gated WHERE {q.theme} > 0 AND doc_id NOT IN ({before})
  QUALIFY step <= {q.quota} - (SELECT count(*) FROM gated WHERE {q.theme} > 0 AND doc_id IN ({before})))"""
        before = " UNION ALL ".join(f"SELECT doc_id FROM q{j}" for j in range(1, i + 1))
    return sql + f""", quotas AS ({' UNION ALL '.join(f'SELECT * FROM q{i}' for i in range(1, len(AUDIT.quotas) + 1))}),
left_ AS (SELECT * FROM gated WHERE doc_id NOT IN (SELECT doc_id FROM quotas)),
sizes AS (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) AS ordinal FROM left_ GROUP BY source),
placed AS (SELECT doc_id, ordinal, row_number() OVER (PARTITION BY source ORDER BY v2 DESC, lower(title), doc_id) AS place FROM left_ JOIN sizes USING (source)),
turn AS (SELECT doc_id, {len(AUDIT.quotas) + 1} AS phase, row_number() OVER (ORDER BY place, ordinal) AS step FROM placed),
chosen AS (SELECT g.*, row_number() OVER (ORDER BY phase, step) AS selected_rank FROM (SELECT * FROM quotas UNION ALL SELECT * FROM turn) JOIN gated g USING (doc_id) QUALIFY selected_rank <= {AUDIT.target})"""


CHOSEN = _chosen()
DIRECTLY = "spanish > 0 OR english > 0 AND german > 0"
LISTED = "array_to_string({0}, ' | ')"


def _figures():
    one = {
        "quality.sources": "(SELECT count(*) FROM documents)", "quality.parsed": "(SELECT count(*) FROM documents)", "quality.eligible": "(SELECT count(*) FROM gated)", "quality.failed": "0", "quality.selected": "(SELECT count(*) FROM chosen)",
        "quality.word_count_least": "(SELECT min(word_count) FROM chosen)", "summary.parsed": "(SELECT count(*) FROM documents)", "summary.failed": "0", "summary.selected": "(SELECT count(*) FROM chosen)", "report.headings": "3",
    }
    one |= {f"quality.quotas.{q.theme}": str(q.quota) for q in AUDIT.quotas} | {f"quality.quotas_met.{q.theme}": f"(SELECT count(*) FROM chosen WHERE {q.theme} > 0)" for q in AUDIT.quotas}
    one |= {f"summary.with_{c}": f"(SELECT count(*) FROM chosen WHERE {c} > 0)" for c in EVIDENCE} | {f"summary.themes.{t}": f"(SELECT nullif(count(*), 0) FROM chosen WHERE {t} > 0)" for t in AUDIT.lexicon}
    return f"{CHOSEN} SELECT * FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{n}{chr(39)} AS name, {v}::BIGINT AS value' for n, v in one.items())}) WHERE value IS NOT NULL"


ORACLES = {
    "section_positions": f"WITH {PAPERS}, {HEADS} SELECT doc_id, name, start FROM heads",
    "section_slices": f"WITH {PAPERS}, {HEADS}, {SLICES} SELECT doc_id, name, length(text) AS chars, sha256(text) AS sha256 FROM sec",
    "audit_evidence": f"WITH {PAPERS}, {HEADS}, {SLICES}, {PICKED} SELECT doc_id, role, rank, sentence FROM picked",
    "audit_records": rf"""{ALL} SELECT doc_id AS paper_id, title, {AUDIT.year}::INT AS year, '{AUDIT.venue}' AS venue, sha256(text) AS fulltext_sha256, word_count, char_count, section_coverage, section_names,
  {LISTED.format('theme_list')} AS themes, {LISTED.format('datasets')} AS datasets, {LISTED.format('metrics')} AS metrics, {LISTED.format('code_urls')} AS code_urls, sha256(substr(trim(regexp_replace(abstract, '\s+', ' ', 'g')), 1, 1800)) AS excerpt_sha256 FROM rec""",
    "feature_texts": rf"""WITH {PAPERS}, {HEADS}, {SLICES}, {PICKED},
f AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY CASE role WHEN 'research_problem' THEN 1 WHEN 'method_claims' THEN 2 ELSE 3 END, rank) AS e FROM picked WHERE role IN ('research_problem', 'method_claims', 'main_results') GROUP BY doc_id)
SELECT doc_id AS paper_id, sha256(title || ' ' || substr(trim(regexp_replace(abstract, '\s+', ' ', 'g')), 1, 1800) || ' ' || coalesce(e, '')) AS sha256 FROM abst JOIN body USING (doc_id) LEFT JOIN f USING (doc_id)""",
    "record_scores": f"{ALL}, {SCORES} SELECT doc_id AS paper_id, direct, capped::BIGINT AS capped, density::BIGINT AS density, reproducibility::BIGINT AS reproducibility, round(centrality, 6) AS centrality, v1, round(v2_evidence, 6) AS v2_evidence, v2 FROM fin",
    "quality_gate": f"{ALL}, {SCORES}, {GATED} SELECT doc_id AS paper_id, word_count FROM gated",
    "eligible_summary": f"{ALL}, {SCORES}, {GATED} SELECT count(*) AS n, min(word_count) AS least, median(word_count)::DOUBLE AS median FROM gated",
    "evidence_counts": f"{ALL} SELECT {', '.join(f'count(*) FILTER ({c} > 0) AS with_{c}' for c in EVIDENCE)} FROM rec",
    "top_datasets": f"WITH {PAPERS}, hay AS (SELECT body AS head FROM body) SELECT dataset, count(*) AS n FROM (SELECT unnest({DATASETS}) AS dataset FROM hay) GROUP BY dataset ORDER BY n DESC, dataset LIMIT 4",
    "stratum_histogram": "SELECT source, count(*) AS n FROM documents GROUP BY source",
    "corpus_scan": r"""WITH b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN ' ' || chr(10) ELSE t END AS t, doc_id % 13 <> 0 AND doc_id % 10 = 0 AS hurt FROM b)
SELECT doc_id, CASE WHEN ok THEN 'Study number ' || doc_id END AS title, CASE WHEN ok THEN sha256(encode(t) || CASE WHEN hurt THEN '\xFF'::BLOB ELSE ''::BLOB END) END AS content_sha256, CASE WHEN ok THEN NOT hurt END AS intact,
  CASE WHEN ok THEN length(t) + hurt::BIGINT END AS chars, CASE WHEN NOT ok THEN 'empty text' END AS error FROM (SELECT *, length(trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 0 OR hurt AS ok FROM c)""",
    "audit_csv": f"{CHOSEN} SELECT doc_id AS paper_id, selected_rank, title, word_count, v2 AS selection_score, nullif({LISTED.format('theme_list')}, '') AS themes, nullif({LISTED.format('datasets')}, '') AS datasets, nullif({LISTED.format('code_urls')}, '') AS code_urls, sha256(text) AS fulltext_sha256 FROM chosen",
    "audit_jsonl": f"{CHOSEN} SELECT doc_id AS paper_id, selected_rank, (selected_rank - 1) // {sinks.CHUNK} + 1 AS chunk, main_results AS results FROM chosen",
    "audit_copies": f"{CHOSEN} SELECT doc_id AS paper_id, sha256(text) AS stated, sha256(text) AS found FROM chosen",
    "audit_direct": f"{CHOSEN} SELECT doc_id AS paper_id, v2 AS selection_score FROM chosen WHERE {DIRECTLY}",
    "audit_summaries": _figures(),
    "registry_header": "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{c}')" for i, c in enumerate(REGISTRY_COLUMNS, 1)) + ") AS v(place, name)",
}
