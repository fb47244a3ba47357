"""The audit's queries by name, and their SQL. Lexicons and fixtures are examples made up for the test data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import V2_STRATA, Audit, Quota, Role, Weight
from ..functions import extract, text
from ..operators import leakage, quality, scan, select, strata, summary
from ..sources.work import dealt

LEXICON = {"nouns": ("tion", "ment"), "articles": ("the ", "les "), "endings": ("ung", "heit"), "verbs": ("ing", "ado")}
PHRASES = {"english": ("the", "of", "and"), "french": ("que", "les"), "german": ("der", "die", "und"), "spanish": ("los", "del")}
QUOTAS = (Quota("german", 40), Quota("spanish", 30), Quota("french", 60), Quota("english", 100))
TARGET = 200
STRATA = Audit.strata
SEVERITIES = ("validity-critical", "method-critical", "evidence-critical", "presentation-critical", "style-preference")
CLAIM_TYPES = ("literature fact", "method design", "implementation result", "performance comparison", "ablation finding", "robustness finding", "limitation", "future work")
CLAIM_STATUSES = ("supported", "partially_supported", "unsupported", "pending_validation", "superseded", "invalidated")


def table(spark, d, name):
    return dealt(spark.read.parquet(f"{d}/{name}.parquet"))


def documents(spark, d):
    return table(spark, d, "documents").withColumn("title", F.concat(F.lit("document "), F.col("doc_id").cast("string")))


def quoted(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def values_sql(columns, rows):
    def cell(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({', '.join(columns)})"


# --- texts ---------------------------------------------------------------------------------------------------------------------------

CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(0), ' '), chr(13), chr(10)), '-\n([a-z])', '\1', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12))"
BROAD = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
COMPACT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
SENTENCES = rf"""sent AS (SELECT doc_id, title, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS place FROM (
  SELECT doc_id, 'document ' || doc_id AS title, list_filter(list_transform(string_split(regexp_replace({COMPACT}, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9) || '•-')), lambda x: length(x) BETWEEN 35 AND 600) AS s FROM documents))"""


def clean_text_stats(spark, d):
    body = text.clean(F.col("text"))
    return documents(spark, d).select("doc_id", body.alias("body")).select("doc_id", text.word_count(F.col("body")).alias("words"), text.char_count(F.col("body")).alias("chars"))


def content_checksums(spark, d):
    return documents(spark, d).select("doc_id", F.sha2("text", 256).alias("sha256"))


def duplicate_texts(spark, d):
    return documents(spark, d).groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def sentence_lengths(spark, d):
    found = documents(spark, d).select("doc_id", F.transform(text.sentences(F.col("text")), F.length).alias("n"))
    return found.select("doc_id", F.size("n").cast("long").alias("sentences"), F.aggregate("n", F.lit(0), lambda a, x: a + x).cast("long").alias("chars"))


def number_sentences(spark, d):
    return documents(spark, d).select("doc_id", F.size(F.filter(text.sentences(F.col("text")), text.has_result_number)).cast("long").alias("n")).filter("n > 0")


# --- themes --------------------------------------------------------------------------------------------------------------------------


def theme_rows(spark, d, phrases=True, most=1 << 30):
    scorer, words = (extract.phrase_scores, PHRASES) if phrases else (extract.substring_scores, LEXICON)
    return documents(spark, d).withColumn("theme_scores", scorer(F.lit(""), F.col("text"), words, most))


def lexicon_scores(spark, d):
    return theme_rows(spark, d, False).select("doc_id", *(F.col("theme_scores")[t].cast("long").alias(t) for t in LEXICON))


def phrase_theme_scores(spark, d):
    return theme_rows(spark, d).select("doc_id", *(F.col("theme_scores")[t].cast("long").alias(t) for t in PHRASES))


def active_themes(spark, d):
    return theme_rows(spark, d).select("doc_id", F.array_join(extract.active_themes(F.col("theme_scores")), ",").alias("themes"))


def theme_frequency(spark, d):
    rows = theme_rows(spark, d).withColumn("themes", extract.active_themes(F.col("theme_scores")))
    return summary.frequency(rows, "themes").withColumnRenamed("item", "theme")


def substring_sql(words):
    return " + ".join(f"(length(hay) - length(replace(hay, '{w}', ''))) // {len(w)}" for w in words)


def phrase_sql(words):
    return " + ".join(f"len(regexp_extract_all(hay, '(^|[^A-Za-z0-9]){w}($|[^A-Za-z0-9])'))" for w in words)


# Guards consume a character there, so that neighbouring phrases need two of them between: blanks are doubled first.
HAY = r"'document' AS x, lower(regexp_replace(text, '([^A-Za-z0-9])', '\1\1', 'g')) AS hay"
THEMES = f"themes AS (SELECT doc_id, text, source, {', '.join(f'{phrase_sql(w)} AS {t}' for t, w in PHRASES.items())} FROM (SELECT *, {HAY} FROM documents))"
LONG_THEMES = f"{THEMES}, long AS (SELECT doc_id, unnest([{quoted(PHRASES)}]) AS theme, unnest([{', '.join(PHRASES)}]) AS n FROM themes)"


# --- evidence and entities --------------------------------------------------------------------------------------------------------------

ROLE = Role("claims", (), ("tion", "the ", "ung"), 0, 3, True)


def evidence_top(spark, d):
    rows = documents(spark, d).select("doc_id", extract.evidence(F.col("text"), ROLE).alias("e"))
    return rows.select("doc_id", F.posexplode("e").alias("i", "sentence")).select("doc_id", (F.col("i") + 1).alias("rank"), "sentence")


EVIDENCE = rf"""WITH {SENTENCES},
scored AS (SELECT *, {' + '.join(f"CASE WHEN contains(lower(s), '{p}') THEN {extract.KEYWORD} ELSE 0 END" for p in ROLE.phrases)}
    + CASE WHEN regexp_matches(s, '(?:\b\d+(?:\.\d+)?\s*%|\b\d+\.\d+\b)') THEN {extract.NUMBER} ELSE 0 END
    + CASE WHEN contains(lower(s), 'we ') OR contains(lower(s), 'our ') THEN {extract.PRONOUN} ELSE 0 END - place * {extract.PLACE} AS score FROM sent),
once AS (SELECT *, row_number() OVER (PARTITION BY doc_id, substr(regexp_replace(lower(s), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'), 1, 160) ORDER BY score DESC, length(s), place) AS copy FROM scored WHERE score > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(s), place) AS rank FROM once WHERE copy = 1)
SELECT doc_id, rank::INT AS rank, s AS sentence FROM best WHERE rank <= {ROLE.cap}"""


def metric_entities(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(extract.metric_names(F.col("text"), ("Apache", "version", "License")), ",").alias("names")).filter("names <> ''")


def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(extract.links(F.concat_ws(" ", "url", "html")))).alias("link"))


# --- gates and selections ----------------------------------------------------------------------------------------------------------------


def labelled_quality(spark, d):
    """Documents labelled as good and not toxic with 300 words or more; the audit's own gate is gated_records."""
    rows = documents(spark, d).select("doc_id", text.word_count(F.col("text")).alias("words"))
    return rows.join(table(spark, d, "labels").filter("quality = 1 AND toxic = 0").select("doc_id"), "doc_id", "left_semi").filter("words >= 300")


def candidates(spark, d):
    """Narrow rows to select from: strata are sources, scores are exact in both engines."""
    weights = (Weight("english", 2.0, 40), Weight("french", 3.0, 30), Weight("german", 2.5, 20), Weight("spanish", 1.5))
    rows = theme_rows(spark, d)
    score = quality.weighted(F.col("theme_scores"), weights)
    return rows.select("doc_id", "title", F.col("source").alias("stratum"), score.alias("score"), extract.active_themes(F.col("theme_scores")).alias("themes"))


CANDIDATES = f"""{THEMES}, cand AS (SELECT doc_id, 'document ' || doc_id AS title, source AS stratum, english > 0 AS english, french > 0 AS french, german > 0 AS german, spanish > 0 AS spanish,
  2.0::DOUBLE * least(english, 40) + 3.0::DOUBLE * least(french, 30) + 2.5::DOUBLE * least(german, 20) + 1.5::DOUBLE * spanish AS score FROM themes)"""


def direct_scores(spark, d):
    return candidates(spark, d).select("doc_id", "score")


def direct_relevance(spark, d):
    rows = theme_rows(spark, d)
    return rows.filter(quality.directly_relevant(F.col("theme_scores"), strong=("spanish",), pairs=(("english", "german"),), above_one=("french",))).select("doc_id")


def stratified_topk(spark, d):
    return select.stratified(candidates(spark, d), TARGET).select("doc_id", "stratum", "score")


def v1_selection(spark, d):
    return select.v1_selection(candidates(spark, d), TARGET, 30).select("doc_id", "stratum", "score", "selected_rank")


V1 = f"""WITH {CANDIDATES},
sizes AS (SELECT stratum, row_number() OVER (ORDER BY count(*) DESC, stratum) AS ordinal FROM cand GROUP BY stratum),
placed AS (SELECT c.*, ordinal, row_number() OVER (PARTITION BY c.stratum ORDER BY score DESC, title, doc_id) AS place FROM cand c JOIN sizes USING (stratum)),
base AS (SELECT * FROM placed WHERE place <= {{quota}} + CASE WHEN ordinal <= {{rest}} THEN 1 ELSE 0 END)"""


def round_robin_fill(spark, d):
    return select.round_robin(candidates(spark, d), TARGET).select("doc_id", "stratum", "step")


def sequential_quota(spark, d):
    return select.sequential_quotas(candidates(spark, d), QUOTAS).select("doc_id", "phase", "step")


def v2_selection_rank(spark, d):
    return select.v2_selection(candidates(spark, d), 300, QUOTAS).select("doc_id", "phase", "step", "selected_rank", "score_rank")


def quota_report(spark, d):
    return select.quota_report(select.v2_selection(candidates(spark, d), 300, QUOTAS), QUOTAS)


def _quota_steps():
    sql, before = f"WITH {CANDIDATES}", "SELECT NULL::BIGINT AS doc_id WHERE false"
    for i, q in enumerate(QUOTAS, 1):
        sql += f""", q{i} AS (SELECT doc_id, {i} AS phase, row_number() OVER (ORDER BY score DESC, title, doc_id) AS step FROM cand WHERE {q.theme} AND doc_id NOT IN ({before})
  QUALIFY step <= {q.quota} - (SELECT count(*) FROM cand WHERE {q.theme} AND doc_id IN ({before})))"""
        before = " UNION ALL ".join(f"SELECT doc_id FROM q{j}" for j in range(1, i + 1))
    return sql + f", quotas AS ({' UNION ALL '.join(f'SELECT * FROM q{i}' for i in range(1, len(QUOTAS) + 1))})"


V2 = (
    _quota_steps()
    + f""", rest AS (SELECT * FROM cand WHERE doc_id NOT IN (SELECT doc_id FROM quotas)),
sizes AS (SELECT stratum, row_number() OVER (ORDER BY count(*) DESC, stratum) AS ordinal FROM rest GROUP BY stratum),
placed AS (SELECT doc_id, ordinal, row_number() OVER (PARTITION BY stratum ORDER BY score DESC, title, doc_id) AS place FROM rest JOIN sizes USING (stratum)),
turn AS (SELECT doc_id, {len(QUOTAS) + 1} AS phase, row_number() OVER (ORDER BY place, ordinal) AS step FROM placed QUALIFY step <= greatest(0, 300 - (SELECT count(*) FROM quotas))),
chosen AS (SELECT * FROM (SELECT * FROM quotas UNION ALL SELECT * FROM turn) ORDER BY phase, step LIMIT 300)"""
)


# --- summaries and strata ------------------------------------------------------------------------------------------------------------------


def corpus_summary(spark, d):
    return summary.measures(documents(spark, d).select(text.word_count(F.col("text")).alias("words")), "words")


def tfidf_terms(spark, d):
    bench = table(spark, d, "benchmark")
    return strata.tfidf(bench, "text", features=5000, id_col="item_id").select("item_id", "term", F.round("weight", 6).alias("weight"))


TFIDF = r"""
WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]{2,}') AS w FROM benchmark),
t AS (SELECT item_id, term, count(*) AS tf FROM (
  SELECT item_id, unnest(w) AS term FROM w UNION ALL
  SELECT item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w) GROUP BY ALL),
n AS (SELECT count(*) AS docs FROM benchmark),
k AS (SELECT term, count(*) AS df, sum(tf) AS total FROM t, n GROUP BY term, docs HAVING count(*) >= 2 AND count(*) <= 0.92 * docs ORDER BY total DESC, term LIMIT 5000),
r AS (SELECT item_id, t.term, (1 + ln(tf)) * (1 + ln((1 + docs) / (1 + df))) AS raw FROM t JOIN k USING (term), n)
SELECT item_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY item_id)), 6) AS weight FROM r
"""


DOCUMENT_TFIDF = TFIDF.replace("item_id", "doc_id").replace("benchmark", "documents").replace("LIMIT 5000", "LIMIT 40000")


def tfidf_documents(spark, d):
    """The weights of all documents with the operator's own 40,000 terms; tfidf_terms weighs the benchmark's items with 5,000."""
    return strata.tfidf(table(spark, d, "documents"), "text").select("doc_id", "term", F.round("weight", 6).alias("weight"))


def semantic_strata(spark, d):
    """Clusters of the documents with the second audit's own settings; labels aren't comparable across libraries. Documents without a weight are in cluster -1."""
    docs = table(spark, d, "documents")
    found = strata.strata(docs, "text", STRATA, **V2_STRATA)
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), F.coalesce("distance", F.lit(0.0)).alias("distance"))


def centroid_distance(spark, d):
    found = strata.centroid_distances(table(spark, d, "embeddings"), "embedding", "label", "vec_id")
    return found.select("vec_id", "label", F.round("distance", 4).alias("distance"))


# --- leakage and scans ---------------------------------------------------------------------------------------------------------------------


def split_leakage(spark, d):
    rows = table(spark, d, "events").withColumn("split", F.col("event_id") % 3)
    return leakage.entity_overlap(rows, "user_id", "split")


def group_splits(spark, d):
    return leakage.group_split(table(spark, d, "events").select("user_id").distinct(), "user_id").groupBy("split").agg(F.count("*").alias("users"))


def scored_labels(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("score")), "doc_id")


def task_metrics(spark, d):
    return leakage.confusion(scored_labels(spark, d), "quality", "score", 0.5, ("lang",)).select("lang", "tp", "fp", "fn", "tn")


def calibration_bins(spark, d):
    return leakage.calibration(scored_labels(spark, d), "quality", "score").select("bin", "n", F.round("observed", 6).alias("observed"))


def content_overlap(spark, d):
    docs = table(spark, d, "documents")
    return leakage.content_overlap(docs, docs.select(F.col("doc_id").alias("item_id"), "text").filter("item_id % 100 = 0")).filter("doc_id <> item_id")


def overlap_classes(spark, d):
    """The overlaps of all documents; content_overlap, as its SQL, sees pairs with every hundredth."""
    return leakage.overlap_classes(table(spark, d, "documents"))


def phrase_scan(spark, d):
    return scan.phrase_scan(table(spark, d, "conversations"), {"english": ("the", "of"), "german": ("der", "die")}, id_col=("conv_id", "turn"))


def repeated_openers(spark, d):
    return scan.repeated_openers(table(spark, d, "documents"))


def routing(spark, d):
    return scan.route(table(spark, d, "documents"), PHRASES)


# --- ledgers ---------------------------------------------------------------------------------------------------------------------------------


QUERIES = {
    f.__name__: f
    for f in (
        clean_text_stats, content_checksums, duplicate_texts, sentence_lengths, number_sentences, lexicon_scores, phrase_theme_scores, active_themes, theme_frequency, evidence_top, metric_entities, page_links,
        labelled_quality, direct_scores, direct_relevance, stratified_topk, v1_selection, round_robin_fill, sequential_quota, v2_selection_rank, quota_report, corpus_summary, tfidf_terms, tfidf_documents, semantic_strata, centroid_distance,
        split_leakage, group_splits, task_metrics, calibration_bins, content_overlap, overlap_classes, phrase_scan, repeated_openers, routing,
    )
}

ORACLES = {
    "clean_text_stats": rf"SELECT doc_id, CASE WHEN b = '' THEN 0 ELSE len(regexp_split_to_array(b, '\s+')) END::BIGINT AS words, length(b) AS chars FROM (SELECT doc_id, {CLEAN} AS b FROM documents)",
    "content_checksums": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "duplicate_texts": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "sentence_lengths": f"WITH {SENTENCES} SELECT d.doc_id, count(s) AS sentences, coalesce(sum(length(s)), 0)::BIGINT AS chars FROM documents d LEFT JOIN sent USING (doc_id) GROUP BY 1",
    "number_sentences": rf"WITH {SENTENCES} SELECT doc_id, count(*) AS n FROM sent WHERE regexp_matches(s, '(?:\b\d+(?:\.\d+)?\s*%|\b\d+\.\d+\b)') GROUP BY 1",
    "lexicon_scores": f"SELECT doc_id, {', '.join(f'({substring_sql(w)})::BIGINT AS {t}' for t, w in LEXICON.items())} FROM (SELECT doc_id, lower(text) AS hay FROM documents)",
    "phrase_theme_scores": f"WITH {THEMES} SELECT doc_id, {', '.join(PHRASES)} FROM themes",
    "active_themes": f"WITH {LONG_THEMES} SELECT doc_id, coalesce(string_agg(theme, ',' ORDER BY n DESC, theme) FILTER (n > 0), '') AS themes FROM long GROUP BY doc_id",
    "theme_frequency": f"WITH {LONG_THEMES} SELECT theme, count(*) AS n FROM long WHERE n > 0 GROUP BY theme",
    "evidence_top": EVIDENCE,
    "metric_entities": r"SELECT * FROM (SELECT doc_id, array_to_string(list_filter(['Apache', 'version', 'License'], lambda n: regexp_matches(text, '(?i)\b' || n || '\b')), ',') AS names FROM documents) WHERE names <> ''",
    "page_links": r"SELECT DISTINCT page_id, rtrim(unnest(regexp_extract_all(concat_ws(' ', url, html), 'https?://[^\s\]\[)>(]+')), '.,;') AS link FROM pages",
    "labelled_quality": r"SELECT doc_id, len(regexp_split_to_array(trim(text), '\s+'))::BIGINT AS words FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AND words >= 300",
    "direct_scores": f"WITH {CANDIDATES} SELECT doc_id, score FROM cand",
    "direct_relevance": f"WITH {THEMES} SELECT doc_id FROM themes WHERE spanish > 0 OR french > 1 OR english > 0 AND german > 0",
    "stratified_topk": V1.format(quota=f"(SELECT {TARGET} // count(*) FROM sizes)", rest=f"(SELECT {TARGET} % count(*) FROM sizes)") + " SELECT doc_id, stratum, score FROM base",
    "v1_selection": V1.format(quota=TARGET // 30, rest=TARGET % 30) + f""", filled AS (SELECT doc_id, title, stratum, score FROM base UNION ALL
  (SELECT doc_id, title, stratum, score FROM cand WHERE doc_id NOT IN (SELECT doc_id FROM base) QUALIFY row_number() OVER (ORDER BY score DESC, title, doc_id) <= greatest(0, {TARGET} - (SELECT count(*) FROM base))))
SELECT doc_id, stratum, score, (row_number() OVER (ORDER BY score DESC, stratum, title, doc_id))::INT AS selected_rank FROM filled QUALIFY selected_rank <= {TARGET}""",
    "round_robin_fill": V1.format(quota=0, rest=0) + f" SELECT doc_id, stratum, (row_number() OVER (ORDER BY place, ordinal))::INT AS step FROM placed QUALIFY step <= {TARGET}",
    "sequential_quota": _quota_steps() + " SELECT doc_id, phase::INT AS phase, step::INT AS step FROM quotas",
    "v2_selection_rank": V2 + """ SELECT doc_id, phase::INT AS phase, step::INT AS step, (row_number() OVER (ORDER BY phase, step))::INT AS selected_rank,
  (row_number() OVER (ORDER BY score DESC, title, doc_id))::INT AS score_rank FROM chosen JOIN cand USING (doc_id)""",
    "quota_report": V2 + " " + " UNION ALL ".join(f"SELECT {i}::INT AS priority, '{q.theme}' AS theme, {q.quota}::BIGINT AS quota, (SELECT count(*) FROM chosen JOIN cand USING (doc_id) WHERE {q.theme}) AS achieved" for i, q in enumerate(QUOTAS, 1)),
    "corpus_summary": r"SELECT count(*) AS n, sum(w)::BIGINT AS total, min(w) AS least, max(w) AS most, avg(w) AS mean, median(w)::DOUBLE AS median FROM (SELECT len(regexp_split_to_array(trim(text), '\s+'))::BIGINT AS w FROM documents)",
    "tfidf_terms": TFIDF,
    "tfidf_documents": DOCUMENT_TFIDF,
    "centroid_distance": """WITH p AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(v) AS m FROM p GROUP BY ALL)
SELECT vec_id, label, round(sqrt(sum((v - m) * (v - m))), 4) AS distance FROM p JOIN c USING (label, i) GROUP BY vec_id, label""",
    "split_leakage": "SELECT user_id, count(DISTINCT event_id % 3) AS splits, count(*) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_id % 3) > 1",
    "group_splits": "SELECT (('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 10)::INT AS split, count(*) AS users FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1",
    "routing": f"WITH {LONG_THEMES}, o AS (SELECT doc_id, theme, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, theme) AS i FROM long WHERE n > 0) SELECT d.doc_id, max(theme) FILTER (i = 1) AS primary, max(theme) FILTER (i = 2) AS secondary FROM documents d LEFT JOIN o USING (doc_id) GROUP BY d.doc_id",
    "task_metrics": """SELECT lang, count(*) FILTER (quality = 1 AND s >= 0.5) AS tp, count(*) FILTER (quality <> 1 AND s >= 0.5) AS fp, count(*) FILTER (quality = 1 AND s < 0.5) AS fn, count(*) FILTER (quality <> 1 AND s < 0.5) AS tn
FROM (SELECT lang, quality, least(n_chars / 5000.0::DOUBLE, 1.0) AS s FROM labels JOIN documents USING (doc_id)) GROUP BY lang""",
    "calibration_bins": "SELECT least(floor(s * 10), 9)::INT AS bin, count(*) AS n, round(avg(quality), 6) AS observed FROM (SELECT quality, least(n_chars / 5000.0::DOUBLE, 1.0) AS s FROM labels JOIN documents USING (doc_id)) GROUP BY 1",
    "content_overlap": r"""WITH k AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_]+', ' ', 'g'))) AS k FROM documents)
SELECT a.doc_id, b.doc_id AS item_id FROM k a JOIN k b USING (k) WHERE b.doc_id % 100 = 0 AND a.doc_id <> b.doc_id""",
    "overlap_classes": r"""WITH k AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_]+', ' ', 'g'))) AS key FROM documents)
SELECT doc_id, key, min(doc_id) OVER (PARTITION BY key) AS first_id, count(*) OVER (PARTITION BY key) AS n FROM k WHERE key IS NOT NULL QUALIFY n > 1""",
}


def entry(spark, d):
    """The flagship: the best rows of each stratum by theme score, over whole texts."""
    return stratified_topk(spark, d)
