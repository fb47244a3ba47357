"""Queries of the remaining rules: append-only ledgers, gates, completion, routes, recency, rescans, gaps and metrics, over made-up ledgers or the test data; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import V2_STRATA, Audit, from_environment
from ..functions.text import strip
from ..operators import leakage, quality, ranks, scan, strata
from .registry import BROAD, COMPACT, STRATA, scored_labels, table

CLASSES = {"english": ("the", "of"), "german": ("der", "die")}


def made(spark, rows, schema):
    return spark.createDataFrame(list(rows), schema)


def recent_orders(spark, d):
    """The recency window over a table with years."""
    return scan.recent(table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")), 1998, 2)


def rescan(spark, d):
    """Findings of a conversation's assistant turns beyond those of its user turns: what a second scan finds anew."""
    turns = table(spark, d, "conversations").select("conv_id", "role", "text")
    found = {r: scan.phrase_scan(turns.filter(F.col("role") == r), CLASSES, id_col="conv_id").select("conv_id", "class", "n") for r in ("user", "assistant")}
    return scan.new_findings(found["user"], found["assistant"])


def generalisation(spark, d):
    """Mean scores by language on either side of a split, and whether their gap is wide."""
    rows = scored_labels(spark, d).withColumn("split", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test"))
    gaps = leakage.generalisation_gap(rows.select(F.col("lang").alias("model"), "split", "score", "doc_id"), 0.02, "doc_id")
    return gaps.select("model", *(F.round(c, 6).alias(c) for c in ("train", "test", "gap")), "wide")


def ranking_metrics(spark, d):
    """Of scores as they are, and of the same below zero: ranks are all that counts for two of the three."""
    rows = scored_labels(spark, d).withColumn("below", F.col("score") - 1)
    both = ranks.ranking(rows, "quality", "score").crossJoin(ranks.ranking(rows, "quality", "below").select(F.col("auroc").alias("auroc_below")))  # one row each
    return both.crossJoin(leakage.rmse(rows, "quality", "score")).select(*(F.round(c, 6).alias(c) for c in ("auroc", "auprc", "auroc_below", "rmse")))


def signal_metrics(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_quantity") + F.col("l_linenumber") - 4).alias("seen"))
    found = leakage.signal_quality(rows, "l_quantity", "seen", 50.0, ("l_returnflag",))
    return found.select("l_returnflag", *(F.round(c, 6).alias(c) for c in ("mse", "snr_db", "psnr_db", "ssim")))


def bit_errors(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", (F.col("l_orderkey") + F.col("l_linenumber") % 2).alias("seen"))
    return leakage.bit_error_rate(rows, "l_orderkey", "seen", 32, ("l_returnflag",)).select("l_returnflag", "bits", "errors", F.round("rate", 9).alias("rate"))


def environment(spark, d):
    audit, root, out = from_environment(Audit(lexicon={}))
    return made(spark, [(audit.target, root, out)], "target long, root string, out string")


def strata_invariants(spark, d):
    """What holds of the strata of all documents whatever the library: every document once, at most as many strata as asked for, distances in range, no stratum that takes nearly all."""
    docs = table(spark, d, "documents")
    found = strata.strata(docs, "text", STRATA, **V2_STRATA)
    both = docs.select("doc_id").join(found, "doc_id", "left")
    known = F.col("cluster_id").isNotNull()
    share = F.max(F.struct("n", "cluster_id"))["n"] / F.sum("n")
    sizes = found.groupBy("cluster_id").agg(F.count("*").alias("n")).agg((share < 0.9).alias("spread"), (F.count("*") <= STRATA).alias("few"))
    return both.agg(F.count("*").alias("documents"), F.count_distinct("doc_id").alias("ids"), F.bool_and(~known | F.col("distance").between(0.0, 2.0)).alias("in_range"), (F.count_if(known) > 0).alias("some")).crossJoin(sizes)


def ranked_in_strata(spark, d):
    """The ten vectors nearest to the mean of their label: the rank within a stratum."""
    near = strata.centroid_distances(table(spark, d, "embeddings"), "embedding", "label", "vec_id").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster_id"), F.round("distance", 6).alias("distance"))
    return strata.rank_in_cluster(near).filter("rank <= 10").select(F.col("doc_id").alias("vec_id"), F.col("cluster_id").alias("label"), "rank")


def theme_members(spark, d):
    """Pages by whether a theme's score is above one, and the capped sum of their scores."""
    scores = F.create_map(F.lit("links"), F.regexp_count("html", F.lit("href=")), F.lit("paragraphs"), F.regexp_count("html", F.lit("<p>")))
    pages = table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html")).select("page_id", scores.alias("s"))
    return pages.select("page_id", quality.directly_relevant(F.col("s"), above_one=("links",)).alias("linked"), quality.capped_sum(F.col("s"), 3).cast("long").alias("capped"))


QUERIES = {
    f.__name__: f
    for f in (
        recent_orders, rescan, generalisation, ranking_metrics, signal_metrics, bit_errors,
        environment, strata_invariants, ranked_in_strata, theme_members,
    )
}

SPLIT = f"""par AS (SELECT {{ids}}, unnest(l) AS b, generate_subscripts(l, 1) - 1 AS paragraph FROM (SELECT {{ids}}, regexp_split_to_array({{text}}, '\\n[ \\t]*\\n\\s*') AS l FROM {{src}})),
body AS (SELECT {{ids}}, paragraph, trim(b, {BROAD}) AS body FROM par WHERE trim(b, {BROAD}) <> '')"""


def counted(words):
    return " + ".join(f"len(regexp_extract_all(lower(regexp_replace(body, '([^A-Za-z0-9])', '\\1\\1', 'g')), '(^|[^A-Za-z0-9]){w}($|[^A-Za-z0-9])'))" for w in words)


def scanned(ids, src, text="text"):
    return f"{SPLIT.format(ids=ids, src=src, text=text)}, found AS ({' UNION ALL '.join(f'SELECT {ids}, paragraph, {chr(39)}{c}{chr(39)} AS class, {counted(w)} AS n FROM body' for c, w in CLASSES.items())})"


LABELLED = "l AS (SELECT doc_id, lang, quality, least(n_chars / 5000.0::DOUBLE, 1.0) AS score FROM labels JOIN documents USING (doc_id))"

ORACLES = {
    "recent_orders": "SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998",
    "rescan": f"""WITH src AS (SELECT conv_id, role, text FROM conversations), {scanned('conv_id, role', 'src')}
SELECT conv_id, class, n::BIGINT AS n FROM found WHERE n > 0 AND role = 'assistant' EXCEPT ALL SELECT conv_id, class, n::BIGINT FROM found WHERE n > 0 AND role = 'user'""",
    "generalisation": f"""WITH {LABELLED}, m AS (SELECT lang AS model, avg(score) FILTER (doc_id % 2 = 0) AS train, avg(score) FILTER (doc_id % 2 <> 0) AS test FROM l GROUP BY lang)
SELECT model, round(train, 6) AS train, round(test, 6) AS test, round(train - test, 6) AS gap, train - test > 0.02::DOUBLE AS wide FROM m""",
    "ranking_metrics": f"""WITH {LABELLED}, s AS (SELECT quality, score FROM l), h AS (SELECT score, sum(quality) AS p, count(*) - sum(quality) AS n FROM s GROUP BY score),
roc AS (SELECT sum(a.p * b.n * CASE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 1 END) AS wins FROM h a JOIN h b ON b.score <= a.score),
pr AS (SELECT p, sum(p) OVER w AS tp, sum(p + n) OVER w AS al FROM h WINDOW w AS (ORDER BY score DESC))
SELECT round((SELECT wins FROM roc) / ((SELECT sum(p) FROM h) * (SELECT sum(n) FROM h)), 6) AS auroc, round((SELECT sum(p * tp / al::DOUBLE) / sum(p) FROM pr), 6) AS auprc, round((SELECT wins FROM roc) / ((SELECT sum(p) FROM h) * (SELECT sum(n) FROM h)), 6) AS auroc_below, round((SELECT sqrt(avg((quality - score) * (quality - score))) FROM s), 6) AS rmse""",
    "signal_metrics": """WITH s AS (SELECT l_returnflag, l_quantity AS x, l_quantity + l_linenumber - 4 AS y FROM lineitem),
m AS (SELECT l_returnflag, avg((x - y) * (x - y)) AS mse, avg(x * x) AS pw, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS cxy FROM s GROUP BY 1)
SELECT l_returnflag, round(mse, 6) AS mse, round(10 * log10(pw / mse), 6) AS snr_db, round(10 * log10(2500 / mse), 6) AS psnr_db,
  round((2 * mx * my + 0.25::DOUBLE) * (2 * cxy + 2.25::DOUBLE) / ((mx * mx + my * my + 0.25::DOUBLE) * (vx + vy + 2.25::DOUBLE)), 6) AS ssim FROM m""",
    "bit_errors": "SELECT l_returnflag, count(*) * 32 AS bits, sum(bit_count(xor(l_orderkey, l_orderkey + l_linenumber % 2)))::BIGINT AS errors, round(sum(bit_count(xor(l_orderkey, l_orderkey + l_linenumber % 2))) / (count(*) * 32.0::DOUBLE), 9) AS rate FROM lineitem GROUP BY 1",
    "environment": "SELECT 1000::BIGINT AS target, 'corpus' AS root, 'audit' AS out",
    "strata_invariants": "SELECT count(*) AS documents, count(DISTINCT doc_id) AS ids, true AS in_range, true AS some, true AS spread, true AS few FROM documents",
    "ranked_in_strata": """WITH p AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM p GROUP BY ALL),
q AS (SELECT vec_id, label, round(sqrt(sum((v - m) * (v - m))), 6) AS distance FROM p JOIN c USING (label, i) GROUP BY vec_id, label)
SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY distance, vec_id))::INT AS rank FROM q QUALIFY rank <= 10""",
    "theme_members": "SELECT page_id, len(regexp_extract_all(h, 'href=')) > 1 AS linked, (least(len(regexp_extract_all(h, 'href=')), 3) + least(len(regexp_extract_all(h, '<p>')), 3))::BIGINT AS capped FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)",
}
# The scans that the registry of queries holds, with the SQL that this module can state.
SCANS = {
    "phrase_scan": f"WITH {scanned('conv_id, turn', 'conversations')} SELECT conv_id, turn, paragraph::INT AS paragraph, class, n::BIGINT AS n FROM found WHERE n > 0",
    "repeated_openers": rf"""WITH {SPLIT.format(ids='doc_id', src='documents', text='text')},
s AS (SELECT doc_id, paragraph, unnest(list_filter(list_transform(string_split(regexp_replace({COMPACT.replace('text', 'body')}, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9) || '•-')), lambda x: length(x) >= 1)) AS s FROM body),
c AS (SELECT doc_id, paragraph, lower(regexp_extract(s, '^[^\p{{L}}\p{{M}}\p{{N}}_]*([\p{{L}}\p{{M}}\p{{N}}_]+)', 1)) AS opener, count(*) AS n FROM s GROUP BY ALL),
b AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, paragraph) AS total, row_number() OVER (PARTITION BY doc_id, paragraph ORDER BY n DESC, opener) AS i FROM c)
SELECT doc_id, paragraph::INT AS paragraph, opener, n, total::BIGINT AS of FROM b WHERE i = 1 AND total >= 3 AND n >= 0.5 * total""",
}
