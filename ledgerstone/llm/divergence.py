"""How far the sources of a language diverge, term by term: counts and pair sums by DuckDB in shards, sums and rankings by Spark.

Tasks tokenise and count texts in vectorised SQL and hand on one row a language, source and term. Those are hashed into shards by
language and term, so that a shard knows all there is of its terms; each shard counts, keeps the terms that are in enough documents,
and later adds up what its terms give to every pair of sources. Spark merges the partial sums and candidates and ranks them.

A term says something of two sources even if it stands in neither, but the sum over terms need not visit what is absent. With f(a, b)
of two shares, a share being a function of a count, the sum over the V terms of a language is

    (V - n_s - n_t) f(s0, t0) + sum over n_s terms of f(s, t0) + sum over n_t terms of f(s0, t) + sum over terms of both of [f(s, t) - f(s, t0) - f(s0, t) + f(s0, t0)]

where s0 and t0 are the shares of an absent term. Shards add up the last part; the two before it need but the number of terms of each
count of each source. All numbers are integers, so that nothing depends on how rows are dealt.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialise, table

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000
TEXT_BYTES = 8 << 20  # of text that one SQL statement tokenises
HELD = 2_000_000  # rows that a task holds before it merges and hands them on
CHUNK = 200_000  # rows of a shard that one SQL statement sees, and the sources of one term
GROUPS = 100_000  # rows of the table of groups that may be broadcast
TOP = 200


def database():
    """A DuckDB of one thread in bounded memory, which never spills to a folder of the machine."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "900MB", "temp_directory": "", "preserve_insertion_order": False})


def asked(con, sql: str, **tables) -> pa.Table:
    for name, rows in tables.items():
        con.register(name, rows)
    out = con.execute(sql).to_arrow_table()
    for name in tables:
        con.unregister(name)
    return out


def slices(batches, most: int):
    """Record batches cut into slices of texts with so many bytes together; a longer text is a slice of its own."""
    for batch in batches:
        ends, at, n = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch["text"]), 0).cast(pa.int64())).to_pylist(), 0, len(batch)
        while at < n:
            before, end = ends[at - 1] if at else 0, at + 1
            while end < n and ends[end] - before <= most:
                end += 1
            yield batch.slice(at, end - at)
            at = end


COUNT = f"""SELECT lang, source, term, sum(n)::BIGINT AS n, count(*)::BIGINT AS docs FROM (
  SELECT row, lang, source, term, count(*) AS n FROM (
    SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM (SELECT *, row_number() OVER () AS row FROM texts))
  GROUP BY ALL) GROUP BY ALL"""
MERGE = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL"


def counted(batches):
    """lang, source, term, n, docs of a task's texts, each once for about HELD rows."""
    con, held, rows = database(), [], 0

    def merged():
        return asked(con, MERGE, held=pa.concat_tables(held)).to_batches()

    for part in slices(batches, TEXT_BYTES):
        held.append(asked(con, COUNT, texts=pa.table(part)))
        rows += len(held[-1])
        if rows > HELD:
            yield from merged()
            held, rows = [], 0
    if held:
        yield from merged()
    con.close()


def chunks(batches, rows: int):
    """Tables of at least so many rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def kept_terms(least: int, chunk: int):
    """A function of a shard's rows, sorted by language and term: lang, term, by_source (an array of source and n) of the terms in `least` documents or more.

    The sources of the last term of a chunk wait for the next one, so that a term is counted whole and no chunk holds more than its rows and those.
    """
    keep = f"SELECT lang, term, list({{'source': source, 'n': n}}) AS by_source FROM held GROUP BY lang, term HAVING sum(docs) >= {least}"

    def keeping(batches):
        con, waits = database(), None
        for rows in chunks(batches, chunk):
            merged = asked(con, MERGE, held=pa.concat_tables([waits, rows]) if waits is not None else rows)
            last = pc.and_(pc.equal(merged["lang"], rows["lang"][-1]), pc.equal(merged["term"], rows["term"][-1]))
            waits = merged.filter(last).select(rows.column_names).cast(rows.schema)
            yield from asked(con, keep, held=merged.filter(pc.invert(last))).to_batches()
        if waits is not None:
            yield from asked(con, keep, held=waits).to_batches()
        con.close()

    return keeping


def share(count: str, of: str, kind="HUGEINT") -> str:
    return f"(1 + ({SCALE}::{kind} * ({count} + 1) // {of}))::BIGINT"


def gap(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) // ({q}))"


SHARES = f"SELECT lang, term, source, {share('n', 'size')} AS p, {share('0', 'size')} AS p0, {share('lang_n', 'lang_size')} AS q FROM held"
PAIRS = f"""SELECT 'pair' AS part, lang, source, item, sum(value)::DECIMAL(38, 0) AS value FROM (
  SELECT s.lang, s.source, t.source AS item, {gap('s.p', 't.p')} - {gap('s.p', 't.p0')} - {gap('s.p0', 't.p')} + {gap('s.p0', 't.p0')} AS value
  FROM shares s JOIN shares t ON s.lang = t.lang AND s.term = t.term AND s.source <> t.source
  UNION ALL SELECT lang, source, item, value FROM pairs) GROUP BY ALL"""
TERMS = f"""SELECT * FROM (
  SELECT 'term' AS part, lang, source, term AS item, {gap('p', 'q')}::DECIMAL(38, 0) AS value FROM shares WHERE p > q
  UNION ALL SELECT part, lang, source, item, value FROM terms)
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {{top}}"""
PARTIAL = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.decimal128(38, 0))])


def partial_sums(top: int, chunk: int):
    """A function of rows lang, term, source, n, size, lang_n, lang_size, of which those of a term follow one another: the task's sums by pair and its best terms by source."""

    def summing(batches):
        con, pairs, terms, waits = database(), PARTIAL.empty_table(), PARTIAL.empty_table(), None

        def add(rows):
            shares = asked(con, SHARES, held=rows)
            return asked(con, PAIRS, shares=shares, pairs=pairs).cast(PARTIAL), asked(con, TERMS.format(top=top), shares=shares, terms=terms).cast(PARTIAL)

        for rows in chunks(batches, chunk):
            rows = pa.concat_tables([waits, rows]) if waits is not None else rows
            last = pc.and_(pc.equal(rows["lang"], rows["lang"][-1]), pc.equal(rows["term"], rows["term"][-1]))
            waits = rows.filter(last)
            pairs, terms = add(rows.filter(pc.invert(last)))
        if waits is not None:
            pairs, terms = add(waits)
        yield from pairs.to_batches() + terms.to_batches()
        con.close()

    return summing


def spark_share(count: str, of: str) -> str:
    return f"(1 + cast({SCALE} as decimal(20, 0)) * ({count} + 1) div {of})"


def spark_gap(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def diverge(docs: DataFrame, least=3, top=TOP, chunk=CHUNK, groups=GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank. docs: text, lang, source.

    Terms are runs of ASCII letters and characters beyond ASCII, with A to Z made lower case; a language keeps those in `least` of its documents.
    Part `pair`: each other source of the language by its gap, the sum over kept terms; part `term`: kept terms of which the source has more than
    its language, the `top` with the largest gaps. Ranks go by gap downwards, then item in UTF-8 order.
    Null and empty texts have no terms, but their language and source are a group; null languages and sources are ''. Bytes that aren't UTF-8 count
    as U+FFFD. Rows are documents: repeated ones count each on its own. Groups without terms have pairs of 0. No rows give no rows; a language with one
    source has no pairs. Only the three columns are read; others, whatever their names, are ignored. Texts are read whole, in slices of some megabytes.
    chunk: rows of a shard in one statement. groups: rows of the table of sources that may be broadcast; a longer one is joined by a shuffle.
    """
    spark = docs.sparkSession
    blank = F.lit("")
    own = docs.select(F.coalesce("lang", blank).alias("lang"), F.coalesce("source", blank).alias("source"), F.make_valid_utf8(F.coalesce("text", blank)).alias("text"))
    counts = own.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    shards = counts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lang", "term").sortWithinPartitions("lang", "term")
    terms = materialise(shards.mapInArrow(kept_terms(least, chunk), "lang string, term string, by_source array<struct<source:string,n:bigint>>"), "divergence-terms")

    by_term = terms.select("lang", "term", F.aggregate("by_source", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("lang_n"), F.explode("by_source").alias("x")).select("lang", "term", "lang_n", "x.source", "x.n")
    sizes = materialise(by_term.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")), "divergence-sizes")  # how many terms a source has of each count
    words = sizes.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("words"), F.sum("terms").alias("present"))
    known = terms.groupBy("lang").agg(F.count("*").alias("v"))
    found = own.select("lang", "source").distinct().join(words, ["lang", "source"], "left").join(known, "lang", "left").fillna(0, ["words", "present", "v"])
    by_lang = found.groupBy("lang").agg((F.sum("words") + F.first("v")).alias("lang_size"))
    found = materialise(found.join(by_lang, "lang").withColumn("size", F.col("words") + F.col("v")), "divergence-groups")
    few = found.count() <= groups
    small = (lambda rows: F.broadcast(rows)) if few else (lambda rows: rows)

    flat = by_term.join(small(found.select("lang", "source", "size", "lang_size")), ["lang", "source"]).select("lang", "term", "source", "n", "size", "lang_n", "lang_size")
    if not few:
        flat = flat.repartition("lang", "term").sortWithinPartitions("lang", "term")
    partial = materialise(flat.mapInArrow(partial_sums(top, chunk), "part string, lang string, source string, item string, value decimal(38,0)"), "divergence-partial")
    drop(terms)

    one = found.filter("size > 0").select("lang", F.col("source").alias("other"), F.expr(spark_share("0", "size")).alias("o0"))
    mine = sizes.join(small(found.select("lang", "source", "size")), ["lang", "source"]).select("lang", "source", "terms", F.expr(spark_share("n", "size")).alias("p"))
    ends = mine.join(small(one), "lang").filter("source <> other")
    side = lambda a, b, p, q: F.struct(F.col(a).alias("source"), F.col(b).alias("item"), (F.expr(spark_gap(p, q)) * F.col("terms").cast("decimal(20,0)")).cast("decimal(38,0)").alias("value"))
    ends = ends.select("lang", F.explode(F.array(side("source", "other", "p", "o0"), side("other", "source", "o0", "p"))).alias("x")).select("lang", "x.*")
    a = found.select("lang", "source", "v", F.col("present").alias("n_s"), F.col("size").alias("size_s"))
    b = found.select("lang", F.col("source").alias("item"), F.col("present").alias("n_t"), F.col("size").alias("size_t"))
    both = a.join(small(b), "lang").filter("source <> item")
    rest = F.expr(f"if(v = 0, 0, cast(v - n_s - n_t as decimal(20, 0)) * {spark_gap(spark_share('0', 'size_s'), spark_share('0', 'size_t'))})")
    absent = both.select("lang", "source", "item", rest.cast("decimal(38,0)").alias("value"))
    sums = absent.unionByName(ends).unionByName(partial.filter("part = 'pair'").drop("part")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit("pair"))
    firsts = partial.filter("part = 'term'").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return pairs.unionByName(firsts).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


def op13_divergence(spark, sf_dir):
    return diverge(table(spark, sf_dir, "documents"))


def _gap(p, q):
    return f"({p} - {q}) * ({p} - {q}) // {q}"


ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS words FROM documents),
t AS (SELECT row, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, term, n, 1 + {SCALE} * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM x),
l AS (SELECT lang, term, 1 + {SCALE} * (n + 1) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM (SELECT lang, term, sum(n) AS n FROM x GROUP BY ALL)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum({_gap('a.p', 'b.p')}) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
term AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, ({_gap('p', 'q')})::BIGINT AS value FROM s JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= {TOP}"""
