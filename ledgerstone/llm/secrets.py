"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is content-addressed. The ledger, a Parquet table, holds for each blob the
rule versions that have been run over it and what they found. A scan runs only over blob and
rule-version pairs the ledger lacks, each blob once however many paths hold it, and findings are then
joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, work_path


@dataclass(frozen=True)
class Rule:
    """group and least: keep a match whose group has that many characters at least."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# Runs of one character class are maximal, so that a lower bound inside the pattern drops just the matches that are too short.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + MORE
SPANS = "array<struct<rule:string,start:int,end:int>>"  # in the ledger: each span says which version of which rule found it
FOUND = "array<struct<start:int,ord:int,kind:string,end:int>>"  # as callers see them; ord: the rule's place among the rules asked for


def spans(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches in code points. The pieces between matches and the matches tell where each begins."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pieces = F.split(text, rule.pattern, -1)
    sizes = F.zip_with(F.slice(pieces, F.lit(1), F.size(whole)), whole, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("n")))
    if rule.least:
        kept = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda g: F.length(g) >= rule.least)
    else:
        kept = F.transform(whole, lambda _: F.lit(True))
    none = F.expr(f"cast(array() as {SPANS})")
    begin = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc, x):
        start = acc["at"] + x["s"]["gap"]
        end = (start + x["s"]["n"]).cast("int")
        one = F.array(F.struct(F.lit(rule.name).alias("rule"), start.cast("int").alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["k"], F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    walked = F.aggregate(F.zip_with(sizes, kept, lambda s, k: F.struct(s.alias("s"), k.alias("k"))), begin, step, lambda acc: acc["found"])
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), walked).otherwise(none)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read_ledger(spark, ledger: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    schema = f"blob binary, rules array<string>, found {SPANS}"
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(schema).parquet(ledger)
    return spark.createDataFrame([], schema)


def update(texts: DataFrame, ledger: str, rules=RULES, text_col="text") -> DataFrame:
    """Scan the blob and rule-version pairs of texts that the ledger lacks, append them to it, and return the whole ledger.

    A null text is the empty blob. A blob that holds a third of all rows leaves each map task once. Ledger rows are only ever
    appended, by one job whose output is committed at its end: a scan that fails leaves the ledger as it was.
    """
    spark = texts.sparkSession
    names = [r.name for r in rules]
    known = read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    blobs = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", digest(F.col("text")))
    none_seen = F.expr("cast(array() as array<string>)")
    if known.isEmpty():
        todo = blobs.dropDuplicates(["blob"]).withColumn("seen", none_seen)
    else:
        complete = known.filter(F.size(F.array_except(F.array(*map(F.lit, names)), "seen")) == 0)
        partly = known.join(complete.select("blob"), "blob", "left_anti")
        todo = blobs.join(complete.select("blob"), "blob", "left_anti").dropDuplicates(["blob"]).join(partly, "blob", "left").withColumn("seen", F.coalesce("seen", none_seen))
    due = F.array_except(F.array(*map(F.lit, names)), "seen")
    found = F.concat(*(F.when(F.array_contains("due", r.name), spans(F.col("text"), r)).otherwise(F.expr(f"cast(array() as {SPANS})")) for r in rules))
    todo.withColumn("due", due).select("blob", F.col("due").alias("rules"), found.alias("found")).write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger)


def findings(whole: DataFrame, rules=RULES) -> DataFrame:
    """blob, found: what just these rule versions found in each blob of a ledger, by start, then rule. Blobs without findings are left out."""
    names = F.array(*(F.lit(r.name) for r in rules))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    place = lambda x: F.array_position(names, x["rule"]).cast("int")
    hits = whole.filter(F.size("found") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    own = F.filter("found", lambda x: place(x) > 0)
    seen = F.transform(own, lambda x: F.struct(x["start"].alias("start"), (place(x) - 1).alias("ord"), F.element_at(kinds, place(x)).alias("kind"), x["end"].alias("end")))
    return hits.select("blob", F.array_sort(seen).alias("found")).filter(F.size("found") > 0)


def scan(docs: DataFrame, ledger: str | None = None, rules=RULES, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, found (spans by start, then rule) for every row of docs, through the ledger at that path (a new one if None).

    Repeated rows and equal texts share a blob and each get its findings, and so do all versions of a path that are given as rows; a null text has
    none; a null id is kept. No rows give no rows. Only the id and text columns are read; others, whatever their names, are ignored. Only findings
    of the given rule versions are returned, in whatever order they were once run. Texts are scanned whole.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hits = findings(update(own, ledger or work_path(docs.sparkSession, "ledger"), rules), rules)
    return own.select("doc_id", digest(F.col("text")).alias("blob")).join(hits, "blob", "left").select("doc_id", F.coalesce("found", F.expr(f"cast(array() as {FOUND})")).alias("found"))


def spell(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark="[SECRET]", ledger: str | None = None, id_col="doc_id", text_col="text", rules=RULES) -> DataFrame:
    """docs with every span that the rules find replaced by mark; overlapping spans become one. Columns, whatever their names, and rows stay.

    Null texts stay null, texts without findings are untouched, repeated rows are treated alike, texts are read whole; no rows give none.
    """
    hits = findings(update(docs, ledger or work_path(docs.sparkSession, "ledger"), rules, text_col), rules)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), digest(F.col(f"`{text_col}`")).alias("blob")).join(hits, "blob", "left")
    text = F.col(f"row.`{text_col}`")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate("found", begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    new = F.when(F.col("found").isNull(), text).otherwise(clean)
    return keyed.select(*(new.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))


def op10_secrets(spark, sf_dir):
    found = F.col("found")
    base = F.filter(found, lambda x: x["ord"] < len(BASE))
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(table(spark, sf_dir, "documents")).select("doc_id", *(count(r.kind) for r in BASE), F.sha2(spell(base), 256).alias("base_sha256"), spell(found).alias("spans"))


def _sql(rule: Rule) -> str:
    """The rule's spans in DuckDB SQL: doc_id, kind, ord, start, stop. Matches begin a run, so that what stands before one needs no test."""
    i, pattern = RULES.index(rule), rule.pattern.replace("(?<![0-9a-f])", "").replace("'", "''")
    kept = f"length(regexp_extract(m, '{pattern}', {rule.group})) >= {rule.least}" if rule.least else "true"
    return f"""SELECT doc_id, row_id, '{rule.kind}' AS kind, {i} AS ord, beg AS start, beg + length(m) AS stop FROM (
  SELECT doc_id, row_id, m, place, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY row_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beg FROM (
    SELECT doc_id, row_id, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(list_slice(regexp_split_to_array(text, '{pattern}'), 1, len(regexp_extract_all(text, '{pattern}')))) AS gap, generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS place
    FROM d WHERE regexp_matches(text, '{pattern}')) WINDOW w AS (PARTITION BY row_id ORDER BY place)) WHERE {kept}"""


_SPELT = "kind || ':' || start::BIGINT || ':' || stop::BIGINT"
ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_id FROM documents),
s AS ({' UNION ALL '.join(map(_sql, RULES))}),
g AS (SELECT row_id, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)}, string_agg({_SPELT}, ',' ORDER BY start, ord) FILTER (ord < {len(BASE)}) AS base, string_agg({_SPELT}, ',' ORDER BY start, ord) AS spans FROM s GROUP BY row_id)
SELECT doc_id, {', '.join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row_id)"""
