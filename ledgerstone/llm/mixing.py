"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Keys are uniform, so equal-width key ranges cut each source,
however large, into ranges of bounded size: rows are sorted inside a range, range totals give each
range its offset, and the sum of both is a distributed prefix sum of token counts. Each source is cut
at its exact budget; what a budget exceeds of one pass over the source repeats it as further epochs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

KEY_BITS = 60


def word_count(text) -> F.Column:
    """Number of runs of characters other than space and U+0009 to U+000D; null counts 0."""
    runs = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(runs, " \t\n\x0b\x0c\r", "")).cast("long")


def source_targets(totals: DataFrame, weights=(5, 2, 1), share=(3, 2), repeat=2) -> DataFrame:
    """totals: s_null, s, source_size, one row a source. Adds target: `share` of all words by weight, at most `repeat` times the source.

    Water filling: with the k sources of least room a weight at their limit, the others get level_k = (words - limits) / weights
    a weight. The true level is the largest level_k, since any other set of sources at the limit gives too low a one.
    """
    up, down = share
    by_code_point = Window.orderBy("s_null", "s")
    ranked = totals.withColumn("i", (F.row_number().over(by_code_point) - 1) % len(weights))
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") + 1).cast("int")).cast("long")).withColumn("limit_", F.col("source_size") * repeat)
    room = Window.orderBy(F.col("limit_") / F.col("w"), "s_null", "s").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    levels = (
        ranked.withColumn("num", F.sum("source_size").over(every) * up - F.coalesce(F.sum("limit_").over(room), F.lit(0)) * down)
        .withColumn("den", (F.sum("w").over(every) - F.coalesce(F.sum("w").over(room), F.lit(0))) * down)
        .withColumn("best", F.max(F.struct(F.col("num") / F.col("den"), F.col("num"), F.col("den"))).over(every))
    )
    fair = F.col("w") * F.col("best.num") / F.col("best.den")
    return levels.select("s_null", "s", "source_size", F.least(F.col("limit_").cast("double"), fair).alias("target"))


def mix(docs: DataFrame, weights=(5, 2, 1), share=(3, 2), repeat=2, seed="mix", rows_per_range=50_000, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken.

    Null texts have size 0 and take nothing; null sources are one source, the last. Null ids are keyed by their text.
    Repeated rows count and are taken each on its own; equal keys are ordered by id, then size. No rows give no rows. Other
    columns, whatever their names, are ignored. A source's taken words sum to its target rounded down.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(F.col("text"), F.lit("")))))))
    sized = materialise(
        own.select(
            "doc_id",
            F.col("source").isNull().cast("int").alias("s_null"),
            F.coalesce("source", F.lit("")).alias("s"),
            word_count(F.col("text")).alias("size"),
            F.conv(F.substring(drawn, 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
        ),
        "mix-sized",
    )
    bits = max(0, math.ceil(math.log2(max(1, sized.count()) / rows_per_range)))
    sized = sized.withColumn("range", F.shiftright("key", KEY_BITS - bits))
    ranges = sized.groupBy("s_null", "s", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.groupBy("s_null", "s").agg(F.sum("range_size").alias("source_size")), weights, share, repeat)
    before = Window.partitionBy("s_null", "s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("s_null", "s", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("offset")).join(targets, ["s_null", "s"])
    inside = Window.partitionBy("s_null", "s", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["s_null", "s", "range"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("offset") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op8_mixing(spark, sf_dir):
    from .common import table

    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '-' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS key
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, 2 * source_size AS lim, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM t),
l AS (SELECT *, 3 * sum(source_size) OVER () - 2 * coalesce(sum(lim) OVER room, 0) AS num, 2 * (sum(w) OVER () - coalesce(sum(w) OVER room, 0)) AS den
      FROM r WINDOW room AS (ORDER BY lim / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT num, den FROM l ORDER BY num / den DESC, num DESC LIMIT 1),
g AS (SELECT source, source_size, least(lim::DOUBLE, (w * (SELECT num FROM best))::DOUBLE / (SELECT den FROM best)::DOUBLE) AS target FROM l),
p AS (SELECT d.*, g.source_size, g.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             CASE WHEN g.source_size > 0 THEN floor(floor(target) / g.source_size) ELSE 0 END AS epochs
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken
FROM p
"""
