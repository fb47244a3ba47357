"""Selection of exactly n rows: by stratum, by sequential quotas, round robin. Inputs are narrow: id, title, stratum, score, themes.

All orders are total: score falling, lower-case title, id. A selection that reads its input more than once writes the narrow columns to the
shared folder first, so that texts are scored once. No window sees more than n rows of a stratum or theme from any task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..config import Quota
from ..sources.work import materialise
from .ranks import before


def order(id_col="doc_id"):
    return [F.desc("score"), F.lower("title"), F.col(id_col)]


def settled(rows: DataFrame, id_col="doc_id") -> DataFrame:
    """The narrow columns, written once."""
    return rows if hasattr(rows, "ledgerstone_path") else materialise(rows.select(id_col, "title", "stratum", "score", "themes"), "narrow")


def ranked(rows: DataFrame, most: int, id_col="doc_id") -> DataFrame:
    """Adds place: the row's rank within its stratum; the `most` first of each stratum stay."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy(*order(id_col)))).filter(F.col("place") <= most)


def stratum_quotas(rows: DataFrame, n: int, strata: int | None = None) -> DataFrame:
    """stratum, quota: n dealt evenly over `strata` (the strata there are, if None), the rest to the largest, ties to the smaller id."""
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("size"))
    number = F.lit(strata) if strata else F.count("*").over(Window.partitionBy())
    by_size = F.row_number().over(Window.orderBy(F.desc("size"), "stratum"))
    return sizes.withColumn("number", number).withColumn("ordinal", by_size).select("stratum", (F.floor(F.lit(n) / F.col("number")) + (F.col("ordinal") <= F.lit(n) % F.col("number")).cast("int")).alias("quota"))


def stratified(rows: DataFrame, n: int, strata: int | None = None, id_col="doc_id") -> DataFrame:
    """The best of each stratum up to its quota."""
    rows = settled(rows, id_col)
    return ranked(rows, n, id_col).join(stratum_quotas(rows, n, strata), "stratum").filter(F.col("place") <= F.col("quota")).drop("place", "quota")


def fill(rows: DataFrame, chosen: DataFrame, n: int, id_col="doc_id") -> DataFrame:
    """chosen and the best of the others, n rows at the most. n bounds what is sorted at the end."""
    missing = max(0, n - chosen.count())
    rest = rows.join(chosen.select(id_col), id_col, "left_anti").orderBy(*order(id_col)).limit(missing)
    return chosen.unionByName(rest.select(*chosen.columns))


def exactly(chosen: DataFrame, n: int) -> DataFrame:
    """chosen, or an error if it hasn't n rows."""
    found = chosen.count()
    if found != n:
        raise ValueError(f"{found} rows are selected; {n} are needed")
    return chosen


def v1_selection(rows: DataFrame, n: int, strata: int | None = None, id_col="doc_id", whole=False) -> DataFrame:
    """Stratified, then filled; selected_rank by score, stratum, title, id. whole: fails if there are fewer than n rows."""
    rows = settled(rows, id_col)
    both = fill(rows, materialise(stratified(rows, n, strata, id_col), "chosen"), n, id_col)
    final = [F.desc("score"), F.col("stratum"), F.lower("title"), F.col(id_col)]
    out = both.orderBy(*final).limit(n).withColumn("selected_rank", F.row_number().over(Window.orderBy(*final)))
    return exactly(materialise(out, "selected"), n) if whole else out


DRIVER_ROWS = 100_000  # quotas that add up to more are picked by rounds of jobs instead of on the driver


def sequential_quotas(rows: DataFrame, quotas: tuple[Quota, ...], id_col="doc_id", driver_rows=DRIVER_ROWS) -> DataFrame:
    """Quotas in order of priority; a theme's members picked for earlier themes count. phase, step: in which order rows were picked.

    A quota's picks are among its theme's first rows, as many as all quotas so far. If these are few, whatever the number of documents, one pass finds them for every
    theme and the driver picks; else each theme is a round of jobs. Both pick the same rows in the same order.
    """
    most = sum(q.quota for q in quotas)
    narrow = rows.select(id_col, "title", "stratum", "score", "themes")
    return picked_here(narrow, quotas, most, id_col) if most <= driver_rows else picked_by_rounds(narrow, quotas, id_col)


def picked_here(narrow: DataFrame, quotas: tuple[Quota, ...], most: int, id_col: str) -> DataFrame:
    spark, schema = narrow.sparkSession, narrow.schema
    member = narrow.withColumn("theme", F.explode(F.array_intersect("themes", F.array(*(F.lit(q.theme) for q in quotas)))))
    place = F.row_number().over(Window.partitionBy("theme").orderBy(*order(id_col)))
    first: dict[str, list] = {q.theme: [] for q in quotas}
    if quotas:
        for r in member.withColumn("place", place).filter(F.col("place") <= most).orderBy("theme", "place").collect():
            first[r["theme"]].append(r)
    picked, theme_of = [], {}
    for phase, q in enumerate(quotas, 1):
        have = sum(q.theme in themes for themes in theme_of.values())
        free = [r for r in first[q.theme] if r[id_col] not in theme_of]
        for step, r in enumerate(free[: max(0, q.quota - have)], 1):
            theme_of[r[id_col]] = set(r["themes"])
            picked.append((*(r[c] for c in schema.names), phase, step))
    return spark.createDataFrame(picked, StructType([*schema.fields, StructField("phase", IntegerType()), StructField("step", IntegerType())]))


def picked_by_rounds(narrow: DataFrame, quotas: tuple[Quota, ...], id_col: str) -> DataFrame:
    """A round a theme: its rows that aren't picked yet are ranked over ranges of the whole order, which no two rows share a place in, so that neither a theme nor a score is one task's."""
    picked = materialise(narrow.limit(0).select("*", F.lit(0).alias("phase"), F.lit(0).alias("step")), "picked")
    for phase, q in enumerate(quotas, 1):
        has = F.array_contains("themes", q.theme)
        need = q.quota - picked.filter(has).count()
        if need <= 0:
            continue
        free = narrow.filter(has).join(picked.select(id_col), id_col, "left_anti").select(*narrow.columns, F.struct((-F.col("score")).alias("s"), F.lower("title").alias("t"), F.col(id_col).alias("i")).alias("key"), F.lit(1).alias("one"))
        new = before(free, "key", ("one",)).filter(F.col("before_one") < need)
        new = new.select(*narrow.columns, F.lit(phase).alias("phase"), (F.col("before_one") + 1).cast("int").alias("step"))
        picked = materialise(picked.unionByName(new), "picked")
    return picked


def round_robin(rows: DataFrame, n: int, id_col="doc_id") -> DataFrame:
    """n rows, one of each stratum in turn, the largest stratum first: by rank within the stratum, then the stratum's ordinal."""
    rows = settled(rows, id_col)
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("size")).withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc("size"), "stratum"))).drop("size")
    chosen = ranked(rows, n, id_col).join(sizes, "stratum").orderBy("place", "ordinal").limit(n)
    return chosen.withColumn("step", F.row_number().over(Window.orderBy("place", "ordinal"))).drop("place", "ordinal")


def v2_selection(rows: DataFrame, n: int, quotas: tuple[Quota, ...], id_col="doc_id") -> DataFrame:
    """Quotas, then round robin. selected_rank: in order of insertion; score_rank: by score. Fails if fewer than n rows are there."""
    rows = settled(rows, id_col)
    if rows.count() < n:
        raise ValueError(f"fewer than {n} eligible rows")
    by_quota = sequential_quotas(rows, quotas, id_col)
    left = materialise(rows.join(by_quota.select(id_col), id_col, "left_anti"), "left")
    turn = round_robin(left, max(0, n - by_quota.count()), id_col).withColumn("phase", F.lit(len(quotas) + 1))
    both = by_quota.unionByName(turn.select(*by_quota.columns)).orderBy("phase", "step").limit(n)
    return both.withColumn("selected_rank", F.row_number().over(Window.orderBy("phase", "step"))).withColumn("score_rank", F.row_number().over(Window.orderBy(*order(id_col))))


def quota_report(selected: DataFrame, quotas: tuple[Quota, ...]) -> DataFrame:
    """priority, theme, quota, achieved."""
    wanted = selected.sparkSession.createDataFrame([(i, q.theme, q.quota) for i, q in enumerate(quotas, 1)], "priority int, theme string, quota long")
    achieved = selected.select(F.explode("themes").alias("theme")).groupBy("theme").agg(F.count("*").alias("achieved"))
    return wanted.join(achieved, "theme", "left").select("priority", "theme", "quota", F.coalesce("achieved", F.lit(0)).cast("long").alias("achieved"))
