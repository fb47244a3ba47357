"""Leakage between splits, group-aware splits, generalisation gaps and task metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import ranking

def entity_overlap(rows: DataFrame, entity: str, split: str) -> DataFrame:
    """Entities that more than one split holds: entity, splits, n. A map-side sum comes first, so that a hot entity costs little."""
    by_split = rows.groupBy(entity, split).agg(F.count("*").alias("n"))
    both = by_split.groupBy(entity).agg(F.count("*").alias("splits"), F.sum("n").alias("n"))
    return both.filter("splits > 1")


def content_key(text="text"):
    """A hash of the text but for case, marks and blanks."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(F.col(text)), r"(?U)\W+", " ")), 256)


def content_overlap(left: DataFrame, right: DataFrame, text="text", left_id="doc_id", right_id="item_id") -> DataFrame:
    """Pairs of left and right rows with the same text, but for case, marks and blanks."""
    key = content_key(text).alias("key")
    return left.select(left_id, key).join(right.select(right_id, key), "key").select(left_id, right_id)


def overlap_classes(rows: DataFrame, text="text", id_col="doc_id") -> DataFrame:
    """id, key, first_id, n: the class of every row that shares its text with another (but for case, marks and blanks), by least id and size. No pairs are listed."""
    keyed = rows.select(id_col, content_key(text).alias("key"))
    classes = keyed.groupBy("key").agg(F.min(id_col).alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(classes, "key").select(id_col, "key", "first_id", "n")


def group_split(rows: DataFrame, group: str, parts=10) -> DataFrame:
    """Adds split: by the first 32 bits of the group's MD5, so that no group is in two splits and any engine can tell which."""
    first = F.conv(F.substring(F.md5(F.col(group).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.withColumn("split", F.pmod(first, F.lit(parts)).cast("int"))


CHUNK = 122_880  # ids whose values are added up one after another


def means_in_order(rows: DataFrame, by, value: str, id_col: str, chunk=CHUNK) -> DataFrame:
    """by, mean of a double: values are added in order of their ids, `chunk` ids at a time, and then the sums, so that a mean doesn't depend on how rows are dealt out. Nulls don't count; ids are whole numbers."""
    v = F.col(value).cast("double")
    parts = rows.select(*by, F.floor(F.col(id_col) / chunk).alias("chunk"), v.alias("v"), F.when(v.isNotNull(), F.struct(F.col(id_col).alias("i"), v.alias("v"))).alias("x"))
    sums = parts.groupBy(*by, "chunk").agg(F.aggregate(F.array_sort(F.collect_list("x")), F.lit(0.0), lambda s, x: s + x["v"]).alias("s"), F.count("v").alias("n"))
    return sums.groupBy(*by).agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))


def generalisation_gap(scores: DataFrame, threshold: float, id_col: str | None = None) -> DataFrame:
    """model, train, test, gap, wide. scores: model, split, score, and id_col if scores are to be added in its order."""
    if id_col:
        scores = means_in_order(scores, ("model", "split"), "score", id_col).withColumnRenamed("mean", "score")  # one row a model and split
    means = scores.groupBy("model").agg(*(F.avg(F.when(F.col("split") == s, F.col("score"))).alias(s) for s in ("train", "test")))
    return means.withColumn("gap", F.col("train") - F.col("test")).withColumn("wide", F.col("gap") > threshold)


def confusion(rows: DataFrame, truth: str, score: str, threshold=0.5, by=()) -> DataFrame:
    """tp, fp, fn, tn, sensitivity, specificity, precision and f1, for each subgroup."""
    t, p = F.col(truth) == 1, F.col(score) >= threshold
    counts = rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))

    def ratio(a, *b):
        return F.try_divide(a, sum(b[1:], b[0]))

    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return counts.select("*", ratio(tp, tp, fn).alias("sensitivity"), ratio(tn, tn, fp).alias("specificity"), ratio(tp, tp, fp).alias("precision"), ratio(2 * tp, 2 * tp, fp, fn).alias("f1"))


def calibration(rows: DataFrame, truth: str, score: str, bins=10) -> DataFrame:
    """bin, n, mean_score, observed."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(truth).alias("observed"))


def auroc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: the area under the ROC curve, exact."""
    return ranking(rows, truth, score).select("auroc")


def auprc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: the area under the precision-recall curve as a sum of steps, exact. Equal scores are one step."""
    return ranking(rows, truth, score).select("auprc")


def signal_quality(rows: DataFrame, clean: str, seen: str, peak: float, by=()) -> DataFrame:
    """mse, snr_db, psnr_db and ssim of a signal against its clean form, for each subgroup. ssim is of whole signals, with the usual constants."""
    x, y = F.col(clean).cast("double"), F.col(seen).cast("double")
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    m = rows.groupBy(*by).agg(F.avg((x - y) * (x - y)).alias("mse"), F.avg(x * x).alias("power"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"))
    mx, my = F.col("mx"), F.col("my")
    ssim = (2 * mx * my + c1) * (2 * F.col("cxy") + c2) / ((mx * mx + my * my + c1) * (F.col("vx") + F.col("vy") + c2))
    return m.select(*by, "mse", (10 * F.log10(F.col("power") / F.col("mse"))).alias("snr_db"), (10 * F.log10(peak * peak / F.col("mse"))).alias("psnr_db"), ssim.alias("ssim"))


def bit_error_rate(rows: DataFrame, sent: str, received: str, width=32, by=()) -> DataFrame:
    """bits, errors, rate over integers of `width` bits, for each subgroup."""
    wrong = F.bit_count(F.col(sent).cast("long").bitwiseXOR(F.col(received).cast("long")).bitwiseAND(F.lit((1 << width) - 1)))
    counts = rows.groupBy(*by).agg((F.count("*") * width).alias("bits"), F.sum(wrong).alias("errors"))
    return counts.withColumn("rate", F.col("errors") / F.col("bits"))


def rmse(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.agg(F.sqrt(F.avg(F.pow(F.col(truth) - F.col(guess), 2))).alias("rmse"))
