"""Grouped statistics (P7, P9, A12, A16-A19, A21, A24, A28, W5, W7, W12, M2 on histograms)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from granary.operators.quantile import exact_quantiles
from granary.session import bounded, cut


def percentile_stretch(rows: DataFrame, by: str, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """``stretched``: values mapped so that the low percentile is 0 and the high one 255, cut to 0..255 and truncated.

    A group whose percentiles coincide keeps its values, cut and truncated alike; null values stay null.
    """
    q = exact_quantiles(rows, [by], [low, high], value)
    p = q.groupBy(by).agg(F.max(F.when(F.col("q") == low, F.col("quantile"))).alias("lo"), F.max(F.when(F.col("q") == high, F.col("quantile"))).alias("hi"))
    j = rows.join(bounded(cut(p)), by)
    raw = F.when(F.col("hi") > F.col("lo"), (F.col(value) - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo"))).otherwise(F.col(value))
    return j.withColumn("stretched", F.when(F.col(value).isNotNull(), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), raw))).cast("int")))


def robust_z(rows: DataFrame, by: str, value: str, floor: float = 2.0) -> DataFrame:
    """``z``: distance from the group's median in units of 1.4826 times the median absolute deviation, at least ``floor``."""
    med = cut(exact_quantiles(rows, [by], [0.5], value).select(by, F.col("quantile").alias("__m")))
    j = rows.join(bounded(med), by)
    mad = exact_quantiles(j.withColumn("__a", F.abs(F.col(value) - F.col("__m"))), [by], [0.5], "__a").select(by, F.col("quantile").alias("__d"))
    return j.join(bounded(cut(mad)), by).withColumn("z", (F.col(value) - F.col("__m")) / F.greatest(F.lit(1.4826) * F.col("__d"), F.lit(floor))).drop("__m", "__d")


def otsu_thresholds(bins: DataFrame, by: str, bin_: str, count: str = "n", levels: int = 256) -> DataFrame:
    """First threshold with the highest between-class score of each group's histogram; none below two levels."""
    w = W.partitionBy(by)
    up = w.orderBy(bin_).rowsBetween(W.unboundedPreceding, 0)
    h = bins.withColumn("t", F.sum(count).over(w)).withColumn("tm", F.sum(F.col(count) * F.col(bin_)).over(w))
    h = h.withColumn("w", F.sum(count).over(up)).withColumn("m", F.sum(F.col(count) * F.col(bin_)).over(up)).where(F.col("w") < F.col("t"))
    score = F.pow((F.col("tm") * F.col("w") - F.col("m") * F.col("t")).cast("double"), 2.0) / (F.col("w") * (F.col("t") - F.col("w"))).cast("double")
    h = h.withColumn("score", score)
    return h.groupBy(by).agg(F.max_by(bin_, F.struct(F.col("score"), -F.col(bin_))).alias("threshold"))


def aggregate_objects(images: DataFrame, objects: DataFrame, key: str, order: str, stage: str, name: str, scores: list[str], sums: list[str]) -> DataFrame:
    """One row per image: unanimous stage, ``mixed`` or ``none``; mean scores and summed times, 0 without objects.

    Names are joined in the objects' order; the objects of one image are few, as one detector run made them.
    """
    g = objects.groupBy(key).agg(
        F.count(F.lit(1)).alias("objects_detected"), F.min(stage).alias("__a"), F.max(stage).alias("__b"),
        *[F.avg(s).alias(s) for s in scores], *[F.sum(s).alias(s) for s in sums],
        F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda s: s[name])).alias("detected"),
    )
    n = F.coalesce("objects_detected", F.lit(0))
    return images.select(key).join(g, key, "left").select(
        key, n.alias("objects_detected"),
        F.when(n == 0, "none").when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise("mixed").alias("predicted_stage"),
        *[F.coalesce(s, F.lit(0.0)).alias(s) for s in [*scores, *sums]],
        F.coalesce("detected", F.lit("")).alias("detected"),
        F.when(n == 0, "no-supported-fruit").otherwise("per-fruit").alias("mask_status"),
    )


def measures(area, pixels_per_unit=None):
    """Equivalent diameter and, with a scale, physical area and diameter; a scale of 0 or less fails."""
    d = 2.0 * F.sqrt(area / math.pi)
    if pixels_per_unit is None:
        return F.struct(area.cast("double").alias("area_px"), d.alias("diameter_px"), F.lit(None).cast("double").alias("area"), F.lit(None).cast("double").alias("diameter"))
    ppu = F.when(pixels_per_unit > 0, pixels_per_unit).otherwise(F.raise_error(F.lit("pixels per unit must be positive")).cast("double"))
    return F.struct(area.cast("double").alias("area_px"), d.alias("diameter_px"), (area / (ppu * ppu)).alias("area"), (d / ppu).alias("diameter"))


def quality_report(rows: DataFrame, fraction: str, grade: str, by: str) -> DataFrame:
    """Per group and overall (``all``): images, graded, ungraded, mean and median fraction. Groups' means use values
    rounded to six places, the overall ones the values as they are."""
    graded, exact = F.col(grade) != "Not graded", F.col(fraction).cast("double")
    scoped = rows.select(F.explode(F.array(
        F.struct(F.col(by).cast("string").alias("scope"), graded.alias("graded"), F.round(exact, 6).alias("f")),
        F.struct(F.lit("all").alias("scope"), graded.alias("graded"), exact.alias("f")),
    )).alias("r")).select("r.*")
    counts = scoped.groupBy("scope").agg(F.count(F.lit(1)).alias("images"), F.count_if("graded").alias("graded"), F.avg(F.when(F.col("graded"), F.col("f"))).alias("mean_fraction"))
    middle = exact_quantiles(scoped.where("graded"), ["scope"], [0.5], "f").select(F.col("scope").alias("__scope"), F.col("quantile").alias("median_fraction"))
    joined = counts.join(bounded(cut(middle)), F.col("scope").eqNullSafe(F.col("__scope")), "left").drop("__scope")
    return joined.select("scope", "images", "graded", "mean_fraction", "median_fraction", (F.col("images") - F.col("graded")).alias("ungraded"))


def mask_agreement(rows: DataFrame, by: list[str], a, b) -> DataFrame:
    """Fractions of two masks, their intersection and disagreement, and Jaccard, 1 where both are empty."""
    f = lambda c: F.avg(c.cast("double"))
    both, either = F.count_if(a & b), F.count_if(a | b)
    return rows.groupBy(*by).agg(f(a).alias("fraction_a"), f(b).alias("fraction_b"), f(a & b).alias("intersection"), f(a != b).alias("disagreement"), F.when(either == 0, 1.0).otherwise(both / either).alias("jaccard"))


def numbered(rows: DataFrame, by: str, order: list, name: str = "object_no") -> DataFrame:
    """``rows`` numbered from 1 within each ``by`` in the given order; an image's objects are few."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order)))


def cluster_counts(pixels: DataFrame, by: str, cluster: str, border) -> DataFrame:
    """``(by, cluster, border, everywhere, background)``: pixels of each cluster on the border and in all, and whether
    it is the background: most border pixels, then most pixels, then the lowest number."""
    n = pixels.groupBy(by, cluster).agg(F.count_if(border).alias("border"), F.count(F.lit(1)).alias("everywhere"))
    best = F.row_number().over(W.partitionBy(by).orderBy(F.desc("border"), F.desc("everywhere"), cluster))
    return n.withColumn("background", best == 1)


def arrays_agree(levels, a, b):
    """U2, A21 on an array of levels: as :func:`mask_agreement`, for masks ``a`` and ``b`` given as functions of a level and its
    place."""
    n = F.size(levels).cast("double")
    count = lambda f: F.size(F.filter(levels, f))
    both, either = count(lambda x, i: a(x, i) & b(x, i)), count(lambda x, i: a(x, i) | b(x, i))
    return F.struct(
        (count(a) / n).alias("fraction_a"), (count(b) / n).alias("fraction_b"), (both / n).alias("intersection"),
        (count(lambda x, i: a(x, i) != b(x, i)) / n).alias("disagreement"), F.when(either == 0, 1.0).otherwise(both / either).alias("jaccard"),
    )
