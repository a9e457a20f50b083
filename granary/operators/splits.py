"""Splits, guards and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def stratified_split(rows: DataFrame, stratum: list[str], key: str, share: float = 0.2, seed: int = 42, eligible: Column | None = None) -> DataFrame:
    """L1: ``split``: ``validation`` for ``share`` of each stratum of the eligible rows, ``train`` for its rest, ``test`` else.

    Membership follows the md5 of seed and key, so it is stable under row order and repartitioning. A stratum gives
    ``round(share * n)`` rows, halves up, at least one if it has two or more. Hash buckets are counted first and only the
    bucket that holds the border is ranked, so a stratum that holds most rows is never sorted in one task.
    """
    eligible = F.lit(True) if eligible is None else eligible
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    keyed = rows.withColumn("__ok", eligible).withColumn("__h", h).withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    counts = keyed.where("__ok").groupBy(*stratum, "__b").agg(F.count(F.lit(1)).alias("__c"))
    w = W.partitionBy(*stratum)
    sized = counts.withColumn("__n", F.sum("__c").over(w)).withColumn("__before", F.sum("__c").over(w.orderBy("__b")) - F.col("__c"))
    quota = F.greatest(F.floor(F.col("__n") * share + 0.5), F.when(F.col("__n") >= 2, 1).otherwise(0))
    sized = sized.withColumn("__q", quota).select(*[F.col(s).alias(f"__s{i}") for i, s in enumerate(stratum)], F.col("__b").alias("__bb"), "__c", "__before", "__q")
    cond = F.col("__b") == F.col("__bb")
    for i, s in enumerate(stratum):
        cond = cond & F.col(s).eqNullSafe(F.col(f"__s{i}"))
    joined = keyed.join(sized, cond, "left")
    border = F.coalesce(F.col("__ok") & (F.col("__before") < F.col("__q")) & (F.col("__before") + F.col("__c") > F.col("__q")), F.lit(False))
    inside = F.col("__before") + F.col("__c") <= F.col("__q")
    plain = joined.where(~border).withColumn("split", F.when(~F.col("__ok"), "test").when(inside, "validation").otherwise("train"))
    ranked = joined.where(border).withColumn("__r", F.row_number().over(W.partitionBy(*stratum, "__b").orderBy("__h", key)))
    close = ranked.withColumn("split", F.when(F.col("__before") + F.col("__r") <= F.col("__q"), "validation").otherwise("train"))
    names = [*[c for c in rows.columns if c != "split"], "split"]
    return plain.select(*names).unionByName(close.select(*names))


def holdout_guard(inputs: DataFrame, reserved: DataFrame, key: str) -> DataFrame:
    """``inputs`` with ``blocked``: their content is in ``reserved``; a null key is never blocked.

    Reserved keys are made distinct (U1); the join is an equi-join that Catalyst broadcasts only while they are small.
    """
    r = reserved.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__hit", F.lit(True))
    return inputs.join(r, key, "left").withColumn("blocked", F.coalesce("__hit", F.lit(False))).drop("__hit")


def manifest_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one manifest that the other lacks, counting repeats, with ``side``; no row if they are equal."""
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def changed_content(current: DataFrame, manifest: DataFrame, key: str, digest: str) -> DataFrame:
    """F8: ``(key, status)`` of manifest rows whose content is gone (``missing``) or differs (``changed``)."""
    c = current.select(key, F.col(digest).alias("__now"), F.lit(True).alias("__there"))
    j = manifest.select(key, digest).join(c, key, "left")
    return j.select(key, F.when(F.col("__there").isNull(), "missing").when(~F.col(digest).eqNullSafe(F.col("__now")), "changed").alias("status")).where("status is not null").distinct()


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free fingerprint of a table: row count and the sum of 60-bit row hashes. Equal tables give equal rows."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(number), F.lit(0).cast("decimal(38,0)")).cast("string").alias("hash_sum"))


def require_split(rows: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """``rows`` themselves; reading any row outside the allowed values fails the job."""
    bad = F.lit(False)
    for column, values in allowed.items():
        bad = bad | ~F.coalesce(F.col(column).isin(*values), F.lit(False))
    return rows.where(F.when(bad, F.raise_error(F.lit(f"a row is outside {allowed}")).cast("boolean")).otherwise(F.lit(True)))


def incomplete_strata(rows: DataFrame, by: str, column: str, wanted: tuple[str, ...]) -> DataFrame:
    """Groups that lack one of the ``wanted`` values, with what is missing."""
    g = rows.groupBy(by).agg(F.collect_set(F.when(F.col(column).isin(*wanted), F.col(column))).alias("__s"))
    return g.select(by, F.array_sort(F.array_except(F.array(*[F.lit(w) for w in wanted]), "__s")).alias("missing")).where(F.size("missing") > 0)


def first_per_stratum(rows: DataFrame, stratum: list[str], order: list[str]) -> DataFrame:
    """The first row of each stratum by the given order."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*stratum).orderBy(*order))).where("__r = 1").drop("__r")


def previews(rows: DataFrame, stratum: list[str], order: str, correct: str, failures: int = 3) -> DataFrame:
    """The first row of each stratum, then up to ``failures`` more wrong ones by order, with ``selection``."""
    first = first_per_stratum(rows, stratum, [order]).withColumn("selection", F.lit("first_per_fruit_stage"))
    rest = rows.where(~F.col(correct)).join(first.select(order), order, "left_anti").orderBy(order).limit(failures)
    return first.unionByName(rest.withColumn("selection", F.lit("additional_failure")))
