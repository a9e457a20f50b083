"""Classification metrics overall and per group (A6-A11, A15, J5, F17, L14), run registry rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from granary.schemas import STAGES

SCORES = ("accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1")


def confusion(rows: DataFrame, truth: str, pred: str, labels: tuple[str, ...] = STAGES, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, truth, <label columns>)``, rows for every label of every group, zeros included; other labels are ignored."""
    seen = rows.where(F.col(truth).isin(*labels) & F.col(pred).isin(*labels))
    counts = seen.groupBy(*by).agg(*[F.count_if((F.col(truth) == t) & (F.col(pred) == p)).alias(f"{i}:{j}") for i, t in enumerate(labels) for j, p in enumerate(labels)])
    lines = F.array(*[F.struct(F.lit(t).alias(truth), *[F.col(f"`{i}:{j}`").alias(p) for j, p in enumerate(labels)]) for i, t in enumerate(labels)])
    return counts.select(*by, F.explode(lines).alias("l")).select(*by, "l.*")


def _sum(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cs)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def metrics(rows: DataFrame, truth: str, pred: str, by: tuple[str, ...], group: str | None = None, labels: tuple[str, ...] = STAGES) -> DataFrame:
    """Metrics per ``by`` overall and, as grouping sets, per ``group``; ``scope`` is ``overall`` or the group's value.

    Macro values average over all ``labels``, zero where undefined; balanced accuracy only over labels that occur as truth.
    All counts come from one aggregation with partial counts before the shuffle. Rows with other labels take no part.
    """
    seen = rows.where(F.col(truth).isin(*labels) & F.col(pred).isin(*labels))
    aggs = [F.count(F.lit(1)).alias("n_images")]
    for i, c in enumerate(labels):
        aggs += [F.count_if((F.col(truth) == c) & (F.col(pred) == c)).alias(f"tp{i}"), F.count_if(F.col(truth) == c).alias(f"sup{i}"), F.count_if(F.col(pred) == c).alias(f"prd{i}")]
    if group is None:
        g = seen.groupBy(*by).agg(*aggs).withColumn("scope", F.lit("overall"))
    else:
        keys = [F.col(b) for b in by]
        g = seen.where(F.col(group).isNotNull()).groupingSets([keys, [*keys, F.col(group)]], *keys, F.col(group)).agg(F.grouping(group).alias("all"), *aggs).withColumn("scope", F.when(F.col("all") == 1, "overall").otherwise(F.col(group)))
    n = range(len(labels))
    tp, sup, prd = ([F.col(f"{x}{i}") for i in n] for x in ("tp", "sup", "prd"))
    p, r = [_ratio(a, b) for a, b in zip(tp, prd)], [_ratio(a, b) for a, b in zip(tp, sup)]
    f1 = [_ratio(2.0 * a, b + c) for a, b, c in zip(tp, sup, prd)]
    k = F.lit(float(len(labels)))
    return g.select(
        *by, "scope", "n_images",
        (_sum(tp) / F.col("n_images")).alias("accuracy"),
        (_sum(r) / _sum([F.when(s > 0, 1.0).otherwise(0.0) for s in sup])).alias("balanced_accuracy"),
        (_sum(p) / k).alias("macro_precision"), (_sum(r) / k).alias("macro_recall"), (_sum(f1) / k).alias("macro_f1"),
    )


def per_class(rows: DataFrame, truth: str, pred: str, by: tuple[str, ...], labels: tuple[str, ...] = STAGES) -> DataFrame:
    """A10: precision, recall, F1 and support of every label per ``by``."""
    seen = rows.where(F.col(truth).isin(*labels) & F.col(pred).isin(*labels))
    g = seen.groupBy(*by).agg(*[x for i, c in enumerate(labels) for x in (F.count_if((F.col(truth) == c) & (F.col(pred) == c)).alias(f"tp{i}"), F.count_if(F.col(truth) == c).alias(f"sup{i}"), F.count_if(F.col(pred) == c).alias(f"prd{i}"))])
    lines = F.array(*[F.struct(F.lit(c).alias("label"), _ratio(F.col(f"tp{i}"), F.col(f"prd{i}")).alias("precision"), _ratio(F.col(f"tp{i}"), F.col(f"sup{i}")).alias("recall"), _ratio(2.0 * F.col(f"tp{i}"), F.col(f"sup{i}") + F.col(f"prd{i}")).alias("f1"), F.col(f"sup{i}").alias("support")) for i, c in enumerate(labels)])
    return g.select(*by, F.explode(lines).alias("l")).select(*by, "l.*")


def compare(table: DataFrame, method: str, baseline: str, scope: str, values: tuple[str, ...] = SCORES) -> DataFrame:
    """Each other method minus the baseline, per scope; a missing value on either side gives null."""
    base = table.where(F.col(method) == baseline).select(F.col(scope), *[F.col(v).alias(f"__{v}") for v in values])
    return table.where(F.col(method) != baseline).join(base, scope).select(method, scope, *[(F.col(v) - F.col(f"__{v}")).alias(f"delta_{v}") for v in values])


def invalid_metrics(table: DataFrame, values: tuple[str, ...] = SCORES) -> DataFrame:
    """F17 on a flat table: rows whose image count isn't positive or with a value that is missing, not finite or outside 0..1."""
    bad = reduce(lambda a, b: a | b, [F.col(v).isNull() | F.isnan(v) | (F.col(v) < 0) | (F.col(v) > 1) for v in values])
    return table.where(F.col("n_images").isNull() | (F.col("n_images") <= 0) | bad)


def invalid_matrices(table: DataFrame, labels: tuple[str, ...] = STAGES) -> DataFrame:
    """F17 with the matrix: ``table`` with ``problem``, null for sound rows: the first of label order, shape, negative entries,
    image count, values outside 0..1, and an accuracy that the diagonal doesn't give.

    Reads ``matrix_labels array<string>, matrix array<array<bigint>>, n_images`` and the metric columns that are there.
    """
    m, k = F.col("matrix"), len(labels)
    entries = F.flatten(m)
    total = F.aggregate(entries, F.lit(0).cast("bigint"), lambda s, x: s + x)
    right = reduce(lambda a, b: a + b, [m[i][i] for i in range(k)])
    values = [v for v in SCORES if v in table.columns]
    bad = reduce(lambda a, b: a | b, [F.col(v).isNull() | F.isnan(v) | (F.col(v) < 0) | (F.col(v) > 1) for v in values])
    shape = (F.size(m) == k) & ~F.exists(m, lambda line: line.isNull() | (F.size(line) != k))
    problem = (
        F.when(~F.col("matrix_labels").eqNullSafe(F.array(*[F.lit(x) for x in labels])), "other label order")
        .when(~F.coalesce(shape, F.lit(False)), "other shape")
        .when(F.exists(entries, lambda x: x.isNull() | (x < 0)), "negative entry")
        .when(F.col("n_images").isNull() | (F.col("n_images") <= 0) | (total != F.col("n_images")), "other image count")
        .when(bad, "value outside 0..1")
    )
    if "accuracy" in values:
        far = F.abs(right / total - F.col("accuracy")) > 1e-8 + 1e-5 * F.abs("accuracy")
        problem = problem.when(far, "accuracy differs from diagonal")
    return table.withColumn("problem", problem)


def scope_options(table: DataFrame, runs: DataFrame) -> DataFrame:
    """``(position, scope)``: ``overall``, then the fruits that any of ``runs`` has, in order. Scopes are few."""
    seen = table.join(runs.select("run").distinct(), "run", "left_semi").select("scope").distinct()
    place = F.row_number().over(W.orderBy(F.col("scope") != "overall", "scope"))
    return seen.where("scope is not null").select(place.alias("position"), "scope")


def latest_runs(runs: DataFrame, by: tuple[str, ...], order: str) -> DataFrame:
    """The newest run per group, by its name from high to low."""
    return runs.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def compatible(runs: DataFrame, by: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """Per group of runs, whether all share one value (nulls count as a value) of every key: ``n_runs, same_<key>, compatible``."""
    same = {k: F.min(F.to_json(F.struct(k), {"ignoreNullFields": "false"})) == F.max(F.to_json(F.struct(k), {"ignoreNullFields": "false"})) for k in keys}
    g = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), *[e.alias(f"same_{k}") for k, e in same.items()])
    return g.withColumn("compatible", reduce(lambda a, b: a & b, [F.col(f"same_{k}") for k in keys]))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """``N / (K * count)`` per label; null labels take no part."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def epoch_scores(predictions: DataFrame, truth: str, pred: str, by: tuple[str, ...], epoch: str, method: str, labels: tuple[str, ...] = STAGES) -> DataFrame:
    """``(by, epoch, score)``, the mean of the methods' macro F1; :func:`best_epoch` chooses the checkpoint by it."""
    return metrics(predictions, truth, pred, (*by, epoch, method), labels=labels).where("scope = 'overall'").groupBy(*by, epoch).agg(F.avg("macro_f1").alias("score"))


def mean_losses(batches: DataFrame, by: tuple[str, ...], loss: str, size: str) -> DataFrame:
    """``(by, train_loss)``, the mean of batch losses weighted by batch size; a loss that isn't finite is an error."""
    x = F.col(loss).cast("double")
    finite = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("nonfinite training loss")).cast("double")).otherwise(x)
    return batches.groupBy(*by).agg((F.sum(finite * F.col(size)) / F.sum(size)).alias("train_loss"))


def best_epoch(history: DataFrame, by: tuple[str, ...], epoch: str, score: str) -> DataFrame:
    """The first epoch with the highest score."""
    return history.groupBy(*by).agg(F.max(score).alias("best_score"), F.max_by(epoch, F.struct(F.col(score), -F.col(epoch))).alias("best_epoch"))


def stopped_epoch(history: DataFrame, by: tuple[str, ...], epoch: str, score: str, patience: int) -> DataFrame:
    """The epoch at which training stops: the first after ``patience`` in a row without a new strict maximum, else the last."""
    w = W.partitionBy(*by).orderBy(epoch)
    best = F.max(score).over(w.rowsBetween(W.unboundedPreceding, -1))
    h = history.withColumn("__new", F.coalesce(F.col(score) > best, F.lit(True)))
    h = h.withColumn("__n", F.row_number().over(w)).withColumn("__last", F.max(F.when(F.col("__new"), F.col("__n"))).over(w))
    return h.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("__n") - F.col("__last") >= patience, F.col(epoch))), F.max(epoch)).alias("stopped_epoch"))
