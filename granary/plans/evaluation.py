"""Queries over predictions and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.functions.normalize import category
from granary.functions.scalars import first_max, run_label, softmax
from granary.operators import metrics as M
from granary.operators import splits as S
from granary.session import table


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Results joined on path with the audited images' labels; repeated rows count once."""
    r = table(spark, sf, "result_rows").where("status = 'ok'").select("result_id", category(F.col("method")).alias("method"), "source", "run", "backend", "predicted_stage", "score_unripe", "score_ripe", "score_overripe", "processing_ms").distinct()
    a = table(spark, sf, "audit_manifest").where("error = ''").select(F.col("path").alias("source"), F.col("fruit"), F.col("stage").alias("true_stage")).distinct()
    return r.join(a, "source").withColumn("correct", F.col("predicted_stage") == F.col("true_stage"))


PREDICTIONS = r"""
preds AS (SELECT r.*, a.fruit, a.true_stage, r.predicted_stage = a.true_stage AS correct FROM
  (SELECT DISTINCT result_id, lower(regexp_replace(method, '^\s+|\s+$', '', 'g')) AS method, source, run, backend, predicted_stage, score_unripe, score_ripe, score_overripe, processing_ms FROM result_rows WHERE status = 'ok') r
  JOIN (SELECT DISTINCT path AS source, fruit, stage AS true_stage FROM audit_manifest WHERE error = '') a USING (source))
"""
_C = ("unripe", "ripe", "overripe")
_SEEN = "SELECT * FROM preds WHERE true_stage IN ('unripe', 'ripe', 'overripe') AND predicted_stage IN ('unripe', 'ripe', 'overripe')"
_COUNTS = ", ".join(f"count(*) FILTER (true_stage = '{c}' AND predicted_stage = '{c}') AS tp{i}, count(*) FILTER (true_stage = '{c}') AS sup{i}, count(*) FILTER (predicted_stage = '{c}') AS prd{i}" for i, c in enumerate(_C))
_P = [f"CASE WHEN prd{i} > 0 THEN tp{i}::DOUBLE / prd{i} ELSE 0 END" for i in range(3)]
_R = [f"CASE WHEN sup{i} > 0 THEN tp{i}::DOUBLE / sup{i} ELSE 0 END" for i in range(3)]
_F1 = [f"CASE WHEN sup{i} + prd{i} > 0 THEN 2.0 * tp{i} / (sup{i} + prd{i}) ELSE 0 END" for i in range(3)]
_METRICS = f"""round((tp0 + tp1 + tp2)::DOUBLE / n_images, 6) AS accuracy, round(({' + '.join(_R)}) / ((sup0 > 0)::INT + (sup1 > 0)::INT + (sup2 > 0)::INT), 6) AS balanced_accuracy,
  round(({' + '.join(_P)}) / 3, 6) AS macro_precision, round(({' + '.join(_R)}) / 3, 6) AS macro_recall, round(({' + '.join(_F1)}) / 3, 6) AS macro_f1"""
_SCOPES = f"""SELECT method, CASE WHEN g = 1 THEN 'overall' ELSE fruit END AS scope, n_images, {_METRICS} FROM
  (SELECT method, fruit, grouping(fruit) AS g, count(*) AS n_images, {_COUNTS} FROM ({_SEEN}) WHERE fruit IS NOT NULL GROUP BY GROUPING SETS ((method), (method, fruit)))"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def confusion_by_method(spark, sf):
    """A6."""
    return M.confusion(predictions(spark, sf), "true_stage", "predicted_stage", by=("method",))


def metrics_by_scope(spark, sf):
    """Overall and per fruit."""
    return _rounded(M.metrics(predictions(spark, sf), "true_stage", "predicted_stage", ("method",), "fruit"))


def metrics_per_class(spark, sf):
    """A10."""
    return _rounded(M.per_class(predictions(spark, sf), "true_stage", "predicted_stage", ("method",)))


def method_comparison(spark, sf):
    """Each method minus the baseline."""
    return _rounded(M.compare(M.metrics(predictions(spark, sf), "true_stage", "predicted_stage", ("method",), "fruit"), "method", "baseline", "scope"))


def evaluation_rows(spark, sf):
    """Saved validation metrics of all runs, one scope."""
    return table(spark, sf, "metric_rows").where("split = 'validation' and scope = 'overall'").select("method", "backend", "run", "n_images", "accuracy", "macro_f1")


def invalid_metrics(spark, sf):
    """F17 on the saved metrics, and on a copy with one value out of range per method."""
    t = table(spark, sf, "metric_rows")
    broken = t.where("scope = 'overall'").withColumn("accuracy", F.col("accuracy") + 1)
    return M.invalid_metrics(t.unionByName(broken)).select("method", "run", "scope", F.round("accuracy", 6).alias("accuracy"))


def latest_runs(spark, sf):
    """Newest run per method and backend, with its readable name."""
    runs = table(spark, sf, "metric_rows").where("scope = 'overall'").select("method", "backend", "run", "split_id").distinct()
    return M.latest_runs(runs, ("method", "backend"), "run").withColumn("label", run_label(F.regexp_extract("run", r"([^/]*)$", 1)))


def run_compatibility(spark, sf):
    """Runs of a backend that may be compared: same split, same evaluation split, same number of images."""
    runs = table(spark, sf, "metric_rows").where("scope = 'overall'").select("run", "backend", "split", "split_id", "n_images").distinct()
    return M.compatible(runs, ("backend",), ("split", "split_id", "n_images"))


def class_weights(spark, sf):
    """A15."""
    return _rounded(M.class_weights(table(spark, sf, "audit_manifest").where("error = ''").select("image_id", "stage").distinct(), "stage"))


def score_argmax(spark, sf):
    """Class of the largest score, first on a tie, compared with the stored prediction."""
    p = predictions(spark, sf)
    s = [F.col(f"score_{c}") for c in _C]
    soft = softmax(s)
    return p.select("result_id", first_max(list(_C), s).alias("best"), F.round(soft[0], 6).alias("soft_unripe"))


def stratum_previews(spark, sf):
    """First prediction per fruit and stage, then three wrong ones."""
    p = predictions(spark, sf).where("method = 'baseline' and fruit is not null and predicted_stage in ('unripe', 'ripe', 'overripe')")
    return S.previews(p, ["fruit", "true_stage"], "result_id", "correct").select("result_id", "fruit", "true_stage", "predicted_stage", "selection")


def first_test_images(spark, sf):
    """First path of the test split per fruit and stage."""
    from granary.plans.audit import images

    t = images(spark, sf).where("split = 'test' and error = ''").select("path", "fruit", "stage").distinct()
    return S.first_per_stratum(t, ["fruit", "stage"], ["path"])


def _epochs(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("score")).withColumn("epoch", F.datediff("day", F.lit("1970-01-01").cast("date")))


def best_epochs(spark, sf):
    """First day with the highest mean value, as an epoch selection."""
    return M.best_epoch(_epochs(spark, sf), ("event_type",), "epoch", "score")


def early_stops(spark, sf):
    """The day on which five days in a row brought no new maximum."""
    return M.stopped_epoch(_epochs(spark, sf), ("event_type",), "epoch", "score", 5)


def method_timings(spark, sf):
    """Mean time per image and status counts of each method."""
    r = table(spark, sf, "result_rows").select("result_id", category(F.col("method")).alias("method"), "status", "processing_ms", "foreground_fraction").distinct()
    ok = (F.col("processing_ms") >= 0) & (F.col("processing_ms") < F.lit(float("inf")))
    return _rounded(r.where("method is not null").groupBy("method").agg(F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "error").alias("n_error"), F.avg(F.when(ok, F.col("processing_ms"))).alias("mean_ms"), F.avg("foreground_fraction").alias("mean_foreground")))


_EPOCHS = "e AS (SELECT event_type, date_diff('day', DATE '1970-01-01', ts::DATE)::INTEGER AS epoch, round(avg(value), 6) AS score FROM events GROUP BY 1, 2)"
QUERIES = {f.__name__: f for f in (confusion_by_method, metrics_by_scope, metrics_per_class, method_comparison, evaluation_rows, invalid_metrics, latest_runs, run_compatibility, class_weights, score_argmax, stratum_previews, first_test_images, best_epochs, early_stops, method_timings)}
_D = ("accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1")
_RAW = _SCOPES.replace("round(", "(").replace(", 6)", ")")
SQL = {
    "confusion_by_method": f"WITH {PREDICTIONS}, s AS ({_SEEN}) SELECT m.method, t.true_stage, " + ", ".join(f"(SELECT count(*) FROM s WHERE s.method = m.method AND s.true_stage = t.true_stage AND s.predicted_stage = '{c}') AS {c}" for c in _C) + " FROM (SELECT DISTINCT method FROM s) m, (VALUES ('unripe'), ('ripe'), ('overripe')) t(true_stage)",
    "metrics_by_scope": f"WITH {PREDICTIONS} {_SCOPES}",
    "metrics_per_class": f"WITH {PREDICTIONS}, g AS (SELECT method, {_COUNTS} FROM ({_SEEN}) GROUP BY method) " + " UNION ALL ".join(f"SELECT method, '{c}' AS label, round({_P[i]}, 6) AS precision, round({_R[i]}, 6) AS recall, round({_F1[i]}, 6) AS f1, sup{i} AS support FROM g" for i, c in enumerate(_C)),
    "method_comparison": f"WITH {PREDICTIONS}, m AS ({_RAW}) SELECT a.method, a.scope, " + ", ".join(f"round(a.{d} - b.{d}, 6) AS delta_{d}" for d in _D) + " FROM m a JOIN m b ON b.method = 'baseline' AND a.scope = b.scope WHERE a.method <> 'baseline'",
    "evaluation_rows": "SELECT method, backend, run, n_images, accuracy, macro_f1 FROM metric_rows WHERE split = 'validation' AND scope = 'overall'",
    "invalid_metrics": "SELECT method, run, scope, round(accuracy + 1, 6) AS accuracy FROM metric_rows WHERE scope = 'overall' AND accuracy > 0",
    "latest_runs": "SELECT method, backend, run, split_id, strftime(strptime(substr(regexp_extract(run, '([^/]*)$', 1), 1, 15), '%Y%m%dT%H%M%S'), '%d %b %Y, %H:%M:%S') || ' UTC' AS label FROM (SELECT DISTINCT method, backend, run, split_id FROM metric_rows WHERE scope = 'overall') QUALIFY row_number() OVER (PARTITION BY method, backend ORDER BY run DESC) = 1",
    "run_compatibility": "SELECT backend, count(*) AS n_runs, count(DISTINCT split) = 1 AS same_split, count(DISTINCT split_id) = 1 AS same_split_id, count(DISTINCT n_images) = 1 AS same_n_images, count(DISTINCT split) = 1 AND count(DISTINCT split_id) = 1 AND count(DISTINCT n_images) = 1 AS compatible FROM (SELECT DISTINCT run, backend, split, split_id, n_images FROM metric_rows WHERE scope = 'overall') GROUP BY backend",
    "class_weights": "WITH c AS (SELECT stage, count(DISTINCT image_id) AS n FROM audit_manifest WHERE error = '' AND stage IS NOT NULL GROUP BY stage) SELECT stage, n, round((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c",
    "score_argmax": f"WITH {PREDICTIONS} SELECT result_id, CASE WHEN score_unripe IS NULL OR score_ripe IS NULL OR score_overripe IS NULL OR isnan(score_unripe) OR isnan(score_ripe) OR isnan(score_overripe) THEN NULL WHEN score_unripe >= score_ripe AND score_unripe >= score_overripe THEN 'unripe' WHEN score_ripe >= score_overripe THEN 'ripe' ELSE 'overripe' END AS best, round(exp(score_unripe - greatest(score_unripe, score_ripe, score_overripe)) / (exp(score_unripe - greatest(score_unripe, score_ripe, score_overripe)) + exp(score_ripe - greatest(score_unripe, score_ripe, score_overripe)) + exp(score_overripe - greatest(score_unripe, score_ripe, score_overripe))), 6) AS soft_unripe FROM preds",
    "stratum_previews": f"WITH {PREDICTIONS}, p AS (SELECT * FROM preds WHERE method = 'baseline' AND fruit IS NOT NULL AND predicted_stage IN ('unripe', 'ripe', 'overripe')), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY fruit, true_stage ORDER BY result_id) = 1), x AS (SELECT * FROM p WHERE NOT correct AND result_id NOT IN (SELECT result_id FROM f) ORDER BY result_id LIMIT 3) SELECT result_id, fruit, true_stage, predicted_stage, 'first_per_fruit_stage' AS selection FROM f UNION ALL SELECT result_id, fruit, true_stage, predicted_stage, 'additional_failure' FROM x",
    "best_epochs": f"WITH {_EPOCHS} SELECT event_type, max(score) AS best_score, arg_max(epoch, struct_pack(s := score, e := -epoch)) AS best_epoch FROM e GROUP BY 1",
    "early_stops": f"WITH {_EPOCHS}, n AS (SELECT *, row_number() OVER w AS n, coalesce(score > max(score) OVER (PARTITION BY event_type ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM e WINDOW w AS (PARTITION BY event_type ORDER BY epoch)), l AS (SELECT *, max(CASE WHEN fresh THEN n END) OVER (PARTITION BY event_type ORDER BY epoch) AS last FROM n) SELECT event_type, coalesce(min(epoch) FILTER (n - last >= 5), max(epoch)) AS stopped_epoch FROM l GROUP BY 1",
    "method_timings": r"SELECT method, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'error') AS n_error, round(avg(processing_ms) FILTER (processing_ms >= 0 AND isfinite(processing_ms)), 6) AS mean_ms, round(avg(foreground_fraction), 6) AS mean_foreground FROM (SELECT DISTINCT result_id, lower(regexp_replace(method, '^\s+|\s+$', '', 'g')) AS method, status, processing_ms, foreground_fraction FROM result_rows) WHERE method IS NOT NULL GROUP BY 1",
}
from granary.plans.audit import IMAGES  # noqa: E402

SQL["first_test_images"] = f"WITH {IMAGES} SELECT path, fruit, stage FROM (SELECT DISTINCT path, fruit, stage FROM images WHERE split = 'test' AND error = '') QUALIFY row_number() OVER (PARTITION BY fruit, stage ORDER BY path) = 1"
