"""Queries of run rules, histories, grids and object lists, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.functions.normalize import category, digest
from granary.operators import imaging, metrics as M, runs as R, splits as S, stats as T
from granary.plans.audit import IMAGES, images
from granary.plans.evaluation import _C, _COUNTS, _F1, _SEEN, PREDICTIONS, _rounded, predictions
from granary.plans.manifests import MANIFEST, manifest
from granary.plans.measures import _PIX, _pixels
from granary.schemas import FRUITS, METHODS, PREDICTION_GRID, STAGES, VIDEO_GRID, conform
from granary.session import table
from granary.streaming import throttle


def matrix_validity(spark, sf):
    """the confusion matrix of each method with its metrics, sound and with one fault of each kind."""
    p = predictions(spark, sf)
    lines = M.confusion(p, "true_stage", "predicted_stage", by=("method",))
    place = F.array_position(F.array(*[F.lit(c) for c in STAGES]), F.col("true_stage"))
    matrix = lines.groupBy("method").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("i"), F.array(*STAGES).alias("l")))), lambda s: s["l"]).alias("matrix"))
    scores = M.metrics(p, "true_stage", "predicted_stage", ("method",)).drop("scope")
    rows = matrix.join(scores, "method").withColumn("matrix_labels", F.array(*[F.lit(c) for c in STAGES]))
    rows = rows.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(6))))
    v = F.col("variant")
    first = F.col("matrix")[0]
    rows = rows.withColumn("matrix_labels", F.when(v == 1, F.reverse("matrix_labels")).otherwise(F.col("matrix_labels")))
    rows = rows.withColumn("n_images", F.when(v == 4, F.col("n_images") + 1).otherwise(F.col("n_images")))
    rows = rows.withColumn("macro_f1", F.when(v == 5, F.lit(1.5)).otherwise(F.col("macro_f1"))).withColumn("accuracy", F.when(v == 6, F.col("accuracy") / 2).otherwise(F.col("accuracy")))
    negative = F.concat(F.array(F.array(first[0], first[1] - 1 - first[1], first[2])), F.slice("matrix", 2, 2))
    rows = rows.withColumn("matrix", F.when(v == 2, F.slice("matrix", 1, 2)).when(v == 3, negative).otherwise(F.col("matrix")))
    return M.invalid_matrices(rows).select("method", "variant", "problem")


def _dated(spark, sf):
    days = table(spark, sf, "result_rows").select("result_id", F.to_date("created_at").alias("day")).distinct()
    return predictions(spark, sf).join(days, "result_id").withColumn("epoch", F.weekofyear("day"))


def epoch_scores(spark, sf):
    """Mean of the methods' macro F1 for each week of predictions, as an epoch's score."""
    return _rounded(M.epoch_scores(_dated(spark, sf), "true_stage", "predicted_stage", (), "epoch", "method"))


def chosen_checkpoint(spark, sf):
    """The week that such a history selects, and where training would have stopped after two poor ones."""
    h = _rounded(M.epoch_scores(_dated(spark, sf), "true_stage", "predicted_stage", (), "epoch", "method")).withColumn("run", F.lit("all"))
    return M.best_epoch(h, ("run",), "epoch", "score").join(M.stopped_epoch(h, ("run",), "epoch", "score", 2), "run")


def weighted_losses(spark, sf):
    """Event values as batch losses, weighted by batch size, per event type and day."""
    e = table(spark, sf, "events").where("value is not null").select("event_type", F.datediff("ts", F.lit("1970-01-01").cast("date")).alias("day"), (F.col("value") / 100).alias("loss"), (F.col("event_id") % 32 + 1).alias("size"))
    return _rounded(M.mean_losses(e, ("event_type", "day"), "loss", "size"))


def numbered_lines(spark, sf):
    """The objects of each order numbered by area."""
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return T.numbered(x, "l_orderkey", [F.desc("l_quantity"), "l_linenumber"])


def running_orders(spark, sf):
    """Place of every order in a batch by date, and the batch's size."""
    return R.running_positions(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "position", "total")


def border_clusters(spark, sf):
    """Three clusters of levels in every 8 x 8 image, counted on the border and in all, and the background one."""
    p = _pixels(spark, sf).withColumn("cluster", F.least(F.floor(F.col("bin") / 86), F.lit(2)).cast("int"))
    return T.cluster_counts(p, "vec_id", "cluster", (F.col("x") == 0) | (F.col("x") == 7) | (F.col("y") == 0) | (F.col("y") == 7))


def prediction_grid(spark, sf):
    """Results in the nine columns of the prediction grid."""
    r = table(spark, sf, "result_rows").select("result_id", *PREDICTION_GRID).distinct()
    return r.select("result_id", *conform(r, PREDICTION_GRID).columns)


def video_grid(spark, sf):
    """The camera's results as frames at 25 a second, in the nine columns of the video grid."""
    r = table(spark, sf, "result_rows").where("source = 'camera:0'").select("result_id", "created_at", *[c for c in VIDEO_GRID if c not in ("frame_index", "timestamp_seconds")]).distinct()
    placed = R.running_positions(r, [F.asc_nulls_last("created_at"), F.asc_nulls_last("result_id")]).withColumn("frame_index", F.col("position")).withColumn("timestamp_seconds", F.round((F.col("position") - 1) / 25.0, 6))
    return conform(placed, ("result_id", *VIDEO_GRID))


def scope_options(spark, sf):
    """What the scope selector offers for the newest run of every method."""
    t = table(spark, sf, "metric_rows")
    return M.scope_options(t, M.latest_runs(t.select("method", "backend", "run").distinct(), ("method", "backend"), "run"))


def _registry(spark, sf):
    """Saved runs with the fields that rules read; every seventh has one fault of a kind."""
    r = table(spark, sf, "metric_rows").where("scope = 'overall'").select("run", "method", "backend", "split", "split_id", "n_images").distinct()
    k = F.conv(F.substring(F.md5("run"), 1, 4), 16, 10).cast("int") % 14
    specs = F.create_map(*[F.lit(x) for m in METHODS for x in (m, R.spec_digest(R.method_spec(m)))])
    return r.select(
        "run", "method", "backend", F.col("split").alias("evaluation_split"), F.when(k == 4, "").otherwise(F.col("split_id")).alias("split_id"), F.when(k == 5, 0).otherwise(F.col("n_images")).alias("n_images"),
        F.when(k == 0, "building").otherwise("completed").alias("status"), F.when(k == 1, "other").otherwise(R.FEATURE_ID).alias("feature_id"),
        F.when(k == 2, "0").otherwise(F.try_element_at(specs, F.col("method"))).alias("spec_sha256"),
        F.when(k == 3, F.array(F.lit("ripe"))).otherwise(F.array(*[F.lit(c) for c in STAGES])).alias("classes"),
        F.when(k == 6, 7).otherwise(42).alias("seed"), F.lit("rf").alias("model_type"), F.create_map(F.lit("n"), F.col("n_images")).alias("counts"),
        F.create_map(F.lit("trees"), F.when(k == 7, "10").otherwise("300"), F.lit("n_jobs"), k.cast("string")).alias("model_parameters"),
        F.create_map(F.lit("numpy"), F.when(k == 8, "1").otherwise("2")).alias("versions"), F.lit("m").alias("model_sha256"),
    )


def run_validity(spark, sf):
    """what makes a saved run unusable, if anything."""
    return R.invalid_runs(_registry(spark, sf), R.FEATURE_ID).select("run", "problem")


def run_problems(spark, sf):
    """Runs that may not be compared with the first one, and why."""
    runs = _registry(spark, sf)
    first = runs.agg(F.min("run").alias("r")).first()["r"]
    return R.incompatible_runs(runs, first or "")


def method_labels(spark, sf):
    """Display names of the methods and classifiers seen, and which comparisons a method is in."""
    r = table(spark, sf, "result_rows").select(category(F.col("method")).alias("id")).unionByName(table(spark, sf, "metric_rows").select(F.col("backend").alias("id"))).where("id is not null").distinct()
    inside = [F.col("id").isin(*R.comparison_methods(h)).alias(f"with_{h}") for h in ("hybrid", "hybrid_refined")]
    return R.with_labels(r, "id", "label").select("id", "label", *inside)


def _detections(spark, sf):
    """Order lines as one detector run per order."""
    kinds = F.array(*[F.lit(f) for f in (*FRUITS, "pear")])
    d = F.struct(F.col("l_linenumber").alias("n"), F.element_at(kinds, (F.col("l_partkey") % 6 + 1).cast("int")).alias("fruit"), (F.col("l_discount") * 10).cast("double").alias("confidence"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("l_quantity").cast("double").alias("x2"), F.lit(9.0).alias("y2"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(d)).alias("found"))


def detected_objects(spark, sf):
    """Supported, certain and large enough detections, numbered as the detector gave them."""
    return R.object_rows(_detections(spark, sf), "l_orderkey").select("l_orderkey", "object_no", "fruit", F.round("confidence", 6).alias("confidence"), "x2")


def object_lists(spark, sf):
    """The objects of each order as one JSON list."""
    return R.objects_json(R.object_rows(_detections(spark, sf), "l_orderkey"), "l_orderkey", ["fruit"])


def latest_frames(spark, sf):
    """The newest event of each user, as the latest frame of a source."""
    e = table(spark, sf, "events").where("user_id is not null and ts is not null").select("user_id", "event_id", "ts")
    at = e.select("user_id", "event_id", "ts", F.struct("ts", "event_id").alias("frame"))
    return throttle.latest_frames(at, "user_id", "frame").select("user_id", "event_id", "ts")


def unchanged_previews(spark, sf):
    """Audited images, as previews, whose content in the manifest is still the same."""
    p = images(spark, sf).where("sha256 is not null").select("path", "sha256").distinct()
    return R.unchanged_previews(p, manifest(spark, sf))


def report_previews(spark, sf):
    """The first twelve audited images by path, numbered for their previews."""
    return imaging.report_previews(images(spark, sf).where("error = ''").select("path").distinct())


def guarded_batch(spark, sf):
    """Every picture of an embedding under two methods; content that pictures labelled 0 hold is reserved."""
    from granary.plans.pictures import pictures

    p = pictures(spark, sf).where("content is not null").select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("path"), "content", "label")
    rows = R.run_batch(p.select("path", "content"), p.where("label = 0").select(F.sha2("content", 256).alias("sha256")), ["baseline", "hsv"])
    return rows.select("path", "method", "status", "error", "foreground_pixels", "mask_status", "position", "total")


def final_evaluation(spark, sf):
    """The guarded evaluation of the test split with a rule in a classifier's place."""
    m = manifest(spark, sf).where("split is not null and fruit is not null and stage in ('unripe', 'ripe', 'overripe') and sha256 is not null")
    m = m.withColumn("source_split", F.col("split"))
    rule = lambda rows, method: rows.withColumn("predicted_stage", F.when(F.conv(F.substring("sha256", 1, 2), 16, 10).cast("int") % 4 == 0, "ripe").otherwise(F.col("stage")))
    _, scores = R.evaluate_final(spark, m, m, rule, ("baseline", "hsv"), frozen=True, trusted=True)
    return _rounded(scores).select("method", "scope", "n_images", "accuracy", "macro_f1")


_E = (matrix_validity, epoch_scores, chosen_checkpoint, weighted_losses, numbered_lines, running_orders, border_clusters, prediction_grid, video_grid, scope_options, run_validity, run_problems, method_labels, detected_objects, object_lists, latest_frames, unchanged_previews, report_previews, guarded_batch, final_evaluation)
QUERIES = {f.__name__: f for f in _E}

_FAULTS = ("NULL", "'other label order'", "'other shape'", "'negative entry'", "'other image count'", "'value outside 0..1'", "'accuracy differs from diagonal'")
_EPOCHS = f"""WITH {PREDICTIONS}, seen AS ({_SEEN}), d AS (SELECT DISTINCT result_id, weekofyear(created_at)::INTEGER AS epoch FROM result_rows), g AS (SELECT epoch, method, {_COUNTS} FROM seen JOIN d USING (result_id) GROUP BY ALL),
  h AS (SELECT epoch, round(avg(({' + '.join(_F1)}) / 3), 6) AS score FROM g GROUP BY epoch)"""
_KIND = "['" + "', '".join((*FRUITS, "pear")) + "']"
_OBJECTS = f"o AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_KIND}[l_partkey % 6 + 1], l_discount, l_quantity)::INTEGER AS object_no, {_KIND}[l_partkey % 6 + 1] AS fruit, round(l_discount * 10, 6)::DOUBLE AS confidence, l_quantity::DOUBLE AS x2 FROM lineitem WHERE l_partkey % 6 < 5 AND l_discount * 10 >= 0.2 AND l_quantity >= 4)"
_RUNS = "r AS (SELECT DISTINCT run, method, backend, split, split_id, n_images, ('0x' || md5(run)[1:4])::INTEGER % 14 AS k FROM metric_rows WHERE scope = 'overall')"
_LABELS = ", ".join(f"('{k}', '{v}')" for k, v in R.LABELS.items())
_IN = lambda h: ", ".join(f"'{m}'" for m in R.comparison_methods(h))
SQL = {
    "matrix_validity": f"WITH {PREDICTIONS}, seen AS ({_SEEN}) SELECT method, variant, problem FROM (SELECT DISTINCT method FROM seen), (VALUES " + ", ".join(f"({i}, {x})" for i, x in enumerate(_FAULTS)) + ") f(variant, problem)",
    "epoch_scores": f"{_EPOCHS} SELECT epoch, score FROM h",
    "chosen_checkpoint": f"""{_EPOCHS}, n AS (SELECT *, row_number() OVER w AS n, coalesce(score > max(score) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM h WINDOW w AS (ORDER BY epoch)),
      l AS (SELECT *, max(CASE WHEN fresh THEN n END) OVER (ORDER BY epoch) AS last FROM n) SELECT 'all' AS run, max(score) AS best_score, arg_max(epoch, struct_pack(s := score, e := -epoch)) AS best_epoch, coalesce(min(epoch) FILTER (n - last >= 2), max(epoch)) AS stopped_epoch FROM l HAVING count(*) > 0""",
    "weighted_losses": "SELECT event_type, date_diff('day', DATE '1970-01-01', ts::DATE)::INTEGER AS day, round(sum(value / 100 * (event_id % 32 + 1)) / sum(event_id % 32 + 1), 6) AS train_loss FROM events WHERE value IS NOT NULL GROUP BY ALL",
    "numbered_lines": "SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber)::INTEGER AS object_no FROM lineitem",
    "running_orders": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position, count(*) OVER () AS total FROM orders",
    "border_clusters": f"WITH {_PIX}, n AS (SELECT vec_id, least(bin // 86, 2)::INTEGER AS cluster, count(*) FILTER (x IN (0, 7) OR y IN (0, 7)) AS border, count(*) AS everywhere FROM pix GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY border DESC, everywhere DESC, cluster) = 1 AS background FROM n",
    "prediction_grid": f"SELECT DISTINCT result_id, {', '.join(PREDICTION_GRID)} FROM result_rows",
    "video_grid": f"WITH r AS (SELECT DISTINCT result_id, created_at, {', '.join(VIDEO_GRID[2:])} FROM result_rows WHERE source = 'camera:0'), n AS (SELECT *, row_number() OVER (ORDER BY created_at, result_id) AS frame_index FROM r) SELECT result_id, frame_index, round((frame_index - 1) / 25.0, 6) AS timestamp_seconds, {', '.join(VIDEO_GRID[2:])} FROM n",
    "scope_options": "WITH l AS (SELECT run FROM (SELECT DISTINCT method, backend, run FROM metric_rows) QUALIFY row_number() OVER (PARTITION BY method, backend ORDER BY run DESC) = 1) SELECT row_number() OVER (ORDER BY scope <> 'overall', scope)::INTEGER AS position, scope FROM (SELECT DISTINCT scope FROM metric_rows WHERE run IN (SELECT run FROM l) AND scope IS NOT NULL)",
    "run_validity": f"WITH {_RUNS} SELECT run, CASE k WHEN 0 THEN 'not completed' WHEN 1 THEN 'other features' WHEN 2 THEN 'other method parameters' WHEN 3 THEN 'other class order' WHEN 4 THEN 'no split id' WHEN 5 THEN 'no images' END AS problem FROM r",
    "run_problems": f"""WITH {_RUNS}, x AS (SELECT *, CASE WHEN k = 4 THEN '' ELSE split_id END AS sid, CASE WHEN k = 1 THEN 'other' ELSE 'f' END AS fid, CASE WHEN k = 6 THEN 7 ELSE 42 END AS seed, CASE WHEN k = 7 THEN 10 ELSE 300 END AS trees, CASE WHEN k = 8 THEN 1 ELSE 2 END AS numpy FROM r), f AS (SELECT * FROM x WHERE run = (SELECT min(run) FROM r))
      SELECT * FROM (SELECT x.run, CASE WHEN x.split IS DISTINCT FROM f.split THEN 'evaluation_split differs' WHEN x.backend IS DISTINCT FROM f.backend THEN 'backend differs' WHEN x.sid IS DISTINCT FROM f.sid THEN 'split_id differs' WHEN x.fid <> f.fid THEN 'feature_id differs' WHEN x.n_images IS DISTINCT FROM f.n_images THEN 'counts differs'
        WHEN x.seed <> f.seed THEN 'seed differs' WHEN x.trees <> f.trees THEN 'model_parameters differs' WHEN x.numpy <> f.numpy THEN 'versions differs' END AS problem FROM x, f WHERE x.run <> f.run) WHERE problem IS NOT NULL""",
    "method_labels": rf"WITH i AS (SELECT DISTINCT id FROM (SELECT lower(regexp_replace(method, '^\s+|\s+$', '', 'g')) AS id FROM result_rows UNION ALL SELECT backend FROM metric_rows) WHERE id <> '') SELECT id, coalesce(label, id) AS label, id IN ({_IN('hybrid')}) AS with_hybrid, id IN ({_IN('hybrid_refined')}) AS with_hybrid_refined FROM i LEFT JOIN (VALUES {_LABELS}) l(k, label) ON k = id",
    "detected_objects": f"WITH {_OBJECTS} SELECT l_orderkey, object_no, fruit, confidence, x2 FROM o",
    "object_lists": f"WITH {_OBJECTS} SELECT l_orderkey, to_json(list({{'object_no': object_no, 'fruit': fruit}} ORDER BY object_no))::VARCHAR AS object_results_json FROM o GROUP BY 1",
    "latest_frames": "SELECT user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id, max(ts) AS ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1",
    "unchanged_previews": f"WITH {IMAGES}, {MANIFEST} SELECT DISTINCT path, sha256 FROM images WHERE sha256 IS NOT NULL AND (path, sha256) IN (SELECT (path, sha256) FROM manifest WHERE sha256 IS NOT NULL AND path IS NOT NULL)",
    "report_previews": f"WITH {IMAGES}, p AS (SELECT DISTINCT path FROM images WHERE error = '' ORDER BY path LIMIT 12) SELECT path, row_number() OVER (ORDER BY path)::INTEGER AS place, lpad((row_number() OVER (ORDER BY path))::VARCHAR, 3, '0') || '_' || regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') || '.png' AS preview FROM p",
    "guarded_batch": """WITH v AS (SELECT vec_id, lpad(vec_id::VARCHAR, 8, '0') AS path, label, list_transform(embedding::DOUBLE[], lambda x: floor((x - list_min(embedding::DOUBLE[])) / (list_max(embedding::DOUBLE[]) - list_min(embedding::DOUBLE[])) * 200)) AS drawn FROM embeddings WHERE len(embedding) = 64),
      b AS (SELECT path, drawn IN (SELECT drawn FROM v WHERE label = 0) AS held FROM v), m AS (SELECT * FROM b, (VALUES ('baseline', 3600, 'not_segmented'), ('hsv', 1600, 'nonempty')) m(method, px, state))
      SELECT path, method, CASE WHEN held THEN 'error' ELSE 'ok' END AS status, CASE WHEN held THEN 'reserved for testing' ELSE '' END AS error, CASE WHEN NOT held THEN px END::BIGINT AS foreground_pixels, CASE WHEN NOT held THEN state END AS mask_status, row_number() OVER (ORDER BY path, method) AS position, count(*) OVER () AS total FROM m""",
    "final_evaluation": f"""WITH {MANIFEST}, preds AS (SELECT x.method, fruit, stage AS true_stage, CASE WHEN ('0x' || sha256[1:2])::INTEGER % 4 = 0 THEN 'ripe' ELSE stage END AS predicted_stage FROM manifest, (VALUES ('baseline'), ('hsv')) x(method) WHERE split = 'test' AND fruit IS NOT NULL AND stage IN ('unripe', 'ripe', 'overripe') AND sha256 IS NOT NULL)
      SELECT method, CASE WHEN g = 1 THEN 'overall' ELSE fruit END AS scope, n_images, round((tp0 + tp1 + tp2)::DOUBLE / n_images, 6) AS accuracy, round(({' + '.join(_F1)}) / 3, 6) AS macro_f1 FROM (SELECT method, fruit, grouping(fruit) AS g, count(*) AS n_images, {_COUNTS} FROM preds GROUP BY GROUPING SETS ((method), (method, fruit)))""",
}
