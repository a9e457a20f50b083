"""Queries of statistics, measurements, objects, pixels and display forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.functions.scalars import clamp_box, display, frame_seconds, letterbox, mask_status, quality_grade, review_flag, run_label, safe_cell, working_size
from granary.operators import stats as T
from granary.schemas import METHODS
from granary.session import table
from granary.streaming.throttle import throttle


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", "user_id", "ts", "value")


def percentile_stretch(spark, sf):
    """Event values of each type stretched between their 2nd and 98th percentile."""
    return T.percentile_stretch(_events(spark, sf), "event_type", "value").select("event_id", "stretched")


def robust_z(spark, sf):
    """Robust deviation of event values within their type, and which are outliers."""
    return T.robust_z(_events(spark, sf), "event_type", "value").select("event_id", F.round("z", 6).alias("z"), (F.round("z", 6) > 3.0).alias("outlier"))


def _histogram(spark, sf):
    return _events(spark, sf).where("value is not null").select("event_type", F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("value") / 2))).cast("bigint").alias("bin")).groupBy("event_type", "bin").agg(F.count(F.lit(1)).alias("n"))


def histogram(spark, sf):
    """Histogram of event values."""
    return _histogram(spark, sf)


def otsu_values(spark, sf):
    """Otsu threshold of each type's histogram, the first of the best."""
    return T.otsu_thresholds(_histogram(spark, sf), "event_type", "bin")


def quality_report(spark, sf):
    """Grades of order lines by twice their discount, overall and per flag."""
    x = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_discount") * 2).alias("fraction"), F.when(F.col("l_quantity") >= 3, "graded").otherwise("too_small_foreground").alias("status"))
    x = x.withColumn("grade", quality_grade(F.col("fraction"), F.col("status")))
    r = T.quality_report(x, "fraction", "grade", "l_returnflag")
    return r.select("scope", "images", "graded", "ungraded", F.round("mean_fraction", 6).alias("mean_fraction"), F.round("median_fraction", 6).alias("median_fraction"))


def grade_counts(spark, sf):
    """How many lines have each grade."""
    x = table(spark, sf, "lineitem").select(quality_grade(F.col("l_discount") * 2).alias("grade"))
    return x.groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


def object_aggregate(spark, sf):
    """Order lines as the objects of orders: unanimous, mixed or none."""
    o = table(spark, sf, "orders").select("o_orderkey")
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag", "l_linestatus", "l_discount", "l_quantity")
    a = T.aggregate_objects(o, x, "o_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", ["l_discount"], ["l_quantity"])
    return a.withColumn("l_discount", F.round("l_discount", 6))


def measure_units(spark, sf):
    """Part sizes as areas at 2.5 pixels a unit."""
    return table(spark, sf, "part").select("p_partkey", T.measures(F.col("p_size"), F.lit(2.5)).alias("m")).select("p_partkey", *[F.round(f"m.{c}", 6).alias(c) for c in ("area_px", "diameter_px", "area", "diameter")])


def letterbox_sizes(spark, sf):
    """P5, P25: letterbox and working size of every audited image."""
    i = table(spark, sf, "audit_manifest").where("width > 0 and height > 0").select("width", "height").distinct()
    return i.select("width", "height", letterbox(F.col("width"), F.col("height")).alias("l"), working_size(F.col("width"), F.col("height"), 200).alias("w")).select("width", "height", F.col("l.width").alias("box_width"), F.col("l.height").alias("box_height"), F.col("l.left").alias("box_left"), F.col("l.top").alias("box_top"), F.col("w.width").alias("work_width"), F.col("w.height").alias("work_height"))


def clamped_boxes(spark, sf):
    """Event values as box corners, kept inside a 300 x 225 image."""
    e = _events(spark, sf)
    return e.select("event_id", clamp_box(F.col("value") - 100, F.col("value") - 60, F.col("value") + 0.5, F.col("value") + 20, F.lit(300), F.lit(225)).alias("b")).select("event_id", "b.*")


def mask_flags(spark, sf):
    """Mask status and review flag of all results."""
    r = table(spark, sf, "result_rows").select("result_id", F.lower(F.trim("method")).alias("method"), "foreground_fraction", "score_ripe").where("foreground_fraction is not null and method is not null").distinct()
    return r.select("result_id", mask_status(F.col("foreground_fraction"), F.col("method")).alias("mask_state"), review_flag(F.col("foreground_fraction"), F.col("score_ripe")).alias("review"))


def image_by_method(spark, sf):
    """Every image under every method, counted per method and split."""
    i = table(spark, sf, "audit_manifest").where("error = ''").select("image_id", "fruit").distinct()
    m = spark.createDataFrame([(x,) for x in METHODS], "method string")
    return i.crossJoin(F.broadcast(m)).groupBy("method", "fruit").agg(F.count(F.lit(1)).alias("n"))


def safe_cells(spark, sf):
    """K4: balances and document texts as spreadsheet cells."""
    d = table(spark, sf, "documents").where("text is not null").select(F.concat(F.lit("d"), "doc_id").alias("id"), safe_cell(F.col("text")).alias("cell"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), safe_cell(F.concat(F.when(F.col("c_acctbal") < 0, "-").otherwise(""), "c_name")).alias("cell"))
    return d.unionByName(c)


def display_values(spark, sf):
    """Results as the report shows them."""
    r = table(spark, sf, "result_rows").select("result_id", "source", "foreground_fraction", F.when((F.col("processing_ms") >= 0) & (F.col("processing_ms") < 1e6), F.col("processing_ms")).alias("processing_ms"), "predicted_stage").distinct()
    return r.select("result_id", *[display(c, F.col(c)).alias(c) for c in ("source", "foreground_fraction", "processing_ms", "predicted_stage")])


def run_labels(spark, sf):
    """Readable run names, with the key appended to all of them where two are alike."""
    runs = table(spark, sf, "metric_rows").select("run").distinct().select("run", run_label(F.regexp_extract("run", r"([^/]*)$", 1)).alias("l"))
    alike = runs.agg((F.countDistinct("l") < F.count("l")).alias("alike"))
    return runs.crossJoin(F.broadcast(alike)).select("run", F.when(F.col("alike"), F.concat("l", F.lit(" ["), "run", F.lit("]"))).otherwise(F.col("l")).alias("label"))


def frame_times(spark, sf):
    """Order lines as frames at the rate given by their quantity, 25 where it is below 3."""
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") >= 3, F.col("l_quantity")).otherwise(0.0).alias("fps"))
    return x.select("l_orderkey", "l_linenumber", F.round(frame_seconds(F.col("l_linenumber"), F.col("fps")), 6).alias("seconds"))


def throttled_events(spark, sf):
    """W12, R2 in batch form: events of each user at least an hour after the last one kept."""
    return throttle(_events(spark, sf).where("user_id is not null and ts is not null"), "user_id", "ts", "event_id", 3600.0).select("event_id")


def _drawn(spark, sf):
    """Embeddings as ``v``, arrays of doubles, and the expression of their levels 0 to 255 as 8 x 8 images, row by row."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    lo, hi = F.array_min("v"), F.array_max("v")
    return e, F.transform("v", lambda x: F.floor((x - lo) / F.when(hi > lo, hi - lo).otherwise(1.0) * 255).cast("bigint"))


def _pixels(spark, sf):
    """``(vec_id, y, x, bin)``, a row per pixel."""
    e, q = _drawn(spark, sf)
    return e.select("vec_id", F.posexplode(q).alias("i", "bin")).select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), "bin")


def pixel_otsu(spark, sf):
    """M2: Otsu mask of every 8 x 8 image: threshold, bright pixels, bright pixels on the border, chosen side and its share.

    The foreground is the side with fewer border pixels, on a tie the smaller one, then the bright one.
    """
    p = _pixels(spark, sf)
    t = T.otsu_thresholds(p.groupBy("vec_id", "bin").agg(F.count(F.lit(1)).alias("n")), "vec_id", "bin")
    border = (F.col("x") == 0) | (F.col("x") == 7) | (F.col("y") == 0) | (F.col("y") == 7)
    bright = F.col("bin") > F.col("threshold")
    g = p.join(t, "vec_id").groupBy("vec_id", "threshold").agg(F.count_if(bright).alias("bright"), F.count_if(bright & border).alias("border_bright"))
    b, o = F.col("border_bright"), 28 - F.col("border_bright")
    take = (b < o) | ((b == o) & (F.col("bright") <= 64 - F.col("bright")))
    return g.select("vec_id", "threshold", "bright", "border_bright", take.alias("takes_bright"), (F.when(take, F.col("bright")).otherwise(64 - F.col("bright")) / 64.0).alias("foreground_fraction"))


def mask_agreement(spark, sf):
    """Two masks of every 8 x 8 image compared."""
    chequer = lambda x, i: (F.floor(i / 8) + i % 8) % 2 == 0
    e, q = _drawn(spark, sf)
    # exploding a list of one keeps the levels from being computed anew wherever they are used
    levels = e.where("size(v) > 0").select("vec_id", F.explode(F.array(q)).alias("q"))
    g = levels.select("vec_id", T.arrays_agree(F.col("q"), lambda x, i: x > 127, chequer).alias("m")).select("vec_id", "m.*")
    return g.select("vec_id", *[F.round(c, 6).alias(c) for c in g.columns if c != "vec_id"])


def mask_boxes(spark, sf):
    """Area, extents and centre of the bright pixels of every 8 x 8 image."""
    p = _pixels(spark, sf).where("bin > 127")
    return p.groupBy("vec_id").agg(F.count(F.lit(1)).alias("area"), F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"))


def centroid_assign(spark, sf):
    """The label whose mean vector is nearest to each embedding."""
    from granary.operators.models import nearest_centroid

    return nearest_centroid(table(spark, sf, "embeddings"), "vec_id", "embedding", "label").withColumn("distance", F.round("distance", 4))


def largest_lines(spark, sf):
    """The largest object of each order by area; ties keep the first."""
    x = table(spark, sf, "lineitem")
    return x.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_quantity", -F.col("l_linenumber"))).alias("largest"), F.max("l_quantity").alias("area"), F.count(F.lit(1)).alias("objects"))


_E = (percentile_stretch, robust_z, histogram, otsu_values, quality_report, grade_counts, object_aggregate, measure_units, letterbox_sizes, clamped_boxes, mask_flags, image_by_method, safe_cells, display_values, run_labels, frame_times, throttled_events, pixel_otsu, mask_agreement, mask_boxes, largest_lines, centroid_assign)
QUERIES = {f.__name__: f for f in _E}

_HIST = "h AS (SELECT event_type, least(255, greatest(0, floor(value / 2)))::BIGINT AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"
_OTSU = "c AS (SELECT *, sum(n) OVER (PARTITION BY k) AS t, sum(n * bin) OVER (PARTITION BY k) AS tm, sum(n) OVER (PARTITION BY k ORDER BY bin) AS w, sum(n * bin) OVER (PARTITION BY k ORDER BY bin) AS m FROM hist), o AS (SELECT k, arg_max(bin, struct_pack(s := pow((tm * w - m * t)::DOUBLE, 2) / (w * (t - w))::DOUBLE, b := -bin)) AS threshold FROM c WHERE w < t GROUP BY k)"
_PIX = "v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id, unnest(range(64)) AS i, unnest(v) AS x, list_min(v) AS lo, list_max(v) AS hi FROM v), pix AS (SELECT vec_id, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, floor((q.x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 255)::BIGINT AS bin FROM q)"
_GRADE = "CASE WHEN {f} <= 0.05 THEN 'Good' WHEN {f} <= 0.15 THEN 'Acceptable' ELSE 'Poor' END"
SQL = {
    "percentile_stretch": "WITH p AS (SELECT event_type, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM events GROUP BY 1) SELECT event_id, floor(greatest(0.0, least(255.0, CASE WHEN hi > lo THEN (value - lo) * 255.0 / (hi - lo) ELSE value END)))::INTEGER AS stretched FROM events JOIN p USING (event_type)",
    "robust_z": "WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), j AS (SELECT * FROM events JOIN m USING (event_type)), d AS (SELECT event_type, median(abs(value - m)) AS d FROM j GROUP BY 1) SELECT event_id, round((value - m) / greatest(1.4826 * d, 2.0), 6) AS z, round((value - m) / greatest(1.4826 * d, 2.0), 6) > 3.0 AS outlier FROM j JOIN d USING (event_type)",
    "histogram": f"WITH {_HIST} SELECT event_type, bin, n FROM h",
    "otsu_values": f"WITH {_HIST}, hist AS (SELECT event_type AS k, bin, n FROM h), {_OTSU} SELECT k AS event_type, threshold FROM o",
    "quality_report": "WITH x AS (SELECT l_returnflag AS scope, l_discount * 2 AS f, l_quantity >= 3 AS g FROM lineitem) SELECT scope, count(*) AS images, count(*) FILTER (g) AS graded, count(*) FILTER (NOT g) AS ungraded, round(avg(round(f, 6)) FILTER (g), 6) AS mean_fraction, round(median(round(f, 6)) FILTER (g), 6) AS median_fraction FROM x GROUP BY 1 UNION ALL SELECT 'all', count(*), count(*) FILTER (g), count(*) FILTER (NOT g), round(avg(f) FILTER (g), 6), round(median(f) FILTER (g), 6) FROM x",
    "grade_counts": f"SELECT {_GRADE.format(f='l_discount * 2')} AS grade, count(*) AS n FROM lineitem GROUP BY 1",
    "object_aggregate": "SELECT o_orderkey, count(l_orderkey) AS objects_detected, CASE WHEN count(l_orderkey) = 0 THEN 'none' WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) ELSE 'mixed' END AS predicted_stage, round(coalesce(avg(l_discount), 0), 6) AS l_discount, coalesce(sum(l_quantity), 0) AS l_quantity, coalesce(string_agg(l_linestatus, ', ' ORDER BY l_linenumber, l_linestatus), '') AS detected, CASE WHEN count(l_orderkey) = 0 THEN 'no-supported-fruit' ELSE 'per-fruit' END AS mask_status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "measure_units": "SELECT p_partkey, round(p_size::DOUBLE, 6) AS area_px, round(2 * sqrt(p_size / pi()), 6) AS diameter_px, round(p_size / 6.25, 6) AS area, round(2 * sqrt(p_size / pi()) / 2.5, 6) AS diameter FROM part",
    "letterbox_sizes": "WITH i AS (SELECT DISTINCT width, height, 224.0::DOUBLE / greatest(width, height) AS s, least(1.0::DOUBLE, 200.0::DOUBLE / greatest(width, height)) AS k FROM audit_manifest WHERE width > 0 AND height > 0), b AS (SELECT *, greatest(1, round_even(width * s, 0))::INTEGER AS bw, greatest(1, round_even(height * s, 0))::INTEGER AS bh FROM i) SELECT width, height, bw AS box_width, bh AS box_height, floor((224 - bw) / 2)::INTEGER AS box_left, floor((224 - bh) / 2)::INTEGER AS box_top, greatest(1, round_even(width * k, 0))::INTEGER AS work_width, greatest(1, round_even(height * k, 0))::INTEGER AS work_height FROM b",
    "clamped_boxes": "SELECT event_id, greatest(0, least(299, floor(value - 100)))::BIGINT AS x1, greatest(0, least(224, floor(value - 60)))::BIGINT AS y1, greatest(1, least(300, ceil(value + 0.5)))::BIGINT AS x2, greatest(1, least(225, ceil(value + 20)))::BIGINT AS y2 FROM events",
    "mask_flags": "WITH r AS (SELECT DISTINCT result_id, lower(trim(method)) AS method, foreground_fraction AS f, score_ripe FROM result_rows WHERE foreground_fraction IS NOT NULL AND method IS NOT NULL) SELECT result_id, CASE WHEN method = 'baseline' THEN 'not_segmented' WHEN f = 0 THEN 'empty' WHEN f > 0.98 THEN 'near_full' ELSE 'nonempty' END AS mask_state, CASE WHEN f = 0 THEN 'no_foreground' WHEN score_ripe > 0.85 THEN 'broad_colour_candidates' ELSE 'inspect_mask' END AS review FROM r",
    "image_by_method": "SELECT method, fruit, count(*) AS n FROM (SELECT DISTINCT image_id, fruit FROM audit_manifest WHERE error = ''), (VALUES " + ", ".join(f"('{m}')" for m in METHODS) + ") m(method) GROUP BY ALL",
    "safe_cells": r"SELECT 'd' || doc_id AS id, CASE WHEN regexp_matches(text, '^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*[=+@-]') THEN '''' || text ELSE text END AS cell FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_acctbal < 0 THEN '''-' || c_name ELSE c_name END FROM customer",
    "display_values": r"WITH r AS (SELECT DISTINCT result_id, source, foreground_fraction AS f, CASE WHEN processing_ms >= 0 AND isfinite(processing_ms) AND processing_ms < 1e6 THEN processing_ms END AS p, predicted_stage FROM result_rows) SELECT result_id, coalesce(nullif(regexp_extract(source, '([^/\\]*)$', 1), ''), '-') AS source, coalesce(format('{:.2f}%', f * 100), '-') AS foreground_fraction, coalesce(format('{:.1f} ms', p), '-') AS processing_ms, coalesce(nullif(predicted_stage, ''), '-') AS predicted_stage FROM r",
    "run_labels": "WITH r AS (SELECT DISTINCT run, strftime(strptime(substr(regexp_extract(run, '([^/]*)$', 1), 1, 15), '%Y%m%dT%H%M%S'), '%d %b %Y, %H:%M:%S') || ' UTC' AS l FROM metric_rows) SELECT run, CASE WHEN (SELECT count(DISTINCT l) < count(l) FROM r) THEN l || ' [' || run || ']' ELSE l END AS label FROM r",
    "frame_times": "SELECT l_orderkey, l_linenumber, round((l_linenumber - 1) / CASE WHEN l_quantity >= 3 THEN l_quantity ELSE 25.0 END, 6) AS seconds FROM lineitem",
    "throttled_events": "WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), k AS (SELECT event_id, user_id, ts, r, ts AS last, true AS kept FROM o WHERE r = 1 UNION ALL SELECT o.event_id, o.user_id, o.ts, o.r, CASE WHEN o.ts - k.last >= INTERVAL 1 HOUR THEN o.ts ELSE k.last END, o.ts - k.last >= INTERVAL 1 HOUR FROM k JOIN o ON o.user_id = k.user_id AND o.r = k.r + 1) SELECT event_id FROM k WHERE kept",
    "pixel_otsu": f"WITH {_PIX}, hist AS (SELECT vec_id AS k, bin, count(*) AS n FROM pix GROUP BY 1, 2), {_OTSU}, g AS (SELECT vec_id, threshold, count(*) FILTER (bin > threshold) AS bright, count(*) FILTER (bin > threshold AND (x IN (0, 7) OR y IN (0, 7))) AS border_bright FROM pix JOIN o ON o.k = vec_id GROUP BY 1, 2), t AS (SELECT *, border_bright < 28 - border_bright OR (border_bright = 14 AND bright <= 64 - bright) AS take FROM g) SELECT vec_id, threshold, bright, border_bright, take AS takes_bright, CASE WHEN take THEN bright ELSE 64 - bright END / 64.0 AS foreground_fraction FROM t",
    "mask_agreement": f"WITH {_PIX}, m AS (SELECT vec_id, bin > 127 AS a, (x + y) % 2 = 0 AS b FROM pix) SELECT vec_id, round(avg(a::INT), 6) AS fraction_a, round(avg(b::INT), 6) AS fraction_b, round(avg((a AND b)::INT), 6) AS intersection, round(avg((a <> b)::INT), 6) AS disagreement, round(CASE WHEN count(*) FILTER (a OR b) = 0 THEN 1 ELSE count(*) FILTER (a AND b)::DOUBLE / count(*) FILTER (a OR b) END, 6) AS jaccard FROM m GROUP BY 1",
    "mask_boxes": f"WITH {_PIX} SELECT vec_id, count(*) AS area, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM pix WHERE bin > 127 GROUP BY 1",
    "centroid_assign": "WITH v AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), c AS (SELECT label AS l, i, avg(x) AS m FROM v GROUP BY 1, 2), d AS (SELECT vec_id, label, l, sum((m - x) * (m - x)) AS d FROM v JOIN c USING (i) GROUP BY 1, 2, 3) SELECT vec_id, label, arg_min(l, struct_pack(d := d, l := l)) AS assigned, round(min(d), 4) AS distance FROM d GROUP BY 1, 2",
    "largest_lines": "SELECT l_orderkey, arg_max(l_linenumber, struct_pack(q := l_quantity, n := -l_linenumber)) AS largest, max(l_quantity) AS area, count(*) AS objects FROM lineitem GROUP BY 1",
}
