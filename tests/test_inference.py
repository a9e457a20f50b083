import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.kernels import segment as G
from granary.operators import imaging, runs as R
from granary.schemas import BLEMISH_REPORT, STAGES
from tests.test_kernels import APPLE, ellipse, paint, png

COLOURS = {"unripe": (30, 210, 20), "ripe": (240, 210, 30), "overripe": (80, 40, 20)}
SCHEMA = "path string, content binary, source_split string, fruit string, stage string, sha256 string"


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for source, n in (("train", 6), ("test", 1)):
        for fruit in ("apple", "banana"):
            for stage, colour in COLOURS.items():
                for i in range(n):
                    img = np.full((40, 40, 3), 255, np.uint8)
                    img[8:32, 8:32] = colour
                    img[0, 0] = i
                    raw = png(img)
                    rows.append((f"{source}/{stage}/{fruit}_{stage}_{i}.png", bytearray(raw), source, fruit, stage, hashlib.sha256(raw).hexdigest()))
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def trained(labelled):
    return R.train_baseline(labelled, "hsv", trees=10, depth=5)


def test_training_from_split_to_metrics(trained):
    parts = {(r.split, r.n) for r in trained["manifest"].groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert parts == {("train", 30), ("validation", 6), ("test", 6)} and trained["metadata"]["counts"] == dict(parts)
    assert trained["predictions"].count() == 6 and {(r.scope, r.accuracy) for r in trained["metrics"].collect()} == {("overall", 1.0), ("apple", 1.0), ("banana", 1.0)}


def test_a_bad_image_fails_training(spark, labelled):
    broken = labelled.withColumn("content", F.when(F.col("path").contains("apple_ripe_3"), F.lit(b"broken")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="not a picture"):
        R.train_baseline(broken, "hsv", trees=2)


def test_inference_chain(spark, labelled, trained):
    bundle = (trained["model"], trained["metadata"])
    images = labelled.where("source_split = 'test'").select("path", "content", "stage").unionByName(spark.createDataFrame([("bad.png", bytearray(b"x"), "ripe")], "path string, content binary, stage string"))
    rows = {r.path: r for r in R.infer_images(images, {"hsv": bundle}, ["path", "stage"]).collect()}
    assert len(rows) == 7 and rows["bad.png"].predicted_stage is None and rows["bad.png"].error.startswith("ValueError") and rows["bad.png"].method == "hsv"
    good = [r for p, r in rows.items() if p != "bad.png"]
    assert all(r.predicted_stage == r.stage and abs(sum(r[f"score_{s}"] for s in STAGES) - 1) < 1e-6 and r.processing_ms >= 0 and r.feature_ms >= 0 and r.mask_status == "nonempty" for r in good)
    one = R.predict_images(images.where("path <> 'bad.png'"), *bundle, "hsv").collect()
    assert len(one) == 6
    for wrong in ({"method": "otsu"}, {"classes": ["ripe"]}, {"spec_sha256": None}, {"feature_id": "x"}):
        with pytest.raises(ValueError, match=next(iter(wrong))):
            R.predict_images(images, trained["model"], trained["metadata"] | wrong, "hsv")
    with pytest.raises(Exception, match="not a picture"):
        R.predict_images(images, *bundle, "hsv").collect()


def test_batch_classifies_with_content_and_numbers_rows(spark, labelled, trained):
    inputs = labelled.select("path", "content").where("path like '%banana%'")
    reserved = labelled.where("path = 'test/ripe/banana_ripe_0.png'").select("sha256")
    rows = R.run_batch(inputs, reserved, ["hsv"], bundles={"hsv": (trained["model"], trained["metadata"])}).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, 22)) and {r.total for r in rows} == {21} and [r.path for r in rows] == sorted(r.path for r in rows)
    # another file holds the reserved content too
    assert {r.path for r in rows if r.status == "error"} == {"test/ripe/banana_ripe_0.png", "train/ripe/banana_ripe_0.png"} and all(r.predicted_stage for r in rows if r.status == "ok")
    sizes = R.run_batch(inputs, reserved, ["hsv", "baseline"], classify=lambda m: m.withColumn("bytes", F.length("content"))).collect()
    assert len(sizes) == 42 and all(r.bytes > 50 for r in sizes if r.status == "ok") and "content" not in sizes[0].asDict()


def test_final_evaluation_checks_again_after_predicting(spark, tmp_path):
    m = spark.createDataFrame([("a", "test", "test", "apple", "ripe", "1")], "path string, split string, source_split string, fruit string, stage string, sha256 string")
    m.write.parquet(str(tmp_path / "now"))
    current, made = spark.read.parquet(str(tmp_path / "now")), []

    def predict(rows, method):
        if not made:  # the data changes while the first method predicts
            made.append(method)
            m.withColumn("sha256", F.lit("2")).write.mode("append").parquet(str(tmp_path / "now"))
            spark.catalog.refreshByPath(str(tmp_path / "now"))
        return rows.withColumn("predicted_stage", F.lit("ripe"))

    now = lambda: spark.read.parquet(str(tmp_path / "now"))
    with pytest.raises(ValueError, match="differ"):
        R.evaluate_final(spark, now(), m, predict, ("hsv",), True, True)
        R.evaluate_final(spark, now(), m, predict, ("hsv",), True, True)
    assert made


def test_methods_share_one_decoding(spark):
    df = spark.createDataFrame([("a", bytearray(png(APPLE))), ("b", None)], "path string, content binary")
    rows = {(r.path, r.method): r for r in imaging.segment_methods(df, ("hybrid", "hsv", "grabcut", "hybrid_refined")).collect()}
    assert len(rows) == 8 and all(rows["b", m].error for m in ("hybrid", "hsv"))
    for m in ("hybrid", "hsv", "grabcut", "hybrid_refined"):
        assert rows["a", m].foreground_pixels == int(G.segment(APPLE, m)["mask"].sum())
    assert rows["a", "hybrid_refined"].refined_review_flag == "inspect_mask" and rows["a", "hsv"].refined_review_flag == ""


def test_defect_report_of_a_split(spark):
    bruised = paint(120, 120, (180, 180, 180), (ellipse(120, 120, 15, 15, 105, 105), (205, 30, 25)), (ellipse(120, 120, 60, 55, 85, 80), (60, 35, 20)))
    rows = [(f"t/{i:02d}.png", "apple", "ripe", "train" if i < 14 else "test", bytearray(png(bruised if i % 7 == 0 else APPLE))) for i in range(16)]
    df = spark.createDataFrame(rows, "path string, fruit string, stage string, split string, content binary")
    report = imaging.blemish_report(df, "train", "hsv")
    got = report.collect()
    assert tuple(report.columns) == BLEMISH_REPORT and len(got) == 14 and {r.segmentation_method for r in got} == {"hsv"}
    assert {r.path for r in got if r.blemish_pixels > 0} == {"t/00.png", "t/07.png"} and all(r.blemish_fraction == round(r.blemish_fraction, 6) for r in got)
    shown = imaging.report_previews(report).collect()
    assert [r.place for r in shown] == list(range(1, 13)) and shown[0].preview == "001_00.png"
    with pytest.raises(Exception, match="not a picture"):
        imaging.blemish_report(df.withColumn("content", F.lit(b"x")), "train", "hsv").collect()


def test_detections_become_masks(spark):
    df = spark.createDataFrame([(1, 20, 10, [("apple", 0.9, 2.0, 1.0, 8.0, 6.0)])], "k int, width int, height int, found array<struct<fruit string, confidence double, x1 double, y1 double, x2 double, y2 double>>")
    boxes = R.object_rows(df, "k").join(df.select("k", "width", "height"), "k")
    (r,) = R.detection_masks(boxes, "k").collect()
    mask = np.unpackbits(np.frombuffer(bytes(r.mask), np.uint8))[:200].reshape(10, 20)
    assert mask.sum() == 30 and mask[1:6, 2:8].all()
    triangle = boxes.withColumn("polygon", F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (10, 0), (0, 10))]))
    (r,) = R.detection_masks(triangle, "k").collect()
    mask = np.unpackbits(np.frombuffer(bytes(r.mask), np.uint8))[:200].reshape(10, 20)
    assert mask[0, :9].all() and mask.sum() in range(45, 56) and not mask[:, 10:].any()


def test_previews_of_changed_sources_are_left_out(spark):
    p = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, sha256 string")
    s = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", None), ("a", "1")], "path string, sha256 string")
    assert [r.path for r in R.unchanged_previews(p, s).collect()] == ["a"]


def test_features_are_made_once(spark, tmp_path):
    df = spark.createDataFrame([("a", bytearray(png(APPLE))), ("b", bytearray(png(APPLE)))], "path string, content binary")
    spec, cache = R.spec_digest(R.method_spec("hsv")), str(tmp_path / "cache")
    for _ in range(2):
        rows = imaging.cached_features(df, cache, "hsv", spec).collect()
        assert [r.path for r in sorted(rows)] == ["a", "b"] and all(len(r.features) == 3072 for r in rows)
        assert spark.read.parquet(cache).count() == 1
    imaging.cached_features(df, cache, "otsu", R.spec_digest(R.method_spec("otsu"))).collect()
    assert spark.read.parquet(cache).count() == 2


def test_kernels_as_sql_functions(spark):
    imaging.register_functions(spark)
    spark.createDataFrame([(bytearray(png(APPLE)),), (bytearray(b"x"),), (None,)], "content binary").createOrReplaceTempView("files_for_sql")
    rows = spark.sql("select image_phash(content) p, image_pixel_sha256(content) s, size(image_features(content)) n, mask_fraction(content, 'hsv') f, quality_grade(mask_fraction(content, 'hsv') / 10) g from files_for_sql").collect()
    assert rows[0].n == 3072 and 0.3 < rows[0].f < 0.5 and rows[0].g == "Good" and len(rows[0].s) == 64 and rows[0].p is not None
    assert all(r.p is None and r.s is None and r.f is None and r.g == "Not graded" for r in rows[1:])


def test_channels_are_swapped():
    from granary.kernels.decode import swap_channels

    assert (swap_channels(APPLE)[..., 0] == APPLE[..., 2]).all()
    for bad in (APPLE[..., 0], APPLE.astype(float), APPLE[:0]):
        with pytest.raises(ValueError):
            swap_channels(bad)
