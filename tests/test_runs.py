import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import models, runs as R
from granary.schemas import METHODS, STAGES
from tests.test_kernels import APPLE, png


def test_specs():
    s = R.method_spec("hsv")
    s["parameters"]["saturation"] = 9
    assert R.method_spec("hsv")["parameters"]["saturation"] == 0.2 and len({R.spec_digest(R.method_spec(m)) for m in METHODS}) == 8
    assert R.comparison_methods("hybrid")[-1] == "hybrid"
    for bad in (lambda: R.method_spec("x"), lambda: R.comparison_methods("hsv")):
        with pytest.raises(ValueError):
            bad()


def test_labels(spark):
    df = spark.createDataFrame([("kmeans",), ("other",), (None,)], "m string")
    assert [r.l for r in R.with_labels(df, "m", "l").collect()] == ["K-means", "other", None]


def test_validity(spark):
    good = ("otsu", "completed", "f", R.spec_digest(R.method_spec("otsu")), list(STAGES), "id", 5)
    bad = [good, ("otsu", "failed", *good[2:]), (*good[:2], "g", *good[3:]), (*good[:3], None, *good[4:]), (*good[:4], ["ripe"], *good[5:]), (*good[:5], "", 5), (*good[:6], 0)]
    df = spark.createDataFrame([(i, *b) for i, b in enumerate(bad)], "i int, method string, status string, feature_id string, spec_sha256 string, classes array<string>, split_id string, n_images int")
    assert [r.problem for r in R.invalid_runs(df, "f").orderBy("i").collect()] == [None, "not completed", "other features", "other method parameters", "other class order", "no split id", "no images"]


def test_compatibility(spark):
    base = dict(evaluation_split="validation", backend="random_forest", split_id="s", feature_id="f", counts={"a": 1, "b": 2}, seed=42, model_type="rf", model_parameters={"trees": "300", "n_jobs": "1"}, versions={"numpy": "2", "x": "1"}, model_sha256="h")
    rows = [("a", base), ("same", base | {"counts": {"b": 2, "a": 1}, "model_parameters": {"n_jobs": "9", "trees": "300"}, "versions": {"numpy": "2"}, "model_sha256": "other"}), ("seed", base | {"seed": None}), ("trees", base | {"model_parameters": {"trees": "1"}}), ("numpy", base | {"versions": {}}), ("split", base | {"evaluation_split": "test"})]
    schema = "run string, evaluation_split string, backend string, split_id string, feature_id string, counts map<string,int>, seed int, model_type string, model_parameters map<string,string>, versions map<string,string>, model_sha256 string"
    df = spark.createDataFrame([(n, *b.values()) for n, b in rows], schema)
    assert {(r.run, r.problem) for r in R.incompatible_runs(df, "a").collect()} == {("seed", "seed differs"), ("trees", "model_parameters differs"), ("numpy", "versions differs"), ("split", "evaluation_split differs")}


def test_reports(tmp_path):
    raw = json.dumps({m: {} for m in METHODS}).encode()
    (tmp_path / "metrics.json").write_bytes(raw)
    meta = {"status": "completed", "metrics_sha256": hashlib.sha256(raw).hexdigest()}
    (tmp_path / "metadata.json").write_text(json.dumps(meta))
    assert set(R.read_report(str(tmp_path))) == set(METHODS)
    (tmp_path / "metrics.json").write_bytes(raw + b" ")
    with pytest.raises(ValueError, match="changed"):
        R.read_report(str(tmp_path))


def test_models_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(s, [float(x) for x in rng.normal(4 * k, 1, 3)]) for k, s in enumerate(STAGES) for _ in range(15)], "stage string, f array<double>")
    model, meta = models.train(df, "f", "stage", "linear"), {"classes": list(STAGES), "feature_id": "x", "method": "hsv"}
    R.save_model(model, str(tmp_path), meta)
    with pytest.raises(PermissionError):
        R.load_model(str(tmp_path), meta)
    with pytest.raises(ValueError):
        R.load_model(str(tmp_path), meta | {"feature_id": "y"}, True)
    a, b = (models.predict(m, df, "f").select("predicted_stage").collect() for m in (model, R.load_model(str(tmp_path), meta, True)))
    assert a == b


def test_batch_blocks_reserved_content_and_goes_on(spark):
    img = png(APPLE)
    other = APPLE.copy()
    other[0, 0] = 0
    df = spark.createDataFrame([("renamed.png", bytearray(img)), ("free.png", bytearray(png(other))), ("broken.png", bytearray(b"x"))], "path string, content binary")
    reserved = spark.createDataFrame([(hashlib.sha256(img).hexdigest(),), (None,)], "sha256 string")
    rows = R.run_batch(df, reserved, ["hsv", "otsu"]).collect()
    assert len(rows) == 6 and {(r.path, r.status) for r in rows} == {("renamed.png", "error"), ("free.png", "ok"), ("broken.png", "error")}
    assert {r.error for r in rows if r.path == "renamed.png"} == {"reserved for testing"}


def test_final_evaluation(spark):
    m = spark.createDataFrame([("a", "test", "test", "apple", "ripe", "1"), ("b", "train", "train", "apple", "ripe", "2")], "path string, split string, source_split string, fruit string, stage string, sha256 string")
    predict = lambda rows, method: rows.withColumn("predicted_stage", F.lit("ripe"))
    with pytest.raises(PermissionError):
        R.evaluate_final(spark, m, m, predict)
    rows, scores = R.evaluate_final(spark, m, m, predict, frozen=True, trusted=True)
    assert rows.count() == 8 and {(r.scope, r.accuracy) for r in scores.collect()} == {("overall", 1.0), ("apple", 1.0)}
    with pytest.raises(ValueError, match="differ"):
        R.evaluate_final(spark, m.withColumn("sha256", F.lit("9")), m, predict, frozen=True, trusted=True)


def test_objects(spark):
    df = spark.createDataFrame([(1, [("apple", 0.91, 5, 5, 25, 25), ("pear", 0.9, 0, 0, 9, 9), ("banana", 0.1, 0, 0, 9, 9), ("banana", 0.5, 0, 0, 3, 9), ("banana", 0.82, 35, 10, 65, 30), None]), (2, None)], "k int, found array<struct<fruit string, confidence double, x1 int, y1 int, x2 int, y2 int>>")
    rows = R.object_rows(df, "k")
    assert [(r.k, r.object_no, r.fruit) for r in rows.orderBy("object_no").collect()] == [(1, 1, "apple"), (1, 2, "banana")]
    assert R.objects_json(rows, "k", ["fruit"]).first().object_results_json == '[{"object_no":1,"fruit":"apple"},{"object_no":2,"fruit":"banana"}]'


def test_grids_against_sql(spark, tmp_path):
    """NaN timings are kept, as the SQL keeps them, and frames without a time come last."""
    import duckdb

    from granary.plans import rules
    from granary.schemas import PREDICTION_GRID, VIDEO_GRID

    nan = float("nan")
    times = [(3, "2026-01-02 00:00:00", nan), (1, None, 5.0), (2, "2026-01-01 00:00:00", None), (None, "2026-01-02 00:00:00", 7.0), (3, "2026-01-02 00:00:00", nan)]
    kinds = {"objects_detected": "int", "processing_ms": "double", "prediction_ms": "double", "score_unripe": "double", "score_ripe": "double", "score_overripe": "double"}
    rest = [c for c in dict.fromkeys((*PREDICTION_GRID, *VIDEO_GRID[2:])) if c not in ("source", "processing_ms", "prediction_ms")]
    rows = spark.createDataFrame(times, "result_id bigint, created_at string, processing_ms double").withColumn("created_at", F.to_timestamp("created_at"))
    rows = rows.select("*", F.col("processing_ms").alias("prediction_ms"), F.lit("camera:0").alias("source"), *[F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in rest])
    rows.write.parquet(str(tmp_path / "result_rows.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW result_rows AS SELECT * FROM '{tmp_path}/result_rows.parquet/*.parquet'")
    for name in ("prediction_grid", "video_grid"):
        got = [tuple(r) for r in rules.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, db.execute(rules.SQL[name]).fetchall()))  # repr: NaN is unequal to itself
        assert sum(repr(r).count("nan") for r in got) == (2 if name == "prediction_grid" else 1)
