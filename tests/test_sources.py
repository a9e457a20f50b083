import datetime as dt
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import imaging, models
from granary.operators.metrics import metrics
from granary.schemas import PREDICTIONS
from granary.sources import files, sinks
from tests.test_kernels import APPLE, png


@pytest.fixture(scope="module")
def dataset(tmp_path_factory):
    root = tmp_path_factory.mktemp("data") / "outer"
    colours = {"Unripe": (30, 210, 20), "Ripe": (240, 210, 30), "Overripe": (80, 40, 20)}
    for split in ("Train", "Test"):
        for stage, c in colours.items():
            folder = root / split / stage
            folder.mkdir(parents=True)
            for i in range(2):
                img = np.full((40, 40, 3), c, np.uint8)
                img[0, 0] = i
                (folder / f"apple_{stage.lower()}_{i}.png").write_bytes(png(img))
    (root / "notes.txt").write_text("x")
    return root


def test_scan(spark, dataset):
    assert files.dataset_root(str(dataset.parent)) == str(dataset)
    rows = files.scan_images(spark, str(dataset)).collect()
    assert len(rows) == 12 and all(r.label.error == "" for r in rows) and {r.path for r in rows} >= {"Train/Ripe/apple_ripe_0.png"}
    assert {r.label.source_split for r in rows} == {"train", "test"} and len({r.sha256 for r in rows}) == 6
    with pytest.raises(ValueError):
        files.dataset_root(str(dataset / "Train"))


def test_collect_inputs(spark, dataset):
    p = str(dataset / "Train" / "Ripe")
    found, warnings = files.collect_inputs(spark, [p, p + "/apple_ripe_0.png", str(dataset / "notes.txt"), "/none/x.png"])
    assert [r.ordinal for r in found.orderBy("ordinal").collect()] == [0, 1] and {r.warning for r in warnings.collect()} == {"unsupported", "missing"}


def test_zip_audit(spark, tmp_path):
    img = np.random.default_rng(4).integers(0, 256, (40, 40, 3)).astype(np.uint8)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("Train/Ripe/apple_ripe_1.png", png(img, 0))
        z.writestr("Test/Ripe/apple_ripe_2.png", png(img, 9))
        z.writestr("Train/Unripe/mango_unripe_1.jpg", "not an image")
        z.writestr("notes.txt", "x")
    scan = files.scan_zip(spark, str(tmp_path / "a.zip"))
    assert {(r.path, r.supported) for r in scan.select("path", "supported").collect()} == {("Train/Ripe/apple_ripe_1.png", True), ("Test/Ripe/apple_ripe_2.png", True), ("Train/Unripe/mango_unripe_1.jpg", True), ("notes.txt", False)}
    rows = {r.path: r for r in imaging.audit_images(scan.where("supported")).collect()}
    a, b, bad = rows["Train/Ripe/apple_ripe_1.png"], rows["Test/Ripe/apple_ripe_2.png"], rows["Train/Unripe/mango_unripe_1.jpg"]
    assert a.pixel_sha256 == b.pixel_sha256 and a.sha256 != b.sha256 and a.phash == b.phash and (a.width, a.height, a.error) == (40, 40, "")
    assert bad.error == "ValueError: not a picture" and bad.width is None and bad.phash is None
    with pytest.raises(Exception, match="not a picture"):
        imaging.audit_images(scan.where("supported"), mode="failfast").collect()


def test_surfaces_keep_going(spark):
    df = spark.createDataFrame([("bad", bytearray(b"x")), ("ok", bytearray(png(APPLE))), ("none", None)], "path string, content binary")
    rows = {r.path: r for r in imaging.surface_images(df, "otsu").collect()}
    assert rows["ok"].quality_grade == "Good" and rows["ok"].objects_detected == 1 and rows["bad"].error and rows["none"].error == "ValueError: no content"
    m = {r.path: r for r in imaging.segment_images(df, "hsv").collect()}
    assert m["ok"].mask_status == "nonempty" and len(m["ok"].mask) == 1250 and m["bad"].foreground_fraction is None


def test_runs_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", -5, "ü", None), ("b", 2, None, 1.5)], "path string, n int, fruit string, score_ripe double")
    sinks.export_csv(df, str(tmp_path / "out"), ("path", "n", "fruit", "score_ripe"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("*.csv"))
    assert "﻿path" in text and "'=1+1,-5,ü," in text
    with pytest.raises(FileExistsError):
        sinks.export_csv(df, str(tmp_path / "out"), ("path",))
    with pytest.raises(ValueError):
        sinks.export_csv(df, str(tmp_path / "in" / "x"), ("path",), [str(tmp_path / "in")])
    sinks.write_csv(df, str(tmp_path / "p"), PREDICTIONS)
    assert spark.read.csv(str(tmp_path / "p"), header=True).columns == list(PREDICTIONS)
    now = dt.datetime(2026, 8, 28, 8, 58, 10, 496281)
    folder = sinks.new_run_folder(str(tmp_path / "outputs"), "otsu", now)
    assert folder.endswith("/otsu/20260828T085810_496281Z")
    with pytest.raises(FileExistsError):
        sinks.new_run_folder(str(tmp_path / "outputs"), "otsu", now)
    sinks.write_run(folder, {"method": "otsu", "seed": 42, "counts": {"train": 3}}, {"predictions": df})
    bad = sinks.new_run_folder(str(tmp_path / "outputs"), "otsu", now + dt.timedelta(days=1))
    with pytest.raises(Exception):
        sinks.write_run(bad, {"method": "otsu"}, {"x": df.select(F.raise_error(F.lit("boom")))})
    torn = sinks.new_run_folder(str(tmp_path / "outputs"), "hsv", now)
    open(torn + "/metadata.json", "w").write("{")
    runs = {(r.folder, r.run): r for r in files.discover_runs(spark, str(tmp_path / "outputs")).collect()}
    assert runs["otsu", "20260828T085810_496281Z"].warning is None and runs["otsu", "20260828T085810_496281Z"].counts == {"train": 3}
    assert runs["otsu", bad.rsplit("/", 1)[1]].warning == "run is not completed" and runs["hsv", torn.rsplit("/", 1)[1]].warning == "unreadable metadata"
    with pytest.raises(ValueError):
        sinks.write_json(str(tmp_path / "x.json"), {"a": float("nan")})
    assert json.loads(open(folder + "/metadata.json").read())["status"] == "completed"


@pytest.mark.parametrize("kind", ["random_forest", "linear"])
def test_training(spark, kind):
    rng = np.random.default_rng(0)
    rows = [(i, s, [float(x) for x in rng.normal(3 * k, 1, 4)]) for k, s in enumerate(("unripe", "ripe", "overripe")) for i in range(30 if k else 60)]
    df = spark.createDataFrame(rows, "id int, stage string, f array<double>")
    model = models.train(df, "f", "stage", kind, trees=10)
    p = models.predict(model, df, "f").withColumn("m", F.lit("x"))
    r = metrics(p, "stage", "predicted_stage", ("m",)).first()
    assert r.n_images == 120 and r.macro_f1 > 0.9 and abs(sum(p.select("score_unripe", "score_ripe", "score_overripe").first()) - 1) < 1e-9


def test_nearest_centroid(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 5), (2, [2.0, 0.0], 5), (3, [1.0, 4.0], 7), (4, [1.0, 2.0], None), (5, None, 5)], "i int, v array<float>, l int")
    assert {(r.i, r.assigned, r.distance) for r in models.nearest_centroid(df, "i", "v", "l").collect()} == {(1, 5, 1.0), (2, 5, 1.0), (3, 7, 0.0), (4, 5, 4.0)}


def test_forest_query_trains_the_whole_forest(spark, tmp_path, monkeypatch):
    from granary.operators import models
    from granary.plans.pictures import forest_predictions

    rows = [(i, [float((i * 7) % 40), float(i % 5)], i % 3) for i in range(40)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    made, train = [], models.train
    monkeypatch.setattr(models, "train", lambda *a, **k: made.append(train(*a, **k)) or made[-1])
    # a fifth of each stage is held out and scored
    assert forest_predictions(spark, str(tmp_path)).count() == 9
    assert [(m.stages[-1].getNumTrees, m.stages[-1].getOrDefault("maxDepth")) for m in made] == [(300, 30)]


def test_picture_queries_use_the_default_method(spark, tmp_path, monkeypatch):
    import inspect

    from granary.operators import imaging
    from granary.plans import pictures

    spark.createDataFrame([(1, [float(i) for i in range(64)], 1)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    used = {}
    for name in ("surface_images", "overlay_images", "crop_objects"):
        def recorded(*a, name=name, real=getattr(imaging, name), **k):
            bound = inspect.signature(real).bind(*a, **k)
            bound.apply_defaults()
            used[name] = bound.arguments["method"]
            return real(*a, **k)

        monkeypatch.setattr(imaging, name, recorded)
    for query in (pictures.picture_surfaces, pictures.picture_overlays, pictures.picture_crops):
        assert query(spark, str(tmp_path)).count() == 1
    assert used == dict.fromkeys(("surface_images", "overlay_images", "crop_objects"), "hybrid_refined")


def test_checkpoint_by_mean_macro_f1_and_mean_losses(spark):
    from granary.operators.metrics import best_epoch, epoch_scores, mean_losses

    rows = [("r", e, m, t, p) for e, m, right in [(1, "hsv", 3), (1, "otsu", 0), (2, "hsv", 2), (2, "otsu", 3), (3, "hsv", 3), (3, "otsu", 2)] for i, t in enumerate(("unripe", "ripe", "overripe")) for p in [t if i < right else "unripe" if t != "unripe" else "ripe"]]
    scores = epoch_scores(spark.createDataFrame(rows, "run string, epoch int, method string, t string, p string"), "t", "p", ("run",), "epoch", "method")
    two = (2 / 3 + 1 + 0) / 3
    assert {r.epoch: round(r.score, 9) for r in scores.collect()} == {1: 0.5, 2: round((two + 1) / 2, 9), 3: round((two + 1) / 2, 9)}
    assert best_epoch(scores, ("run",), "epoch", "score").first().best_epoch == 2
    losses = spark.createDataFrame([(1, 2.0, 128), (1, 5.0, 64), (2, 1.0, 10)], "epoch int, loss double, n int")
    assert {r.epoch: r.train_loss for r in mean_losses(losses, ("epoch",), "loss", "n").collect()} == {1: 3.0, 2: 1.0}
    with pytest.raises(Exception, match="nonfinite"):
        mean_losses(spark.createDataFrame([(1, float("nan"), 1)], "epoch int, loss double, n int"), ("epoch",), "loss", "n").collect()


def test_pictures_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("a.png", bytearray(png(APPLE))), ("b.png", bytearray(b"x")), ("c.png", None)], "name string, content binary")
    sinks.write_pictures(df, str(tmp_path / "p"))
    assert (tmp_path / "p" / "a.png").read_bytes() == png(APPLE) and not (tmp_path / "p" / "c.png").exists()
    with pytest.raises(FileExistsError):
        sinks.write_pictures(df, str(tmp_path / "p"))
    for bad in (df.unionByName(df), df.withColumn("name", F.lit("x/y"))):
        with pytest.raises(ValueError):
            sinks.write_pictures(bad, str(tmp_path / "q"))


def test_storage(spark, tmp_path):
    from granary.sources import storage

    p = str(tmp_path / "f.txt")
    storage.write_bytes(p, b"one")
    storage.write_bytes(p, b"two")
    assert storage.read_bytes(p) == b"two" and storage.exists(p) and storage.inside(p, str(tmp_path)) and not storage.inside(str(tmp_path) + "x", str(tmp_path))
    with pytest.raises(FileExistsError):
        storage.write_bytes(p, b"three", overwrite=False)
    with pytest.raises(FileNotFoundError):
        storage.read_bytes(p + "x")
    storage.move(p, p + "2")
    with pytest.raises(FileExistsError):
        storage.move(p + "2", str(tmp_path))
    storage.remove(p + "2")
    assert not storage.exists(p + "2")
