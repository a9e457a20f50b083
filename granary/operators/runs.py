"""Run rules and pipelines: specs, validity, compatibility, reports, guarded batches, final evaluation
(D14, P19, P20, P26, F15, J6, J10, J11, S11, S12, B8, L5, L6, L10, L11, L12, L16, W11)."""

from __future__ import annotations

import copy
import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from granary.kernels import segment as G
from granary.operators.imaging import segment_methods
from granary.operators.metrics import metrics
from granary.operators.models import predict, train
from granary.operators.splits import holdout_guard, manifest_difference, require_split, stratified_split
from granary.schemas import METHODS, STAGES
from granary.session import cut
from granary.sources import storage

#: Display names of methods and classifiers.
LABELS = {"baseline": "RGB baseline", "hsv": "HSV", "otsu": "Otsu", "kmeans": "K-means", "grabcut": "GrabCut", "watershed": "Watershed", "hybrid": "Hybrid A", "hybrid_refined": "Hybrid B", "random_forest": "Random Forest", "shared_cnn": "Shared CNN"}
_SPECS = {"baseline": {}, "hsv": G.HSV, "otsu": {"border": 0.05}, "kmeans": {"clusters": 3, "grid": 64, "seed": 42}, "grabcut": G.GRABCUT, "watershed": G.WATERSHED, "hybrid": {"hsv": G.HSV, "grabcut": G.GRABCUT}, "hybrid_refined": G.REFINED}


def method_spec(method: str) -> dict:
    """Parameters of a method; a copy, so that callers can't change them."""
    if method not in _SPECS:
        raise ValueError(f"unknown method {method!r}")
    return {"method": method, "parameters": copy.deepcopy(_SPECS[method])}


def spec_digest(spec: dict) -> str:
    """SHA-256 of the canonical JSON."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def comparison_methods(hybrid: str) -> list[str]:
    """The five single methods and the chosen hybrid."""
    if hybrid not in ("hybrid", "hybrid_refined"):
        raise ValueError("choose a hybrid method")
    return ["hsv", "otsu", "kmeans", "grabcut", "watershed", hybrid]


def with_labels(rows: DataFrame, column: str, to: str) -> DataFrame:
    """P20: display name of a method or classifier id; unknown ids stay as they are."""
    table = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return rows.withColumn(to, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))


def invalid_runs(runs: DataFrame, feature_id: str, spec_column: str = "spec_sha256") -> DataFrame:
    """``runs`` with ``problem``, null for usable ones: first of unfinished, other features, other spec, other classes,
    no split id, no images. ``classes`` is the class order of the run; ``spec_sha256`` its method's digest."""
    specs = F.create_map(*[F.lit(x) for m in METHODS for x in (m, spec_digest(method_spec(m)))])
    problem = (
        F.when(~F.col("status").eqNullSafe("completed"), "not completed")
        .when(~F.col("feature_id").eqNullSafe(feature_id), "other features")
        .when(~F.col(spec_column).eqNullSafe(F.try_element_at(specs, F.col("method"))), "other method parameters")
        .when(~F.col("classes").eqNullSafe(F.array(*[F.lit(s) for s in STAGES])), "other class order")
        .when(F.coalesce(F.col("split_id"), F.lit("")) == "", "no split id")
        .when(F.coalesce(F.col("n_images"), F.lit(0)) <= 0, "no images")
    )
    return runs.withColumn("problem", problem)


def incompatible_runs(runs: DataFrame, reference: str, keys: tuple[str, ...] = ("evaluation_split", "backend", "split_id", "feature_id", "counts", "seed", "model_type"), versions: tuple[str, ...] = ("numpy", "Pillow", "scikit-learn")) -> DataFrame:
    """``(run, problem)`` of runs that may not be compared with run ``reference``.

    Keys compare with nulls equal; ``model_parameters`` compare without ``n_jobs``; of ``versions`` only those named count;
    runs of a shared network must have the same ``model_sha256``.
    """
    def text(c: str):
        if c == "model_parameters":
            return F.to_json(F.array_sort(F.map_entries(F.map_filter(c, lambda k, _: k != "n_jobs"))))
        if c == "versions":
            return F.to_json(F.array(*[F.coalesce(F.try_element_at("versions", F.lit(v)), F.lit("")) for v in versions]))
        if c == "counts":
            return F.to_json(F.array_sort(F.map_entries(c)))
        return F.col(c).cast("string")

    names = [*keys, "model_parameters", "versions", "model_sha256"]
    flat = runs.select("run", *[text(c).alias(c) for c in names])
    ref = flat.where(F.col("run") == reference).select(*[F.col(c).alias(f"__{c}") for c in names])
    differ = lambda c: ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    first = reduce(lambda acc, c: acc.when(differ(c), f"{c} differs"), [*keys[1:], "model_parameters", "versions"], F.when(differ(keys[0]), f"{keys[0]} differs"))
    first = first.when((F.col("backend") == "shared_cnn") & differ("model_sha256"), "model_sha256 differs")
    return flat.where(F.col("run") != reference).crossJoin(F.broadcast(ref)).select("run", first.alias("problem")).where("problem is not null")


def read_report(folder: str) -> dict:
    """Metrics of a finished report; their digest must be the one its metadata names, and all methods must be there."""
    meta = json.loads(storage.read_bytes(f"{folder}/metadata.json"))
    raw = storage.read_bytes(f"{folder}/metrics.json")
    if meta.get("status") != "completed":
        raise ValueError("the report is not completed")
    if hashlib.sha256(raw).hexdigest() != meta.get("metrics_sha256"):
        raise ValueError("metrics.json was changed")
    values = json.loads(raw)
    if set(values) != set(METHODS):
        raise ValueError("the report lacks methods")
    return values


_RECORDED = ("classes", "feature_id", "method", "spec_sha256")


def load_model(folder: str, metadata: dict, trusted: bool = False):
    """A saved pipeline, only if trusted, with the recorded class order and, where given, feature id; else an error."""
    from pyspark.ml import PipelineModel

    if not trusted:
        raise PermissionError("only trusted models are loaded")
    saved = json.loads(storage.read_bytes(f"{folder}/model.json"))
    for key in _RECORDED:
        if saved.get(key) != metadata.get(key):
            raise ValueError(f"{key} of model and run differ")
    if saved.get("spark") != metadata.get("spark", saved.get("spark")):
        raise ValueError("the model was saved by another version")
    return PipelineModel.load(f"{folder}/model")


def save_model(model, folder: str, metadata: dict) -> None:
    """K8: the pipeline, then the record that :func:`load_model` checks."""
    model.write().save(f"{folder}/model")
    storage.write_bytes(f"{folder}/model.json", json.dumps({k: metadata.get(k) for k in (*_RECORDED, "spark")}).encode())


#: Names the features that models of this engine are trained on.
FEATURE_ID = "rgb32-masked-v1"


def bundle_metadata(method: str, **more) -> dict:
    """What a saved model must agree with to be used: classes, features, method and the digest of its parameters."""
    return {"classes": list(STAGES), "feature_id": FEATURE_ID, "method": method, "spec_sha256": spec_digest(method_spec(method)), **more}


def check_bundle(metadata: dict, method: str) -> None:
    """An error names the first thing in which a model's record differs from ``method`` as it is now."""
    for key, value in bundle_metadata(method).items():
        if metadata.get(key) != value:
            raise ValueError(f"the model has another {key}")


def infer_images(rows: DataFrame, bundles: dict, keep: list[str] = ["path"], mode: str = "permissive") -> DataFrame:
    """Every image under every method of ``bundles``, ``{method: (model, metadata)}``: the mask's numbers and times,
    ``predicted_stage`` and scores; failed images are error rows without a prediction.

    Each bundle is checked first. An image is decoded once for all methods; each model scores the rows of its method, and
    those that share a model are scored together. ``prediction_ms`` is null, as scores aren't made image by image.
    """
    for method, (_, metadata) in bundles.items():
        check_bundle(metadata, method)
    seen = segment_methods(rows, tuple(bundles), keep, mode, features=True)
    parts = [seen.where("features is null").drop("features").withColumn("predicted_stage", F.lit(None).cast("string"))]
    models: dict[int, tuple] = {}
    for method, (model, _) in bundles.items():
        models.setdefault(id(model), (model, []))[1].append(method)
    if len(models) > 1:
        seen = cut(seen)
        parts = [seen.where("features is null").drop("features").withColumn("predicted_stage", F.lit(None).cast("string"))]
    for model, methods in models.values():
        parts.append(predict(model, seen.where(F.col("features").isNotNull() & F.col("method").isin(*methods)), "features").drop("features"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("prediction_ms", F.lit(None).cast("double"))


def predict_images(rows: DataFrame, model, metadata: dict, method: str, keep: list[str] = ["path"]) -> DataFrame:
    """Images under one saved model, which must be one of this method, feature and parameters; a bad image fails the job."""
    return infer_images(rows, {method: (model, metadata)}, keep, "failfast")


def train_baseline(rows: DataFrame, method: str, share: float = 0.2, seed: int = 42, **training) -> dict:
    """From labelled images to a checked model: ``{model, metadata, manifest, predictions, metrics}``.

    ``rows`` has ``path, content, source_split, fruit, stage, sha256``. Training images are split by fruit and stage (L1), test
    ones only listed; features are made once, a bad image fails the job; the model learns from ``train`` and is measured on
    ``validation``. ``training`` goes to :func:`models.train`.
    """
    split = stratified_split(rows, ["fruit", "stage"], "path", share, seed, eligible=F.col("source_split") == "train")
    manifest = cut(split.select("path", "source_split", "split", "fruit", "stage", "sha256"))
    usable = require_split(split.where("split <> 'test'"), {"split": ("train", "validation"), "source_split": ("train",)})
    made = cut(segment_methods(usable, (method,), ["path", "split", "fruit", "stage"], "failfast", features=True).select("path", "split", "fruit", "stage", "features"))
    model = train(made.where("split = 'train'"), "features", "stage", seed=seed, **training)
    found = cut(predict(model, made.where("split = 'validation'"), "features").drop("features").withColumn("method", F.lit(method)))
    counts = {r["split"]: r["n"] for r in manifest.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    record = bundle_metadata(method, counts=counts, seed=seed, model_type=training.get("kind", "random_forest"), status="completed")
    return {"model": model, "metadata": record, "manifest": manifest, "predictions": found, "metrics": metrics(found, "stage", "predicted_stage", ("method",), "fruit")}


def run_batch(inputs: DataFrame, reserved: DataFrame, methods: list[str], classify=None, bundles: dict | None = None) -> DataFrame:
    """Every allowed input under every method; blocked and unreadable inputs are error rows, the batch goes on.

    ``inputs`` has ``path, content``; content whose SHA-256 is in ``reserved.sha256`` is rejected before it is decoded, even
    under another name. With ``bundles`` (as for :func:`infer_images`) rows are classified; or ``classify`` maps the mask rows,
    with their ``content``, to prediction rows. ``position`` and ``total`` number the rows of all methods by path (W11).
    """
    hashed = inputs.select("path", "content", F.sha2("content", 256).alias("sha256"))
    guarded = cut(holdout_guard(hashed, reserved, "sha256"))
    allowed, keep = guarded.where("not blocked"), ["path", "sha256"]
    if bundles is not None:
        rows = infer_images(allowed, {m: bundles[m] for m in methods}, keep)
    elif classify is not None:
        rows = classify(segment_methods(allowed, tuple(methods), [*keep, "content"])).drop("content")
    else:
        rows = segment_methods(allowed, tuple(methods), keep)
    blocked = guarded.where("blocked").select(*keep, F.lit("reserved for testing").alias("error"), F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    out = rows.unionByName(blocked, allowMissingColumns=True).withColumn("status", F.when(F.col("error") == "", "ok").otherwise("error"))
    return running_positions(out, ["path", "method"])


def running_positions(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """``position`` of every row from 1 in the given order, and ``total``, without sorting all rows in one task.

    Rows are sorted over tasks by range and counted per task; a task's rows are numbered on from the counts before it.
    """
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    task = F.shiftright("__at", 33)
    counts = placed.groupBy(task.alias("__task")).agg(F.count(F.lit(1)).alias("__n"))
    # one row per task
    before = counts.select("__task", (F.sum("__n").over(Window.orderBy("__task")) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("total"))
    numbered = placed.withColumn("__task", task).join(F.broadcast(before), "__task")
    return numbered.withColumn("position", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__task", "__at", "__before")


def evaluate_final(spark: SparkSession, current: DataFrame, manifest: DataFrame, predict, methods: tuple[str, ...] = METHODS, frozen: bool = False, trusted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Predictions and metrics of all methods over the test rows, once the caller confirms that all is frozen and trusted.

    ``current`` and ``manifest`` are ``(path, split, source_split, fruit, stage, sha256)``; they must be equal before the
    predictions, and again once these have been made and stored. ``predict(rows, method)`` adds ``predicted_stage``.
    """
    if not (frozen and trusted):
        raise PermissionError("confirm that the model is frozen and trusted")

    def verify() -> None:
        if manifest_difference(current, manifest).limit(1).count():
            raise ValueError("data and manifest differ")

    verify()
    test = require_split(manifest.where("split = 'test'"), {"split": ("test",), "source_split": ("test",)})
    rows = reduce(DataFrame.unionByName, [predict(test, m).withColumn("method", F.lit(m)) for m in methods])
    rows = cut(rows.withColumn("correct", F.col("predicted_stage") == F.col("stage")))
    scores = cut(metrics(rows, "stage", "predicted_stage", ("method",), "fruit"))
    verify()
    return rows, scores


def unchanged_previews(previews: DataFrame, sources: DataFrame) -> DataFrame:
    """``previews`` whose source file still has the content they were made of: equal ``path`` and ``sha256``."""
    return previews.join(sources.where("sha256 is not null").select("path", "sha256").distinct(), ["path", "sha256"], "left_semi")


def detection_masks(detections: DataFrame, key: str, width: str = "width", height: str = "height") -> DataFrame:
    """``(key, object_no, mask)`` of supported detections: packed bits, row by row, of the polygon ``x, y`` pairs of
    ``polygon`` where it has three or more points, else of the box. ``detections`` comes from :func:`object_rows` with the
    image's size; corners are kept inside it."""
    import numpy as np
    import pandas as pd

    has = "polygon" in detections.columns
    source = detections.select(key, "object_no", "x1", "y1", "x2", "y2", F.col("polygon" if has else "x1").alias("polygon"), F.col(width).alias("__w"), F.col(height).alias("__h"))

    def run(batches):
        for pdf in batches:
            masks = []
            for r in pdf.itertuples(index=False):
                w, h = int(r[-2]), int(r[-1])
                y, x = np.mgrid[:h, :w]
                points = r.polygon if has and r.polygon is not None and len(r.polygon) >= 3 else None
                if points is None:
                    mask = (x >= int(np.floor(r.x1))) & (x < int(np.ceil(r.x2))) & (y >= int(np.floor(r.y1))) & (y < int(np.ceil(r.y2)))
                else:
                    mask = np.zeros((h, w), bool)
                    p = [(float(q[0]), float(q[1])) for q in points]
                    for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1]):
                        if ay != by:
                            mask ^= ((ay > y + 0.5) != (by > y + 0.5)) & (x + 0.5 < (bx - ax) * (y + 0.5 - ay) / (by - ay) + ax)
                masks.append(np.packbits(mask).tobytes())
            yield pd.DataFrame({key: pdf[key], "object_no": pdf["object_no"], "mask": masks})

    kind = source.schema[0].dataType.simpleString()
    return source.mapInPandas(run, f"`{key}` {kind}, object_no int, mask binary")


def object_rows(detections: DataFrame, key: str, confidence: float = 0.20, least_side: int = 4) -> DataFrame:
    """Supported detections ``(key, object_no, fruit, confidence, box)`` numbered in detector order.

    ``detections`` has ``key`` and ``found array<struct<fruit, confidence, x1, y1, x2, y2>>``; null lists and entries give none.
    """
    from granary.schemas import FRUITS

    ok = F.filter("found", lambda d: d.isNotNull() & d["fruit"].isin(*FRUITS) & (d["confidence"] >= confidence) & (d["x2"] - d["x1"] >= least_side) & (d["y2"] - d["y1"] >= least_side))
    return detections.select(key, F.posexplode(ok).alias("n", "d")).select(key, (F.col("n") + 1).alias("object_no"), "d.*")


def objects_json(objects: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The objects of each image as one compact JSON list in order of ``object_no``; an image's objects are few."""
    return objects.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct("object_no", *columns)))).alias("object_results_json"))
