"""Commands: ``python -m granary.cli COMMAND ...`` (C1-C3, C5-C8). Each makes a new run folder and prints where it is."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.operators import duplicates, imaging, neardup, runs as R
from granary.operators.metrics import compare, metrics
from granary.schemas import AUDIT, BLEMISH_REPORT, METHODS, NEAR_DUPLICATES
from granary.session import cut
from granary.sources import files, sinks


def _labelled(spark: SparkSession, data: str) -> DataFrame:
    """Images of a dataset folder with their labels and content."""
    rows = files.scan_images(spark, files.dataset_root(data), content=True)
    return rows.select("path", "bytes", "sha256", "content", "label.source_split", "label.fruit", "label.stage", "label.raw_stage", F.col("label.error").alias("label_error"))


def audit(spark: SparkSession, zip_path: str, out: str, distance: int = 4) -> str:
    """Every image of an archive decoded, hashed and labelled; duplicates and near duplicates reported."""
    scan = files.scan_zip(spark, zip_path).where("supported")
    labels = files.parse_labels(F.col("path"))
    seen = imaging.audit_images(scan.select("path", "content", "size" if "size" in scan.columns else F.length("content").alias("size"), F.col("error").alias("scan_error")), ["path", "size", "scan_error"])
    rows = seen.withColumn("l", labels).select("path", F.col("l.source_split").alias("source_split"), F.col("l.fruit").alias("fruit"), F.col("l.stage").alias("stage"), F.col("l.raw_stage").alias("raw_stage"), F.col("size").alias("bytes"), "width", "height", "mode", "format", "sha256", "pixel_sha256", F.col("phash").alias("code"), F.lpad(F.lower(F.hex("phash")), 16, "0").alias("phash"), F.concat_ws("; ", *[F.when(F.col(c) != "", F.col(c)) for c in ("scan_error", "l.error", "error")]).alias("error"))
    rows = cut(rows)
    good = rows.where("error = ''")
    near = neardup.near_duplicates(good, "path", "code", "pixel_sha256", "source_split", ["fruit", "stage"], distance)
    groups = {k: cut(duplicates.duplicate_groups(good, k, "source_split", ["fruit", "stage"], "path")) for k in ("sha256", "pixel_sha256")}
    folder = sinks.new_run_folder(out, "audit")
    sinks.write_csv(rows, f"{folder}/audit.csv", AUDIT)
    sinks.write_csv(near, f"{folder}/near_duplicates.csv", NEAR_DUPLICATES)
    for k, g in groups.items():
        g.write.json(f"{folder}/groups_{k}")
    counts = rows.agg(F.count_if(F.col("error") == "").alias("valid_images"), F.count_if(F.col("error") != "").alias("invalid_images")).first().asDict()
    sinks.write_json(f"{folder}/summary.json", counts | {f"{k}_groups": g.count() for k, g in groups.items()})
    return folder


def baseline(spark: SparkSession, data: str, out: str, method: str = "baseline", **training) -> str:
    """A forest trained on one method's images and measured on validation; the model is saved with its record."""
    run = R.train_baseline(_labelled(spark, data).where("label_error = ''"), method, **training)
    folder = sinks.new_run_folder(out, method)
    R.save_model(run["model"], folder, run["metadata"])
    scores = run["metrics"].where("scope = 'overall'").drop("method", "scope").first()
    sinks.write_json(f"{folder}/metrics.json", scores.asDict() if scores else {})
    sinks.write_run(folder, run["metadata"] | {"split_id": "by-md5-42", "backend": "random_forest"}, {"manifest": run["manifest"], "predictions": run["predictions"], "metrics": run["metrics"]})
    return folder


def experiment(spark: SparkSession, data: str, out: str, hybrid: str = "hybrid_refined", **training) -> str:
    """All methods of a comparison trained and measured on one split, and their difference from the baseline."""
    rows = cut(_labelled(spark, data).where("label_error = ''"))
    found = [R.train_baseline(rows, m, **training)["metrics"] for m in ("baseline", *R.comparison_methods(hybrid))]
    table = cut(found[0])
    for f in found[1:]:
        table = table.unionByName(f)
    folder = sinks.new_run_folder(out, "comparison")
    sinks.write_run(folder, {"method": "comparison", "hybrid": hybrid}, {"metrics": table, "differences": compare(table, "method", "baseline", "scope")})
    return folder


def blemish(spark: SparkSession, data: str, out: str, split: str = "test", method: str = "hybrid_refined") -> str:
    """The defect report of one source split."""
    rows = _labelled(spark, data).where("label_error = ''").withColumn("split", F.col("source_split"))
    folder = sinks.new_run_folder(out, "blemish")
    sinks.write_csv(imaging.blemish_report(rows, split, method), f"{folder}/blemish_report.csv", BLEMISH_REPORT)
    return folder


def final_test(spark: SparkSession, data: str, model_folder: str, out: str, confirm_frozen: bool = False, trusted_model: bool = False) -> str:
    """A saved model on all test images, each checked against the run's manifest before and after."""
    if not (confirm_frozen and trusted_model):
        raise PermissionError("confirm that the model is frozen and trusted")
    record = json.loads(sinks.storage.read_bytes(f"{model_folder}/model.json"))
    model = R.load_model(model_folder, record, trusted=True)
    columns = ["path", "split", "source_split", "fruit", "stage", "sha256"]
    saved = spark.read.parquet(f"{model_folder}/manifest").select(*columns)
    now = _labelled(spark, data).where("label_error = ''")
    current = now.join(saved.select("path", "split"), "path", "left").select(*columns)

    def predict(rows: DataFrame, method: str) -> DataFrame:
        return R.predict_images(rows.join(now.select("path", "content"), "path"), model, record, method, columns)

    rows, scores = R.evaluate_final(spark, current, saved, predict, (record["method"],), confirm_frozen, trusted_model)
    folder = sinks.new_run_folder(out, "final_test")
    sinks.write_run(folder, record | {"model": model_folder}, {"predictions": rows, "metrics": scores})
    return folder


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="granary", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        p = commands.add_parser(name)
        for flag, more in options:
            p.add_argument(flag, **more)

    text = lambda default=None: {"default": default, "required": default is None}
    forest = [("--trees", {"type": int, "default": 300}), ("--depth", {"type": int, "default": 30})]
    command("audit", ("--zip", text()), ("--out", text("outputs")), ("--distance", {"type": int, "default": 4}))
    command("baseline", ("--data", text()), ("--out", text("outputs")), ("--method", {"choices": METHODS, "default": "baseline"}), *forest)
    command("experiment", ("--data", text()), ("--out", text("outputs")), ("--hybrid", {"choices": ("hybrid", "hybrid_refined"), "default": "hybrid_refined"}), *forest)
    command("blemish", ("--data", text()), ("--out", text("outputs")), ("--split", text("test")), ("--method", {"choices": METHODS, "default": "hybrid_refined"}))
    command("final-test", ("--data", text()), ("--run", text()), ("--out", text("outputs")), ("--confirm-frozen", {"action": "store_true"}), ("--trusted-model", {"action": "store_true"}))
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"granary {a.command}").getOrCreate()
    if a.command == "audit":
        folder = audit(spark, a.zip, a.out, a.distance)
    elif a.command == "baseline":
        folder = baseline(spark, a.data, a.out, a.method, trees=a.trees, depth=a.depth)
    elif a.command == "experiment":
        folder = experiment(spark, a.data, a.out, a.hybrid, trees=a.trees, depth=a.depth)
    elif a.command == "blemish":
        folder = blemish(spark, a.data, a.out, a.split, a.method)
    else:
        folder = final_test(spark, a.data, a.run, a.out, a.confirm_frozen, a.trusted_model)
    print(folder)
    return 0


if __name__ == "__main__":
    sys.exit(main())
