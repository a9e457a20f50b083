"""Queries of the picture kernels and classifiers over pictures drawn from the embeddings.

Each embedding becomes an 8 x 8 grid of levels shown as 40 x 40 coloured pixels on a plain margin, written as PNG, so every
operator runs on real files over the whole table. What is drawn is known, so SQL gives sizes, pixels and shapes; where it can't
(defects, enhancement, features), tests hold the kernels against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.kernels.decode import encode_png
from granary.operators import imaging, models
from granary.schemas import METHODS, STAGES
from granary.operators.splits import stratified_split
from granary.session import cut, shared_folder, table
from granary.streaming.throttle import throttle_stream


def draw(levels: np.ndarray) -> np.ndarray:
    """A 60 x 60 picture: light grey margin, 8 x 8 blocks from green to red by level."""
    v = np.asarray(levels, np.float64)
    span = v.max() - v.min()
    q = ((v - v.min()) / (span if span > 0 else 1) * 200).astype(np.uint8).reshape(8, 8).repeat(5, 0).repeat(5, 1)
    img = np.full((60, 60, 3), 225, np.uint8)
    img[10:50, 10:50] = np.stack([40 + q, 220 - q, np.full_like(q, 30)], -1)
    return img


def pictures(spark: SparkSession, sf: str) -> DataFrame:
    """``(vec_id, label, content)``: every embedding of 64 values as a PNG; others have null content."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "content": [encode_png(draw(x)) if x is not None and len(x) == 64 else None for x in pdf["embedding"]]})

    return e.mapInPandas(run, "vec_id bigint, label int, content binary")


def picture_masks(spark, sf):
    """Every picture under each of the eight methods."""
    found = imaging.segment_methods(pictures(spark, sf), METHODS, ["vec_id"])
    return found.select("vec_id", "method", F.round("foreground_fraction", 6).alias("foreground_fraction"), "mask_status", "foreground_pixels", "error")


def picture_surfaces(spark, sf):
    """Defects, objects, measures and grade of every picture."""
    return imaging.surface_images(pictures(spark, sf), keep=["vec_id"])


def picture_audit(spark, sf):
    """Sizes and pixel digest of every picture."""
    return imaging.audit_images(pictures(spark, sf), ["vec_id"]).select("vec_id", "width", "height", "mode", "format", "pixel_sha256", "error")


def picture_enhancement(spark, sf):
    """P6-P8, A26."""
    return imaging.enhance_images(pictures(spark, sf), ["vec_id"]).select("vec_id", F.sha2("content", 256).alias("picture_sha256"), "std_before", "std_after", "mean_change", "error")


def picture_overlays(spark, sf):
    """B6, B7, K6."""
    return imaging.overlay_images(pictures(spark, sf), keep=["vec_id"]).select("vec_id", F.sha2("overlay", 256).alias("overlay_sha256"), "blemish_pixels", "objects_detected", "error")


def picture_crops(spark, sf):
    """The objects found in every picture, their boxes, and the size of their crops."""
    c = imaging.crop_objects(pictures(spark, sf), ["vec_id"])
    size = imaging.audit_images(c.select("vec_id", "object_no", F.col("crop").alias("content")), ["vec_id", "object_no"]).select("vec_id", "object_no", F.col("width").alias("crop_width"), F.col("height").alias("crop_height"))
    return c.join(size, ["vec_id", "object_no"]).select("vec_id", "object_no", "area", "x", "y", "width", "height", "crop_width", "crop_height")


def picture_features(spark, sf):
    """Perceptual hash, and feature vectors as their length, sum and largest value."""
    p = pictures(spark, sf)
    f = imaging.image_features(p, "hsv", ["vec_id"]).join(imaging.audit_images(p, ["vec_id"]).select("vec_id", "phash"), "vec_id")
    return f.select("phash", "vec_id", F.size("features").alias("n"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 3).alias("total"), F.array_max("features").alias("largest"))


def _staged(spark, sf):
    e = table(spark, sf, "embeddings").where("embedding is not null and label is not null")
    return e.select("vec_id", "embedding", F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.pmod("label", F.lit(3)) + 1).alias("stage"))


def _halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    split = cut(stratified_split(_staged(spark, sf), ["stage"], "vec_id"))
    return split.where("split = 'train'"), split.where("split = 'validation'")


def forest_predictions(spark, sf):
    """L1, L3, L4: a balanced forest trained on four fifths of the embeddings and applied to the rest."""
    fit, held = _halves(spark, sf)
    return models.predict(models.train(fit, "embedding", "stage", "random_forest"), held, "embedding").select("vec_id", "stage", "predicted_stage", *[F.round(f"score_{c}", 6).alias(f"score_{c}") for c in STAGES])


def linear_predictions(spark, sf):
    """A balanced linear head trained on four fifths of the embeddings and applied to the rest."""
    fit, held = _halves(spark, sf)
    return models.predict(models.train(fit, "embedding", "stage", "linear"), held, "embedding").select("vec_id", "stage", "predicted_stage")


def streamed_throttle(spark, sf):
    """The throttle as a bounded stream over the events, kept events written as files and read back."""
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path).select("event_id", "user_id", "ts")
    out = shared_folder(spark, "throttle")
    q = throttle_stream(stream, "user_id", "ts", 3600.0, "event_id").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("event_id")


QUERIES = {f.__name__: f for f in (picture_masks, picture_surfaces, picture_audit, picture_enhancement, picture_overlays, picture_crops, picture_features, forest_predictions, linear_predictions, streamed_throttle)}
from granary.plans.measures import SQL as _M  # noqa: E402

_DRAWN = "v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id, [floor((x - list_min(v)) / CASE WHEN list_max(v) > list_min(v) THEN list_max(v) - list_min(v) ELSE 1 END * 200)::INTEGER for x in v] AS q FROM v WHERE len(v) = 64)"
_LINE = "repeat('e1e1e1', 10) || array_to_string([repeat(printf('%02x%02x1e', 40 + q[y * 8 + x + 1], 220 - q[y * 8 + x + 1]), 5) for x in range(8)], '') || repeat('e1e1e1', 10)"
#: Pixels of the square that each method finds; flooding gives its outermost ring to neither side.
_FOUND = ", ".join(f"('{m}', {3600 if m == 'baseline' else 1444 if m == 'watershed' else 1600})" for m in METHODS)
SQL = {
    "streamed_throttle": _M["throttled_events"],
    "picture_masks": f"SELECT vec_id, method, round(px / 3600.0, 6)::DOUBLE AS foreground_fraction, CASE method WHEN 'baseline' THEN 'not_segmented' ELSE 'nonempty' END AS mask_status, px::BIGINT AS foreground_pixels, '' AS error FROM embeddings, (VALUES {_FOUND}) m(method, px)",
    "picture_crops": "SELECT vec_id, 1::BIGINT AS object_no, (39 * 39)::BIGINT AS area, 10::BIGINT AS x, 10::BIGINT AS y, 40::BIGINT AS width, 40::BIGINT AS height, 40 AS crop_width, 40 AS crop_height FROM embeddings",
    "picture_audit": f"WITH {_DRAWN} SELECT vec_id, 60 AS width, 60 AS height, 'RGB' AS mode, 'PNG' AS format, sha256('60x60:'::BLOB || unhex(repeat('e1e1e1', 600) || array_to_string([repeat({_LINE}, 5) for y in range(8)], '') || repeat('e1e1e1', 600))) AS pixel_sha256, '' AS error FROM q",
}
