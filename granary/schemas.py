"""Table contracts and fixed vocabularies.

Writers select exactly these columns in this order and ignore extras; missing optional ones become null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Vocabularies that results must use.
FRUITS = ("apple", "banana", "mango", "orange", "tomato")
STAGES = ("unripe", "ripe", "overripe")
STAGE_ALIASES = {"overipe": "overripe"}
SPLITS = ("train", "test", "validation", "val")
METHODS = ("baseline", "hsv", "otsu", "kmeans", "grabcut", "watershed", "hybrid", "hybrid_refined")
EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp")

# Output contracts, columns in order.
AUDIT = ("path", "source_split", "fruit", "stage", "raw_stage", "bytes", "width", "height", "mode", "format", "sha256", "pixel_sha256", "phash", "error")
NEAR_DUPLICATES = ("path_a", "path_b", "distance", "cross_split", "conflicting_labels")
MANIFEST = ("path", "source_split", "split", "fruit", "stage", "raw_stage", "sha256")
PREDICTIONS = ("path", "fruit", "true_stage", "predicted_stage", "correct", "score_unripe", "score_ripe", "score_overripe")
BLEMISH_REPORT = ("path", "fruit", "stage", "split", "segmentation_method", "foreground_pixels", "blemish_pixels", "blemish_fraction", "quality_grade", "blemish_components", "stem_cavity_removed", "status")
PREDICTION_GRID = ("source", "method", "status", "predicted_stage", "objects_detected", "detected_fruits", "processing_ms", "prediction_ms", "error")
SURFACE_GRID = ("source", "segmentation_method", "status", "blemish_fraction", "blemish_status", "quality_grade", "objects_detected", "equivalent_diameter_px", "calibrated", "error")
VIDEO_GRID = ("frame_index", "timestamp_seconds", "predicted_stage", "score_unripe", "score_ripe", "score_overripe", "objects_detected", "detected_fruits", "processing_ms")
METRICS = ("method", "backend", "run", "split", "split_id", "scope", "n_images", "accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1")


def conform(df: DataFrame, contract: tuple[str, ...]) -> DataFrame:
    """``df`` cut to ``contract``: extras ignored, missing columns null, order fixed."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in contract])


def require_columns(df: DataFrame, contract: tuple[str, ...]) -> DataFrame:
    """``df`` itself if its columns are exactly those of ``contract`` as a set; else an error naming the difference."""
    have, want = set(df.columns), set(contract)
    if have != want:
        raise ValueError(f"missing columns {sorted(want - have)}, unexpected columns {sorted(have - want)}")
    return df
