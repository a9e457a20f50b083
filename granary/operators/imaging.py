"""Image operators over ``(path, content)`` rows: audit, masks, surfaces, features, inference (S5, P3-P6, M0-M7, B1-B7, B9,
L2, L10).

Kernels run batch-wise in ``mapInPandas``. ``mode="permissive"`` turns a bad image into a row with ``error`` and nulls,
``mode="failfast"`` fails the job. Results leave the worker in slices of bounded size, whatever the pictures' size.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from granary.kernels import decode as D
from granary.kernels import pixels as P
from granary.kernels import segment as G
from granary.schemas import BLEMISH_REPORT, conform
from granary.sources import storage


#: Bytes of results that a worker gathers before it hands them on.
_SLICE = 32 << 20


def _weight(value) -> int:
    """About how many bytes a result takes."""
    if isinstance(value, list):
        return 8 * len(value) if not value or not isinstance(value[0], dict) else sum(_weight(x) for d in value for x in d.values())
    return len(value) if isinstance(value, bytes | str) else 8


def _run(rows: DataFrame, schema: str, one: Callable, mode: str, keep: list[str]) -> DataFrame:
    if mode not in ("permissive", "failfast"):
        raise ValueError("mode is permissive or failfast")
    source = rows.select(*[k for k in keep if k != "content"], "content")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep)
    names = [x.split()[0] for x in re.split(r", (?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, first, size = [], 0, 0
            for i, content in enumerate(pdf["content"]):
                row: dict = dict.fromkeys(names)
                try:
                    if content is None:
                        raise ValueError("no content")
                    row |= one(bytes(content))
                    row["error"] = ""
                except Exception as e:
                    if mode == "failfast":
                        raise
                    row["error"] = f"{type(e).__name__}: {e}"
                out.append(row)
                size += sum(_weight(v) for v in row.values()) + len(content or b"") * ("content" in keep)
                if size > _SLICE:
                    yield _slice(pdf, first, i + 1, out)
                    out, first, size = [], i + 1, 0
            yield _slice(pdf, first, len(pdf), out)

    def _slice(pdf: pd.DataFrame, first: int, end: int, out: list[dict]) -> pd.DataFrame:
        result = pd.DataFrame(out, columns=[*names, "error"]).astype(object)
        result = result.where(result.notna(), None)
        return pd.concat([pdf[keep].iloc[first:end].reset_index(drop=True), result], axis=1)

    return source.mapInPandas(run, f"{kept}, {schema}, error string")


def audit_images(rows: DataFrame, keep: list[str] = ["path"], mode: str = "permissive") -> DataFrame:
    """``width, height, mode, format, sha256, pixel_sha256, phash, error``; phash is signed 64 bits. Files that can't be
    decoded keep the digest of their bytes."""
    def one(content: bytes) -> dict:
        rgb, kind, fmt = D.decode(content)
        h, w = rgb.shape[:2]
        p = P.perceptual_hash(rgb)
        return {"width": w, "height": h, "mode": kind, "format": fmt, "pixel_sha256": hashlib.sha256(f"{w}x{h}:".encode() + rgb.tobytes()).hexdigest(), "phash": p - (1 << 64) if p >> 63 else p}

    hashed = rows.select(*keep, "content", F.sha2("content", 256).alias("__sha256"))
    out = _run(hashed, "width int, height int, mode string, format string, pixel_sha256 string, phash bigint", one, mode, [*keep, "__sha256"])
    return out.select(*keep, "width", "height", "mode", "format", F.col("__sha256").alias("sha256"), "pixel_sha256", "phash", "error")


def segment_images(rows: DataFrame, method: str, keep: list[str] = ["path"], mode: str = "permissive") -> DataFrame:
    """M0-M7: ``foreground_fraction, mask_status, foreground_pixels, processing_ms`` and the packed mask bits."""
    def one(content: bytes) -> dict:
        import numpy as np

        began = time.perf_counter()
        s = G.segment(D.decode(content)[0], method)
        return {"foreground_fraction": s["foreground_fraction"], "mask_status": s["mask_status"], "foreground_pixels": int(s["mask"].sum()), "mask": np.packbits(s["mask"]).tobytes(), "processing_ms": (time.perf_counter() - began) * 1000}

    return _run(rows, "foreground_fraction double, mask_status string, foreground_pixels bigint, mask binary, processing_ms double", one, mode, keep)


def segment_methods(rows: DataFrame, methods: tuple[str, ...], keep: list[str] = ["path"], mode: str = "permissive", features: bool = False) -> DataFrame:
    """Every image under every one of ``methods``: ``method, foreground_fraction, mask_status, foreground_pixels,
    refined_review_flag, processing_ms`` and, if asked, ``features`` of the masked image with ``feature_ms``.

    An image is decoded once, and hybrids take over the masks of their parts. A bad image is one error row per method.
    """
    def one(content: bytes) -> dict:
        rgb, known = D.decode(content)[0], {}
        out = []
        for m in sorted(methods, key=lambda m: m.startswith("hybrid")):
            began = time.perf_counter()
            s = known[m] = G.segment(rgb, m, known)
            row = {"method": m, "foreground_fraction": s["foreground_fraction"], "mask_status": s["mask_status"], "foreground_pixels": int(s["mask"].sum()), "refined_review_flag": s["detail"].get("refined_review_flag", ""), "processing_ms": (time.perf_counter() - began) * 1000}
            if features:
                began = time.perf_counter()
                row["features"] = P.features(rgb * s["mask"][..., None]).tolist()
                row["feature_ms"] = (time.perf_counter() - began) * 1000
            out.append(row)
        return {"found": out}

    fields = "method:string,foreground_fraction:double,mask_status:string,foreground_pixels:bigint,refined_review_flag:string,processing_ms:double" + (",features:array<float>,feature_ms:double" if features else "")
    packed = _run(rows, f"found array<struct<{fields}>>", one, mode, keep)
    names = [x.split(":")[0] for x in re.split(r",(?![^<]*>)", fields)]
    blank = F.array(*[F.struct(*[(F.lit(m) if n == "method" else F.lit(None)).alias(n) for n in names]) for m in methods])
    each = packed.select(*keep, "error", F.explode(F.coalesce("found", blank)).alias("f"))
    return each.select(*keep, "f.*", "error")


def blemish_images(rows: DataFrame, method: str = "hybrid_refined", keep: list[str] = ["path"], mode: str = "permissive") -> DataFrame:
    """B2: defects of the picture as it is, not denoised, inside its mask."""
    def one(content: bytes) -> dict:
        rgb = D.decode(content)[0]
        b = G.blemishes(rgb, G.segment(rgb, method)["mask"])
        return {"foreground_pixels": b["foreground_pixels"], "blemish_pixels": b["blemish_pixels"], "blemish_fraction": b["blemish_fraction"], "quality_grade": G.grade(b["blemish_fraction"], b["status"]), "blemish_components": len(b["components"]), "stem_cavity_removed": b["removed_stem"], "status": b["status"]}

    return _run(rows, "foreground_pixels bigint, blemish_pixels bigint, blemish_fraction double, quality_grade string, blemish_components bigint, stem_cavity_removed bigint, status string", one, mode, keep)


def blemish_report(rows: DataFrame, split: str | None = None, method: str = "hybrid_refined") -> DataFrame:
    """The defect report of one split (all without): the twelve columns of ``schemas.BLEMISH_REPORT``.

    ``rows`` has ``path, fruit, stage, split, content``. Fractions are rounded to six places (P30). One bad image fails the
    report.
    """
    chosen = rows if split is None else rows.where(F.col("split") == split)
    found = blemish_images(chosen, method, ["path", "fruit", "stage", "split"], "failfast").withColumn("segmentation_method", F.lit(method))
    return conform(found.withColumn("blemish_fraction", F.round("blemish_fraction", 6)), BLEMISH_REPORT)


def report_previews(report: DataFrame, most: int = 12) -> DataFrame:
    """The first ``most`` images of a report by path, with the place that numbers their previews."""
    place = F.row_number().over(Window.orderBy("path"))
    return report.orderBy("path").limit(most).withColumn("place", place).withColumn("preview", F.concat(F.lpad(F.col("place").cast("string"), 3, "0"), F.lit("_"), F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1), F.lit(".png")))


def surface_images(rows: DataFrame, method: str = "hybrid_refined", keep: list[str] = ["path"], mode: str = "permissive") -> DataFrame:
    """Surface row of every image; an empty or small foreground is ungraded with a null fraction."""
    schema = "foreground_pixels bigint, blemish_pixels bigint, blemish_fraction double, blemish_status string, blemish_components bigint, stem_cavity_removed bigint, quality_grade string, mask_status string, objects_detected bigint, largest_area_px bigint, equivalent_diameter_px double, perimeter_px double"
    return _run(rows, schema, lambda content: G.surface(D.decode(content)[0], method), mode, keep)


def image_features(rows: DataFrame, method: str = "baseline", keep: list[str] = ["path"], mode: str = "failfast") -> DataFrame:
    """3072 features of the masked image; by default one bad image fails the job, none is skipped."""
    def one(content: bytes) -> dict:
        rgb = D.decode(content)[0]
        mask = G.segment(rgb, method)["mask"]
        return {"features": P.features(rgb * mask[..., None]).tolist()}

    return _run(rows, "features array<float>", one, mode, keep)


def enhance_images(rows: DataFrame, keep: list[str] = ["path"], mode: str = "permissive") -> DataFrame:
    """The denoised and stretched picture as PNG, its spread before and after and the mean change."""
    def one(content: bytes) -> dict:
        e = P.enhance(D.decode(content)[0])
        return {"content": D.encode_png(e["image"]), "std_before": e["std_before"], "std_after": e["std_after"], "mean_change": e["mean_change"]}

    return _run(rows, "content binary, std_before double, std_after double, mean_change double", one, mode, keep)


def network_inputs(rows: DataFrame, method: str = "baseline", keep: list[str] = ["path"], mode: str = "failfast") -> DataFrame:
    """P5: letterboxed, normalised input of the masked picture, 150,528 floats."""
    def one(content: bytes) -> dict:
        rgb = D.decode(content)[0]
        return {"tensor": P.network_input(rgb * G.segment(rgb, method)["mask"][..., None]).ravel().tolist()}

    return _run(rows, "tensor array<float>", one, mode, keep)


def overlay_images(rows: DataFrame, method: str = "hybrid_refined", keep: list[str] = ["path"], mode: str = "permissive") -> DataFrame:
    """The picture as PNG with defects in red and object boxes in green, and the counts."""
    def one(content: bytes) -> dict:
        rgb = D.decode(content)[0]
        calm = P.median3(rgb)
        mask = G.segment(calm, method)["mask"]
        b, found = G.blemishes(calm, mask), P.objects(mask)
        out = rgb.copy()
        out[b["mask"]] = (255, 0, 0)
        for o in found:
            x, y, w, h = o["bbox"]
            out[[y, y + h - 1], x : x + w] = (0, 255, 0)
            out[y : y + h, [x, x + w - 1]] = (0, 255, 0)
        return {"overlay": D.encode_png(out), "blemish_pixels": b["blemish_pixels"], "blemish_fraction": b["blemish_fraction"], "objects_detected": len(found)}

    return _run(rows, "overlay binary, blemish_pixels bigint, blemish_fraction double, objects_detected bigint", one, mode, keep)


def crop_objects(rows: DataFrame, keep: list[str] = ["path"], mode: str = "permissive", method: str = "hybrid_refined") -> DataFrame:
    """One row per detected object, by area: number, box and its crop with all outside the mask black."""
    def one(content: bytes) -> dict:
        rgb = D.decode(content)[0]
        mask = G.segment(rgb, method)["mask"]
        shown = rgb * mask[..., None].astype(rgb.dtype)
        out = []
        for i, o in enumerate(P.objects(mask), 1):
            x, y, w, h = o["bbox"]
            out.append({"object_no": i, "area": o["area"], "x": x, "y": y, "width": w, "height": h, "crop": D.encode_png(shown[y : y + h, x : x + w])})
        return {"objects": out}

    packed = _run(rows, "objects array<struct<object_no:bigint;area:bigint;x:bigint;y:bigint;width:bigint;height:bigint;crop:binary>>".replace(";", ","), one, mode, keep)
    return packed.select(*keep, "error", F.explode_outer("objects").alias("o")).select(*keep, "error", "o.*")


def cached_features(rows: DataFrame, cache: str, method: str, spec_sha256: str, keep: list[str] = ["path"]) -> DataFrame:
    """Features of the masked images, read from the Parquet folder ``cache`` where content, method and parameters are the
    same, and made and added to it where they aren't. ``rows`` has ``content``; equal content is made once."""
    spark = rows.sparkSession
    keyed = rows.select(*keep, "content", F.sha2("content", 256).alias("sha256"))
    schema = "sha256 string, method string, spec_sha256 string, features array<float>"
    known = spark.read.schema(schema).parquet(cache) if storage.exists(cache) else spark.createDataFrame([], schema)
    mine = (F.col("method") == method) & (F.col("spec_sha256") == spec_sha256)
    new = keyed.select("sha256", "content").dropDuplicates(["sha256"]).join(known.where(mine).select("sha256"), "sha256", "left_anti")
    made = image_features(new, method, ["sha256"]).drop("error").withColumn("method", F.lit(method)).withColumn("spec_sha256", F.lit(spec_sha256))
    made.select("sha256", "method", "spec_sha256", "features").write.mode("append").parquet(cache)
    return keyed.drop("content").join(spark.read.schema(schema).parquet(cache).where(mine).select("sha256", "features"), "sha256").select(*keep, "sha256", "features")


def register_functions(spark) -> None:
    """The kernels as SQL functions over ``content``: ``image_phash``, ``image_pixel_sha256``, ``image_features``,
    ``mask_fraction(content, method)`` and ``quality_grade(fraction)``. Arrow batches, null for what can't be decoded."""
    def attempt(one, *columns):
        def safe(*values):
            try:
                return None if values[0] is None else one(*values)
            except ValueError:
                return None

        return pd.Series([safe(*v) for v in zip(*columns)], dtype=object)

    def phash(rgb) -> int:
        p = P.perceptual_hash(rgb)
        return p - (1 << 64) if p >> 63 else p

    def digest(rgb) -> str:
        return hashlib.sha256(f"{rgb.shape[1]}x{rgb.shape[0]}:".encode() + rgb.tobytes()).hexdigest()

    def over(kind: str, one):
        @F.pandas_udf(kind)
        def run(content: pd.Series) -> pd.Series:
            return attempt(lambda c: one(D.decode(bytes(c))[0]), content)

        return run

    @F.pandas_udf("double")
    def fraction(content: pd.Series, method: pd.Series) -> pd.Series:
        return attempt(lambda c, m: G.segment(D.decode(bytes(c))[0], m)["foreground_fraction"], content, method)

    @F.pandas_udf("string")
    def grade(value: pd.Series) -> pd.Series:
        return pd.Series([G.grade(None if pd.isna(v) else float(v)) for v in value], dtype=object)

    for name, f in (("image_phash", over("bigint", phash)), ("image_pixel_sha256", over("string", digest)), ("image_features", over("array<float>", lambda rgb: P.features(rgb).tolist())), ("mask_fraction", fraction), ("quality_grade", grade)):
        spark.udf.register(name, f)
