"""Scalar semantics as Columns (P1, P5, P10-P13, P15, P17, P22, P24, P25, P29, K4, K13, F1): no Python in the data path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from granary.schemas import EXTENSIONS, FRUITS, SPLITS, STAGE_ALIASES, STAGES


def has_image_extension(path: Column) -> Column:
    """the suffix, in lower case, is that of a supported image."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*EXTENSIONS)


def stage_of(word: Column) -> Column:
    """Stage that a word names, aliases resolved; null for any other word."""
    aliased = reduce(lambda acc, kv: F.when(word == kv[0], kv[1]).otherwise(acc), STAGE_ALIASES.items(), word)
    return F.when(aliased.isin(*STAGES), aliased)


def parse_labels(path: Column) -> Column:
    """Struct of source_split, fruit, stage, raw_stage and error from the last three parts of a path.

    Parts are lower-cased; the file's first two words, split on ``_``, are the fruit and a word for the folder's stage. The
    first failing rule gives ``error`` (else an empty string): path, split, fruit or stage, file name. Null paths give null.
    """
    parts = F.split(F.lower(path), "/")
    n = F.size(parts)
    split, folder = F.try_element_at(parts, F.lit(-3)), F.try_element_at(parts, F.lit(-2))
    tokens = F.split(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""), "_")
    fruit, word = F.try_element_at(tokens, F.lit(1)), F.try_element_at(tokens, F.lit(2))
    stage = stage_of(folder)
    error = (
        F.when(n < 3, "path has no split and stage folder")
        .when(~split.isin(*SPLITS), "unknown split")
        .when(stage.isNull() | ~fruit.isin(*FRUITS), "unknown fruit or stage")
        .when(~F.coalesce(stage_of(word) == stage, F.lit(False)), "file name does not match its folder")
        .otherwise("")
    )
    ok = error == ""
    return F.when(path.isNotNull(), F.struct(F.when(ok, split).alias("source_split"), F.when(ok, fruit).alias("fruit"), F.when(ok, stage).alias("stage"), F.when(ok, folder).alias("raw_stage"), error.alias("error")))


def working_size(width: Column, height: Column, cap: int) -> Column:
    """P25: dimensions scaled so that the longer side is at most ``cap``; halves round to even, at least 1."""
    scale = F.least(F.lit(1.0), F.lit(float(cap)) / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1), F.bround(width * scale)).cast("int").alias("width"), F.greatest(F.lit(1), F.bround(height * scale)).cast("int").alias("height"))


def letterbox(width: Column, height: Column, side: int = 224) -> Column:
    """P5: size and offsets of an image fitted into a square; small images are enlarged."""
    scale = F.lit(float(side)) / F.greatest(width, height)
    w, h = F.greatest(F.lit(1), F.bround(width * scale)).cast("int"), F.greatest(F.lit(1), F.bround(height * scale)).cast("int")
    return F.struct(w.alias("width"), h.alias("height"), F.floor((side - w) / 2).cast("int").alias("left"), F.floor((side - h) / 2).cast("int").alias("top"))


def quality_grade(fraction: Column, status: Column | None = None) -> Column:
    """P10: Good to 0.05, Acceptable to 0.15, else Poor; null or another status than graded is Not graded; outside 0..1 fails."""
    bad = F.isnan(fraction) | (fraction < 0) | (fraction > 1)
    grade = F.when(fraction.isNull(), "Not graded").when(bad, F.raise_error(F.lit("fraction outside 0..1")).cast("string")).when(fraction <= 0.05, "Good").when(fraction <= 0.15, "Acceptable").otherwise("Poor")
    return grade if status is None else F.when(F.coalesce(status != "graded", F.lit(True)), "Not graded").otherwise(grade)


def mask_status(fraction: Column, method: Column) -> Column:
    """Empty, near_full above 0.98, nonempty; the baseline isn't segmented."""
    return F.when(method == "baseline", "not_segmented").when(fraction == 0, "empty").when(fraction > 0.98, "near_full").when(fraction.isNotNull(), "nonempty")


def review_flag(fraction: Column, candidate: Column) -> Column:
    """P13."""
    return F.when(fraction == 0, "no_foreground").when(candidate > 0.85, "broad_colour_candidates").otherwise("inspect_mask")


def first_max(names: list[str], scores: list[Column]) -> Column:
    """Name of the largest score; on a tie the first one; null if any score is null or NaN."""
    values = F.array(*scores)
    bad = reduce(lambda a, b: a | b, [s.isNull() | F.isnan(s) for s in scores])
    return F.when(~bad, F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(values, F.array_max(values)).cast("int")))


def softmax(logits: list[Column]) -> list[Column]:
    """P14, shifted by the largest logit."""
    top = F.greatest(*logits)
    exps = [F.exp(x - top) for x in logits]
    total = reduce(lambda a, b: a + b, exps)
    return [e / total for e in exps]


def run_label(stamp: Column) -> Column:
    """``20260828T085810_496281Z`` as ``28 Aug 2026, 08:58:10 UTC``; anything else unchanged."""
    whole = F.regexp_extract(stamp, r"^(\d{8}T\d{6})_\d{6}Z$", 1)
    at = F.try_to_timestamp(F.when(whole != "", whole), F.lit("yyyyMMdd'T'HHmmss"))
    return F.coalesce(F.concat(F.date_format(at, "dd MMM yyyy, HH:mm:ss"), F.lit(" UTC")), stamp)


def clamp_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Low corner floored into 0..side-1, high corner raised into 1..side."""
    a = F.greatest(F.lit(0), F.least(width - 1, F.floor(x1)))
    b = F.greatest(F.lit(0), F.least(height - 1, F.floor(y1)))
    c = F.greatest(F.lit(1), F.least(width, F.ceil(x2)))
    d = F.greatest(F.lit(1), F.least(height, F.ceil(y2)))
    return F.struct(*[v.cast("bigint").alias(n) for v, n in ((a, "x1"), (b, "y1"), (c, "x2"), (d, "y2"))])


def frame_seconds(index: Column, fps: Column) -> Column:
    """Time of a frame counted from 1; a missing or non-positive rate counts as 25."""
    return (index - 1) / F.when(fps > 0, fps).otherwise(F.lit(25.0))


def basename(path: Column) -> Column:
    """P29."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def safe_cell(c: Column) -> Column:
    """K4: a text that a spreadsheet would run as a formula gets a leading apostrophe. Numbers aren't touched: pass strings only."""
    return F.when(c.rlike(r"(?U)^\s*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def display(name: str, c: Column) -> Column:
    """Fractions as percent, ``*_ms`` as milliseconds, diameters as pixels, sources as file names, missing as ``-``."""
    if name in ("accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", "score_unripe", "score_ripe", "score_overripe", "foreground_fraction", "blemish_fraction"):
        out = F.concat(F.call_function("format_number", c.cast("double") * 100, F.lit("0.00")), F.lit("%"))
    elif name.endswith("_ms"):
        out = F.concat(F.call_function("format_number", c.cast("double"), F.lit("0.0")), F.lit(" ms"))
    elif name == "equivalent_diameter_px":
        out = F.concat(F.call_function("format_number", c.cast("double"), F.lit("0.0")), F.lit(" px"))
    elif name == "source":
        out = basename(c)
    else:
        out = c.cast("string")
    return F.when(c.isNull() | (c.cast("string") == ""), "-").otherwise(out)
