"""Queries of the content audit: labels, counts, duplicates, near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.functions.normalize import digest, phash_bits, split_name
from granary.functions.scalars import basename, has_image_extension, parse_labels
from granary.operators import duplicates, neardup
from granary.session import cut, table


def images(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct rows of the audit manifest with hashes and splits in plain spelling."""
    t = table(spark, sf, "audit_manifest")
    return t.select("image_id", "path", split_name(F.col("source_split")).alias("split"), "fruit", "stage", "raw_stage", "width", "height", "bytes", "error", digest(F.col("sha256")).alias("sha256"), digest(F.col("pixel_sha256")).alias("pixel_sha256"), phash_bits(F.col("phash")).alias("code")).distinct()


#: The same in DuckDB; ``code`` holds the unsigned 64 bits.
IMAGES = r"""
images AS (SELECT DISTINCT image_id, path, CASE WHEN s = 'val' THEN 'validation' WHEN s <> '' THEN s END AS split, fruit, stage, raw_stage, width, height, bytes, error,
  CASE WHEN regexp_full_match(h, '[0-9a-f]{64}') AND h <> repeat('0', 64) THEN h END AS sha256,
  CASE WHEN regexp_full_match(p, '[0-9a-f]{64}') AND p <> repeat('0', 64) THEN p END AS pixel_sha256,
  CASE WHEN regexp_full_match(c, '[0-9a-f]{1,16}') AND c <> repeat('0', length(c)) THEN ('0x' || c)::UBIGINT END AS code
  FROM (SELECT m.* EXCLUDE (sha256, pixel_sha256), lower(regexp_replace(source_split, '^\s+|\s+$', '', 'g')) AS s,
    regexp_replace(lower(regexp_replace(m.sha256, '^\s+|\s+$', '', 'g')), '^sha256:\s*', '') AS h,
    regexp_replace(lower(regexp_replace(m.pixel_sha256, '^\s+|\s+$', '', 'g')), '^sha256:\s*', '') AS p,
    regexp_replace(regexp_replace(lower(regexp_replace(m.phash, '^\s+|\s+$', '', 'g')), '^0x', ''), '[\s:_.-]', '', 'g') AS c FROM audit_manifest m))
"""

_GROUPS = """
groups AS (SELECT {key} AS key, count(*) AS n, min(path) AS first, count(DISTINCT coalesce(split, '~')) > 1 AS cross_split,
  count(DISTINCT coalesce(fruit, '~') || '/' || coalesce(stage, '~')) > 1 AS conflicting_labels FROM images WHERE {key} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
"""


def dup_groups(spark, sf):
    """A1 on file bytes."""
    return duplicates.duplicate_groups(images(spark, sf), "sha256", "split", ["fruit", "stage"], "path")


def dup_pixel_groups(spark, sf):
    """A1 on decoded pixels."""
    return duplicates.duplicate_groups(images(spark, sf), "pixel_sha256", "split", ["fruit", "stage"], "path")


def dup_members(spark, sf):
    """The images of all groups with equal bytes."""
    return duplicates.duplicate_members(images(spark, sf), "sha256", "path").select("image_id", "path", "group_size", "group_first")


def doc_dup_groups(spark, sf):
    """A1 on whole document texts, by digest; source as split, language as label."""
    d = table(spark, sf, "documents").where("text <> ''").select(F.sha2("text", 256).alias("h"), "doc_id", "source", F.lower("lang").alias("lang"))
    return duplicates.duplicate_groups(d, "h", "source", ["lang"], "doc_id")


def audit_summary(spark, sf):
    """Counts of valid and failed images, of groups by bytes and by pixels."""
    i = cut(images(spark, sf))
    base = i.agg(F.count_if(F.col("error") == "").alias("valid_images"), F.count_if(F.col("error") != "").alias("invalid_images"))
    by = [duplicates.audit_summary(duplicates.duplicate_groups(i, k, "split", ["fruit", "stage"], "path")).select(*[F.col(c).alias(f"{p}_{c}") for c in ("n_groups", "redundant_copies", "cross_split_groups", "conflicting_groups")]) for k, p in (("sha256", "byte"), ("pixel_sha256", "pixel"))]
    return base.crossJoin(by[0]).crossJoin(by[1])


def _summary_sql(key: str, p: str) -> str:
    return f"""SELECT count(*) AS {p}_n_groups, coalesce(sum(n - 1), 0)::BIGINT AS {p}_redundant_copies, count(*) FILTER (cross_split) AS {p}_cross_split_groups, count(*) FILTER (conflicting_labels) AS {p}_conflicting_groups
      FROM (SELECT count(*) AS n, count(DISTINCT coalesce(split, '~')) > 1 AS cross_split, count(DISTINCT coalesce(fruit, '~') || '/' || coalesce(stage, '~')) > 1 AS conflicting_labels FROM images WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) > 1)"""


def label_parse(spark, sf):
    """P1, P29, F1 on every path of the audit."""
    t = table(spark, sf, "audit_manifest").select("path").distinct()
    return t.select("path", has_image_extension(F.col("path")).alias("supported"), basename(F.col("path")).alias("file"), parse_labels(F.col("path")).alias("l")).select("path", "supported", "file", F.col("l.source_split").alias("label_split"), F.col("l.fruit").alias("label_fruit"), F.col("l.stage").alias("label_stage"), F.col("l.raw_stage").alias("label_raw_stage"), F.col("l.error").alias("label_error"))


_LABELS = r"""
WITH t AS (SELECT DISTINCT path FROM audit_manifest), p AS (SELECT path, string_split(lower(path), '/') AS parts FROM t),
q AS (SELECT path, len(parts) AS n, parts[-3] AS split, parts[-2] AS folder, string_split(regexp_replace(parts[-1], '\.[^.]*$', ''), '_') AS tokens FROM p),
r AS (SELECT *, CASE WHEN folder = 'overipe' THEN 'overripe' WHEN folder IN ('ripe', 'unripe', 'overripe') THEN folder END AS stage,
  CASE WHEN tokens[2] = 'overipe' THEN 'overripe' WHEN tokens[2] IN ('ripe', 'unripe', 'overripe') THEN tokens[2] END AS word FROM q),
s AS (SELECT *, CASE WHEN n < 3 THEN 'path has no split and stage folder' WHEN split NOT IN ('train', 'test', 'validation', 'val') THEN 'unknown split'
  WHEN stage IS NULL OR tokens[1] NOT IN ('apple', 'banana', 'mango', 'orange', 'tomato') THEN 'unknown fruit or stage'
  WHEN word IS DISTINCT FROM stage THEN 'file name does not match its folder' ELSE '' END AS e FROM r WHERE path IS NOT NULL)
SELECT path, lower(regexp_extract(path, '(\.[^./]+)$', 1)) IN ('.jpg', '.jpeg', '.png', '.webp', '.bmp') AS supported, regexp_extract(path, '([^/\\]*)$', 1) AS file,
  CASE WHEN e = '' THEN split END AS label_split, CASE WHEN e = '' THEN tokens[1] END AS label_fruit, CASE WHEN e = '' THEN stage END AS label_stage, CASE WHEN e = '' THEN folder END AS label_raw_stage, e AS label_error FROM s
"""


def label_counts(spark, sf):
    """A2: images per split, fruit and stage."""
    return images(spark, sf).where("error = ''").groupBy("split", "fruit", "stage").agg(F.count(F.lit(1)).alias("n"))


def dimension_counts(spark, sf):
    """Image sizes, most frequent first."""
    return images(spark, sf).where("width is not null").groupBy("width", "height").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width", "height")


def near_dup_pairs(spark, sf):
    """Pairs of different pictures (one for each class of equal pixels and hash) within 4 bits."""
    i = images(spark, sf).where("error = ''")
    return neardup.near_duplicates(i, "path", "code", "pixel_sha256", "split", ["fruit", "stage"], 4)


def near_dup_classes(spark, sf):
    """Every image with its class and how many copies the class holds."""
    return neardup.copy_classes(images(spark, sf).where("error = ''"), "path", "code", "pixel_sha256").select("path", "class_path", "class_size")


_CLASSES = "c AS (SELECT path, split, fruit, stage, code, pixel_sha256, min(path) OVER (PARTITION BY code, pixel_sha256) AS class_path, count(*) OVER (PARTITION BY code, pixel_sha256) AS class_size FROM images WHERE error = '' AND code IS NOT NULL AND pixel_sha256 IS NOT NULL)"

QUERIES = {f.__name__: f for f in (dup_groups, dup_pixel_groups, dup_members, doc_dup_groups, audit_summary, label_parse, label_counts, dimension_counts, near_dup_pairs, near_dup_classes)}
SQL = {
    "dup_groups": f"WITH {IMAGES}, {_GROUPS.format(key='sha256')} SELECT * FROM groups",
    "dup_pixel_groups": f"WITH {IMAGES}, {_GROUPS.format(key='pixel_sha256')} SELECT * FROM groups",
    "dup_members": f"WITH {IMAGES} SELECT image_id, path, n AS group_size, f AS group_first FROM (SELECT *, count(*) OVER w AS n, min(path) OVER w AS f FROM images WHERE sha256 IS NOT NULL WINDOW w AS (PARTITION BY sha256)) WHERE n > 1",
    "doc_dup_groups": "SELECT sha256(text) AS key, count(*) AS n, min(doc_id) AS first, count(DISTINCT coalesce(source, '~')) > 1 AS cross_split, count(DISTINCT coalesce(lower(lang), '~')) > 1 AS conflicting_labels FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1",
    "audit_summary": f"WITH {IMAGES} SELECT * FROM (SELECT count(*) FILTER (error = '') AS valid_images, count(*) FILTER (error <> '') AS invalid_images FROM images), ({_summary_sql('sha256', 'byte')}), ({_summary_sql('pixel_sha256', 'pixel')})",
    "label_parse": _LABELS,
    "label_counts": f"WITH {IMAGES} SELECT split, fruit, stage, count(*) AS n FROM images WHERE error = '' GROUP BY ALL",
    "dimension_counts": f"WITH {IMAGES} SELECT width, height, count(*) AS n FROM images WHERE width IS NOT NULL GROUP BY ALL",
    "near_dup_pairs": f"""WITH {IMAGES}, {_CLASSES}, k AS (SELECT DISTINCT ON (class_path) * FROM c WHERE path = class_path)
      SELECT a.path AS path_a, b.path AS path_b, bit_count(xor(a.code, b.code))::INTEGER AS distance, a.split IS DISTINCT FROM b.split AS cross_split, (a.fruit IS DISTINCT FROM b.fruit OR a.stage IS DISTINCT FROM b.stage) AS conflicting_labels
      FROM k a JOIN k b ON a.path < b.path AND a.pixel_sha256 <> b.pixel_sha256 AND bit_count(xor(a.code, b.code)) <= 4""",
    "near_dup_classes": f"WITH {IMAGES}, {_CLASSES} SELECT path, class_path, class_size FROM c",
}
