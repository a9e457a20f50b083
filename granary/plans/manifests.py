"""Queries over split manifests: splits, guards, differences, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.functions.normalize import category, digest, split_name
from granary.operators import splits as S
from granary.plans.audit import IMAGES, images
from granary.session import table


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct rows of the split manifest in plain spelling."""
    t = table(spark, sf, "baseline_manifest")
    return t.select("image_id", "path", "source_split", split_name(F.col("split")).alias("split"), category(F.col("fruit")).alias("fruit"), "stage", digest(F.col("sha256")).alias("sha256")).distinct()


MANIFEST = r"""
manifest AS (SELECT DISTINCT image_id, path, source_split, CASE WHEN s = 'val' THEN 'validation' WHEN s <> '' THEN s END AS split, CASE WHEN f <> '' THEN f END AS fruit, stage,
  CASE WHEN regexp_full_match(h, '[0-9a-f]{64}') AND h <> repeat('0', 64) THEN h END AS sha256
  FROM (SELECT m.* EXCLUDE (sha256), lower(regexp_replace(m.split, '^\s+|\s+$', '', 'g')) AS s, lower(regexp_replace(m.fruit, '^\s+|\s+$', '', 'g')) AS f,
    regexp_replace(lower(regexp_replace(m.sha256, '^\s+|\s+$', '', 'g')), '^sha256:\s*', '') AS h FROM baseline_manifest m))
"""


def split_counts(spark, sf):
    """Images per split and fruit; null is a value."""
    return manifest(spark, sf).groupBy("split", "fruit").agg(F.count(F.lit(1)).alias("n"))


def stratified_split(spark, sf):
    """L1: a fifth of the training source to validation, by fruit and stage, stable under row order."""
    m = manifest(spark, sf).where("source_split = 'train' or source_split = 'test'")
    return S.stratified_split(m, ["fruit", "stage"], "image_id", eligible=F.col("source_split") == "train").select("image_id", "fruit", "stage", "split")


def holdout_guard(spark, sf):
    """Audited images whose content is reserved for testing, whatever their name."""
    reserved = manifest(spark, sf).where("split = 'test'").select("sha256")
    return S.holdout_guard(images(spark, sf).select("image_id", "path", "sha256"), reserved, "sha256").select("image_id", "path", "blocked")


def changed_content(spark, sf):
    """F8: manifest images whose file is gone from the audit or has other content now."""
    return S.changed_content(images(spark, sf).select("path", "sha256").distinct(), manifest(spark, sf).select("path", "sha256"), "path", "sha256")


def manifest_difference(spark, sf):
    """The training part of the manifest against one in which every tomato was moved to test."""
    m = manifest(spark, sf).where("split in ('train', 'test')").select("image_id", "split", "fruit")
    return S.manifest_difference(m, m.withColumn("split", F.when(F.col("fruit") == "tomato", "test").otherwise(F.col("split"))))


def manifest_complete(spark, sf):
    """test rows, how many lack a hash, and whether the manifest may serve as a guard."""
    t = manifest(spark, sf).where("split = 'test'")
    return t.agg(F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("sha256").isNull()).alias("without_hash")).withColumn("complete", (F.col("n_test") > 0) & (F.col("without_hash") == 0))


def incomplete_strata(spark, sf):
    """Fruits that lack one of the stages in a source split."""
    m = manifest(spark, sf).where("fruit is not null").withColumn("part", F.concat_ws("/", "source_split", "fruit"))
    return S.incomplete_strata(m, "part", "stage", ("unripe", "ripe", "overripe", "rotten"))


def guarded_training_view(spark, sf):
    """what training may read; a row from elsewhere would fail the job."""
    m = manifest(spark, sf).where("split in ('train', 'validation') and source_split = 'train'")
    return S.require_split(m, {"split": ("train", "validation"), "source_split": ("train",)}).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def dataset_fingerprint(spark, sf):
    """Fingerprint of the manifest, free of row order."""
    return S.fingerprint(manifest(spark, sf), ["image_id", "path", "split", "sha256"])


def record_digests(spark, sf):
    """SHA-256 of each row's canonical JSON."""
    m = manifest(spark, sf).where("split is not null and fruit is not null and sha256 is not null")
    return m.select("image_id", F.sha2(F.concat(F.lit('{"fruit":"'), "fruit", F.lit('","path":"'), "path", F.lit('","split":"'), "split", F.lit('"}')), 256).alias("row_sha256"))


def test_union(spark, sf):
    """Distinct hashes reserved by either table's test rows."""
    a = images(spark, sf).where("split = 'test'").select("sha256")
    b = manifest(spark, sf).where("split = 'test'").select("sha256")
    return a.unionByName(b).where("sha256 is not null").distinct()


QUERIES = {f.__name__: f for f in (split_counts, stratified_split, holdout_guard, changed_content, manifest_difference, manifest_complete, incomplete_strata, guarded_training_view, dataset_fingerprint, record_digests, test_union)}
_DIFF = "m AS (SELECT image_id, split, fruit FROM manifest WHERE split IN ('train', 'test')), o AS (SELECT image_id, CASE WHEN fruit = 'tomato' THEN 'test' ELSE split END AS split, fruit FROM m)"
SQL = {
    "split_counts": f"WITH {MANIFEST} SELECT split, fruit, count(*) AS n FROM manifest GROUP BY ALL",
    "stratified_split": f"""WITH {MANIFEST}, m AS (SELECT *, md5('42|' || image_id) AS h FROM manifest WHERE source_split IN ('train', 'test')),
      r AS (SELECT *, row_number() OVER (PARTITION BY fruit, stage ORDER BY h, image_id) AS r, count(*) OVER (PARTITION BY fruit, stage) AS n FROM m WHERE source_split = 'train')
      SELECT image_id, fruit, stage, CASE WHEN r <= greatest(floor(n * 0.2 + 0.5), CASE WHEN n >= 2 THEN 1 ELSE 0 END) THEN 'validation' ELSE 'train' END AS split FROM r UNION ALL SELECT image_id, fruit, stage, 'test' FROM m WHERE source_split = 'test'""",
    "holdout_guard": f"WITH {IMAGES}, {MANIFEST} SELECT image_id, path, coalesce(sha256 IN (SELECT sha256 FROM manifest WHERE split = 'test' AND sha256 IS NOT NULL), false) AS blocked FROM images",
    "changed_content": f"WITH {IMAGES}, {MANIFEST}, c AS (SELECT DISTINCT path, sha256, true AS there FROM images) SELECT DISTINCT path, CASE WHEN there IS NULL THEN 'missing' ELSE 'changed' END AS status FROM manifest m LEFT JOIN (SELECT path, sha256 AS now, there FROM c) USING (path) WHERE there IS NULL OR sha256 IS DISTINCT FROM now",
    "manifest_difference": f"WITH {MANIFEST}, {_DIFF} SELECT *, 'left' AS side FROM (SELECT * FROM m EXCEPT ALL SELECT * FROM o) UNION ALL SELECT *, 'right' FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM m)",
    "manifest_complete": f"WITH {MANIFEST} SELECT count(*) AS n_test, count(*) FILTER (sha256 IS NULL) AS without_hash, count(*) > 0 AND count(*) FILTER (sha256 IS NULL) = 0 AS complete FROM manifest WHERE split = 'test'",
    "incomplete_strata": f"WITH {MANIFEST} SELECT part, list_sort([x for x in ['unripe', 'ripe', 'overripe', 'rotten'] if NOT list_contains(s, x)]) AS missing FROM (SELECT source_split || '/' || fruit AS part, list(DISTINCT stage) AS s FROM manifest WHERE fruit IS NOT NULL GROUP BY 1) WHERE len([x for x in ['unripe', 'ripe', 'overripe', 'rotten'] if NOT list_contains(s, x)]) > 0",
    "guarded_training_view": f"WITH {MANIFEST} SELECT split, count(*) AS n FROM manifest WHERE split IN ('train', 'validation') AND source_split = 'train' GROUP BY 1",
    "dataset_fingerprint": f"WITH {MANIFEST} SELECT count(*) AS n_rows, coalesce(sum(('0x' || md5(concat_ws('|', coalesce(image_id::VARCHAR, '~'), coalesce(path, '~'), coalesce(split, '~'), coalesce(sha256, '~')))[1:15])::UBIGINT), 0)::VARCHAR AS hash_sum FROM manifest",
    "record_digests": f"""WITH {MANIFEST} SELECT image_id, sha256('{{"fruit":"' || fruit || '","path":"' || path || '","split":"' || split || '"}}') AS row_sha256 FROM manifest WHERE split IS NOT NULL AND fruit IS NOT NULL AND sha256 IS NOT NULL""",
    "test_union": f"WITH {IMAGES}, {MANIFEST} SELECT sha256 FROM images WHERE split = 'test' AND sha256 IS NOT NULL UNION SELECT sha256 FROM manifest WHERE split = 'test' AND sha256 IS NOT NULL",
}
