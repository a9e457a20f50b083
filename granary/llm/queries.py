"""Queries p1 to p3 and p5 to p9 with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.functions.normalize import category, digest, phash_bits, plain_path, specimen_name, split_name
from granary.llm.components import pruned_components, star_components
from granary.llm.leakage import leaks
from granary.llm.hamming import cross_split_overlap, nearest_neighbours, overlap_report, similar_vectors
from granary.llm.pii import personal_information
from granary.llm.quantiles import digests, exact_quantile, merge, percentiles
from granary.llm.splits import assign_splits, related, split_conflicts
from granary.llm.tokens import encode_corpus
from granary.operators.quantile import finite
from granary.session import cut, table


def audit_links(spark: SparkSession, sf: str, most: int = 4) -> DataFrame:
    """Links ``(a, b)`` of plain paths, ``a < b``: both given, different, distance 0 to ``most``."""
    pairs = table(spark, sf, "audit_pairs").where(F.col("distance").between(0, most)).select(plain_path(F.col("path_a")).alias("p"), plain_path(F.col("path_b")).alias("q"))
    return pairs.where("p is not null and q is not null and p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def grouped_paths(links: DataFrame) -> DataFrame:
    """``(path, group_path)`` for links between texts: exact bigint ids stand for the texts while components are found."""
    links = cut(links)
    names = cut(links.select(F.explode(F.array("a", "b")).alias("path")).distinct().withColumn("id", F.monotonically_increasing_id()))
    edges = links.join(names.select(F.col("path").alias("a"), F.col("id").alias("i")).hint("merge"), "a").join(names.select(F.col("path").alias("b"), F.col("id").alias("j")).hint("merge"), "b").select(F.col("i").alias("a"), F.col("j").alias("b"))
    members = cut(pruned_components(edges).join(names.hint("merge"), "id").select("path", "root"))
    return members.join(members.groupBy("root").agg(F.min("path").alias("group_path")).hint("merge"), "root").select("path", "group_path")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each path in at least one link; ``group_path`` is the smallest path of its component."""
    return grouped_paths(audit_links(spark, sf))


def image_codes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "audit_manifest").select(F.col("image_id").alias("id"), phash_bits(F.col("phash")).alias("code"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of images of which at least one is among the other's five nearest within 7 bits."""
    return nearest_neighbours(image_codes(spark, sf)).select(F.least("id", "neighbour").alias("image_a"), F.greatest("id", "neighbour").alias("image_b")).distinct()


def p2_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest embeddings of every twentieth one among all, by learned codes and float distances."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return similar_vectors(rows, rows.where("id % 20 = 0")).select(F.col("id").alias("vec_id"), "neighbour", F.round("distance", 5).alias("distance"), "rank")


def split_images(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "audit_manifest").select("image_id", split_name(F.col("source_split")).alias("split"), "source", digest(F.col("pixel_sha256")).alias("pixel"), phash_bits(F.col("phash")).alias("code"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a training and an evaluation image with equal pixels or codes within 4 bits."""
    return cross_split_overlap(split_images(spark, sf)).select("image_a", "image_b").distinct()


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Images of the split manifest with the two entities that relate them: content and the fruit's specimen."""
    fruit, specimen = category(F.col("fruit")), specimen_name(F.col("specimen"))
    return table(spark, sf, "baseline_manifest").select(F.col("image_id").alias("id"), split_name(F.col("split")).alias("split"), fruit.alias("fruit"), digest(F.col("sha256")).alias("sha"), F.to_json(F.struct(fruit.alias("f"), F.when(fruit.isNotNull(), specimen).alias("s"))).alias("piece"), specimen.isNotNull().alias("known")).withColumn("piece", F.when(F.col("known") & F.col("fruit").isNotNull(), F.col("piece"))).drop("known")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Images whose group of related images holds at least two different splits."""
    m = manifest(spark, sf)
    return split_conflicts(m, related(m, ["sha", "piece"])).select(F.col("id").alias("image_id"))


def p3_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The new split of every image: related images stay together, shares near 77, 17 and 6 percent within each fruit."""
    m = manifest(spark, sf)
    return assign_splits(m, cut(related(m, ["sha", "piece"])), "fruit").select(F.col("id").alias("image_id"), F.col("root").alias("group_id"), "split")


def timings(spark: SparkSession, sf: str) -> DataFrame:
    """``(result_id, method, field, day, value)`` of all finite timings of 0 or more; repeated rows count once, null methods have
    no row."""
    rows = table(spark, sf, "result_rows").select("result_id", category(F.col("method")).alias("method"), F.to_date("created_at").alias("day"), "processing_ms", "prediction_ms").where("method is not null").distinct()
    long = rows.select("result_id", "method", "day", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("processing_ms", "prediction_ms")])).alias("e"))
    return long.select("result_id", "method", "e.field", "day", "e.value").where(finite(F.col("value")) & (F.col("value") >= 0))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Valid timings above ten times the median of their method and field: digests of days, merged, then one exact pass."""
    values, keys = cut(timings(spark, sf)), ["method", "field"]
    digest = merge(digests(values, [*keys, "day"]), keys)
    medians = exact_quantile(values, keys, 0.5, digest=digest)
    return values.join(medians, keys).where(F.col("value") > 10 * F.col("quantile")).select("result_id", "field").distinct()


def p5_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Median, 90th, 95th and 99th percentile per method and field, from the merged digests of single days."""
    return percentiles(merge(digests(timings(spark, sf), ["method", "field", "day"]), ["method", "field"]), ["method", "field"], [0.5, 0.9, 0.95, 0.99])


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation images with a training counterpart, and the pairs, per evaluation split, source and kind of evidence."""
    return overlap_report(split_images(spark, sf))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document by the byte-level vocabulary."""
    return encode_corpus(table(spark, sf, "documents"), "doc_id", "text")


def all_leaks(spark: SparkSession, sf: str, edited: bool = False) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), "doc_id", "item_id", "text", edited=edited)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold at least ten consecutive words of an item: alignments around rare seeds, then the exact run."""
    return all_leaks(spark, sf).where((F.col("score") >= 20) & (F.col("verbatim_run") >= 10)).select("doc_id", "item_id").distinct()


def p8_alignments(spark: SparkSession, sf: str) -> DataFrame:
    """Edited and verbatim copies with their best local alignment; a score of 2 per item word is a full verbatim copy.

    A pair counts from a score of 20 on, or four fifths of the full score of an item below 13 words.
    """
    return all_leaks(spark, sf, edited=True).where("score >= least(20, ceil(1.6 * item_words))").groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("verbatim_run").alias("verbatim_run"), F.max("item_words").alias("item_words"))


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """Each test item with the number of documents it leaked into; 0 for none."""
    found = p8_found(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return table(spark, sf, "eval_items").select("item_id", "subset").distinct().join(found, "item_id", "left").select("item_id", "subset", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct piece of personal information of each document."""
    return personal_information(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "name_lexicon"))


def p9_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with personal information replaced by typed placeholders."""
    return personal_information(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "name_lexicon"), replace=True)


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_vectors, p3_found, p3_splits, p5_found, p5_percentiles, p6_found, p6_report, p7_ids, p8_found, p8_alignments, p8_items, p9_found, p9_redacted)}

_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '[\\/]+', '/', 'g'), '^(\./)+', ''), '/(\./)+', '/', 'g')"
_CODE = r"""
codes AS (SELECT DISTINCT image_id, s, px, CASE WHEN regexp_full_match(c, '[0-9a-f]{1,16}') AND c <> repeat('0', length(c)) THEN ('0x' || c)::UBIGINT END AS code FROM (SELECT image_id,
  replace(lower(regexp_replace(source_split, '^\s+|\s+$', '', 'g')), 'validation', 'val') AS s,
  regexp_replace(lower(regexp_replace(pixel_sha256, '^\s+|\s+$', '', 'g')), '^sha256:\s*', '') AS px,
  regexp_replace(regexp_replace(lower(regexp_replace(phash, '^\s+|\s+$', '', 'g')), '^0x', ''), '[\s:_.-]', '', 'g') AS c FROM audit_manifest WHERE image_id IS NOT NULL))
"""
_MEMBERS = r"""
m AS (SELECT DISTINCT image_id, CASE WHEN s = 'val' THEN 'validation' WHEN s <> '' THEN s END AS split, CASE WHEN length(h) = 64 AND h <> repeat('0', 64) THEN h END AS sha,
  CASE WHEN f <> '' AND p NOT IN ('', 'unknown', 'n/a') THEN f || '|' || p END AS piece
  FROM (SELECT image_id, lower(regexp_replace(split, '^\s+|\s+$', '', 'g')) AS s, lower(regexp_replace(fruit, '^\s+|\s+$', '', 'g')) AS f, lower(regexp_replace(specimen, '^\s+|\s+$', '', 'g')) AS p,
    regexp_replace(lower(regexp_replace(sha256, '^\s+|\s+$', '', 'g')), '^sha256:\s*', '') AS h FROM baseline_manifest))
"""
_RELATED = f"{_MEMBERS}, e AS (SELECT a.image_id AS i, b.image_id AS j FROM m a JOIN m b ON a.sha = b.sha UNION SELECT a.image_id, b.image_id FROM m a JOIN m b ON a.piece = b.piece), r AS (SELECT DISTINCT image_id AS i, image_id AS j FROM m UNION SELECT r.i, e.j FROM r JOIN e ON e.i = r.j)"
_SPLIT = r"""
g AS (SELECT i, min(j) AS root FROM r GROUP BY i), f AS (SELECT image_id, min(fruit) AS fruit FROM fruits GROUP BY 1),
per AS (SELECT root, coalesce(fruit, '') AS stratum, count(*) AS n FROM g JOIN f ON f.image_id = g.i GROUP BY ALL),
c AS (SELECT root, sum(n)::BIGINT AS n, min({'k': -n, 's': stratum}).s AS stratum, (('0x' || md5(root::VARCHAR)[1:8])::UBIGINT // 1048576)::INT AS place FROM per GROUP BY root),
z AS (SELECT *, sum(n) OVER (PARTITION BY stratum) AS total, n > sum(n) OVER (PARTITION BY stratum) * 0.02::DOUBLE AS big FROM c),
m AS (SELECT stratum, place, any_value(total) AS total, any_value(filled) + sum(sum(n)) OVER (PARTITION BY stratum ORDER BY place) - sum(n) / 2::DOUBLE AS middle
  FROM (SELECT *, coalesce(sum(n) FILTER (WHERE big) OVER (PARTITION BY stratum), 0) AS filled FROM z) WHERE NOT big GROUP BY stratum, place)
"""
_TIMES = r"""
t AS (SELECT DISTINCT result_id, lower(regexp_replace(method, '^\s+|\s+$', '', 'g')) AS method, unnest(['processing_ms', 'prediction_ms']) AS field, unnest([processing_ms, prediction_ms]) AS v FROM result_rows WHERE method IS NOT NULL)
"""
_WINDOWS = "SELECT DISTINCT {k}, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT {k}, w, unnest(range(1, len(w) - 8)) AS i FROM (SELECT {k}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {t}) WHERE len(w) >= 10)"
#: Queries that SQL can express on whole tables; the others are tested against brute force, round trips and exact bounds.
SQL: dict[str, str] = {
    "p1_found": f"""WITH RECURSIVE l AS (SELECT DISTINCT p, q FROM (SELECT {_PLAIN.format(c='path_a')} AS p, {_PLAIN.format(c='path_b')} AS q FROM audit_pairs WHERE distance BETWEEN 0 AND 4) WHERE p <> '' AND q <> '' AND p <> q),
      e AS (SELECT p, q FROM l UNION SELECT q, p FROM l), r AS (SELECT p AS path, p AS other FROM e UNION SELECT r.path, e.q FROM r JOIN e ON e.p = r.other) SELECT path, min(other) AS group_path FROM r GROUP BY path""",
    "p2_found": f"WITH {_CODE}, n AS (SELECT a.image_id AS i, b.image_id AS j, bit_count(xor(a.code, b.code)) AS d FROM codes a JOIN codes b ON a.image_id <> b.image_id AND bit_count(xor(a.code, b.code)) <= 7 QUALIFY row_number() OVER (PARTITION BY a.image_id ORDER BY d, b.image_id) <= 5) SELECT DISTINCT least(i, j) AS image_a, greatest(i, j) AS image_b FROM n",
    "p3_found": f"WITH RECURSIVE {_RELATED} SELECT r.i AS image_id FROM r JOIN m ON m.image_id = r.j GROUP BY 1 HAVING count(DISTINCT m.split) > 1",
    "p3_splits": "WITH RECURSIVE " + _RELATED + r""", fruits AS (SELECT image_id, nullif(lower(regexp_replace(fruit, '^\s+|\s+$', '', 'g')), '') AS fruit FROM baseline_manifest WHERE image_id IS NOT NULL), """
      + _SPLIT.replace("m AS", "mass AS") + "SELECT g.i AS image_id, g.root AS group_id, CASE WHEN z.big OR middle < z.total * 0.77::DOUBLE THEN 'train' WHEN middle < z.total * 0.94::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM g JOIN z USING (root) LEFT JOIN mass USING (stratum, place)",
    "p5_found": f"WITH {_TIMES}, g AS (SELECT *, median(v) OVER (PARTITION BY method, field) AS mid FROM t WHERE v >= 0 AND isfinite(v)) SELECT DISTINCT result_id, field FROM g WHERE v > 10 * mid",
    "p6_found": f"WITH {_CODE}, f AS (SELECT * FROM codes WHERE s = 'train'), h AS (SELECT * FROM codes WHERE s IN ('test', 'val')) SELECT DISTINCT least(f.image_id, h.image_id) AS image_a, greatest(f.image_id, h.image_id) AS image_b FROM f JOIN h ON f.image_id <> h.image_id AND (f.px = h.px AND length(f.px) = 64 OR bit_count(xor(f.code, h.code)) <= 4)",
    "p6_report": f"""WITH {_CODE}, f AS (SELECT * FROM codes WHERE s = 'train'), h AS (SELECT * FROM codes WHERE s IN ('test', 'val')),
      p AS (SELECT f.image_id AS t, h.image_id AS e, unnest([CASE WHEN f.px = h.px AND length(f.px) = 64 THEN 'pixel' END, CASE WHEN bit_count(xor(f.code, h.code)) <= 4 THEN 'phash' END]) AS evidence FROM f JOIN h ON f.image_id <> h.image_id AND (f.px = h.px AND length(f.px) = 64 OR bit_count(xor(f.code, h.code)) <= 4)),
      own AS (SELECT DISTINCT image_id, CASE WHEN s = 'val' THEN 'validation' ELSE s END AS split, source FROM (SELECT image_id, replace(lower(regexp_replace(source_split, '^\\s+|\\s+$', '', 'g')), 'validation', 'val') AS s, source FROM audit_manifest) WHERE s IN ('val', 'test'))
      SELECT split, source, evidence, count(DISTINCT e) AS n_images, count(*) AS n_pairs FROM (SELECT DISTINCT t, e, evidence FROM p WHERE evidence IS NOT NULL) JOIN own ON own.image_id = e GROUP BY ALL""",
    "p8_items": f"WITH d AS ({_WINDOWS.format(k='doc_id', t='documents')}), i AS ({_WINDOWS.format(k='item_id', t='eval_items')}), n AS (SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM d JOIN i USING (g) WHERE doc_id IS NOT NULL GROUP BY 1) SELECT DISTINCT item_id, subset, coalesce(n_docs, 0) AS n_docs FROM eval_items LEFT JOIN n USING (item_id)",
    "p8_found": f"WITH d AS ({_WINDOWS.format(k='doc_id', t='documents')}), i AS ({_WINDOWS.format(k='item_id', t='eval_items')}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)",
}
