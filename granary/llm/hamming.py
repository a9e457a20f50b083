"""Searches over 64-bit codes and float vectors: nearest neighbours by multi-index hashing, and overlap of splits.

All work on *distinct* codes first, so that a group of equal copies costs one code however many rows it holds, and attach
rows afterwards. Buckets are probed by equi-joins on (table, key); the distance test is ``bit_count`` inside the join's
condition, and a pair is accepted only in the first table that can find it, so no de-duplication shuffle is needed. The
number of substrings follows the number of codes, so that chance meetings in buckets stay in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from granary.operators.neardup import ROW, code_pairs
from granary.session import bounded, cut

BITS = 64


def hamming(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def learn_bit_order(codes: DataFrame, parts: int = 4, sample_rows: int = 20_000) -> list[int]:
    """A rotation of the code space that keeps Hamming distances: a permutation of the 64 bits, learned from a sample.

    Correlated bits in one substring make crowded buckets, so each bit in turn (most biased first) joins the substring whose
    bits it correlates with least. ``sample_rows`` bounds the rows that reach the driver; every code is indexed whatever the
    sample, and results don't depend on it, only bucket sizes do.
    """
    rows = codes.orderBy(F.xxhash64("code")).limit(sample_rows).toPandas()["code"].to_numpy(dtype=np.int64)
    if len(rows) < 2:
        return list(range(BITS))
    bits = ((rows[:, None] >> np.arange(BITS)) & 1).astype(np.float64)
    spread = bits.std(axis=0)
    corr = np.abs(np.nan_to_num((bits - bits.mean(axis=0)).T @ (bits - bits.mean(axis=0)) / len(rows) / np.maximum(np.outer(spread, spread), 1e-9)))
    groups: list[list[int]] = [[] for _ in range(parts)]
    for b in np.argsort(spread, kind="stable"):
        free = [g for g in groups if len(g) < BITS // parts]
        min(free, key=lambda g: (sum(corr[b, x] for x in g), len(g))).append(int(b))
    return [b for g in groups for b in g]


def permute(code: Column, order: list[int]) -> Column:
    """Bit ``order[i]`` of ``code`` becomes bit ``i``."""
    if order == list(range(BITS)):
        return code
    terms = [F.shiftleft(F.shiftrightunsigned(code, b).bitwiseAND(F.lit(1).cast("bigint")), i) for i, b in enumerate(order)]
    while len(terms) > 1:
        terms = [terms[i].bitwiseOR(terms[i + 1]) if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def _edges(parts: int) -> list[int]:
    return [BITS * i // parts for i in range(parts + 1)]


def _part(code: Column, k: int, parts: int) -> Column:
    first, end = _edges(parts)[k : k + 2]
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << (end - first)) - 1).cast("bigint"))


def _flips(width: int, most: int) -> list[int]:
    """Masks of at most ``most`` of ``width`` bits."""
    return [sum(1 << b for b in chosen) for n in range(most + 1) for chosen in combinations(range(width), n)]


def parts_for(left: int, right: int, radius: int, most_probes: int = 8192) -> int:
    """Into how many substrings codes are best cut, given how many codes probe an index of how many.

    With ``m`` substrings one differs in at most ``radius // m`` bits, so each code probes that many flips of each; evenly
    spread codes meet by chance the more the shorter substrings are; a probe costs as much as testing ``ROW`` pairs. Few codes
    take many short substrings, many take few long ones with more probes a code (at radius 7: 4 of 16 bits below some forty
    million codes, 3 of 21 bits below some two thousand million, then 2 of 32 bits), so that the work a code stays bounded.
    """
    def cost(m: int) -> float:
        width, most = -(-BITS // m), radius // m
        probes = sum(comb(width, n) for n in range(min(most, width) + 1))
        return float("inf") if probes > most_probes else m * probes * left * (ROW + right / 2.0 ** (BITS / m))

    return min(range(1, min(radius, 15) + 2), key=cost)


def near_codes(codes: DataFrame, radius: int = 7, parts: int | None = None, order: list[int] | None = None, queries: DataFrame | None = None) -> DataFrame:
    """All unordered pairs ``(x, y, distance)`` of distinct ``code`` values within ``radius``, by multi-index hashing; with
    ``queries`` all pairs of a query's ``code`` ``x`` and an indexed one ``y``, equal ones too.

    Codes are split into ``parts`` substrings (by default :func:`parts_for` their number), each indexed. Some substring
    differs in at most ``radius // parts`` bits, so probing each index with the substring and its flips of so many bits
    retrieves every pair. Without ``queries`` only the code with the smaller substring probes, which halves the probes.
    Probes are spread over tasks before they are made. Nulls are ignored.
    """
    own = queries is None
    base = codes.where("code is not null").select("code").distinct()
    asking = base if own else queries.where("code is not null").select("code").distinct()
    if parts is None:
        n = base.count()
        parts = parts_for(n if own else asking.count(), n, radius)
    most = radius // parts
    turn = lambda df: df.select("code", permute(F.col("code"), order or list(range(BITS))).alias("p"))
    tables = F.array(*[F.struct(F.lit(k).alias("t"), _part(F.col("p"), k, parts).alias("s")) for k in range(parts)])
    index = turn(base).select(F.explode(tables).alias("e"), F.col("code").alias("y"), F.col("p").alias("py")).select("e.t", F.col("e.s").alias("key"), "y", "py")
    tasks = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    widths = [b - a for a, b in zip(_edges(parts), _edges(parts)[1:])]
    masks = F.element_at(F.array(*[F.array(*[F.lit(x).cast("bigint") for x in _flips(w, min(most, w))]) for w in widths]), F.col("t") + 1)
    probe = turn(asking).repartition(tasks, F.xxhash64("code")).select(F.explode(tables).alias("e"), F.col("code").alias("x"), F.col("p").alias("px")).select("e.t", "e.s", "x", "px")
    probe = probe.select("t", "s", "x", "px", F.explode(masks).alias("mask")).withColumn("key", F.col("s").bitwiseXOR(F.col("mask")))
    if own:
        probe = probe.where("key >= s")
    diff = F.col("px").bitwiseXOR(F.col("py"))
    earlier = F.lit(False)
    for k in range(parts - 1):
        earlier = earlier | ((F.col("t") > k) & (F.bit_count(_part(diff, k, parts)) <= most))
    met = probe.select("t", "key", "x", "px", "mask").join(index, ["t", "key"]).where((F.bit_count(diff) <= radius) & ~earlier)
    if not own:
        return met.select("x", "y", F.bit_count(diff).alias("distance"))
    return met.where("mask <> 0 or x < y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.bit_count(diff).alias("distance"))


def nearest_neighbours(vectors: DataFrame, k: int = 5, radius: int = 7, parts: int | None = None, sample_rows: int = 20_000) -> DataFrame:
    """The ``k`` nearest other rows within ``radius`` bits of every row: ``(id, neighbour, distance, rank)``.

    ``vectors`` has ``id bigint`` and ``code bigint`` (64 bits); ties go to the smaller id; rows with a null id or code take
    no part; repeated rows count once; an empty input gives no row. Exact: within the radius recall is 1 by the pigeonhole
    principle. Only the ``k + 1`` smallest ids of a code can be anybody's neighbours, so a code that a third of all rows
    share costs ``k + 1`` candidates; its other rows take the ``k`` smallest ids directly.
    """
    rows = cut(vectors.where("id is not null and code is not null").select("id", "code").distinct())
    w = "row_number() over (partition by code order by id)"
    heads = cut(rows.withColumn("n", F.expr(w)).where(F.col("n") <= k + 1))
    single = heads.where("n = 1").select("code")
    if parts is None:
        n = single.count()
        parts = parts_for(n, n, radius)
    pairs = near_codes(single, radius, parts, learn_bit_order(single, parts, sample_rows))
    directed = pairs.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e"), "distance").select(F.col("e.x").alias("code"), F.col("e.y").alias("other"), "distance")
    others = heads.where(F.col("n") <= k).select(F.col("code").alias("other"), F.col("id").alias("neighbour"))
    ranked = directed.join(others, "other").select("code", "neighbour", "distance").withColumn("r", F.expr("row_number() over (partition by code order by distance, neighbour)")).where(F.col("r") <= k)
    # per code at most k near rows and k+1 own rows: both lists are bounded
    near = ranked.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))
    own = heads.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("own"))
    lists = own.join(near, "code", "left").select("code", F.concat(F.transform("own", lambda i: F.struct(F.lit(0).alias("distance"), i.alias("neighbour"))), F.coalesce("near", F.expr("cast(array() as array<struct<distance:int,neighbour:bigint>>)"))).alias("all"))
    mine = F.slice(F.filter("all", lambda s: s["neighbour"] != F.col("id")), 1, k)
    return rows.join(lists, "code").select("id", F.posexplode(mine).alias("rank", "s")).select("id", F.col("s.neighbour").alias("neighbour"), F.col("s.distance").alias("distance"), (F.col("rank") + 1).alias("rank"))


def cross_split_overlap(images: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """Pairs ``(image_a, image_b, evidence, distance)`` of one training and one evaluation image that are the same or nearly so.

    ``images`` has ``image_id, split, source, pixel, code`` in normal form; ``evidence`` is ``pixel`` (distance null) or
    ``phash``; a pair with both kinds has two rows. Rows without an id or a split take no part; repeated rows count once.
    Distinct codes are matched first; images are attached afterwards, so hot codes cost output rows only.
    """
    fit, held = _sides(images)
    pixel = fit.where("pixel is not null").select("pixel", F.col("image_id").alias("t")).distinct().join(held.where("pixel is not null").select("pixel", F.col("image_id").alias("e")).distinct(), "pixel").select("t", "e", F.lit("pixel").alias("evidence"), F.lit(None).cast("int").alias("distance"))
    codes = cut(code_pairs(held, fit, radius, blocks))
    near = (
        codes.join(held.select(F.col("code").alias("x"), F.col("image_id").alias("e")).distinct(), "x")
        .join(fit.select(F.col("code").alias("y"), F.col("image_id").alias("t")).distinct(), "y")
        .select("t", "e", F.lit("phash").alias("evidence"), "distance")
    )
    both = pixel.unionByName(near).where("t <> e")
    return both.select(F.least("t", "e").alias("image_a"), F.greatest("t", "e").alias("image_b"), "evidence", "distance").distinct()


def _sides(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct training and evaluation rows of images with an id and a split."""
    known = images.where("image_id is not null and split in ('train', 'validation', 'test')")
    base = cut(known.select("image_id", "split", "source", "pixel", "code").distinct())
    return base.where("split = 'train'"), base.where("split <> 'train'")


def overlap_report(images: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """``(split, source, evidence, n_images, n_pairs)``: evaluation images with a training counterpart, and the pairs, per
    evaluation split, source and kind of evidence, without making the pairs.

    Training images are counted per pixel hash and code, and an evaluation image adds up the counts it meets, so that copies
    cost a row, not a pair each. Input as for :func:`cross_split_overlap`; an image has one row, but for repeated ones, and
    isn't its own counterpart.
    """
    fit, held = _sides(images)
    own = fit.select("image_id", F.col("pixel").alias("own_pixel"), F.col("code").alias("own_code")).distinct()
    held = held.join(own, "image_id", "left")
    per_pixel = fit.where("pixel is not null").groupBy("pixel").agg(F.countDistinct("image_id").alias("n"))
    pixel = held.join(per_pixel, "pixel").select("image_id", "split", "source", F.lit("pixel").alias("evidence"), (F.col("n") - F.coalesce((F.col("own_pixel") == F.col("pixel")).cast("int"), F.lit(0))).alias("n"))
    per_code = fit.where("code is not null").groupBy(F.col("code").alias("y")).agg(F.countDistinct("image_id").alias("n"))
    met = code_pairs(held, fit, radius, blocks).join(per_code, "y").groupBy(F.col("x").alias("code")).agg(F.sum("n").alias("n"))
    itself = F.coalesce((hamming(F.col("own_code"), F.col("code")) <= radius).cast("int"), F.lit(0))
    near = held.join(met, "code").select("image_id", "split", "source", F.lit("phash").alias("evidence"), (F.col("n") - itself).alias("n"))
    return pixel.unionByName(near).where("n > 0").groupBy("split", "source", "evidence").agg(F.countDistinct("image_id").alias("n_images"), F.sum("n").alias("n_pairs"))


# --- float vectors -----------------------------------------------------------------------------------------------------


def learn_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centre and ``(dimensions, bits)`` projection whose signs lose least of the sample: principal axes, turned until their
    signs fit best (iterative quantisation). Missing axes are filled with random ones."""
    rng = np.random.default_rng(seed)
    centre = sample.mean(0)
    x = sample - centre
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    axes = axes[:bits]
    if len(axes) < bits:
        axes = np.vstack([axes, rng.normal(size=(bits - len(axes), x.shape[1])) / np.sqrt(x.shape[1])])
    v = x @ axes.T
    turn, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return centre, axes.T @ turn


def _codes_of(x: np.ndarray, centre: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return np.packbits((x - centre) @ projection > 0, axis=1).view(">i8").ravel().astype(np.int64)


def _radius_for(sample: np.ndarray, codes: np.ndarray, k: int, recall: float, asked: int = 256) -> int:
    """The radius within which the sample's own ``k`` nearest lie, but for ``1 - recall`` of them."""
    x, distances = sample[:asked], []
    for lo in range(0, len(x), 64):
        d = ((x[lo : lo + 64, None] - sample[None]) ** 2).sum(2) if len(sample) <= 2048 else (sample**2).sum(1)[None] - 2 * x[lo : lo + 64] @ sample.T
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        near = np.argpartition(d, min(k, len(sample) - 1) - 1, axis=1)[:, :k]
        distances.append(np.bitwise_count((codes[lo : lo + len(d), None] ^ codes[near]).view(np.uint64)))
    return int(np.ceil(np.quantile(np.concatenate([x.ravel() for x in distances]), recall)))


def similar_vectors(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = 0.97, sample_rows: int = 10_000, radius: int | None = None, parts: int | None = None) -> DataFrame:
    """The ``k`` nearest other rows of ``vectors`` by Euclidean distance for every row of ``queries``:
    ``(id, neighbour, distance, rank)``; ties go to the smaller id.

    Both have ``id bigint`` and ``vector array<float>``; vectors that are null, of another length than most of the sample or
    not finite take no part; of repeated ids the rows count as they are. A rotation is learned on at most ``sample_rows``
    rows (a bounded sample by hash), every vector gets a 64-bit code and every code is indexed; multi-index hashing retrieves
    all codes within ``radius`` bits, which is learned on the same sample so that ``recall`` of its true neighbours lie
    within, and all candidates are ranked by their float vectors. Results are those of a full search but for neighbours whose
    codes lie further off. Where the sample's neighbours are spread over most of the code space (no structure), the radius
    grows and so do the candidates: then no index helps.
    """
    clean = lambda df: df.where("id is not null and vector is not null").select("id", F.col("vector").cast("array<float>").alias("vector"))
    # a bounded sample at the driver, chosen by hash
    rows = clean(vectors).orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()["vector"]
    lengths = rows.map(len)
    empty = "id bigint, neighbour bigint, distance double, rank int"
    if not len(rows) or not lengths.max():
        return vectors.sparkSession.createDataFrame([], empty)
    size = int(lengths.mode().max())
    sample = np.stack([np.asarray(v, np.float64) for v in rows[lengths == size]])
    sample = sample[np.isfinite(sample).all(1)]
    if len(sample) < 2:
        sample = np.vstack([sample, np.zeros((2 - len(sample), size))])
    centre, projection = learn_rotation(sample)
    if radius is None:
        radius = min(BITS, _radius_for(sample, _codes_of(sample, centre, projection), k, recall))

    def coded(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(1)
                ok = np.flatnonzero((pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False) == size))
                batch = batch.take(pa.array(ok))
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                fine = np.flatnonzero(np.isfinite(x).all(1))
                batch = batch.take(pa.array(fine))
                code = _codes_of(x[fine], centre, projection) if len(fine) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code)], names=["id", "vector", "code"])

        return cut(clean(df).mapInArrow(run, "id bigint, vector array<float>, code bigint"))

    every, asked = coded(vectors), coded(queries)
    pairs = near_codes(every.select("code"), radius, parts, queries=asked.select("code")).select("x", "y")
    left = pairs.join(asked.select(F.col("code").alias("x"), F.col("id"), F.col("vector").alias("a")), "x")
    both = left.join(every.select(F.col("code").alias("y"), F.col("id").alias("neighbour"), F.col("vector").alias("b")), "y").where("id <> neighbour")
    square = F.aggregate(F.zip_with("a", "b", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)
    found = both.select("id", "neighbour", F.sqrt(square).alias("distance")).distinct()
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by id order by distance, neighbour)"))
    return ranked.where(F.col("rank") <= k).select("id", "neighbour", "distance", "rank")
