"""Percentiles of very large numeric columns with a deterministic error: q-digests.

Finite values of either sign are quantised to a bounded ordered universe of ``2**BITS`` leaves of equal relative width, counted
map-side, and the counts are compressed along the dyadic tree over the universe: a node whose family holds less than ``n / k``
values passes its count to its parent. Digests of partitions or days merge by adding the counts of equal nodes. A digest has
at most ``3 k`` nodes. The leaf of an answer is off by at most ``BITS * n / k`` ranks; as a leaf may hold any number of
values, answers state bounds of the value, and a bound of the rank that counts the whole leaves.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from granary.operators.quantile import BITS, edge, finite, leaf_of, settle
from granary.session import cut

COMPRESSION = 20_000


def compress(nodes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """q-digest compression, level by level from the leaves; nodes are heap numbers (root 1, leaves ``2**BITS + leaf``)."""
    limit = counts.sum() // k
    level_of = np.frexp(nodes.astype(np.float64))[1] - 1
    kept_n, kept_c = [], []
    up_n, up_c = np.empty(0, np.int64), np.empty(0, np.int64)
    for level in range(BITS, 0, -1):
        here = level_of == level
        n, inv = np.unique(np.concatenate([nodes[here], up_n]), return_inverse=True)
        c = np.bincount(inv, weights=np.concatenate([counts[here], up_c]), minlength=len(n)).astype(np.int64)
        parents, fam = np.unique(n >> 1, return_inverse=True)
        total = np.bincount(fam, weights=c, minlength=len(parents)).astype(np.int64)
        above = np.zeros(len(parents), np.int64)
        rows = np.flatnonzero(level_of == level - 1)
        if len(rows) and len(parents):
            at = np.searchsorted(parents, nodes[rows])
            ok = (at < len(parents)) & (parents[np.minimum(at, len(parents) - 1)] == nodes[rows])
            np.add.at(above, at[ok], counts[rows][ok])
        merge = total + above < limit
        stay = ~merge[fam] if len(n) else np.empty(0, bool)
        kept_n.append(n[stay])
        kept_c.append(c[stay])
        up_n, up_c = parents[merge], total[merge]
    root = level_of == 0
    if root.any() or len(up_n):
        kept_n.append(np.array([1]))
        kept_c.append(np.array([counts[root].sum() + up_c.sum()]))
    return np.concatenate(kept_n), np.concatenate(kept_c)


def _compressed(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Compresses node counts per group; a group's input is bounded by the tree, whatever the number of values."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema if f.name in keys)}, node bigint, count bigint"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n, c = compress(pdf["node"].to_numpy(np.int64), pdf["count"].to_numpy(np.int64), k)
        return pd.DataFrame({**{x: [pdf[x].iloc[0]] * len(n) for x in keys}, "node": n, "count": c})

    part = ", ".join(f"`{x}`" for x in keys)
    sized = cut(df.select(*keys, "node", "count").withColumn("__n", F.expr(f"sum(count) over (partition by {part})")))
    # below 2 k values no family is light enough to merge
    return sized.where(F.col("__n") < 2 * k).drop("__n").unionByName(sized.where(F.col("__n") >= 2 * k).drop("__n").groupBy(*keys).applyInPandas(one, schema))


def digests(values: DataFrame, keys: list[str], value: str = "value", k: int = COMPRESSION) -> DataFrame:
    """One q-digest per group as rows ``(keys, node, count)``. Invalid values (null, NaN, infinite) are left out.

    Leaf counts are aggregated before the shuffle, so a hot group sends at most one row per leaf and task. Groups without a
    valid value have no digest; null keys are a group.
    """
    leaves = values.where(finite(F.col(value))).groupBy(*keys, (leaf_of(F.col(value)).cast("bigint") + (1 << BITS)).alias("node")).agg(F.count(F.lit(1)).alias("count"))
    return _compressed(leaves, keys, k)


def merge(parts: DataFrame, keys: list[str], k: int = COMPRESSION) -> DataFrame:
    """Digests of days or partitions joined into one per ``keys`` by adding the counts of equal nodes."""
    return _compressed(parts.groupBy(*keys, "node").agg(F.sum("count").alias("count")), keys, k)


def _ranges(digest: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes as ``(keys, count, lo, hi)`` with the first and last leaf of each."""
    below = F.lit(BITS) - (F.length(F.bin("node")) - 1)
    lo = F.call_function("shiftleft", F.col("node"), below) - (1 << BITS)
    return digest.select(*keys, "count", lo.alias("lo"), (lo + F.call_function("shiftleft", F.lit(1).cast("bigint"), below) - 1).alias("hi"))


def brackets(digest: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """Certain bounds ``(keys, q, n, rank_lo, rank_hi, leaf_lo, leaf_hi)`` of the leaves that hold quantile ``q``.

    The quantile lies between the values of rank ``rank_lo`` and ``rank_hi`` (from 0). Values counted in a node lie anywhere
    in its range, so the value of rank r is at least the first ``lo`` whose nodes reach rank r when all count as early as
    possible, and at most the first ``hi`` that reaches it when all count as late as possible.
    """
    part = ", ".join(f"`{x}`" for x in keys)
    n = _ranges(digest, keys).withColumn("n", F.expr(f"sum(count) over (partition by {part})"))
    n = n.withColumn("by_lo", F.expr(f"sum(count) over (partition by {part} order by lo)")).withColumn("by_hi", F.expr(f"sum(count) over (partition by {part} order by hi)"))
    asked = n.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    asked = asked.withColumn("rank_lo", F.floor(F.col("q") * (F.col("n") - 1))).withColumn("rank_hi", F.ceil(F.col("q") * (F.col("n") - 1)))
    return asked.groupBy(*keys, "q", "n", "rank_lo", "rank_hi").agg(F.min(F.when(F.col("by_lo") > F.col("rank_lo"), F.col("lo"))).alias("leaf_lo"), F.min(F.when(F.col("by_hi") > F.col("rank_hi"), F.col("hi"))).alias("leaf_hi"))


def percentiles(digest: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """Approximate quantiles ``(keys, q, n, value, lower, upper, rank_error)`` from digests alone.

    ``lower`` and ``upper`` certainly enclose the quantile and ``value`` lies between them; ``rank_error`` certainly bounds
    the number of values between ``value`` and the quantile: all that may lie in the leaves from ``lower`` to ``upper``,
    however many one leaf holds.
    """
    own = [f"__key{i}" for i in range(len(keys))]
    b = brackets(digest, keys, quantiles).select(*[F.col(x).alias(y) for x, y in zip(keys, own)], "q", "n", "leaf_lo", "leaf_hi")
    same = reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(keys, own)])
    met = _ranges(digest, keys).join(b, same & (F.col("lo") <= F.col("leaf_hi")) & (F.col("hi") >= F.col("leaf_lo")))
    found = met.groupBy(*keys, "q", "n", "leaf_lo", "leaf_hi").agg(F.sum("count").alias("rank_error"))
    bounds = found.withColumn("lower", edge(F.col("leaf_lo"), False)).withColumn("upper", edge(F.col("leaf_hi"), True))
    return bounds.select(*keys, "q", "n", (F.col("lower") / 2 + F.col("upper") / 2).alias("value"), "lower", "upper", "rank_error")


def exact_quantile(values: DataFrame, keys: list[str], q: float, value: str = "value", digest: DataFrame | None = None, k: int = COMPRESSION) -> DataFrame:
    """``(keys, n, quantile)`` exactly, interpolated between neighbours: the digest brackets it, two more passes settle it, in
    which no task orders more than a sliver of a group."""
    found = brackets(digest if digest is not None else digests(values, keys, value, k), keys, [q])
    return settle(values, found, keys, value).drop("q")
