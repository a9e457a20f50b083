"""Near duplicates by Hamming distance of 64-bit perceptual hashes."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, functions as F

from granary.session import cut

BITS = 64
#: Pairs of codes that are tested in the time in which one row is shuffled and sorted.
ROW = 50


def blocks_for(left: int, right: int, radius: int) -> int:
    """The number of blocks that costs least for so many distinct codes a side: each of the tables holds every code, and
    evenly spread codes meet by chance in the more pairs the shorter the key is. A row that is shuffled and sorted costs as
    much as testing :data:`ROW` pairs. Keys thus grow with the data: at radius 4 it is 6 blocks (21 bits) up to some three
    hundred million codes, then 7 (27 bits), so that chance pairs stay in proportion to the codes."""
    def cost(b: int) -> float:
        return comb(b, radius) * (ROW * (left + right) + left * right / 2.0 ** (BITS * (b - radius) / b))

    return min(range(radius + 1, min(16, radius + 6) + 1), key=cost)


def code_pairs(left: DataFrame, right: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """All pairs ``(x, y, distance)`` of a code of ``left`` and one of ``right`` within ``radius`` bits.

    Codes are cut into ``blocks`` blocks; at most ``radius`` of them differ, so the others agree: one table for each choice
    of ``blocks - radius`` blocks is joined on these blocks. Without ``blocks`` the sides are counted and :func:`blocks_for`
    chooses. A pair counts in the first table whose blocks agree, so none comes twice. Inputs need a ``code`` column; nulls
    are ignored.
    """
    if blocks is None:
        blocks = blocks_for(left.count(), right.count(), radius)
    if not 0 <= radius < blocks <= 16:
        raise ValueError("radius must be below the number of blocks")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), blocks - radius))

    def block(c: Column, b: int) -> Column:
        return F.shiftrightunsigned(c, edges[b]).bitwiseAND(F.lit((1 << (edges[b + 1] - edges[b])) - 1).cast("bigint"))

    def key(c: Column, chosen: tuple[int, ...]) -> Column:
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        return c.bitwiseAND(F.lit(mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask).cast("bigint"))

    def tabled(df: DataFrame, name: str) -> DataFrame:
        distinct = df.where("code is not null").select(F.col("code").alias(name)).distinct()
        return distinct.select(name, F.explode(F.array(*[F.struct(F.lit(t).alias("t"), key(F.col(name), chosen).alias("key")) for t, chosen in enumerate(choices)])).alias("e")).select(name, "e.t", "e.key")

    diff = F.col("x").bitwiseXOR(F.col("y"))
    first = F.lit(False)
    for t, chosen in enumerate(choices):
        clear = F.lit(True)
        for b in range(max(chosen)):
            if b not in chosen:
                clear = clear & (block(diff, b) != 0)
        first = first | ((F.col("t") == t) & clear)
    return tabled(left, "x").join(tabled(right, "y"), ["t", "key"]).where((F.bit_count(diff) <= radius) & first).select("x", "y", F.bit_count(diff).alias("distance"))


def copy_classes(rows: DataFrame, path: str, code: str, pixels: str) -> DataFrame:
    """``rows`` with ``class_path`` and ``class_size``: the smallest path and the number of rows with equal hash and pixels.

    Rows without either take no part.
    """
    ok = rows.where(F.col(code).isNotNull() & F.col(pixels).isNotNull())
    return ok.join(ok.groupBy(code, pixels).agg(F.min(path).alias("class_path"), F.count(F.lit(1)).alias("class_size")), [code, pixels])


def near_duplicates(rows: DataFrame, path: str, code: str, pixels: str, split: str, label: list[str], radius: int = 4, blocks: int | None = None) -> DataFrame:
    """Pairs ``(path_a, path_b, distance, cross_split, conflicting_labels)`` of class representatives, ``path_a < path_b``.

    Rows of equal hash and pixels form a class that its smallest path represents (:func:`copy_classes` gives membership), so
    copies aren't expanded; pairs with equal pixels are exact duplicates and left out. ``radius`` is 0 to 8.
    """
    if not 0 <= radius <= 8:
        raise ValueError("the distance must be 0 to 8")
    ok = rows.where(F.col(code).isNotNull() & F.col(pixels).isNotNull())
    reps = cut(ok.groupBy(F.col(code).alias("code"), F.col(pixels).alias("px")).agg(F.min_by(F.struct(F.col(path).alias("path"), F.col(split).alias("split"), *[F.col(x).alias(f"l{i}") for i, x in enumerate(label)]), path).alias("r")).select("code", "px", "r.*"))
    pairs = code_pairs(reps.select("code"), reps.select("code"), radius, blocks)
    side = lambda c, p: reps.select(F.col("code").alias(c), *[F.col(x).alias(f"{p}_{x}") for x in ("px", "path", "split", *[f"l{i}" for i in range(len(label))])])
    j = pairs.join(side("x", "a"), "x").join(side("y", "b"), "y").where("a_path < b_path and a_px <> b_px")
    conflict = F.lit(False)
    for i in range(len(label)):
        conflict = conflict | ~F.col(f"a_l{i}").eqNullSafe(F.col(f"b_l{i}"))
    return j.select(F.col("a_path").alias("path_a"), F.col("b_path").alias("path_b"), F.col("distance").cast("int").alias("distance"), (~F.col("a_split").eqNullSafe(F.col("b_split"))).alias("cross_split"), conflict.alias("conflicting_labels"))
