"""Exact quantiles of groups of any size, without holding or ordering a group's values in one task.

Values are counted by *leaves* of equal relative width, which bracket a quantile; the bracket is counted again in 65,536 equal
parts; only the values of the parts that hold the two ranks are counted by value and ordered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from granary.session import bounded, cut

BITS = 22
#: Leaves per unit of the natural logarithm: leaves are 0.07 percent wide, and all doubles of either sign fit.
STEPS = 1440
#: Below the logarithm of the smallest positive double.
FLOOR = -744.5
ZERO = 1 << (BITS - 1)
#: Parts of a bracket.
PARTS = 1 << 16
_LARGEST = 1.7976931348623157e308


def finite(value: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return F.coalesce((value > F.lit(float("-inf"))) & (value < F.lit(float("inf"))), F.lit(False))


def leaf_of(value: Column) -> Column:
    """Leaf of a finite value, monotone in the value; zero has a leaf of its own."""
    size = F.floor((F.ln(F.abs(value)) - FLOOR) * STEPS).cast("int") + 1
    return F.when(value == 0, ZERO).when(value > 0, size + ZERO).otherwise(F.lit(ZERO) - size)


def edge(leaf: Column, upper: bool) -> Column:
    """A bound of the values of a leaf, moved outwards by far more than the logarithm's rounding."""
    size = F.abs(leaf - ZERO)
    out = F.exp((size - F.when((leaf < ZERO) == F.lit(upper), 1).otherwise(0)) / STEPS + FLOOR)
    far = F.lit(1 + 1e-9)
    wide = F.when((leaf > ZERO) == F.lit(upper), out * far).otherwise(out / far)
    return F.when(leaf == ZERO, 0.0).when(leaf > ZERO, F.least(wide, F.lit(_LARGEST))).otherwise(F.greatest(-wide, F.lit(-_LARGEST)))


def _same(keys: list[str], own: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(keys, own)])


def settle(values: DataFrame, found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, q, n, quantile)`` exactly from brackets ``found``: ``(keys, q, n, rank_lo, rank_hi, leaf_lo, leaf_hi)``.

    Quantiles lie between neighbours in proportion. Groups are told apart with nulls equal; values that aren't finite take no
    part.
    """
    own = [f"__key{i}" for i in range(len(keys))]
    named = [F.col(x).alias(y) for x, y in zip(keys, own)]
    part = ", ".join(f"`{x}`" for x in [*keys, "q"])
    asked = cut(found.select(*named, "n", "q", "rank_lo", "rank_hi", "leaf_lo", "leaf_hi", edge(F.col("leaf_lo"), False).alias("lower"), edge(F.col("leaf_hi"), True).alias("upper")))
    leaf, ranks = leaf_of(F.col("__value")), ["n", "q", "rank_lo", "rank_hi"]
    near = values.where(finite(F.col(value))).select(*keys, F.col(value).cast("double").alias("__value")).join(bounded(asked), _same(keys, own)).where(leaf <= F.col("leaf_hi"))
    width = F.col("upper") / 2 - F.col("lower") / 2
    # a bracket of zeros alone has no width
    place = F.when(width > 0, F.floor((F.col("__value") / 2 - F.col("lower") / 2) / F.when(width > 0, width) * PARTS).cast("int"))
    inside = F.greatest(F.lit(0), F.least(F.coalesce(place, F.lit(0)), F.lit(PARTS - 1)))
    near = near.select(*keys, *ranks, "__value", F.when(leaf >= F.col("leaf_lo"), inside).otherwise(-1).alias("__part"))
    counts = near.groupBy(*keys, *ranks, "__part").agg(F.count(F.lit(1)).alias("c"))
    cum = counts.withColumn("upto", F.expr(f"sum(c) over (partition by {part} order by __part)"))
    first = lambda c, r: F.min(F.when((F.col("__part") >= 0) & (F.col("upto") > F.col(r)), c))
    parts = cum.groupBy(*keys, *ranks).agg(
        first(F.col("__part"), "rank_lo").alias("part_a"), first(F.col("__part"), "rank_hi").alias("part_b"), first(F.col("upto") - F.col("c"), "rank_lo").alias("before")
    )
    parts = cut(parts.select(*named, F.col("q").alias("__q"), "part_a", "part_b", "before"))
    few = near.join(bounded(parts), _same([*keys, "q"], [*own, "__q"])).where((F.col("__part") == F.col("part_a")) | (F.col("__part") == F.col("part_b")))
    counts = few.groupBy(*keys, *ranks, "before", F.col("__value").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    cum = counts.withColumn("upto", F.col("before") + F.expr(f"sum(c) over (partition by {part} order by v)"))
    at = lambda r: F.min(F.when(F.col("upto") > F.col(r), F.col("v")))
    ends = cum.groupBy(*keys, *ranks).agg(at("rank_lo").alias("a"), at("rank_hi").alias("b"))
    return ends.select(*keys, "q", "n", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("q") * (F.col("n") - 1) - F.col("rank_lo"))).alias("quantile"))


def exact_quantiles(values: DataFrame, keys: list[str], quantiles: list[float], value: str) -> DataFrame:
    """``(keys, q, n, quantile)`` for every group and quantile, exactly as if each group were sorted.

    ``keys`` has at least one column; groups without a finite value have no row; an empty input gives none.
    """
    part = ", ".join(f"`{x}`" for x in keys)
    leaves = values.where(finite(F.col(value))).groupBy(*keys, leaf_of(F.col(value)).alias("leaf")).agg(F.count(F.lit(1)).alias("c"))
    cum = leaves.withColumn("n", F.expr(f"sum(c) over (partition by {part})")).withColumn("upto", F.expr(f"sum(c) over (partition by {part} order by leaf)"))
    asked = cum.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    asked = asked.withColumn("rank_lo", F.floor(F.col("q") * (F.col("n") - 1))).withColumn("rank_hi", F.ceil(F.col("q") * (F.col("n") - 1)))
    at = lambda r: F.min(F.when(F.col("upto") > F.col(r), F.col("leaf")))
    found = asked.groupBy(*keys, "q", "n", "rank_lo", "rank_hi").agg(at("rank_lo").alias("leaf_lo"), at("rank_hi").alias("leaf_hi"))
    return settle(values, found, keys, value)
