import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import quantiles as Q
from granary.operators import quantile as C


def test_compression_keeps_count_and_rank_error():
    rng = np.random.default_rng(1)
    leaves = rng.lognormal(5, 1.5, 50_000)
    q = np.floor((np.log(leaves) - C.FLOOR) * C.STEPS).astype(np.int64) + 1 + C.ZERO
    node, count = np.unique(q + (1 << C.BITS), return_counts=True)
    k = 200
    n, c = Q.compress(node, count, k)
    assert c.sum() == 50_000 and len(n) <= 3 * k and len(set(n.tolist())) == len(n)
    level = np.frexp(n.astype(float))[1] - 1
    lo = (n << (C.BITS - level)) - (1 << C.BITS)
    hi = lo + (1 << (C.BITS - level)) - 1
    srt = np.sort(q)
    for r in (0, 500, 25_000, 49_999):
        up = min(h for h in hi if c[hi <= h].sum() > r)
        assert srt[r] <= up and np.searchsorted(srt, up, "right") - r <= C.BITS * 50_000 / k + (srt == up).sum()


@pytest.fixture(scope="module")
def values(spark):
    r = random.Random(2)
    rows = [("a", d, r.lognormvariate(4, 1)) for d in range(5) for _ in range(700)] + [("a", 1, 50.0)] * 3000
    rows += [("b", 0, float(i)) for i in range(10)] + [("b", 0, x) for x in (None, float("nan"), float("inf"), -1.0, -250.5)] + [("c", 0, None), (None, 0, 3.0)]
    return rows, spark.createDataFrame(rows, "g string, day int, value double").cache()


@pytest.mark.parametrize("k", [50, 20_000])
def test_exact_median_from_merged_days(values, k):
    rows, df = values
    d = Q.merge(Q.digests(df, ["g", "day"], k=k), ["g"], k)
    for q in (0.5, 0.0, 1.0, 0.93):
        got = {r.g: (r.n, r.quantile) for r in Q.exact_quantile(df, ["g"], q, digest=d, k=k).collect()}
        for g in ("a", "b", None):
            v = [x for h, _, x in rows if h == g and x is not None and math.isfinite(x)]
            assert got[g][0] == len(v) and got[g][1] == pytest.approx(np.quantile(v, q), rel=1e-12)
        assert "c" not in got


def test_percentiles_enclose(values):
    rows, df = values
    v = np.sort([x for h, _, x in rows if h == "a"])
    for r in Q.percentiles(Q.digests(df, ["g"], k=100), ["g"], [0.1, 0.5, 0.99]).where("g = 'a'").collect():
        rank = r.q * (len(v) - 1)
        assert r.lower <= v[math.ceil(rank)] and v[math.floor(rank)] <= r.upper
        assert r.n == len(v) and r.lower <= r.value <= r.upper
        exact = np.quantile(v, r.q)
        assert ((v > min(r.value, exact)) & (v < max(r.value, exact))).sum() <= r.rank_error <= C.BITS * len(v) / 100 + ((v >= r.lower) & (v <= r.upper)).sum()


def test_a_million_values_in_one_leaf(spark):
    df = spark.range(1_000_000).select(F.lit("a").alias("g"), (100.03 + F.col("id") * 5e-8).alias("value")).unionByName(spark.range(10).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("value")))
    (r,) = Q.percentiles(Q.digests(df, ["g"]), ["g"], [0.5]).collect()
    v = np.sort(np.concatenate([np.arange(10.0), 100.03 + np.arange(1_000_000) * 5e-8]))
    exact = np.quantile(v, 0.5)
    assert r.lower <= exact <= r.upper and r.upper / r.lower < 1.0015
    assert ((v > min(r.value, exact)) & (v < max(r.value, exact))).sum() <= r.rank_error
    (e,) = Q.exact_quantile(df, ["g"], 0.5).collect()
    assert e.quantile == pytest.approx(exact, rel=1e-15)


def test_leaves_are_relative_and_monotone(spark):
    x = np.array([-1.7e308, -3.0, -1e-9, -5e-324, 0.0, 5e-324, 1e-300, 1e-9, 1.0001e-9, 0.5, 0.502, 1.0, 100.0, 1.7e308])
    rows = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = rows.select("v", C.leaf_of(F.col("v")).alias("leaf"), C.edge(C.leaf_of(F.col("v")), False).alias("a"), C.edge(C.leaf_of(F.col("v")), True).alias("b")).orderBy("v").collect()
    leaves = [r.leaf for r in got]
    assert leaves == sorted(leaves) and 0 < leaves[0] and leaves[-1] < 1 << C.BITS and len(set(leaves)) >= len(x) - 1
    assert all(r.a <= r.v <= r.b for r in got)


def test_empty(values):
    _, df = values
    assert Q.exact_quantile(df.limit(0), ["g"], 0.5).count() == 0
