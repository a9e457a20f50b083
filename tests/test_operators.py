import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import duplicates, metrics, neardup, splits, stats
from granary.schemas import MANIFEST, conform, require_columns
from granary.session import bounded
from granary.streaming.throttle import keep, latest_frames, throttle, throttle_stream


def test_duplicate_groups(spark):
    df = spark.createDataFrame([("a", "train", "apple", "ripe", "x"), ("b", "test", "apple", "unripe", "x"), ("c", "train", "mango", "ripe", "y"), ("d", "train", "mango", "ripe", None), ("e", "train", "mango", "ripe", None), ("f", None, None, None, "z"), ("g", None, None, None, "z")], "path string, split string, fruit string, stage string, h string")
    g = {r.key: r for r in duplicates.duplicate_groups(df, "h", "split", ["fruit", "stage"], "path").collect()}
    assert set(g) == {"x", "z"} and g["x"].cross_split and g["x"].conflicting_labels and g["x"].n == 2 and g["x"].first == "a"
    assert not g["z"].cross_split and not g["z"].conflicting_labels
    s = duplicates.audit_summary(duplicates.duplicate_groups(df.limit(0), "h", "split", ["fruit"], "path")).first()
    assert tuple(s) == (0, 0, 0, 0)
    assert duplicates.duplicate_members(df, "h", "path").count() == 4


@pytest.mark.parametrize("radius", [0, 2, 4, 8])
def test_code_pairs_against_brute_force(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(-(1 << 63), 1 << 63, 40, dtype=np.int64)
    codes = [int(x) for x in base]
    for x in base:
        for n in (1, 3, 4, 5, 8):
            y = int(x) & ((1 << 64) - 1)
            for b in rng.choice(64, n, replace=False):
                y ^= 1 << int(b)
            codes.append(y - (1 << 64) if y >> 63 else y)
    df = spark.createDataFrame([(c,) for c in codes] + [(None,), (codes[0],)], "code bigint")
    got = [(r.x, r.y, r.distance) for r in neardup.code_pairs(df, df, radius, max(6, radius + 1)).collect()]
    u = sorted(set(codes))
    want = {(x, y, bin((x ^ y) & ((1 << 64) - 1)).count("1")) for x in u for y in u}
    assert len(got) == len(set(got)) and set(got) == {w for w in want if w[2] <= radius}


def test_near_duplicates_report_classes(spark):
    df = spark.createDataFrame([("a", 0b1, "p", "train", "x"), ("b", 0b1, "p", "test", "x"), ("c", 0b11, "q", "test", "y"), ("d", None, "r", "test", "y"), ("e", 0b111, "p", "train", "x")], "path string, code bigint, px string, split string, l string")
    got = {(r.path_a, r.path_b, r.distance, r.cross_split, r.conflicting_labels) for r in neardup.near_duplicates(df, "path", "code", "px", "split", ["l"], 1).collect()}
    assert got == {("a", "c", 1, True, True), ("c", "e", 1, True, True)}
    assert {(r.path, r.class_path, r.class_size) for r in neardup.copy_classes(df, "path", "code", "px").collect()} == {("a", "a", 2), ("b", "a", 2), ("c", "c", 1), ("e", "e", 1)}
    with pytest.raises(ValueError):
        neardup.near_duplicates(df, "path", "code", "px", "split", [], 9)


def test_confusion_and_metrics(spark):
    df = spark.createDataFrame([("m", "apple", "unripe", "ripe"), ("m", "apple", "ripe", "ripe"), ("m", "mango", "overripe", "overripe"), ("m", "mango", "x", "ripe"), ("m", "mango", None, "ripe")], "method string, fruit string, t string, p string")
    c = {r.t: (r.unripe, r.ripe, r.overripe) for r in metrics.confusion(df, "t", "p", by=("method",)).collect()}
    assert c == {"unripe": (0, 1, 0), "ripe": (0, 1, 0), "overripe": (0, 0, 1)}
    m = {r.scope: r for r in metrics.metrics(df, "t", "p", ("method",), "fruit").collect()}
    assert m["overall"].accuracy == pytest.approx(2 / 3) and m["overall"].n_images == 3
    assert m["mango"].balanced_accuracy == 1.0 and m["mango"].macro_recall == pytest.approx(1 / 3)
    assert metrics.metrics(df.limit(0), "t", "p", ("method",), "fruit").count() == 0
    assert {r.label: r.support for r in metrics.per_class(df, "t", "p", ("method",)).collect()} == {"unripe": 1, "ripe": 1, "overripe": 1}


def test_epoch_rules(spark):
    h = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), ("a", 3, 0.7), ("a", 4, 0.6), ("a", 5, 0.9), ("b", 1, 0.1)], "k string, e int, s double")
    assert {r.k: (r.best_score, r.best_epoch) for r in metrics.best_epoch(h, ("k",), "e", "s").collect()} == {"a": (0.9, 5), "b": (0.1, 1)}
    assert {r.k: r.stopped_epoch for r in metrics.stopped_epoch(h, ("k",), "e", "s", 2).collect()} == {"a": 4, "b": 1}


def test_compatibility_counts_nulls(spark):
    r = spark.createDataFrame([("a", 1, "s"), ("a", 2, None), ("b", 1, None), ("b", 1, None)], "g string, x int, y string")
    got = {x.g: (x.n_runs, x.same_x, x.same_y, x.compatible) for x in metrics.compatible(r, ("g",), ("x", "y")).collect()}
    assert got == {"a": (2, False, False, False), "b": (2, True, True, True)}


def test_stratified_split_is_stable_and_complete(spark):
    rows = [(i, f"f{i % 3}", None if i % 7 == 0 else "s", "train" if i % 5 else "test") for i in range(500)]
    df = spark.createDataFrame(rows, "id int, fruit string, stage string, src string")
    split = lambda d: {(r.id, r.split) for r in splits.stratified_split(d, ["fruit", "stage"], "id", eligible=F.col("src") == "train").select("id", "split").collect()}
    one = split(df)
    assert one == split(df.repartition(7).orderBy(F.desc("id"))) and len(one) == 500
    assert {i for i, s in one if s == "test"} == {i for i in range(500) if i % 5 == 0}
    train = [r for r in rows if r[3] == "train"]
    for key in {(r[1], r[2]) for r in train}:
        ids = {r[0] for r in train if (r[1], r[2]) == key}
        n = sum(1 for i, s in one if i in ids and s == "validation")
        assert n == max(1, int(len(ids) * 0.2 + 0.5))


def test_guards(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "i int, h string")
    assert {(r.i, r.blocked) for r in splits.holdout_guard(a, a.where("i <> 2"), "h").collect()} == {(1, True), (2, False), (3, False)}
    assert splits.manifest_difference(a, a.orderBy(F.desc("i"))).count() == 0
    assert splits.manifest_difference(a, a.union(a.where("i = 1"))).select("i", "side").collect() == [(1, "right")]
    assert {tuple(r) for r in splits.changed_content(a.where("i = 1"), a.withColumn("h", F.lit("x")), "i", "h").collect()} == {(2, "missing"), (3, "missing")}
    with pytest.raises(Exception, match="outside"):
        splits.require_split(a, {"h": ("x",)}).collect()
    f = lambda d: tuple(splits.fingerprint(d, ["i", "h"]).first())
    assert f(a) == f(a.repartition(3)) != f(a.where("i < 3")) and f(a.limit(0)) == (0, "0")


def test_previews(spark):
    rows = [("z", "apple", "ripe", False), ("a", "apple", "ripe", False), ("b", "apple", "ripe", False), ("c", "apple", "ripe", False), ("d", "apple", "ripe", True), ("e", "apple", "ripe", False)]
    df = spark.createDataFrame(rows, "path string, fruit string, stage string, ok boolean")
    got = {(r.path, r.selection) for r in splits.previews(df, ["fruit", "stage"], "path", "ok").collect()}
    assert got == {("a", "first_per_fruit_stage"), ("b", "additional_failure"), ("c", "additional_failure"), ("e", "additional_failure")}


def test_statistics(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 256, 400)
    h = spark.createDataFrame([("k", int(x)) for x in v], "k string, b bigint").groupBy("k", "b").agg(F.count(F.lit(1)).alias("n"))
    best = max(range(255), key=lambda t: (v <= t).mean() * (v > t).mean() * (v[v <= t].mean() - v[v > t].mean()) ** 2 if (v <= t).any() and (v > t).any() else -1)
    assert stats.otsu_thresholds(h, "k", "b").first().threshold == best
    one = spark.createDataFrame([("k", 5, 3)], "k string, b bigint, n bigint")
    assert stats.otsu_thresholds(one, "k", "b").count() == 0
    flat = spark.createDataFrame([("k", 7.0), ("k", 7.0), ("k", None)], "k string, v double")
    assert sorted([r.stretched for r in stats.percentile_stretch(flat, "k", "v").collect()], key=str) == [7, 7, None]
    assert sorted([r.z for r in stats.robust_z(flat, "k", "v").collect()], key=str) == [0.0, 0.0, None]
    e = stats.aggregate_objects(spark.createDataFrame([(1,), (2,), (3,)], "i int"), spark.createDataFrame([(1, 2, "ripe", "b", 0.5, 1.0), (1, 1, "ripe", "a", 0.7, 2.0), (2, 1, "ripe", "a", 0.1, 1.0), (2, 2, "unripe", "c", 0.3, 1.0)], "i int, o int, stage string, fruit string, s double, ms double"), "i", "o", "stage", "fruit", ["s"], ["ms"])
    assert {tuple(r) for r in e.collect()} == {(1, 2, "ripe", 0.6, 3.0, "a, b", "per-fruit"), (2, 2, "mixed", 0.2, 2.0, "a, c", "per-fruit"), (3, 0, "none", 0.0, 0.0, "", "no-supported-fruit")}


def test_contracts(spark):
    df = spark.createDataFrame([("p", 1)], "path string, extra int")
    assert conform(df, MANIFEST).columns == list(MANIFEST)
    with pytest.raises(ValueError, match="unexpected"):
        require_columns(df, MANIFEST)
    assert "broadcast" in bounded(df)._jdf.queryExecution().analyzed().toString() and "broadcast" not in bounded(df, 1)._jdf.queryExecution().analyzed().toString()


def test_throttle_batch_and_stream_agree(spark, tmp_path):
    rng = np.random.default_rng(5)
    t0 = dt.datetime(2026, 1, 1)
    rows = [(i, int(rng.integers(0, 6)), t0 + dt.timedelta(milliseconds=int(x))) for i, x in enumerate(rng.integers(0, 20_000, 400))] + [(900, None, t0), (901, 1, None)]
    df = spark.createDataFrame(rows, "id long, u long, ts timestamp")
    got = {r.id for r in throttle(df, "u", "ts", "id", 0.35).collect()}
    want, last = set(), {}
    for i, u, t in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[2], r[0])):
        if u not in last or t - last[u] >= dt.timedelta(seconds=0.35):
            last[u] = t
            want.add(i)
    assert got == want
    df.orderBy("ts", "id").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = throttle_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "u", "ts", 0.35).writeStream.format("memory").queryName("throttled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    s = [(r.u, r.ts) for r in spark.table("throttled").collect()]
    assert sorted(s) == sorted((r[1], r[2]) for r in rows if r[0] in want)
    assert throttle(df.limit(0), "u", "ts", "id").count() == 0
    with pytest.raises(ValueError):
        throttle(df, "u", "ts", "id", -1)
    assert keep(np.array([0, 1, 5, 9]), 5, None)[0].tolist() == [True, False, True, False]
    assert {(r.u, r.id) for r in latest_frames(df.where("u is not null and ts is not null"), "u", "ts").select("u", "id").collect()} == {(u, max((r for r in rows if r[1] == u and r[2]), key=lambda r: (r[2]))[0]) for u in {r[1] for r in rows if r[1] is not None}}


def test_exact_quantiles_of_any_group(spark):
    import numpy as np

    from granary.operators.quantile import exact_quantiles

    rng = np.random.default_rng(3)
    groups = {"zeros": [0.0] * 9, "one": [-4.5], "mixed": [*rng.normal(0, 3, 300), *[0.0] * 40, *[2.5] * 70], "wide": [-1.7e308, -1e-300, 0.0, 1e-300, 3.0, 1.7e308], None: [1.0, 2.0], "bits": [0.0] * 5 + [1.0] * 5}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("mixed", None), ("mixed", float("nan")), ("none", None), ("none", float("inf"))]
    got = {(r.g, r.q): (r.n, r.quantile) for r in exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], [0.0, 0.25, 0.5, 0.98, 1.0], "x").collect()}
    assert {g for g, _ in got} == set(groups)
    for g, v in groups.items():
        for q in (0.0, 0.25, 0.5, 0.98, 1.0):
            assert got[g, q][0] == len(v) and (got[g, q][1] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-300) or g == "wide")
    assert exact_quantiles(spark.createDataFrame([], "g string, x double"), ["g"], [0.5], "x").count() == 0
