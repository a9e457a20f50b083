import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm.hamming import cross_split_overlap, learn_bit_order, near_codes, nearest_neighbours, overlap_report, parts_for, permute, similar_vectors


def signed(x):
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def family(rng, n, most):
    out = []
    for _ in range(n):
        c = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        out.append(signed(c))
        for _ in range(int(rng.integers(0, 5))):
            d = c
            for b in rng.choice(64, int(rng.integers(0, most + 1)), replace=False):
                d ^= 1 << int(b)
            out.append(signed(d))
    return out


def ham(x, y):
    return bin((x ^ y) & ((1 << 64) - 1)).count("1")


def test_permutation_keeps_distances(spark):
    rng = np.random.default_rng(2)
    codes = family(rng, 30, 9)
    df = spark.createDataFrame([(c,) for c in codes], "code bigint")
    order = learn_bit_order(df)
    assert sorted(order) == list(range(64))
    p = [r[0] for r in df.select(permute(F.col("code"), order)).collect()]
    assert all(ham(codes[i], codes[j]) == ham(p[i], p[j]) for i in range(len(codes)) for j in range(i))
    assert learn_bit_order(df.limit(0)) == list(range(64))


def test_near_codes_finds_every_pair_once(spark):
    rng = np.random.default_rng(3)
    codes = family(rng, 60, 8)
    df = spark.createDataFrame([(c,) for c in codes] + [(None,)], "code bigint")
    order = learn_bit_order(df.where("code is not null"))
    for o, parts in ((None, 4), (order, 4), (order, 3), (None, 2), (None, None), (None, 8)):
        got = [tuple(r) for r in near_codes(df, 7, parts, o).collect()]
        u = sorted(set(codes))
        assert len(got) == len(set(got))
        assert set(got) == {(x, y, ham(x, y)) for i, x in enumerate(u) for y in u[i + 1 :] if ham(x, y) <= 7}
    asked = df.where("code is not null").limit(20)
    q = {r.code for r in asked.collect()}
    got = [tuple(r) for r in near_codes(df, 9, None, order, asked).collect()]
    assert len(got) == len(set(got)) and set(got) == {(x, y, ham(x, y)) for x in q for y in u if ham(x, y) <= 9}


def test_substrings_grow_with_the_codes():
    assert [parts_for(n, n, 7) for n in (10**5, 10**8, 10**10)] == [4, 3, 2]


@pytest.mark.parametrize("size", [16, 100])
def test_similar_vectors_against_a_full_search(spark, size):
    rng = np.random.default_rng(size)
    x = np.repeat(rng.normal(size=(150, size)), 8, 0) + 0.15 * rng.normal(size=(1200, size))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    dirty = [(5000, None), (None, rows[0][1]), (5001, []), (5002, [1.0]), (5003, [float("nan")] * size), (5004, rows[3][1])]
    df = spark.createDataFrame(rows + dirty, "id bigint, vector array<float>")
    got = {}
    for r in similar_vectors(df, df.where("id % 20 = 0")).collect():
        got.setdefault(r.id, {})[r.rank] = (r.neighbour, r.distance)
    y = np.vstack([x, x[3]]).astype(np.float32)
    ids = [*range(1200), 5004]
    hits = total = 0
    for i in range(0, 1200, 20):
        d = np.sqrt(((y.astype(float) - y[i].astype(float)) ** 2).sum(1))
        want = [ids[j] for j in sorted(range(len(ids)), key=lambda j: (d[j], ids[j])) if j != i][:5]
        hits += len(set(want) & {n for n, _ in got.get(i, {}).values()})
        total += 5
    assert hits / total >= 0.9
    assert similar_vectors(df.limit(0), df).count() == 0


@pytest.mark.parametrize("copies", [0, 3, 40])
def test_nearest_neighbours_against_brute_force(spark, copies):
    rng = np.random.default_rng(copies)
    codes = family(rng, 40, 8)
    rows = [(i * 3, c) for i, c in enumerate(codes)] + [(1000 + i, codes[0]) for i in range(copies)]
    df = spark.createDataFrame(rows + rows[:5] + [(None, 5), (7777, None)], "id bigint, code bigint")
    got = {}
    for r in nearest_neighbours(df).collect():
        got.setdefault(r.id, []).append((r.rank, r.distance, r.neighbour))
    for i, c in rows:
        want = sorted((ham(c, d), j) for j, d in rows if j != i and ham(c, d) <= 7)[:5]
        assert [(d, n) for _, d, n in sorted(got.get(i, []))] == want
    assert nearest_neighbours(df.limit(0)).count() == 0


def test_cross_split_overlap(spark):
    rng = np.random.default_rng(9)
    codes = family(rng, 50, 6)
    splits = ["train", "test", "validation", None]
    rows = [(i, splits[int(rng.integers(0, 4))], "s", f"p{int(rng.integers(0, 60))}" if i % 3 else None, c if i % 5 else None) for i, c in enumerate(codes)]
    df = spark.createDataFrame(rows + rows[:10] + [(None, "train", "s", "p1", codes[0])], "image_id bigint, split string, source string, pixel string, code bigint")
    got = {(r.image_a, r.image_b) for r in cross_split_overlap(df).select("image_a", "image_b").collect()}
    want = set()
    for a in rows:
        for b in rows:
            if a[1] == "train" and b[1] in ("test", "validation") and (a[3] and a[3] == b[3] or a[4] is not None and b[4] is not None and ham(a[4], b[4]) <= 4):
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert got == want and want
    assert cross_split_overlap(df.limit(0)).count() == 0


def test_overlap_report_counts_the_pairs(spark):
    rng = np.random.default_rng(4)
    codes = family(rng, 40, 5)
    rows = [(i, ["train", "test", "validation"][i % 3], ["s", None, "u"][i % 7 % 3], f"p{int(rng.integers(0, 20))}" if i % 4 else None, c if i % 5 else None) for i, c in enumerate(codes)]
    rows += [(1000 + i, "train" if i % 2 else "test", "hot", "same", codes[1]) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:9], "image_id bigint, split string, source string, pixel string, code bigint")
    where = {r[0]: (r[1], r[2]) for r in rows}
    want = {}
    for r in cross_split_overlap(df).collect():
        e = r.image_b if where[r.image_a][0] == "train" else r.image_a
        want.setdefault((*where[e], r.evidence), []).append(e)
    got = {(r.split, r.source, r.evidence): (r.n_images, r.n_pairs) for r in overlap_report(df).collect()}
    assert got == {k: (len(set(v)), len(v)) for k, v in want.items()} and len(got) > 5
    assert overlap_report(df.limit(0)).count() == 0
