import random
from functools import partial
from collections import defaultdict

import pytest

from granary.llm.components import canonical, prune, pruned_components, star_components
from granary.llm.queries import grouped_paths
from granary.llm.splits import assign_splits, component_ranges, related, split_conflicts


def brute(edges):
    parent = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def groups(pairs):
    g = defaultdict(set)
    for i, r in pairs:
        g[r].add(i)
    return sorted(map(sorted, g.values()))


rng = random.Random(4)
GRAPHS = {
    "empty": [],
    "dirty": [(1, 2), (2, 1), (1, 1), (None, 3), (4, None), (1, 2)],
    "ring_and_edge": [(i, (i + 1) % 7) for i in range(7)] + [(10, 11)],
    "star": [(5, i) for i in range(40) if i != 5],
    "chains_on_core": [(1, 2), (2, 3), (3, 1), (3, 10), *((i, i + 1) for i in range(10, 30)), (30, 2), (1, 50), (50, 51), *((i, i + 1) for i in range(60, 70))],
    "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(110)],
}


def strip_of_triangles(n, base):
    return [(base + i, base + i + k) for i in range(n) for k in (1, 2) if i + k < n]


GRAPHS |= {
    "rings_and_paths": [(100 + i, 100 + (i + 1) % 33) for i in range(33)] + [(200 + i, 201 + i) for i in range(50)] + [(300, 301)],
    "strip": strip_of_triangles(24, 0) + [(23, 50), (50, 51)],
    "clique": [(i, j) for i in range(8) for j in range(i)] + [(7, 20), (20, 21), (21, 3), (5, 30), (30, 31)],
    "theta": [(0, 10), (10, 11), (11, 1), (0, 20), (20, 1), (0, 30), (30, 31), (31, 32), (32, 1), (-5, 0), (-6, -5)],
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("solve", [star_components, pruned_components, partial(pruned_components, least_shrink=0.9)])
def test_components(spark, name, solve):
    edges = GRAPHS[name]
    got = solve(spark.createDataFrame(edges or [(None, None)], "a bigint, b bigint")).collect()
    want = brute(edges)
    assert len(got) == len(want) and groups((r.id, r.root) for r in got) == groups(want.items())
    assert all(r.root in want for r in got)
    if solve is star_components:
        assert {r.id: r.root for r in got} == want


def test_one_round_takes_all_light_vertices(spark):
    df = spark.createDataFrame(GRAPHS["chains_on_core"], "a bigint, b bigint")
    layer, rest, left = prune(canonical(df))
    assert left == 3
    removed = {r.child for r in layer.collect()}
    assert removed == {*range(10, 31), 50, 51, *range(61, 71)} and {tuple(r) for r in rest.collect()} == {(1, 2), (1, 3), (2, 3)}


def test_pruning_repeats_until_nothing_is_left(spark, monkeypatch):
    """A tree whose every edge is a chain of eight: each round takes the lowest generation with its chains."""
    from granary.llm import components

    edges, last = [], 1000
    for i in range(2, 64):
        path = [i // 2, *range(last, last + 7), i]
        edges, last = edges + list(zip(path, path[1:])), last + 7
    left, once = [], components.prune

    def counted(e):
        found = once(e)
        left.append(found[2])
        return found

    monkeypatch.setattr(components, "prune", counted)
    out = pruned_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    got = out.collect()
    assert len(got) == 63 + 7 * 62 and len({r.root for r in got}) == 1
    assert len(left) >= 3 and left[-1] == 0 and left == sorted(left, reverse=True)
    assert "MapInArrow" not in out._jdf.queryExecution().toString()


def test_paths_take_the_smallest_in_byte_order(spark):
    links = spark.createDataFrame([("b", "é"), ("B", "b"), ("x", "y")], "a string, b string")
    assert {tuple(r) for r in grouped_paths(links).collect()} == {("b", "B"), ("B", "B"), ("é", "B"), ("x", "x"), ("y", "x")}


ROWS = [(1, "train", "h1", "p1"), (2, "test", "h1", None), (3, None, None, "p1"), (4, "train", None, None), (5, "train", "h2", None), (5, "train", "h2", None), (6, "train", "h2", None), (None, "test", "h2", None), (7, "test", None, "p9")]


def test_related_and_conflicts(spark):
    df = spark.createDataFrame(ROWS, "id bigint, split string, sha string, piece string")
    g = related(df, ["sha", "piece"])
    assert {(r.id, r.root) for r in g.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 7)}
    assert {r.id for r in split_conflicts(df, g).collect()} == {1, 2, 3}
    assert related(df.limit(0), ["sha"]).count() == 0


def test_same_text_in_two_entities_does_not_relate(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, "x")], "id bigint, sha string, piece string")
    assert related(df, ["sha", "piece"]).where("id <> root").count() == 0


def test_splits_keep_groups_and_shares(spark):
    r = random.Random(1)
    rows = [(i, f"f{i % 2}" if i % 11 else None, f"h{r.randrange(2500)}") for i in range(6000)] + [(10_000 + i, "f0", "hot") for i in range(1500)]
    df = spark.createDataFrame(rows, "id bigint, fruit string, sha string")
    g = related(df, ["sha"])
    out = assign_splits(df, g, "fruit")
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(rows) and {x[0] for x in got} == {x[0] for x in rows}
    per = defaultdict(set)
    for _, root, split in got:
        per[root].add(split)
    assert all(len(s) == 1 for s in per.values())
    share = {s: sum(x[2] == s for x in got) / len(got) for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.77) < 0.02 and abs(share["validation"] - 0.17) < 0.02 and abs(share["test"] - 0.06) < 0.02
    assert sorted(got) == sorted(tuple(x) for x in assign_splits(df.repartition(5), g, "fruit").collect())
    assert assign_splits(df.limit(0), g.limit(0), "fruit").count() == 0


def test_stored_ranges_keep_old_components_where_they_are(spark):
    r = random.Random(5)
    make = lambda lo, hi: [(i, f"f{i % 3}", f"h{i // 3 if r.random() < 0.8 else i}") for i in range(lo, hi)]
    rows = make(0, 4000)
    old = spark.createDataFrame(rows, "id bigint, fruit string, sha string")
    new = spark.createDataFrame(rows + make(100_000, 103_000) + [(200_000, "f9", "z"), (200_001, None, None)], "id bigint, fruit string, sha string")
    g_old, g_new = related(old, ["sha"]), related(new, ["sha"])
    ranges = component_ranges(old, g_old, "fruit")
    before = {x.id: x.split for x in assign_splits(old, g_old, "fruit").collect()}
    after = {x.id: x.split for x in assign_splits(new, g_new, "fruit", ranges=ranges).collect()}
    assert len(after) == 7002 and all(after[i] == s for i, s in before.items())


def test_a_jump_takes_one_shuffle_and_the_driver_few_cuts(spark, monkeypatch):
    """What the driver holds of p1_found follows the number of shuffles and cuts."""
    from granary.llm import components as C

    cuts, once, plain = [], C.cut_and_count, C.cut
    monkeypatch.setattr(C, "cut_and_count", lambda df, **k: (cuts.append(1), once(df, **k))[1])
    monkeypatch.setattr(C, "cut", lambda df: (cuts.append(1), plain(df))[1])
    path = [(i, i + 1) for i in range(100)]
    df = spark.createDataFrame(path + [(200 + i, 200 + (i + 1) % 5) for i in range(5)], "a bigint, b bigint")
    arcs = C._arcs(plain(C._ends_of_edges(C.canonical(df))))
    plan = C._jump(arcs)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Union" not in plan
    assert groups((r.id, r.root) for r in pruned_components(df).collect()) == groups(brute(df.collect()).items())
    assert len(cuts) <= 10, len(cuts)
