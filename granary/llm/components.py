"""Connected components at scale, by two methods that share one contract.

Input: edges ``(a bigint, b bigint)``; null ends, loops and repeats are ignored. Output: one row ``(id, root)`` for every
vertex with at least one edge; all vertices of a component carry the same ``root``, which is one of them.

* :func:`star_components` - alternating large-star and small-star steps; ``root`` is the smallest id.
* :func:`pruned_components` - strips degree-one vertices and compresses degree-two chains by list ranking, again and again,
  solves the reduced core with the star steps and restores labels to the removed vertices, layer by layer.

Hot vertices: degrees and minima are aggregated map-side; which edges go is decided by grouping on the *pair*, never on a
vertex; what must join on a vertex has a unique small side, so adaptive execution can split the hot partition. Every step is
cut with a reliable checkpoint, and superseded ones are removed. No ids, edges or labels reach the driver, only counts: joins
are sort-merge joins by hint, since a broadcast of every shrinking edge set would pass through the driver. What the driver
holds grows with the number of shuffles and cuts, so a step takes as few of them as it can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from granary.session import cut, cut_and_count, release


def canonical(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges with ``a < b``; null ends and loops are dropped."""
    return (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _both_ways(edges: DataFrame) -> DataFrame:
    ways = F.array(
        F.struct(F.col("a").alias("v"), F.col("b").alias("n")),
        F.struct(F.col("b").alias("v"), F.col("a").alias("n")),
    )
    return edges.select(F.explode(ways).alias("e")).select("e.v", "e.n")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the smallest member of its neighbourhood."""
    sym = _both_ways(edges)
    least = sym.groupBy("v").agg(F.min("n").alias("m")).select("v", F.least("v", "m").alias("m"))
    linked = sym.where("n > v").join(least.hint("merge"), "v")
    return linked.select(F.col("m").alias("a"), F.col("n").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the smallest of these. Edges may repeat, until the next large star; stars have no repeats."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    own = least.select(F.col("m").alias("a"), "b")
    others = edges.join(least.hint("merge"), "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return own.unionByName(others)


def _cut_edges(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges cut, with their number and an order-free checksum, to see whether a step changed anything."""
    done, r = cut_and_count(edges, n=F.count(F.lit(1)), h=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    return done, (r["n"], int(r["h"] or 0))


def star_components(edges: DataFrame) -> DataFrame:
    """Components by alternating large-star and small-star; ``root`` is the smallest id of the component.

    An empty input gives an empty result. Every edge set is checkpointed, and the loop ends when a whole round leaves the
    edges as they were, which is when they form one star around each smallest vertex.
    """
    return _stars(*_cut_edges(canonical(edges)))


def _stars(now: DataFrame, state: tuple[int, int | None]) -> DataFrame:
    """:func:`star_components` of canonical edges that have been cut, which are released, with their number and checksum if known."""
    while state[0]:
        before, last = state, now
        now, state = _cut_edges(_small_star(_large_star(now)))
        release(last)
        if state == before:
            break
    members = F.array(
        F.struct(F.col("b").alias("id"), F.col("a").alias("root")),
        F.struct(F.col("a").alias("id"), F.col("a").alias("root")),
    )
    return now.select(F.explode(members).alias("s")).select("s.id", "s.root").distinct()


# A vertex of degree one or two is light. Light vertices form paths: pending ones that end at a leaf, chains between two
# heavy vertices, whole components, and rings. One list ranking per round finds the ends of all of them.


def _ends_of_edges(edges: DataFrame) -> DataFrame:
    """Edges with what is known of their ends: ``(a, b, da, oa, db, ob)``; ``d`` is 1 or 2 for a light end and null for a
    heavy one, ``o`` the other neighbour of an end of degree two."""
    degrees = _both_ways(edges).groupBy("v").agg(
        F.count(F.lit(1)).alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi")
    )
    none = F.lit(None).cast("bigint")
    links = F.when(F.col("d") == 1, F.array(F.struct(F.col("lo").alias("n"), none.alias("o")))).otherwise(
        F.array(F.struct(F.col("lo").alias("n"), F.col("hi").alias("o")), F.struct(F.col("hi").alias("n"), F.col("lo").alias("o")))
    )
    light = degrees.where("d <= 2").select("v", "d", F.explode(links).alias("l"))
    first, second = F.col("v") < F.col("l.n"), F.col("v") > F.col("l.n")
    seen = light.select(
        F.least("v", "l.n").alias("a"), F.greatest("v", "l.n").alias("b"),
        F.when(first, F.col("d")).alias("da"), F.when(first, F.col("l.o")).alias("oa"),
        F.when(second, F.col("d")).alias("db"), F.when(second, F.col("l.o")).alias("ob"),
    )
    plain = edges.select("a", "b", *[none.alias(c) for c in ("da", "oa", "db", "ob")])
    return plain.unionByName(seen).groupBy("a", "b").agg(*[F.max(c).alias(c) for c in ("da", "oa", "db", "ob")])


def _arcs(ends: DataFrame) -> DataFrame:
    """Arcs ``(v, h, pv, ph, end, leaf, m)`` out of light vertices ``v`` to a neighbour ``h``: either ``end``, the vertex
    behind the last of the path (``leaf``: it is the last one itself, of degree one), or the arc ``pv -> ph`` to go on with.
    ``m`` is the smallest vertex passed so far."""
    def arc(v: str, h: str, d: str, o: str) -> Column:
        return F.struct(
            F.col(v).alias("v"), F.col(h).alias("h"),
            F.when(F.col(d) == 2, F.col(h)).alias("pv"), F.when(F.col(d) == 2, F.col(o)).alias("ph"),
            F.when(F.col(d).isNull() | (F.col(d) == 1), F.col(h)).alias("end"), F.coalesce(F.col(d) == 1, F.lit(False)).alias("leaf"),
            F.col(v).alias("m"),
        )

    both = F.array(
        F.when(F.col("da").isNotNull(), arc("a", "b", "db", "ob")), F.when(F.col("db").isNotNull(), arc("b", "a", "da", "oa"))
    )
    return ends.where("da is not null or db is not null").select(F.explode(F.array_compact(both)).alias("s")).select("s.*")


def _jump(arcs: DataFrame) -> DataFrame:
    """One round of pointer jumping: an open arc takes over what the arc it points to knows.

    At most one arc points to another, so that asking and asked arc meet in one group of at most two, by a single shuffle.
    """
    none, no = F.lit(None).cast("bigint"), F.lit(None).cast("boolean")
    asked = F.struct(F.col("v").alias("x"), F.col("h").alias("y"), "pv", "ph", "end", "leaf", "m", none.alias("rv"), none.alias("rh"), none.alias("rm"))
    asks = F.struct(F.col("pv").alias("x"), F.col("ph").alias("y"), none.alias("pv"), none.alias("ph"), none.alias("end"), no.alias("leaf"), none.alias("m"), F.col("v").alias("rv"), F.col("h").alias("rh"), F.col("m").alias("rm"))
    both = arcs.select(F.explode(F.array_compact(F.array(asked, F.when(F.col("end").isNull(), asks)))).alias("s")).select("s.*")
    met = both.groupBy("x", "y").agg(*[F.max(c).alias(c) for c in ("pv", "ph", "end", "leaf", "m", "rv", "rh", "rm")])
    done = F.when(F.col("end").isNotNull(), F.struct(F.col("x").alias("v"), F.col("y").alias("h"), "pv", "ph", "end", "leaf", "m"))
    moved = F.when(F.col("rv").isNotNull(), F.struct(F.col("rv").alias("v"), F.col("rh").alias("h"), "pv", "ph", "end", "leaf", F.least("m", "rm").alias("m")))
    return met.select(F.explode(F.array_compact(F.array(done, moved))).alias("s")).select("s.*")


def _cut_ends(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """:func:`_ends_of_edges` cut, with the number of their arcs that don't know their end yet, and the sum of these arcs' vertices."""
    first, second = F.col("da").isNotNull() & (F.col("db") == 2), F.col("db").isNotNull() & (F.col("da") == 2)
    left = F.when(first, F.col("a")).otherwise(0).cast("decimal(38,0)") + F.when(second, F.col("b")).otherwise(0).cast("decimal(38,0)")
    done, r = cut_and_count(_ends_of_edges(edges), n=F.count_if(first) + F.count_if(second), s=F.sum(left))
    return done, (r["n"], int(r["s"] or 0))


def _cut_arcs(arcs: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The arcs cut, with the number of those that don't know their end yet, and the sum of their smallest vertices."""
    left = F.when(F.col("end").isNull(), F.col("m")).cast("decimal(38,0)")
    done, r = cut_and_count(arcs, n=F.count_if(F.col("end").isNull()), s=F.sum(left))
    return done, (r["n"], int(r["s"] or 0))


def _rank(ends: DataFrame, left: tuple[int, int]) -> DataFrame:
    """All arcs with their ends, by pointer jumping, which doubles the reach of every arc per round; two rounds go into a cut.

    Arcs on rings never end. Once only such arcs are left and a round changes none of their smallest vertices, each knows
    the smallest of its ring: a window that twice its length doesn't better has met all of the ring.
    """
    arcs = _arcs(ends)
    while left[0]:
        before, last = left, arcs
        arcs, left = _cut_arcs(_jump(_jump(arcs)))
        release(last)
        if left == before:
            break
    return arcs


def prune(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """One round: the light vertices as ``(child, parent)``, the edges left and their number, with one for every chain between two
    different heavy vertices. A parent is a heavy end of the path; of a path without one, the smaller of its two leaves; of
    a ring, its smallest vertex. The last two are no children themselves."""
    ends, open_arcs = _cut_ends(edges)
    arcs = _rank(ends, open_arcs)
    heavy = F.when(F.col("end").isNotNull() & ~F.col("leaf"), F.col("end"))
    paths = arcs.groupBy("v").agg(
        F.count(F.lit(1)).alias("d"), F.min(heavy).alias("lo"), F.max(heavy).alias("hi"), F.count(heavy).alias("n"),
        F.min("end").alias("leaf"), F.min("m").alias("ring"),
    )
    alone = F.when(F.col("leaf").isNull(), F.col("ring")).when(F.col("d") == 1, F.least("v", "leaf")).otherwise(F.col("leaf"))
    paths = cut(paths.select("v", F.coalesce("lo", alone).alias("parent"), F.when((F.col("n") == 2) & (F.col("lo") < F.col("hi")), F.col("hi")).alias("other")))
    release(arcs)
    new = paths.where("other is not null").select(F.col("parent").alias("a"), F.col("other").alias("b"))
    rest, (left, _) = _cut_edges(ends.where("da is null and db is null").select("a", "b").unionByName(new).distinct())
    release(ends)
    return paths.where("v <> parent").select(F.col("v").alias("child"), "parent"), rest, left


def pruned_components(edges: DataFrame, least_shrink: float = 0.05) -> DataFrame:
    """Components by rounds of :func:`prune` until no edge is left or a round removes less than ``least_shrink`` of them.

    Trees, paths and rings vanish in a number of rounds logarithmic in their size, pending ones too. What then stays is a
    core whose vertices have three neighbours or more, but for the few that ever smaller rounds would still peel (strips of
    triangles lose only their ends in a round); :func:`star_components` solves it, and removed vertices take the root of the
    vertex they hung on, last removed first. An empty input gives no row.
    """
    now, (left, _) = _cut_edges(canonical(edges))
    layers = []
    while left:
        before, last = left, now
        layer, now, left = prune(last)
        release(last)
        layers.append(layer)
        if left > (1 - least_shrink) * before:
            break
    labels = cut(_stars(now, (left, None))) if left else now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    for layer in reversed(layers):
        known = layer.join(labels.withColumnRenamed("id", "parent").hint("merge"), "parent", "left")
        fresh = F.when(F.col("root").isNull(), F.struct(F.col("parent").alias("id"), F.col("parent").alias("root")))
        own = F.array(F.struct(F.col("child").alias("id"), F.coalesce("root", "parent").alias("root")), fresh)
        labels = labels.unionByName(cut(known.select(F.explode(F.array_compact(own)).alias("s")).select("s.id", "s.root").distinct()))
    return labels
