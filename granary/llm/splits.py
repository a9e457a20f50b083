"""Splits that keep related records together.

Records are related if they share any entity (a content hash, a specimen, an author ...). Components come from alternating
large-star and small-star steps; the component's identifier is hashed to a place between 0 and 1, and the place's range tells
the split. Ranges are laid in proportion to the records that the places hold; a stored set of ranges keeps every component
where it is while records are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from granary.llm.components import star_components
from granary.session import cut

#: Shares of train, validation and test.
SHARES = (("train", 0.77), ("validation", 0.17), ("test", 0.06))


def related(records: DataFrame, entities: list[str]) -> DataFrame:
    """``(id, root)`` of every record with a non-null ``id``: records sharing a non-null entity, directly or not, share ``root``.

    ``root`` is the smallest id of the component; a record without relations is its own root. Each entity is replaced by a
    star around its smallest record, so an entity that a third of all records share gives one edge per record, never pairs.
    """
    rows = records.where("id is not null").select("id", *entities).distinct()
    keyed = cut(
        rows.select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(e).cast("string").alias("key")) for i, e in enumerate(entities)])).alias("e"))
        .select("id", "e.kind", "e.key").where("key is not null").distinct()
    )
    heads = keyed.groupBy("kind", "key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = keyed.join(heads, ["kind", "key"]).where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    return rows.select("id").distinct().join(star_components(edges), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def split_conflicts(records: DataFrame, groups: DataFrame) -> DataFrame:
    """``(id, root)`` of all records whose component holds at least two different non-null ``split`` values."""
    members = cut(records.where("id is not null").select("id", "split").distinct().join(groups, "id").select("id", "root", "split"))
    bad = members.groupBy("root").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select("root")
    return members.join(bad, "root").select("id", "root").distinct()


def _components(records: DataFrame, groups: DataFrame, stratum: str, places: int) -> DataFrame:
    """``(root, stratum, n, place)`` of every component; its stratum is the one most of its records have (ties: smallest name;
    null counts as the empty name)."""
    rows = records.where("id is not null").groupBy("id").agg(F.min(stratum).alias("stratum")).join(groups, "id")
    per = rows.groupBy("root", F.coalesce("stratum", F.lit("")).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    comps = per.groupBy("root").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("k"), "stratum")).alias("top"))
    return comps.select("root", F.col("top.stratum").alias("stratum"), "n", _place(F.col("root"), places).alias("place"))


def _place(root: Column, places: int) -> Column:
    """A component's place by the leading 32 bits of its identifier's MD5."""
    return F.floor(F.conv(F.substring(F.md5(root.cast("string")), 1, 8), 16, 10).cast("bigint") * places / F.lit(1 << 32)).cast("int")


def split_ranges(comps: DataFrame, shares=SHARES, places: int = 4096, large: float = 0.02) -> DataFrame:
    """``(stratum, borders, large)``: where each split's range of places ends, and the components that the hash doesn't place.

    Components with more than the share ``large`` of their stratum, at most ``1 / large`` of them, go to the first split, as
    one in the range of a small split would fill it alone; the first range is shortened by what they hold. A place belongs to
    the split in whose share the middle of its records falls. ``comps`` comes from :func:`_components`.
    """
    totals = comps.groupBy("stratum").agg(F.sum("n").alias("total"))
    sized = comps.join(totals, "stratum").withColumn("big", F.col("n") > F.col("total") * large)
    whole = sized.groupBy("stratum").agg(
        F.first("total").alias("total"), F.sum(F.when(F.col("big"), F.col("n")).otherwise(0)).alias("filled"),
        F.array_sort(F.collect_list(F.when(F.col("big"), F.col("root")))).alias("large"),
    )
    mass = sized.where("not big").groupBy("stratum", "place").agg(F.sum("n").alias("m"))
    placed = mass.join(whole, "stratum").withColumn("end", F.expr("sum(m) over (partition by stratum order by place)"))
    middle = F.col("filled") + F.col("end") - F.col("m") / 2
    bounds = [sum(s for _, s in shares[: i + 1]) for i in range(len(shares) - 1)]
    ends = placed.groupBy("stratum").agg(*[F.min(F.when(middle >= F.col("total") * b, F.col("place"))).alias(f"b{i}") for i, b in enumerate(bounds)])
    borders = F.array(*[F.coalesce(f"b{i}", F.lit(places)) for i in range(len(bounds))])
    return whole.join(ends, "stratum", "left").select("stratum", borders.alias("borders"), "large")


def assign_splits(records: DataFrame, groups: DataFrame, stratum: str, shares=SHARES, places: int = 4096, large: float = 0.02, ranges: DataFrame | None = None) -> DataFrame:
    """``(id, root, split)``: one split per component, near ``shares`` overall and within every stratum.

    The component's identifier is hashed to one of ``places``, and the ranges of its stratum tell the split. Without ``ranges``
    they are made from these records by :func:`split_ranges`, which orders only ``strata x places`` counts, whatever the number
    of components. Ranges of an earlier run, stored as a table, keep the split of every component whose identifier (its
    smallest id) and stratum are the same, however many records were added; a stratum they lack is cut at the plain shares.
    """
    comps = cut(_components(records, groups, stratum, places))
    laid = (ranges if ranges is not None else split_ranges(comps, shares, places, large)).select("stratum", "borders", "large")
    bounds = [round(places * sum(s for _, s in shares[: i + 1])) for i in range(len(shares) - 1)]
    borders = F.coalesce("borders", F.array(*[F.lit(b) for b in bounds]))
    held = F.coalesce(F.array_contains("large", F.col("root")), F.lit(False))
    split = F.when(held, shares[0][0])
    for i, (name, _) in enumerate(shares[:-1]):
        split = split.when(F.col("place") < borders[i], name)
    chosen = comps.join(laid, "stratum", "left").select("root", split.otherwise(shares[-1][0]).alias("split"))
    return groups.join(chosen, "root").select("id", "root", "split")


def component_ranges(records: DataFrame, groups: DataFrame, stratum: str, shares=SHARES, places: int = 4096, large: float = 0.02) -> DataFrame:
    """The ranges that :func:`assign_splits` makes from these records, to be stored and handed to later runs."""
    return split_ranges(cut(_components(records, groups, stratum, places)), shares, places, large)
