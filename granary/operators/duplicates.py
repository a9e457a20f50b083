"""Exact duplicate groups and the audit summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def duplicate_groups(rows: DataFrame, key: str, split: str, label: list[str], order: str) -> DataFrame:
    """A1: groups of rows that share ``key``: ``(key, n, first, cross_split, conflicting_labels)``.

    Null and blank keys group nothing; groups of one are left out. A null split or label counts as a value of its own.
    Counting is partial before the shuffle; members aren't collected, so a group of any size costs one row
    (:func:`duplicate_members` lists them).
    """
    def differ(c):
        c = c if isinstance(c, F.Column) else F.col(c)
        seen = F.coalesce(c, F.lit("\0none"))
        return F.min(seen) != F.max(seen)

    tag = F.to_json(F.struct(*label), {"ignoreNullFields": "false"})
    return (
        rows.where(F.col(key).isNotNull() & (F.col(key) != ""))
        .groupBy(F.col(key).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), differ(F.col(split)).alias("cross_split"), differ(tag).alias("conflicting_labels"))
        .where("n > 1")
    )


def duplicate_members(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A1: the rows of all groups of more than one, with the group's first row; no list is built."""
    groups = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("group_first")).where("group_size > 1")
    return rows.join(groups, key)


def audit_summary(groups: DataFrame) -> DataFrame:
    """A4: number of groups, redundant copies, cross-split and conflicting groups; zeros for no group."""
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant_copies"),
        F.count_if("cross_split").alias("cross_split_groups"),
        F.count_if("conflicting_labels").alias("conflicting_groups"),
    )
