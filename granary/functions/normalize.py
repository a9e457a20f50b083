"""Spelling-insensitive forms of the keys that the tables hold: paths, hashes, splits, categories.

All functions take and return Columns, run inside code generation and give null where the input names nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_OUTER = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Outer white space of any kind removed (``trim`` only knows the blank)."""
    return F.regexp_replace(c, _OUTER, "")


def plain_path(c: Column) -> Column:
    """Plain spelling of a relative POSIX path: ``/`` only, single, no ``./`` parts, no outer blanks; blank gives null.

    Letter case and outer folders are kept, as they name different files.
    """
    p = F.regexp_replace(strip(c), r"[\\/]+", "/")
    p = F.regexp_replace(p, r"^(?:\./)+", "")
    p = F.regexp_replace(p, r"/(?:\./)+", "/")
    # most paths are plain already, which one search tells
    odd = c.rlike(r"(?U)^\s|\s$|\\|//|^\./|/\./")
    return F.when(odd & (p != ""), p).when(~odd & (c != ""), c)


def digest(c: Column) -> Column:
    """64 lower-case hex digits of a SHA-256 spelling; null for anything else and for the all-zero filler."""
    h = F.regexp_replace(F.lower(strip(c)), r"^sha256:\s*", "")
    return F.when(h.rlike(r"^[0-9a-f]{64}$") & ~h.rlike(r"^0+$"), h)


def phash_bits(c: Column) -> Column:
    """Signed bigint holding the 64 bits of a perceptual hash; null for fillers and for zero.

    Accepts any letter case, an ``0x`` prefix, blanks, colons, hyphens, underscores and dots as separators, and lost leading zeros.
    """
    h = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"^0x", ""), r"(?U)[\s:_.\-]", "")
    v = F.conv(F.when(h.rlike(r"^[0-9a-f]{1,16}$"), h), 16, -10).cast("bigint")
    return F.when(v != 0, v)


def split_name(c: Column) -> Column:
    """``train``, ``validation`` or ``test``; ``val`` is validation, blank is null."""
    s = F.lower(strip(c))
    return F.when(s == "val", "validation").when(s != "", s)


def category(c: Column) -> Column:
    """Lower-case, outer-blank-free category (fruit, method); blank gives null."""
    s = F.lower(strip(c))
    return F.when(s != "", s)


def specimen_name(c: Column) -> Column:
    """Specimen number in lower case; ``unknown``, ``n/a`` and blank name none."""
    s = F.lower(strip(c))
    return F.when(~s.isin("", "unknown", "n/a"), s)
