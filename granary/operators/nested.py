"""Deeply nested JSON records to flat tables that keep parent-child links.

Every text is stream-parsed once into (path, value, ordinals) triples; triples are grouped by the repeated ancestor they
stand below, and each group is pivoted into rows of one table. A record never leaves its task: there is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from granary.session import cut

_TOKEN = re.compile(
    r'[ \t\n\r]*(?:([\[{])|([\]}])|"((?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+)"(?:[ \t\n\r]*(:))?'
    r"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity)|(,))"
)
_BLANK = re.compile(r"[ \t\n\r]*")
_KEY = re.compile(r"[0-9]{1,18}")


@dataclass(frozen=True)
class Repeated:
    """A repeated ancestor: ``table`` gets a row for each object found at ``path`` below the parent level's object."""

    table: str
    path: tuple[str, ...] = ()


@dataclass(frozen=True)
class Nesting:
    """Levels from the outermost in, and the keys of outer objects that the outermost list may sit under."""

    levels: tuple[Repeated, ...]
    wrappers: tuple[str, ...] = ()


#: Frame kinds: list or object of plain values, list of elements, object that is an element or keyed by element numbers.
_LIST, _OBJECT, _ELEMENTS, _OPEN, _KEYED = range(5)


class _Incomplete(ValueError):
    pass


def flatten(text: str | None, nesting: Nesting, fields: bool = True) -> list[list]:
    """Rows ``[level, ordinals, paths, values]`` of one text; none for null, empty or incomplete JSON.

    * Elements are numbered from 1 by place; null and non-object elements keep their place and give no row.
    * A bare object where a list is expected is element 1; an object whose first key is a number is keyed by element number.
    * The outermost list may sit below any chain of ``wrappers``; a text that is a JSON string is parsed again.
    * ``paths`` of plain values below an element are joined with dots, list places counted from 1; values are JSON scalars
      as text, strings without quotes, null for null. Unknown fields are kept; NaN and Infinity are numbers. A repeated key
      keeps both values. With ``fields`` false both lists stay empty.
    """
    try:
        while text:
            start = _BLANK.match(text).end()
            if not text.startswith('"', start):
                return _parse(text, nesting, fields)
            inner, end = scanstring(text, start + 1, True)
            if _BLANK.match(text, end).end() != len(text):
                return []
            text = inner
    except (ValueError, IndexError):
        pass
    return []


class _Frame:
    """An open container: its kind, how many elements it stands in, their ordinals, the path below the innermost one and
    its row (None above the outermost list, ``_VOID`` where values belong to no row)."""

    __slots__ = ("kind", "level", "ords", "path", "row", "count", "is_list", "tentative")

    def __init__(self, kind: int, level: int, ords: tuple, path: tuple, row: list | None, is_list: bool):
        self.kind, self.level, self.ords, self.path, self.row, self.is_list = kind, level, ords, path, row, is_list
        self.count, self.tentative = 0, -1


_VOID: list = [-1, (), [], []]


def _parse(text: str, nesting: Nesting, fields: bool) -> list[list]:
    levels, wrappers = nesting.levels, nesting.wrappers
    depth, top = len(levels), nesting.levels[0].path
    rows: list[list] = []
    stack: list[_Frame] = []
    frame: _Frame | None = None
    key = ""
    want = "v"  # v value, V value or end of list, k key or end, K key, c comma or end, e end of text
    match, pos = _TOKEN.match, 0

    while True:
        m = match(text, pos)
        if m is None:
            if want == "e" and _BLANK.match(text, pos).end() == len(text):
                return rows
            raise _Incomplete
        pos = m.end()
        kind = m.lastindex
        if kind == 6:
            if want != "c":
                raise _Incomplete
            want = "v" if frame.is_list else "K"
            continue
        if kind == 4:
            if want != "k" and want != "K":
                raise _Incomplete
            key = m.group(3)
            if "\\" in key:
                key = scanstring(f'"{key}"', 1, True)[0]
            want = "v"
            if frame.kind == _OPEN:
                _settle(frame, key, rows, wrappers)
            elif frame.tentative >= 0 and key in wrappers:  # no element after all, but an outer object
                del rows[frame.tentative :]
                frame.level, frame.ords, frame.row, frame.tentative = 0, (), None, -1
            continue
        if kind == 2:
            if frame is None or frame.is_list != (m.group(2) == "]") or want != "c" and want != ("V" if frame.is_list else "k"):
                raise _Incomplete
            stack.pop()
            frame = stack[-1] if stack else None
            want = "c" if stack else "e"
            continue
        if want != "v" and want != "V":
            raise _Incomplete
        want = "c"
        place, repeated, path, row, level = -1, False, (), None, 0
        if frame is None:
            repeated, want = not top, "e"
        else:
            frame.count += 1
            level, row = frame.level, frame.row
            if frame.kind == _ELEMENTS:
                place = frame.count
            elif frame.kind == _KEYED:
                if _KEY.fullmatch(key):
                    place = int(key)
                else:
                    row = _VOID
            else:
                step = str(frame.count) if frame.is_list else key
                path = (*frame.path, step)
                if row is None:
                    repeated = step in wrappers or path == top
                    if not repeated and path != top[: len(path)]:
                        row = _VOID
                elif level < depth and not frame.is_list and row is not _VOID:
                    repeated = path == levels[level].path
        if kind == 1:
            is_list = m.group(1) == "["
            ords = frame.ords if frame is not None else ()
            if place >= 0:
                if is_list:
                    frame = _Frame(_LIST, level, ords, ("",), _VOID, True)
                else:
                    row = [level, (*ords, place), [], []]
                    rows.append(row)
                    frame = _Frame(_OBJECT, level + 1, row[1], (), row, False)
            elif repeated:
                frame = _Frame(_ELEMENTS if is_list else _OPEN, level, ords, (), row, is_list)
            else:
                frame = _Frame(_LIST if is_list else _OBJECT, level, ords, path, row, is_list)
            stack.append(frame)
            want = "V" if is_list else "k"
        elif fields and place < 0 and row is not None and row is not _VOID:
            if kind == 3:
                value = m.group(3)
                if "\\" in value:
                    value = scanstring(f'"{value}"', 1, True)[0]
            else:
                value = m.group(5)
                if value == "null":
                    value = None
            row[2].append(".".join(path))
            row[3].append(value)


def _settle(frame: _Frame, key: str, rows: list[list], wrappers: tuple[str, ...]) -> None:
    """The first key tells whether an object in a list's place is keyed by numbers, an outer object or the bare element 1."""
    if _KEY.fullmatch(key):
        frame.kind = _KEYED
        return
    frame.kind = _OBJECT
    if frame.level == 0 and key in wrappers:
        return
    row = [frame.level, (*frame.ords, 1), [], []]
    if frame.level == 0:
        frame.tentative = len(rows)
    rows.append(row)
    frame.level, frame.ords, frame.row = frame.level + 1, row[1], row


def flatten_records(records: DataFrame, keys: list[str], column: str, nesting: Nesting, fields: bool = True) -> DataFrame:
    """One row per element of all levels: ``keys``, ``level``, ``<table>_no`` per level (0 below it) and, if asked, ``fields``.

    ``fields`` maps the dotted path below the element to its text. Runs batch-wise inside each task over Arrow; incomplete,
    empty and null texts give no row; other columns of ``records`` are not read.
    """
    names = [f"{x.table}_no" for x in nesting.levels]
    n = len(names)
    source = records.select(*keys, F.col(column).alias("__text"))
    types = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "level int", *(f"`{x}` bigint" for x in names), *(["paths array<string>", "texts array<string>"] if fields else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, level, ords, paths, texts = [], [], [[] for _ in range(n)], [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                for lv, o, p, v in flatten(text, nesting, fields):
                    at.append(i)
                    level.append(lv)
                    for d in range(n):
                        ords[d].append(o[d] if d < len(o) else 0)
                    if fields:
                        paths.append(p)
                        texts.append(v)
            take = pa.array(at, pa.int64())
            cols = [batch.column(j).take(take) for j in range(len(keys))] + [pa.array(level, pa.int32()), *(pa.array(o, pa.int64()) for o in ords)]
            if fields:
                cols += [pa.array(paths, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "level", *names, *(["paths", "texts"] if fields else [])])

    out = source.mapInArrow(run, schema)
    if not fields:
        return out
    # a repeated key keeps its last value in the map
    last = F.expr("map_from_entries(filter(arrays_zip(paths, texts), (x, i) -> array_position(slice(paths, i + 2, size(paths)), x.paths) = 0))")
    return out.select(*keys, "level", *names, last.alias("fields"))


def child_table(flat: DataFrame, nesting: Nesting, table: str, columns: dict[str, tuple[str | tuple[str, ...], str]]) -> DataFrame:
    """The table of one level: keys of the record and all parents, then ``columns`` (name: path, type) cast with ``try_cast``.

    Of several paths the first that has a value counts. Fields of other names are those of :func:`other_fields`.
    """
    numbers = [f"{x.table}_no" for x in nesting.levels[: _level(nesting, table) + 1]]
    picked = []
    for name, (paths, kind) in columns.items():
        tried = [F.expr(f"try_cast(fields['{x}'] as {kind})") for x in ([paths] if isinstance(paths, str) else paths)]
        picked.append(F.coalesce(*tried).alias(name))
    return flat.where(F.col("level") == _level(nesting, table)).select(*_own(flat, nesting), *numbers, *picked)


def other_fields(flat: DataFrame, nesting: Nesting, table: str, columns: dict[str, tuple[str | tuple[str, ...], str]]) -> DataFrame:
    """Path and text of the fields of one level that none of ``columns`` names, a row each, with all parents' keys."""
    numbers = [f"{x.table}_no" for x in nesting.levels[: _level(nesting, table) + 1]]
    known = {x for paths, _ in columns.values() for x in ([paths] if isinstance(paths, str) else paths)}
    rows = flat.where(F.col("level") == _level(nesting, table))
    rows = rows.select(*_own(flat, nesting), *numbers, F.explode(F.map_entries("fields")).alias("__f"))
    return rows.where(~F.col("__f.key").isin(*known)).select(*_own(flat, nesting), *numbers, F.col("__f.key").alias("path"), F.col("__f.value").alias("value"))


def _level(nesting: Nesting, table: str) -> int:
    return [x.table for x in nesting.levels].index(table)


def _own(flat: DataFrame, nesting: Nesting) -> list[str]:
    return [c for c in flat.columns if c not in {"level", "fields", *(f"{x.table}_no" for x in nesting.levels)}]


def nested_tables(records: DataFrame, keys: list[str], column: str, nesting: Nesting, columns: dict[str, dict]) -> dict[str, DataFrame]:
    """All tables of :func:`child_table` by name, each with its ``<table>_other`` of :func:`other_fields`, from one parse of
    the texts, whose triples are kept in a checkpoint. ``columns`` has the columns of each table."""
    flat = cut(flatten_records(records, keys, column, nesting))
    found = {name: child_table(flat, nesting, name, c) for name, c in columns.items()}
    return found | {f"{name}_other": other_fields(flat, nesting, name, c) for name, c in columns.items()}
