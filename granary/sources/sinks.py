"""Sinks (K1-K6, K9, K11): contract-checked tables, safe spreadsheets, guarded destinations, completion markers."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from granary.functions.scalars import safe_cell
from granary.schemas import conform
from granary.sources import storage


def guard_destination(path: str, protected: list[str]) -> str:
    """K3: ``path`` if it doesn't exist and isn't inside (or equal to) any protected folder; else an error."""
    if storage.exists(path):
        raise FileExistsError(path)
    for p in protected:
        if storage.inside(path, p):
            raise ValueError(f"{path} is inside {p}")
    return path


def write_csv(df: DataFrame, path: str, contract: tuple[str, ...]) -> None:
    """K1: CSV of exactly the contract's columns, overwriting."""
    conform(df, contract).write.mode("overwrite").csv(path, header=True)


def export_csv(df: DataFrame, path: str, contract: tuple[str, ...], protected: list[str] = ()) -> None:
    """K2, K4: a new CSV folder, UTF-8 with a byte-order mark, text cells made safe; numbers stay numbers; nulls are empty."""
    guard_destination(path, list(protected))
    out = conform(df, contract)
    cells = [safe_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in out.dtypes]
    out = out.select(*cells)
    out.withColumnRenamed(out.columns[0], "﻿" + out.columns[0]).write.mode("errorifexists").csv(path, header=True, emptyValue="")


def write_json(path: str, value: dict) -> None:
    """K5: indented JSON; NaN is refused."""
    storage.write_bytes(path, json.dumps(value, indent=2, allow_nan=False).encode())


def write_pictures(pictures: DataFrame, folder: str) -> None:
    """K6: ``content`` of each row as a file ``name`` in a new folder; an existing folder, a name with a slash or one that comes
    twice is an error. Tasks write their own pictures, so the folder must be one that all executors share."""
    twice = pictures.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or name is null or name like '%/%'").limit(1).count()
    if twice:
        raise ValueError("names must be single and without slashes")
    storage.make_folder(folder)
    target = storage.qualified(folder)
    if not target.startswith("file:"):
        raise ValueError("pictures are written to a mounted folder only")
    local = target.removeprefix("file:")

    def write(rows) -> None:
        for r in rows:
            with open(f"{local}/{r['name']}", "xb") as f:
                f.write(bytes(r["content"]))

    pictures.where("content is not null").select("name", "content").foreachPartition(write)


def new_run_folder(outputs: str, method: str, now: datetime | None = None) -> str:
    """A new folder named by the UTC time in microseconds; an existing one is an error."""
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%S_%fZ")
    folder = f"{outputs}/{method}/{stamp}"
    storage.make_folder(folder)
    return folder


def write_run(folder: str | Path, metadata: dict, tables: dict[str, DataFrame]) -> None:
    """K9: metadata says ``building`` until all tables are written, then ``completed``; on an error ``failed``."""
    meta = f"{folder}/metadata.json"
    write_json(meta, {**metadata, "status": "building"})
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    except Exception:
        write_json(meta, {**metadata, "status": "failed"})
        raise
    write_json(meta, {**metadata, "status": "completed"})
