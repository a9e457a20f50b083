"""Scans (S1-S8): image folders, ZIP archives, saved runs and tables, as DataFrames."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from granary.functions.scalars import has_image_extension, parse_labels
from granary.schemas import EXTENSIONS
from granary.sources import storage

#: Fixed value: largest archive entry that is read.
ENTRY_CAP = 50 << 20


def dataset_root(folder: str) -> str:
    """The folder itself if it holds train and test (any case), or its only subfolder that does; else an error."""
    def holds(p: Path) -> bool:
        return {"train", "test"} <= {c.name.lower() for c in p.iterdir() if c.is_dir()}

    top = Path(folder)
    if holds(top):
        return str(top)
    inner = [c for c in top.iterdir() if c.is_dir() and holds(c)]
    if len(inner) != 1:
        raise ValueError(f"{folder} holds {len(inner)} datasets")
    return str(inner[0])


def scan_images(spark: SparkSession, root: str, glob: str = "*", content: bool = False) -> DataFrame:
    """``(path, bytes, sha256, label)`` of supported images below ``root``, paths relative to it, and their
    ``content`` if asked.

    Without ``content`` files are read only to be hashed; without ``sha256`` in the result Spark doesn't open them. ``root`` may
    be on any file system that Spark reads.
    """
    base = "file:///" + storage.qualified(root).removeprefix("file:").lstrip("/").rstrip("/") + "/" if storage.qualified(root).startswith("file:") else storage.qualified(root).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "file:///"), "^" + re.escape(base), "")
    rows = files.select(path.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), *(["content"] if content else [])).where(has_image_extension(F.col("path")))
    return rows.withColumn("label", parse_labels(F.col("path")))


def collect_inputs(spark: SparkSession, paths: list[str], recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(ordinal, path)`` of chosen files and folders in first-seen order, each resolved path once, and ``(path, warning)``."""
    found: dict[str, None] = {}
    warnings: list[tuple[str, str]] = []

    def take(p: Path) -> None:
        if p.is_symlink():
            warnings.append((str(p), "link"))
        elif p.suffix.lower() not in EXTENSIONS:
            warnings.append((str(p), "unsupported"))
        else:
            found.setdefault(str(p.resolve()))

    for text in paths:
        p = Path(text)
        if not p.exists():
            warnings.append((text, "missing"))
        elif p.is_dir():
            for child in sorted(p.rglob("*") if recursive else p.iterdir()):
                if child.is_file():
                    take(child)
        else:
            take(p)
    return spark.createDataFrame([(i, p) for i, p in enumerate(found)], "ordinal long, path string"), spark.createDataFrame(warnings, "path string, warning string")


class _Entries(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _ZipReader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self):
        with zipfile.ZipFile(self.path) as z:
            n = len(z.infolist())
        return [_Entries(i, min(n, i + self.per_task)) for i in range(0, n, self.per_task)] or [_Entries(0, 0)]

    def read(self, partition: _Entries) -> Iterator[tuple]:
        with zipfile.ZipFile(self.path) as z:
            for info in sorted(z.infolist(), key=lambda x: x.filename)[partition.first : partition.last]:
                if info.is_dir():
                    continue
                supported = any(info.filename.lower().endswith(e) for e in EXTENSIONS)
                content, error = None, ""
                if supported and info.file_size > ENTRY_CAP:
                    error = "ValueError: entry too large"
                elif supported:
                    try:
                        content = z.read(info)
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                yield info.filename, info.file_size, supported, content, error


class ZipSource(DataSource):
    """Entries of a ZIP archive by name: ``path, bytes, supported, content, error``; a bad entry is a row with an error.

    Options: ``path``, and ``entriesPerTask`` (256), so that a large archive is read by many tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "imagezip"

    def schema(self):
        return "path string, bytes long, supported boolean, content binary, error string"

    def reader(self, schema):
        return _ZipReader(self.options["path"], int(self.options.get("entriesPerTask", 256)))


def scan_zip(spark: SparkSession, path: str) -> DataFrame:
    """Registers :class:`ZipSource` and loads an archive."""
    spark.dataSource.register(ZipSource)
    return spark.read.format("imagezip").option("path", path).load()


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and a declared schema; malformed rows fail the job."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


RUN = "status string, method string, backend string, split_id string, feature_id string, seed long, model_type string, counts map<string,long>, model_parameters map<string,string>, metrics_sha256 string"


def discover_runs(spark: SparkSession, outputs: str) -> DataFrame:
    """One row per ``<method>/<run>/metadata.json``: keys and ``warning``; unreadable or unfinished runs get a warning.

    No model is read. Newest first per method by run name.
    """
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").load(outputs)
    f = files.select(F.col("_metadata.file_path").alias("file"), F.col("value"), F.from_json("value", RUN, {"mode": "PERMISSIVE"}).alias("m"))
    parts = F.split("file", "/")
    warning = F.when(F.try_parse_json("value").isNull() | F.col("m.status").isNull(), "unreadable metadata").when(F.col("m.status") != "completed", "run is not completed").when(~F.col("m.method").eqNullSafe(F.element_at(parts, -3)), "method differs from folder")
    return f.select(F.element_at(parts, -3).alias("folder"), F.element_at(parts, -2).alias("run"), "m.*", warning.alias("warning")).orderBy("folder", F.desc("run"))


