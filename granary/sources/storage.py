"""Small files and folders on whatever file system a path names, through Hadoop, so that markers stand where the tables are."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def _place(path: str | Path):
    """The file system of ``path`` and its Hadoop form."""
    spark = SparkSession.active()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def qualified(path: str | Path) -> str:
    """``path`` with scheme and without relative parts."""
    fs, p = _place(path)
    return fs.makeQualified(p).toString()


def inside(path: str | Path, folder: str | Path) -> bool:
    """Whether ``path`` is ``folder`` or below it."""
    a, b = qualified(path), qualified(folder).rstrip("/")
    return a == b or a.startswith(b + "/")


def exists(path: str | Path) -> bool:
    fs, p = _place(path)
    return fs.exists(p)


def make_folder(path: str | Path) -> None:
    """A new folder; an existing one is an error."""
    fs, p = _place(path)
    if fs.exists(p):
        raise FileExistsError(str(path))
    fs.mkdirs(p)


def write_bytes(path: str | Path, content: bytes, overwrite: bool = True) -> None:
    """A file by way of another name, so that no reader meets half of it; without ``overwrite`` an existing one is an error."""
    fs, p = _place(path)
    if not overwrite and fs.exists(p):
        raise FileExistsError(str(path))
    _, part = _place(f"{path}.partial")
    out = fs.create(part, True)
    out.write(bytearray(content))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(part, p)


def read_bytes(path: str | Path) -> bytes:
    fs, p = _place(path)
    if not fs.exists(p):
        raise FileNotFoundError(str(path))
    stream = fs.open(p)
    try:
        return bytes(SparkSession.active().sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def move(path: str | Path, to: str | Path) -> None:
    """Renames a file or folder; an existing target is an error."""
    fs, p = _place(path)
    _, q = _place(to)
    if fs.exists(q):
        raise FileExistsError(str(to))
    if not fs.rename(p, q):
        raise OSError(f"{path} can't be renamed")


def remove(path: str | Path) -> None:
    fs, p = _place(path)
    fs.delete(p, True)
