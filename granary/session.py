"""Helpers that read the session's own settings and never assume a machine-local folder on a cluster."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` below ``sf_dir`` (one file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir`` of the session; where none is set, and only if driver and executors are one process, fall
    back to a temporary folder that goes with it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="granary-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and_count(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`cut` with aggregates of the table, gathered by the job that writes it.

    A task that runs twice after the loss of an executor may count twice: use the numbers to see whether something changed or
    is left, not as results. If the session's events are lost, the table is read once more.
    """
    ensure_checkpoint_dir(df.sparkSession)
    seen = Observation(f"cut-{uuid.uuid4().hex}")
    done = df.observe(seen, *[c.alias(n) for n, c in metrics.items()]).checkpoint(eager=True)
    found: list[dict] = []
    reader = threading.Thread(target=lambda: found.append(seen.get), daemon=True)
    reader.start()
    reader.join(30)
    if found and found[0].keys() == metrics.keys():
        return done, found[0]
    return done, done.agg(*[c.alias(n) for n, c in metrics.items()]).first().asDict()


def release(*frames: DataFrame) -> None:
    """Remove the files of tables made by :func:`cut` that nothing will read again; others are left alone.

    Whatever was computed from them must itself have been cut, so that no lost task can ask for them.
    """
    for df in frames:
        plan = df._jdf.queryExecution().analyzed()
        if plan.nodeName() != "LogicalRDD":
            continue
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the session's checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def bounded(df: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """``df`` marked for broadcasting if its rows, as JSON text, hold at most ``most_bytes``; else as it is, to be joined by shuffle.

    Meant for materialised tables: the size is measured by one aggregation.
    """
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(df) if size <= most_bytes else df
