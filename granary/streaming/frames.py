"""Frames as files: a video is a finished folder of frames, a camera one that grows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.functions.scalars import frame_seconds
from granary.operators.imaging import segment_methods
from granary.operators.runs import running_positions
from granary.session import cut
from granary.sources import storage
from granary.streaming.throttle import throttle_stream

#: Reads that may fail in a row, and seconds between analysed frames.
FAILURES, INTERVAL = 5, 0.35
_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def video_frames(spark: SparkSession, folder: str, fps: float = 25.0) -> DataFrame:
    """``(frame_index, timestamp_seconds, path, content)`` of the frames of a folder in order of their names."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    placed = running_positions(files.select("path"), ["path"]).select("path", F.col("position").alias("frame_index"))
    timed = placed.withColumn("timestamp_seconds", frame_seconds(F.col("frame_index"), F.lit(float(fps))))
    return files.join(timed, "path").select("frame_index", "timestamp_seconds", "path", "content")


def process_video(spark: SparkSession, folder: str, output: str, analyse: Callable[[DataFrame], DataFrame], fps: float = 25.0, chunk: int = 2000, cancelled: Callable[[], bool] = lambda: False, emit: Callable[[str, dict], None] = lambda kind, what: None) -> DataFrame | None:
    """Every frame of a folder analysed, in order and in chunks that bound what is under way; rows are written to a
    hidden folder, which takes the name ``output`` only when all are done.

    ``analyse`` maps frames (with ``content``) to rows with ``frame_index`` and ``error``. ``emit`` hears of progress and of the
    end; if ``cancelled()`` between chunks, what was written is removed and None returned. An ``output`` that exists, or a
    folder without a single decodable frame, is an error, and nothing is left behind.
    """
    if storage.exists(output):
        raise FileExistsError(output)
    part = f"{output.rstrip('/').rpartition('/')[0]}/.{uuid.uuid4().hex}.partial"
    frames = cut(video_frames(spark, folder, fps))
    total = frames.count()
    try:
        for first in range(1, total + 1, chunk):
            if cancelled():
                emit("cancelled", {"done": first - 1, "total": total})
                return None
            analyse(frames.where(F.col("frame_index").between(first, first + chunk - 1))).write.mode("append").parquet(part)
            emit("progress", {"done": min(first + chunk - 1, total), "total": total})
        if not total or not spark.read.parquet(part).where("error = ''").limit(1).count():
            raise ValueError("the video has no decodable frames")
        storage.move(part, output)
    finally:
        if storage.exists(part):
            storage.remove(part)
    emit("completed", {"output": output, "total": total})
    return spark.read.parquet(output)


def segment_frames(method: str) -> Callable[[DataFrame], DataFrame]:
    """An ``analyse`` for :func:`process_video` and :func:`live_frames`: the mask's numbers of one method."""
    def analyse(frames: DataFrame) -> DataFrame:
        keep = [c for c in frames.columns if c != "content"]
        return segment_methods(frames, (method,), keep)

    return analyse


def camera_frames(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """The stream of frames that arrive in a folder: ``(source, ts, path, content)``, at most so many in a micro-batch."""
    files = spark.readStream.schema(_SCHEMA).format("binaryFile").option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.select(F.lit(folder).alias("source"), F.col("modificationTime").alias("ts"), "path", "content")


def fail_after(rows: DataFrame, source: str, order: str, limit: int = FAILURES) -> DataFrame:
    """The stream ``rows`` as it is, which fails once ``limit`` rows of a source in a row have an ``error``."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed = state.get[0] if state.exists else 0
        pdf = pd.concat(list(frames)).sort_values(order, kind="stable")
        for bad in pdf["error"] != "":
            failed = failed + 1 if bad else 0
            if failed >= limit:
                raise ValueError("the source stopped returning frames")
        state.update((failed,))
        yield pdf

    return rows.groupBy(source).applyInPandasWithState(step, rows.schema, "failed int", "append", GroupStateTimeout.NoTimeout)


def live_frames(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], interval: float = INTERVAL) -> DataFrame:
    """Frames at least ``interval`` seconds apart per source, analysed. Stop the query to cancel (R5); its progress
    events tell what was done (R6)."""
    return analyse(throttle_stream(stream, "source", "ts", interval, "path"))
