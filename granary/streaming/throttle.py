"""Greedy throttling of events by key (W12, R2): an event passes if it is at least ``gap`` seconds after the last one that did.

The batch and the streaming form share one rule; the stream keeps one timestamp per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def keep(micros: np.ndarray, gap: int, last: int | None) -> tuple[np.ndarray, int | None]:
    """Which of the ascending times pass, and the last that did. Jumps from one kept time to the next by binary search."""
    kept = np.zeros(len(micros), bool)
    i = 0 if last is None else int(np.searchsorted(micros, last + gap, "left"))
    while i < len(micros):
        kept[i], last = True, int(micros[i])
        i = max(i + 1, int(np.searchsorted(micros, last + gap, "left")))
    return kept, last


def _gap(seconds: float) -> int:
    if seconds < 0:
        raise ValueError("the interval must not be negative")
    return round(seconds * 1_000_000)


def throttle(events: DataFrame, key: str, at: str, order: str, seconds: float = 0.35) -> DataFrame:
    """Batch form: the events of each key that pass, in order of time and ``order``. Null keys or times never pass.

    Rows are range-partitioned by nothing but their key and sorted within the task, so a key's rows stream through one
    Python iterator in Arrow batches with one timestamp of state; no group is ever held as a whole.
    """
    gap = _gap(seconds)
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("__t", F.unix_micros(F.col(at).cast("timestamp"))).repartition(F.col(key)).sortWithinPartitions(key, "__t", order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for pdf in batches:
            passed = np.zeros(len(pdf), bool)
            keys, times = pdf[key].to_numpy(), pdf["__t"].to_numpy(np.int64)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(pdf) else []
            for a, b in zip(starts, [*starts[1:], len(pdf)]):
                if keys[a] != current:
                    current, last = keys[a], None
                passed[a:b], last = keep(times[a:b], gap, last)
            yield pdf[passed].drop(columns="__t")

    return rows.mapInPandas(run, events.schema)


def throttle_stream(events: DataFrame, key: str, at: str, seconds: float = 0.35, order: str | None = None) -> DataFrame:
    """Streaming form over ``(key, at)``, other columns kept: state is the last passed time per key.

    Within a micro-batch events are taken by time, then ``order``; an event of an earlier time than the last passed one
    doesn't pass. A key's events of one micro-batch are held at once: bound them by ``maxFilesPerTrigger``.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    gap, schema = _gap(seconds), events.schema

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(frames)).sort_values([at, order] if order else at, kind="stable")
        kept, last = keep(pdf[at].to_numpy("datetime64[us]").astype(np.int64), gap, last)
        if last is not None:
            state.update((last,))
        yield pdf[kept]

    return events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key).applyInPandasWithState(step, schema, "last bigint", "append", GroupStateTimeout.NoTimeout)


def latest_frames(frames: DataFrame, source: str, order: str) -> DataFrame:
    """The newest row of each source, in batch or in update mode."""
    rest = [c for c in frames.columns if c not in (source, order)]
    return frames.groupBy(source).agg(F.max_by(F.struct(*rest), order).alias("f"), F.max(order).alias(order)).select(source, order, "f.*")
