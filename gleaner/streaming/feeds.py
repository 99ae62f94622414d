"""Seen signatures, stability and stalls over streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(stream: DataFrame, signature: list[str], time: str, delay: str) -> DataFrame:
    """Records whose signature hasn't come within the watermark; state ends with it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(signature)


def settled(stream: DataFrame, key: str, value: str, order: str, equal: int = 3, idle: int | None = None) -> DataFrame:
    """(key, settled_at): the sample at which a key's value was the same `equal` times in
    a row. State: last value, run, samples; a settled key is kept so that it isn't told twice.
    idle: a key without samples for so many milliseconds is forgotten, so that the state of
    an endless stream doesn't grow without end; one that comes back later begins anew. A
    stream that is run to its end (`drained`) takes None, since clocks never come to one."""

    def step(keys, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, run, n, done = state.get if state.exists else (None, 0, 0, False)
        values = pd.concat(list(frames)).sort_values(order, kind="stable")[value]
        known, text = values.notna().to_numpy(), values.map(str).to_numpy(object)
        same = known & np.concatenate([[last is not None and text[0] == last], known[:-1] & (text[1:] == text[:-1])]).astype(bool)
        at = np.arange(len(text))
        runs = at + 1 - np.maximum.accumulate(np.where(same, -run, at))
        hits = np.flatnonzero(known & (runs >= equal))
        told = [] if done or not len(hits) else [n + int(hits[0]) + 1]
        state.update((text[-1] if known[-1] else None, int(runs[-1]), n + len(text), done or bool(told)))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame({key: [keys[0]] * len(told), "settled_at": told})

    kind = stream.schema[key].dataType.simpleString()
    ends = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.select(key, value, order).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, settled_at long", "last string, run long, n long, done boolean", "append", ends
    )


def stalls(stream: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """Sessions of events parted by silence."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything a stream has now, run to its end and read from files."""
    spark: SparkSession = stream.sparkSession
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return spark.read.schema(stream.schema).parquet(path)
