"""The memory's time-driven behaviour as structured streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def appended(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream: the change notification of an append-only table."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def access_counts(events: DataFrame, key: str, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """Running reinforcement per key: accesses and last access."""
    return events.withWatermark(ts, late).groupBy(key).agg(F.count(F.lit(1)).alias("accesses"), F.max(ts).alias("last_accessed"))


def windowed(events: DataFrame, kind: str, ts: str = "ts", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), kind).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """First arrival of each key; state is dropped behind the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def working_memory(writes: DataFrame, ttl_seconds: int, key: str = "key", value: str = "value", ts: str = "ts") -> DataFrame:
    """(key, value, live): the latest value of each key, and its expiry once event time has passed its time to live."""

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], value: [last], "live": [False]})
            return
        rows = pd.concat(list(parts)).sort_values(ts)
        last = str(rows[value].iloc[-1])
        state.update((last,))
        expires = int(rows[ts].iloc[-1].timestamp() * 1000) + ttl_seconds * 1000
        state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], value: [last], "live": [True]})

    kind = writes.schema[key].dataType.simpleString()
    return writes.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {value} string, live boolean", "last string", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Works off what has arrived and stops: the scheduled consolidation."""
    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
