"""The seen filter as a keyed stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postmill import schemas as S


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; a glob pattern may name files or folders.

    Without ``max_files`` all files that have arrived make one micro-batch. With it, a run is cut into
    several, and rows of a later file that are older than rows of an earlier one come out of order.
    """
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def seen_stream(
    arrivals: DataFrame,
    key: str = "job_url",
    ts: str = "ts",
    order: str = "event_id",
    ttl_seconds: int = S.TTL_SECONDS,
    lateness: str = "1 day",
) -> DataFrame:
    """Kept sightings of a stream of (key, ts, order), exact in event time.

    The state of a key is the time it was last kept; it is dropped once the watermark is a time to
    live beyond it. The order of files within a micro-batch does not matter. A row behind the watermark
    of earlier runs can be older than the state, so it is not judged; :func:`run_to_table` counts such rows.
    Of a key, its distinct times in the micro-batch are held. Where those of one key do not fit a task, use
    :mod:`postmill.streaming.increment`, which runs the batch filter.
    """
    ttl = ttl_seconds * 1_000_000

    def keep_greedily(times: np.ndarray, last: int | None) -> list[int]:
        """Positions kept in sorted ``times``: each at least ``ttl`` after the one kept before.

        Jumps from kept time to kept time by binary search, so the cost follows what is kept. Defined
        here, so that it is shipped with the stream and workers need no copy of this package.
        """
        out: list[int] = []
        i = 0 if last is None else int(np.searchsorted(times, last + ttl, side="left"))
        while i < len(times):
            out.append(i)
            i = int(np.searchsorted(times, times[i] + ttl, side="left"))
        return out

    def first_of_times(got: pd.DataFrame) -> pd.DataFrame:
        # the first row of each time is the only one that can be kept
        return got.sort_values(["t", "o"]).drop_duplicates("t")

    def step(group: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        got = first_of_times(pd.concat([first_of_times(c[["t", "o"]]) for c in chunks], ignore_index=True))
        times = got["t"].to_numpy()
        last = state.get[0] if state.exists else None
        picks = keep_greedily(times, last)
        if picks:
            last = int(times[picks[-1]])
            state.update((last,))
        if last is not None:
            expiry = (last + ttl) // 1000
            state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        if picks:
            part = got.iloc[picks]
            yield pd.DataFrame({"k": group[0], "t": part["t"].to_numpy(), "o": part["o"].to_numpy()})

    slim = (
        arrivals.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
        .withWatermark(ts, lateness)
        .select(F.col(key).alias("k"), F.unix_micros(ts).alias("t"), F.col(order).alias("o"), ts)
    )
    kept = slim.groupBy("k").applyInPandasWithState(
        step, "k string, t long, o long", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )
    return kept.select(F.col("k").alias(key), F.timestamp_micros("t").alias(ts), F.col("o").alias(order))


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> int:
    """Process what is available and stop; the output is a Parquet table. Gives the number of late rows left out."""
    query = (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
