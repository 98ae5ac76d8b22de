"""Structured Streaming: per-series lateness, exactly-once appends and windowed results.

A watermark holds for a whole query; here each series has its own newest time, kept as state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import values as V
from ..operators import aggregate


def admit_stream(samples: DataFrame, allowed: int) -> DataFrame:
    """(series_id, ts, value, ingest_seq, reason); reason is 'late' for a sample older than its series' newest by more than allowed, else null. allowed <= 0: never late."""
    rows = samples.select("series_id", "ts", F.col("value").cast("double").alias("value"), "ingest_seq")

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("ingest_seq", kind="stable")
        ts = pdf["ts"].to_numpy(np.int64)
        start = state.get[0] if state.exists else ts[0]
        newest = np.maximum.accumulate(np.concatenate([[start], ts]))  # before each sample; a late one never moves it
        late = ts < newest[:-1] - allowed if allowed > 0 else np.zeros(len(ts), bool)
        state.update((int(newest[-1]),))
        reasons = np.where(late, "late", None)
        yield pdf.assign(reason=pd.Series(reasons, index=pdf.index, dtype=object))

    return rows.groupBy("series_id").applyInPandasWithState(step, "series_id string, ts bigint, value double, ingest_seq bigint, reason string", "newest bigint", "append", GroupStateTimeout.NoTimeout)


def append_once(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Each micro-batch goes to its own folder by batch number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()


def admit_records(records: DataFrame, allowed: int) -> DataFrame:
    """As admit_stream, for records of streams: (stream_id, ts, ingest_seq, reason)."""
    rows = records.select(F.col("stream_id").alias("series_id"), "ts", F.lit(0.0).alias("value"), "ingest_seq")
    judged = admit_stream(rows, allowed)
    return judged.select(F.col("series_id").alias("stream_id"), "ts", "ingest_seq", "reason")


def windowed(stream: DataFrame, step: str, window: str, delay: str) -> DataFrame:
    """Sliding aggregates of a stream with a column at (timestamp), final once the watermark has passed."""
    cells = stream.withWatermark("at", delay).groupBy("series_id", F.window("at", window, step))
    return aggregate.finish(cells.agg(*aggregate.partial())).withColumn("window_end", V.to_ns("window.end")).drop("window")
