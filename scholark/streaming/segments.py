"""Click segments, windowed counts and incremental upserts over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "user_id bigint, event_id bigint, segment bigint, node_id bigint"
_STATE = "segment bigint, node_id bigint"


def windowed_counts(events: DataFrame, ts: str, key: str, length: str, late: str) -> DataFrame:
    """Events per ``key`` and tumbling window; events later than ``late`` behind the newest are dropped, state is bounded by it."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, length), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), key, "n")


def session_counts(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Events per ``key`` and session: a session ends when ``gap`` passes without an event."""
    counted = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def click_segments_stream(events: DataFrame) -> DataFrame:
    """The streaming form of click segmentation: ``events`` has ``user_id``, ``event_id``, ``us``, ``is_click`` and ``k``.

    Each user's state is the current segment and its node. Within a micro-batch events are taken in order of time;
    across micro-batches in order of arrival.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        segment, node = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        out = []
        for event, click, k in zip(rows["event_id"], rows["is_click"], rows["k"]):
            if click:
                segment, node = segment + 1, int(k)
            if segment:
                out.append((key[0], event, segment, node))
        state.update((segment, node))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "segment", "node_id"])

    return events.groupBy("user_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def append_versions(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Micro-batches appended as versions under ``folder``; ``latest`` reads the newest row of each key. A batch that is run
    again replaces itself, so the result is exactly-once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key by (batch, ``order``)."""
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("batch", order)).alias("r")).select(key, "r.*")
