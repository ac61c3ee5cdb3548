"""Queries that run as streams over the events table, read to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholark.session import scratch_path
from scholark.sources.tables import table
from scholark.streaming.segments import click_segments_stream


def _stream(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    reader = spark.readStream.schema(events.schema)
    if any("/events.parquet/" in f for f in events.inputFiles()):
        return reader.parquet(f"{d}/events.parquet")
    return reader.option("pathGlobFilter", "events.parquet").parquet(d)


def _run(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """The stream's rows once its source is read, from files in the shared folder."""
    home = scratch_path(spark, "stream")
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")


def stream_click_segments(spark: SparkSession, d: str) -> DataFrame:
    events = _stream(spark, d).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_type") == "click").alias("is_click"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return _run(spark, click_segments_stream(events), "append")


QUERIES = {"stream_click_segments": stream_click_segments}

ORACLES = {
    "stream_click_segments": """WITH ev AS (SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us FROM events),
        m AS (SELECT *, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS segment FROM ev)
        SELECT user_id, event_id, segment, first_value(k) OVER (PARTITION BY user_id, segment ORDER BY us, event_id) AS node_id FROM m WHERE segment > 0""",
}

__all__ = ["ORACLES", "QUERIES"]
