"""Sliding-window request alert as a Structured Streaming query.

Event time arrives as TIMESTAMP_NTZ; watermarks need TIMESTAMP, so it is
cast (sessions run in UTC, so the instant is unchanged). Append mode emits a
window once the watermark passes its end; late rows beyond the watermark are
dropped by the state store, as a streaming alert would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbpipe.operators.metrics import REQUEST_ALERT_THRESHOLD, REQUEST_SLIDE, REQUEST_WINDOW, fmt_ts

WATERMARK = "5 minutes"


def request_alert_stream(events: DataFrame, threshold: int = REQUEST_ALERT_THRESHOLD,
                         window: str = REQUEST_WINDOW, slide: str = REQUEST_SLIDE,
                         watermark: str = WATERMARK, ts: str = "ts") -> DataFrame:
    s = events.withColumn("_event_time", F.col(ts).cast("timestamp"))
    agg = (s.withWatermark("_event_time", watermark)
            .groupBy(F.window("_event_time", window, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("n_requests")))
    return (agg.where(F.col("n_requests") >= threshold)
               .select(fmt_ts(F.col("w.start")).alias("window_start"),
                       fmt_ts(F.col("w.end")).alias("window_end"), "n_requests"))


def start_request_alert(spark, source_dir: str, schema, sink_dir: str, checkpoint: str,
                        threshold: int = REQUEST_ALERT_THRESHOLD, available_now: bool = True,
                        max_files_per_trigger: int | None = None):
    """Parquet folder -> alert rows appended as parquet under ``sink_dir``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    alerts = request_alert_stream(reader.parquet(source_dir), threshold=threshold)
    w = (alerts.writeStream.outputMode("append").format("parquet")
               .option("path", sink_dir).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
