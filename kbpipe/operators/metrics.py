"""Counters, windows and alerts over event tables.

Time columns arrive as TIMESTAMP_NTZ; sessions run in UTC. Timestamps are
reported as ``yyyy-MM-dd HH:mm:ss`` strings so results compare across engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbpipe.session import materialize

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Alert settings (thresholds are parameters with these defaults)
REQUEST_ALERT_THRESHOLD = 500
REQUEST_WINDOW = "5 minutes"
REQUEST_SLIDE = "1 minute"
MONTHLY_BUDGET = 10.0
BUDGET_ALERT_FRACTION = 0.9
RETENTION_DAYS = 30
EXPORT_PERIOD = "60 seconds"


def fmt_ts(c):
    return F.date_format(c, TS_FORMAT)


def request_alert(events: DataFrame, threshold: int = REQUEST_ALERT_THRESHOLD,
                  window: str = REQUEST_WINDOW, slide: str = REQUEST_SLIDE,
                  ts: str = "ts") -> DataFrame:
    """Sliding windows whose request count reaches the threshold.

    Each event falls in window/slide windows; the count is combinable, so a
    hot window is pre-aggregated map-side before the shuffle.
    """
    w = events.groupBy(F.window(F.col(ts), window, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("n_requests"))
    return (w.where(F.col("n_requests") >= threshold)
             .select(fmt_ts(F.col("w.start")).alias("window_start"),
                     fmt_ts(F.col("w.end")).alias("window_end"),
                     "n_requests"))


BUCKET_ROWS = 1 << 20     # rows of a bucket, on average


def running_sum(df: DataFrame, part: str, order: list[str], value: str,
                out: str = "running", buckets: int | None = None) -> DataFrame:
    """``sum(value) OVER (PARTITION BY part ORDER BY order ROWS UNBOUNDED
    PRECEDING)`` without putting a whole partition in one task.

    Rows are range-partitioned on (part, order...) into balanced buckets
    (ties in time are split by the later order keys) and written once with
    their bucket, so that every later step sees the same buckets; bucket
    totals (one row per bucket and part) give each bucket its offset; the
    running sum inside a bucket is an ordinary window. A NULL ``part`` is a
    partition of its own.
    """
    n = buckets or max(1, -(-df.count() // BUCKET_ROWS))
    b = materialize(df.repartitionByRange(n, part, *order).withColumn("_bucket", F.spark_partition_id()),
                    "running-sum")
    totals = b.groupBy(part, "_bucket").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(part).alias("_part"), F.col("_bucket").alias("_b"), F.coalesce(
        F.sum("_total").over(before), F.lit(0).cast(totals.schema["_total"].dataType)).alias("_offset"))
    b = b.join(offsets, F.col(part).eqNullSafe(F.col("_part")) & (F.col("_bucket") == F.col("_b")))
    inner = Window.partitionBy(part, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn(out, F.col("_offset") + F.sum(value).over(inner)).drop("_bucket", "_offset", "_part", "_b")


def budget_alert(costs: DataFrame, budget: float = MONTHLY_BUDGET,
                 fraction: float = BUDGET_ALERT_FRACTION, ts: str = "ts",
                 id_col: str = "id", cost: str = "cost") -> DataFrame:
    """Per calendar month, the first charge at which month-to-date spend
    reaches ``fraction * budget``. Sums are exact (DECIMAL)."""
    c = costs.withColumn("month", F.date_format(F.col(ts), "yyyy-MM"))
    r = running_sum(c, "month", [ts, id_col], cost, out="month_to_date")
    limit = F.lit(budget * fraction).cast("decimal(18,2)")
    crossed = r.where(F.col("month_to_date") >= limit)
    first = crossed.groupBy("month").agg(F.min_by(
        F.struct(F.col(ts).alias("t"), F.col(id_col).alias("i"), "month_to_date"),
        F.struct(ts, id_col)).alias("f"))
    return first.select("month", fmt_ts(F.col("f.t")).alias("alert_ts"),
                        F.col("f.i").alias("charge_id"),
                        F.col("f.month_to_date").cast("double").alias("month_to_date"))


def log_retention(events: DataFrame, days: int = RETENTION_DAYS, ts: str = "ts") -> DataFrame:
    """Rows within ``days`` of the newest timestamp. The newest timestamp is
    a scalar subquery (one tiny aggregate job), not a join."""
    newest = events.select(F.max(ts)).scalar()
    cutoff = newest - F.expr(f"INTERVAL {int(days)} DAYS")
    return events.where(F.col(ts) >= cutoff)


def counter_export(events: DataFrame, period: str = EXPORT_PERIOD, ts: str = "ts",
                   key: str = "event_type") -> DataFrame:
    """Per key and export period: events in the period and the cumulative
    counter value. The window runs over the per-period series (bounded by
    time span / period), not over raw events."""
    per = events.groupBy(key, F.window(F.col(ts), period).alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"))
    run = Window.partitionBy(key).orderBy("w.end").rowsBetween(Window.unboundedPreceding, 0)
    return per.select(key, fmt_ts(F.col("w.end")).alias("exported_at"), "n_events",
                      F.sum("n_events").over(run).alias("cumulative"))


def ingest_counts(points: DataFrame, key: str = "type") -> DataFrame:
    """Ingested points per type (counts attempts: write errors are not
    subtracted, matching the service's counters)."""
    return points.groupBy(key).agg(F.count(F.lit(1)).alias("n_indexed"))
