"""Events kept in one folder a day, so that retention is a matter of folders.

The newest day comes from the folder names and the newest timestamp from that
day alone; what is kept is read from the folders within reach of it. Expiry
deletes whole days and reads nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbpipe.operators.metrics import RETENTION_DAYS

DAY = "event_day"


def write_events(events: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """Write ``events`` under ``event_day=yyyy-mm-dd``. Rows without a
    timestamp lie in a folder of their own and are never retained. A day of
    any size is written by the tasks that read it, without a shuffle."""
    events.withColumn(DAY, F.to_date(ts)).write.mode(mode).partitionBy(DAY).parquet(path)


def stored_days(spark: SparkSession, path: str) -> list[dt.date]:
    """Days that have a folder, oldest first: one listing, one name a day."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hpath)]
    return sorted(d for n in names if n.startswith(f"{DAY}=") and (d := _day(n.split("=", 1)[1])))


def _day(value: str) -> dt.date | None:
    try:
        return dt.date.fromisoformat(value)
    except ValueError:
        return None     # the folder of rows without a timestamp


def read_events(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(DAY, T.DateType())])).parquet(path)


def newest_ts(spark: SparkSession, path: str, schema: T.StructType, ts: str = "ts"):
    """The newest timestamp, read from the newest day; None for no events."""
    for day in reversed(stored_days(spark, path)):
        top = read_events(spark, path, schema).where(F.col(DAY) == F.lit(day)).agg(F.max(ts)).first()[0]
        if top is not None:
            return top
    return None


def retained(spark: SparkSession, path: str, schema: T.StructType, days: int = RETENTION_DAYS,
             ts: str = "ts") -> DataFrame:
    """Events within ``days`` of the newest timestamp, as ``log_retention``
    gives them; only the folders that can hold some are read."""
    top = newest_ts(spark, path, schema, ts)
    if top is None:
        return spark.createDataFrame([], schema)
    cutoff = top - dt.timedelta(days=days)
    in_reach = F.col(DAY) >= F.lit(cutoff.date())
    kept = F.col(ts) >= F.lit(cutoff).cast(schema[ts].dataType)
    return read_events(spark, path, schema).where(in_reach & kept).drop(DAY)


def expire(spark: SparkSession, path: str, schema: T.StructType, days: int = RETENTION_DAYS,
           ts: str = "ts") -> list[dt.date]:
    """Delete the days that lie wholly before the retained time; returns them.
    No event that ``retained`` gives is touched, so it can be run at any time
    and again."""
    top = newest_ts(spark, path, schema, ts)
    if top is None:
        return []
    gone = [d for d in stored_days(spark, path) if d < (top - dt.timedelta(days=days)).date()]
    for d in gone:
        hpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{DAY}={d.isoformat()}")
        hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)
    return gone
