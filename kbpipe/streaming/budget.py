"""Monthly budget alert over arriving charges, as a ``foreachBatch`` job.

The state is a small table, one row per month with its spend so far, written
anew by every micro-batch into a folder of its own. A month's charges are
summed with partial aggregation, and only where a micro-batch carries a month
over its limit are that batch's charges put in order (distributed, see
``metrics.running_sum``) to name the charge that did it. So the current month,
which holds nearly all charges, is never one task. A replayed batch reads the
state of the batch before and overwrites its own: exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbpipe.operators.metrics import BUDGET_ALERT_FRACTION, MONTHLY_BUDGET, fmt_ts, running_sum

STATE = "month string, spent decimal(38,2)"
ALERT = "month string, alert_ts string, charge_id bigint, month_to_date double"


def _state_before(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """The state that the last batch before ``batch_id`` left."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    done = [int(n.split("=")[1]) for n in names if n.startswith("batch=")]
    before = [n for n in done if n < batch_id]
    if not before:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{folder}/batch={max(before)}")


def budget_batch(charges: DataFrame, batch_id: int, state_dir: str, alerts_dir: str, budget: float = MONTHLY_BUDGET,
                 fraction: float = BUDGET_ALERT_FRACTION, ts: str = "ts", id_col: str = "id", cost: str = "cost") -> None:
    """One micro-batch: alerts of the months that it carries over the limit,
    and the new state. Charges without a time belong to no month; a NULL cost
    counts as nothing."""
    spark = charges.sparkSession
    limit = F.lit(budget * fraction).cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(38,2)")
    c = charges.where(F.col(ts).isNotNull()).select(
        F.date_format(ts, "yyyy-MM").alias("month"), F.col(ts).alias("t"), F.col(id_col).alias("i"),
        F.coalesce(F.col(cost), F.lit(0)).cast("decimal(18,2)").alias("cost"))
    old = _state_before(spark, state_dir, batch_id).withColumnRenamed("spent", "before")
    new = c.groupBy("month").agg(F.sum("cost").alias("added"))
    both = old.join(new, "month", "full").select(
        "month", F.coalesce("before", zero).alias("before"), F.coalesce("added", zero).alias("added"))
    state = f"{state_dir}/batch={batch_id}"
    crossing = both.where((F.col("before") < limit) & (F.col("before") + F.col("added") >= limit))
    rows = c.join(crossing.select("month", "before"), "month")
    running = running_sum(rows, "month", ["t", "i"], "cost", out="in_batch")
    to_date = F.col("before") + F.col("in_batch")
    first = running.where(to_date >= limit).groupBy("month").agg(
        F.min_by(F.struct("t", "i", to_date.alias("spent")), F.struct("t", "i")).alias("f"))
    first.select("month", fmt_ts(F.col("f.t")).alias("alert_ts"), F.col("f.i").cast("bigint").alias("charge_id"),
                 F.col("f.spent").cast("double").alias("month_to_date")) \
        .write.mode("overwrite").parquet(f"{alerts_dir}/batch={batch_id}")
    both.select("month", (F.col("before") + F.col("added")).cast("decimal(38,2)").alias("spent")) \
        .write.mode("overwrite").parquet(state)


def start_budget_alert(charges: DataFrame, state_dir: str, alerts_dir: str, checkpoint: str, available_now: bool = True,
                       budget: float = MONTHLY_BUDGET, fraction: float = BUDGET_ALERT_FRACTION):
    """A stream of charges (``ts, id, cost``) to alerts under ``alerts_dir``."""
    w = charges.writeStream.foreachBatch(lambda df, n: budget_batch(
        df, n, state_dir, alerts_dir, budget, fraction)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_alerts(spark: SparkSession, alerts_dir: str) -> DataFrame:
    return spark.read.schema(ALERT).option("recursiveFileLookup", "true").parquet(alerts_dir)
