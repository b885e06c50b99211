"""Windows, alerts, running sums, and the two streaming jobs vs batch."""

import datetime as dt
import os
import shutil
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from kbpipe.operators import metrics as M
from kbpipe.plans.ingest import knowledge_points
from kbpipe.sources import backup, store
from kbpipe.sources.tables import Tables
from kbpipe.streaming.alerts import start_request_alert
from kbpipe.streaming.ingest import start_ingest


def test_running_sum_equals_plain_window(spark, sf):
    e = Tables(spark, sf).events.withColumn("month", F.date_format("ts", "yyyy-MM-dd"))
    r = M.running_sum(e, "month", ["ts", "event_id"], "value", out="run", buckets=7)
    w = Window.partitionBy("month").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    plain = e.withColumn("run2", F.sum("value").over(w))
    j = r.join(plain.select("event_id", "run2"), "event_id")
    assert j.count() == e.count()
    assert j.where(F.abs(F.col("run") - F.col("run2")) > 1e-6).count() == 0


def test_budget_alert_first_crossing(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 10), 5), (2, dt.datetime(2024, 1, 2, 10), 3),
            (3, dt.datetime(2024, 1, 3, 10), 2), (4, dt.datetime(2024, 1, 4, 10), 9),
            (5, dt.datetime(2024, 2, 1, 10), 1)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, cost int") \
              .withColumn("cost", F.col("cost").cast("decimal(18,2)"))
    got = [(r["month"], r["charge_id"], r["month_to_date"]) for r in M.budget_alert(df).collect()]
    assert got == [("2024-01", 3, 10.0)]


def test_request_alert_window_counts(spark):
    base = dt.datetime(2024, 1, 1, 0, 0, 30)
    rows = [(i, base + dt.timedelta(seconds=20 * i)) for i in range(6)]   # 00:00:30 .. 00:02:10
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz")
    got = {r["window_start"]: r["n_requests"] for r in M.request_alert(df, threshold=6).collect()}
    assert got == {"2023-12-31 23:58:00": 6, "2023-12-31 23:59:00": 6, "2024-01-01 00:00:00": 6}


def test_retention_and_export(spark, sf):
    e = Tables(spark, sf).events
    kept = M.log_retention(e, days=7)
    newest = e.agg(F.max("ts")).first()[0]
    assert kept.agg(F.min("ts")).first()[0] >= newest - dt.timedelta(days=7)
    ex = M.counter_export(e)
    last = ex.groupBy("event_type").agg(F.max("cumulative").alias("c"))
    per_type = e.groupBy("event_type").count()
    assert last.join(per_type, "event_type").where(F.col("c") != F.col("count")).count() == 0


def _split_copy(df, folder, key, n):
    df.withColumn("_p", F.pmod(F.col(key), F.lit(n))).repartition(n, "_p").drop("_p") \
      .write.mode("overwrite").parquet(folder)


def _time_ordered_copy(df, folder, tmp, n):
    """Files that arrive in event-time order, as a log shipper writes them."""
    os.makedirs(folder)
    lo = df.agg(F.min("ts")).first()[0]
    days = F.datediff(F.col("ts"), F.lit(lo))
    span = df.agg(F.max(days)).first()[0] + 1
    for g in range(n):
        part = df.where((days * n / span).cast("int") == g)
        out = os.path.join(tmp, f"g{g}")
        part.coalesce(1).write.parquet(out)
        (f,) = [x for x in os.listdir(out) if x.endswith(".parquet")]
        shutil.copy(os.path.join(out, f), os.path.join(folder, f"events-{g}.parquet"))
        time.sleep(1.1)


def test_streaming_alert_equals_batch(spark, sf, tmp_path):
    e = Tables(spark, sf).events
    src = str(tmp_path / "events")
    _time_ordered_copy(e, src, str(tmp_path / "staging"), 4)
    q = start_request_alert(spark, src, e.schema, str(tmp_path / "out"), str(tmp_path / "ck"),
                            threshold=3, max_files_per_trigger=1)
    q.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out"))
    horizon = e.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=5)
    cut = F.to_timestamp("window_end") <= F.lit(horizon)
    batch = M.request_alert(e, threshold=3).where(cut)
    stream = got.where(cut)
    assert stream.exceptAll(batch).count() == 0 and batch.exceptAll(stream).count() == 0
    assert batch.count() > 0


def test_streaming_ingest_equals_batch(spark, sf, tmp_path):
    d = Tables(spark, sf).documents
    src = str(tmp_path / "docs")
    _split_copy(d, src, "doc_id", 3)
    table, bk = str(tmp_path / "kb"), str(tmp_path / "backup")
    q = start_ingest(spark, src, d.schema, table, bk, str(tmp_path / "ck"), dim=256,
                     max_files_per_trigger=1)
    q.awaitTermination(600)
    kb = store.read_table(spark, table).select("text", "source")
    batch = knowledge_points(d, "x", dim=256).select("text", "source")
    assert kb.exceptAll(batch).count() == 0 and batch.exceptAll(kb).count() == 0
    assert backup.restore_backup(spark, bk).count() == d.count()


def test_running_sum_keeps_null_parts_and_needs_no_exchange_reuse(spark):
    from pyspark.sql import functions as F

    from kbpipe.operators.metrics import running_sum
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("part"),
                                  (F.col("id") * 7919 % 5000).alias("ts"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r["id"]: r["running"] for r in running_sum(df, "part", ["ts", "id"], "v", buckets=7).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    want, sums = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r["ts"], r["id"])):
        want[r["id"]] = sums[r["part"]] = sums.get(r["part"], 0) + r["v"]
    assert got == want


def _alarms(spark, tmp, batches, threshold):
    """Micro-batches of event times (seconds), one run each; rows by kind."""
    from kbpipe.streaming import counters as K
    src, out, ck = (str(tmp / n) for n in ("in", "out", "ck"))
    seen = []
    for secs in batches:
        spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s) if s is not None else None, "k")
                               for s in secs], "ts timestamp_ntz, event_type string").write.mode("append").parquet(src)
        s = spark.readStream.schema("ts timestamp_ntz, event_type string").parquet(src)
        K.start_append(K.request_alarms(s, threshold=threshold), out, ck, state_partitions=2).awaitTermination(300)
        seen.append(sorted(tuple(r) for r in spark.read.parquet(out).collect()))
    return seen, sorted(tuple(r) for r in K.open_alarms(spark, ck).collect())


def test_alarm_is_raised_at_the_crossing_and_once(spark, tmp_path):
    runs, still_open = _alarms(spark, tmp_path, [[60, 70, None], [80, 90, 95], [3600]], threshold=3)
    minutes = [f"2024-01-01 00:0{m}:00" for m in range(2)] + [f"2023-12-31 23:5{m}:00" for m in range(7, 10)]
    ends = {"2024-01-01 00:00:00": "2024-01-01 00:05:00", "2024-01-01 00:01:00": "2024-01-01 00:06:00",
            "2023-12-31 23:57:00": "2024-01-01 00:02:00", "2023-12-31 23:58:00": "2024-01-01 00:03:00",
            "2023-12-31 23:59:00": "2024-01-01 00:04:00"}
    raised = sorted((m, ends[m], 5, "raised") for m in minutes)
    assert runs[0] == []                                        # two events: below the load
    assert runs[1] == raised                                    # raised with the batch that reaches it
    assert runs[2] == sorted(raised + [(m, ends[m], 5, "closed") for m in minutes])
    assert still_open == []


def test_open_windows_come_from_the_state(spark, tmp_path):
    runs, still_open = _alarms(spark, tmp_path, [[0, 1, 2], [3]], threshold=3)
    assert len(runs[1]) == 5 and {r[3] for r in runs[1]} == {"raised"}      # not raised again
    assert [r[2:] for r in still_open] == [(4, "open")] * 5


def test_counter_goes_on_after_a_restart_and_late_events_are_left_out(spark, tmp_path):
    from kbpipe.streaming import counters as K
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "ts timestamp_ntz, event_type string"
    for rows in ([(5, "a"), (6, "a"), (65, "a"), (7, "b"), (8, None)], [(66, "a"), (1200, "a")], [(10, "a"), (1201, "a")]):
        spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), k) for s, k in rows], schema) \
            .write.mode("append").parquet(src)
        K.start_append(K.counter_exports(spark.readStream.schema(schema).parquet(src)), out, ck, state_partitions=2).awaitTermination(300)
    got = sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str)
    assert got == sorted([("a", "2024-01-01 00:01:00", 2, 2), ("a", "2024-01-01 00:02:00", 2, 4),
                          ("b", "2024-01-01 00:01:00", 1, 1), (None, "2024-01-01 00:01:00", 1, 1)], key=str)
    # the event at second 10 came after its period was exported
    assert [tuple(r) for r in K.open_counters(spark, ck).collect()] == [("a", "2024-01-01 00:21:00", 2, 6)]


def test_budget_is_crossed_in_a_later_batch_and_replays_change_nothing(spark, tmp_path):
    from decimal import Decimal

    from kbpipe.streaming.budget import budget_batch, read_alerts
    state, alerts = str(tmp_path / "state"), str(tmp_path / "alerts")
    day = dt.datetime(2024, 3, 1)

    def batch(n, *rows):
        df = spark.createDataFrame([(day + dt.timedelta(days=d) if d is not None else None, i, Decimal(c) if c else None)
                                    for d, i, c in rows], "ts timestamp_ntz, id bigint, cost decimal(18,2)")
        budget_batch(df, n, state, alerts)
        return sorted(tuple(r) for r in read_alerts(spark, alerts).collect())

    assert batch(0, (0, 1, "4.00"), (1, 2, "3.00"), (40, 3, "8.99"), (None, 4, "99.00"), (2, 5, None)) == []
    want = [("2024-03", "2024-03-05 00:00:00", 7, 9.5)]
    for _ in range(2):      # the second time as a replay
        assert batch(1, (5, 8, "50.00"), (4, 7, "2.00"), (3, 6, "0.50")) == want
    assert batch(2, (6, 9, "1.00"), (41, 10, "0.01")) == want + [("2024-04", "2024-04-11 00:00:00", 10, 9.0)]
    assert batch(3) == want + [("2024-04", "2024-04-11 00:00:00", 10, 9.0)]


def test_frontier_stream_brings_each_link_once(spark, tmp_path):
    from kbpipe.streaming.frontier import start_frontier
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "page_id bigint, url string, html string"
    visited = spark.createDataFrame([("http://h.org/seen",), (None,)], "url string")
    runs = [[(1, "http://h.org/a", '<a href="/x">x</a><a href="/x">x</a><a href="/seen">s</a><a href="http://o.org/y">o</a>')],
            [(2, "http://h.org/b", '<a href="/x">x</a><a href="/z">z</a>'), (3, None, None)]]
    for rows in runs:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        start_frontier(spark.readStream.schema(schema).parquet(src), visited, out, ck, state_partitions=2).awaitTermination(300)
    assert sorted(r["url"] for r in spark.read.schema("url string").parquet(out).collect()) == ["http://h.org/x", "http://h.org/z"]


def test_restore_stream_sorts_good_from_bad(spark, tmp_path):
    from kbpipe.streaming.ingest import start_restore
    src = tmp_path / "in"
    src.mkdir()
    table, bad, ck = (str(tmp_path / n) for n in ("t", "bad", "ck"))
    arrivals = [{"a.json": '{"url": "u", "text": "one"}', "b.json": "{ this is not valid json }", "c.txt": '{"text": "no"}'},
                {"d.json": '[{"text": "x"}]', "e.json": '{"url": null,\n "text": "two"}', "f.json": '{"url": "v"}',
                 "g.json": '{"text": 3}', "h.json": ""}]
    for files in arrivals:
        for name, body in files.items():
            (src / name).write_text(body)
        start_restore(spark, str(src), table, bad, ck, dim=16).awaitTermination(300)
    got = sorted(((r["original_file"], r["source"], r["text"], r["restored"]) for r in store.read_table(spark, table).collect()))
    assert got == [("a.json", "u", "one", "true"), ("e.json", None, "two", "true"), ("g.json", "unknown", "3", "true")]
    why = spark.read.schema("file string, reason string").option("recursiveFileLookup", "true").parquet(bad).collect()
    assert sorted(map(tuple, why)) == [("b.json", "not JSON"), ("d.json", "not an object"), ("f.json", "no text")]      # h.json has no bytes, so no record
