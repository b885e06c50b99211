"""Stored tables that plans lean on: visited urls by bucket, events by day."""

import datetime as dt
import time
import uuid

import pytest
from pyspark.sql import functions as F

from kbpipe.operators import metrics as M
from kbpipe.sources import events, store, visited
from kbpipe.sources.tables import Tables


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("buckets", [None, 2, 7])
def test_new_urls_never_shuffle_the_visited_side(spark, tmp_path, buckets):
    name = f"visited_{uuid.uuid4().hex[:8]}"
    try:
        for urls in ([("u1",), ("u2",), (None,)], [("u2",), ("u3",)], [("u2",), ("u3",)]):   # the last is a retry
            visited.mark_visited(spark.createDataFrame(urls, "url string"), name, str(tmp_path / "v"), buckets)
        assert visited.bucket_count(spark, name) == (buckets or 4)
        links = spark.createDataFrame([("u1",), ("u4",), ("u4",), ("u5",), ("U1",)], "link string")
        new = visited.new_urls(links, name)
        assert sorted(r.url for r in new.collect()) == ["U1", "u4", "u5"]
        plan = executed(visited.new_urls(links, name))
        links_side, stored = plan.split("SortMergeJoin")[1].split("FileScan parquet")
        # distinct before the only shuffle; another bucket count moves the distinct links once more
        assert links_side.count("Exchange hashpartitioning") == (1 if buckets is None else 2)
        assert links_side.count("HashAggregate(keys=[url") == 2
        assert "Bucketed: true" in stored and "Exchange" not in links_side.split("Scan ExistingRDD")[1]
        assert visited.new_urls(links.limit(0), name).count() == 0
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_visited_table_without_urls(spark, tmp_path):
    name = f"visited_{uuid.uuid4().hex[:8]}"
    try:
        visited.mark_visited(spark.createDataFrame([], "url string"), name, str(tmp_path / "v"))
        links = spark.createDataFrame([("a",), ("a",)], "link string")
        assert [r.url for r in visited.new_urls(links, name).collect()] == ["a"]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_retention_reads_only_the_days_in_reach(spark, sf, tmp_path):
    e = Tables(spark, sf).events
    path = str(tmp_path / "events")
    events.write_events(e, path)
    want = sorted(r.event_id for r in M.log_retention(e, days=7).collect())
    kept = events.retained(spark, path, e.schema, days=7)
    assert kept.columns == e.columns
    assert sorted(r.event_id for r in kept.collect()) == want
    plan = executed(kept)
    assert "PartitionFilters: [isnotnull(event_day" in plan
    days = events.stored_days(spark, path)
    gone = events.expire(spark, path, e.schema, days=7)
    assert gone and events.stored_days(spark, path) == days[len(gone):]
    assert events.expire(spark, path, e.schema, days=7) == []
    assert sorted(r.event_id for r in events.retained(spark, path, e.schema, days=7).collect()) == want


def test_retention_edges(spark, tmp_path):
    path = str(tmp_path / "events")
    schema = "event_id bigint, ts timestamp_ntz"
    none = spark.createDataFrame([], schema)
    assert events.retained(spark, path, none.schema).count() == 0 and events.expire(spark, path, none.schema) == []
    top = dt.datetime(2024, 3, 10, 12, 0)
    rows = [(1, top), (2, top - dt.timedelta(days=2)), (3, top - dt.timedelta(days=2, seconds=1)),
            (4, top - dt.timedelta(days=9)), (5, None), (1, top)]
    df = spark.createDataFrame(rows, schema)
    events.write_events(df, path)
    assert events.newest_ts(spark, path, df.schema) == top
    got = events.retained(spark, path, df.schema, days=2)
    assert sorted(r.event_id for r in got.collect()) == [1, 1, 2]          # the boundary stays, repeats too
    assert events.expire(spark, path, df.schema, days=2) == [dt.date(2024, 3, 1)]
    # an earlier day arriving late is kept or expired by the same rule
    events.write_events(spark.createDataFrame([(6, top - dt.timedelta(days=1))], schema), path)
    assert events.retained(spark, path, df.schema, days=2).where(F.col("event_id") == 6).count() == 1


def files_under(folder):
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file()) if folder.exists() else 0


def test_writes_leave_no_shuffle_files(spark, tmp_path):
    """Nor does a scratch table stay, and the session's setting does."""
    from pathlib import Path

    from kbpipe.session import SHUFFLE_CLEANUP, checkpoint_root, scratch_table
    local = [Path(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
             .diskBlockManager().localDirsString()]
    names = lambda: {p.name for d in local for p in d.rglob("shuffle_*.data")}
    df = spark.range(20000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    set_to = spark.conf.get(SHUFFLE_CLEANUP, "false")
    df.repartition(7).write.parquet(str(tmp_path / "plain"))
    before = names()
    assert before or set_to == "true"           # what stays of a plain write
    store.write_run(df.repartition(7), str(tmp_path / "t"), "r")
    with scratch_table(df.repartition(7), "scratch-test") as t:
        assert t.count() == 20000
        scratch = [p for p in Path(checkpoint_root(spark)).glob("scratch-test-*")]
        assert len(scratch) == 1
    time.sleep(3)                               # files go in the background
    left = {n.split("_")[1] for n in names() - before}
    assert not scratch[0].exists() and len(left) <= 1        # the count's own shuffle
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == set_to


def test_point_counts_by_digest(spark):
    """As grouped by text and source; no text passes more than one shuffle."""
    from kbpipe.plans.registry import _point_counts
    p = spark.createDataFrame([("a", "t", "s"), ("a", "t", "s"), ("b", "t", "s"), ("c", "t", None), ("d", None, "s"),
                               ("e", "", "s"), ("f", None, None)], "id string, text string, source string")
    got = sorted(map(tuple, _point_counts(p).collect()), key=str)
    want = p.groupBy("text", "source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("m"))
    assert got == sorted(map(tuple, want.collect()), key=str)
    plan = _point_counts(p)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "text#" in x.split("Exchange")[1]]
