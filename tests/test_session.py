"""Session helpers: spreading small inputs, the shared checkpoint folder."""

import kbpipe.session as S
from kbpipe.sources.tables import Tables


def test_spread_is_the_callers_or_the_sessions_choice(spark, sf):
    d = Tables(spark, sf).documents
    assert S.spread(d, 7).rdd.getNumPartitions() == 7
    assert S.spread(d).rdd.getNumPartitions() == 4     # as these tests' session says
    spark.conf.unset(S.SPREAD)
    try:
        assert S.spread(d) is d                        # off by default, whatever the size
    finally:
        spark.conf.set(S.SPREAD, "4")


def test_checkpoint_root_and_materialize(spark):
    root = S.checkpoint_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    df = spark.range(5)
    m = S.materialize(df, "t")
    assert sorted(r["id"] for r in m.collect()) == [0, 1, 2, 3, 4]
    assert S.scratch_path(spark, "x").startswith(root + "/x-")


def test_text_work_is_dealt_over_all_cores(spark, sf):
    """The redaction chain's input, however few its files are."""
    from kbpipe.plans import ingest, registry
    name = "spark.kbpipe.spreadPartitions"
    given = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        want = 4 * spark.sparkContext.defaultParallelism
        assert registry._chunk_input(spark, sf).rdd.getNumPartitions() == want
        one = spark.createDataFrame([(1, "s", "a text that is long enough to be a chunk of its own")],
                                    "doc_id bigint, source string, text string").coalesce(1)
        assert ingest.knowledge_points(one, "r", 8).rdd.getNumPartitions() == want
    finally:
        if given:
            spark.conf.set(name, given)
