import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from kbpipe.session import build_session
    s = build_session("local[4]", app="kbpipe-tests", shuffle_partitions=4, spread_partitions=4)
    # tests set their own shared folder only because none is configured here
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="kbpipe-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def one_col(spark, values, name="text", dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id bigint, {name} {dtype}")
