"""Session construction and the few cluster-level helpers every job needs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "kbpipe",
                  shuffle_partitions: int | None = None, spread_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session with AQE on and a UTC clock.

    On a cluster ``master`` is left to spark-submit; locally pass ``local[N]``.
    Shuffle partitions default to 2x the cores locally; on a cluster AQE
    coalesces whatever the cluster config asks for.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # vectors are 3072 floats: 2048-row Arrow batches keep a Python
        # worker's batch (widened to float64 for scoring) near 50 MB
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # one BLAS thread per Python worker: executors already run one
        # worker per core, nested thread pools only oversubscribe
        "spark.executorEnv.OMP_NUM_THREADS": "1",
        "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
        "spark.executorEnv.MKL_NUM_THREADS": "1",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if spread_partitions:
        conf[SPREAD] = str(spread_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    bound_batches(spark)
    return spark


ARROW_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Keep a Python worker's Arrow batch near 16 MB unless the session says
    otherwise: rows of long texts or many vectors would fill Spark's 64 MB, in
    every worker and again in its JVM buffer."""
    if spark.conf.get(ARROW_BATCH_BYTES, None) is None:
        spark.conf.set(ARROW_BATCH_BYTES, str(16 << 20))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (UDFs, the top-k
    kernel), as ``--py-files`` would: zip it once per application and add
    it with ``addPyFile``; Spark distributes it with the tasks."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="kbpipe-pyfiles-"), "kbpipe.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for materialised intermediates and sinks.

    Reads ``spark.checkpoint.dir`` (the cluster's shared location). Only when
    it is unset on a local master, as in tests, a fresh temporary folder is
    made and registered, so that later ``checkpoint()`` calls agree with it.
    On a cluster a machine-local folder would vanish with its executor, so an
    unset value is an error there.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir.rstrip("/")
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="kbpipe-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder name under the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared root and read it back.

    Cuts lineage (a lost executor re-reads files instead of recomputing the
    whole upstream plan) and lets one result feed several sinks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when their write is done, not when
    the driver happens to collect its garbage: a job of several writes would
    keep the input of each on disk. A session that sets this itself has its way."""
    if spark.conf.get(SHUFFLE_CLEANUP, "false") == "true":
        yield
        return
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, "false")


@contextmanager
def scratch_table(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` written once and read back, for several sinks; gone afterwards."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    try:
        with brief_shuffles(spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


SPREAD = "spark.kbpipe.spreadPartitions"


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over ``partitions`` tasks, or as many as the session
    names in ``spark.kbpipe.spreadPartitions``; as it is when neither is
    given.

    For inputs of fewer files and row groups than cores, in front of the
    CPU-heavy text operators. It costs a shuffle of the input, so it is the
    deployment's choice and off by default: a large table is already split by
    ``spark.sql.files.maxPartitionBytes``.
    """
    n = partitions or df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(n)) if n else df


def deal(df: DataFrame, per_core: int = 4) -> DataFrame:
    """``df`` over a few tasks per core, or over as many as ``spread`` is told.

    For the redaction chain and the embedder, whose work per row outweighs a
    shuffle of their input by far: a table in few files or row groups would
    otherwise keep most cores idle, and its longest task grows with it.
    """
    sc = df.sparkSession.sparkContext
    return spread(df, df.sparkSession.conf.get(SPREAD, None) or per_core * sc.defaultParallelism)
