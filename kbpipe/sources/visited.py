"""The urls a crawl has fetched, as a table bucketed by url.

Every round appends its urls; the frontier asks the whole table. Bucketed by
``url``, the stored side is read where the join wants it and never shuffled,
however many rounds it holds: only the round's new links move.

Urls may be stored more than once (a retried round appends again): the anti
join takes the table as a set, so a retry changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbpipe.operators.common import settled

URL = "url"


def default_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mark_visited(urls: DataFrame, table: str, path: str | None = None, buckets: int | None = None) -> None:
    """Append the ``url`` column of ``urls`` (NULLs left out, each url once) to
    ``table``, made on first use with ``buckets`` buckets (the session's
    shuffle partitions unless given) at ``path`` (else in the warehouse). One
    shuffle on ``url`` leaves one file a bucket and round."""
    spark = urls.sparkSession
    known = spark.catalog.tableExists(table)
    n = (bucket_count(spark, table) if known else buckets) or default_buckets(spark)
    once = urls.select(URL).where(F.col(URL).isNotNull()).distinct()
    w = once.repartition(n, URL).write.format("parquet").bucketBy(n, URL).sortBy(URL)
    if path and not known:
        w = w.option("path", path)
    w.mode("append").saveAsTable(table)


def bucket_count(spark: SparkSession, table: str) -> int | None:
    """Buckets of ``table``; NULL (None) if it isn't bucketed."""
    rows = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").select("data_type").collect()
    return int(rows[0][0]) if rows else None


def new_urls(links: DataFrame, table: str, link: str = "link") -> DataFrame:
    """``url``: the distinct links that ``table`` doesn't hold. Links are made
    distinct before they move, then moved into the table's buckets if the
    session's shuffle has another count; the table is merged as it lies (a
    broadcast or a hash table of it would grow with the crawl)."""
    spark = links.sparkSession
    cand = links.select(F.col(link).alias(URL)).distinct()
    n = bucket_count(spark, table)
    if n and n != default_buckets(spark):
        cand = cand.repartition(n, URL)
    return settled(cand).join(spark.table(table).select(URL).hint("merge"), URL, "left_anti")
