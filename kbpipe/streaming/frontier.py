"""Crawl frontier over arriving pages: links that were not seen and not
visited, each once.

Duplicates are dropped by ``dropDuplicatesWithinWatermark`` on the time a file
arrived, so the state holds the links of the last ``delay`` only; what was
fetched before is the visited table, an anti join with a stored table. A link
found again after ``delay`` comes again unless it has been visited by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbpipe.operators import web
from kbpipe.streaming.counters import keyed_state

DELAY = "1 day"


def frontier_stream(pages: DataFrame, visited: DataFrame, delay: str = DELAY) -> DataFrame:
    """``url`` of new same-site links; ``pages`` is a file stream."""
    arrived = pages.withColumn("arrived", F.col("_metadata.file_modification_time")).withWatermark("arrived", delay)
    links = web.same_site(web.page_links(arrived, keep=("arrived",))).select(F.col("link").alias("url"), "arrived")
    new = links.dropDuplicatesWithinWatermark(["url"])
    return new.join(visited.select("url").distinct(), "url", "left_anti").select("url")


def start_frontier(pages: DataFrame, visited: DataFrame, sink_dir: str, checkpoint: str, delay: str = DELAY,
                   available_now: bool = True, state_partitions: int | None = None):
    w = (frontier_stream(pages, visited, delay).writeStream.outputMode("append").format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    with keyed_state(pages.sparkSession, state_partitions):
        return w.start()
