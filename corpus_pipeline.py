"""Corpus pipeline: ``documents`` through five of the training-data operators.

``STAGES`` lists (name, function); each takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and reread as the next one's
docs. All but the last return the columns of ``documents``. ``run`` applies
them in order.

Every stage takes NULLs in any column, empty and very long texts, repeated
rows and further columns of any name; an empty table leaves it empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbpipe.llm import decontam, packing, pii, quality, simhash
from kbpipe.llm.common import Scratch, free_name, table
from kbpipe.session import ship_package


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged. NULL and empty texts
    fail them; a NULL source is a host of its own; repeated rows stay or go
    together (see ``quality.judge``)."""
    ship_package(spark)
    kept = free_name("kept", docs.columns)
    return quality.judge(docs).where(F.col(kept)).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash component, unchanged: the smallest doc_id,
    and one row of it (see ``simhash.one_per_component`` for NULLs and ties)."""
    ship_package(spark)
    return simhash.one_per_component(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark, unchanged; NULL and
    empty texts are clean (see ``decontam.find_contamination``)."""
    ship_package(spark)
    flag = free_name("contaminated", docs.columns)
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col(flag)).select(*_columns(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by placeholders; NULL and empty
    texts stay as they are (see ``pii.redacted``)."""
    ship_package(spark)
    return pii.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens. NULL and
    empty texts are one piece of one token; NULL ids and repeated rows have
    pieces of their own; a very long text has as many as it needs (see
    ``packing.pack``)."""
    ship_package(spark)
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

# Fingerprints and byte-level tokens have no SQL; tests/llm compares run()
# with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage wrote for itself is deleted once its
    result is written, and its input with it."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with Scratch.collected() as made:
            before, docs = docs, scratch.write(stage(spark, docs, sf_dir))
        for s in made:
            s.drop_all()
        scratch.drop(before)
    return docs
