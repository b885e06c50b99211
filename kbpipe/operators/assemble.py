"""Document text from element tables (pages, paragraphs, sheet cells).

Byte decoders are out of scope; decoded elements arrive as rows and the
ordered concatenation is a grouped ``listagg``. A document's text is one
value, so its elements meet in one group; cell rows are pre-joined per
(sheet, row) in a first, wider-keyed aggregation so a huge workbook spreads
over many tasks before its row strings meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbpipe.functions.text import py_strip
from kbpipe.operators.common import ORDERED_BLOCK, computed, listagg_ordered, ordered_concat


def _ordered(text: str, sep: str, *order: str):
    return listagg_ordered(text, sep, *order)


def join_elements(elements: DataFrame, key: str, order: str, text: str = "text",
                  sep: str = " ", strip: bool = True, keep_empty: bool = False,
                  documents: DataFrame | None = None) -> DataFrame:
    """Skip empty elements, join the rest in order.

    ``strip``/``keep_empty`` select the two flavours: crawl (space, strip,
    drop empty documents) and upload (newline, no strip, keep empty ones).
    """
    nonempty = F.col(text).isNotNull() & (F.col(text) != "")
    e = elements.select(key, order, F.when(nonempty, F.col(text)).alias(text))
    agg = ordered_concat(e, key, order, text, sep, out="text")
    if documents is not None:
        # documents with no element at all (a PDF without pages) still count
        agg = documents.select(key).distinct().join(agg, key, "left")
    out = agg.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    if strip:
        out = computed(out, text=py_strip("text"))
    if not keep_empty:
        out = out.where(F.col("text") != "")
    return out


def assemble_pdf_pages(pages: DataFrame) -> DataFrame:
    return join_elements(pages, "doc_id", "page_no", sep=" ", strip=True)


def assemble_pdf_upload(pages: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Upload flavour: newline-joined, not stripped; empty documents kept
    (also those absent from ``pages`` when the ``documents`` list is given)."""
    return join_elements(pages, "doc_id", "page_no", sep="\n", strip=False, keep_empty=True,
                         documents=documents)


def assemble_paragraphs(paragraphs: DataFrame) -> DataFrame:
    return join_elements(paragraphs, "doc_id", "para_no", sep=" ", strip=True)


def assemble_cells(cells: DataFrame) -> DataFrame:
    """Per row: non-NULL cells as strings joined by spaces (rows without any
    are skipped); rows joined by spaces in sheet, row order; strip; empty
    documents dropped. Runs of a sheet's rows are joined before a document's
    runs meet, so a huge workbook spreads over many tasks."""
    c = cells.where(F.col("value").isNotNull())
    c = c.withColumn("value", F.col("value").cast("string"))
    rows = c.groupBy("doc_id", "sheet_no", "row_no").agg(
        _ordered("value", " ", "col_no").alias("row_text"))
    run = F.floor(F.col("row_no") / F.lit(ORDERED_BLOCK)).alias("run_no")
    runs = rows.groupBy("doc_id", "sheet_no", run).agg(_ordered("row_text", " ", "row_no").alias("run_text"))
    docs = runs.groupBy("doc_id").agg(_ordered("run_text", " ", "sheet_no", "run_no").alias("text"))
    return computed(docs, text=py_strip("text")).where(F.col("text") != "")


def upload_status(filename="filename"):
    """400 unless the name ends with ``.pdf`` (case-sensitive)."""
    f = F.col(filename) if isinstance(filename, str) else filename
    return F.when(f.endswith(".pdf"), F.lit(200)).otherwise(F.lit(400))
