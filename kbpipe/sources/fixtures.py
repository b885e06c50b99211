"""Derived inputs built from the driver tables (FIXTURES.md part B).

Most are written once as SQL that both Spark and DuckDB accept (``||``,
``CASE``, ``lpad``, ``chr``, ``CAST(... AS STRING)``), so the Spark queries
and the independent DuckDB oracles read identical inputs. Derivations that
need dialect-specific array functions have a Spark builder here and a DuckDB
text in ``kbpipe.plans.oracle``.

Every fixture grows with the table it is derived from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbpipe.session import spread
from kbpipe.sources.tables import Tables

# The twelve names used by the case-note templates
NAMES = [("John", "Smith"), ("Emily", "Chen"), ("Amir", "Khan"), ("Sarah", "Jones"),
         ("David", "Brown"), ("Grace", "Okafor"), ("Liam", "Walsh"), ("Priya", "Patel"),
         ("Tom", "Evans"), ("Mary", "Wilson"), ("Omar", "Haddad"), ("Zoe", "Taylor")]


def _case(key: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


CASE_NOTES = f"""
WITH b AS (
  SELECT c_custkey AS note_id, c_name,
         {_case('c_custkey', [f for f, _ in NAMES])} AS first_name,
         {_case('c_custkey', [l for _, l in NAMES])} AS last_name,
         '07700 9' || lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') AS phone,
         lpad(CAST((c_custkey * 7) % 1000 AS STRING), 3, '0') || ' ' ||
           lpad(CAST((c_custkey * 13) % 1000 AS STRING), 3, '0') || ' ' ||
           lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS health_id,
         'QQ ' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || ' ' ||
           lpad(CAST((c_custkey * 3) % 100 AS STRING), 2, '0') || ' ' ||
           lpad(CAST((c_custkey * 11) % 100 AS STRING), 2, '0') || ' C' AS ref_num
  FROM {{customer}}
)
SELECT note_id, CASE note_id % 8
  WHEN 0 THEN 'Subject: ' || first_name || ' ' || last_name || '. Contact ' ||
              lower(first_name) || '.' || lower(last_name) || '@council.example.org or ' ||
              phone || '. At noon ' || first_name || ' ' || last_name ||
              ' asked for a second bin.'
  WHEN 1 THEN 'Coordinator: ' || first_name || ' ' || last_name || chr(10) || 'NHS ' ||
              health_id || chr(10) || 'Ref: ' || ref_num || chr(10) || 'Account ' || c_name
  WHEN 2 THEN 'Kin Contact: ' || first_name || ' ' || last_name || ' called on ' || phone ||
              '; ' || first_name || ' asked for a callback.'
  WHEN 3 THEN 'Seen by Dr. ' || last_name || ' today. Dr. ' || last_name || ' noted id ' ||
              health_id || ' and ' || last_name || ' will follow up.'
  WHEN 4 THEN 'Dr. ' || first_name || ' ' || last_name || ' will review the case of ' ||
              first_name || '. Email ' || lower(first_name) || '@example.com.'
  WHEN 5 THEN 'No personal details in this note about bins, number ' ||
              CAST(note_id AS STRING) || '.'
  WHEN 6 THEN 'Subject: ' || first_name || ' ' || last_name || chr(10) || chr(10) ||
              'Coordinator: Mary Wilson and Dr. ' || first_name || '; ref ' || lower(ref_num) ||
              '.' || chr(10) || chr(10) || first_name || ' ' || last_name || ' and ' ||
              first_name || ' were told.'
  ELSE 'Route' || chr(160) || 'plan' || chr(10) || 'for' || chr(10) || chr(10) || 'the  north' ||
       chr(10) || '*' || chr(10) || 'depot' || chr(10) || 'W-' ||
       CAST(note_id AS STRING) || ' ' || phone
END AS text
FROM b
"""

FETCHED_PAGES = """
SELECT page_id,
       url || CASE page_id % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.docx'
                               WHEN 3 THEN '.xlsx' WHEN 4 THEN '.doc' WHEN 5 THEN '.xls'
                               ELSE '' END AS url,
       CASE WHEN page_id % 10 = 0 THEN 404 ELSE 200 END AS status,
       CASE page_id % 8 WHEN 6 THEN 'Application/PDF; charset=binary'
                        WHEN 7 THEN 'text/html; charset=utf-8' ELSE '' END AS content_type,
       html
FROM {pages}
"""

# the body of each fetched page, as text; cast to bytes per dialect
RAW_CONTENT_TEXT = """
CASE (page_id + CAST(floor(page_id / 8) AS BIGINT)) % 4
                 WHEN 0 THEN chr(10) || html
                 WHEN 1 THEN lower(substr(html, 1, 9)) || substr(html, 10)
                 WHEN 2 THEN html
                 ELSE '%PDF-1.4 ' || substr(html, 16) END
"""

# what the byte decoders made of each fetched page; some documents are empty
DECODED_TEXT = """
SELECT page_id, CASE WHEN page_id % 11 = 0 THEN '' ELSE 'Decoded text of ' || url END AS text
FROM {fetched}
"""

UPLOAD_NAME = ("'doc_' || CAST(doc_id AS STRING) || "
               "CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.docx' ELSE '' END")
UPLOAD_NAMES = f"SELECT doc_id AS id, {UPLOAD_NAME} AS filename FROM {{documents}}"
UPLOADS = f"SELECT doc_id, {UPLOAD_NAME} AS source, text FROM {{documents}}"

# pages whose markup nests, stays open, uses other containers or none; every
# one has links that are relative, foreign, without a host or of another scheme
MIXED_PAGES = """
WITH p AS (
  SELECT page_id, url,
         replace(html, '<article>',
                 '<article><a href="../up/' || CAST(page_id AS STRING) || '?q=1&amp;r=2#t">u</a>' ||
                 '<a href="//cdn.example.net/x/../y">c</a><a href="./a/./b//c/">d</a>' ||
                 '<a href="https://other.example.org/z">o</a><a href="?page=2">n</a><a href="#top">t</a>' ||
                 '<a href="mailto:desk@example.org">m</a><a href="sub/../../../x/..">x</a>' ||
                 '<a href="/k/./l/../' || CAST(page_id % 7 AS STRING) || '">k</a>') AS html
  FROM {pages})
SELECT page_id, url, CASE page_id % 8
  WHEN 0 THEN replace(html, '<article>', '<article><nav>Menu <NAV class="n">deep</NAV> still menu</nav>after ')
  WHEN 1 THEN replace(replace(html, '<article>', '<article>Lead <article>'),
                      '</article>', '</article> tail <nav/>kept</article> outside')
  WHEN 2 THEN replace(html, '<article>', '<article><div><header>open <div>x</div> header</div></section>')
  WHEN 3 THEN replace(html, '<article>', '<article>before <header>never closed ')
  WHEN 4 THEN replace(replace(html, '<article>', '<article>no</article><nav><main id="m"><footer>f<footer>g</footer>h</footer>'),
                      '</article>', '</main></nav>')
  WHEN 5 THEN replace(replace(html, '<article>', '<section>'), '</article>', '</section>')
  WHEN 6 THEN replace(replace(replace(replace(html, '<article>', '<p>'), '</article>', ''), '<body>', ''), '</body>', '')
  ELSE replace(html, '</article>', '') END AS html
FROM p
"""

CODE_URLS = """
SELECT 'p' || CAST(page_id AS STRING) AS id, url FROM {pages}
UNION ALL
SELECT 'c' || CAST(page_id AS STRING) AS id,
       'https://github.com/u' || CAST(page_id AS STRING) || '/r/blob/main/f.md' AS url
FROM {pages}
"""

QUESTIONS = """
SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS qid, conv_id,
       CASE WHEN (conv_id + turn) % 20 = 0 THEN '   ' ELSE text END AS prompt
FROM {conversations}
WHERE role = 'user'
"""

VERDICTS = """
SELECT doc_id AS conv_id,
       CASE WHEN toxic = 1 THEN ' unsafe' || chr(10) ELSE 'SAFE' END AS verdict
FROM {labels}
"""

# verdicts of single questions: some have two that differ, a NULL one or none
QUESTION_VERDICTS = """
SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS qid, 'SAFE' AS verdict
FROM {conversations} WHERE role = 'user' AND (conv_id * 3 + turn) % 7 <> 0
UNION ALL
SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS qid,
       CASE (conv_id + turn) % 10 WHEN 0 THEN ' unsafe' || chr(10) WHEN 2 THEN NULL WHEN 4 THEN '' ELSE 'Safe.' END AS verdict
FROM {conversations} WHERE role = 'user' AND (conv_id + turn) % 2 = 0
"""

# hits of a search: up to three a question, none for some, without source or text for others
SPARSE_HITS = "\nUNION ALL\n".join(f"""
SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS qid, CAST({rank} AS BIGINT) AS rank,
       CASE WHEN (conv_id + {rank}) % 4 = 0 THEN NULL ELSE 'page ' || CAST(turn + {rank} AS STRING) END AS source,
       CASE WHEN (conv_id + turn + {rank}) % 5 = 0 THEN NULL ELSE substr(text, {rank}, 60) END AS text
FROM {{conversations}} WHERE role = 'user' AND conv_id % 4 >= {rank}""" for rank in (1, 2, 3))

# one backup file per test item: good ones, corrupt, arrays, without text, without url
BACKUP_FILES = """
SELECT CASE length(text) % 5
         WHEN 1 THEN '{{"url": "item://' || CAST(item_id AS STRING)
         WHEN 2 THEN '[{{"url": "item://' || CAST(item_id AS STRING) || '", "text": "x"}}]'
         WHEN 3 THEN '{{"url": "item://' || CAST(item_id AS STRING) || '", "title": "x"}}'
         WHEN 4 THEN '{{"text": "item ' || CAST(item_id AS STRING) || '"}}'
         ELSE '{{' || chr(10) || '  "url": "item://' || CAST(item_id AS STRING) || '",' || chr(10) ||
              '  "text": "item ' || CAST(item_id AS STRING) || ' of ' || CAST(length(text) AS STRING) || '"' || chr(10) || '}}'
       END AS value, length(text) % 2 AS slice
FROM {benchmark} WHERE text IS NOT NULL
"""

COSTS = """
SELECT event_id AS id, ts, CAST(value AS DECIMAL(18,2)) AS cost
FROM {events}
WHERE event_type = 'purchase'
"""

# rules of every crawled host; they differ by host (first match wins)
ROBOTS_RULES = """
WITH h AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host FROM {pages})
SELECT host, 0 AS rule_no, '/en' AS path, false AS allow FROM h WHERE length(host) % 3 < 2
UNION ALL SELECT host, 1 AS rule_no, '/en/6' AS path, true AS allow FROM h
UNION ALL SELECT host, 2 AS rule_no, '/fr/1' AS path, false AS allow FROM h WHERE length(host) % 2 = 0
UNION ALL SELECT host, 3 AS rule_no, '/' AS path, length(host) % 5 <> 0 AS allow FROM h WHERE length(host) % 7 <> 0
"""


def portable(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    return spark.sql(sql, **tables)


class Fixtures:
    """Derived inputs for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)

    def case_notes(self) -> DataFrame:
        return portable(self.spark, CASE_NOTES, customer=self.t.customer)

    def fetched_pages(self) -> DataFrame:
        return portable(self.spark, FETCHED_PAGES, pages=self.t.pages)

    def robots_rules(self) -> DataFrame:
        return portable(self.spark, ROBOTS_RULES, pages=self.t.pages)

    def mixed_pages(self) -> DataFrame:
        return portable(self.spark, MIXED_PAGES, pages=spread(self.t.pages))

    def raw_bytes(self, with_html: bool = False) -> DataFrame:
        html = ", html" if with_html else ""
        return portable(self.spark,
                        f"SELECT page_id, url, content_type, status{html}, "
                        f"CAST({RAW_CONTENT_TEXT} AS BINARY) AS content FROM {{fp}}",
                        fp=self.fetched_pages())

    def decoded_text(self) -> DataFrame:
        return portable(self.spark, DECODED_TEXT, fetched=self.fetched_pages())

    def upload_names(self) -> DataFrame:
        return portable(self.spark, UPLOAD_NAMES, documents=self.t.documents)

    def uploads(self) -> DataFrame:
        return portable(self.spark, UPLOADS, documents=self.t.documents)

    def code_urls(self) -> DataFrame:
        return portable(self.spark, CODE_URLS, pages=self.t.pages)

    def questions(self) -> DataFrame:
        return portable(self.spark, QUESTIONS, conversations=spread(self.t.conversations))

    def verdicts(self) -> DataFrame:
        return portable(self.spark, VERDICTS, labels=self.t.labels)

    def question_verdicts(self) -> DataFrame:
        return portable(self.spark, QUESTION_VERDICTS, conversations=self.t.conversations)

    def sparse_hits(self) -> DataFrame:
        return portable(self.spark, SPARSE_HITS, conversations=self.t.conversations)

    def backup_files(self) -> DataFrame:
        return portable(self.spark, BACKUP_FILES, benchmark=self.t.benchmark)

    def costs(self) -> DataFrame:
        return portable(self.spark, COSTS, events=self.t.events)

    # --- dialect-specific derivations (DuckDB text lives with the oracles) ---

    def doc_pages(self) -> DataFrame:
        """Lines of each document as ordered pages; empty lines kept."""
        d = self.t.documents
        return d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page_no", "text")) \
                .withColumn("page_no", F.col("page_no").cast("bigint"))

    def doc_cells(self) -> DataFrame:
        """Sheets of ten rows, one row per line, one cell per word; some
        cells and whole rows are empty (NULL)."""
        p = self.doc_pages()
        cells = p.select(
            "doc_id",
            F.floor(F.col("page_no") / 10).cast("bigint").alias("sheet_no"),
            (F.col("page_no") % 10).alias("row_no"),
            F.posexplode(F.split("text", " ", -1)).alias("col_no", "word"))
        blank = (((F.col("row_no") + F.col("col_no")) % 5) == 0) | ((F.col("row_no") % 7) == 0)
        return cells.select("doc_id", "sheet_no", "row_no",
                            F.col("col_no").cast("bigint").alias("col_no"),
                            F.when(blank, F.lit(None).cast("string")).otherwise(F.col("word")).alias("value"))

    def paragraph_docs(self) -> DataFrame:
        """Documents whose lines are regrouped into paragraphs of three lines
        separated by a blank line."""
        d = self.t.documents
        lines = F.split("text", "\n", -1)
        joined = F.array_join(
            F.transform(lines, lambda l, i: F.when((i > 0) & (i % 3 == 0), F.concat(F.lit("\n"), l)).otherwise(l)),
            "\n")
        return d.select("doc_id", "source", joined.alias("text"))

    def answer_chunks(self) -> DataFrame:
        """Assistant turns streamed as word fragments; every fourth is empty."""
        c = self.t.conversations.where(F.col("role") == "assistant")
        w = c.select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("pos", "word"))
        return w.select(
            "conv_id",
            (F.col("turn") * (1 << 31) + F.col("pos")).alias("seq"),
            F.when(F.col("pos") % 4 == 3, F.lit("")).otherwise(F.concat("word", F.lit(" "))).alias("chunk"))
