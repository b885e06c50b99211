"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads whole driver tables (or fixtures Spark derives from them).
Output columns are aliased to match the DuckDB oracles in ``oracle.py``.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbpipe.functions import redact as R
from kbpipe.functions import text as TX
from kbpipe.functions.embed import DEFAULT_DIM
from kbpipe.operators import assemble as A
from kbpipe.operators import chunk as C
from kbpipe.operators import metrics as M
from kbpipe.operators import questions as Q
from kbpipe.operators import redaction, retrieve
from kbpipe.operators import web as Wb
from kbpipe.operators.common import explode_rows
from kbpipe.plans.answer import answer_questions
from kbpipe.plans import ingest as ingest_plan
from kbpipe.plans.ingest import knowledge_points
from kbpipe.session import brief_shuffles, deal, scratch_path, spread
from kbpipe.sources import backup, events, store, visited
from kbpipe.sources.fixtures import Fixtures
from kbpipe.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# parameters of the registered queries (fixture scale is small)
ALERT_THRESHOLD = 3
RETENTION_QUERY_DAYS = 7
EMBEDDINGS_DIM = 64
RUN_ID = "run-0"
STATE_PARTITIONS = 4        # of the keyed-state streams


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _key(prefix: str, col: str):
    """Ids of two tables in one column, told apart by a prefix."""
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def _texts(spark, sf) -> DataFrame:
    """Documents plus case notes: ``(text_id, text)``."""
    f = Fixtures(spark, sf)
    d = Tables(spark, sf).documents.select(_key("d", "doc_id").alias("text_id"), "text")
    n = f.case_notes().select(_key("n", "note_id").alias("text_id"), "text")
    return spread(d.unionByName(n))


# --------------------------------------------------------------- sources, web

@query
def page_scan(spark, sf):
    return Wb.page_scan(Fixtures(spark, sf).fetched_pages()).select("page_id", "url", "content_type")


@query
def format_routing(spark, sf):
    p = Wb.page_scan(Fixtures(spark, sf).fetched_pages())
    return p.select("page_id", "url", Wb.route_format().alias("fmt"))


@query
def binary_guard(spark, sf):
    p = Wb.with_format(Wb.page_scan(Fixtures(spark, sf).raw_bytes()))
    return p.where(F.col("fmt") != "html").select("page_id", "fmt", Wb.guard_ok().alias("guard_ok"))


@query
def legacy_placeholder(spark, sf):
    p = Wb.with_format(Wb.page_scan(Fixtures(spark, sf).fetched_pages()))
    return p.where(F.col("fmt") == "legacy").select(
        "page_id", F.lit("document").alias("type"), Wb.legacy_placeholder().alias("text"))


@query
def crawl_records(spark, sf):
    f = Fixtures(spark, sf)
    return Wb.crawl_records(spread(f.raw_bytes(with_html=True)), f.decoded_text())


@query
def html_main_text(spark, sf):
    return Wb.main_text_rows(spread(Tables(spark, sf).pages), "page_id")


@query
def html_nested_text(spark, sf):
    """Main content of pages whose markup nests, stays open or has no container."""
    return Wb.main_text_rows(Fixtures(spark, sf).mixed_pages(), "page_id")


@query
def collapse_ws(spark, sf):
    d = spread(Tables(spark, sf).documents)
    return d.select("doc_id", TX.collapse_ws("text").alias("text"))


@query
def url_rewrite(spark, sf):
    u = Fixtures(spark, sf).code_urls()
    return u.select("id", "url", Wb.fetch_url("url").alias("fetch_url"))


@query
def page_links(spark, sf):
    links = Wb.page_links(spread(Tables(spark, sf).pages))
    return links.select("page_id", "link_no", "link")


@query
def same_site_links(spark, sf):
    links = Wb.same_site(Wb.page_links(spread(Tables(spark, sf).pages)))
    return links.select("page_id", "link_no", "link")


@query
def mixed_links(spark, sf):
    """Relative, scheme-relative, foreign and other-scheme links, with
    whether each stays on its page's site."""
    links = Wb.page_links(Fixtures(spark, sf).mixed_pages())
    return links.select("page_id", "link_no", "link", Wb.on_site().alias("on_site"))


@query
def same_site_mixed(spark, sf):
    links = Wb.same_site(Wb.page_links(Fixtures(spark, sf).mixed_pages()))
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"),
                                        F.countDistinct("link").alias("n_distinct"))


@query
def frontier(spark, sf):
    pages = Tables(spark, sf).pages
    links = Wb.same_site(Wb.page_links(spread(pages)))
    return Wb.frontier(links, pages.select("url"))


@query
def frontier_visited_table(spark, sf):
    """The frontier against a stored table of visited urls that two rounds
    have filled; the table's side is not shuffled."""
    pages = Tables(spark, sf).pages
    name, path = f"visited_{uuid.uuid4().hex[:12]}", scratch_path(spark, "visited")
    for i in range(2):
        visited.mark_visited(pages.where(F.col("page_id") % 2 == i), name, path)
    return visited.new_urls(Wb.same_site(Wb.page_links(spread(pages))), name)


@query
def robots_audit(spark, sf):
    return Wb.robots_audit(Tables(spark, sf).pages, Fixtures(spark, sf).robots_rules())


# ------------------------------------------------------------------ redaction

def _stage(spark, sf, n_steps):
    """Texts after the first ``n_steps`` steps of the token stages."""
    t = redaction.apply_steps(_texts(spark, sf), "text", R.TOKEN_STEPS[:n_steps])
    return t.select("text_id", "text")


_N_NORMALISE = len(R.NORMALISE_STEPS)


@query
def normalise_ws(spark, sf):
    return _stage(spark, sf, _N_NORMALISE)


@query
def redact_email(spark, sf):
    return _stage(spark, sf, _N_NORMALISE + 1)


@query
def redact_phone(spark, sf):
    return _stage(spark, sf, _N_NORMALISE + 2)


@query
def redact_health_id(spark, sf):
    return _stage(spark, sf, _N_NORMALISE + 3)


@query
def redact_ref_num(spark, sf):
    return _stage(spark, sf, _N_NORMALISE + 4)


@query
def redact_context_names(spark, sf):
    s = redaction.with_stages(_texts(spark, sf), "text", "_x_")
    return s.select("text_id", F.col("_x_s").alias("text"))


@query
def discovered_names(spark, sf):
    return redaction.discovered_names(_texts(spark, sf), "text_id", "text")


@query
def redact_name_sweep(spark, sf):
    n = Fixtures(spark, sf).case_notes()
    return redaction.redact(spread(n), "text").select("note_id", "text")


@query
def redact_documents(spark, sf):
    return redaction.redact(_texts(spark, sf), "text").select("text_id", "text")


def register_views(spark, sf) -> None:
    """SQL surface: ``redacted_documents (text_id, text)``, the column chain
    as a view of the session."""
    redaction.redact(_texts(spark, sf), "text").select("text_id", "text").createOrReplaceTempView("redacted_documents")


@query
def redacted_documents_sql(spark, sf):
    register_views(spark, sf)
    return spark.sql("SELECT text_id, text FROM redacted_documents")


@query
def redaction_metrics(spark, sf):
    t = redaction.redact(_texts(spark, sf), "text", out="redacted")
    return redaction.redaction_metrics(t, "text", "redacted")


# ------------------------------------------------------------------- assembly

@query
def assemble_pdf_pages(spark, sf):
    return A.assemble_pdf_pages(Fixtures(spark, sf).doc_pages())


@query
def assemble_pdf_upload(spark, sf):
    return A.assemble_pdf_upload(Fixtures(spark, sf).doc_pages(), Tables(spark, sf).documents)


@query
def assemble_paragraphs(spark, sf):
    paras = Fixtures(spark, sf).doc_pages().withColumnRenamed("page_no", "para_no")
    return A.assemble_paragraphs(paras)


@query
def assemble_cells(spark, sf):
    return A.assemble_cells(Fixtures(spark, sf).doc_cells())


@query
def upload_check(spark, sf):
    u = Fixtures(spark, sf).upload_names()
    return u.select("id", "filename", A.upload_status().cast("bigint").alias("status"))


# ------------------------------------------------------------------- chunking

def _chunk_input(spark, sf) -> DataFrame:
    f = Fixtures(spark, sf)
    p = f.paragraph_docs().select(_key("d", "doc_id").alias("doc_id"), "text")
    n = f.case_notes().select(_key("n", "note_id").alias("doc_id"), "text")
    return deal(p.unionByName(n))


@query
def chunk_paragraphs(spark, sf):
    return C.chunk_documents(_chunk_input(spark, sf), "text").select("doc_id", "chunk_no", "chunk")


@query
def chunk_paragraphs_parity(spark, sf):
    return C.chunk_documents(_chunk_input(spark, sf), "text", redact_first=True) \
            .select("doc_id", "chunk_no", "chunk")


@query
def chunk_min_length(spark, sf):
    return C.indexable(C.chunk_documents(_chunk_input(spark, sf), "text")) \
            .select("doc_id", "chunk_no", "chunk")


@query
def chunk_counts(spark, sf):
    return C.chunk_counts(C.chunk_documents(_chunk_input(spark, sf), "text"))


# ------------------------------------------------------- embedding, retrieval

@query
def embed_text(spark, sf):
    d = spread(Tables(spark, sf).documents)
    e = retrieve.embed(d.select("doc_id", "text"), "text", "v")
    entries = F.transform("v", lambda w, i: F.struct(i.cast("bigint").alias("bucket"), w.alias("weight")))
    x = explode_rows(e, F.filter(entries, lambda x: x["weight"] != 0), None, "e", "doc_id")
    return x.select("doc_id", F.col("e.bucket").alias("bucket"),
                    F.round(F.col("e.weight").cast("double"), 6).alias("weight"))


@query
def vector_dim_check(spark, sf):
    probes = _probe_questions(Tables(spark, sf).embeddings)
    return retrieve.vector_dim_check(probes, "qvec", EMBEDDINGS_DIM).select(
        F.col("qid").alias("vec_id"), "n_dims", "accepted")


@query
def cosine_top_k(spark, sf):
    e = Tables(spark, sf).embeddings
    return retrieve.cosine_top_k(e, e, k=3, id_col="vec_id", vec_col="embedding",
                                 qid_col="vec_id", qvec_col="embedding",
                                 dim=EMBEDDINGS_DIM, exclude_self=True)


@query
def clustered_top_k(spark, sf):
    """The same search over a table rewritten in cluster order, with blocks of
    questions that are too large to broadcast."""
    e = Tables(spark, sf).embeddings
    stored = store.compact(e, scratch_path(spark, "clustered"), "vec_id", "embedding", EMBEDDINGS_DIM)
    return retrieve.cosine_top_k(stored, e, k=3, id_col="vec_id", vec_col="embedding",
                                 qid_col="vec_id", qvec_col="embedding", dim=EMBEDDINGS_DIM, exclude_self=True,
                                 max_broadcast_bytes=0)


def _probe_questions(e: DataFrame) -> DataFrame:
    """Every vector as a question; every seventh arrives truncated, as if the
    embedding call had failed, and must come back without hits."""
    broken = F.col("vec_id") % 7 == 0
    return e.select(F.col("vec_id").alias("qid"),
                    F.when(broken, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("qvec"))


@query
def top_k_with_empty(spark, sf):
    e = Tables(spark, sf).embeddings
    q = _probe_questions(e)
    hits = retrieve.cosine_top_k(e, q, k=3, id_col="vec_id", vec_col="embedding",
                                 qid_col="qid", qvec_col="qvec", dim=EMBEDDINGS_DIM)
    per_q = retrieve.top_k_with_empty(q, hits)
    return per_q.groupBy("qid").agg(
        F.count("id").cast("bigint").alias("n_hits"),
        F.coalesce(F.expr("listagg(CAST(id AS STRING), ',') WITHIN GROUP (ORDER BY rank)"),
                   F.lit("")).alias("hit_ids"))


@query
def crawl_points(spark, sf):
    """Crawled pages as whole-page points (the crawl endpoint's indexing)."""
    recs = Wb.html_records(spread(Tables(spark, sf).pages))
    pts = ingest_plan.crawl_points(recs, RUN_ID)
    return pts.select("id", "source", "type", "text", F.size("vector").cast("bigint").alias("n_dims"))


def _knowledge_table(spark, sf) -> DataFrame:
    """``documents`` ingested into a new knowledge table, read back."""
    path = scratch_path(spark, "knowledge")
    store.ensure_table(spark, path)
    store.append_points(knowledge_points(Tables(spark, sf).documents, RUN_ID), path, run_id=RUN_ID)
    return store.read_table(spark, path)


@query
def knowledge_append(spark, sf):
    k = _knowledge_table(spark, sf)
    return k.select("id", "text", "source", "type", F.size("vector").cast("bigint").alias("n_dims"))


@query
def upload_flow(spark, sf):
    """Uploaded documents through the whole flow: the name check turns away
    what is no ``.pdf``; the accepted ones are redacted once and reach both
    sinks. Per sink its rows, and the run's counters as rows of their own."""
    docs = Fixtures(spark, sf).uploads().where(A.upload_status("source") == 200)
    table, folder = scratch_path(spark, "upload-kb"), scratch_path(spark, "upload-backup")
    m = ingest_plan.ingest_documents(docs, table, folder, RUN_ID)
    k = store.read_table(spark, table).select(
        F.lit("knowledge").alias("sink"), "source", "text", F.size("vector").cast("bigint").alias("n"))
    b = backup.restore_backup(spark, folder).select(
        F.lit("backup").alias("sink"), "source", "text", F.lit(None).cast("bigint").alias("n"))
    counters = ("documents_redacted", "chunks_processed", "chunks_indexed", "rejected_vectors")
    c = spark.createDataFrame([("counter", x, None, int(m[x])) for x in counters],
                              "sink string, source string, text string, n bigint")
    return k.unionByName(b).unionByName(c)


@query
def ensure_collection(spark, sf):
    """Create the table, write points, create it again: nothing is lost."""
    path = scratch_path(spark, "collection")
    first = store.ensure_table(spark, path), store.read_table(spark, path).count()
    store.append_points(knowledge_points(Tables(spark, sf).documents, RUN_ID, DEFAULT_DIM), path, DEFAULT_DIM, run_id=RUN_ID)
    second = store.ensure_table(spark, path), store.read_table(spark, path).count()
    return spark.createDataFrame([(1, *first), (2, *second)], "attempt bigint, created boolean, n_points bigint")


def _point_counts(points: DataFrame) -> DataFrame:
    """``(text, source, n_points, n_ids)`` of each text and source. Counted by
    the text's digest: the texts themselves would go through both shuffles of
    the distinct count, this way they go through one."""
    k = points.withColumn("key", F.coalesce(F.unhex(F.md5("text")), F.lit(b"")))
    n = k.groupBy("key", "source").agg(F.count(F.lit(1)).alias("n_points"), F.count_distinct("id").alias("n_ids"))
    return k.groupBy("key").agg(F.first("text").alias("text")).join(n, "key").select("text", "source", "n_points", "n_ids")


@query
def knowledge_mixed(spark, sf):
    """One table, four writers of the same documents: a batch run, the same
    source again, and two streams with checkpoints of their own. Every
    writer's points stay, under ids of their own."""
    from kbpipe.streaming.ingest import start_ingest
    d = Tables(spark, sf).documents
    src, path = scratch_path(spark, "docs-in"), scratch_path(spark, "kb-mixed")
    store.ensure_table(spark, path)
    for run in (RUN_ID, "run-1"):
        store.append_points(knowledge_points(d, run, DEFAULT_DIM), path, DEFAULT_DIM, run_id=run)
    with brief_shuffles(spark):
        d.repartition(4).write.option("compression", "zstd").parquet(src)
    for name in ("a", "b"):
        start_ingest(spark, src, d.schema, path, scratch_path(spark, f"backup-{name}"),
                     scratch_path(spark, f"ck-{name}"), dim=DEFAULT_DIM, max_files_per_trigger=2).awaitTermination()
    return _point_counts(store.read_table(spark, path))


# ------------------------------------------------------------------ questions

@query
def question_check(spark, sf):
    q = Q.question_check(Fixtures(spark, sf).questions())
    return q.select("qid", "clean_prompt", F.coalesce("status", F.lit(200)).cast("bigint").alias("status"))


@query
def safety_prompt(spark, sf):
    q = Q.question_check(Fixtures(spark, sf).questions()).where(F.col("status").isNull())
    return q.select("qid", Q.safety_prompt().alias("safety_prompt"))


@query
def safety_gate(spark, sf):
    f = Fixtures(spark, sf)
    g = Q.safety_gate(Q.question_check(f.questions()), f.verdicts())
    return g.select("qid", "safe", F.coalesce("status", F.lit(200)).cast("bigint").alias("status"))


def _answers(spark, sf):
    """Questions against the stored knowledge table: the corpus is written
    once, and the search reads stored ids, vectors, texts and sources."""
    f = Fixtures(spark, sf)
    return answer_questions(f.questions(), f.verdicts(), _knowledge_table(spark, sf))


@query
def context_blocks(spark, sf):
    _, hits = _answers(spark, sf)
    return Q.context_blocks(hits).select("qid", F.col("n_hits").cast("bigint").alias("n_hits"), "context")


@query
def rag_prompt(spark, sf):
    answers, _ = _answers(spark, sf)
    return answers.select("qid", F.col("status").cast("bigint").alias("status"), "prompt")


@query
def safety_gate_questions(spark, sf):
    """Verdicts per question, with doubles, NULLs and gaps."""
    f = Fixtures(spark, sf)
    g = Q.safety_gate(Q.question_check(f.questions()), f.question_verdicts(), key="qid")
    return g.select("qid", "safe", F.coalesce("status", F.lit(200)).cast("bigint").alias("status"))


@query
def rag_prompt_branches(spark, sf):
    """Prompts where hits lack a source or a text, or there are none."""
    f = Fixtures(spark, sf)
    valid = Q.question_check(f.questions()).where(F.col("status").isNull())
    ctx = Q.context_blocks(f.sparse_hits())
    return valid.join(ctx, "qid", "left").select(
        "qid", F.coalesce("n_hits", F.lit(0)).cast("bigint").alias("n_hits"), "context",
        Q.rag_prompt(F.col("clean_prompt"), F.col("n_hits"), F.col("context")).alias("prompt"))


@query
def question_outcomes(spark, sf):
    f = Fixtures(spark, sf)
    g = Q.safety_gate(Q.question_check(f.questions()), f.verdicts()) \
         .withColumn("status", F.coalesce("status", F.lit(200)))
    o = Q.question_outcomes(g)
    return o.select(F.col("status").cast("bigint").alias("status"),
                    F.col("n_questions").cast("bigint").alias("n_questions"), "message")


@query
def accumulate_chunks(spark, sf):
    return Q.accumulate_chunks(Fixtures(spark, sf).answer_chunks())


@query
def transcripts(spark, sf):
    t = Q.transcripts(Tables(spark, sf).conversations)
    return t.select("conv_id", "transcript", F.col("n_turns").cast("bigint").alias("n_turns"))


# -------------------------------------------------------------------- metrics

@query
def ingest_counts(spark, sf):
    t = Tables(spark, sf)
    pages = Wb.main_text_rows(spread(t.pages)).select(F.lit("web_scraped").alias("type"), "text")
    chunks = C.indexable(C.chunk_documents(spread(t.documents.select("doc_id", "text")), "text",
                                           redact_first=True)) \
              .select(F.lit("pdf_upload").alias("type"), F.col("chunk").alias("text"))
    return M.ingest_counts(pages.unionByName(chunks))


@query
def request_alert(spark, sf):
    return M.request_alert(Tables(spark, sf).events, threshold=ALERT_THRESHOLD)


@query
def budget_alert(spark, sf):
    return M.budget_alert(Fixtures(spark, sf).costs())


@query
def log_retention(spark, sf):
    e = M.log_retention(Tables(spark, sf).events, days=RETENTION_QUERY_DAYS)
    return e.select("event_id", "event_type", M.fmt_ts(F.col("ts")).alias("ts"))


@query
def log_retention_by_day(spark, sf):
    """Retention over events stored by day: old days expire as folders, the
    rest is a pruned scan."""
    e = Tables(spark, sf).events
    path = scratch_path(spark, "events")
    events.write_events(e, path)
    events.expire(spark, path, e.schema, days=RETENTION_QUERY_DAYS)
    kept = events.retained(spark, path, e.schema, days=RETENTION_QUERY_DAYS)
    return kept.select("event_id", "event_type", M.fmt_ts(F.col("ts")).alias("ts"))


@query
def counter_export(spark, sf):
    return M.counter_export(Tables(spark, sf).events)


# ------------------------------------------------------------ backup, restore

def _note_backup(spark, sf) -> str:
    """Redacted case notes written through the JSON sink; returns the folder."""
    n = Fixtures(spark, sf).case_notes()
    red = redaction.redact(spread(n), "text").withColumn(
        "url", F.concat(F.lit("note://"), F.col("note_id").cast("string")))
    folder = scratch_path(spark, "backup")
    backup.write_backup(red, folder, RUN_ID, url="url", text="text")
    return folder


@query
def backup_json(spark, sf):
    """Crawled pages, redacted, through the JSON sink (tagged web_scraped);
    the files read back as plain JSON Lines with a fixed schema."""
    pages = Wb.html_records(spread(Tables(spark, sf).pages))
    red = redaction.redact(pages, "text")
    folder = scratch_path(spark, "crawl-backup")
    backup.write_backup(red, folder, RUN_ID, url="url", text="text", record_type="web_scraped")
    return spark.read.schema("url string, text string, type string").json(f"{folder}/batch=*/")


@query
def restore_backup(spark, sf):
    """Redacted case notes through the JSON sink and the restore source."""
    r = backup.restore_backup(spark, _note_backup(spark, sf))
    return r.select("source", "text", "restored")


@query
def restore_index(spark, sf):
    """Both backup layouts (one object per file: the benchmark items; JSON
    Lines: the redacted case notes) restored into a knowledge table."""
    folder, path = _note_backup(spark, sf), scratch_path(spark, "restored")
    items = Tables(spark, sf).benchmark.select(
        F.concat(F.lit("item://"), F.col("item_id").cast("string")).alias("url"), "text")
    items.write.mode("append").option("maxRecordsPerFile", 1).json(folder)
    store.append_points(ingest_plan.restore_points(spark, folder, RUN_ID, DEFAULT_DIM), path, DEFAULT_DIM, run_id=RUN_ID)
    return store.read_table(spark, path).select("source", "text", "restored",
                                                F.size("vector").cast("bigint").alias("n_dims"))


# ------------------------------------------------------------------ streaming

@query
def request_alert_stream(spark, sf):
    """The sliding request alert as a Structured Streaming job over the
    events table's rows as arriving files; windows closed by the final
    watermark (end <= newest event - 5 minutes)."""
    import datetime as _dt
    from kbpipe.streaming.alerts import start_request_alert
    e = Tables(spark, sf).events
    src, out, ck = (scratch_path(spark, n) for n in ("events-in", "alerts-out", "alerts-ck"))
    e.write.parquet(src)
    start_request_alert(spark, src, e.schema, out, ck, threshold=ALERT_THRESHOLD).awaitTermination()
    horizon = e.agg(F.max("ts")).first()[0] - _dt.timedelta(minutes=5)
    res = spark.read.parquet(out)
    return res.where(F.to_timestamp("window_end") <= F.lit(horizon))


def _in_slices(spark, sf, stream, slices: int = 2) -> tuple[str, str]:
    """Runs ``stream(events)`` over the events table arriving in time order, a
    slice of the time range per run; every run restarts from the checkpoint.
    Returns the sink's folder and the checkpoint."""
    from kbpipe.streaming.counters import start_append
    e = Tables(spark, sf).events
    src, out, ck = (scratch_path(spark, n) for n in ("slices-in", "slices-out", "slices-ck"))
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    lo, hi = e.agg(F.min(at), F.max(at)).first()
    part = F.least(F.floor((at - lo) * slices / (hi - lo + 1)), F.lit(slices - 1))
    for i in range(slices):
        e.where(part == i).write.mode("append").parquet(src)
        start_append(stream(spark.readStream.schema(e.schema).parquet(src)), out, ck,
                     state_partitions=STATE_PARTITIONS).awaitTermination()
    return out, ck


@query
def request_alarm_stream(spark, sf):
    """The request alert with state: raised when the load is reached, final
    counts from closed windows and, for the last ones, from the state."""
    from kbpipe.streaming.counters import open_alarms, request_alarms
    out, ck = _in_slices(spark, sf, lambda e: request_alarms(e, threshold=ALERT_THRESHOLD))
    rows = spark.read.parquet(out)
    final = rows.where("kind = 'closed'").unionByName(open_alarms(spark, ck)).drop("kind")
    raised = rows.where("kind = 'raised'").groupBy("window_start").agg(F.count(F.lit(1)).alias("n_raised"))
    return final.join(raised, "window_start", "left").select("window_start", "window_end", "n_requests", "n_raised")


@query
def counter_export_stream(spark, sf):
    """The periodic counter export with state, over restarts; the last periods
    come from the state."""
    from kbpipe.streaming.counters import counter_exports, open_counters
    out, ck = _in_slices(spark, sf, counter_exports)
    return spark.read.parquet(out).unionByName(open_counters(spark, ck))


@query
def budget_alert_stream(spark, sf):
    """The budget alert over charges arriving in time order, a run per slice."""
    from kbpipe.streaming.budget import read_alerts, start_budget_alert
    c = Fixtures(spark, sf).costs()
    src, state, alerts, ck = (scratch_path(spark, n) for n in ("costs-in", "spent", "budget-alerts", "costs-ck"))
    for i in range(3):
        c.where(F.floor(F.dayofmonth("ts") / 11) == i).write.mode("append").parquet(src)
        start_budget_alert(spark.readStream.schema(c.schema).parquet(src), state, alerts, ck).awaitTermination()
    return read_alerts(spark, alerts)


@query
def frontier_stream(spark, sf):
    """The frontier over pages arriving in two runs."""
    from kbpipe.streaming.frontier import start_frontier
    pages = Tables(spark, sf).pages
    src, out, ck = (scratch_path(spark, n) for n in ("pages-in", "frontier", "frontier-ck"))
    for i in range(2):
        pages.where(F.col("page_id") % 2 == i).write.mode("append").parquet(src)
        start_frontier(spark.readStream.schema(pages.schema).parquet(src), pages.select("url"), out, ck,
                       state_partitions=STATE_PARTITIONS).awaitTermination()
    return spark.read.schema("url string").parquet(out)


@query
def restore_stream(spark, sf):
    """Backup files arriving in two runs: what reached the table, and the
    rejected ones by reason."""
    from kbpipe.streaming.ingest import start_restore
    files = Fixtures(spark, sf).backup_files()
    src, path, bad, ck = (scratch_path(spark, n) for n in ("backup-in", "restored", "rejects", "restore-ck"))
    for i in range(2):
        files.where(F.col("slice") == i).select("value").write.mode("append").option("maxRecordsPerFile", 1).text(src)
        start_restore(spark, src, path, bad, ck, glob="part-*").awaitTermination()
    points = store.read_table(spark, path).select("source", "text", "restored", F.size("vector").cast("bigint").alias("n_dims"))
    rejects = spark.read.schema("file string, reason string").option("recursiveFileLookup", "true").parquet(bad)
    return points.unionByName(rejects.select(F.col("reason").alias("source"), F.lit(None).cast("string").alias("text"),
                                             F.lit("false").alias("restored"), F.lit(0).cast("bigint").alias("n_dims")))


@query
def ingest_stream(spark, sf):
    """Documents as arriving files through the incremental ingest job; the
    knowledge table it leaves behind."""
    from kbpipe.streaming.ingest import start_ingest
    d = Tables(spark, sf).documents
    src, table, bk, ck = (scratch_path(spark, n) for n in ("docs-in", "kb", "kb-backup", "kb-ck"))
    d.repartition(4).write.parquet(src)
    start_ingest(spark, src, d.schema, table, bk, ck, max_files_per_trigger=2).awaitTermination()
    k = store.read_table(spark, table)
    return k.select("text", "source", "type", F.size("vector").cast("bigint").alias("n_dims"))
