"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbpipe.llm import (chat, decontam, filter_audit, langid, license_scan, lm, neighbours, packing, pii, prefix_trie,
                        quality, simhash, urls)
from kbpipe.llm.common import table

# Tools of the messages that op1 derives from ``conversations``.
TOOLS = {
    "search": {"type": "object", "required": ["query", "top_k"], "additionalProperties": False,
               "properties": {"query": {"type": "string"}, "lang": {"type": "string"},
                              "top_k": {"type": "integer", "minimum": 1, "maximum": 10}}},
    "summarise": {"type": "object", "required": ["source"], "additionalProperties": False,
                  "properties": {"source": {"type": "string"}, "max_words": {"type": "integer", "minimum": 1}}},
}


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Chat with tools, derived from plain turns: every user turn makes the
    assistant call ``search`` with its whole text (``top_k`` from its length:
    out of range for some, a string for others) and ``summarise`` with a
    reference to that result, listed first; the assistant turn after it is the
    result of both. In some conversations the search also refers to the summary
    (a cycle), is called twice under one identifier, or a result comes for a
    call that nobody made."""
    t = F.col("turn")
    search = F.concat(F.lit("s"), t.cast("string"))
    summarise = F.concat(F.lit("m"), t.cast("string"))
    first = F.to_json(F.struct(summarise.alias("id"), F.lit("summarise").alias("name"), F.struct(
        F.struct(search.alias("$ref")).alias("source"), F.lit(50).alias("max_words")).alias("arguments")))
    size = F.coalesce(F.length("text"), F.lit(0))
    second = F.to_json(F.struct(search.alias("id"), F.lit("search").alias("name"), F.struct(
        F.coalesce("text", F.lit("")).alias("query"),
        F.when(F.col("conv_id") % 9 == 4, F.struct(summarise.alias("$ref"))).alias("lang"),
        (size % 12).alias("top_k")).alias("arguments")))

    def third(call_id, top_k):
        return F.concat(F.lit(","), F.to_json(F.struct(call_id.alias("id"), F.lit("search").alias("name"), F.struct(
            F.lit("again").alias("query"), top_k.alias("top_k")).alias("arguments"))))

    again = F.when(F.col("conv_id") % 6 == 5, third(search, F.lit(5))).when(
        size % 12 == 11, third(F.concat(F.lit("t"), t.cast("string")), F.lit("5"))).otherwise("")
    asked = conversations.where("role = 'user'").select(
        "conv_id", "turn", F.lit("assistant").alias("role"),
        F.concat(F.lit('{"tool_calls":['), first, F.lit(","), second, again, F.lit("]}")).alias("text"))

    def answer(prefix: str, which: str = "true") -> DataFrame:
        return conversations.where(f"role = 'assistant' and {which}").select(
            "conv_id", "turn", F.lit("tool").alias("role"),
            F.to_json(F.struct(F.concat(F.lit(prefix), (t - 1).cast("string")).alias("tool_call_id"),
                               F.coalesce("text", F.lit("")).alias("content"))).alias("text"))

    return asked.unionByName(answer("s")).unionByName(answer("m")).unionByName(
        answer("x", "conv_id % 8 = 7"))


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_tool_calls(tool_messages(table(spark, sf_dir, "conversations")), TOOLS)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "host_bad", "demerits")


def op5_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents", "doc_id", "text"))
    spans = F.col("pii")
    base = F.filter(spans, lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id", *[pii.count_of(spans, k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: F.round(s["score"], 2).cast("string")), ",").alias("scores"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return langid.identify(docs, langid.fit(docs))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents", "doc_id", "text"),
                                        table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated",
                        decontam.removable_words(F.col("hit_spans")).alias("n_removed"))


def op11_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return neighbours.score_quality(docs, neighbours.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents", "doc_id", "text", "source"),
                                      table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_tool_calls, op2_license_scan, op3_simhash, op4_quality_rules, op5_ctw_score, op6_pii, op7_url_filter,
    op8_language_id, op9_best_fit_packing, op10_decontamination, op11_quality_votes, op12_filter_audit,
    op13_prefix_trie, pipeline)}
