"""Crawl-side operators over a table of fetched pages.

The network fetch itself is out of scope: pages arrive as rows
``(page_id, url, status, content_type, html | content)``. All operators are
row-local except the frontier (one dedup + one anti join on ``url``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbpipe.functions import html as H
from kbpipe.functions import urls as U
from kbpipe.functions.text import col_of
from kbpipe.operators.common import computed, explode_rows, settled

# Document suffixes and the legacy placeholder text
LEGACY_SUFFIXES = (".doc", ".xls")
PDF_CONTENT_TYPE = "application/pdf"
LEGACY_TEXT = "Legacy document format metadata placeholder for "
# the crawler's user-agent token is a deployment parameter


def page_scan(pages: DataFrame) -> DataFrame:
    """Only pages answered with status 200 go on."""
    return pages.where(F.col("status") == 200)


def _ends(u, suffixes):
    cond = None
    for s in suffixes:
        c = u.endswith(s)
        cond = c if cond is None else cond | c
    return cond


def route_format(url="url", content_type="content_type"):
    """``pdf | docx | xlsx | legacy | html``.

    Document iff the lower-cased URL ends with a document suffix or the
    content type names PDF; PDF (suffix or type) first, then .docx, .xlsx,
    then .doc/.xls. A ``.pdf?x=1`` URL is html unless the type says PDF.
    """
    u = F.lower(col_of(url))
    pdf_type = F.lower(F.coalesce(col_of(content_type), F.lit(""))).contains(PDF_CONTENT_TYPE)
    return (F.when(u.endswith(".pdf") | pdf_type, "pdf")
             .when(u.endswith(".docx"), "docx")
             .when(u.endswith(".xlsx"), "xlsx")
             .when(_ends(u, LEGACY_SUFFIXES), "legacy")
             .otherwise("html"))


def with_format(pages: DataFrame) -> DataFrame:
    return pages.withColumn("fmt", route_format())


def guard_ok(content="content"):
    """False when document bytes look like an HTML error page: they start
    with a newline or with lower-case ``<!doctype`` (case-sensitive)."""
    c = col_of(content)
    return ~(c.startswith(F.lit(b"\n")) | c.startswith(F.lit(b"<!doctype")))


def legacy_placeholder(url="url"):
    return F.concat(F.lit(LEGACY_TEXT), col_of(url))


def main_text_rows(pages: DataFrame, *keep: str, html: str = "html") -> DataFrame:
    """``(*keep, text)`` for pages with a content container (others dropped)."""
    x = computed(pages.select(*keep, html), _inert=H.strip_inert(html))
    x = computed(x.drop(html), text=H.main_text_of_inert("_inert")).drop("_inert")
    return x.where(F.col("text").isNotNull())


def html_records(pages: DataFrame) -> DataFrame:
    """``(type='html', url, text)`` for html pages with a container."""
    return main_text_rows(pages, "url").select(F.lit("html").alias("type"), "url", "text")


def crawl_records(fetched: DataFrame, decoded_text: DataFrame | None = None) -> DataFrame:
    """One crawl record per page: status filter, routing, byte guard, legacy
    placeholder, main-content text. ``fetched`` holds ``html`` (text) and
    ``content`` (bytes). Decoded text of pdf/docx/xlsx documents comes from
    ``decoded_text(page_id, text)`` when given (decoders are out of scope);
    without it those rows are dropped, as an unreadable document would be.
    """
    p = with_format(page_scan(fetched))
    doc = F.col("fmt") != "html"
    p = p.where(~doc | guard_ok("content"))
    html = main_text_rows(p.where(~doc), "page_id", "url").select(
        "page_id", F.lit("html").alias("type"), "url", "text")
    legacy = p.where(F.col("fmt") == "legacy").select(
        "page_id", F.lit("document").alias("type"), "url", legacy_placeholder().alias("text"))
    out = html.unionByName(legacy)
    if decoded_text is not None:
        docs = (p.where(F.col("fmt").isin("pdf", "docx", "xlsx")).select("page_id", "url")
                 .join(decoded_text.where(F.col("text") != ""), "page_id")
                 .select("page_id", F.lit("document").alias("type"), "url", "text"))
        out = out.unionByName(docs)
    return out


def page_links(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple = ()) -> DataFrame:
    """``(page_id, link_no, link)``: every anchor href resolved against the
    page URL, in document order, duplicates kept (NULL where the href is no
    URL); ``keep`` names columns of the pages to carry along."""
    x = explode_rows(pages.withColumn("base", F.col(url)), H.hrefs(html), "link_no", "href",
                     "page_id", "base", *keep)
    x = computed(x, _native=U.join_native("base", "href"))
    return computed(x, link=U.join_rest("_native", "base", "href")).select("page_id", "link_no", "link", "base", *keep)


def on_site(link: str = "link", base: str = "base", site: str | None = None):
    """Whether the link's authority (userinfo, host, port; case-sensitive)
    equals that of the crawl's start URL ``site`` or, without one, of the
    page's own URL (``base``)."""
    return U.authority(link) == (U.authority(F.lit(site)) if site is not None else U.authority(base))


def same_site(links: DataFrame, base: str = "base", site: str | None = None) -> DataFrame:
    """Links that are ``on_site``."""
    return links.where(on_site(base=base, site=site))


def frontier(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Distinct links not fetched yet. Dedup and the anti join both hash on
    ``url``, so the anti join reuses the dedup's partitioning; a link on every
    page is one row a task before anything moves. For a visited side that
    grows round by round see ``sources.visited``."""
    cand = settled(links.select(F.col("link").alias("url")).distinct())
    return cand.join(visited.select("url").distinct(), "url", "left_anti")


def robots_audit(pages: DataFrame, rules: DataFrame, override: bool = True) -> DataFrame:
    """``allowed_by_rules`` per URL and the crawler's ``effective`` decision
    (a disallow is logged and overridden in the crawler's policy).

    ``rules`` are ``(host, rule_no, path, allow)`` rows of the group that
    applies to the crawler; they hold for URLs of that host (authority as
    written) only. A host's rules become one row (robots files are bounded in
    size), so a page meets its host's rules in one equi-join, never in pairs.
    An empty path with ``allow`` false allows everything; a host without
    rules, like a URL without one, is allowed."""
    path = F.when(F.col("path") == "*", F.col("path")).otherwise(U.requoted("path"))
    hosts = rules.groupBy("host").agg(F.array_sort(F.collect_list(F.struct(
        "rule_no", path.alias("path"), (F.col("allow") | (F.col("path") == "")).alias("allow")))).alias("_rules"))
    j = pages.select("page_id", "url", U.authority("url").alias("_host")).join(
        hosts.withColumnRenamed("host", "_host"), "_host", "left")
    out = j.select("page_id", "url", F.when(F.col("_rules").isNull(), True).otherwise(
        U.first_rule_allows(U.robots_target("url"), F.col("_rules"))).alias("allowed_by_rules"))
    eff = F.lit(True) if override else F.col("allowed_by_rules")
    return out.withColumn("effective", eff)


def fetch_url(url="url"):
    return U.rewrite_code_host(url)
