"""Crawl-side operators: main content, routing, guard, links, robots."""

from pyspark.sql import functions as F

from kbpipe.functions import html as H
from kbpipe.operators import web as Wb


def text_of(spark, html):
    df = spark.createDataFrame([(html,)], "html string")
    return df.select(H.main_text("html").alias("t")).first()["t"]


def test_main_container_text(spark):
    html = "<html><body><main><p>Bin collection every Tuesday.</p></main></body></html>"
    assert text_of(spark, html) == "Bin collection every Tuesday."


def test_no_container_dropped(spark):
    assert text_of(spark, "<html><head><title>Empty</title></head></html>") is None


def test_main_preferred_even_empty(spark):
    html = "<body><main></main><article><p>Long article</p></article></body>"
    assert text_of(spark, html) == ""


def test_main_inside_comment_or_script_ignored(spark):
    html = ("<body><!-- <main>ad</main> --><script>var s='<main>x</main>';</script>"
            "<article>Real <b>text</b></article></body>")
    assert text_of(spark, html) == "Real text"


def test_dropped_blocks_and_entities(spark):
    html = ("<body><header>Top</header><nav>Menu</nav><p>A &amp;lt; B &copy; C&nbsp;D</p>"
            "<footer>Foot</footer></body>")
    assert text_of(spark, html) == "A &lt; B © C D"


def test_less_than_signs_and_longer_tag_names_are_no_tags(spark):
    html = "<body><main-menu>Menu</main-menu><p>5 < 6 kg and 7 > 3</p><navy>Blue</navy></body>"
    assert text_of(spark, html) == "Menu 5 < 6 kg and 7 > 3 Blue"


def test_named_and_numeric_entities(spark):
    html = ("<body>&pound;5 it&#8217;s &#x2019;&#X1F600; caf&eacute; &#233; &#0;&#xD800;&#1114112; "
            "&amp;#39; &#38;lt; &unknown; &# 5; AT&T</body>")
    assert text_of(spark, html) == "£5 it’s ’\U0001F600 café é \ufffd\ufffd\ufffd &#39; &lt; &unknown; &# 5; AT&T"


def test_unclosed_body_runs_to_end(spark):
    assert text_of(spark, "<html><body><p>cut off") == "cut off"


def test_blocks_nest_and_end_with_the_element_around_them(spark):
    cases = {
        "<body><nav>a<nav>b</nav>c</nav>d</body>e": "d",
        "<article>x<article>y</article>z</article>w": "x y z",
        "<article><div><header>H</div>t</article>": "t",
        "<article>a<header>never closed</article><p>b": "a",
        "<nav><main>kept</main></nav><article>no</article>": "kept",
        "</nav><BODY class='q'>t</header>u<nav/>v</body>": "t u v",
        "<body>a<footer>b": "a",
        "<main/><article>k": "k",
        "<div><article>a</div>b": "a",
        "": None,
    }
    df = spark.createDataFrame([(h,) for h in cases] + [(None,)], "html string")
    got = {r["html"]: r["t"] for r in df.select("html", H.main_text("html").alias("t")).collect()}
    assert got == cases | {None: None}


def test_deep_nesting_is_no_recursion(spark):
    html = "<body>" + "<div><nav>x</nav>y " * 3000 + "</div>" * 3000 + "z"
    assert text_of(spark, html) == "y " * 3000 + "z"


def test_link_that_is_no_url_is_null_and_leaves_the_site(spark):
    df = spark.createDataFrame([(1, "https://x.org/", '<a href="//[bad">1</a><a href="ok">2</a>')],
                               "page_id bigint, url string, html string")
    links = Wb.page_links(df)
    assert [r["link"] for r in links.orderBy("link_no").collect()] == [None, "https://x.org/ok"]
    assert [r["link"] for r in Wb.same_site(links).collect()] == ["https://x.org/ok"]


def pages_df(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, status int, content_type string")


def test_status_filter_and_routing(spark):
    df = pages_df(spark, [
        (1, "https://x.org/a.pdf", 200, ""), (2, "https://x.org/a.PDF", 200, ""),
        (3, "https://x.org/a.docx", 200, ""), (4, "https://x.org/a.xlsx", 200, ""),
        (5, "https://x.org/a.doc", 200, ""), (6, "https://x.org/a.xls", 200, ""),
        (7, "https://x.org/a.pdf?x=1", 200, "text/html"), (8, "https://x.org/view", 200, "Application/PDF"),
        (9, "https://x.org/gone.pdf", 404, "")])
    got = {r["page_id"]: r["fmt"] for r in Wb.with_format(Wb.page_scan(df)).collect()}
    assert got == {1: "pdf", 2: "pdf", 3: "docx", 4: "xlsx", 5: "legacy", 6: "legacy",
                   7: "html", 8: "pdf"}


def test_binary_guard(spark):
    df = spark.createDataFrame([(1, bytearray(b"\nx")), (2, bytearray(b"<!doctype html>")),
                                (3, bytearray(b"<!DOCTYPE html>")), (4, bytearray(b"%PDF-1.4"))],
                               "id int, content binary")
    got = {r["id"]: r["ok"] for r in df.select("id", Wb.guard_ok().alias("ok")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True}


def test_legacy_placeholder(spark):
    df = spark.createDataFrame([("https://x.org/old.doc",)], "url string")
    assert df.select(Wb.legacy_placeholder().alias("t")).first()["t"] == \
        "Legacy document format metadata placeholder for https://x.org/old.doc"


def test_links_same_site(spark):
    html = ('<a href="/about">A</a><a href="https://x.org/contact">B</a>'
            '<a href="https://other.org/z">C</a><a href="../up/page?q=1">D</a><a href="">E</a>')
    df = spark.createDataFrame([(1, "https://x.org/dir/page", html)], "page_id bigint, url string, html string")
    links = Wb.page_links(df)
    all_links = [r["link"] for r in links.orderBy("link_no").collect()]
    assert all_links == ["https://x.org/about", "https://x.org/contact", "https://other.org/z",
                         "https://x.org/up/page?q=1", "https://x.org/dir/page"]
    same = [r["link"] for r in Wb.same_site(links).orderBy("link_no").collect()]
    assert same == ["https://x.org/about", "https://x.org/contact", "https://x.org/up/page?q=1",
                    "https://x.org/dir/page"]


def test_authority_keeps_port_and_case(spark):
    html = '<a href="http://X.org:8080/a">1</a><a href="http://x.org:8080/b">2</a>'
    df = spark.createDataFrame([(1, "http://x.org:8080/", html)], "page_id bigint, url string, html string")
    same = [r["link"] for r in Wb.same_site(Wb.page_links(df)).collect()]
    assert same == ["http://x.org:8080/b"]


def test_code_host_rewrite(spark):
    df = spark.createDataFrame([("https://github.com/user/repo/blob/main/README.md",),
                                ("https://example.org/blob/x",)], "url string")
    got = [r["u"] for r in df.select(Wb.fetch_url().alias("u")).collect()]
    assert got == ["https://raw.githubusercontent.com/user/repo/main/README.md",
                   "https://example.org/blob/x"]


def test_frontier_dedups_and_skips_visited(spark):
    links = spark.createDataFrame([("https://x.org/a",), ("https://x.org/a",), ("https://x.org/b",)],
                                  "link string")
    visited = spark.createDataFrame([("https://x.org/b",)], "url string")
    assert [r["url"] for r in Wb.frontier(links, visited).collect()] == ["https://x.org/a"]


def robots_rules(spark, rows):
    return spark.createDataFrame(rows, "host string, rule_no int, path string, allow boolean")


def test_robots_first_match_per_host_and_override(spark):
    rules = robots_rules(spark, [("x.org", 1, "/private/ok", True), ("x.org", 0, "/private", False),
                                 ("other.org", 0, "/", False), ("free.org", 0, "", False)])
    df = spark.createDataFrame([(1, "https://x.org/private/ok"), (2, "https://x.org/public"),
                                (3, "https://x.org/private"), (4, "https://other.org/public"),
                                (5, "https://free.org/private"), (6, "https://none.org/private"), (7, None)],
                               "page_id bigint, url string")
    out = {r["page_id"]: (r["allowed_by_rules"], r["effective"])
           for r in Wb.robots_audit(df, rules).collect()}
    assert out == {1: (False, True), 2: (True, True), 3: (False, True), 4: (False, True),
                   5: (True, True), 6: (True, True), 7: (True, True)}
    strict = {r["page_id"]: r["effective"] for r in Wb.robots_audit(df, rules, override=False).collect()}
    assert strict == {1: False, 2: True, 3: False, 4: False, 5: True, 6: True, 7: True}


def test_crawl_records_end_to_end(spark):
    rows = [(1, "https://x.org/p", 200, "", bytearray(b"<!DOCTYPE html>"), "<body><p>Hi</p></body>"),
            (2, "https://x.org/old.doc", 200, "", bytearray(b"DOC"), ""),
            (3, "https://x.org/bad.doc", 200, "", bytearray(b"<!doctype html>"), ""),
            (4, "https://x.org/gone", 404, "", bytearray(b""), "<body>x</body>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, status int, content_type string, "
                                     "content binary, html string")
    got = sorted((r["page_id"], r["type"]) for r in Wb.crawl_records(df).collect())
    assert got == [(1, "html"), (2, "document")]
    assert Wb.crawl_records(df).where(F.col("page_id") == 2).first()["text"].endswith("old.doc")


def test_links_against_crawl_start_url(spark):
    html = ("<ul><li><a class=x href='/rooms?d=1'>r</a><li><A HREF=https://town.test/b/#top>b</A>"
            "<li><a href='http://other.test/'>o</a></ul>")
    df = spark.createDataFrame([(1, "https://town.test/", html)], "page_id bigint, url string, html string")
    links = [r["link"] for r in Wb.same_site(Wb.page_links(df), site="https://town.test").collect()]
    assert len(links) == 2 and all(x.startswith("https://town.test/") for x in links)


def test_pdf_record_takes_decoded_text(spark):
    rows = [(1, "https://example.gov/policy.pdf", 200, "application/pdf",
             bytearray(b"%PDF-1.4 actual content"), "")]
    fetched = spark.createDataFrame(rows, "page_id bigint, url string, status int, content_type string, "
                                          "content binary, html string")
    decoded = spark.createDataFrame([(1, "Policy document content.")], "page_id bigint, text string")
    out = Wb.crawl_records(fetched, decoded).collect()
    assert [(r["type"], r["text"]) for r in out] == [("document", "Policy document content.")]
    assert Wb.crawl_records(fetched).count() == 0      # nothing decoded -> dropped


def test_robots_star_path_and_encoding(spark):
    rules = robots_rules(spark, [("x.org", 0, "/a b", False), ("x.org", 1, "*", True)])
    df = spark.createDataFrame([(1, "https://x.org/a%20b/c"), (2, "https://x.org/z")], "page_id bigint, url string")
    out = {r["page_id"]: r["allowed_by_rules"] for r in Wb.robots_audit(df, rules).collect()}
    assert out == {1: False, 2: True}
