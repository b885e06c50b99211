"""Property checks: Spark operators vs independent plain-Python versions."""

from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import one_col
from kbpipe.functions import html as H
from kbpipe.operators import redaction
from kbpipe.sources.fixtures import Fixtures
from kbpipe.sources.tables import Tables

# pieces that exercise every rule and its boundaries
PIECES = ["Subject:", "Coordinator:", "Kin", "Contact:", "Dr.", "John", "Smith", "Emily", "Chen",
          "a.b@c.org", "jörg@ex.de", "07700", "900111", "+44", "0", "111", "222", "3333", "AA", "qq",
          "12", "34", "56", "B", "é", "x_y", "4737097684299439", ".", ",", ";", "-"]
SEPS = [" ", "  ", "\n", " \n ", "\t", " ", "", "\n\n"]

texts = st.lists(st.tuples(st.sampled_from(PIECES), st.sampled_from(SEPS)), min_size=0, max_size=25) \
          .map(lambda xs: "".join(p + s for p, s in xs))


@settings(max_examples=15, deadline=None)
@given(st.lists(texts, min_size=1, max_size=40))
def test_redaction_properties(spark, batch):
    """No newline, double space or known address is left, and texts without
    a trigger keep their words."""
    df = redaction.redact(one_col(spark, batch), "text", out="red")
    for r in df.collect():
        t, out = batch[r["id"]], r["red"]
        assert "\n" not in out and "  " not in out
        assert "a.b@c.org" not in out and "jörg@ex.de" not in out
        if not any(x in t for x in ("@", ":", "Dr.", "0", "1", "2", "3", "4")):
            assert out.split() == t.split()


class _MainText(HTMLParser):
    """Standard-library take on main-content text: first main, else first
    article, else body; script/style/nav/footer/header dropped; text nodes
    stripped and joined by one space."""

    SKIP = {"script", "style", "nav", "footer", "header"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("start", tag))

    def handle_endtag(self, tag):
        self.events.append(("end", tag))

    def handle_data(self, data):
        self.events.append(("data", data))

    def text(self):
        for want in ("main", "article", "body"):
            if any(e == ("start", want) for e in self.events):
                break
        else:
            return None
        out, inside, depth_skip, started = [], 0, 0, False
        for kind, val in self.events:
            if not started:
                if (kind, val) == ("start", want):
                    started, inside = True, 1
                continue
            if kind == "start":
                if val in self.SKIP:
                    depth_skip += 1
                if val == want:
                    inside += 1
            elif kind == "end":
                if val in self.SKIP and depth_skip:
                    depth_skip -= 1
                if val == want:
                    inside -= 1
                    if inside == 0:
                        break
            elif not depth_skip and val.strip():
                out.append(val.strip())
        return " ".join(" ".join(out).split())


def py_main_text(html):
    p = _MainText()
    p.feed(html)
    p.close()
    return p.text()


def test_main_text_matches_stdlib_parser_on_all_pages(spark, sf):
    pages = Tables(spark, sf).pages.select("page_id", "html", H.main_text("html").alias("t")).collect()
    bad = [r["page_id"] for r in pages if py_main_text(r["html"]) != r["t"]]
    assert not bad, bad[:5]


class _Tree(HTMLParser):
    """Every element on a stack; each text with the numbered elements around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.opened, self.stack, self.texts = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "meta", "img", "link", "hr", "input"):
            self.stack.append((len(self.opened), tag))
            self.opened.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if any(t == tag for _, t in self.stack):
            while self.stack.pop()[1] != tag:
                pass

    def handle_data(self, data):
        self.texts.append((list(self.stack), data))

    def main_text(self):
        for want in ("main", "article", "body"):
            if want in self.opened:
                top = self.opened.index(want)
                out = [d for around, d in self.texts if any(n == top for n, _ in around)
                       and not any(n > top and t in _MainText.SKIP for n, t in around)]
                return " ".join(" ".join(out).split())
        return None


def test_main_text_of_nested_pages_matches_a_tree(spark, sf):
    rows = Fixtures(spark, sf).mixed_pages().select("page_id", "html", H.main_text("html").alias("t")).collect()
    seen = set()
    for r in rows:
        tree = _Tree()
        tree.feed(r["html"])
        tree.close()
        assert tree.main_text() == r["t"], r["page_id"]
        seen.add(r["page_id"] % 8)
    assert seen == set(range(8))


HREF_PIECES = ["/", "a", "b.html", "..", ".", "?q=1", "#f", "//h.org", "http://x.org", "https://y.org:81",
               ";p", "%20", "é", "?", "#", "", "mailto:z@x.org", "../", "./", "a/../b", "HTTP:", "[", " "]
BASES = ["https://x.org/dir/page", "https://x.org/dir/", "http://u@x.org:8080/a/b?z=1#t", "https://x.org",
         "https://x.org/a/../b//c/d?q#", "http://x.org?k=v", "http://x.org/a;p/b", "ftp://x.org/a", "x"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(BASES),
                          st.lists(st.sampled_from(HREF_PIECES), max_size=5).map("".join)),
                min_size=1, max_size=60))
def test_url_join_matches_urllib(spark, pairs):
    import urllib.parse
    from kbpipe.functions.urls import join_native, join_rest
    df = spark.createDataFrame([(i, b, h) for i, (b, h) in enumerate(pairs)], "i int, b string, h string")
    got = {r["i"]: r["j"] for r in df.withColumn("n", join_native("b", "h"))
           .select("i", join_rest("n", "b", "h").alias("j")).collect()}
    for i, (b, h) in enumerate(pairs):
        try:
            want = urllib.parse.urljoin(b, h)
        except ValueError:
            want = None
        assert got[i] == want, (b, h)
