"""Independent DuckDB SQL for each registered query (the correctness gate).

The rules are re-stated here in RE2 syntax (DuckDB's engine): RE2 has no
look-around, so word boundaries are ``\\b`` (ASCII); the fixtures that
exercise them are ASCII, where both agree. Fixture inputs come from the same
portable SQL the Spark side runs. Strings that are fixed values (templates,
placeholders) are shared constants; everything computed is SQL.
"""

from __future__ import annotations

from kbpipe.operators import questions as Qc
from kbpipe.plans import registry as reg
from kbpipe.sources import fixtures as fx

# ------------------------------------------------------------------ helpers

S = (r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
     r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
D = r"\p{Nd}"
L_CI = r"[A-Za-z\x{130}\x{131}\x{17f}\x{212a}]"
EDGE = rf"^{S}+|{S}+$"
NAME2 = rf"([A-Z][a-z]+(?:{S}+[A-Z][a-z]+)+)"
CTX = [rf"(Subject:{S}*){NAME2}", rf"(Coordinator:{S}*){NAME2}",
       rf"(Kin Contact:{S}*){NAME2}", rf"(Dr\.{S}*)([A-Z][a-z]+)"]
EMAIL = r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"
PHONE = rf"(?:0|\+44){S}*{D}{{2,5}}{S}*{D}{{3,5}}{S}*{D}{{3,6}}"
HEALTH = rf"\b{D}{{3}}{S}*{D}{{3}}{S}*{D}{{4}}\b"
REF = rf"\b{L_CI}{{2}}{S}*{D}{{2}}{S}*{D}{{2}}{S}*{D}{{2}}{S}*{L_CI}\b"
DIM = 3072
TS = "%Y-%m-%d %H:%M:%S"


def lit(s: str) -> str:
    """SQL expression for a Python string (newlines via chr(10))."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted) if len(parts) > 1 else quoted[0]


def rr(x: str, pat: str, rep: str) -> str:
    return f"regexp_replace({x}, {lit(pat)}, {lit(rep)}, 'g')"


def strip(x: str) -> str:
    return rr(x, EDGE, "")


def r1(x): return rr(rr(f"replace({x}, chr(160), ' ')", rf"{S}*\n{S}*", " "), " +", " ")
def r2(x): return rr(r1(x), EMAIL, "[EMAIL_REDACTED]")
def r3(x): return rr(r2(x), PHONE, "[PHONE_REDACTED]")
def r4(x): return rr(r3(x), HEALTH, "[HEALTH_ID_REDACTED]")
def r5(x): return rr(r4(x), REF, "[REF_NUM_REDACTED]")


def sorted_names(x: str) -> str:
    return ("list_transform(list_sort(list_transform(list_distinct(" + x + "), "
            "lambda n: lpad(CAST(100000 - length(n) AS VARCHAR), 6, '0') || n)), "
            "lambda s: substr(s, 7))")


def staged(src: str, text: str = "text") -> str:
    """Subquery: all ``src`` columns + ``_t`` (after the context rules) and
    ``_found`` (discovered names, sweep order)."""
    q = f"(SELECT *, {r5(text)} AS _t FROM {src})"
    for i, pat in enumerate(CTX):
        q = (f"(SELECT * REPLACE ({rr('_t', pat, chr(92) + '1[NAME_REDACTED]')} AS _t), "
             f"regexp_extract_all(_t, {lit(pat)}, 2) AS _n{i} FROM {q})")
    allnames = "list_concat(_n0, _n1, _n2, _n3)"
    return f"(SELECT * EXCLUDE (_n0, _n1, _n2, _n3), {sorted_names(allnames)} AS _found FROM {q})"


def sweep(t: str, names: str) -> str:
    return (f"list_reduce({names}, lambda acc, n: regexp_replace(acc, '\\b' || n || '\\b', "
            f"'[NAME_REDACTED]', 'g'), {t})")


def redacted(src: str, text: str = "text") -> str:
    """Subquery: ``src`` columns + ``_red`` (fully redacted text)."""
    return f"(SELECT * EXCLUDE (_t, _found), {sweep('_t', '_found')} AS _red FROM {staged(src, text)})"


def sub(sql: str) -> str:
    return f"({sql})"


FP = sub(fx.FETCHED_PAGES.format(pages="pages"))
CASE_NOTES = sub(fx.CASE_NOTES.format(customer="customer"))
QUESTIONS = sub(fx.QUESTIONS.format(conversations="conversations"))
VERDICTS = sub(fx.VERDICTS.format(labels="labels"))
TEXTS = sub(f"SELECT 'd' || doc_id AS text_id, text FROM documents UNION ALL "
            f"SELECT 'n' || note_id AS text_id, text FROM {CASE_NOTES}")

FMT = ("CASE WHEN ends_with(lower(url), '.pdf') OR contains(lower(content_type), 'application/pdf') "
       "THEN 'pdf' WHEN ends_with(lower(url), '.docx') THEN 'docx' "
       "WHEN ends_with(lower(url), '.xlsx') THEN 'xlsx' "
       "WHEN ends_with(lower(url), '.doc') OR ends_with(lower(url), '.xls') THEN 'legacy' "
       "ELSE 'html' END")
GUARD = "NOT (starts_with(hex(content), '0A') OR starts_with(hex(content), hex('<!doctype')))"
RAW = sub(f"SELECT page_id, url, status, html, {FMT} AS fmt, encode({fx.RAW_CONTENT_TEXT}) AS content "
          f"FROM {FP}")
LEGACY = "'Legacy document format metadata placeholder for ' || url"


def inert(h: str) -> str:
    h = rr(h, r"(?s)<!--.*?-->", " ")
    h = rr(h, r"(?is)<script\b[^>]*>.*?</script\s*>", " ")
    return rr(h, r"(?is)<style\b[^>]*>.*?</style\s*>", " ")


ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", "chr(160)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&pound;", "'£'"), ("&euro;", "'€'"),
            ("&ndash;", "'–'"), ("&mdash;", "'—'"), ("&lsquo;", "'‘'"), ("&rsquo;", "'’'"), ("&ldquo;", "'“'"),
            ("&rdquo;", "'”'"), ("&hellip;", "'…'"), ("&bull;", "'•'"), ("&deg;", "'°'"), ("&frac12;", "'½'"),
            ("&eacute;", "'é'"), ("&reg;", "'®'"), ("&trade;", "'™'"), ("&amp;", "'&'")]


def entities(x: str) -> str:
    for e, ch in ENTITIES:
        target = ch if ch.startswith(("chr(", "'")) and len(ch) > 1 else lit(ch)
        x = f"replace({x}, '{e}', {target})"
    return x


def main_text(html: str) -> str:
    h = inert(html)
    arms = " ".join(
        f"WHEN regexp_matches({h}, '(?i)<{t}(?:[\\s/][^>]*)?>') THEN "
        f"regexp_extract({h}, '(?is)<{t}(?:[\\s/][^>]*)?>(.*?)(?:</{t}\\s*>|\\z)', 1)"
        for t in ("main", "article", "body"))
    c = f"(CASE {arms} END)"
    for t in ("nav", "footer", "header"):
        c = rr(c, rf"(?is)<{t}(?:[\s/][^>]*)?>.*?</{t}\s*>", " ")
    c = rr(c, r"<[A-Za-z/!?][^>]*>", " ")
    return f"trim({rr(entities(c), S + '+', ' ')})"


ANCHOR = r"""(?is)<a\s(?:[^>]*?[\s"'])?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
AUTH = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"

LINKS = sub(f"""
WITH h AS (SELECT page_id, url AS base, regexp_extract_all({inert('html')}, {lit(ANCHOR)}, 1) AS hs
           FROM pages),
x AS (SELECT page_id, base, unnest(range(len(hs))) AS link_no, unnest(hs) AS raw FROM h),
y AS (SELECT page_id, base, link_no,
             {entities("CASE WHEN starts_with(raw, '\"') OR starts_with(raw, '''') "
                       "THEN substr(raw, 2, length(raw) - 2) ELSE raw END")} AS href FROM x)
SELECT page_id, CAST(link_no AS BIGINT) AS link_no, base,
       CASE WHEN href = '' THEN base
            WHEN regexp_matches(href, '^/($|[^/])') THEN regexp_extract(base, {lit(ORIGIN)}, 1) || href
            WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href END AS link
FROM y""")
SAME_SITE = sub(f"SELECT * FROM {LINKS} WHERE regexp_extract(link, {lit(AUTH)}, 1) = "
                f"regexp_extract(base, {lit(AUTH)}, 1)")


# main content of the derived pages: a recursive walk over the structure tags
_TAGS = r"(?i)</?(?:main|article|body|nav|footer|header|html|div|section|aside)(?:[\s/][^>]*)?>"
NESTED_TEXT = f"""
WITH RECURSIVE p AS (SELECT page_id, {inert('html')} AS h FROM {sub(fx.MIXED_PAGES.format(pages='pages'))}),
t AS (SELECT page_id, regexp_split_to_array(h, {lit(_TAGS)}) AS pieces,
             list_transform(regexp_extract_all(h, {lit(_TAGS)}), lambda x: CASE
               WHEN ends_with(x, '/>') AND NOT starts_with(x, '</') THEN 'none'
               ELSE lower(regexp_extract(x, '^<(/?[A-Za-z]+)', 1)) END) AS tags FROM p),
c AS (SELECT page_id, pieces, tags, CASE WHEN list_contains(tags, 'main') THEN list_position(tags, 'main')
             WHEN list_contains(tags, 'article') THEN list_position(tags, 'article')
             WHEN list_contains(tags, 'body') THEN list_position(tags, 'body') END AS opened FROM t),
w AS (
  SELECT page_id, 0 AS i, CAST([] AS STRUCT(tag VARCHAR, no INT)[]) AS stack FROM c WHERE opened IS NOT NULL
  UNION ALL
  SELECT w.page_id, w.i + 1,
         CASE WHEN tag = 'none' THEN stack
              WHEN NOT starts_with(tag, '/') THEN list_append(stack, {{'tag': tag, 'no': w.i + 1}})
              WHEN NOT list_contains(list_transform(stack, lambda x: x.tag), substr(tag, 2)) THEN stack
              ELSE list_filter(stack, lambda x: x.no < list_max(list_transform(
                     list_filter(stack, lambda y: y.tag = substr(tag, 2)), lambda y: y.no))) END
  FROM (SELECT w.*, c.tags[w.i + 1] AS tag FROM w JOIN c ON c.page_id = w.page_id WHERE w.i < len(c.tags)) w),
k AS (SELECT w.page_id, w.i, CASE
        WHEN list_contains(list_transform(stack, lambda x: x.no), opened)
         AND len(list_filter(stack, lambda x: x.no > opened AND x.tag IN ('nav', 'footer', 'header'))) = 0
        THEN c.pieces[w.i + 1] ELSE '' END AS piece FROM w JOIN c ON c.page_id = w.page_id),
j AS (SELECT page_id, string_agg(piece, ' ' ORDER BY i) AS h FROM k GROUP BY page_id)
SELECT page_id, trim({rr(entities(rr('h', r"<[A-Za-z/!?][^>]*>", " ")), S + '+', ' ')}) AS text FROM j"""

# links of the derived pages, resolved segment by segment
MIXED_LINKS = sub(f"""
WITH h AS (SELECT page_id, url AS base, regexp_extract_all({inert('html')}, {lit(ANCHOR)}, 1) AS hs
           FROM {sub(fx.MIXED_PAGES.format(pages='pages'))}),
x AS (SELECT page_id, base, unnest(range(len(hs))) AS link_no, unnest(hs) AS raw FROM h),
y AS (SELECT page_id, base, link_no, {entities("substr(raw, 2, length(raw) - 2)")} AS href FROM x),
z AS (SELECT *, regexp_extract(base, {lit(ORIGIN)}, 1) AS origin, regexp_extract(href, '^([^?#]*)', 1) AS path,
             regexp_extract(href, '^[^?#]*(.*)$', 1) AS rest,
             regexp_extract(base, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS bpath FROM y),
s AS (SELECT *, CASE WHEN starts_with(path, '/') THEN string_split(path, '/')
                     ELSE list_concat([''], list_filter(string_split(regexp_replace(bpath, '[^/]*$', '') || regexp_replace(path, '/$', ''), '/'), lambda v: v <> ''),
                                      CASE WHEN ends_with(path, '/') THEN [''] ELSE [] END) END AS segs FROM z),
r AS (SELECT *, list_reduce(list_transform(segs, lambda v: [v]), lambda a, v:
               CASE v[1] WHEN '.' THEN a WHEN '..' THEN a[:-2] ELSE list_concat(a, v) END) AS kept FROM s)
SELECT page_id, CAST(link_no AS BIGINT) AS link_no, base, CASE
  WHEN href = '' THEN base
  WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
  WHEN starts_with(href, '//') THEN regexp_extract(base, '^([a-z]+:)', 1) || href
  WHEN starts_with(href, '?') THEN origin || bpath || href
  WHEN starts_with(href, '#') THEN regexp_replace(base, '#.*', '') || href
  ELSE origin || '/' || ltrim(array_to_string(kept, '/') ||
       CASE WHEN segs[-1] IN ('.', '..') THEN '/' ELSE '' END, '/') || rest END AS link
FROM r""")


def tokens_weights(src: str, key: str, text: str) -> str:
    """Sparse hashed embedding: ``(key, bucket, w)`` with float32 weights."""
    return sub(f"""
WITH tok AS (SELECT {key} AS k, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS t
             FROM {src}),
b AS (SELECT k, CAST(CAST('0x' || substr(md5(t), 1, 8) AS UBIGINT) % {DIM} AS BIGINT) AS bucket,
             count(*) AS cnt FROM tok WHERE t <> '' GROUP BY ALL)
SELECT k, bucket, CAST(CAST(cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY k)) AS FLOAT) AS DOUBLE) AS w
FROM b""")


def parity_chunks(src: str) -> str:
    """Redact whole text, split on blank lines, strip, drop empties."""
    return sub(f"""
WITH r AS (SELECT * FROM {redacted(src)}),
p AS (SELECT doc_id, source, unnest(range(len(ps))) AS chunk_no, unnest(ps) AS piece
      FROM (SELECT doc_id, source, string_split(_red, chr(10) || chr(10)) AS ps FROM r))
SELECT doc_id, source, CAST(chunk_no AS BIGINT) AS chunk_no, chunk
FROM (SELECT doc_id, source, chunk_no, {strip('piece')} AS chunk FROM p) WHERE chunk <> ''""")


POINTS = sub(f"""
SELECT sha256(concat_ws(chr(31), '{reg.RUN_ID}', CAST(doc_id AS VARCHAR), CAST(chunk_no AS VARCHAR),
                        chunk)) AS id, chunk AS text, source, 'pdf_upload' AS type
FROM {parity_chunks("(SELECT doc_id, source, text FROM documents)")}
WHERE length(chunk) > 40""")

CHECKED = sub(f"SELECT qid, conv_id, prompt, {strip('prompt')} AS clean FROM {QUESTIONS}")
SAFE = "COALESCE(NOT contains(upper(" + strip("v.verdict") + "), 'UNSAFE'), false)"
GATED = sub(f"""
SELECT q.qid, q.conv_id, q.clean, {SAFE} AS safe,
       CASE WHEN q.clean = '' THEN 400 WHEN NOT {SAFE} THEN 403 ELSE 200 END AS status
FROM {CHECKED} q LEFT JOIN {VERDICTS} v ON q.conv_id = v.conv_id""")

HITS = sub(f"""
WITH pts AS (SELECT * FROM {POINTS}),
qv AS (SELECT qid, clean FROM {GATED} WHERE status = 200),
pw AS (SELECT * FROM {tokens_weights('pts', 'id', 'text')}),
qw AS (SELECT * FROM {tokens_weights('qv', 'qid', 'clean')}),
dots AS (SELECT qw.k AS qid, pw.k AS id, sum(qw.w * pw.w) AS dot FROM qw JOIN pw USING (bucket)
         GROUP BY ALL),
qn AS (SELECT k AS qid, sqrt(sum(w * w)) AS n FROM qw GROUP BY k),
pn AS (SELECT k AS id, sqrt(sum(w * w)) AS n FROM pw GROUP BY k),
sc AS (SELECT q.qid, p.id, p.text, p.source,
              CASE WHEN coalesce(qn.n, 0) = 0 OR coalesce(pn.n, 0) = 0 THEN 0.0
                   ELSE round(coalesce(d.dot, 0) / (qn.n * pn.n), 6) END + 0.0 AS score
       FROM qv q CROSS JOIN pts p
       LEFT JOIN dots d ON d.qid = q.qid AND d.id = p.id
       LEFT JOIN qn ON qn.qid = q.qid LEFT JOIN pn ON pn.id = p.id),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc)
SELECT qid, rank, id, score, text, source FROM rk WHERE rank <= 3""")

CONTEXT = sub(f"""
SELECT qid, CAST(count(*) AS BIGINT) AS n_hits,
       coalesce(string_agg({lit(Qc.CONTEXT_PREFIX)} || coalesce(source, {lit(Qc.UNKNOWN_SOURCE)}) ||
                           {lit(Qc.CONTEXT_MIDDLE)} || text, chr(10) || chr(10) ORDER BY rank), '')
         AS context
FROM {HITS} GROUP BY qid""")

RAG_HEAD = lit(Qc.RAG_HEAD.format(org=Qc.ORG_NAME))


def cosine_sql(questions: str, exclude_self: bool) -> str:
    cond = "WHERE q.qid <> p.id" if exclude_self else ""
    return f"""
WITH q AS (SELECT * FROM {questions}),
p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.qid, p.id,
             CASE WHEN list_dot_product(q.v, q.v) = 0 OR list_dot_product(p.v, p.v) = 0 THEN 0.0
                  ELSE round(list_dot_product(q.v, p.v) /
                             (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(p.v, p.v))), 6)
             END + 0.0 AS score
      FROM q, p {cond}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
SELECT qid, rank, id, score FROM r WHERE rank <= 3"""


def _oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["page_scan"] = f"SELECT page_id, url, content_type FROM {FP} WHERE status = 200"
    o["format_routing"] = f"SELECT page_id, url, {FMT} AS fmt FROM {FP} WHERE status = 200"
    o["binary_guard"] = (f"SELECT page_id, fmt, {GUARD} AS guard_ok FROM {RAW} "
                         f"WHERE status = 200 AND fmt <> 'html'")
    o["legacy_placeholder"] = (f"SELECT page_id, 'document' AS type, {LEGACY} AS text FROM {FP} "
                               f"WHERE status = 200 AND {FMT} = 'legacy'")
    o["crawl_records"] = f"""
WITH ok AS (SELECT * FROM {RAW} WHERE status = 200 AND (fmt = 'html' OR {GUARD})),
h AS (SELECT page_id, url, {main_text('html')} AS text FROM ok WHERE fmt = 'html')
SELECT page_id, 'html' AS type, url, text FROM h WHERE text IS NOT NULL
UNION ALL
SELECT page_id, 'document' AS type, url, {LEGACY} AS text FROM ok WHERE fmt = 'legacy'
UNION ALL
SELECT ok.page_id, 'document' AS type, url, d.text
FROM ok JOIN ({fx.DECODED_TEXT.format(fetched=FP)}) d ON d.page_id = ok.page_id
WHERE fmt IN ('pdf', 'docx', 'xlsx') AND d.text <> ''"""
    o["html_main_text"] = (f"SELECT page_id, text FROM (SELECT page_id, {main_text('html')} AS text "
                           f"FROM pages) WHERE text IS NOT NULL")
    o["html_nested_text"] = NESTED_TEXT
    o["mixed_links"] = (f"SELECT page_id, link_no, link, regexp_extract(link, {lit(AUTH)}, 1) = "
                        f"regexp_extract(base, {lit(AUTH)}, 1) AS on_site FROM {MIXED_LINKS}")
    o["same_site_mixed"] = (f"SELECT page_id, count(*) AS n_links, count(DISTINCT link) AS n_distinct "
                            f"FROM {MIXED_LINKS} WHERE regexp_extract(link, {lit(AUTH)}, 1) = "
                            f"regexp_extract(base, {lit(AUTH)}, 1) GROUP BY page_id")
    o["collapse_ws"] = f"SELECT doc_id, trim({rr('text', S + '+', ' ')}) AS text FROM documents"
    o["url_rewrite"] = f"""
SELECT id, url, CASE WHEN contains(url, 'github.com') AND contains(url, '/blob/')
                     THEN replace(replace(url, 'github.com', 'raw.githubusercontent.com'), '/blob/', '/')
                     ELSE url END AS fetch_url
FROM {sub(fx.CODE_URLS.format(pages='pages'))}"""
    o["page_links"] = f"SELECT page_id, link_no, link FROM {LINKS}"
    o["same_site_links"] = f"SELECT page_id, link_no, link FROM {SAME_SITE}"
    o["frontier"] = (f"SELECT DISTINCT link AS url FROM {SAME_SITE} s "
                     f"WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = s.link)")
    target = (f"CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$', 1) = '' "
              f"THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$', 1) END")
    o["robots_audit"] = f"""
WITH r AS ({fx.ROBOTS_RULES.format(pages='pages')}),
u AS (SELECT page_id, url, {target} AS t, regexp_extract(url, {lit(AUTH)}, 1) AS host FROM pages),
d AS (SELECT u.page_id, arg_min(r.allow, r.rule_no) AS allow
      FROM u JOIN r ON r.host = u.host AND starts_with(u.t, r.path) GROUP BY u.page_id)
SELECT u.page_id, u.url, COALESCE(d.allow, true) AS allowed_by_rules, true AS effective
FROM u LEFT JOIN d ON d.page_id = u.page_id"""

    # redaction
    for name, fn in (("normalise_ws", r1), ("redact_email", r2), ("redact_phone", r3),
                     ("redact_health_id", r4), ("redact_ref_num", r5)):
        o[name] = f"SELECT text_id, {fn('text')} AS text FROM {TEXTS}"
    o["redact_context_names"] = f"SELECT text_id, _t AS text FROM {staged(TEXTS)}"
    o["discovered_names"] = f"SELECT text_id, unnest(_found) AS name FROM {staged(TEXTS)}"
    o["redact_name_sweep"] = f"SELECT note_id, _red AS text FROM {redacted(CASE_NOTES)}"
    o["redact_documents"] = f"SELECT text_id, _red AS text FROM {redacted(TEXTS)}"
    counts = ", ".join(
        f"CAST(sum(len(regexp_extract_all(_red, '\\[{tok}\\]'))) AS BIGINT) AS {col}"
        for col, tok in (("email_hits", "EMAIL_REDACTED"), ("phone_hits", "PHONE_REDACTED"),
                         ("health_id_hits", "HEALTH_ID_REDACTED"), ("ref_num_hits", "REF_NUM_REDACTED"),
                         ("name_hits", "NAME_REDACTED")))
    o["redaction_metrics"] = (f"SELECT CAST(count(*) FILTER (WHERE text IS NOT NULL AND text <> '') "
                              f"AS BIGINT) AS documents_redacted, {counts} FROM {redacted(TEXTS)}")

    # assembly
    doc_pages = sub("SELECT doc_id, CAST(unnest(range(len(parts))) AS BIGINT) AS page_no, "
                    "unnest(parts) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts "
                    "FROM documents)")
    o["assemble_pdf_pages"] = f"""
SELECT doc_id, text FROM (
  SELECT doc_id, {strip("coalesce(string_agg(text, ' ' ORDER BY page_no) FILTER (WHERE text <> ''), '')")}
         AS text FROM {doc_pages} GROUP BY doc_id) WHERE text <> ''"""
    o["assemble_paragraphs"] = o["assemble_pdf_pages"]
    o["assemble_pdf_upload"] = f"""
SELECT doc_id, coalesce(string_agg(text, chr(10) ORDER BY page_no) FILTER (WHERE text <> ''), '') AS text
FROM {doc_pages} GROUP BY doc_id"""
    o["assemble_cells"] = f"""
WITH w AS (SELECT doc_id, CAST(floor(page_no / 10) AS BIGINT) AS sheet_no, page_no % 10 AS row_no,
                  unnest(range(len(ws))) AS col_no, unnest(ws) AS word
           FROM (SELECT doc_id, page_no, string_split(text, ' ') AS ws FROM {doc_pages})),
cells AS (SELECT doc_id, sheet_no, row_no, col_no,
                 CASE WHEN (row_no + col_no) % 5 = 0 OR row_no % 7 = 0 THEN NULL ELSE word END AS value
          FROM w),
rows AS (SELECT doc_id, sheet_no, row_no, string_agg(value, ' ' ORDER BY col_no) AS row_text
         FROM cells WHERE value IS NOT NULL GROUP BY ALL),
docs AS (SELECT doc_id, {strip("string_agg(row_text, ' ' ORDER BY sheet_no, row_no)")} AS text
         FROM rows GROUP BY doc_id)
SELECT doc_id, text FROM docs WHERE text <> ''"""
    o["upload_check"] = (f"SELECT id, filename, CAST(CASE WHEN ends_with(filename, '.pdf') THEN 200 "
                         f"ELSE 400 END AS BIGINT) AS status FROM "
                         f"{sub(fx.UPLOAD_NAMES.format(documents='documents'))}")

    # chunking
    para = ("array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: "
            "CASE WHEN i > 1 AND (i - 1) % 3 = 0 THEN chr(10) || l ELSE l END), chr(10))")
    chunk_in = sub(f"SELECT 'd' || doc_id AS doc_id, {para} AS text FROM documents UNION ALL "
                   f"SELECT 'n' || note_id AS doc_id, text FROM {CASE_NOTES}")
    pieces = sub(f"""
WITH d AS (SELECT doc_id, text, _found AS names FROM {staged(chunk_in)}),
p AS (SELECT doc_id, names, unnest(range(len(ps))) AS chunk_no, unnest(ps) AS piece
      FROM (SELECT doc_id, names, string_split(text, chr(10) || chr(10)) AS ps FROM d))
SELECT doc_id, names, CAST(chunk_no AS BIGINT) AS chunk_no, chunk
FROM (SELECT doc_id, names, chunk_no, {strip('piece')} AS chunk FROM p) WHERE chunk <> ''""")
    chunks = sub(f"SELECT doc_id, chunk_no, "
                 f"{sweep('_t', sorted_names('list_concat(names, _found)'))} AS chunk "
                 f"FROM {staged(pieces, 'chunk')}")
    o["chunk_paragraphs"] = f"SELECT doc_id, chunk_no, chunk FROM {chunks}"
    o["chunk_min_length"] = f"SELECT doc_id, chunk_no, chunk FROM {chunks} WHERE length(chunk) > 40"
    o["chunk_counts"] = (f"SELECT doc_id, CAST(count(*) AS BIGINT) AS chunks_processed, "
                         f"CAST(count(*) FILTER (WHERE length(chunk) > 40) AS BIGINT) AS chunks_indexed "
                         f"FROM {chunks} GROUP BY doc_id")
    chunk_in_src = sub(f"SELECT doc_id, NULL AS source, text FROM {chunk_in}")
    o["chunk_paragraphs_parity"] = f"SELECT doc_id, chunk_no, chunk FROM {parity_chunks(chunk_in_src)}"

    # embedding and retrieval
    o["embed_text"] = (f"SELECT k AS doc_id, bucket, round(w, 6) AS weight "
                       f"FROM {tokens_weights('documents', 'doc_id', 'text')}")
    o["vector_dim_check"] = (f"SELECT vec_id, n_dims, coalesce(n_dims = {reg.EMBEDDINGS_DIM}, false) AS accepted "
                             f"FROM (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN least(32, len(embedding)) "
                             f"ELSE len(embedding) END AS BIGINT) AS n_dims FROM embeddings)")
    all_q = sub("SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings")
    o["cosine_top_k"] = cosine_sql(all_q, exclude_self=True)
    o["clustered_top_k"] = o["cosine_top_k"]
    ok_q = sub("SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings "
               "WHERE vec_id % 7 <> 0")
    o["top_k_with_empty"] = (f"SELECT e.vec_id AS qid, CAST(count(h.id) AS BIGINT) AS n_hits, "
                             f"coalesce(string_agg(CAST(h.id AS VARCHAR), ',' ORDER BY h.rank), '') AS hit_ids "
                             f"FROM embeddings e "
                             f"LEFT JOIN ({cosine_sql(ok_q, exclude_self=False)}) h ON h.qid = e.vec_id "
                             f"GROUP BY e.vec_id")
    crawled_pages = sub(f"SELECT url, text FROM (SELECT url, {main_text('html')} AS text FROM pages) "
                        f"WHERE text IS NOT NULL")
    o["crawl_points"] = (f"SELECT sha256(concat_ws(chr(31), '{reg.RUN_ID}', url, _red)) AS id, url AS source, "
                         f"'web_scraped' AS type, _red AS text, CAST({DIM} AS BIGINT) AS n_dims "
                         f"FROM {redacted(crawled_pages)}")
    o["knowledge_append"] = f"SELECT id, text, source, type, CAST({DIM} AS BIGINT) AS n_dims FROM {POINTS}"

    uploads = sub(f"SELECT * FROM ({fx.UPLOADS.format(documents='documents')}) WHERE ends_with(source, '.pdf')")
    o["upload_flow"] = f"""
WITH u AS MATERIALIZED (SELECT doc_id, source, text, _red FROM {redacted(uploads)}),
c AS MATERIALIZED (SELECT * FROM {parity_chunks(uploads)})
SELECT 'knowledge' AS sink, source, chunk AS text, CAST({DIM} AS BIGINT) AS n FROM c WHERE length(chunk) > 40
UNION ALL SELECT 'backup', source, _red, NULL FROM u WHERE text IS NOT NULL
UNION ALL SELECT 'counter', 'documents_redacted', NULL, CAST(count(*) AS BIGINT) FROM u WHERE text <> ''
UNION ALL SELECT 'counter', 'chunks_processed', NULL, CAST(count(*) AS BIGINT) FROM c
UNION ALL SELECT 'counter', 'chunks_indexed', NULL, CAST(count(*) AS BIGINT) FROM c WHERE length(chunk) > 40
UNION ALL SELECT 'counter', 'rejected_vectors', NULL, CAST(0 AS BIGINT)"""
    o["ensure_collection"] = (f"SELECT CAST(1 AS BIGINT) AS attempt, true AS created, CAST(0 AS BIGINT) AS n_points "
                              f"UNION ALL SELECT CAST(2 AS BIGINT), false, CAST(count(*) AS BIGINT) FROM {POINTS}")
    o["knowledge_mixed"] = (f"SELECT text, source, CAST(4 * count(*) AS BIGINT) AS n_points, "
                            f"CAST(4 * count(DISTINCT id) AS BIGINT) AS n_ids FROM {POINTS} GROUP BY text, source")

    # questions
    o["question_check"] = (f"SELECT qid, clean AS clean_prompt, CAST(CASE WHEN clean = '' THEN 400 "
                           f"ELSE 200 END AS BIGINT) AS status FROM {CHECKED}")
    o["safety_prompt"] = (f"SELECT qid, {lit(Qc.SAFETY_TEMPLATE)} || clean AS safety_prompt "
                          f"FROM {CHECKED} WHERE clean <> ''")
    o["safety_gate"] = f"SELECT qid, safe, CAST(status AS BIGINT) AS status FROM {GATED}"
    o["context_blocks"] = f"SELECT qid, n_hits, context FROM {CONTEXT}"
    o["rag_prompt"] = f"""
SELECT g.qid, CAST(g.status AS BIGINT) AS status,
       CASE WHEN g.status = 200 THEN
         CASE WHEN coalesce(c.n_hits, 0) > 0
              THEN {RAG_HEAD} || c.context || {lit(Qc.RAG_MIDDLE)} || g.clean || {lit(Qc.RAG_TAIL)}
              ELSE g.clean END END AS prompt
FROM {GATED} g LEFT JOIN {CONTEXT} c ON c.qid = g.qid"""
    unsafe = f"bool_or(coalesce(contains(upper({strip('verdict')}), 'UNSAFE'), true))"
    o["safety_gate_questions"] = f"""
WITH v AS (SELECT qid, {unsafe} AS unsafe FROM ({fx.QUESTION_VERDICTS.format(conversations='conversations')}) GROUP BY qid)
SELECT q.qid, coalesce(NOT v.unsafe, false) AS safe,
       CAST(CASE WHEN q.clean = '' THEN 400 WHEN coalesce(v.unsafe, true) THEN 403 ELSE 200 END AS BIGINT) AS status
FROM {CHECKED} q LEFT JOIN v ON q.qid = v.qid"""
    o["rag_prompt_branches"] = f"""
WITH c AS (SELECT qid, count(*) AS n_hits, coalesce(string_agg({lit(Qc.CONTEXT_PREFIX)} ||
             coalesce(source, {lit(Qc.UNKNOWN_SOURCE)}) || {lit(Qc.CONTEXT_MIDDLE)} || text, chr(10) || chr(10) ORDER BY rank)
             FILTER (text IS NOT NULL), '') AS context
           FROM ({fx.SPARSE_HITS.format(conversations='conversations')}) GROUP BY qid)
SELECT q.qid, CAST(coalesce(n_hits, 0) AS BIGINT) AS n_hits, context,
       CASE WHEN n_hits > 0 THEN {RAG_HEAD} || context || {lit(Qc.RAG_MIDDLE)} || q.clean || {lit(Qc.RAG_TAIL)}
            ELSE q.clean END AS prompt
FROM {CHECKED} q LEFT JOIN c ON q.qid = c.qid WHERE q.clean <> ''"""
    msg = " ".join(f"WHEN {code} THEN {lit(m)}" for code, m in Qc.MESSAGES.items())
    o["question_outcomes"] = f"""
SELECT CAST(status AS BIGINT) AS status, CAST(count(*) AS BIGINT) AS n_questions,
       CASE status {msg} ELSE {lit(Qc.OTHER_MESSAGE)} || CAST(status AS VARCHAR) END AS message
FROM {GATED} GROUP BY status"""
    o["accumulate_chunks"] = """
WITH w AS (SELECT conv_id, turn, unnest(range(len(ws))) AS pos, unnest(ws) AS word
           FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations
                 WHERE role = 'assistant')),
c AS (SELECT conv_id, turn * 2147483648 + pos AS seq,
             CASE WHEN pos % 4 = 3 THEN '' ELSE word || ' ' END AS chunk FROM w)
SELECT conv_id, string_agg(chunk, '' ORDER BY seq) AS answer FROM c WHERE chunk <> '' GROUP BY conv_id"""
    o["transcripts"] = ("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript, "
                        "CAST(count(*) AS BIGINT) AS n_turns FROM conversations GROUP BY conv_id")

    # metrics
    o["ingest_counts"] = f"""
SELECT 'web_scraped' AS type, CAST(count(*) AS BIGINT) AS n_indexed
FROM (SELECT {main_text('html')} AS text FROM pages) WHERE text IS NOT NULL
UNION ALL
SELECT 'pdf_upload' AS type, CAST(count(*) AS BIGINT) AS n_indexed
FROM {parity_chunks("(SELECT doc_id, source, text FROM documents)")} WHERE length(chunk) > 40"""
    o["request_alert"] = f"""
WITH w AS (SELECT date_trunc('minute', ts) - to_minutes(CAST(k AS BIGINT)) AS ws
           FROM events, range(5) t(k))
SELECT strftime(ws, '{TS}') AS window_start, strftime(ws + INTERVAL 5 MINUTE, '{TS}') AS window_end,
       CAST(count(*) AS BIGINT) AS n_requests
FROM w GROUP BY ws HAVING count(*) >= {reg.ALERT_THRESHOLD}"""
    o["budget_alert"] = f"""
WITH c AS ({fx.COSTS.format(events='events')}),
r AS (SELECT *, strftime(ts, '%Y-%m') AS month,
             sum(cost) OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY ts, id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mtd FROM c),
x AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY ts, id) AS rn FROM r WHERE mtd >= 9.00)
SELECT month, strftime(ts, '{TS}') AS alert_ts, id AS charge_id, CAST(mtd AS DOUBLE) AS month_to_date
FROM x WHERE rn = 1"""
    o["log_retention"] = (f"SELECT event_id, event_type, strftime(ts, '{TS}') AS ts FROM events "
                          f"WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {reg.RETENTION_QUERY_DAYS} DAY")
    o["counter_export"] = f"""
WITH p AS (SELECT event_type, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS we, count(*) AS n
           FROM events GROUP BY ALL)
SELECT event_type, strftime(we, '{TS}') AS exported_at, CAST(n AS BIGINT) AS n_events,
       CAST(sum(n) OVER (PARTITION BY event_type ORDER BY we ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            AS BIGINT) AS cumulative
FROM p"""
    o["restore_backup"] = (f"SELECT 'note://' || CAST(note_id AS VARCHAR) AS source, _red AS text, "
                           f"'true' AS restored FROM {redacted(CASE_NOTES)}")
    o["restore_index"] = (f"SELECT source, text, restored, CAST({reg.DEFAULT_DIM} AS BIGINT) AS n_dims FROM ("
                          f"{o['restore_backup']} UNION ALL SELECT 'item://' || CAST(item_id AS VARCHAR), text, 'true' "
                          f"FROM benchmark WHERE text IS NOT NULL)")
    crawled = sub(f"SELECT url, text FROM (SELECT url, {main_text('html')} AS text FROM pages) "
                  f"WHERE text IS NOT NULL")
    o["backup_json"] = f"SELECT url, _red AS text, 'web_scraped' AS type FROM {redacted(crawled)}"
    o["request_alarm_stream"] = f"SELECT *, CAST(1 AS BIGINT) AS n_raised FROM ({o['request_alert']})"
    o["counter_export_stream"] = o["counter_export"]
    o["budget_alert_stream"] = o["budget_alert"]
    o["frontier_stream"] = o["frontier_visited_table"] = o["frontier"]
    o["log_retention_by_day"] = o["log_retention"]
    o["redacted_documents_sql"] = o["redact_documents"]
    good = "length(text) % 5"
    o["restore_stream"] = f"""
SELECT CASE WHEN {good} = 0 THEN 'item://' || CAST(item_id AS VARCHAR) WHEN {good} = 1 THEN 'not JSON'
            WHEN {good} = 2 THEN 'not an object' WHEN {good} = 3 THEN 'no text' ELSE 'unknown' END AS source,
       CASE WHEN {good} = 0 THEN 'item ' || CAST(item_id AS VARCHAR) || ' of ' || CAST(length(text) AS VARCHAR)
            WHEN {good} = 4 THEN 'item ' || CAST(item_id AS VARCHAR) END AS text,
       CASE WHEN {good} IN (0, 4) THEN 'true' ELSE 'false' END AS restored,
       CAST(CASE WHEN {good} IN (0, 4) THEN {DIM} ELSE 0 END AS BIGINT) AS n_dims
FROM benchmark WHERE text IS NOT NULL"""
    o["request_alert_stream"] = (f"SELECT * FROM ({o['request_alert']}) WHERE window_end <= "
                                 f"strftime((SELECT max(ts) FROM events) - INTERVAL 5 MINUTE, '{TS}')")
    o["ingest_stream"] = f"SELECT text, source, type, CAST({DIM} AS BIGINT) AS n_dims FROM {POINTS}"
    return o


ORACLES = _oracles()
