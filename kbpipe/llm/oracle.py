"""DuckDB SQL of the training-data queries that SQL can express.

The others are tested against brute force (tests/llm): fuzzy matching,
XXH64 fingerprints, context trees, Luhn and mod-97 spans with lookarounds,
trained classifiers, byte-level tokens and JSON serialisation.
"""

from __future__ import annotations

from kbpipe.llm import decontam, filter_audit, prefix_trie, quality, urls

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(expr: str) -> str:
    return f"translate({expr}, '{_UPPER}', '{_LOWER}')"


_W = quality.WINDOW

OP4 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d
), win AS (
  SELECT r, i, array_to_string(list_slice(words, i + 1, i + {_W}), ' ') AS s
  FROM (SELECT r, words, unnest(range(0, len(words) - {_W - 1})) AS i FROM w WHERE len(words) >= {_W})
), dup AS (
  SELECT r, s FROM win GROUP BY r, s HAVING count(*) > 1
), hit AS (
  SELECT r, count(DISTINCT j) AS n
  FROM (SELECT win.r, unnest(range(win.i, win.i + {_W})) AS j FROM win JOIN dup USING (r, s)) GROUP BY r
), m AS (
  SELECT w.r, doc_id, source, len(words) AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
         coalesce(hit.n, 0) AS n_repeat_words
  FROM w LEFT JOIN hit ON w.r = hit.r
), f AS (
  SELECT *, n_words < {quality.MIN_WORDS} AS f1, 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words AS f2,
         100 * n_symbols > {quality.MAX_SYMBOLS_PER_100} * n_words AS f3,
         100 * n_dup_lines > {quality.MAX_DUP_LINE_PCT} * n_lines AS f4,
         word_chars < {quality.MIN_WORD_LEN} * n_words OR word_chars > {quality.MAX_WORD_LEN} * n_words AS f5
  FROM m
), h AS (
  SELECT source, count(*) AS docs, sum((f1 OR f2 OR f3 OR f4 OR f5)::INT) AS failed FROM f GROUP BY source
), s AS (
  SELECT least(greatest(avg(failed / docs), 0.5 / (sum(docs) + 1)), 1 - 0.5 / (sum(docs) + 1)) AS mean,
         var_pop(failed / docs) AS v FROM h
), p AS (
  SELECT mean, CASE WHEN v > 0 THEN least(1000, greatest(1, mean * (1 - mean) / v - 1)) ELSE 1000 END AS k FROM s
), verdict AS (
  SELECT source, (failed + mean * k) / (docs + k) > mean + {quality.BAD_HOST_Z} * sqrt(mean * (1 - mean) / (k + 1)) AS host_bad FROM h, p
), j AS (
  SELECT f.*, host_bad, f1::INT + f2::INT + f3::INT + f4::INT + f5::INT AS own
  FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
       NOT (f1 OR f2) AND own + CASE WHEN own > 0 AND host_bad THEN 1 ELSE 0 END < {quality.MAX_DEMERITS} AS kept,
       host_bad, own + CASE WHEN own > 0 AND host_bad THEN 1 ELSE 0 END AS demerits
FROM j
"""


def _op7() -> str:
    cases = {"rule": "", "verdict": ""}
    for what, host, path in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        cases["rule"] += f" WHEN {fits} THEN '{host}{path}'"
        cases["verdict"] += f" WHEN {fits} THEN '{what}'"
    words = ", ".join(f"'{w}'" for ws in urls.LISTED_LABELS.values() for w in ws)
    listed = " OR ".join([f"contains(host, '{w}')" for w in urls.LISTED_WORDS] + [
        f"list_has_any(regexp_split_to_array(regexp_replace(name, '\\.[^.]*$', ''), '[^\\p{{L}}]+'), [{words}])",
        f"regexp_extract(name, '\\.([^.]*)$', 1) IN {urls.LISTED_TLDS}"])
    host = _lower("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")
    return f"""
WITH p AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN {host} ELSE '' END AS host,
         CASE WHEN contains(url, '://')
              THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
  FROM pages
), n AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', ''), '\\.$', '') AS name
  FROM p
)
SELECT page_id, host, path, CASE{cases["rule"]} END AS rule,
       CASE{cases["verdict"]} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict
FROM n
"""


_N = decontam.WINDOW
_WORDS = "regexp_extract_all(" + _lower("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP10 = f"""
WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(words, i + 1, i + n), ' ') AS s
  FROM (SELECT item, words, least({_N}, len(words)) AS n,
               unnest(range(0, len(words) - least({_N}, len(words)) + 1)) AS i
        FROM b WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents
), dw AS (
  SELECT r, n, i, array_to_string(list_slice(words, i + 1, i + n), ' ') AS s
  FROM (SELECT r, n, words, unnest(range(0, len(words) - n + 1)) AS i FROM d, sizes WHERE len(words) >= n)
), m AS (
  SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s
), word AS (
  SELECT DISTINCT r, unnest(range(i, i + n)) AS j FROM m
), stretch AS (
  SELECT r, count(*) AS n FROM (SELECT r, j - row_number() OVER (PARTITION BY r ORDER BY j) AS g FROM word)
  GROUP BY r, g
), hit AS (
  SELECT r, sum(n) AS n_hit, sum(n) FILTER (n >= {_N}) AS n_removed FROM stretch GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item FROM m) GROUP BY r
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 100 * coalesce(n_hit, 0) >= {decontam.COVERAGE_PCT} * len(words) AS contaminated
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN items ON d.r = items.r
"""

_A = filter_audit

OP12 = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words FROM d
), marks AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(words) < {_A.MIN_WORDS})::INT AS a,
         (100 * len(list_distinct(words)) < {_A.MIN_DISTINCT_PCT} * len(words))::INT AS b,
         (100 * len(regexp_extract_all(t, '[A-Z]')) > {_A.MAX_UPPER_PCT} * length(t))::INT AS c,
         regexp_matches(t, '[#$%&*|]')::INT AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS e
  FROM w LEFT JOIN marks USING (doc_id)
), m AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM f GROUP BY ALL
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT x1.l || x2.l || x3.l || x4.l || x5.l AS o, [x1.bit, x2.bit, x3.bit, x4.bit, x5.bit] AS bits
  FROM x x1, x x2, x x3, x x4, x x5
  WHERE len(list_distinct([x1.l, x2.l, x3.l, x4.l, x5.l])) = 5
), s AS (
  SELECT o, k AS step, bits[k] AS bit, coalesce(list_sum(list_slice(bits, 1, k - 1)), 0)::INT AS earlier
  FROM orders, range(1, 6) r(k)
), r AS (
  SELECT part, o, step, bit,
         coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit > 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & earlier > 0 AND mask & bit > 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & bit > 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (mask & earlier = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM m, s GROUP BY part, o, step, bit
)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""

# crc32 bit by bit (DuckDB has no such function): the bits of the text, then
# one division step for each.
_CRC = """list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c:
           list_transform(range(0, 8), lambda b: (ascii(c)::BIGINT >> b) & 1))),
         lambda crc, bit: xor(crc >> 1, 3988292384 * xor(crc & 1, bit)))"""

OP13 = f"""
WITH t AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list({{'id': id, 'words': words}} ORDER BY turn NULLS FIRST, id) AS turns,
         xor({_CRC}, 4294967295) % {prefix_trie.HEADS} AS h
  FROM t GROUP BY conv_id
), seq AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(g.turns, 1, c.h), []), list_slice(c.turns, c.h + 1, len(c.turns)))
         AS turns
  FROM c LEFT JOIN c g ON g.conv_id = c.conv_id - c.conv_id % {prefix_trie.GROUP}
), prefix AS (
  SELECT conv_id, d AS depth, d = len(turns) AS is_end,
         CASE WHEN d = 0 THEN 0 ELSE turns[d].words END AS words,
         array_to_string(list_transform(list_slice(turns, 1, d), lambda x: x.id), '') AS key
  FROM seq, unnest(range(0, len(turns) + 1)) r(d)
), node AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM prefix GROUP BY key, depth
), kids AS (
  SELECT left(key, 64 * (depth - 1)) AS key, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1
), sub AS (
  SELECT left(node.key, 64 * d) AS key, sum((kids.n IS NULL)::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM node LEFT JOIN kids ON kids.key = node.key, unnest(range(0, depth + 1)) r(d) GROUP BY 1
)
SELECT node.conv_id, node.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n_convs,
       coalesce(kids.n, 0) AS n_children, sub.n_leaves::BIGINT AS n_leaves, sub.saved::BIGINT AS saved_tokens,
       node.ends_sha256
FROM node JOIN sub ON sub.key = node.key LEFT JOIN kids ON kids.key = node.key
LEFT JOIN node up ON node.depth > 0 AND up.key = left(node.key, 64 * (node.depth - 1))
"""

ORACLES = {"op4_quality_rules": OP4, "op7_url_filter": _op7(), "op10_decontamination": OP10, "op12_filter_audit": OP12,
           "op13_prefix_trie": OP13}
