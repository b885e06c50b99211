"""License scans, quality rules, personal data, URL filters, decontamination."""

import time

import pytest
from pyspark.sql import functions as F

from kbpipe.llm import decontam, license_scan, pii, quality, queries, urls
from kbpipe.llm.common import Scratch

from . import brute


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def key(t):
    return [(x is not None, x) for x in t]


# --- license scans ---------------------------------------------------------

BASE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def test_license_base_columns(spark, sf):
    got = sorted((tuple(r) for r in queries.op2_license_scan(spark, sf).select(*BASE).collect()), key=key)
    want = sorted(((r.doc_id, *brute.license_base(r.text)) for r in docs(spark, sf).collect()), key=key)
    assert got == want and any(w[2] for w in want)


def test_license_edge(spark, edge, edge_rows):
    got = sorted((tuple(r) for r in license_scan.scan_licenses(edge).select(*BASE).collect()), key=key)
    assert got == sorted(((r[0], *brute.license_base(r[1])) for r in edge_rows), key=key)
    assert license_scan.scan_licenses(edge.limit(0)).count() == 0


@pytest.mark.parametrize("text,labels,score", [
    ("Released under the MIT license.", "mit", 1.0),
    ("foo Released undr the M1T license bar", "mit", 1 - 2 / 30),
    ("All rights reserved", "reserved", 1.0),
    ("(C) all rihgts reserved!", "reserved", 1 - 2 / 19),
    ("we all like rights", "", 0.0),
    ("Licensed under the Apache-License, Version 2.0", "apache", 1.0),
    ("licensed under cc by nc 4.0", "cc-by,cc-by-nc", 1.0),
])
def test_license_notices(text, labels, score):
    got = license_scan.scan_text(text.encode())
    assert got["labels"] == labels and got["score"] == pytest.approx(score)


def test_license_weaker_match_before_a_better_one():
    text = b"released under teh mit license and released under the mit license"
    assert license_scan.scan_text(text)["spans"] == ["mit:0:4:2", "mit:6:10:0"]


def test_license_places_of_a_long_text_take_linear_time():
    got = license_scan.scan_text(b"cc by " * 300_000)
    assert (got["n_base"], got["first_word"], got["last_word"]) == (300_000, 0, 599_998)


def test_license_search_agrees_with_full_dynamic_programming():
    """Every notice within its edits is found, by seeds, as a scan of all places would."""
    import random
    rnd = random.Random(5)
    for label, phrase, errors in license_scan.NOTICES:
        for _ in range(12):
            s = list(phrase)
            for _ in range(rnd.randint(0, errors + 2)):
                at, c = rnd.randrange(len(s)), rnd.choice("abcxyz ")
                kind = rnd.random()
                if kind < 0.34:
                    s[at] = c
                elif kind < 0.67:
                    s.insert(at, c)
                else:
                    del s[at]
            norm = " ".join("lorem ipsum " .split() + "".join(s).split() + ["dolor"])
            near = brute.edit_distance_inside(phrase, norm) <= errors
            found = any(x[4] == len(phrase) and x[0] == label for x in license_scan.find_notices(
                norm.encode(), ((label, phrase, errors),)))
            assert found == near, (norm, phrase)


# --- quality rules ---------------------------------------------------------

def test_quality_measures(spark, sf):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted((tuple(r) for r in queries.op4_quality_rules(spark, sf).select("doc_id", *cols).collect()), key=key)
    want = sorted(((r.doc_id, *brute.quality(r.text)) for r in docs(spark, sf).collect()), key=key)
    assert got == want and any(w[5] for w in want)


def test_quality_edge(spark, edge, edge_rows):
    out = quality.judge(edge)
    assert out.columns[:len(edge.columns)] == edge.columns
    got = sorted((tuple(r) for r in out.select("doc_id", "n_words_", "word_chars", "n_symbols", "n_dup_lines",
                                               "n_repeat_words", "base_failed").collect()), key=key)
    assert got == sorted(((r[0], *brute.quality(r[1])) for r in edge_rows), key=key)
    assert quality.judge(edge.limit(0)).count() == 0


def test_quality_boundaries(spark):
    w8 = " ".join("abcdefgh")
    texts = [w8, f"{w8} {w8}", "a b c d e f g a b c d e f g a", "x " * 9, "l one\nl one\n\n \nl two\nl one"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    got = {r.doc_id: tuple(r)[3:9] for r in quality.judge(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute.quality(t)


def test_bad_host_costs_only_documents_that_fail_a_rule(spark):
    good = " ".join(f"word{i}" for i in range(30))
    noisy = " ".join(f"word{i}#" for i in range(30))
    rows = [(i, noisy, "bad") for i in range(40)] + [(100, good, "bad")] + [(200 + i, good, "ok") for i in range(40)]
    rows += [(300, noisy, "ok")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.kept, r.host_bad) for r in quality.judge(df).collect()}
    assert got[0] == (False, True) and got[100] == (True, True)
    assert got[200] == (True, False) and got[300] == (True, False)


def test_hosts_above_the_upper_quartile_of_the_prior_are_bad(spark):
    hosts = [("low", 1000, 100), ("usual", 1000, 150), ("high", 1000, 300), ("tiny", 2, 1)]
    good, noisy = " ".join(f"word{i}" for i in range(30)), " ".join(f"word{i}#" for i in range(30))
    rows = [(good if i >= failed else noisy, h) for h, n, failed in hosts for i in range(n)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, source string")
    got = {(r.source, r.text == noisy): (r.host_bad, r.kept) for r in quality.judge(df).collect()}
    rates = [f / n for _, n, f in hosts]
    m = sum(rates) / 4
    k = max(1, min(1000, m * (1 - m) / (sum((x - m) ** 2 for x in rates) / 4) - 1))
    limit = m + 0.6745 * (m * (1 - m) / (k + 1)) ** 0.5
    for h, n, f in hosts:
        bad = (f + m * k) / (n + k) > limit
        assert got[h, True] == (bad, not bad) and got[h, False] == (bad, True)
    # a rate of one half from two documents is drawn below the limit, 0.3 from a thousand is below it too
    assert {h for h, *_ in hosts if got[h, True][0]} == {h for h, n, f in hosts if (f + m * k) / (n + k) > limit}


def test_the_given_tables_have_verdicts_that_the_host_changes(spark):
    docs01 = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = quality.judge(docs01)
    assert judged.where("not base_failed and not kept and host_bad").count() > 0
    assert judged.where("host_bad and demerits = 0 and not kept").count() == 0


def test_beta_prior_shrinks_small_hosts(spark):
    hosts = spark.createDataFrame([("a", 1000, 100), ("b", 1000, 300), ("c", 2, 2)],
                                  "host string, host_docs bigint, host_failed bigint")
    m, v = (0.1 + 0.3 + 1) / 3, None
    r = [0.1, 0.3, 1.0]
    v = sum((x - m) ** 2 for x in r) / 3
    k = max(1, min(1000, m * (1 - m) / v - 1))
    a, b = quality.fit_beta(hosts).first()
    assert a == pytest.approx(m * k) and b == pytest.approx((1 - m) * k)


# --- personal data ---------------------------------------------------------

def pii_rows(df):
    spans = F.col("pii_" if "pii_" in df.columns else "pii")
    return df.select("doc_id", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def test_pii_base(spark, sf):
    got = sorted((tuple(r)[:6] for r in queries.op6_pii(spark, sf).collect()), key=key)
    want = []
    for r in docs(spark, sf).collect():
        spans, digest = brute.pii(r.text)
        want.append((r.doc_id, *[sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")], digest))
    assert got == sorted(want, key=key) and any(w[1] for w in want)


TRICKY = [
    "a@b.c_d@e.f x@@y.z .@-.- a@b a@b. q@w.e.r,t", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.0255 1.2.3 .1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111112 5500005555555559 1 2",
    "+1 (988) 555-2485 +12 +1--2 +49.30.123456. ++44 20 7946 0958 +1 234567890123456",
    "\U0001F600 é a@b.co \U0001F600 10.0.0.1 ü +1 555 123 4567", "DE89 3704 0044 0532 0130 00, GB82WEST12345698765432",
    "DE88370400440532013000", "", "@", "+", "é@ü.de a@é.de", "1-2-3 4 5 6-7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2",
]


def test_pii_tricky_texts(spark):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id bigint, text string")
    out = {r.doc_id: [tuple(s)[:4] for s in r.pii] for r in pii.find_pii(df).collect()}
    for i, t in enumerate(TRICKY):
        assert [s[:3] for s in out[i] if s[0] != "iban"] == brute.pii(t)[0], t
        assert all(t[a:b] == m for _, a, b, m in out[i])
    assert [s[3] for i in out for s in out[i] if s[0] == "iban"] == ["DE89 3704 0044 0532 0130 00",
                                                                     "GB82WEST12345698765432"]


IBANS = [       # text, its account numbers, redacted
    ("DE89 3704 0044 0532 0130 00 Please pay", ["DE89 3704 0044 0532 0130 00"], "<IBAN> Please pay"),
    ("to GB82WEST12345698765432 Thanks", ["GB82WEST12345698765432"], "to <IBAN> Thanks"),
    ("DE89370400440532013000 BIC COBADEFFXXX", ["DE89370400440532013000"], "<IBAN> BIC COBADEFFXXX"),
    ("DE89370400440532013000 12 EUR", ["DE89370400440532013000"], "<IBAN> 12 EUR"),
    ("DE89370400440532013000 GB82 WEST 1234 5698 7654 32 X", ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
     "<IBAN> <IBAN> X"),
    ("FR12 DE89 3704 0044 0532 0130 00 OK", ["DE89 3704 0044 0532 0130 00"], "FR12 <IBAN> OK"),
    ("é AB12 GB82WEST12345698765432", ["GB82WEST12345698765432"], "é AB12 <IBAN>"),
    ("MT84 MALT 0110 0001 2345 MTLC AST0 01S A1", ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"], "<IBAN> A1"),
    ("NO93 8601 1117 947 Oslo", ["NO93 8601 1117 947"], "<IBAN> Oslo"),
    ("DE88370400440532013000 BIC FR12 AA11", [], "DE88370400440532013000 BIC FR12 AA11"),
]


def test_account_numbers_before_capitals_and_digits(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(IBANS)], "doc_id bigint, text string")
    found = {r.doc_id: [s for s in r.pii if s.kind == "iban"] for r in pii.find_pii(df).collect()}
    new = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    for i, (t, want, redacted) in enumerate(IBANS):
        assert [s.match for s in found[i]] == want and new[i] == redacted, t
        assert all(t[s.start:s.end] == s.match for s in found[i])


def test_many_account_numbers_take_linear_time(spark):
    good, n = "DE89 3704 0044 0532 0130 00 X ", 5_000
    df = spark.createDataFrame([(0, good * n), (1, "DE11 " * 40_000)], "doc_id bigint, text string")
    t0 = time.time()
    new = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert new[0] == "<IBAN> X " * n and time.time() - t0 < 60


def test_pii_edge(spark, edge, edge_rows):
    out = pii.find_pii(edge, "pii_")
    assert out.columns == [*edge.columns, "pii_"] and out.count() == len(edge_rows)
    assert pii.find_pii(edge.limit(0), "pii_").count() == 0


def test_pii_long_texts_take_linear_time(spark):
    big = 200_000
    texts = ["a" * big, "a." * big, "1" * big, "1." * big, "a@" + "b." * big, "+" * big, "+1" + " " * big,
             "1 " * big, "A" * big, "AA11" + "B" * big, "x@y.z " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    t0 = time.time()
    n = {r.doc_id: r.n for r in pii.find_pii(df).select("doc_id", F.size("pii").alias("n")).collect()}
    assert time.time() - t0 < 60 and n[10] == 5000


def test_context_raises_the_score(spark):
    df = spark.createDataFrame([(0, "call +1 555 123 4567"), (1, "xxxx +1 555 123 4567")], "doc_id bigint, text string")
    s = {r.doc_id: r.pii[0].score for r in pii.find_pii(df).collect()}
    assert s[0] > s[1]


TELS = [         # text, national numbers found
    ("call 0171 234 5678 now", ["0171 234 5678"]), ("0171 234 5678 alone", []), ("order 0171 234 5678", []),
    ("Phone: 0171 2345678, 030-123 45 67 or (0171) 234-5678", ["0171 2345678", "030-123 45 67", "0171) 234-5678"]),
    ("tel +49 0171 2345678", []), ("phone 0171", []), ("phone 00123456789", []), ("fax 0171234567890123", []),
    ("telephone " + "x" * 41 + " 0171 234 5678", []), ("a phone\n0171/2345678!", ["0171/2345678"]),
]


def test_context_decides_national_numbers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TELS)], "doc_id bigint, text string")
    got = {r.doc_id: [s for s in r.pii if s.kind == "tel"] for r in pii.find_pii(df).collect()}
    new = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    for i, (t, want) in enumerate(TELS):
        assert [s.match for s in got[i]] == want, t
        assert all(t[s.start:s.end] == s.match and s.score >= pii.MIN_SCORE for s in got[i])
        if "+" not in t:
            for m in want:
                t = t.replace(m, "<PHONE>", 1)
            assert new[i] == t


def test_redaction(spark):
    df = spark.createDataFrame([(0, "mail a@b.co or 10.0.0.1!", 24), (1, "clean é", 7), (2, None, None)],
                               "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redacted(df).collect()}
    assert got == {0: ("mail <EMAIL> or <IP>!", 21), 1: ("clean é", 7), 2: (None, None)}


# --- URL filters -----------------------------------------------------------

URLS = ["http://a.net/x", "https://EXAMPLE.net/en/1", "http://example.net", "http://example.net/", "x://org/fr/",
        "x://a.b.org/fr/1?q#f", "http://spam-farm.example.org/en/", "nothing", None, "", "http://", "://",
        "http://h?x=/de/", "a://b://c/d", "http://x.example.com/de/9#t", "http://notexample.com/de/",
        "http://xorg/fr/1", "http://u:p@Host:80/p?a", "http://h\n/p\nq?z"]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "x")],
                               "page_id bigint, url string, verdict string")
    got = sorted(tuple(r) for r in urls.filter_urls(df).collect())
    want = []
    for i, u in [*enumerate(URLS), (0, URLS[0])]:
        h, p = brute.url(u)
        r = brute.rule(h, p)
        want.append((i, h, p, r and r[1] + r[2],
                     r[0] if r else "block" if any(w in h for w in urls.LISTED_WORDS) else "allow"))
    assert got == sorted(want, key=lambda t: t[0])
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_hosts_of_listed_categories(spark):
    listed = ["m.free-bets.example.com", "www.ads-track.example.org", "adult-x.example.org", "spam-farm.example.org",
              "bet365.org", "ads.news.org", "u:p@ads.org:80", "some.name.bet", "some.name.sex.", "bestpills.org"]
    other = ["downloads.example.org", "roads.org", "visit.ad", "alphabet.org", "betsy.org", "essex.org", "loadster.com",
             "ads@news.org", "f\u00f6ad.org", "track-field.org", "example.org", "10.0.0.1", "", "tracker-free.org"]
    df = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(listed + other)], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in urls.filter_urls(df, rules=()).collect()}
    assert [h for i, h in enumerate(listed + other) if got[i] == "block"] == listed


@pytest.mark.parametrize("share,shards,final", [(0.02, None, 32 << 10), (0.5, None, 1 << 10), (0.98, None, 32 << 10),
                                                (0.0, None, 0), (1.0, None, 0), (0.1, 2, 128)])
def test_cascade_is_exact_for_the_whole_universe(spark, share, shards, final):
    scratch = Scratch(spark, "t")
    pages = spark.range(2_000).select(F.concat(F.lit("k"), F.col("id") % 1_500).alias("key"))
    listed = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1000)) < int(share * 1000)
    keys = scratch.write(urls.listed_keys(pages, F.col("key"), listed))
    out = urls.add_membership(pages, "key", "hit", keys.drop("key"), scratch, shards, final)
    assert out.where(F.col("hit") != listed).count() == 0 and out.count() == 2_000


# --- decontamination -------------------------------------------------------

def test_decontamination(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r)[:6] for r in queries.op10_decontamination(spark, sf).collect()), key=key)
    want = sorted(((r.doc_id, *brute.contamination(r.text, items)) for r in docs(spark, sf).collect()), key=key)
    assert got == want and any(w[5] for w in want)


def test_decontamination_random_items_in_one_or_many_blocks(spark):
    import random
    rnd = random.Random(3)
    items = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.choice([0, 1, 3, 6, 12, 13, 14, 20])))) for i in range(40)]
    items += [(None, "z z z"), (7, "q w"), (7, None)]
    texts = [" ".join(rnd.choice("abcz") for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    texts += [items[5][1], "Q, W! z--z z", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (1 << 20, 60):
        out = decontam.find_contamination(df, bench, block_bytes=size).select(
            "doc_id", "n_words", "n_hit", F.size("hit_items"), F.sha2(F.array_join("hit_items", ","), 256),
            "contaminated")
        got = sorted(tuple(r) for r in out.collect())
        assert got == sorted((i, *brute.contamination(t, items)) for i, t in enumerate(texts))


def test_decontamination_edge(spark, edge, edge_rows):
    bench = spark.createDataFrame([(1, "over the lazy dog"), (2, "one")], "item_id bigint, text string")
    out = decontam.find_contamination(edge, bench)
    got = sorted((tuple(r) for r in out.select("doc_id", "n_words_", "n_hit", F.size("hit_items"),
                  F.sha2(F.array_join("hit_items", ","), 256), "contaminated_").collect()), key=key)
    items = [tuple(r) for r in bench.collect()]
    assert got == sorted(((r[0], *brute.contamination(r[1], items)) for r in edge_rows), key=key)
    assert decontam.find_contamination(edge.limit(0), bench).count() == 0
    assert decontam.find_contamination(edge, bench.limit(0)).where("n_hit > 0").count() == 0


def test_overlong_items_are_cut_with_overlap(spark):
    long = " ".join(f"w{i}" for i in range(400))
    text = " ".join(f"w{i}" for i in range(95, 130)) + " x " + " ".join(f"w{i}" for i in range(300, 311))
    df = spark.createDataFrame([(0, text), (1, long)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, long), (8, "w300 w301")], "item_id bigint, text string")
    for size in (1 << 20, 500, 60):
        found = decontam.find_contamination(df, bench, block_bytes=size)
        got = {r.doc_id: (r.n_words, r.hit_spans, r.hit_items) for r in found.collect()}
        assert got == {0: (47, [0, 35, 36, 38], ["7", "8"]), 1: (400, [0, 400], ["7", "8"])}
        assert [r.n for r in found.orderBy("doc_id").select(decontam.removable_words(F.col("hit_spans")).alias("n")).collect()] \
            == [35, 400]


def test_span_removal(spark):
    bench = spark.createDataFrame([(1, "b c d e")], "item_id bigint, text string")
    df = spark.createDataFrame([(0, "A, b C (d) e! f"), (1, "a b c"), (2, None)], "doc_id bigint, text string")
    found = decontam.find_contamination(df, bench)
    got = {r.doc_id: r.text for r in decontam.remove_spans(found, min_words=4).collect()}
    assert got == {0: "A, ! f", 1: "a b c", 2: None}
