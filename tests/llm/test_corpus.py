"""SimHash, language models, language identification, packing, tool calls, pipeline."""

import itertools
import json
import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbpipe.llm import chat, langid, lm, packing, queries, simhash
from kbpipe.llm.common import Scratch

from . import brute


def key(t):
    return [(x is not None, x) for x in t]


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- SimHash ---------------------------------------------------------------

def test_simhash(spark, sf):
    got = sorted((tuple(r) for r in queries.op3_simhash(spark, sf).collect()), key=key)
    want = brute.simhash([(r.doc_id, r.text) for r in docs(spark, sf).collect()])
    assert got == sorted(want, key=key) and any(d != c for d, _, c in want)


def test_simhash_edge(spark, edge, edge_rows):
    got = sorted((tuple(r) for r in simhash.simhash_components(edge).collect()), key=key)
    assert got == sorted(brute.simhash([r[:2] for r in edge_rows]), key=key)
    assert simhash.simhash_components(edge.limit(0)).count() == 0


@pytest.mark.parametrize("big", [2, 40, 2048])
def test_links_connect_what_brute_force_connects(spark, big):
    rnd = random.Random(big)
    fps = set()
    for _ in range(8):      # dense clusters and chains with distances around the limit
        base = rnd.getrandbits(64)
        for _ in range(60):
            fps.add(base ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([0, 1, 2, 3, 4, 5, 6]))))
    for _ in range(4):
        base = rnd.getrandbits(64)
        fps |= {base ^ rnd.getrandbits(10) for _ in range(120)} | {base ^ (rnd.getrandbits(9) << 40) for _ in range(60)}
    x = base
    for _ in range(40):
        x ^= sum(1 << b for b in rnd.sample(range(64), 4))
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    scratch = Scratch(spark, "t")
    comp = dict(tuple(r) for r in simhash.components(simhash.links(df, scratch, 4, big), scratch).collect())
    up = {f: f for f in fps}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                up[find(a)] = find(b)
    sets = defaultdict(set)
    for f in fps:
        sets[find(f)].add(f - (1 << 64) if f >> 63 else f)
    got = defaultdict(set)
    for f in fps:
        s = f - (1 << 64) if f >> 63 else f
        got[comp.get(s, s)].add(s)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, got.values()))


def test_levels_split_what_the_levels_above_left():
    assert simhash.parts_of(()) == [(0, 32), (32, 32)]
    assert simhash.parts_of((0,)) == [(32, 16), (48, 16)] and simhash.parts_of((1,)) == [(0, 16), (16, 16)]
    assert simhash.parts_of((1, 0)) == [(16, 8), (24, 8)] and simhash.parts_of((0, 1)) == [(32, 8), (40, 8)]


def test_a_dense_ball_is_one_component(spark):
    """1,351 different fingerprints within 3 bits of one overflow the buckets
    of the first two levels (at 64); one more stands alone, 8 bits away."""
    base = 0x0123456789ABCDEF
    free = [*range(10), *range(32, 42)]
    fps = [base ^ sum(1 << b for b in c) for n in range(4) for c in itertools.combinations(free, n)]
    far = base ^ (0xFF << 24)
    df = spark.createDataFrame([(f,) for f in [*fps, far]], "fp bigint")
    scratch = Scratch(spark, "t")
    comp = dict(tuple(r) for r in simhash.components(simhash.links(df, scratch, big=64), scratch).collect())
    assert len({comp[f] for f in fps}) == 1 and far not in comp


def test_equal_value_pairs_are_looked_at_once():
    k = np.array([6] * 3, np.int64)
    assert simhash._meets_here(k, np.array([-1, 0, 0]), np.array([-1, 0, 1])).tolist() == [True, False, False]
    # own values 6 and 7: of the two shared buckets 6 counts
    assert simhash._meets_here(k[:1], np.array([-1]), np.array([0]))[0]
    assert not simhash._meets_here(np.array([7]), np.array([0]), np.array([-1]))[0]


# --- language model --------------------------------------------------------

def test_unigram_columns(spark, sf):
    got = sorted(tuple(r) for r in queries.op5_ctw_score(spark, sf).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect())
    rows = [(r.doc_id, r.text) for r in docs(spark, sf).collect()]
    want = sorted((d, *w) for (d, _), w in zip(rows, brute.unigram(rows)))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)


def test_scores_edge(spark, edge, edge_rows):
    rows = [r[:2] for r in edge_rows]
    for size in (lm.CHUNK_BYTES, 100):
        got = sorted((tuple(r)[:6] for r in lm.score_texts(edge, size).collect()), key=key)
        want = sorted(((d, *w) for (d, _), w in zip(rows, brute.unigram(rows))), key=key)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert lm.score_texts(edge.limit(0)).count() == 0
    held = edge.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    if held.count():
        r = lm.score_texts(held).first()
        assert r.train_tokens == 0 and r.bits_per_byte == pytest.approx(8)


class SlowTree:
    """Context-tree weighting by its recursive definition."""

    def __init__(self, data):
        self.bits = defaultdict(lambda: [0, 0])     # (context bytes, bit prefix) -> counts
        for raw in data:
            padded = b"\0" * D + raw + b"\xff"
            for i in range(D, len(padded)):
                self.add(padded[i - D:i], padded[i])

    def add(self, ctx, byte):
        s = f"{byte:08b}"
        for d in range(D + 1):
            for k in range(8):
                self.bits[ctx[D - d:], s[:k]][int(s[k])] += 1

    @staticmethod
    def kt(z, o):
        return math.lgamma(z + .5) + math.lgamma(o + .5) - math.lgamma(z + o + 1) - math.log(math.pi)

    def weighted(self, ctx, prefix):
        own = self.kt(*self.bits.get((ctx, prefix), (0, 0)))
        if len(ctx) == D:
            return own
        kids = sum(self.weighted(bytes([c]) + ctx, prefix) for c in range(256)
                   if (bytes([c]) + ctx, prefix) in self.bits)
        return np.logaddexp(own, kids) - math.log(2)

    def prob(self, ctx, prefix, bit):
        """P(next bit) as the ratio of weighted probabilities with and without it."""
        before = self.weighted(b"", prefix)
        nodes = [(ctx[D - d:], prefix) for d in range(D + 1)]
        known = [n in self.bits for n in nodes]
        for n in nodes:
            self.bits[n][bit] += 1
        after = self.weighted(b"", prefix)
        for n, k in zip(nodes, known):
            self.bits[n][bit] -= 1
            if not k:
                del self.bits[n]
        return math.exp(after - before)


D = lm.DEPTH


def _code(ctx, byte):
    out = 0
    for b in (*ctx[::-1], byte):
        out = out << 8 | b
    return out


def test_context_tree_matches_its_definition():
    """Depths 0 to 6, the tree cut into parts as the job cuts it."""
    data = [b"abracadabra abracadabra", b"aaaaaaaaa", b"abba cad", "é".encode(), b""]
    asked = [(ctx, byte) for ctx in (b"racada", b"dabrac", b"zzzzab", b"zacada", b"\0" * 6, b"aaaaaa", b"qqqqqq")
             for byte in (*range(90, 120, 3), ord("b"), ord("a"), 0xff)] + [(b"abraca", b) for b in range(256)]
    gram, count = np.unique(np.concatenate([c for d in data for c in lm.codes(d)]), return_counts=True)
    extra = np.array([_code(*a) for a in asked], np.int64)
    code, n = lm.summed([gram, np.unique(extra)], [count, np.zeros(len(np.unique(extra)), np.int64)])
    part = lm.part_of(code, 40)
    trees = [lm.Subtrees(code[part == p], n[part == p]) for p in np.unique(part)]
    assert len(trees) > 5
    handed = [(lm._numbered(bit, name), *rest) for t in trees for bit, (name, *rest) in enumerate(t.handed)]
    node, at = np.unique(np.concatenate([h[0] for h in handed]), return_inverse=True)
    top = lm.Top(node, *(np.bincount(at, weights=np.concatenate([h[i] for h in handed])) for i in (1, 2, 3)))
    got = {int(c): float(v) for t in trees for c, v in zip(t.code, t.log10(top))}
    slow = SlowTree(data)
    for ctx, byte in asked[::3]:
        s = f"{byte:08b}"
        want = sum(math.log10(slow.prob(ctx, s[:k], int(s[k]))) for k in range(8))
        assert got[_code(ctx, byte)] == pytest.approx(want, rel=1e-5), (ctx, byte)
    assert sum(10 ** got[_code(b"abraca", b)] for b in range(256)) == pytest.approx(1, rel=1e-4)


@pytest.mark.parametrize("n", [10 ** 6, 10 ** 8, 10 ** 10])
def test_a_bit_that_training_never_saw_keeps_a_probability(n):
    """Newlines only among the control bytes of a large corpus: a held-out
    text with another one still has a finite score."""
    seen = np.sort([_code(b"abcde" + bytes([c]), 10) for c in range(40, 110)])
    new = _code(b"abcde" + bytes([50]), 1)
    code, count = lm.summed([seen, np.array([new])], [np.full(len(seen), n // len(seen)), np.zeros(1, np.int64)])
    tree = lm.Subtrees(code, count)
    handed = [(lm._numbered(bit, name), *rest) for bit, (name, *rest) in enumerate(tree.handed)]
    got = tree.log10(lm.Top(*(np.concatenate(x) for x in zip(*handed))))
    assert np.isfinite(got).all() and (got <= 0).all()
    assert got[code == new] == pytest.approx(math.log10(.5 / (n + 1)), abs=1.5)


def test_scores_are_those_of_one_tree(spark):
    """Whole job against the slow tree, however chunks and parts are cut."""
    texts = ["abracadabra", "abraca dabra", None, "", "aaaa", "abracadabra abra"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    held = {i for i in range(6) if crc32(str(i).encode()) % 7 == 2}
    slow = SlowTree([(t or "").encode() for i, t in enumerate(texts) if i not in held])
    want = []
    for t in texts:
        padded, total = b"\0" * D + (t or "").encode() + b"\xff", 0.0
        for i in range(D, len(padded)):
            s = f"{padded[i]:08b}"
            total += sum(math.log10(slow.prob(padded[i - D:i], s[:k], int(s[k]))) for k in range(8))
        want.append(total)
    for chunk_bytes, parts in ((lm.CHUNK_BYTES, 4), (12, 50), (1, 1)):
        got = {r.doc_id: r.score for r in lm.score_texts(df, chunk_bytes, parts).collect()}
        assert [got[i] for i in range(6)] == pytest.approx(want, rel=1e-5)


def test_longer_contexts_tell_fluent_from_scrambled_text(spark):
    import random
    rnd = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda"]
    nxt = {w: rnd.sample(words, 2) for w in words}

    def fluent(n):
        out = [rnd.choice(words)]
        while len(out) < n:
            out.append(rnd.choice(nxt[out[-1]]))
        return out

    rows, pairs = [], []
    for i in range(400):
        ws = fluent(40)
        rows.append((i, " ".join(ws)))
        if crc32(str(i).encode()) % 7 == 2:
            for k in range(1000 + 1000 * i, 10 ** 9):      # an id that is held out as well
                if crc32(str(k).encode()) % 7 == 2:
                    rows.append((k, " ".join(rnd.sample(ws, len(ws)))))
                    pairs.append((i, k))
                    break
    got = {r.doc_id: r.bits_per_byte for r in lm.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(pairs) > 20 and all(got[a] < got[b] for a, b in pairs)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 100.0, 1e6])
    assert lm._log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)


def test_held_out_texts_are_predicted(spark, sf):
    r = queries.op5_ctw_score(spark, sf).where("held_out").agg(F.avg("bits_per_byte")).first()[0]
    assert r < 4


# --- language identification -----------------------------------------------

def test_languages(spark, sf):
    out = queries.op8_language_id(spark, sf).withColumnRenamed("doc_id", "i")
    d = docs(spark, sf)
    j = out.join(d, out.i == d.doc_id).where("held_out and lang is not null").select("lang", "lang_pred").collect()
    assert len(j) > 20 and sum(r.lang == r.lang_pred for r in j) >= 0.9 * len(j)
    r = out.agg(F.min("score"), F.max("score"), F.count("*")).first()
    assert 0 <= r[0] and r[1] <= 1 and r[2] == d.count()


def test_languages_edge(spark, edge, edge_rows):
    out = langid.identify(edge, langid.fit(edge)).collect()
    want = {r[0]: crc32(str(r[0]).encode()) % 5 == 0 if r[0] is not None else False for r in edge_rows}
    assert len(out) == len(edge_rows) and all(r.held_out == want[r.doc_id] for r in out)
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert {2, 3, 4, 8} <= und and 6 not in und
    assert langid.fit(edge.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(edge, None).collect()} == {"und"}


def test_languages_match_a_version_written_as_loops(spark, sf):
    model = langid.fit(docs(spark, sf))
    assert any(len(m) > 2 for m in model.members.values()) or model.pair_w
    text = {r.doc_id: r.text for r in docs(spark, sf).collect()}
    for r in queries.op8_language_id(spark, sf).collect():
        t = text[r.doc_id]
        want = brute.language(t, model) if t and any(ch.isalpha() for ch in t) else ("und", 0.0)
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-3, r.doc_id


def test_svm_weights_leave_no_gradient():
    # the fitted weights are a minimum of the stated objective
    rnd = np.random.default_rng(3)
    x = rnd.normal(0, 1, (60, 4)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] + 0.3 * rnd.normal(0, 1, 60) > 0, 1, -1).astype(np.float32)
    w = langid.fit_svm(x, y, rounds=5000)

    def loss(v):
        z = np.hstack([x, np.ones((60, 1))])
        share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        return 0.5 * (v @ v) / (10.0 * 60) + float((share * np.maximum(0, 1 - y * (z @ v)) ** 2).sum())
    best = loss(w.astype(np.float64))
    assert all(loss(w + 0.01 * rnd.normal(0, 1, 5)) >= best - 1e-6 for _ in range(200))


def test_training_sample_is_bounded_per_language(spark):
    rows = langid.training_rows(spark.range(3000).selectExpr(
        "id as doc_id", "'the same text' as text", "if(id % 100 = 0, 'fr', 'en') as lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    got = {r["lang"]: r["count"] for r in langid.training_sample(rows, counts, 50).groupBy("lang").count().collect()}
    assert got == {"en": 50, "fr": counts["fr"]} and counts["en"] > 2000


def test_features_of_long_texts_are_those_of_the_whole(monkeypatch):
    raw = bytes(random.Random(1).choices(b"abc\xc3\xa9 ", k=5000))
    whole = langid.features(raw)
    monkeypatch.setattr(langid, "_STEP", 7)
    assert np.allclose(langid.features(raw), whole)


def test_families_are_told_apart_before_languages():
    rnd = np.random.default_rng(0)
    langs = np.array(["en", "de", "fr", "es", "xx"] * 40, dtype=object)
    x = np.abs(rnd.normal(0, 0.05, (200, 32))).astype(np.float32)
    for i, v in enumerate(["en", "de", "fr", "es", "xx"]):
        x[langs == v, i] += 1
        x[langs == v, 10 + (i // 2)] += 1
    m = langid.Model(x, langs, 32)
    assert m.families == ["germanic", "romance", "xx"] and set(m.pair_w) == {("de", "en"), ("es", "fr")}
    assert [m.predict(v)[0] for v in x] == langs.tolist()


# --- packing ---------------------------------------------------------------

def check_packing(rows, texts, capacity=2048):
    """rows of the query against the tokenizers library and the contract."""
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        cuts = cuts if len(ids) > capacity else [0, len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, n, a, b - a, crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_packing(spark, sf):
    texts = [(r.doc_id, r.text) for r in docs(spark, sf).collect()]
    rows = queries.op9_best_fit_packing(spark, sf).collect()
    n = check_packing(rows, texts)
    assert n <= math.ceil(sum(r.length for r in rows) / 2048) + 2


def test_packing_edge(spark, edge, edge_rows):
    extra = spark.createDataFrame([(50, "a <|endoftext|> b"), (51, "<|endoftext|>")], "doc_id bigint, text string")
    both = edge.select("doc_id", "text").union(extra)
    rows = packing.pack(both).collect()
    check_packing(rows, [*(r[:2] for r in edge_rows), (50, "a <|endoftext|> b"), (51, "<|endoftext|>")])
    assert packing.pack(edge).count() >= len(edge_rows) and packing.pack(edge.limit(0)).count() == 0


def test_exchange_between_groups_never_costs_a_sequence(spark, sf):
    texts = [(r.doc_id, r.text) for r in docs(spark, sf).collect()]
    d = docs(spark, sf)
    n = [check_packing(packing.pack(d, group_pieces=4, rounds=r).collect(), texts)
         for r in (0, 3, None)]
    assert n[2] <= n[1] <= n[0]


def test_certificate_reports_bound_and_gap(spark, sf):
    packed = packing.pack(docs(spark, sf))
    rows = packed.collect()
    lengths = np.array([r.length for r in rows])
    bins = len({r.sequence_id for r in rows})
    bound = packing.lower_bound(lengths)
    assert packing.certificate(packed).collect() == [(len(rows), bins, bound, bins - bound)]
    # two pieces of 60 never share a sequence of 100; a third sequence is one too many
    loose = spark.createDataFrame([(60, 1), (60, 2), (40, 3)], "length bigint, sequence_id bigint")
    assert tuple(packing.certificate(loose, 100).first()) == (3, 3, 2, 1)
    assert tuple(packing.certificate(loose.limit(0), 100).first()) == (0, 0, 0, 0)


def test_groups_over_their_bound_hand_on_their_worst_bins():
    # best-fit decreasing needs 3 bins, the bound is 2
    lengths = np.array([5, 4, 4, 3, 2, 2])
    bins, certified, loose = packing.pack_group(lengths, None, 10)
    assert bins.max() == 2 and not certified and loose.all()
    kept, certified, _ = packing.pack_group(lengths, np.array([0, 1, 1, 0, 0, 1]), 10)
    assert kept.tolist() == [0, 1, 1, 0, 0, 1] and certified
    assert packing.pack_group(np.array([6, 6]), None, 10)[1]


def test_both_tokenizer_files_agree_on_every_code_point():
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.tokenizer("byte_bpe_50k")
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 7 == 0)]
    lines = [f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}{chr(c)} .{chr(c)}" for c in points]
    for i in range(0, len(lines), 20_000):
        part = lines[i:i + 20_000]
        assert [e.ids for e in tok.encode_batch(part, add_special_tokens=False)] == [fast(t) for t in part]


@pytest.mark.parametrize("seed", range(4))
def test_bounds_never_exceed_a_packing(seed):
    rnd = np.random.default_rng(seed)
    for _ in range(30):
        n = rnd.integers(1, 9)
        lengths = rnd.integers(1, 101, n)
        bins = packing.best_fit_decreasing(lengths, 100)
        assert np.bincount(bins, weights=lengths).max() <= 100
        best = n                     # exact optimum by search
        loads: list[int] = []

        def place(i):
            nonlocal best
            if len(loads) >= best:
                return
            if i == n:
                best = len(loads)
                return
            for k in range(len(loads)):
                if loads[k] + lengths[i] <= 100:
                    loads[k] += lengths[i]
                    place(i + 1)
                    loads[k] -= lengths[i]
            loads.append(lengths[i])
            place(i + 1)
            loads.pop()

        place(0)
        assert packing.lower_bound(lengths, 100) <= best <= bins.max() + 1
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3      # better than total size


# --- tool calls ------------------------------------------------------------

SCHEMAS = {"f": {"type": "object", "required": ["x"], "additionalProperties": False,
                 "properties": {"x": {"type": "integer", "minimum": 0}, "y": {"type": "array", "items": {"type": "string"}}}}}


def message(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(call_id, content):
    return json.dumps({"tool_call_id": call_id, "content": content})


def test_tool_calls(spark):
    ref = {"$ref": "b"}
    rows = [
        (1, 1, "assistant", message(("a", "f", {"x": ref}), ("b", "f", {"x": 2.0, "y": ["é\n"]}))),
        (1, 2, "tool", result("b", {"z": 1, "a": [1.5, None]})),
        (1, 2, "tool", result("a", "ok")),
        (1, 3, "assistant", message(("c", "f", {"x": -1}), ("d", "g", {}), ("e", "f", "{\"x\": 3}"), ("b", "f", {"x": 1}))),
        (1, 4, "tool", result("e", 1)), (1, 5, "tool", result("e", 2)), (1, 5, "tool", result("nope", 2)),
        (2, 1, "assistant", message(("p", "f", {"x": {"$ref": "q"}}), ("q", "f", {"x": {"$ref": "p"}}))),
        (2, 2, "assistant", message(("r", "f", {"x": {"$ref": "later"}}), ("s", "f", {"x": 0}), (None, "f", {"x": 1}))),
        (2, 3, "tool", result("r", 1)), (2, 0, "tool", result("s", 1)),
        (2, 9, "assistant", message(("later", "f", {"x": 0}))),
        (2, 10, "tool", result("later", 0)),
        (3, 1, "assistant", "not json"), (3, 1, "assistant", None), (3, 1, "tool", "[]"), (3, 1, "tool", "{\"x\": NaN}"),
        (3, 2, "user", message(("u", "f", {"x": 1}))), (None, None, "assistant", message(("n", "f", {"x": 1}))),
        (None, None, "tool", result("n", 7)), (4, 1, "assistant", "[" * 5000),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows],
                               "conv_id bigint, turn bigint, role string, text string, status string, ck string")
    out = chat.link_tool_calls(df, SCHEMAS).collect()
    got = {(r.conv_id, r.turn, r.call_id): r for r in out}
    assert len(out) == len(got)
    status = {k: r.status for k, r in got.items()}
    assert status == {
        (1, 1, "b"): "ok", (1, 1, "a"): "ok", (1, 3, "c"): "invalid", (1, 3, "d"): "invalid", (1, 3, "e"): "ok",
        (1, 3, "b"): "duplicate", (1, None, "nope"): "orphan", (2, 1, "p"): "invalid", (2, 1, "q"): "invalid",
        (2, 2, "r"): "unresolved", (2, 2, "s"): "unanswered", (2, 2, None): "invalid", (2, None, "s"): "orphan",
        (2, 9, "later"): "ok", (None, None, "n"): "ok"}
    assert (got[1, 1, "b"].pos, got[1, 1, "a"].pos) == (0, 1)
    assert got[1, 3, "c"].problems == ["$.x: below minimum"] and got[2, 1, "p"].problems == ["refs: cycle"]
    assert got[1, 1, "b"].line == ('{"arguments":{"x":2,"y":["é\\n"]},"id":"b","name":"f",'
                                   '"result":{"a":[1.5,null],"z":1}}')
    assert got[1, 3, "e"].result_turn == 4
    assert chat.link_tool_calls(df.limit(0), SCHEMAS).count() == 0


def test_tool_calls_with_identifiers_that_restart(spark):
    ref = {"x": {"$ref": "a"}}
    rows = [(1, 0, "tool", result("a", 0)), (1, -1, "tool", result("a", -1)), (1, 1, "assistant", message(("a", "f", {"x": 1}))),
            (1, 2, "tool", result("a", "two")), (1, 2, "tool", result("a", "more")), (1, 3, "tool", result("a", "later")),
            (1, 4, "assistant", message(("a", "f", {"x": 2}), ("a", "f", {"x": 3}), ("b", "f", ref))),
            (1, 5, "tool", result("a", "five")), (1, 5, "tool", result("b", "b")),
            (1, 6, "assistant", message(("a", "f", {"x": 4}))),
            (2, 1, "assistant", message(("a", "f", {"x": 1}))), (2, 2, "tool", result("a", "other"))]
    out = chat.link_tool_calls(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"),
                               SCHEMAS).collect()
    got = sorted((r.conv_id, r.turn or 0, r.pos or 0, r.call_id, r.status, json.loads(r.line)["result"],
                  [tuple(m) for m in r.more_results]) for r in out)
    assert got == [
        (1, 0, 0, "a", "orphan", -1, []), (1, 0, 0, "a", "orphan", 0, []), (1, 1, 0, "a", "ok", "more", [(2, '"two"'), (3, '"later"')]),
        (1, 4, 0, "a", "ok", "five", []), (1, 4, 1, "a", "duplicate", None, []), (1, 4, 2, "b", "ok", "b", []),
        (1, 6, 0, "a", "duplicate", None, []), (2, 1, 0, "a", "ok", "other", [])]


def test_tool_calls_with_odd_json(spark):
    schemas = {"f": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}, "e": {"enum": [1, "a"]},
                                                      "b": {"type": "boolean", "minimum": 5}}}}
    s = "\\ud800"
    calls = ['{"id":"a","name":"f","arguments":{"n":1e999}}', '{"id":"b","name":"f","arguments":{"n":-1e999,"x":"%s"}}' % s,
             '{"id":"c%s","name":"f","arguments":{}}' % s, '{"id":"d","name":"f%s","arguments":{}}' % s,
             '{"id":"e","name":"f","arguments":{"e":true}}', '{"id":"g","name":"f","arguments":{"e":1.0,"b":true}}',
             '{"id":"h","name":"f","arguments":"{\\"n\\": 2}"}', '{"id":"i","name":"f","arguments":{"n":"3","%s":1}}' % s,
             '{"id":"j","name":"f","arguments":%s1%s}' % ("[" * 3000, "]" * 3000)]
    rows = [(1, 0, "assistant", '{"tool_calls":[%s]}' % ",".join(calls), "x"),
            (1, 1, "tool", '{"tool_call_id":"g","content":"%s"}' % s, "x"), (1, 1, "tool", '{"tool_call_id":"%s","content":1}' % s, "x"),
            (1, 1, "tool", '{"tool_call_id":"h","content":1e999}', "x"), (1, 2, "tool", '{"tool_call_id":"h","content":"ok"}', "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, status string")
    got = {r.pos: r for r in chat.link_tool_calls(df, schemas).collect()}
    assert [got[i].status for i in range(9)] == ["invalid"] * 5 + ["unanswered", "ok", "invalid", "invalid"]
    assert got[0].problems == ["$.n: not integer", "$: not serialisable"]
    assert got[2].problems == ["id: not Unicode", "id: missing"] and got[3].problems[0] == "name: not Unicode"
    assert got[4].problems == ["$.e: not in enum"] and got[5].problems == []
    assert got[8].problems[-1] == "$: not serialisable"
    assert got[6].result_turn == 2


def test_derived_messages_reach_every_status(spark):
    got = {r.status for r in queries.op1_tool_calls(spark, "/root/testdata/sf0.01").select("status").distinct().collect()}
    assert got == {"ok", "invalid", "duplicate", "unresolved", "unanswered", "orphan"}


def test_op1_matches_plain_linking(spark, sf):
    conv = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    want = []
    for (c, t), r in conv.items():
        if r.role == "user":
            top_k, cycle = len(r.text or "") % 12, c % 9 == 4
            answered = (c, t + 1) in conv and conv[c, t + 1].role == "assistant"
            want.append((c, t, f"s{t}", "invalid" if cycle or not 1 <= top_k <= 10 else "ok" if answered else "unanswered"))
            want.append((c, t, f"m{t}", "invalid" if cycle else "ok" if answered else "unresolved"))
            if c % 6 == 5:
                want.append((c, t, f"s{t}", "duplicate"))
            elif top_k == 11:
                want.append((c, t, f"t{t}", "invalid"))
        elif r.role == "assistant":
            if not ((c, t - 1) in conv and conv[c, t - 1].role == "user"):
                want += [(c, None, f"s{t - 1}", "orphan"), (c, None, f"m{t - 1}", "orphan")]
            if c % 8 == 7:
                want.append((c, None, f"x{t - 1}", "orphan"))
    out = queries.op1_tool_calls(spark, sf).collect()
    assert sorted(((r.conv_id, r.turn, r.call_id, r.status) for r in out), key=str) == sorted(want, key=str)
    for r in out:
        line = json.loads(r.line)
        assert json.dumps(line, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.line
        if r.status == "ok":
            assert line["result"] == (conv[r.conv_id, r.result_turn].text or "")
            assert r.pos == (0 if r.call_id[0] == "s" else 1)


# --- pipeline --------------------------------------------------------------

def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline
    d = docs(spark, sf)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    cur, seen = d, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, cur, sf)
        out.write.parquet(str(tmp_path / name))
        seen[name] = cur = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert cur.columns == d.columns and cur.dtypes == d.dtypes
    rows = {n: {r.doc_id: r for r in x.collect()} for n, x in seen.items() if n != "best_fit_packing"}
    start = {r.doc_id: r for r in d.collect()}
    judged = {r.doc_id: r.kept for r in queries.op4_quality_rules(spark, sf).collect()}
    assert set(rows["quality_rules"]) == {i for i in start if judged[i]}
    kept = [(i, start[i].text) for i in sorted(rows["quality_rules"])]
    assert set(rows["near_duplicates"]) == {c for _, _, c in brute.simhash(kept)}
    clean = {i for i in rows["near_duplicates"] if not brute.contamination(start[i].text, items)[4]}
    assert set(rows["benchmark_decontamination"]) == clean < set(rows["near_duplicates"])
    assert set(rows["personal_data"]) == clean
    for i, r in rows["personal_data"].items():
        assert not brute.pii(r.text)[0]
        assert (r.text == start[i].text) == (not brute.pii(start[i].text)[0]) and r.n_chars == len(r.text)
    check_packing(seen["best_fit_packing"].collect(), [(i, r.text) for i, r in rows["personal_data"].items()])
    final = Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf).collect())
    assert final == Counter(tuple(r)[:5] for r in seen["best_fit_packing"].collect())


def test_pipeline_stages_edge(spark, edge, sf, tmp_path):
    import corpus_pipeline
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge, sf)
        assert out.dtypes == edge.dtypes or name == "best_fit_packing"
        out.write.parquet(str(tmp_path / name))
        assert stage(spark, edge.limit(0), sf).count() == 0
    pieces = spark.read.parquet(str(tmp_path / "best_fit_packing"))
    # every row's pieces follow each other without gaps, every sequence is filled from its start
    assert pieces.where("piece = 0").count() == edge.count() and pieces.where("length > 2048 or length < 1").count() == 0
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")) \
        .where("n != m or n > 2048").count() == 0
    dedup = spark.read.parquet(str(tmp_path / "near_duplicates"))
    assert dedup.where("doc_id = 1").count() == 1 and dedup.where("doc_id is null and text is not null").count() == 1
    assert spark.read.parquet(str(tmp_path / "personal_data")).where("n_words = 'clash'").count() == edge.count()
