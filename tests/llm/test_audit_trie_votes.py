"""Filter audit, conversation trie and neighbour voting against brute force."""

import hashlib
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kbpipe.llm import filter_audit, neighbours, prefix_trie
from kbpipe.llm.filter_audit import FILTERS, Diagram, adjacent_swaps, own_failures, word_counts

# -- decision diagrams ------------------------------------------------------------


def test_adjacent_swaps_visit_every_order():
    things, seen = list("ABCDE"), {"ABCDE"}
    for i in adjacent_swaps(5):
        things[i], things[i + 1] = things[i + 1], things[i]
        seen.add("".join(things))
    assert seen == {"".join(p) for p in permutations("ABCDE")}


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.tuples(st.integers(0, 3), st.integers(0, 2)), max_size=32),
       st.lists(st.integers(0, 3), max_size=25))
def test_swapped_diagram_equals_one_built_in_that_order(weights, swaps):
    d = Diagram(weights or {0: (0, 0)})
    for i in swaps:
        d.swap(i)
        for step, (name, kept, removed) in enumerate(d.steps()):
            bit, earlier = 1 << FILTERS.index(name), sum(1 << FILTERS.index(x) for x in d.order[:step])
            for got, fails in ((removed, True), (kept, False)):
                want = [sum(w[k] for m, w in weights.items() if not m & earlier and bool(m & bit) == fails)
                        for k in range(2)]
                assert list(got) == want
        for level in d.levels:
            assert all((d.low[n], d.high[n]) == pair for pair, n in level.items())


def _brute_audit(docs, labels):
    good, toxic = defaultdict(int), defaultdict(int)
    for i, q, t in labels:
        if i is not None:
            good[i], toxic[i] = max(good[i], int(q == 1)), max(toxic[i], int(t == 1))
    fails = []
    for doc_id, text, part in docs:
        t = text or ""
        ws = t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
        ws = [w for w in ws if w]
        e = doc_id is not None and any(o is not None and o < doc_id and (x or "") == t for o, x, _ in docs)
        f = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws),
             "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": e}
        fails.append((part or "", f, good[doc_id] if doc_id is not None else 0,
                      toxic[doc_id] if doc_id is not None else 0))
    out, shapley = [], defaultdict(int)
    for part in {p for p, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [x for x in left if x[1][name]]
                left = [x for x in left if not x[1][name]]
                shapley[part, name] += len(gone)
                out.append((part, "".join(order), step, len(left), len(gone),
                            sum(x[1][name] for x in mine) - len(gone),
                            sum(x[1][name] and sum(x[1].values()) == 1 for x in mine),
                            sum(x[2] for x in gone), sum(x[3] for x in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_against_brute_force(spark, edge, edge_rows):
    labels = [(1, 1, 0), (1, 0, 1), (6, 1, None), (7, None, 1), (None, 1, 1), (99, 1, 1), (-9, 0, 0)]
    extra = [(20, "Same text here", None, "z"), (21, "Same text here", "x", "z"), (20, "Same text here", "x", "z"),
             (22, "A B C $ " * 30, "x", "z")]
    docs = edge.select("doc_id", "text", "source", "n_words", "kept").unionByName(spark.createDataFrame(
        [(i, t, s, "clash", "clash") for i, t, _, s in extra],
        "doc_id bigint, text string, source string, n_words string, kept string"))
    got = filter_audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    rows = [(r[0], r[1], r[3]) for r in edge_rows] + [(i, t, s) for i, t, _, s in extra]
    assert sorted(map(tuple, got.collect())) == _brute_audit(rows, labels)
    empty = filter_audit.audit_filters(docs.where("false"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert empty.columns == got.columns and empty.count() == 0


def test_texts_are_split_the_same_in_parts():
    text = b"a bb a\tccc\x0bdd a\n" * 9 + b"long" * 9
    assert word_counts(text, 4) == word_counts(text) == (55, 5)
    assert own_failures(b"") == 1 and own_failures("É".encode() * 60) == 1


# -- conversation trie ------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.sets(st.lists(st.integers(0, 6), max_size=6).map(tuple), min_size=1, max_size=40))
def test_double_array_holds_exactly_its_sequences(seqs):
    seqs = sorted(seqs)
    flat = np.array([c for s in seqs for c in s], np.int64)
    trie = prefix_trie.DoubleArray(flat, np.r_[0, np.cumsum([len(s) for s in seqs])], 7)
    prefixes = {s[:d] for s in seqs for d in range(len(s) + 1)}
    places = {(): 0}
    for p in sorted(prefixes, key=len):
        for c in range(7):
            to = int(trie.step(np.array([places[p]]), np.array([c]))[0])
            assert (to > 0) == (p + (c,) in prefixes)
            if to > 0:
                places[p + (c,)] = to
    assert len(set(places.values())) == len(prefixes)


def _brute_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            d = hashlib.blake2b(len(role.encode()).to_bytes(8, "little") + role.encode() + text.encode(), digest_size=16)
            convs[conv].append(((turn is not None, turn or 0, d.digest()), (role, text)))
    convs = {c: [t for _, t in sorted(ts)] for c, ts in convs.items()}
    seqs = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(convs.get(c - c % 20, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:-1] == n for m in members)]
        ends = sorted(c for c in cs if len(seqs[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs),
                    sum(len(m) == len(node) + 1 for m in below), len(leaves),
                    sum((len(members[n]) - 1) * len((n[-1][1] if n else "").split()) for n in below),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda t: [(x is not None, x) for x in t])


def _conversations(seed, n):
    rng, rows = np.random.default_rng(seed), []
    for c in range(n):
        if c % 11 == 5:
            continue
        for t in range(int(rng.integers(0, 7)) + (30 if c % 37 == 0 else 0)):
            k = int(rng.integers(0, 2 if t < 4 else 3))
            rows.append((c, None if k == 9 else t, "user" if t % 2 == 0 else "assistant", f"turn {k} " * (k + 1)))
    return rows + [(3, None, None, None), (3, None, "user", ""), (None, 0, "user", "no conversation"),
                   (4, 0, "user", "turn 0 "), (4, 0, "user", "turn 0 "), (60, 0, "user", "w " * 50_000)]


@pytest.mark.parametrize("shard_turns, tasks", [(1 << 18, 1), (12, 3), (1, 2), (40, 7)])
def test_trie_against_brute_force(spark, shard_turns, tasks):
    rows = _conversations(7, 70)
    df = spark.createDataFrame([(*r, "clash") for r in rows],
                               "conv_id bigint, turn bigint, role string, text string, depth string").repartition(3)
    got = [tuple(r) for r in prefix_trie.prefix_trie(df, shard_turns, tasks).collect()]
    assert sorted(got, key=lambda t: [(x is not None, x) for x in t]) == _brute_trie(rows)


def test_empty_conversations_have_no_node(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    got = prefix_trie.prefix_trie(df)
    assert got.columns == list(prefix_trie.OUT) and got.count() == 0


def test_many_ids_are_hashed_in_blocks(spark):
    ids = [3 * i - 20_000 for i in range(15_000)]
    df = spark.createDataFrame([(bytes([i % 2]), i) for i in ids], "key binary, conv_id bigint")
    got = {bytes(r["key"]): r["ends"] for r in prefix_trie.ends_hashes(df, "key").collect()}
    for k in (0, 1):
        assert got[bytes([k])] == hashlib.sha256(",".join(str(i) for i in ids if i % 2 == k).encode()).hexdigest()


# -- neighbour voting ---------------------------------------------------------------


def _slow_scores(train, texts, k):
    """The model's definition, a row at a time: ``train`` is (text, label, share)."""
    x = np.array([neighbours.terms(t.encode()) for t, *_ in train], np.float64)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1

    def unit(v):
        return v / (np.linalg.norm(v) or 1)

    a = np.array([unit(v * idf) for v in x])
    mean = a.mean(axis=0)
    _, _, axes = np.linalg.svd(a - mean, full_matrices=False)
    axes = axes[:neighbours.LATENT]
    train_z = [unit(axes @ (v - mean)) for v in a]
    out = []
    for t in texts:
        z = unit(axes @ (unit(neighbours.terms((t or "").encode()) * idf) - mean))
        near = sorted(((float(z @ v), y, s) for v, (_, y, s) in zip(train_z, train)), reverse=True)[:k]
        total = sum(max(c, 0) * s for c, _, s in near)
        out.append(sum(max(c, 0) * s * y for c, y, s in near) / total)
    return out


def test_votes_against_slow_version(spark):
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    good = [" ".join(rng.choice(words, 30)) for _ in range(60)]
    bad = [" ".join(w + "###$" for w in rng.choice(words, 12)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    labels = [(i, int(i < 60)) for i, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = neighbours.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    train = [(t, labels[i][1], 1.0) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    got = neighbours.score_quality(docs, model).collect()
    assert [(r["doc_id"], r["held_out"]) for r in got] == [(i, zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows]
    assert np.allclose([r["score"] for r in got], _slow_scores(train, [t for _, t in rows], neighbours.NEIGHBOURS), atol=2e-3)
    assert [r["predicted"] for r in got] == [int(i < 60) for i, _ in rows]


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = neighbours.fit(docs, labels)
    got = neighbours.score_quality(docs, model).where("held_out").join(labels, "doc_id").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in got])
    assert len(got) > 50 and right > 0.93
    low = [r["score"] for r in got if r["quality"] == 0]
    assert np.mean([[h > x for x in low] for h in (r["score"] for r in got if r["quality"] == 1)]) > 0.95


def test_votes_on_edge_rows(spark, edge, edge_rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 1), (7, 0), (7, None), (8, 5), (None, 1)], "doc_id bigint, quality int")
    model = neighbours.fit(edge, labels)
    got = neighbours.score_quality(edge, model).collect()
    assert len(got) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert neighbours.fit(edge, labels.where("false")) is None and neighbours.fit(edge.where("false"), labels) is None
    assert {r["score"] for r in neighbours.score_quality(edge, None).collect()} == {0.5}
    assert neighbours.score_quality(edge.where("false"), model).count() == 0


def test_repeats_are_counted_across_parts():
    text = b"a a b b b c\nc  c d"
    assert neighbours.repeats(text, 2) == neighbours.repeats(text) == 5
