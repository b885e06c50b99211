"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that
differ in at most 4 bits differ in at most 2 bits within one segment, so the
Hamming balls of radius 1 around the two segment values meet. Every distinct
fingerprint is entered under the 33 values of the ball of each segment (66
table rows, whatever the group sizes), rows that meet are fetched by one
shuffle on the value, and complete distances are verified there with NumPy.
A pair is looked at in exactly one bucket per segment.

Large buckets (many different fingerprints around one segment value) are not
compared in that task: their rows go on, unchanged, to a second table keyed
by the ball of a 16-bit half of the other segment as well, and large buckets of
that one to a third, keyed by the ball of an 8-bit part of its other half too.
A bucket of the third table has 8 free bits, so it can't hold more than
33 * 17 * 9 * 256 (1.3 million) different fingerprints, whatever the table.
Only a spanning set of the verified links leaves a bucket, never all pairs.
Exact copies share a fingerprint and are grouped before all this.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbpipe.llm.common import Scratch, arrow_map, free_name, texts, tokens

SHINGLE = 4       # words per shingle
MAX_BITS = 4      # largest distance of a link
BIG_BUCKET = 2048  # distinct fingerprints of a bucket compared within one task

_WEIGHTS = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Bit set where more than half of the shingles' XXH64 (seed 42) have it."""
    ws = tokens(raw)
    if not ws:
        return 0
    n = max(1, len(ws) - shingle + 1)
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[-n:].tolist() if n > 1 else [len(joined)]
    h64 = xxhash.xxh64_intdigest
    h = np.fromiter((h64(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):      # bounded memory for very long texts
        bits = np.unpackbits(h[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8),
                             axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(_WEIGHTS[2 * ones > n].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``; ``fp`` holds the 64 bits as a signed bigint."""
    def run(batch):
        fps = np.array([fingerprint(t, shingle) for t in texts(batch, "text")], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(fps.view(np.int64))}

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, fp bigint")


def _segment(fp: str, shift: int, bits: int) -> str:
    return f"(shiftrightunsigned({fp}, {shift}) & {(1 << bits) - 1}L)"


def _enter(df: DataFrame, keys: list[str], segments: list[tuple[int, int]], level: int) -> DataFrame:
    """Rows of ``df`` once per value of the radius-1 ball of every segment:
    key ``s{level}`` (segment number), ``k{level}`` (value), ``f{level}``
    (flipped bit, -1 for the own value)."""
    parts = []
    for n, (shift, bits) in enumerate(segments):
        parts.append(f"transform(sequence(-1, {bits - 1}), i -> named_struct("
                     f"'s{level}', {n}, 'k{level}', {_segment('fp', shift, bits)} ^ "
                     f"if(i < 0, 0L, shiftleft(1L, i)), 'f{level}', i))")
    keep = [F.col(k) for k in keys]
    return df.select("fp", *keep, F.inline(F.expr(f"concat({', '.join(parts)})")))


def _meets_here(key: np.ndarray, fi: np.ndarray, fj: np.ndarray) -> np.ndarray:
    """True in the one bucket, of those two entries share, that counts.

    Equal segment values share all buckets: their own value counts. Values
    one bit apart share their two own values, values two bits apart the two
    values between: of these the smaller counts.
    """
    ci, cj = fi < 0, fj < 0
    one = np.int64(1)
    bi = np.where(ci, 0, np.left_shift(one, np.maximum(fi, 0).astype(np.int64)))
    bj = np.where(cj, 0, np.left_shift(one, np.maximum(fj, 0).astype(np.int64)))
    return np.where(fi == fj, ci, key < (key ^ bi ^ bj))


class _Forest:
    """Union-find over positions of one bucket, for a spanning set of links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if np.array_equal(nxt, up):
                self.up = up
                return up
            up = nxt

    def join(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Adds links; the mask of those that joined two trees."""
        used = np.zeros(len(i), bool)
        r = self.roots()
        for n in np.flatnonzero(r[i] != r[j]):
            a, b = self._find(i[n]), self._find(j[n])
            if a != b:
                self.up[max(a, b)] = min(a, b)
                used[n] = True
        return used

    def _find(self, x):
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x


def _links(fp, bucket, keys, flips, max_bits: int):
    """Spanning links of every bucket of sorted rows, by rising row offset."""
    n = len(fp)
    forest, out = _Forest(n), []
    idx, off = np.arange(n), 1
    while True:
        idx = idx[idx + off < n]
        idx = idx[bucket[idx] == bucket[idx + off]]
        if not len(idx):
            break
        j = idx + off
        near = np.bitwise_count((fp[idx] ^ fp[j]).view(np.uint64)) <= max_bits
        near &= fp[idx] != fp[j]
        for k, f in zip(keys, flips):
            near &= _meets_here(k[idx], f[idx], f[j])
        a, b = idx[near], j[near]
        if len(a):
            used = forest.join(a, b)
            out.append((fp[a[used]], fp[b[used]]))
        off += 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _compare(level: int, max_bits: int, big: int | None):
    """Task over rows sorted by bucket: links of the buckets of at most
    ``big`` rows, and the rows of larger ones as they are (``dst`` NULL)."""
    names = [f"{c}{i}" for i in range(1, level + 1) for c in "skf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        n_held, passing = 0, False

        def out(src, dst, rows=None):
            cols = [pa.array(src, pa.int64()), pa.array(dst, pa.int64()) if dst is not None
                    else pa.nulls(len(src), pa.int64())]
            for c in names:
                cols.append(pa.nulls(len(src), pa.int64()) if rows is None
                            else pa.array(rows[c], pa.int64()))
            return pa.RecordBatch.from_arrays(cols, names=["src", "dst", *names])

        def bucket_ids(rows):
            new = np.zeros(len(rows["fp"]), np.int64)
            for c in names:
                if c[0] != "f":
                    new[1:] |= rows[c][1:] != rows[c][:-1]
            return np.cumsum(new)

        def compare(rows):
            if not len(rows["fp"]):
                return
            b = bucket_ids(rows)
            if big:
                size = np.bincount(b)
                large = size[b] > big
                if large.any():
                    yield out(rows["fp"][large], None, {c: rows[c][large] for c in names})
                    rows = {c: v[~large] for c, v in rows.items()}
                    b = b[~large]
            src, dst = _links(rows["fp"], b, [rows[f"k{i}"] for i in range(1, level + 1)],
                              [rows[f"f{i}"] for i in range(1, level + 1)], max_bits)
            if len(src):
                yield out(src, dst)

        def joined(parts):
            return {c: np.concatenate([p[c] for p in parts]) for c in ["fp", *names]}

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                    for c in ["fp", *names]}
            same = passing or bool(held)
            if same:
                last = held[-1]
                alike = np.ones(len(rows["fp"]), bool)
                for c in names:
                    if c[0] != "f":
                        alike &= rows[c] == last[c][-1]
                head = len(alike) if alike.all() else int(np.argmin(alike))
            else:
                head = 0
            if passing and head:
                # the rest of a bucket already found to be large
                yield out(rows["fp"][:head], None, {c: rows[c][:head] for c in names})
                rows = {c: v[head:] for c, v in rows.items()}
                if not len(rows["fp"]):
                    continue
            elif head == len(rows["fp"]):
                held.append(rows)
                n_held += head
                if big and n_held > big:
                    # may hold earlier buckets' tail only: it is one bucket
                    all_rows = joined(held)
                    yield out(all_rows["fp"], None, all_rows)
                    held, n_held, passing = [{c: v[-1:] for c, v in rows.items()}], 0, True
                continue
            if passing:
                held, passing = [], False
            rows = joined([*held, rows]) if held else rows
            b = bucket_ids(rows)
            tail = b == b[-1]
            yield from compare({c: v[~tail] for c, v in rows.items()})
            held = [{c: v[tail] for c, v in rows.items()}]
            n_held = int(tail.sum())
        if held and not passing:
            yield from compare(joined(held))

    return run


LEVELS = 3


def parts_of(path: tuple[int, ...]) -> list[tuple[int, int]]:
    """The two (shift, bits) that a level's key is taken from, given the part
    numbers chosen at the levels above: the fingerprint's halves, then the
    halves of the half not chosen, and so on. Two fingerprints that differ in
    at most 4 bits differ in at most 2 of one of the two parts, at any level."""
    shift, bits = 0, 64
    for chosen in path:
        bits //= 2
        shift += bits * (1 - chosen)
    return [(shift, bits // 2), (shift + bits // 2, bits // 2)]


def links(fps: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS,
          big: int = BIG_BUCKET) -> DataFrame:
    """``(src, dst)``: links that connect whatever distinct fingerprints of
    ``fps`` (column ``fp``) are connected by distances of at most
    ``max_bits`` (at most 4)."""
    if not 0 <= max_bits <= 4:
        raise ValueError("two segments with balls of radius 1 find distances of at most 4")
    schema, keys, found = "src bigint, dst bigint", [], None
    rest = fps.select("fp")
    for level in range(1, LEVELS + 1):
        entered = None
        for path in itertools.product((0, 1), repeat=level - 1):
            below = rest
            for n, chosen in enumerate(path, 1):
                below = below.where(F.col(f"s{n}") == chosen)
            part = _enter(below, keys, parts_of(path), level)
            entered = part if entered is None else entered.unionByName(part)
        names = [f"{c}{level}" for c in "skf"]
        keys = keys + names
        schema += "".join(f", {c} bigint" for c in names)
        bucket = [c for c in keys if c[0] != "f"]
        limit = big if level < LEVELS else None
        met = scratch.write(entered.repartition(*bucket).sortWithinPartitions(*bucket)
                            .mapInArrow(_compare(level, max_bits, limit), schema))
        near = met.where("dst is not null").select("src", "dst")
        found = near if found is None else found.unionByName(near)
        rest = met.where("dst is null").select(F.col("src").alias("fp"), *keys)
        if limit is None or rest.isEmpty():
            break
    return found


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` for every node of ``edges``: root is the component's
    smallest node. Alternating large-star and small-star steps; every round
    is one written table, so no lineage builds up."""
    e = scratch.write(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
                      .where("u != v").distinct())
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(m2, "u").select(F.col("v").alias("a"), F.col("m").alias("v"))
                 .where("a != v").select(F.col("a").alias("u"), "v")
                 .union(m2.select("u", F.col("m").alias("v"))).distinct())
        nxt = scratch.write(small)
        stats = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        e = nxt
        if stats == before:
            break
        before = stats
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                       big: int = BIG_BUCKET) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the
    smallest doc_id reachable over links, per row of ``docs``.

    Defined cases: NULL and empty texts have fingerprint zero and are linked
    like any other; NULL ids keep their rows and never name a component
    (NULL where all ids are); repeated rows stay; a text of any length is
    fingerprinted whole, its bits summed in parts; other columns are ignored;
    an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, shingle))
    distinct = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(distinct, scratch, max_bits, big)
    comp = scratch.write(components(edges, scratch))
    # smallest document of every component that has more than one fingerprint
    member = distinct.join(comp, distinct.fp == comp.node).select("fp", "root", "least")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.write(distinct.join(
        member.join(least, "root").select(F.col("fp").alias("node"), "component_id"),
        F.col("fp") == F.col("node"), "left")
        .select(F.col("fp").alias("f"), F.coalesce("component_id", "least").alias("component_id")))
    return (rows.join(named, rows.fp == named.f, "left")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def one_per_component(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without near duplicates: of every component the row with the
    smallest doc_id, and one row of it; a component whose ids are all NULL
    keeps one of its rows.

    Defined cases: NULL and empty texts have fingerprint zero and form one
    component with whatever is near it; a NULL id loses to any other; of
    repeated rows one stays; texts of any length are fingerprinted whole; other
    columns (whatever their names) pass unchanged; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    uid = free_name("row_uid", docs.columns)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rows = scratch.write(docs.select(*cols, F.monotonically_increasing_id().alias(uid)))
    # components are named by row here, so that NULL and repeated ids are told apart
    groups = simhash_components(rows.select(F.col(uid).alias("doc_id"), "text"), shingle, max_bits).select(
        F.col("doc_id").alias("g_uid"), "component_id")
    named = rows.select(F.col(uid).alias("g_uid"), "doc_id").join(groups, "g_uid")
    best = named.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "g_uid"))["g_uid"].alias(uid))
    return rows.join(best.select(uid), uid, "left_semi").select(*cols)
