"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are put into one suffix automaton over words. A
training text is streamed through it word by word; the automaton's state and
matching length say how much of an item ends at each word. Where the length
reaches a window (13 words, or a whole shorter item), those words are hit,
and the state names the items. Runs of words unknown to all items are skipped
before the automaton sees them.

Test items are read in blocks of bounded size (one block for any usual
benchmark; an item that exceeds a block is cut into parts that overlap by a
window less one word). Every block's automaton scans all rows in turn; between
two scans rows and hits are written, so one automaton is alive at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbpipe.llm.common import WORD_TABLE, Scratch, arrow_map, free_name, texts, words

WINDOW = 13
COVERAGE_PCT = 5           # contaminated: hits are at least this share of the words
BLOCK_BYTES = 8 << 20      # text of the test items in one automaton


class Automaton:
    """Suffix automaton of several word sequences (as small integers)."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        kept = []
        for item_id, ws in items:
            if ws:
                codes = [self.vocab.setdefault(w, len(self.vocab)) for w in ws]
                last = 0
                for c in codes:
                    last = self._extend(last, c)
                kept.append((item_id, codes))
        # items by the state of each of their windows
        self.found: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        for item_id, codes in kept:
            size = min(window, len(codes))
            for state, length in self._walk(codes):
                if length >= size:
                    at = self._locus(state, size)
                    if size == window:
                        self.found.setdefault(at, set()).add(item_id)
                    else:
                        self.short.setdefault(at, {}).setdefault(size, set()).add(item_id)
        # nearest suffix state (itself included) that ends a short item
        self.ends: list[int] = [-1] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.ends[v] = v if v in self.short else self.ends[self.link[v]]
        sizes = [s for by in self.short.values() for s in by]
        self.least = min([window, *sizes])

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(link)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        clone = len(self.link)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _walk(self, codes: Iterable[int]):
        """(state, matching length) after every word."""
        nxt, link, length = self.next, self.link, self.length
        v, n = 0, 0
        for c in codes:
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
            else:
                n = 0
            yield v, n

    def _locus(self, v: int, size: int) -> int:
        """The state of the last ``size`` words read, on the suffix path of ``v``."""
        while self.length[self.link[v]] >= size:
            v = self.link[v]
        return v

    def hits(self, ws: list[bytes]) -> list[tuple[int, int, tuple[str, ...]]]:
        """(first word, end word, items) of every window occurrence."""
        out: list[tuple[int, int, tuple[str, ...]]] = []
        codes = np.fromiter(map(self.vocab.get, ws, repeat(-1)), np.int64, len(ws))
        known = np.flatnonzero(np.diff(np.r_[False, codes >= 0, False].astype(np.int8)))
        for a, b in known.reshape(-1, 2).tolist():      # stretches of known words
            if b - a < self.least:
                continue
            for at, (v, n) in enumerate(self._walk(codes[a:b].tolist()), a + 1):
                if n >= self.window and v:
                    found = self.found.get(self._locus(v, self.window))
                    if found:
                        out.append((at - self.window, at, tuple(found)))
                s = self.ends[v]
                while s > 0:
                    for size, found in self.short[s].items():
                        if size <= n and size > self.length[self.link[s]]:
                            out.append((at - size, at, tuple(found)))
                    s = self.ends[self.link[s]]
        return out


def _parts(ws: list[bytes], block_bytes: int, window: int) -> Iterator[list[bytes]]:
    """An item's words in parts of about ``block_bytes`` that share ``window -
    1`` words, so that every window lies in one of them."""
    at = 0
    while True:
        end, size = at, 0
        while end < len(ws) and (size < block_bytes or end < at + window):
            size += len(ws[end]) + 1
            end += 1
        yield ws[at:end]
        if end == len(ws):
            return
        at = end - window + 1


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, window: int = WINDOW):
    """Lists of (item id, words) of at most ``block_bytes`` of text; items
    without an id have the empty id."""
    block, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"),
                                F.col("text").cast("binary").alias("t")).distinct().toLocalIterator():
        for part in _parts(words(bytes(row["t"] or b"")), block_bytes, window):
            n = sum(map(len, part)) + len(part)
            if block and size + n > block_bytes:
                yield block
                block, size = [], 0
            block.append((row["i"], part))
            size += n
    if block:
        yield block


def merged(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_AUTOMATA: dict[str, Automaton] = {}     # per worker: automaton of a broadcast block


def _scan(docs: DataFrame, text: str, hit: str, items: str, n_words: str, block, window: int,
          keep_text: bool) -> DataFrame:
    """``docs`` with the block's hits added to columns ``hit`` (word spans as
    a flat list start, end, ...) and ``items`` (item ids), and the number of
    words that the scan split the text into."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    key = uuid.uuid4().hex
    names = docs.columns if keep_text else [c for c in docs.columns if c != text]

    def run(batch: pa.RecordBatch):
        auto = _AUTOMATA.get(key)
        if auto is None:
            _AUTOMATA.clear()
            auto = _AUTOMATA[key] = Automaton(shared.value, window)
        new_hit, new_items, sizes = [], [], []
        for raw, h, it in zip(texts(batch, text), batch.column(hit).to_pylist(), batch.column(items).to_pylist()):
            ws = words(raw)
            found = auto.hits(ws)
            sizes.append(len(ws))
            spans = merged([*zip(h[::2], h[1::2]), *((a, b) for a, b, _ in found)])
            new_hit.append([x for s in spans for x in s])
            new_items.append(sorted({*it, *(i for _, _, ids in found for i in ids)}))
        return {n: batch.column(n) for n in names} | {hit: new_hit, items: new_items, n_words: sizes}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields
                       if f.name in names)
    return arrow_map(docs, run, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       coverage_pct: int = COVERAGE_PCT, block_bytes: int = BLOCK_BYTES,
                       keep_text: bool = True) -> DataFrame:
    """``docs`` plus ``n_words, n_hit, hit_spans`` (flat list of word spans),
    ``hit_items`` (ids as strings, sorted) and ``contaminated``. Without
    ``keep_text`` the last scan doesn't hand the texts back.

    Defined cases: NULL and empty texts have no words and are clean; items
    without words are nowhere; a NULL item id reads as the empty string;
    repeated rows stay; a text of any length is scanned whole, one pass a
    block; columns that clash with a result column keep their
    name and the result column gets underscores appended; an empty benchmark
    leaves everything clean; an empty table gives an empty one.
    """
    name = {k: free_name(k, docs.columns)
            for k in ("n_words", "n_hit", "hit_spans", "hit_items", "contaminated")}
    df = docs.select("*", F.expr("cast(array() as array<bigint>)").alias(name["hit_spans"]),
                     F.expr("cast(array() as array<string>)").alias(name["hit_items"]),
                     F.lit(0).cast("bigint").alias(name["n_words"]))
    scratch = Scratch(docs.sparkSession, "decontam")
    blocks = item_blocks(benchmark, block_bytes, window)
    block, written = next(blocks, []), None      # without items the scan counts words only
    while block is not None:
        following = next(blocks, None)
        df = _scan(df, "text", name["hit_spans"], name["hit_items"], name["n_words"], block, window,
                   keep_text or following is not None)
        if following is not None:
            df = scratch.write(df)
            if written is not None:
                scratch.drop(written)
            written = df
        block = following
    spans = F.col(name["hit_spans"])
    # ends minus starts: odd positions add, even positions subtract
    n_hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)),
                        F.lit(0).cast("bigint"), lambda a, x: a + x)
    df = df.withColumn(name["n_hit"], n_hit)
    return df.withColumn(name["contaminated"], (F.col(name["n_hit"]) > 0) & (
        100 * F.col(name["n_hit"]) >= coverage_pct * F.col(name["n_words"])))


def _original_spans(raw: bytes, spans: list[int]) -> bytes:
    """The text without the words of ``spans`` (and what stands between them)."""
    if not spans:
        return raw
    low = np.frombuffer(raw.translate(WORD_TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[False, low, False].astype(np.int8))).reshape(-1, 2)
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(raw[at:edge[a][0]])
        at = int(edge[b - 1][1])
    return b"".join([*out, raw[at:]])


def removable_words(spans: Column, min_words: int = WINDOW) -> Column:
    """Words that ``remove_spans`` cuts out: those of spans of at least
    ``min_words`` (a flat list start, end, ...)."""
    sizes = F.transform(spans, lambda end, i: F.when(i % 2 == 1, end - F.get(spans, i - 1)).otherwise(0))
    return F.aggregate(F.filter(sizes, lambda n: n >= min_words), F.lit(0).cast("bigint"), lambda a, n: a + n)


def remove_spans(found: DataFrame, spans: str = "hit_spans", min_words: int = WINDOW) -> DataFrame:
    """``found`` (of ``find_contamination``) with the hit spans of at least
    ``min_words`` words cut out of ``text``."""
    names = found.columns

    def run(batch: pa.RecordBatch):
        clean = []
        for raw, null, s in zip(texts(batch, "text"), batch.column("text").is_null().to_pylist(),
                                batch.column(spans).to_pylist()):
            long = [x for a, b in zip(s[::2], s[1::2]) if b - a >= min_words for x in (a, b)]
            clean.append(None if null else _original_spans(raw, long))
        return {n: batch.column(n) for n in names} | {"text": pa.array(clean, pa.binary()).cast(pa.string())}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return arrow_map(found, run, schema)

