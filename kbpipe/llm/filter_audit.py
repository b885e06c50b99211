"""Filter interaction audit with count-weighted decision diagrams.

Every document gets a mask of the filters that it fails. The masks' document
counts of a part (at most 32 rows, whatever the part's size) become a decision
diagram: one level per filter, a node per distinct remainder, and the counts
of its documents at every node. The filters' order is changed by swapping two
adjacent levels, which touches the nodes of those levels only; 119 swaps visit
all 120 orders. In each order the path along which all filters pass gives the
steps: what leaves it at a level is removed there, what stays is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbpipe.llm.common import Scratch, arrow_map, texts

FILTERS = "ABCDE"
# Fixed values of the query contract.
MIN_WORDS = 50
MIN_DISTINCT_PCT = 65
MAX_UPPER_PCT = 5
SYMBOLS = b"#$%&*|"

_STEP = 1 << 20         # bytes of a text split into words at once
_UPPER = bytes(range(65, 91))
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\x0b\x0c\r"


def word_counts(raw: bytes, step: int = _STEP) -> tuple[int, int]:
    """(words, distinct words) of a text, split in parts that end at a space."""
    n, seen, at = 0, set(), 0
    while at < len(raw):
        end = at + step
        while end < len(raw) and raw[end] not in _SPACE:
            end += 1
        ws = raw[at:end].split()
        n += len(ws)
        seen.update(ws)
        at = end
    return n, len(seen)


def own_failures(raw: bytes) -> int:
    """Mask of the filters A to D (bit 0 to 3) that a text fails."""
    words, distinct = word_counts(raw)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    points = len(raw.translate(None, _CONTINUATION))
    symbols = len(raw.translate(None, SYMBOLS)) < len(raw)
    return ((words < MIN_WORDS) | (100 * distinct < MIN_DISTINCT_PCT * words) << 1
            | (100 * upper > MAX_UPPER_PCT * points) << 2 | symbols << 3)


class Diagram:
    """Quasi-reduced decision diagram of weighted masks: level ``i`` decides
    filter ``order[i]``, ``low`` follows documents that pass, ``high`` those
    that fail. Equal remainders share a node; ``total`` sums its weights."""

    def __init__(self, weights: dict[int, tuple[int, ...]], filters: str = FILTERS):
        self.order = list(filters)
        self.low: list[int] = []
        self.high: list[int] = []
        self.total: list[tuple[int, ...]] = []
        size = len(next(iter(weights.values()), (0,)))
        ends: dict[tuple[int, ...], int] = {}
        row = []
        for path in range(1 << len(filters)):        # first filter in the highest bit
            mask = sum(1 << i for i in range(len(filters)) if path >> (len(filters) - 1 - i) & 1)
            w = weights.get(mask, (0,) * size)
            if w not in ends:
                ends[w] = self._add(-1, -1, w)
            row.append(ends[w])
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in filters]
        for level in reversed(self.levels):
            row = [self._node(level, row[i], row[i + 1]) for i in range(0, len(row), 2)]
        self.root = row[0]

    def _add(self, low: int, high: int, total: tuple[int, ...]) -> int:
        self.low.append(low)
        self.high.append(high)
        self.total.append(total)
        return len(self.total) - 1

    def _node(self, level: dict[tuple[int, int], int], low: int, high: int) -> int:
        node = level.get((low, high))
        if node is None:
            node = level[low, high] = self._add(low, high, tuple(
                a + b for a, b in zip(self.total[low], self.total[high])))
        return node

    def swap(self, i: int) -> None:
        """Exchange the filters of levels ``i`` and ``i + 1``. Nodes of level
        ``i`` keep their identity and total, so nothing above them changes."""
        below: dict[tuple[int, int], int] = {}
        again: dict[tuple[int, int], int] = {}
        low, high = self.low, self.high
        for node in self.levels[i].values():
            p, f = low[node], high[node]
            low[node], high[node] = (self._node(below, low[p], low[f]),
                                     self._node(below, high[p], high[f]))
            again[low[node], high[node]] = node
        self.levels[i], self.levels[i + 1] = again, below
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]

    def steps(self) -> list[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """(filter, kept, removed) along the path on which all filters pass."""
        out, node = [], self.root
        for name in self.order:
            out.append((name, self.total[self.low[node]], self.total[self.high[node]]))
            node = self.low[node]
        return out


def adjacent_swaps(n: int) -> Iterator[int]:
    """Positions whose swaps, one after the other, visit every order of ``n``
    things once: the largest thing that can moves one place, and all larger
    ones turn round."""
    things, heading = list(range(n)), [-1] * n
    for _ in range(factorial(n) - 1):
        where = {t: i for i, t in enumerate(things)}
        moving = max(t for t in things if 0 <= where[t] + heading[t] < n and things[where[t] + heading[t]] < t)
        i = where[moving]
        j = i + heading[moving]
        things[i], things[j] = things[j], things[i]
        for t in range(moving + 1, n):
            heading[t] = -heading[t]
        yield min(i, j)


def audit_part(weights: dict[int, tuple[int, int, int]]) -> list[dict]:
    """Rows of all orders and steps for a part's (documents, good, toxic) by mask."""
    diagram = Diagram(weights)
    orders = {}
    swaps = [*adjacent_swaps(len(FILTERS)), None]
    for at in swaps:
        orders["".join(diagram.order)] = diagram.steps()
        if at is not None:
            diagram.swap(at)
    failing, unique, shapley = {}, {}, dict.fromkeys(FILTERS, 0)
    for steps in orders.values():
        failing[steps[0][0]] = steps[0][2][0]        # put first, a filter removes all that fail it
        unique[steps[-1][0]] = steps[-1][2][0]       # put last, those that fail nothing else
        for name, _, removed in steps:
            shapley[name] += removed[0]
    return [{"filter_order": order, "step": k, "kept": kept[0], "removed": removed[0],
             "redundant": failing[name] - removed[0], "unique_fails": unique[name],
             "good_lost": removed[1], "toxic_lost": removed[2], "shapley": shapley[name]}
            for order, steps in sorted(orders.items()) for k, (name, kept, removed) in enumerate(steps, 1)]


MASKS = "doc_id bigint, part string, own int, digest binary"
OUT = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
       "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def failure_masks(docs: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id, part, own`` (mask of A to D) and the SHA-256 of every whole text."""
    def run(batch: pa.RecordBatch):
        raws = texts(batch, "text")
        return {"doc_id": batch.column("doc_id"), "part": batch.column("part"),
                "own": [own_failures(t) for t in raws], "digest": [hashlib.sha256(t).digest() for t in raws]}

    return arrow_map(docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                                 "text"), run, MASKS)


def mask_counts(docs: DataFrame, labels: DataFrame, scratch: Scratch, part: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and failure mask."""
    rows = scratch.write(failure_masks(docs, part))
    # one row per repeated text; copies of one text are one row per task before the shuffle
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")) \
        .where("copies > 1").select("digest", "first_id")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias("toxic"))
    repeat = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int")
    known = rows.join(first, "digest", "left").select("doc_id", "part", (F.col("own") + 16 * repeat).alias("mask"))
    return known.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step; see ``OUT``.

    Defined cases: NULL and empty texts have no words (A fails, and E as for
    any equal texts); a NULL id is never larger than another and carries no
    label; rows of one id and text don't fail E for each other; of several
    labels of an id, a 1 counts; NULL labels count as 0; a NULL part is the
    empty string; a very long text is split in parts; other columns are
    ignored; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "filter-audit")
    per_part = scratch.write(mask_counts(docs, labels, scratch, part).groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks")))   # at most 32 entries

    def run(batch: pa.RecordBatch):
        out: dict[str, list] = {c.split(" ")[0]: [] for c in OUT.split(", ")}
        for name, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist()):
            for row in audit_part({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in masks}):
                for c, v in (row | {"part": name}).items():
                    out[c].append(v)
        return out

    return arrow_map(per_part, run, OUT)
