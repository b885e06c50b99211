"""Best-fit packing of tokenised documents, certified by lower bounds.

Documents are tokenised, cut into pieces of at most ``CAPACITY`` tokens, and
pieces are dealt by hash into groups of bounded size. Every group is packed
by best-fit decreasing, and dual-feasible functions give a lower bound on the
sequences it needs: a group that meets its bound is certified and final.
Groups with a gap hand the documents of their worst-filled sequences to a
common pool; the pool is dealt anew and packed again, and a new group's
packing replaces the old sequences only if it needs fewer. Exchanges go on
until ``IDLE_ROUNDS`` in a row save no sequence; ``certificate`` reports what is left
between the packing and the lower bound of the whole table. Only (id, length)
rows travel; texts are read and tokenised once.
"""

from __future__ import annotations

import math
import os
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbpipe.llm.common import Scratch, arrow_map, texts

CAPACITY = 2048
END_ID = 0
GROUP_PIECES = 16384     # pieces packed together in one task, on average
IDLE_ROUNDS = 3          # exchanges in a row that may save no sequence
TOKENIZER = "byte_bpe_50k"

PIECE = "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@lru_cache(maxsize=2)
def tokenizer(name: str):
    """``encode(text) -> ids`` for a vocabulary of the public tokenizers.

    Both files hold one vocabulary. The rank file gives the same ids several
    times faster (tests compare them on every code point); texts that name
    the special token go through the ``tokenizers`` library, which reads that
    name as one id.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def encode(text: str) -> list[int]:
        if "<|endoftext|>" not in text:
            return fast.encode_ordinary(text)
        if not slow:
            slow.append(Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: one if they fit, else full
    pieces after a first one that takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece."""
    def run(batch):
        encode = tokenizer(name)
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), texts(batch, "text")):
            ids = np.array([*encode(raw.decode("utf-8", "replace")), END_ID], "<u4")
            for n, (start, length) in enumerate(cut(len(ids), capacity)):
                for k, v in zip(out, (doc_id, n, start, length,
                                      zlib.crc32(ids[start:start + length].tobytes()))):
                    out[k].append(v)
        return out

    return arrow_map(docs.select("doc_id", "text"), run,
                     "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of every item. Items go by falling length into the fullest bin
    with room; ``mask`` has a bit per remaining room that some bin has."""
    bins = np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n_bins = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, n_bins
            n_bins += 1
        bins[i] = b
        room[r - size].append(b)
        mask |= 1 << (r - size)
    return bins


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing of these lengths needs."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity) if len(lengths) else 0


def bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs of ``count[n]`` items of every length n:
    the best of two families of dual-feasible functions (total size after
    rounding, over the capacity)."""
    x = np.arange(capacity + 1)
    best = math.ceil((count * x).sum() / capacity)
    # items over capacity - k count as full, items under k as nothing
    n_from, s_from = np.cumsum(count[::-1])[::-1], np.cumsum((count * x)[::-1])[::-1]
    for k in range(1, capacity // 2 + 1):
        mid = s_from[k] - s_from[capacity - k + 1]
        best = max(best, int(n_from[capacity - k + 1]) + math.ceil(mid / capacity))
    # sizes rounded to multiples of 1 / k, multiples of 1 / (k + 1) kept
    for k in range(1, 33):
        y = (k + 1) * x
        u = np.where(y % capacity == 0, x * k, (y // capacity) * capacity)
        best = max(best, math.ceil(int((count * u).sum()) / (capacity * k)))
    return best


def pack_group(lengths: np.ndarray, old: np.ndarray | None, capacity: int = CAPACITY):
    """(bins, certified, loose): the packing of one group, whether it meets
    its lower bound, and which items to hand on (those of the worst-filled
    bins, four for every bin over the bound). ``old`` are the bins that the
    items come from; they stay if the new packing needs as many or more."""
    bins = best_fit_decreasing(lengths, capacity)
    if old is not None:
        _, kept = np.unique(old, return_inverse=True)
        if kept.max() <= bins.max():
            bins = kept
    gap = int(bins.max()) + 1 - lower_bound(lengths, capacity)
    fill = np.bincount(bins, weights=lengths)
    worst = np.argsort(fill, kind="stable")[:4 * gap]
    return bins, gap == 0, np.isin(bins, worst)


def _offsets(bins: np.ndarray, lengths: np.ndarray, uid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence id, offset): a sequence is named by its smallest piece uid."""
    order = np.lexsort((uid, bins))
    b, n = bins[order], lengths[order]
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    which = np.cumsum(np.r_[True, b[1:] != b[:-1]]) - 1
    at = np.cumsum(n) - n
    seq, off = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
    seq[order] = uid[order][first][which]
    off[order] = at - at[first][which]
    return seq, off


PACKED = f"{PIECE}, sequence_id bigint, offset bigint, loose boolean"


def _pack(df: DataFrame, capacity: int, again: bool) -> DataFrame:
    """Packs every ``grp`` of ``df``."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        old = pdf["sequence_id"].to_numpy() if again else None
        bins, done, loose = pack_group(lengths, old, capacity)
        seq, off = _offsets(bins, lengths, pdf["uid"].to_numpy())
        return pdf.drop(columns=["grp", "sequence_id"], errors="ignore").assign(
            sequence_id=seq, offset=off, loose=loose & (not done))[
            [c.strip().split(" ")[0] for c in PACKED.split(", ")]]

    return df.groupBy("grp").applyInPandas(run, PACKED)


def pack(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER,
         group_pieces: int = GROUP_PIECES, rounds: int | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of
    every piece; sequences have at most ``capacity`` tokens.

    Groups with a gap exchange documents until none is left, one group holds
    them all, or ``IDLE_ROUNDS`` exchanges in a row save no sequence
    (``rounds``: or after so many).

    Defined cases: NULL and empty texts are the one id 0; NULL and repeated
    ids are packed like others, row by row; other columns are ignored; an
    empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cols = [c.strip().split(" ")[0] for c in PIECE.split(", ")]
    every = scratch.write(pieces(docs, capacity, name).select(
        F.monotonically_increasing_id().alias("uid"), *cols[1:]))
    full = every.where(F.col("length") == capacity).select(
        *cols, F.col("uid").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    short = every.where(F.col("length") < capacity)
    n = short.count()
    groups = max(1, math.ceil(n / group_pieces))
    packed = scratch.write(_pack(short.select(
        *cols, F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("grp")), capacity, False))
    done, r, idle = full, 0, 0
    while r != rounds and idle < IDLE_ROUNDS:
        loose = packed.where("loose")
        n_loose, sequences = loose.agg(F.count("uid"), F.count_distinct("sequence_id")).first()
        # alone, a group would only repeat the packing that it has
        if not n_loose or groups == 1:
            break
        done = done.unionByName(packed.where("not loose").drop("loose"))
        groups = max(1, math.ceil(n_loose / group_pieces))
        # whole sequences move, so that old and new packings can be compared
        packed = scratch.write(_pack(loose.select(
            *cols, "sequence_id", F.pmod(F.xxhash64("sequence_id", F.lit(r)), F.lit(groups)).alias("grp")),
            capacity, True))
        r += 1
        idle = idle + 1 if packed.select("sequence_id").distinct().count() >= sequences else 0
    return done.unionByName(packed.drop("loose")).drop("uid")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row ``n_pieces, n_sequences, lower_bound, gap``: a gap of 0 proves
    that no packing of these pieces needs fewer sequences. The bound rests on
    the number of pieces of each length, at most ``capacity`` rows; an empty
    table has zeros."""
    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(capacity + 1, np.int64)
        count[pdf["length"]] = pdf["n"]
        return pd.DataFrame({"n_pieces": [int(count.sum())], "lower_bound": [bound_of_counts(count, capacity)]})

    lengths = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    # a length without pieces: the one group exists for an empty table too
    none = packed.sparkSession.range(1).selectExpr("0L AS length", "0L AS n")
    bounds = lengths.unionByName(none).groupBy(F.lit(0).alias("grp")).applyInPandas(
        lambda pdf: bound(pdf[["length", "n"]].groupby("length", as_index=False).sum()),
        "n_pieces bigint, lower_bound bigint")
    used = packed.select(F.count_distinct("sequence_id")).scalar()
    return bounds.withColumn("n_sequences", used).select(
        "n_pieces", "n_sequences", "lower_bound", (F.col("n_sequences") - F.col("lower_bound")).alias("gap"))
