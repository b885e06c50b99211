"""Conversation prefix trie: double-array tries per shard, merged where shared.

Turns become 16-byte digests, conversations sequences of digests. Distinct
sequences are dealt out by range, so a shard holds neighbours: sequences that
share long prefixes. A task cuts its sorted stream into shards of bounded
size, numbers a shard's turns densely and packs its trie into the arrays BASE
and CHECK: the child of node ``s`` under turn ``c`` is ``t = BASE[s] + c`` if
``CHECK[t] = s``. Traversing the arrays gives the nodes and their sums.

A node can occur in two shards only if it lies on the path of a shard's first
or last sequence (its spines). These nodes are merged by a chained digest of
their prefix; sums over subtrees are corrected for the nodes that several
shards counted, all others are final as they leave their shard.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbpipe.llm.common import Scratch, arrow_map, texts

# Fixed values of the query contract.
GROUP = 20          # a conversation starts like the first one of its group
HEADS = 4           # ... for crc32(conv_id) mod 4 turns

DIGEST = 16
SHARD_TURNS = 1 << 18       # turns packed into one trie, and about what a task gets of a large table
ID_BLOCK = 4096             # conv_ids that are joined to one string first
NO_IDS = hashlib.sha256(b"").hexdigest()


def _turn_digest(role: bytes, text: bytes) -> bytes:
    return hashlib.blake2b(len(role).to_bytes(8, "little") + role + text, digest_size=DIGEST).digest()


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, words`` of every turn with a conv_id."""
    def run(batch: pa.RecordBatch):
        raws = texts(batch, "text")
        return {"conv_id": batch.column("conv_id"), "turn": batch.column("turn"),
                "digest": [_turn_digest(r, t) for r, t in zip(texts(batch, "role"), raws)],
                "words": [len(t.split()) for t in raws]}

    return arrow_map(conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text"), run,
                     "conv_id bigint, turn bigint, digest binary, words bigint")


def rebuilt(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, seq`` (array of (digest, words)): the first turns of the
    group's first conversation, then the own ones."""
    own = scratch.write(turns(conversations).groupBy("conv_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("has_turn"), "turn", "digest", "words"))),
        lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns")))
    first = own.where(F.col("conv_id") % GROUP == 0).select(
        F.col("conv_id").alias("first_id"), F.slice("turns", 1, HEADS - 1).alias("head"))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    none = F.expr("cast(array() as array<struct<digest: binary, words: bigint>>)")
    both = own.withColumns({"n": n, "first_id": F.col("conv_id") - F.col("conv_id") % GROUP}).join(first, "first_id", "left")
    return both.select("conv_id", F.concat(
        F.slice(F.coalesce("head", none), F.lit(1), F.col("n")),
        F.slice("turns", F.col("n") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("seq"))


def ends_hashes(members: DataFrame, key: str) -> DataFrame:
    """``key, ends``: SHA-256 of the key's conv_ids in ascending order,
    comma-joined. Ids are joined in blocks first and a task hashes the blocks
    of a key as they come, so a key with a third of all ids is neither one row
    nor held whole."""
    blocks = members.groupBy(key, F.floor(F.col("conv_id") / ID_BLOCK).alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ordered = blocks.repartition(key).sortWithinPartitions(key, "block").select(key, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            keys, ends = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k == now:
                    sha.update(b"," + ids.encode())
                    continue
                if sha is not None:
                    keys.append(now)
                    ends.append(sha.hexdigest())
                now, sha = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], names=[key, "ends"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()], pa.string())],
                                             names=[key, "ends"])

    return ordered.mapInArrow(run, f"{key} binary, ends string")


class DoubleArray:
    """Trie over sequences of small integers: arrays BASE and CHECK.

    ``sequences`` are rows of a flat array with ``starts``; node 0 is the root
    and no child is ever put there. Built breadth first, so that the children
    of a node get their places together."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, alphabet: int):
        self.base = np.zeros(16, np.int64)
        self.check = np.full(16, -1, np.int64)
        self.check[0] = 0                      # taken
        self._free = 1                         # no free place before it
        self._tries = 0
        length = np.diff(starts)
        live, state, depth = np.arange(len(length)), np.zeros(len(length), np.int64), 0
        while True:
            go = length[live] > depth
            live, state = live[go], state[go]
            if not len(live):
                break
            code = flat[starts[live] + depth]
            edge, back = np.unique(state * alphabet + code, return_inverse=True)
            node, under = edge // alphabet, edge % alphabet
            cuts = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True]).tolist()
            for a, b in zip(cuts, cuts[1:]):
                self._place(int(node[a]), under[a:b])
            state = self.base[state] + code
            depth += 1

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.r_[self.base, np.zeros(more, np.int64)]
            self.check = np.r_[self.check, np.full(more, -1, np.int64)]

    def _place(self, node: int, codes: np.ndarray) -> None:
        """Puts the children of ``node`` (ascending ``codes``) into free
        places: the first that fits from the first free one on, which moves up
        when the places after it are too crowded to be worth trying."""
        check = self.check
        while self._free < len(check) and check[self._free] >= 0:
            self._free += 1
        at, gaps, tried = self._free, codes - codes[0], 0
        span = int(gaps[-1]) + 1
        while True:
            if at + span > len(self.check):
                self._grow(at + span)
                check = self.check
            if check[at] < 0 and (len(codes) == 1 or (check[at + gaps] < 0).all()):
                break
            at += 1
            tried += 1
        if tried > 64:
            self._free = max(self._free, at - 64)
        self.base[node] = at - int(codes[0])
        check[at + gaps] = node

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Children of ``state`` under ``code``; -1 where there is none."""
        to = self.base[state] + code
        inside = (to > 0) & (to < len(self.check))
        ok = inside & (self.check[np.where(inside, to, 0)] == state) & (to != 0)
        return np.where(ok, to, -1)


class _Shard:
    """Distinct sequences of one trie with their numbers of conversations,
    smallest conversation and hash of their conversations."""

    def __init__(self):
        self.seqs, self.words, self.n, self.least, self.ends = [], [], [], [], []
        self.size = 0

    def add(self, digests: bytes, words: list[int], n: int, least: int, ends: str) -> None:
        for to, v in ((self.seqs, digests), (self.words, words), (self.n, n), (self.least, least), (self.ends, ends)):
            to.append(v)
        self.size += len(words) + 1

    def nodes(self, number: int) -> dict[str, list]:
        """Rows of the shard, see ``NODES``."""
        flat = np.frombuffer(b"".join(self.seqs), f"S{DIGEST}") if any(self.seqs) else np.zeros(0, f"S{DIGEST}")
        # dense turn ids by first appearance: children of a node lie close together
        _, first, code = np.unique(flat, return_index=True, return_inverse=True)
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        code = rank[code]
        length = np.array([len(w) for w in self.words], np.int64)
        starts = np.r_[0, np.cumsum(length)]
        trie = DoubleArray(code, starts, max(1, len(first)))
        all_words = np.array([w for ws in self.words for w in ws], np.int64)
        size = len(trie.check)
        n_convs, depth, words = (np.zeros(size, np.int64) for _ in range(3))
        least = np.full(size, np.iinfo(np.int64).max)
        weight, small = np.array(self.n, np.int64), np.array(self.least, np.int64)
        n_convs[0], least[0] = weight.sum(), small.min()
        # traverse: all sequences step together, level by level
        live, state, by_depth = np.arange(len(length)), np.zeros(len(length), np.int64), [np.zeros(1, np.int64)]
        end_state, d = np.zeros(len(length), np.int64), 0
        while True:
            go = length[live] > d
            live, state = live[go], state[go]
            if not len(live):
                break
            at = starts[live] + d
            state = trie.step(state, code[at])
            d += 1
            np.add.at(n_convs, state, weight[live])
            np.minimum.at(least, state, small[live])
            words[state], depth[state], end_state[live] = all_words[at], d, state
            by_depth.append(np.unique(state))
        n_children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for level in reversed(by_depth):
            leaves[level[n_children[level] == 0]] = 1
            saved[level] += (n_convs[level] - 1) * words[level]
            if level[0] or len(level) > 1:
                up = trie.check[level]
                np.add.at(n_children, up, 1)
                np.add.at(leaves, up, leaves[level])
                np.add.at(saved, up, saved[level])
        ends = dict(zip(end_state.tolist(), self.ends))
        # spines: the paths of the first and the last sequence
        key: dict[int, bytes] = {}
        paths = []
        for i in dict.fromkeys((0, len(self.seqs) - 1)):
            s, k, path = 0, b"\0" * DIGEST, [b"\0" * DIGEST]
            key[0] = k
            for j in range(int(length[i])):
                s = int(trie.step(np.array([s]), code[starts[i] + j:starts[i] + j + 1])[0])
                k = hashlib.blake2b(k + self.seqs[i][j * DIGEST:(j + 1) * DIGEST], digest_size=DIGEST).digest()
                key[s] = k
                path.append(k)
            paths.append(path)
        at = np.concatenate(by_depth)
        up = np.where(at > 0, trie.check[at], 0)
        inner = at.tolist()
        out = {
            "shard": [number] * len(at), "conv_id": least[at].tolist(), "depth": depth[at].tolist(),
            "parent_conv_id": [p if s else None for s, p in zip(inner, least[up].tolist())],
            "n_convs": n_convs[at].tolist(), "n_children": n_children[at].tolist(), "n_leaves": leaves[at].tolist(),
            "saved_tokens": saved[at].tolist(), "words": words[at].tolist(),
            "ends": [ends.get(s) for s in inner], "key": [key.get(s) for s in inner],
            "parent_key": [key.get(p) if s else None for s, p in zip(inner, up.tolist())],
            "path": [None] * len(at)}
        for path in paths:
            for c in out:
                out[c].append({"shard": number, "path": path, "key": path[-1]}.get(c))
        return out


NODES = ("shard bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
         "n_leaves bigint, saved_tokens bigint, words bigint, ends string, key binary, parent_key binary, "
         "path array<binary>")


def shard_nodes(sequences: DataFrame, shard_turns: int) -> DataFrame:
    """Nodes of all shards of sorted ``digests, words, n, least, ends``. Nodes
    of spines have a ``key``; rows with a ``path`` are the spines themselves."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    schema = to_arrow_schema(_parse_datatype_string(NODES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, _Shard()

        def done():
            rows = shard.nodes(number)
            whole = pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
            for at in range(0, whole.num_rows, 1 << 16):
                yield whole.slice(at, 1 << 16)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("digests", "words", "n", "least", "ends"))):
                if shard.seqs and shard.size + len(row[1]) > shard_turns:
                    yield from done()
                    number, shard = number + 1, _Shard()
                shard.add(*row)
        if shard.seqs:
            yield from done()

    return sequences.mapInArrow(run, NODES)


def merged_spines(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes of all spines, one row per prefix, with the sums of their shards
    and corrections for what several shards counted: ``key, conv_id, depth,
    n_convs, n_children, n_leaves, saved_tokens, ends, parent_key``."""
    parts = nodes.where("path is null and key is not null")
    sums = scratch.write(parts.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_shards"), F.count_if(F.col("n_children") == 0).alias("n_ends"),
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("words").alias("words"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends").alias("ends"), F.max("parent_key").alias("parent_key"), F.min("shard").alias("shard")))
    again = sums.where("n_shards > 1")
    # a shared node is childless in one shard at most, and not a leaf then:
    # the other sequences that reach it go on
    found = again.select(
        "key", "parent_key", "shard", "depth", (F.col("n_shards") - 1).alias("more"), "n_ends",
        ((F.col("n_shards") - 1) * F.col("words")).alias("more_saved"))
    paths = nodes.where("path is not null").select("shard", "path")
    # every shared node, once per node above it (and for itself)
    lies = F.array_contains("path", F.col("key"))
    above = (found.join(paths, "shard").where(lies)
             .groupBy("key", "n_ends", "more_saved", "depth").agg(F.min("path").alias("path"))
             .select("n_ends", "more_saved", F.explode(F.slice("path", F.lit(1), (F.col("depth") + 1).cast("int"))).alias("key"))
             .groupBy("key").agg(F.sum("n_ends").alias("less_leaves"), F.sum("more_saved").alias("more_saved")))
    fewer = found.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(
        F.sum("more").alias("less_children"))
    zero = F.lit(0).cast("bigint")
    return scratch.write(
        sums.join(above, "key", "left").join(fewer, "key", "left").select(
            "key", "parent_key", "conv_id", "depth", "n_convs",
            (F.col("n_children") - F.coalesce("less_children", zero)).alias("n_children"),
            (F.col("n_leaves") - F.coalesce("less_leaves", zero)).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_saved", zero)).alias("saved_tokens"), "ends"))


OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, tasks: int | None = None) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, see ``OUT``.

    Defined cases: a NULL role or text is empty, a NULL turn comes first; turns
    with one number are ordered by a digest of role and text; repeated rows are
    turns of their own; a conversation without a turn left is a member of the
    root; rows without a conv_id belong to no conversation; texts of any
    length are hashed and counted whole; other columns are ignored; an empty
    table has no node. A conversation's digests (16 bytes a turn) travel as
    one row.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    convs = scratch.write(rebuilt(conversations, scratch).select(
        "conv_id", F.col("seq.digest").alias("digests"), F.col("seq.words").alias("words"))
        .withColumn("key", F.unhex(F.sha2(F.array_join(F.transform("digests", F.hex), "").cast("binary"), 256))))
    ends = ends_hashes(convs.select("key", "conv_id"), "key")
    distinct = convs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"),
                                        F.first("digests").alias("digests"), F.first("words").alias("words"))
    seqs = scratch.write(distinct.join(ends, "key").select(
        F.unhex(F.array_join(F.transform("digests", F.hex), "")).alias("digests"), "words", "n", "least", "ends"))
    total = seqs.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()[0]
    parts = tasks or max(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                         math.ceil(total / shard_turns))
    nodes = scratch.write(shard_nodes(
        seqs.repartitionByRange(parts, "digests").sortWithinPartitions("digests"), shard_turns))
    spines = merged_spines(nodes, scratch)
    parent = spines.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    single = nodes.where("path is null and key is null")

    def rows(df: DataFrame, above: Column) -> DataFrame:
        return df.select("conv_id", "depth", above.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                         "saved_tokens", F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"))

    return (rows(single.where("parent_key is null"), F.col("parent_conv_id"))
            .unionByName(rows(single.where("parent_key is not null").drop("parent_conv_id").join(parent, "parent_key"),
                              F.col("above")))
            .unionByName(rows(spines.join(parent, "parent_key", "left"), F.col("above"))))
