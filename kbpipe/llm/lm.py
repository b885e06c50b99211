"""Language-model scores: context-tree weighting over bytes.

Each byte is decomposed into 8 binary decisions; every decision is predicted
in the contexts of 0 to ``DEPTH`` preceding bytes. A context's binary node
counts its bits in the training texts (Krichevsky-Trofimov estimates), and the
context tree's weighting mixes the estimates of all depths: a node's weight is
its own estimate's probability of the data against the product of its
children's weighted probabilities. After training, the weights are fixed and
every (context, byte) has one log-probability.

A text ends with the byte 0xFF, which UTF-8 never uses, and starts in a
context of zero bytes.

The tree is never in one place. Its leaves are the distinct (DEPTH + 1)-byte
sequences of the corpus, and they grow with it. Chunks of documents send each
part of the tree the sequences they hold (distinct, packed, with their training
counts), a part being named by the last ``TOP`` + 1 bytes of context. A part
sums the counts of all chunks, builds its subtrees bottom-up with NumPy and
hands up what the depths 0 to ``TOP`` need: two numbers per seen context and
bit, at most 2^24 whatever the corpus (a proven bound; they are broadcast).
With these the parts answer every chunk with one log-probability per sequence
it holds. Token counts of the unigram base score travel with the first trip.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbpipe.llm.common import Scratch, remainder_of, texts, tokens

END = b"\xff"
FOLDS, HELD_OUT = 7, 2         # fixed by the query contract
DEPTH = 6                      # longest context in bytes: DEPTH + 1 bytes fit a 64-bit number
TOP = 2                        # depths 0 to TOP are mixed from all parts
CHUNK_BYTES = 8 << 20          # texts that ask for their sequences together
_STEP = 1 << 20                # bytes of a text coded at once
_SHIFT = 8 * (DEPTH - TOP)     # code >> _SHIFT: the last TOP bytes of context


def codes(raw: bytes, step: int = _STEP) -> Iterator[np.ndarray]:
    """Every byte and the end with the ``DEPTH`` bytes before, the nearest
    first and the byte itself last, as 56-bit numbers; in bounded parts."""
    padded = np.frombuffer(b"\0" * DEPTH + raw + END, np.uint8)
    for at in range(0, len(padded) - DEPTH, step):
        b = padded[at:at + step + DEPTH].astype(np.int64)
        n = len(b) - DEPTH
        code = np.zeros(n, np.int64)
        for back in range(1, DEPTH + 1):
            code = (code << 8) | b[DEPTH - back:DEPTH - back + n]
        yield (code << 8) | b[DEPTH:]


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) for x > 0: Stirling's series after moving x up by 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    inv = 1 / y
    series = inv / 12 - inv ** 3 / 360 + inv ** 5 / 1260 - inv ** 7 / 1680
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


_SMALL = 1 << 12         # counts below it have their values in a table
_HALF, _WHOLE = (_log_gamma(np.arange(_SMALL) + add) for add in (0.5, 1.0))


def _looked_up(table: np.ndarray, add: float, n: np.ndarray) -> np.ndarray:
    """ln gamma(n + add) for counts ``n``."""
    out = table[np.minimum(n, _SMALL - 1)]
    large = np.flatnonzero(n >= _SMALL)
    out[large] = _log_gamma(n[large] + add)
    return out


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the KT probability of a sequence with these counts."""
    z, o = zeros.astype(np.int64), ones.astype(np.int64)
    return _looked_up(_HALF, 0.5, z) + _looked_up(_HALF, 0.5, o) - _looked_up(_WHOLE, 1.0, z + o) - np.log(np.pi)


def _rate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Probability of a one."""
    return (ones + 0.5) / (zeros + ones + 1.0)


def _mix(log_kt: np.ndarray, log_children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share of a node's own estimate, ln of its weighted probability)."""
    own = 1 / (1 + np.exp(np.clip(log_children - log_kt, -700, 700)))
    return own, np.logaddexp(log_kt, log_children) - np.log(2)


def _nodes(keys: np.ndarray, counts: np.ndarray, bit: int):
    """Binary nodes before decision ``bit`` of sorted (context, byte) keys:
    (node of every key, node keys, zeros, ones)."""
    name = keys >> (8 - bit)
    new = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    of = np.cumsum(np.r_[False, name[1:] != name[:-1]])
    ones = np.add.reduceat(np.where((keys >> (7 - bit)) & 1, counts, 0), new)
    return of, name[new], np.add.reduceat(counts, new) - ones, ones


class Subtrees:
    """Contexts deeper than ``TOP`` of one part, from its sorted distinct
    codes and their training counts. ``rates[bit]`` is every code's probability
    of a one, mixed over those depths; ``handed[bit]`` what the context of
    ``TOP`` bytes above needs: (node keys, zeros, ones, ln of the children's
    weighted probabilities)."""

    def __init__(self, code: np.ndarray, count: np.ndarray):
        self.code = code
        self.rates: list = [None] * 8
        below: list = [None] * 8        # (node, first key of the node) -> sums for the depth above
        keys, counts, place = code, count.astype(np.int64), np.arange(len(code))
        for depth in range(DEPTH, TOP, -1):
            if depth < DEPTH:
                # drop the oldest byte: (context, byte) keys one byte shorter
                keys, up = np.unique(((keys >> 16) << 8) | (keys & 255), return_inverse=True)
                counts = np.bincount(up, weights=counts, minlength=len(keys)).astype(np.int64)
                place = up[place]
            for bit in range(8):
                of, _, zeros, ones = _nodes(keys, counts, bit)
                log_kt, rate = _log_kt(zeros, ones), _rate(zeros, ones)
                if depth == DEPTH:
                    self.rates[bit], weighted = rate[of], log_kt
                else:
                    first, log_child = below[bit]
                    own, weighted = _mix(log_kt, np.bincount(of[up[first]], weights=log_child, minlength=len(rate)))
                    node = of[place]
                    self.rates[bit] = own[node] * rate[node] + (1 - own[node]) * self.rates[bit]
                below[bit] = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), weighted
        self.keys, self.place = np.unique(((keys >> 16) << 8) | (keys & 255), return_inverse=True)
        counts = np.bincount(self.place, weights=counts, minlength=len(self.keys)).astype(np.int64)
        self.handed = []
        for bit in range(8):
            of, name, zeros, ones = _nodes(self.keys, counts, bit)
            first, log_child = below[bit]
            self.handed.append((name, zeros, ones, np.bincount(
                of[self.place[first]], weights=log_child, minlength=len(name))))
        self.place = self.place[place]

    def log10(self, top: Top) -> np.ndarray:
        """log10 P(byte | context) of every code."""
        out = np.zeros(len(self.code))
        for bit in range(8):
            name = self.keys >> (8 - bit)
            base, share = top.mixture(bit, name)
            p = base[self.place] + share[self.place] * self.rates[bit]
            out += np.log10(np.where((self.code >> (7 - bit)) & 1, p, 1 - p))
        return out


def _numbered(bit: int, name: np.ndarray) -> np.ndarray:
    """Node keys of decision ``bit`` (context and ``bit`` bits) as context *
    256 + number of the node among the 255 of a byte."""
    return ((name >> bit) << 8) | (1 << bit) | (name & ((1 << bit) - 1))


class Top:
    """Depths 0 to 2 of the tree, from the sums of all parts. ``nodes`` are
    sorted (context of two bytes * 256 + node) numbers."""

    def __init__(self, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log_children: np.ndarray):
        order = np.argsort(nodes)
        self.nodes = nodes[order].astype(np.int64)
        zeros, ones, log_children = (x[order].astype(np.float64) for x in (zeros, ones, log_children))
        self.own, self.rate = [], []
        at = self.nodes
        for depth in (2, 1, 0):
            own, weighted = _mix(_log_kt(zeros, ones), log_children)
            rate = _rate(zeros, ones)
            if depth < 2:      # dense below: 256 contexts of one byte, then one
                full_own, full_rate = np.full(256 << (8 * depth), 0.5), np.full(256 << (8 * depth), 0.5)
                full_own[at], full_rate[at] = own, rate
                own, rate = full_own, full_rate
            # doubles: a rate of single precision is 1 after 2^24 equal bits, and
            # the other bit then had probability zero or less
            self.own.insert(0, own)
            self.rate.insert(0, rate)
            if depth:
                # the nearest byte is the highest: contexts lose their lowest byte
                above = ((at >> 16) << 8) | (at & 255)
                at, where = np.unique(above, return_inverse=True)
                zeros, ones, log_children = (np.bincount(where, weights=x, minlength=len(at))
                                             for x in (zeros, ones, weighted))

    def mixture(self, bit: int, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(base, share): a node's probability of a one is ``base + share *
        (that of the deeper contexts)``. A node never seen predicts one half."""
        number = _numbered(bit, name)
        at = np.minimum(np.searchsorted(self.nodes, number), max(0, len(self.nodes) - 1))
        seen = self.nodes[at] == number if len(self.nodes) else np.zeros(len(number), bool)
        base, share = np.zeros(len(number)), np.ones(len(number))
        for depth, where in ((0, number & 255), (1, ((number >> 16) << 8) | (number & 255)), (2, None)):
            if where is None:
                own, rate = (np.where(seen, x[at] if len(x) else 0.5, 0.5) for x in (self.own[2], self.rate[2]))
            else:
                own, rate = self.own[depth][where], self.rate[depth][where]
            base, share = base + share * own * rate, share * (1 - own)
        return base, share


# -- packing ----------------------------------------------------------------------

def _shrunk(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _grown(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], n, codec="zstd", asbytes=True) if n else b""


def pack(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed (sorted ones as differences)."""
    return _shrunk(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpack(blob: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(_grown(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.int64))


def part_of(code: np.ndarray, parts: int) -> np.ndarray:
    """Part of the tree of every code. Contexts with the last two bytes in
    common lie in few parts (a hash of them, moved on by the third byte)."""
    two, third = code >> _SHIFT >> 8, (code >> (_SHIFT - 8) >> 8) & 255
    spread = max(1, min(64, parts // 16))
    return ((two * 0x9E3779B1 >> 12) + third % spread) % parts


# -- chunks -------------------------------------------------------------------------

class _Grams:
    """Sorted distinct codes and their counts, merged whenever ``4 * _STEP``
    entries have gathered."""

    def __init__(self):
        self.code, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: tuple[list, list] = [], []        # not counted, counted
        self.size = 0

    def add(self, raw: bytes, counted: bool) -> None:
        for c in codes(raw):
            self.waiting[counted].append(c)
            self.size += len(c)
            if self.size >= 4 * _STEP:
                self.merge()

    def merge(self) -> _Grams:
        for counted, parts in enumerate(self.waiting):
            if parts:
                u, times = np.unique(np.concatenate(parts), return_counts=True)
                parts.clear()
                self.code, self.count = summed([self.code, u], [self.count, times * counted])
        self.size = 0
        return self


def summed(code: list[np.ndarray], count: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes of several arrays, and the sums of their counts."""
    c, n = np.concatenate(code), np.concatenate(count)
    order = np.argsort(c, kind="stable")        # merges runs that are sorted already
    c, n = c[order], n[order]
    new = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
    return c[new], np.add.reduceat(n, new) if len(c) else n


class _Chunk:
    """Documents of one chunk, and what they ask of each part."""

    def __init__(self):
        self.ids, self.held, self.texts, self.size = [], [], [], 0
        self.train: Counter[bytes] = Counter()
        self.other: Counter[bytes] = Counter()      # tokens of held-out documents
        self.grams = _Grams()

    def add(self, doc_id, held: bool, raw: bytes) -> None:
        self.ids.append(doc_id)
        self.held.append(held)
        self.texts.append(raw)
        self.size += len(raw)
        (self.other if held else self.train).update(tokens(raw))
        self.grams.add(raw, not held)

    def vocab(self) -> list[bytes]:
        return [*self.train, *(t for t in self.other if t not in self.train)]

    def rows(self, chunk: int, parts: int) -> list[dict]:
        g = self.grams.merge()
        part = part_of(g.code, parts)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        vocab = self.vocab()
        of_token, names = token_parts(vocab, parts), np.array([*vocab, None], object)
        train = np.array([self.train.get(t, 0) for t in vocab], np.int64)
        out = [{"chunk": chunk, "ids": self.ids, "held": self.held,
                "sizes": [len(t) for t in self.texts], "texts": _shrunk(b"".join(self.texts))}]
        for p in range(parts):
            mine, toks = order[cuts[p]:cuts[p + 1]], np.flatnonzero(of_token == p)
            if len(mine) or len(toks):
                out.append({"chunk": chunk, "part": p, "codes": pack_sorted(g.code[mine]), "counts": pack(g.count[mine]),
                            "tokens": _shrunk(b" ".join(names[toks].tolist())), "train": pack(train[toks])})
        return out


def token_parts(vocab, parts: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(t) % parts for t in vocab), np.int64, len(vocab))


CHUNK = ("chunk bigint, ids array<bigint>, held array<boolean>, sizes array<bigint>, texts binary, "
         "part int, codes binary, counts binary, tokens binary, train binary")


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(ddl))


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def chunks(docs: DataFrame, parts: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per chunk of documents one row with them and one for each part asked."""
    from pyspark import TaskContext
    schema = _schema(CHUNK)
    held = F.coalesce(remainder_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk()
        for batch in batches:
            for doc_id, h, raw in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(),
                                      texts(batch, "text")):
                if chunk.ids and chunk.size + len(raw) > chunk_bytes:
                    yield _batch(chunk.rows(number, parts), schema)
                    chunk, number = _Chunk(), number + 1
                    pa.default_memory_pool().release_unused()
                chunk.add(doc_id, h, raw)
        if chunk.ids:
            yield _batch(chunk.rows(number, parts), schema)

    return docs.select("doc_id", held.alias("held"), "text").mapInArrow(run, CHUNK)


# -- parts ---------------------------------------------------------------------------

HANDED = ("chunk bigint, part int, known binary, node array<bigint>, zeros array<bigint>, ones array<bigint>, "
          "log_children array<double>, n_tokens bigint, n_vocab bigint")


def _asked(table: pa.Table) -> tuple[list[int], list[np.ndarray]]:
    return table["chunk"].to_pylist(), [unpack_sorted(b) for b in table["codes"].to_pylist()]


def _subtrees(table: pa.Table, asked: list[np.ndarray]) -> Subtrees | None:
    code, count = summed(asked, [unpack(b, np.int64) for b in table["counts"].to_pylist()])
    return Subtrees(code, count) if len(code) else None


def _hand_up(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """A part's answers on tokens, one row per chunk, and one row of sums."""
    part = table["part"][0].as_py()
    chunk, asked = _asked(table)
    vocab: dict[bytes, int] = {}
    total: list[int] = []
    at_of = []
    for blob, n in zip(table["tokens"].to_pylist(), table["train"].to_pylist()):
        at = []
        for t, k in zip(_grown(blob).split(), unpack(n, np.int64).tolist()):
            i = vocab.setdefault(t, len(total))
            if i == len(total):
                total.append(0)
            total[i] += k
            at.append(i)
        at_of.append(np.array(at, np.int64))
    known = np.array(total, np.int64)
    rows = [{"chunk": c, "part": part, "known": pack(known[at])} for c, at in zip(chunk, at_of)]
    tree = _subtrees(table, asked)
    row = {"part": part, "n_tokens": int(known.sum()), "n_vocab": int((known > 0).sum())}
    if tree:
        handed = [(_numbered(bit, name), z, o, lw) for bit, (name, z, o, lw) in enumerate(tree.handed)]
        row |= {k: np.concatenate(x) for k, x in zip(("node", "zeros", "ones", "log_children"), zip(*handed))}
    return pa.Table.from_batches([_batch([*rows, row], schema)])


def _part_sums(schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        return _hand_up(table, schema)
    return run


ANSWER = "chunk bigint, part int, logs binary"


def _answer(top, schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        chunk, asked = _asked(table)
        tree = _subtrees(table, asked)
        logs = tree.log10(top.value).astype(np.float32) if tree else np.zeros(0, np.float32)
        rows = [{"chunk": c, "part": part, "logs": pack(logs[np.searchsorted(tree.code, a)] if len(a) else logs[:0])}
                for c, a in zip(chunk, asked)]
        return pa.Table.from_batches([_batch(rows, schema)])
    return run


def top_of(handed: DataFrame) -> Top:
    """Depths 0 to 2 from the parts' sums (at most 2^24 rows)."""
    sums = (handed.where("chunk is null").select(F.inline(F.arrays_zip("node", "zeros", "ones", "log_children")))
            .groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "log_children")]).toArrow())
    return Top(*(sums[c].to_numpy() for c in ("node", "zeros", "ones", "log_children")))


# -- scores -----------------------------------------------------------------------------

OUT = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
       "base_score double, score double, bits_per_byte double")


def _log_sums(raws: list[bytes], known: np.ndarray, logs: np.ndarray) -> list[float]:
    """Sum of the log-probabilities of every text; ``known`` are the chunk's
    sorted codes, ``logs`` theirs."""
    out = np.zeros(len(raws))
    waiting: list[np.ndarray] = []      # codes above 8 bits that say whose they are
    owner: list[int] = []
    size = 0

    def flush():
        nonlocal size
        if waiting:
            both = np.sort(np.concatenate(waiting))
            code = (both >> np.uint64(8)).astype(np.int64)
            new = np.r_[True, code[1:] != code[:-1]]
            value = logs[np.searchsorted(known, code[new])][np.cumsum(new) - 1]
            sums = np.bincount((both & np.uint64(255)).astype(np.int64), weights=value, minlength=len(owner))
            np.add.at(out, owner, sums)
            waiting.clear()
            owner.clear()
            size = 0

    for i, raw in enumerate(raws):
        for c in codes(raw):
            waiting.append((c.astype(np.uint64) << np.uint64(8)) | np.uint64(len(owner)))
            owner.append(i)
            size += len(c)
            if size >= _STEP or len(owner) == 256:
                flush()
    flush()
    return out.tolist()


def _score(n_train: int, n_all: int, n_vocab: int, parts: int):
    columns = [f.split(" ")[0] for f in OUT.split(", ")]
    schema = _schema(OUT)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        row = docs.to_pylist()[0]
        raw, at, raws = _grown(row["texts"]), 0, []
        for n in row["sizes"]:
            raws.append(raw[at:at + n])
            at += n
        again = _Chunk()        # the same documents: the same tokens and codes in the same order
        for doc_id, h, t in zip(row["ids"], row["held"], raws):
            again.add(doc_id, h, t)
        code, vocab = again.grams.merge().code, {t: i for i, t in enumerate(again.vocab())}
        known, logs = np.zeros(len(vocab), np.int64), np.zeros(len(code), np.float64)
        of_token, of_code = token_parts(vocab, parts), part_of(code, parts)
        by_token, by_code = (np.argsort(x, kind="stable") for x in (of_token, of_code))
        token_cut, code_cut = (np.searchsorted(x[o], np.arange(parts + 1))
                               for x, o in ((of_token, by_token), (of_code, by_code)))
        for a in answers.to_pylist():
            p = a["part"]
            if a["known"] is not None:
                known[by_token[token_cut[p]:token_cut[p + 1]]] = unpack(a["known"], np.int64)
            if a["logs"] is not None:
                logs[by_code[code_cut[p]:code_cut[p + 1]]] = unpack(a["logs"], np.float32)
        unit = np.log10((known + 1) / (n_all + n_vocab + 1))
        end = math.log10((n_train + 1) / (n_all + n_vocab + 1))
        out: dict[str, list] = {k: [] for k in columns}
        for doc_id, h, t, score in zip(row["ids"], row["held"], raws, _log_sums(raws, code, logs)):
            ws = tokens(t)
            at = np.fromiter(map(vocab.__getitem__, ws), np.int64, len(ws))
            for k, v in zip(columns, (doc_id, h, len(ws) + 1, int((known[at] > 0).sum()) + (n_train > 0), n_all,
                                      float(unit[at].sum() + end), score,
                                      -score / math.log10(2) / (len(t) + 1))):
                out[k].append(v)
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def score_texts(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, parts: int | None = None) -> DataFrame:
    """Scores per row: token counts, the unigram ``base_score``, ``score``
    (log10 probability of the text and its end under the context-tree model)
    and ``bits_per_byte`` (code length over bytes and end).

    ``parts`` of the tree: the session's shuffle partitions, unless given. A
    part holds the distinct sequences of its contexts in memory, so size them
    as for any shuffle.

    Defined cases: NULL and empty texts have one token, the end; a NULL id is
    not held out; repeated rows stay and count each; a very long text is a
    chunk of its own, coded in steps; ties don't arise; other columns are
    ignored; without training rows every count is 0 and every bit has
    probability one half; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.write(chunks(docs, parts, chunk_bytes))
    asks = rows.where("part is not null").select("chunk", "part", "codes", "counts", "tokens", "train")
    handed = scratch.write(asks.groupBy("part").applyInArrow(_part_sums(_schema(HANDED)), HANDED))
    n_words, n_distinct = handed.where("chunk is null").agg(
        F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_vocab"), F.lit(0))).first()
    n_train = rows.where("part is null").agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()[0]
    top = spark.sparkContext.broadcast(top_of(handed))
    answers = asks.drop("tokens", "train").groupBy("part").applyInArrow(_answer(top, _schema(ANSWER)), ANSWER)
    none = F.lit(None).cast("binary")
    both = answers.withColumn("known", none).unionByName(
        handed.where("chunk is not null").select("chunk", "part", "known", none.alias("logs")))
    return (rows.where("part is null").select("chunk", "ids", "held", "sizes", "texts").groupBy("chunk")
            .cogroup(both.groupBy("chunk")).applyInArrow(_score(n_train, n_words + n_train, n_distinct + (n_train > 0), parts), OUT))
