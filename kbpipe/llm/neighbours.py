"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A whole text becomes the square-rooted counts of hashed byte n-grams and of
words that repeat the word before, weighted by inverse document frequency,
centred, and projected to the leading singular directions of a bounded sample
of labelled rows. The sample's vectors are broadcast (``2 * PER_LABEL`` rows
of ``LATENT`` numbers at most: the bound is a parameter). Every document's
cosines with all of them are exact products, a block of documents at a time;
the nearest ones vote with their similarity.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbpipe.llm.common import arrow_map, remainder_of, texts
from kbpipe.llm.langid import features as ngrams

DIM = 2048            # hashed n-gram columns; one more counts repeated words
LATENT = 48           # dimensions of the latent space
PER_LABEL = 3000      # bound on the labelled rows used per label
NEIGHBOURS = 20
REPEAT_WEIGHT = 8     # a repeated word counts as so many n-grams
HELD_OUT = 5          # documents with crc32 mod 5 = 0 are never learned from
THRESHOLD = 0.3       # fixed by the query contract
_BLOCK = 256          # documents multiplied with all labelled vectors at once
_STEP = 1 << 20       # bytes of a text split into words at once


def repeats(raw: bytes, step: int = _STEP) -> int:
    """Words equal to the word before them."""
    n, last, at = 0, None, 0
    while at < len(raw):
        end = at + step
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        ws = raw[at:end].split()
        if ws:
            n += (last == ws[0]) + sum(map(bytes.__eq__, ws, ws[1:]))
            last = ws[-1]
        at = end
    return n


def terms(raw: bytes, dim: int = DIM) -> np.ndarray:
    """Term vector of a text: ``dim`` n-gram columns of length 1 (zero for an
    empty text) and the repeated words on the same scale."""
    x = np.empty(dim + 1, np.float32)
    x[:dim] = ngrams(raw, dim)
    # n-grams of 1 to 3 bytes: about three a byte before scaling
    x[dim] = np.sqrt(REPEAT_WEIGHT * repeats(raw) / max(1, 3 * len(raw)))
    return x


class Model:
    """Projection and labelled unit vectors. ``x`` holds a term vector per
    row, ``y`` its label; ``share`` is the weight of a row of each label (rows
    of that label in the whole table per sampled one)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, share: dict[int, float], latent: int = LATENT):
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
        a = self._weighted(x)
        self.mean = a.mean(axis=0)
        a -= self.mean
        _, directions = np.linalg.eigh(a.T @ a)
        self.axes = np.ascontiguousarray(directions[:, ::-1][:, :latent])
        self.vectors = _unit(a @ self.axes)
        self.weight = np.array([share[int(v)] for v in y], np.float32)
        self.label = y.astype(np.float32)

    def _weighted(self, x: np.ndarray) -> np.ndarray:
        return _unit(x * self.idf)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Unit latent vectors of term vectors."""
        return _unit((self._weighted(x) - self.mean) @ self.axes)

    def scores(self, z: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Label votes of the ``k`` nearest labelled vectors (and those as near
        as the last of them), weighted by similarity; without a similar one,
        the labels' share in the table."""
        near = z @ self.vectors.T
        k = min(k, near.shape[1])
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        vote = np.where(near >= least[:, None], np.maximum(near, 0), 0) * self.weight
        total = vote.sum(axis=1, dtype=np.float64)
        prior = float(self.weight @ self.label) / float(self.weight.sum())
        return np.where(total > 0, (vote @ self.label) / np.where(total > 0, total, 1), prior)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(size > 0, size, 1)).astype(np.float32)


def training_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, quality`` of ids that may be learned from; of several labels
    of an id, a 1 counts."""
    may = labels.where(F.col("quality").isin(0, 1) & F.coalesce(
        remainder_of(F.col("doc_id"), HELD_OUT) != 0, F.lit(False)))
    return may.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, dim: int = DIM,
        latent: int = LATENT) -> Model | None:
    """Model from at most ``per_label`` rows of each label, the first by a
    hash of their id. A hash threshold leaves about twice as many ids before
    anything is shuffled; only those ids meet the documents, as a broadcast of
    known size."""
    known = training_labels(labels)
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not counts:
        return None
    h = F.xxhash64("doc_id")
    cut = F.create_map(*[c for y, n in counts.items() for c in (F.lit(y), F.lit(
        (1 << 63) - 1 if n <= 2 * per_label else int((2 * per_label / n) * 2 ** 64) - (1 << 63)).cast("bigint"))])
    few = known.withColumn("h", h).where(F.col("h") <= cut[F.col("quality")])
    first = few.withColumn("r", F.row_number().over(Window.partitionBy("quality").orderBy("h", "doc_id"))) \
        .where(F.col("r") <= per_label).select("doc_id", "quality")
    # rows that share an id count once, so that no id can bring more than one row
    sample = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id").groupBy("doc_id", "quality").agg(
        F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batch):
        return {"doc_id": batch.column("doc_id"), "quality": batch.column("quality"),
                "x": [terms(t, dim).tobytes() for t in texts(batch, "text")]}

    rows = arrow_map(sample, run, "doc_id bigint, quality int, x binary").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return None
    y = rows["quality"].to_numpy()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, dim + 1)
    share = {v: counts[v] / n for v, n in zip(*(a.tolist() for a in np.unique(y, return_counts=True)))}
    return Model(x, y, share, latent)


def score_quality(docs: DataFrame, model: Model | None, dim: int = DIM, k: int = NEIGHBOURS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row.

    Defined cases: NULL and empty texts have no terms and are scored as such a
    vector (its distance to the mean is not zero); without labelled rows every
    score is 0.5; a NULL id is not held out; ties at the last neighbour all
    vote; repeated rows stay; very long texts are counted in parts; other
    columns are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.coalesce(remainder_of(F.col("doc_id"), HELD_OUT) == 0, F.lit(False))
                       .alias("held_out"), "text")

    def run(batch):
        m = shared.value
        raws = texts(batch, "text")
        score = np.full(len(raws), 0.5)
        for at in range(0, len(raws) if m else 0, _BLOCK):
            z = m.project(np.stack([terms(t, dim) for t in raws[at:at + _BLOCK]]))
            score[at:at + _BLOCK] = np.clip(m.scores(z, k), 0, 1)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

    return arrow_map(rows, run, "doc_id bigint, held_out boolean, score double, predicted int")
