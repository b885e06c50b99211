"""Language identification: family first, then one-versus-one linear SVMs.

Features are hashed byte n-grams (1 to 3 bytes, ASCII lower-cased) of the
whole text, counted with NumPy, square-rooted and scaled to length 1. Linear
SVMs (squared hinge) are fitted on a bounded sample of the labelled rows: one
against the rest per family, one per pair of languages within a family. The
model (a few weight vectors) is shared with the tasks; predictions are
row-local.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbpipe.llm.common import arrow_map, remainder_of, texts

# Languages by family; a language not named here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "mt"),
}
FAMILY_OF = {lang: fam for fam, langs in FAMILIES.items() for lang in langs}

DIM = 2048            # hashed feature columns
SAMPLE_ROWS = 8000    # bound on the labelled rows used for fitting, shared by all languages
MIN_PER_LANG = 20     # rows that every language may bring, however many there are
UNKNOWN = "und"
HELD_OUT = 5          # documents with crc32 mod 5 = 0 are never learned from
_STEP = 1 << 20       # bytes of a text counted at once


def features(raw: bytes, dim: int = DIM) -> np.ndarray:
    """Square-rooted, length-1 counts of hashed 1-, 2- and 3-byte n-grams."""
    counts = np.zeros(dim, np.int64)
    low = raw.lower()
    for at in range(0, len(low), _STEP):
        b = np.frombuffer(low[max(0, at - 2):at + _STEP], np.uint8).astype(np.uint32)
        skip = min(at, 2)      # n-grams that end before ``at`` are already counted
        for n, mult in ((1, 40503), (2, 2654435761), (3, 2246822519)):
            if len(b) < n:
                continue
            code = b[n - 1:].copy()
            for k in range(1, n):
                code = code | b[n - 1 - k:len(b) - k] << np.uint32(8 * k)
            code = code[max(0, skip - (n - 1)):]
            h = ((code * np.uint32(mult) + np.uint32(n)) >> np.uint32(16)) % np.uint32(dim)
            counts += np.bincount(h, minlength=dim)
    x = np.sqrt(counts.astype(np.float32))
    size = np.linalg.norm(x)
    return x / size if size else x


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 200) -> np.ndarray:
    """Linear SVM with squared hinge loss by accelerated gradient descent;
    ``y`` is +1 or -1, both classes weigh the same. Last weight: bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    lam = 1.0 / (c * len(x))
    step = 1.0 / (lam + 2.0 * 2.0)       # |x|^2 <= 2, weights sum to 1
    w = z = np.zeros(x.shape[1], np.float32)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (lam * z - 2 * x.T @ (weight * y * slack))
        z = new + (t / (t + 3)) * (new - w)
        w = new
    return w.astype(np.float32)


class Model:
    """Families, their one-against-rest weights, and pair weights within them."""

    def __init__(self, x: np.ndarray, langs: np.ndarray, dim: int = DIM):
        self.dim = dim
        self.langs = sorted(set(langs.tolist()))
        fam = np.array([FAMILY_OF.get(v, v) for v in langs.tolist()], dtype=object)
        self.families = sorted(set(fam.tolist()))
        self.members = {f: [v for v in self.langs if FAMILY_OF.get(v, v) == f] for f in self.families}
        self.family_w = (np.stack([fit_svm(x, np.where(fam == f, 1, -1).astype(np.float32))
                                   for f in self.families])
                         if len(self.families) > 1 else np.zeros((len(self.families), dim + 1), np.float32))
        self.pair_w = {}
        for f, members in self.members.items():
            for a, b in combinations(members, 2):
                pick = np.flatnonzero((langs == a) | (langs == b))
                self.pair_w[a, b] = fit_svm(x[pick], np.where(langs[pick] == a, 1, -1).astype(np.float32))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Language and score (0 to 1) of one feature vector."""
        x1 = np.append(x, np.float32(1))
        scores = self.family_w @ x1
        f = int(np.argmax(scores))
        sure = 1.0 if len(self.families) == 1 else _sigmoid(4 * scores[f])
        members = self.members[self.families[f]]
        if len(members) == 1:
            return members[0], sure
        votes, margin = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            m = float(self.pair_w[a, b] @ x1)
            votes[a if m >= 0 else b] += 1
            margin[a] += m
            margin[b] -= m
        best = max(members, key=lambda v: (votes[v], margin[v]))
        return best, sure * _sigmoid(4 * margin[best] / (len(members) - 1))


def _sigmoid(v: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(v, -30, 30))))


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows that may be learned from: ``lang, text, h``, where ``h``
    is a hash of id and text (copies of one text differ)."""
    may = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                     & F.coalesce(remainder_of(F.col("doc_id"), HELD_OUT) != 0, F.lit(False))
                     & F.rlike("text", F.lit(r"\p{L}")))
    return may.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))


def training_sample(rows: DataFrame, counts: dict[str, int], per_lang: int) -> DataFrame:
    """At most ``per_lang`` rows of each language, the first by hash.

    ``counts`` are the languages' numbers of rows: a hash threshold twice as
    wide as needed leaves about ``2 * per_lang`` rows a language before any
    are shuffled, however large the table or a language is."""
    cut = F.create_map(*[c for lang, n in counts.items() for c in (F.lit(lang), F.lit(
        (1 << 63) - 1 if n <= 2 * per_lang else int((2 * per_lang / n) * 2 ** 64) - (1 << 63)).cast("bigint"))])
    w = Window.partitionBy("lang").orderBy("h")
    return (rows.where(F.col("h") <= cut[F.col("lang")])
            .withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_lang).select("lang", "text", "h"))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, dim: int = DIM) -> Model | None:
    """Model from a bounded sample: feature vectors are computed in tasks and
    about ``sample_rows`` of them reach the driver, which holds one count and
    a few weight vectors per language."""
    may = training_rows(docs)
    counts = {r["lang"]: r["count"] for r in may.groupBy("lang").count().collect()}
    if not counts:
        return None

    def run(batch):
        return {"lang": batch.column("lang"), "h": batch.column("h"),
                "x": [features(t, dim).tobytes() for t in texts(batch, "text")]}

    sample = training_sample(may, counts, max(MIN_PER_LANG, sample_rows // len(counts)))
    rows = arrow_map(sample, run, "lang string, h bigint, x binary").toArrow().sort_by(
        [("lang", "ascending"), ("h", "ascending"), ("x", "ascending")])
    if not rows.num_rows:
        return None
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, dim)
    return Model(x, np.array(rows["lang"].to_pylist(), dtype=object), dim)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row.

    Defined cases: NULL texts and texts without a letter are ``und`` with
    score 0, as is everything if nothing could be learned; a NULL id is not
    held out; repeated rows stay; a text of any length is counted whole, in
    parts; of languages with equal votes the larger margin wins, then the first
    by name; other columns are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.coalesce(remainder_of(F.col("doc_id"), HELD_OUT) == 0, F.lit(False))
                       .alias("held_out"),
                       F.when(F.rlike("text", F.lit(r"\p{L}")), F.col("text")).alias("text"))

    def run(batch):
        m = shared.value
        got = [m.predict(features(t, m.dim)) if t and m else (UNKNOWN, 0.0) for t in texts(batch, "text")]
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    return arrow_map(rows, run, "doc_id bigint, held_out boolean, lang_pred string, score double")
