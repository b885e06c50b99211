"""URL filters: rules first, then a Bloom filter cascade over hosts.

The cascade knows the corpus's complete key universe. Level 1 encodes the
listed keys; the unlisted keys that it lets through by mistake are encoded in
level 2, the listed keys that level 2 lets through in level 3, and so on
until a level makes no mistake. Membership of any key of the universe is then
exact without a join: the first level that rejects a key decides.

Levels are built by Spark: bit positions come from two native 64-bit hashes,
bits of one 64-bit word are OR-ed by a partially aggregated group-by, and the
words of a level, whose number is known before from the count of its keys,
are the only thing that reaches the driver. Beyond ``MAX_LEVEL_BYTES`` the
universe is cut into shards by key hash, each with its own cascade, and the
table is tested against one shard's cascade after the other.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbpipe.llm.common import Scratch, arrow_map

# Fixed values of the query contract: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

# Hosts are listed if a label of theirs holds one of these words.
LISTED_WORDS = ("spam", "pills", "casino", "porn", "xxx", "warez", "phish", "malware")

# Further categories, as whole words of a host's labels: "ads" lists
# ads-track.example.com but not downloads.example.com.
LISTED_LABELS = {
    "advertising": ("ad", "ads", "adclick", "adnetwork", "adserver", "adservers", "adservice", "adtrack",
                    "adtracking", "advert", "adverts", "advertising", "clicktrack", "clicktracking", "popunder",
                    "tracking"),
    "betting": ("bet", "bets", "betting", "bookie", "bookies", "bookmaker", "bookmakers", "gamble", "gambling",
                "jackpot", "jackpots", "lotto", "lottery", "poker", "roulette", "slots", "sportsbet", "sportsbook",
                "wager", "wagers"),
    "adult": ("adult", "adults", "camgirl", "camgirls", "erotic", "erotica", "escort", "escorts", "hentai", "milf",
              "nsfw", "nude", "nudes", "sex", "sexcam", "sexcams", "sexy", "xrated"),
}
# Top-level domains that are a category of their own (their labels are not
# searched for the words above: .ad is a country).
LISTED_TLDS = ("adult", "bet", "casino", "poker", "porn", "sex", "sexy", "xxx")

MAX_LEVEL_BYTES = 64 << 20     # a broadcast level is never larger
SEEDS = (17, 71)
FINAL_BYTES = 32 << 10         # a level may take this much to make no mistake at all


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), _lower_ascii(host)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), path).otherwise("")


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; NULL without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):      # a longer rule overrides
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, what).otherwise(verdict)
    return text, verdict


class Level:
    """One Bloom filter: ``bits`` is a power-of-two number of bits."""

    def __init__(self, n_keys: int, rate: float):
        rate = min(max(rate, 1e-6), 0.5)
        self.hashes = max(1, round(-math.log2(rate)))
        want = max(64, math.ceil(n_keys * -math.log(rate) / math.log(2) ** 2))
        self.bits = 1 << (want - 1).bit_length()
        self.array: np.ndarray | None = None

    @property
    def n_bytes(self) -> int:
        return self.bits // 8

    def positions(self, h1, h2, level: int):
        """Bit positions for hash columns (Spark) or arrays (NumPy)."""
        mask = self.bits - 1
        if isinstance(h1, Column):
            return [(h1 + (i + 1 + 31 * level) * h2).bitwiseAND(F.lit(mask)) for i in range(self.hashes)]
        with np.errstate(over="ignore"):
            return [(h1 + np.int64(i + 1 + 31 * level) * h2) & np.int64(mask) for i in range(self.hashes)]

    def passes(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        ok = np.ones(len(h1), bool)
        for pos in self.positions(h1, h2, level):
            ok &= (self.array[pos >> 6] >> (pos & 63)) & 1 == 1
        return ok


def _hashes(key: Column) -> tuple[Column, Column]:
    """Two hashes of a key; 48 bits each, so position sums never overflow."""
    wide = (1 << 48) - 1
    return tuple(F.xxhash64(key, F.lit(s)).bitwiseAND(F.lit(wide)) for s in SEEDS)


def _test(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """True where the cascade says the key is listed."""
    verdict = np.zeros(len(h1), bool)
    live = np.arange(len(h1))
    for n, level in enumerate(levels):
        ok = level.passes(h1[live], h2[live], n)
        verdict[live[~ok]] = n % 2 == 1     # rejected by an even-numbered (mistakes) level: listed
        live = live[ok]
    verdict[live] = len(levels) % 2 == 1    # passed the last level, which makes no mistake
    return verdict


def _passing(keys: DataFrame, level: Level, n: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level.array)

    def run(batch: pa.RecordBatch):
        h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
        lv = Level.__new__(Level)
        lv.bits, lv.hashes, lv.array = level_bits, level_hashes, shared.value
        keep = pa.array(lv.passes(h1, h2, n))
        return {c: batch.column(c).filter(keep) for c in ("h1", "h2", "listed")}

    level_bits, level_hashes = level.bits, level.hashes
    return arrow_map(keys.select("h1", "h2", "listed"), run, "h1 bigint, h2 bigint, listed boolean")


def _rate(n: int, n_encode: int, n_others: int, final_bytes: int) -> float:
    """Mistakes allowed to level ``n``: a share that balances the sizes of all
    levels, or next to none once that fits into ``final_bytes``."""
    if not n_others:
        return 0.5
    sure = 0.1 / n_others
    if n_encode * -math.log(sure) / math.log(2) ** 2 <= 8 * final_bytes:
        return sure
    return math.sqrt(0.5) * n_encode / n_others if n == 0 else 0.5


def build_cascade(keys: DataFrame, scratch: Scratch, final_bytes: int = FINAL_BYTES) -> list[Level]:
    """Levels for ``keys`` (``h1, h2, listed``: the distinct universe)."""
    levels: list[Level] = []
    encode, others = keys.where("listed"), keys.where("not listed")
    n_encode, n_others = keys.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    while n_encode:
        n = len(levels)
        level = Level(n_encode, _rate(n, n_encode, n_others, final_bytes))
        if level.n_bytes > MAX_LEVEL_BYTES:
            raise ValueError("universe too large for one cascade: use more shards")
        pos = F.explode(F.array(*level.positions(F.col("h1"), F.col("h2"), n)))
        filled = (encode.select(pos.alias("pos"))
                  .groupBy(F.shiftright("pos", 6).alias("word"))
                  .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"),
                                                F.col("pos").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
                  .toArrow())       # at most level.bits / 64 rows
        level.array = np.zeros(level.bits // 64, np.int64)
        level.array[filled["word"].to_numpy()] = filled["bits"].to_numpy()
        levels.append(level)
        if not n_others:
            break
        wrong = scratch.write(_passing(others, level, n))
        encode, others = wrong, encode
        n_encode, n_others = wrong.count(), n_encode
    return levels


def listed_keys(pages: DataFrame, key: Column, listed: Column) -> DataFrame:
    """``key, h1, h2, listed`` of every distinct key of the table."""
    h1, h2 = _hashes(F.col("key"))
    return pages.select(key.alias("key")).distinct().select("key", h1.alias("h1"), h2.alias("h2"),
                                                            listed.alias("listed"))


def is_spam_host(host: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(host, F.lit(w)) for w in LISTED_WORDS])


def is_listed_host(host: Column) -> Column:
    """Whether a host is of a listed category: by a part of its name
    (``LISTED_WORDS``), a word of its labels (cut at everything that is not a
    letter) or its top-level domain. User and port are left aside."""
    name = F.regexp_replace(host, r"(?s)^.*@|:[0-9]*$", "")
    name = F.regexp_replace(name, r"\.$", "")
    below = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), r"[^\p{L}]+")
    words = [w for ws in LISTED_LABELS.values() for w in ws]
    return (is_spam_host(host) | F.arrays_overlap(below, F.array(*[F.lit(w) for w in words]))
            | F.regexp_extract(name, r"\.([^.]*)$", 1).isin(*LISTED_TLDS))


def add_membership(df: DataFrame, key: str, out: str, keys: DataFrame, scratch: Scratch,
                   shards: int | None = None, final_bytes: int = FINAL_BYTES) -> DataFrame:
    """``df`` plus boolean ``out``: whether column ``key`` is listed, exact for
    every key of the universe ``keys``."""
    if shards is None:
        n_listed = keys.where("listed").count()
        shards = max(1, math.ceil(Level(max(1, n_listed), 1e-3).n_bytes / (MAX_LEVEL_BYTES // 4)))
    cols = [F.col(f"`{c}`") for c in df.columns]
    h1, h2 = _hashes(F.col(key))
    df = df.select("*", h1.alias(f"{out}_h1"), h2.alias(f"{out}_h2"), F.lit(False).alias(out))
    for shard in range(shards):
        part = keys.where(F.pmod(F.shiftright("h1", 24), F.lit(shards)) == shard)
        levels = build_cascade(part, scratch, final_bytes)
        df = _add_shard(df, out, levels, shard, shards)
    return df.select(*cols, F.col(out))


def _add_shard(df: DataFrame, out: str, levels: list[Level], shard: int, shards: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast([(x.bits, x.hashes, x.array) for x in levels])

    def run(batch: pa.RecordBatch):
        cols = {n: batch.column(n) for n in batch.schema.names}
        h1, h2 = cols[f"{out}_h1"].to_numpy(), cols[f"{out}_h2"].to_numpy()
        lvls = []
        for bits, hashes, array in shared.value:
            lv = Level.__new__(Level)
            lv.bits, lv.hashes, lv.array = bits, hashes, array
            lvls.append(lv)
        mine = np.flatnonzero((h1 >> 24) % shards == shard)
        hit = cols[out].to_numpy(zero_copy_only=False).copy()
        hit[mine] = _test(lvls, h1[mine], h2[mine])
        return cols | {out: pa.array(hit)}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return arrow_map(df, run, schema)


def filter_urls(pages: DataFrame, rules=RULES, is_listed=is_listed_host) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every url.

    The longest fitting rule decides; without one, hosts on the list (their
    membership tested by the cascade) are blocked and all others allowed.

    Defined cases: NULL urls and urls without ``://`` have empty host and
    path and are allowed; NULL ids and repeated rows stay; urls of any length
    are cut by linear patterns; other columns are ignored; an empty table gives
    an empty one.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col("url")
    parsed = pages.select("page_id", F.coalesce(host_of(url), F.lit("")).alias("host"),
                          F.coalesce(path_of(url), F.lit("")).alias("path"))
    keys = scratch.write(listed_keys(parsed, F.col("host"), is_listed(F.col("key"))))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    tested = add_membership(parsed, "host", "listed", keys.drop("key"), scratch)
    return tested.select("page_id", "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
