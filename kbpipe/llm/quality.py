"""Quality rules with host verdicts. DataFrame functions only.

Rules are measured per document, failures are summed per host (partial
aggregation: a host with a third of all rows sends one row per task), host
rates are shrunk with a beta prior fitted to all hosts by its moments, and
the hosts' verdicts are joined back. The per-document measures are written
once, so texts are read and split a single time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbpipe.llm.common import SPACES, Scratch, free_name

# Fixed values of the query contract.
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"

# The method's own limits.
MAX_SYMBOLS_PER_100 = 10    # symbol characters per 100 words
MAX_DUP_LINE_PCT = 30       # repeated lines in percent of the lines with a word
MIN_WORD_LEN, MAX_WORD_LEN = 3, 12   # mean code points per word
BAD_HOST_Z = 0.6745         # a host is bad above this many standard deviations of the prior: its upper quartile
MAX_DEMERITS = 2            # own failed rules, plus 1 for a bad host, that reject

RULES = ("few_words", "repeats", "symbols", "dup_lines", "word_length")


def _word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _sorted_windows(hashes: Column) -> Column:
    """(hash, start) of every window, sorted, where some hash occurs twice;
    else NULL."""
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.array_sort(
        F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows that occur twice or more: sorted windows with
    an equal neighbour are kept, and their sorted starts cover
    ``min(WINDOW, distance to the one before)`` words each. ``windows`` must
    be a plain column: the neighbours are fetched from it by position."""
    repeated = F.filter(
        F.transform(windows, lambda x, k: F.when(
            F.coalesce(F.get(windows, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(windows, k + 1)["h"] == x["h"], F.lit(False)), x["i"])),
        lambda i: i.isNotNull())
    return F.aggregate(
        F.array_sort(repeated), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("bigint").alias("n"),
                              i.alias("last")),
        lambda a: a["n"])


def measure(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` plus the measures of every whole text (NULL: no words)."""
    p = prefix
    cols = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col("text"), F.lit(""))

    def once(df: DataFrame, keep: list[str], **parts: Column) -> DataFrame:
        # a one-row generator: each part is evaluated once per row and later
        # steps read it as a plain column
        return df.select(*cols, *[p + k for k in keep], F.inline(F.array(F.struct(
            *[e.alias(p + k) for k, e in parts.items()]))))

    def q(name: str) -> Column:
        return F.col(p + name)

    squeezed = text
    for c in " \t\n\x0b\x0c\r":
        squeezed = F.replace(squeezed, F.lit(c), F.lit(""))
    df = once(docs, [], words=_word_array(text),
              lines=F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = once(df, [], n_words=F.size(q("words")).cast("bigint"),
              hashes=F.transform(q("words"), lambda x: F.xxhash64(x)),
              word_chars=F.length(squeezed).cast("bigint"),
              n_symbols=F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint"),
              n_dup_lines=(F.size(q("lines")) - F.size(F.array_distinct(q("lines")))).cast("bigint"),
              n_lines=F.size(q("lines")).cast("bigint"))
    keep = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    df = once(df, keep, windows=F.when(q("n_words") >= WINDOW, F.transform(
        F.sequence(F.lit(0), (q("n_words") - WINDOW).cast("int")),
        lambda i: F.xxhash64(*[F.get(q("hashes"), i + k) for k in range(WINDOW)]))))
    df = once(df, keep, ordered=_sorted_windows(q("windows")))
    return df.select(*cols, *[p + k for k in keep],
                     F.coalesce(_repeat_words(q("ordered")), F.lit(0)).cast("bigint").alias(f"{p}n_repeat_words"))


def rule_flags(p: str = "") -> dict[str, Column]:
    n = F.col(f"{p}n_words")
    return {
        "few_words": n < MIN_WORDS,
        "repeats": 100 * F.col(f"{p}n_repeat_words") > MAX_REPEAT_PCT * n,
        "symbols": 100 * F.col(f"{p}n_symbols") > MAX_SYMBOLS_PER_100 * n,
        "dup_lines": 100 * F.col(f"{p}n_dup_lines") > MAX_DUP_LINE_PCT * F.col(f"{p}n_lines"),
        "word_length": (F.col(f"{p}word_chars") < MIN_WORD_LEN * n) | (F.col(f"{p}word_chars") > MAX_WORD_LEN * n),
    }


def host_verdicts(measured: DataFrame, host: str, p: str = "") -> DataFrame:
    """``host, host_docs, host_failed, host_rate, host_bad``: the share of
    failing documents, shrunk as ``(failed + a) / (docs + a + b)`` where
    beta(a, b) has the mean and variance of all hosts' shares. A host is bad
    if its shrunk rate lies above the prior's upper quartile (``mean +
    BAD_HOST_Z * deviation``): a few failing documents don't carry a small
    host there, as they are drawn towards the mean."""
    any_failed = F.lit(False)
    for flag in rule_flags(p).values():
        any_failed = any_failed | flag
    hosts = measured.groupBy(F.col(f"`{host}`").alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"),
        F.sum(any_failed.cast("bigint")).alias("host_failed"))
    prior = fit_beta(hosts)
    a, b = prior.select("a").scalar(), prior.select("b").scalar()
    rate = (F.col("host_failed") + a) / (F.col("host_docs") + a + b)
    mean = a / (a + b)
    limit = mean + BAD_HOST_Z * F.sqrt(mean * (1 - mean) / (a + b + 1))
    return hosts.withColumn("host_rate", rate).withColumn("host_bad", F.col("host_rate") > limit)


def fit_beta(hosts: DataFrame) -> DataFrame:
    """One row ``a, b``: beta prior with the moments of the hosts' shares.

    The strength is ``m (1 - m) / v - 1``, kept between 1 and 1000 (one host,
    or hosts that all agree, have no variance and get 1000; a mean of 0 or 1
    is moved inside by half a document)."""
    r = F.col("host_failed") / F.col("host_docs")
    half = F.lit(0.5) / (F.sum("host_docs") + 1)
    stats = hosts.agg(F.least(F.greatest(F.avg(r), half), 1 - half).alias("m"), F.var_pop(r).alias("v"))
    strength = F.when(F.col("v") > 0, F.least(F.lit(1000.0), F.greatest(
        F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(F.lit(1000.0))
    return stats.select((F.col("m") * strength).alias("a"), ((1 - F.col("m")) * strength).alias("b"))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """``docs`` plus measures (``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words``), ``base_failed``, ``host_rate``, ``host_bad``,
    ``demerits`` and ``kept``.

    A document goes if it fails the base rules, or if its failed rules plus
    one for a bad host reach ``MAX_DEMERITS`` while it fails at least one
    rule itself: documents without a failed rule always stay.

    Defined cases: NULL and empty texts have no words and fail; a NULL host
    is a host of its own; repeated rows count each; columns of ``docs`` whose
    names clash with a result column keep their name and the result column
    gets underscores appended; empty tables give empty tables.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    p = free_name("q_", [c[:2] for c in docs.columns])
    m = scratch.write(measure(docs, p))
    hosts = scratch.write(host_verdicts(m, host, p).select(
        F.col("host").alias(f"{p}host"), F.col("host_rate").alias(f"{p}host_rate"),
        F.col("host_bad").alias(f"{p}host_bad")))
    j = m.join(hosts, F.col(f"`{host}`").eqNullSafe(F.col(f"{p}host")), "left")
    flags = rule_flags(p)
    own = sum((f.cast("int") for f in flags.values()), F.lit(0))
    j = j.withColumns({f"{p}own": own, f"{p}base_failed": flags["few_words"] | flags["repeats"]})
    demerits = F.col(f"{p}own") + F.when(F.col(f"{p}own") > 0, F.col(f"{p}host_bad").cast("int")).otherwise(0)
    out = {"n_words": None, "word_chars": None, "n_symbols": None, "n_dup_lines": None, "n_repeat_words": None,
           "base_failed": None, "host_rate": None, "host_bad": None, "demerits": demerits,
           "kept": ~F.col(f"{p}base_failed") & (demerits < MAX_DEMERITS)}
    return j.select(*[F.col(f"`{c}`") for c in docs.columns],
                    *[(F.col(f"{p}{k}") if e is None else e).alias(free_name(k, docs.columns))
                      for k, e in out.items()])
