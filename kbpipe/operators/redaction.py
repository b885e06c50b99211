"""Personal-data redaction as DataFrame operators.

Everything is row-local (no shuffle): a document's names are discovered and
swept inside the same row, so the operator parallelises over partitions and
never groups documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbpipe.functions import redact as R
from kbpipe.functions import regexes as rx
from kbpipe.operators.common import computed, explode_rows


def apply_steps(df: DataFrame, col: str, steps, out: str | None = None) -> DataFrame:
    """Column steps applied one projection at a time (each step's input is a
    column reference, so guarded steps do not repeat their input)."""
    out = out or col
    if out != col:
        df = df.withColumn(out, F.col(col))
    for step in steps:
        df = df.withColumn(out, step(out))
    return df


def may_name(col: str):
    """False only for texts in which no context rule can fire: every rule
    needs its keyword, the token rules cannot create one, and whitespace
    normalisation can only join ``Kin`` and ``Contact:``."""
    c = F.col(col)
    cond = None
    for kw in rx.CONTEXT_RAW_KEYWORDS:
        t = c.contains(kw)
        cond = t if cond is None else cond | t
    return F.coalesce(cond, F.lit(False))


def with_stages(df: DataFrame, col: str, prefix: str = "_r_", names_only: bool = False) -> DataFrame:
    """Add ``{prefix}s`` (text after the four context rules, before the sweep)
    and ``{prefix}names`` (discovered names in sweep order).

    Each stage is its own projection so a regex result used twice (names are
    read from the text a rule is about to rewrite) is computed once. With
    ``names_only`` the stages run only for texts where a name rule can fire
    (``{prefix}s`` is then NULL elsewhere and must not be used).
    """
    t = f"{prefix}s"
    # one projection per step: a guarded step reads its input three times,
    # and as a column reference that input is computed once
    df = df.withColumn(t, F.when(may_name(col), F.col(col)) if names_only else F.col(col))
    df = apply_steps(df, t, R.TOKEN_STEPS)
    found = []
    for i in range(len(rx.CONTEXT_NAME_RULES)):
        n = f"{prefix}n{i}"
        df = df.withColumn(n, R.context_names(t, i)).withColumn(t, R.context_rule(t, i))
        found.append(n)
    names = R.sort_names(F.concat(*found))
    if names_only:
        names = F.coalesce(names, F.when(F.col(col).isNotNull(), F.array().cast("array<string>")))
    return df.withColumn(f"{prefix}names", names).drop(*found)


def redact(df: DataFrame, col: str = "text", out: str | None = None,
           names_out: str | None = None) -> DataFrame:
    """Full redaction of ``col`` into ``out`` (default: in place).

    NULL stays NULL and '' stays ''. ``names_out`` keeps the discovered names.
    """
    out = out or col
    p = "_r_"
    df = with_stages(df, col, p)
    cols = {out: R.sweep_names(f"{p}s", f"{p}names")}
    if names_out:
        cols[names_out] = F.col(f"{p}names")
    return computed(df, **cols).drop(f"{p}s", f"{p}names")


def redact_with_names(df: DataFrame, col: str, names_col: str,
                      out: str | None = None) -> DataFrame:
    """Redact a piece of a document (a chunk) with names discovered from the
    whole document (``names_col``) as well as those found in the piece."""
    out = out or col
    p = "_q_"
    df = with_stages(df, col, p)
    all_names = R.sort_names(F.concat(F.coalesce(F.col(names_col), F.array().cast("array<string>")),
                                      F.col(f"{p}names")))
    return computed(df, **{out: R.sweep_names(f"{p}s", all_names)}).drop(f"{p}s", f"{p}names")


def discovered_names(df: DataFrame, id_col: str, col: str = "text") -> DataFrame:
    """One row per (document, discovered name)."""
    staged = with_stages(df.select(id_col, col), col, "_d_")
    return explode_rows(staged, F.col("_d_names"), None, "name", id_col)


_TOKENS = {
    "email_hits": rx.EMAIL_TOKEN,
    "phone_hits": rx.PHONE_TOKEN,
    "health_id_hits": rx.HEALTH_TOKEN,
    "ref_num_hits": rx.REF_TOKEN,
    "name_hits": rx.NAME_TOKEN,
}


def token_counts(col: str) -> dict:
    return {k: F.regexp_count(F.col(col), F.lit(_escape(tok))) for k, tok in _TOKENS.items()}


def _escape(tok: str) -> str:
    return tok.replace("[", r"\[").replace("]", r"\]")


def redaction_counters(raw_col: str, redacted_col: str) -> list:
    """Counter semantics: +1 per non-empty document redacted, plus the number
    of placeholders of each kind in the output. Aggregate expressions usable
    in ``agg`` or ``observe``."""
    counts = token_counts(redacted_col)
    return [F.count_if(F.col(raw_col).isNotNull() & (F.col(raw_col) != "")).alias("documents_redacted"),
            *[F.sum(F.coalesce(v, F.lit(0))).cast("bigint").alias(k) for k, v in counts.items()]]


def redaction_metrics(df: DataFrame, raw_col: str, redacted_col: str) -> DataFrame:
    """The counters as a one-row table. A global aggregate: partial sums per
    task, one tiny final merge."""
    return df.agg(*redaction_counters(raw_col, redacted_col))
