"""Whitespace helpers with the Unicode semantics of the rules they serve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kbpipe.functions import regexes as rx


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Strip Unicode whitespace at both ends (Spark ``trim`` strips only U+0020)."""
    return F.regexp_replace(col_of(c), rx.EDGE_WS, "")


def collapse_ws(c) -> Column:
    """Every whitespace run becomes one space, then the ends are stripped."""
    collapsed = F.regexp_replace(col_of(c), rx.WS_RUN, " ")
    # after the collapse the only edge whitespace left is a single U+0020
    return F.trim(collapsed)


def nbsp_to_space(c) -> Column:
    return guarded(col_of(c), "\u00a0", lambda x: F.replace(x, F.lit("\u00a0"), F.lit(" ")))


def newline_runs(c) -> Column:
    return guarded(col_of(c), "\n", lambda x: F.regexp_replace(x, rx.NEWLINE_RUN, " "))


def space_runs(c) -> Column:
    return guarded(col_of(c), "  ", lambda x: F.regexp_replace(x, rx.SPACE_RUN, " "))


# redaction stage 1, step by step
NORMALISE_STEPS = [nbsp_to_space, newline_runs, space_runs]


def normalise_ws(c) -> Column:
    """Redaction stage 1: NBSP -> space, runs holding a newline -> one space,
    space runs -> one space. No strip; tabs away from newlines survive.
    (One nested expression; operators apply ``NORMALISE_STEPS`` as separate
    projections instead, see ``redaction.with_stages``.)"""
    c = col_of(c)
    for step in NORMALISE_STEPS:
        c = step(c)
    return c


def guarded(c: Column, needle: str | tuple, fn) -> Column:
    """``fn(c)`` only where ``c`` contains a literal the rule cannot match
    without (exact: elsewhere ``fn`` would return ``c`` unchanged). A
    substring test is far cheaper than a regex pass over a long text."""
    needles = (needle,) if isinstance(needle, str) else needle
    cond = None
    for n in needles:
        t = c.contains(n)
        cond = t if cond is None else (cond | t)
    return F.when(cond, fn(c)).otherwise(c)
