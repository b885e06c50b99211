"""Plan-shape helpers shared by the operators.

Catalyst pushes a filter below the projection that computes the column it
tests by substituting the expression, and it infers ``size(array) > 0``
filters from ``explode`` and pushes those down too. For cheap columns that
is what we want; for a regular-expression chain over whole documents it
means running the chain twice (once in the pushed filter, once in the
projection). ``computed`` evaluates such columns inside a one-row
``inline_outer`` generator: filters on generator output stay above it, and
outer generators infer no filters, so each chain runs once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` plus (or with replaced) expensive columns, each evaluated once."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    packed = F.array(F.struct(*[e.alias(n) for n, e in cols.items()]))
    return df.select(*keep, F.inline_outer(packed))


def explode_rows(df: DataFrame, arr: Column, pos: str | None, val: str, *keep: str) -> DataFrame:
    """Rows of ``arr`` (with position ``pos`` if given); empty or NULL arrays
    give no rows. Uses the outer generator plus a filter on its output, so
    no size filter is inferred and pushed below expensive inputs."""
    cols = [F.col(f"`{c}`") for c in keep]
    if pos:
        x = df.select(*cols, F.posexplode_outer(arr).alias(pos, val))
        return x.where(F.col(pos).isNotNull()).withColumn(pos, F.col(pos).cast("bigint"))
    x = df.select(*cols, F.explode_outer(arr).alias(val))
    return x.where(F.col(val).isNotNull())


def _sql_str(s: str) -> str:
    if s.isprintable() and "'" not in s and "\\" not in s:
        return f"'{s}'"
    return "concat(" + ", ".join(f"chr({ord(ch)})" for ch in s) + ")"


def listagg_ordered(text: str, sep: str, *order: str) -> Column:
    """``listagg(text, sep) WITHIN GROUP (ORDER BY order...)``; NULLs skipped."""
    return F.expr(f"listagg(`{text}`, {_sql_str(sep)}) WITHIN GROUP "
                  f"(ORDER BY {', '.join(f'`{o}`' for o in order)})")


ORDERED_BLOCK = 4096  # elements joined per first-level group


def ordered_concat(df: DataFrame, key: str, order: str, text: str, sep: str,
                   out: str = "text", block: int = ORDERED_BLOCK,
                   count_out: str | None = None) -> DataFrame:
    """``(key, out)``: non-NULL ``text`` joined with ``sep`` in ``order``.

    Two levels, so a key holding a large share of all rows does not put all
    of its rows in one task: contiguous runs of ``block`` order values are
    joined first (grouped by key and run), then the run strings per key.
    NULL elements and all-NULL runs are skipped at both levels, so the result
    equals a single ordered join. Keys whose elements are all NULL get NULL.
    ``count_out`` adds the number of elements per key.
    """
    run = F.floor(F.col(order) / F.lit(block)).alias("_run")
    parts = (df.select(key, order, text, run)
               .groupBy(key, "_run").agg(listagg_ordered(text, sep, order).alias("_part"),
                                         F.count(F.lit(1)).alias("_n")))
    aggs = [listagg_ordered("_part", sep, "_run").alias(out)]
    if count_out:
        aggs.append(F.sum("_n").alias(count_out))
    return parts.groupBy(key).agg(*aggs)


def settled(df: DataFrame) -> DataFrame:
    """``df``, below which no later anti join is moved. Catalyst moves one
    under a distinct and a repartition, so that raw rows, a hot key's all in
    one task, go through the join's shuffle instead of the distinct ones. A
    condition that is always true but counts as nondeterministic stops it."""
    return df.where(F.monotonically_increasing_id() >= 0)
