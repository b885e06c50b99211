"""Column-level redaction stages (JVM-side regular expressions, but for the sweep).

Order matters and is fixed: normalise -> email -> phone -> health id ->
reference number -> context names (each rule on the text the previous left)
-> sweep of every discovered name over the whole text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbpipe.functions import regexes as rx
from kbpipe.functions.text import NORMALISE_STEPS, col_of, guarded, normalise_ws


def redact_email(c) -> Column:
    return guarded(col_of(c), "@", lambda x: F.regexp_replace(x, rx.EMAIL, rx.EMAIL_TOKEN))


def redact_phone(c) -> Column:
    return guarded(col_of(c), ("0", "+44"), lambda x: F.regexp_replace(x, rx.PHONE, rx.PHONE_TOKEN))


def redact_health_id(c) -> Column:
    return F.regexp_replace(col_of(c), rx.HEALTH_ID, rx.HEALTH_TOKEN)


def redact_ref_num(c) -> Column:
    return F.regexp_replace(col_of(c), rx.REF_NUM, rx.REF_TOKEN)


# stages 1-5 in order: normalise, then the four fixed-token rules
TOKEN_STEPS = [*NORMALISE_STEPS, redact_email, redact_phone, redact_health_id, redact_ref_num]


def redact_tokens(c) -> Column:
    """Stages 1-5 as one nested expression (for short texts and tests)."""
    c = col_of(c)
    for step in TOKEN_STEPS:
        c = step(c)
    return c


def context_rule(c, i: int) -> Column:
    return guarded(col_of(c), rx.CONTEXT_KEYWORDS[i],
                   lambda x: F.regexp_replace(x, rx.CONTEXT_NAME_RULES[i], rx.CONTEXT_REPLACEMENT))


def context_names(c, i: int) -> Column:
    """Names rule ``i`` would replace in ``c`` (its second group)."""
    c = col_of(c)
    found = F.regexp_extract_all(c, F.lit(rx.CONTEXT_NAME_RULES[i]), 2)
    return F.when(c.contains(rx.CONTEXT_KEYWORDS[i]), found) \
            .otherwise(F.when(c.isNotNull(), F.array().cast("array<string>")))


def sort_names(names) -> Column:
    """Distinct names, longest first, then alphabetical: a deterministic sweep
    order where overlapping names (``John`` and ``John Smith``) meet."""
    def cmp(a, b):
        return (F.when(F.length(a) > F.length(b), -1)
                .when(F.length(a) < F.length(b), 1)
                .when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.array_sort(F.array_distinct(col_of(names)), cmp)


class _Names:
    """Names of one text as sequences of words: by first word the numbers of
    words that names have, by name its place in the sweep order."""

    def __init__(self, names: list[str], name_words: list[list[str]]):
        self.rank = {}
        self.sizes: dict[str, set[int]] = {}
        for name, ws in zip(names, name_words):
            if ws:
                self.rank.setdefault(name, len(self.rank))
                self.sizes.setdefault(ws[0], set()).add(len(ws))
        self.hashes: dict[tuple[int, int], int] = {}       # (words, hash) -> place in the order
        self.order = list(self.rank)
        for name, ws in zip(names, name_words):
            if ws:
                self.hashes[len(ws), _prefix_hashes(_pieces(name, ws))[-1]] = self.rank[name]


_MOD, _BASE = (1 << 61) - 1, 911_382_323_172_673


def _pieces(name: str, ws: list[str]) -> list[str]:
    """Words and gaps of a name: word, gap, word, ..., word."""
    out, at = [], 0
    for w in ws:
        i = name.index(w, at)
        out += [name[at:i], w]
        at = i + len(w)
    return out[1:]


def _prefix_hashes(pieces: list[str]) -> list[int]:
    out, h = [0], 0
    for p in pieces:
        h = (h * _BASE + hash(p)) % _MOD
        out.append(h)
    return out


def sweep_words(words: list[str], gaps: list[str], names: list[str], name_words: list[list[str]],
                token: str = rx.NAME_TOKEN) -> str:
    """The text ``gaps[0] words[0] gaps[1] ...`` with every name replaced that
    stands there as whole words, names in list order, each from left to right.

    One pass finds all places where a name can stand: a word that starts
    names, and a rolling hash of as many words as those names have. The places
    are then taken in list order, as far as their words are still free."""
    known = _Names(names, name_words)
    pieces = [x for pair in zip(words, gaps[1:]) for x in pair]      # word, gap, word, gap, ...
    prefix = _prefix_hashes(pieces) if any(max(s) > 1 for s in known.sizes.values()) else None
    power: dict[int, int] = {}
    found = []
    for i, w in enumerate(words):
        for n in known.sizes.get(w, ()):
            if n == 1:
                place = known.rank.get(w)
            elif i + n <= len(words):
                k = 2 * n - 1
                if k not in power:
                    power[k] = pow(_BASE, k, _MOD)
                place = known.hashes.get((n, (prefix[2 * i + k] - prefix[2 * i] * power[k]) % _MOD))
            else:
                place = None
            if place is not None:
                found.append((place, i, n))
    if not found:
        return gaps[0] + "".join(pieces)
    taken = bytearray(len(words))
    end: dict[int, int] = {}
    for place, i, n in sorted(found):
        if taken.find(1, i, i + n) < 0 and "".join(pieces[2 * i:2 * (i + n) - 1]) == known.order[place]:
            taken[i:i + n] = b"\1" * n
            end[i] = i + n
    out, at = [gaps[0]], 0
    for i in sorted(end):
        out += pieces[2 * at:2 * i]
        out.append(token)
        out.append(gaps[end[i]])
        at = end[i]
    return "".join(out + pieces[2 * at:])


@F.arrow_udf(T.StringType())
def _sweep(words: pa.Array, gaps: pa.Array, names: pa.Array, name_words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else sweep_words(w, g, n, nw)
                     for w, g, n, nw in zip(*(x.to_pylist() for x in (words, gaps, names, name_words)))], pa.string())


def sweep_names(text, names) -> Column:
    """Replace every whole-word occurrence of each name, in list order.

    Words and gaps are cut by the JVM's rules; the search among a document's
    own names needs a hash table, which column expressions lack (their maps
    are scanned), so it runs on Arrow batches and takes time in proportion to
    text and names. Texts without names pass by as NULLs. Names start and end
    with a word character, as those of the rules do.
    """
    text, names = col_of(text), col_of(names)
    some = F.size(names) > 0
    word = F.lit(f"({rx.W}++)")

    def given(c: Column) -> Column:
        return F.when(some, c)

    swept = _sweep(given(F.regexp_extract_all(text, word, 1)), given(F.split(text, f"{rx.W}++", -1)),
                   given(names), given(F.transform(names, lambda n: F.regexp_extract_all(n, word, 1))))
    return F.when(some, swept).otherwise(text)
