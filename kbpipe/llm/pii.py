"""Personal data: patterns propose spans, checksums confirm them, and words
nearby adjust the score. DataFrame functions only, row-local, no shuffle.

``split`` gives the text between the matches of a pattern and
``regexp_extract_all`` the matches, so running lengths give every match's
position in code points. A pattern is only tried on texts that hold a
character it needs. All repetitions are possessive and a match can only
start where a run starts (or where the last match ended, ``\\G``), so the
time is linear in the text for any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbpipe.llm.common import free_name

_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"

# Length of an account number by country (ISO 13616 registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_IBAN_RUN = r"[0-9]{2}(?:\x20?[A-Z0-9])"
_IBAN = "|".join(f"(?:{c.replace(' ', '|')}){_IBAN_RUN}{{{n - 4}}}+" for n, c in IBAN_LENGTHS.items())

# Kind -> (guard, pattern). The first four match the query contract's rules.
PATTERNS = {
    "email": ("@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    # added by the method: account numbers under the mod-97 checksum, as long as
    # the country's are; where none ends there or for other countries, the whole run.
    # Group 1 is the number; only its head is taken, so that a run which fails
    # the checksum doesn't hide a number that starts inside it.
    "iban": ("", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9])(?=((?:{_IBAN}|[A-Z]{{2}}{_IBAN_RUN}{{11,30}}+)(?![A-Za-z0-9])))"
                 r"[A-Z]{2}[0-9]{2}"),
    # a national phone number: too weak a pattern without a word that names it
    "tel": ("0", r"(?<![0-9+][\x20().-]{0,2})(?<![A-Za-z])0[1-9](?:[\x20()./-]{0,2}[0-9])++"),
}
HEAD = {"iban": 4}       # code points that a match takes, where that isn't all of it
BASE_KINDS = ("email", "ip", "card", "phone")
MAX_IP_PART = 255
CARD_DIGITS = (16, 19)
PHONE_DIGITS = (8, 15)
TEL_DIGITS = (9, 12)

# Words that make a kind more likely within CONTEXT code points before a span.
CONTEXT = 40
_BACK = 8        # matches before a span whose text can lie within its context
CONTEXT_WORDS = {
    "email": "e-?mail|contact|write|address",
    "ip": "ip|address|host|server|login",
    "card": "card|credit|visa|payment|pay",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "tel": "phone|call|tel|mobile|fax",
}
BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "tel": 0.4}
CONTEXT_BONUS = {"email": 0.1, "ip": 0.1, "card": 0.1, "phone": 0.1, "iban": 0.1, "tel": 0.3}
MIN_SCORE = 0.5      # a span below it is dropped

PLACEHOLDERS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "iban": "<IBAN>", "tel": "<PHONE>"}


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn checksum of a string of digits."""
    def add(acc: Column, ch: Column) -> Column:
        d = ch.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((acc["sum"] + F.when(acc["odd"], twice).otherwise(d)).alias("sum"),
                        (~acc["odd"]).alias("odd"))
    chars = F.array_remove(F.split(F.reverse(digits), ""), "")
    return F.aggregate(chars, F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), add,
                       lambda acc: acc["sum"] % 10 == 0)


def mod97(account: Column) -> Column:
    """ISO 7064 mod 97-10 of an account number (spaces allowed)."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
    chars = F.array_remove(F.split(turned, ""), "")
    return F.aggregate(
        chars, F.lit(0),
        lambda acc, ch: F.when(ch.rlike("[0-9]"), (acc * 10 + F.ascii(ch) - 48) % 97)
                         .otherwise((acc * 100 + F.ascii(ch) - 55) % 97),
        lambda acc: acc == 1)


def confirmed(kind: str, s: Column) -> Column:
    """Whether a proposed match passes its kind's check."""
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda x: F.regexp_replace(x, "^0+", "").rlike(
            r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(s)).between(*CARD_DIGITS) & luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(*PHONE_DIGITS)
    if kind == "tel":
        return F.length(_digits(s)).between(*TEL_DIGITS)
    if kind == "iban":
        return F.length(F.replace(s, F.lit(" "), F.lit(""))).between(15, 34) & mod97(s)
    return F.lit(True)


_BLOCK = 128     # matches per block of running lengths
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,match:string,score:double>>"


def _found(kind: str, text: Column) -> Column:
    """Per match (and once for what follows the last): the text before it
    (``gap``), the match (NULL at the end), the length of the one and what the
    other takes of the text."""
    guard, pattern = PATTERNS[kind]
    tried = text.contains(guard) if guard else text.rlike("[0-9]")
    return F.when(tried, F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if kind in HEAD else 0)).alias("match")),
        lambda x: F.struct(x["gap"].alias("gap"), F.length(x["gap"]).alias("before"),
                           F.when(x["match"].isNull(), 0).otherwise(
                               F.lit(HEAD[kind]) if kind in HEAD else F.length(x["match"])).alias("len"),
                           x["match"].alias("match"))))


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x["before"] + x["len"])


def _block_totals(found: Column) -> Column:
    n = F.ceil(F.size(found) / _BLOCK).cast("int")
    return F.when(F.size(found) > 0, F.transform(
        F.sequence(F.lit(0), n - 1), lambda b: _total(F.slice(found, b * _BLOCK + 1, _BLOCK))))


def _block_starts(totals: Column) -> Column:
    return F.transform(totals, lambda _, i: F.aggregate(
        F.slice(totals, 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x))


def score(kind: str, found: Column, x: Column, i: Column) -> Column:
    """Score of match ``x``, the ``i``-th of ``found``: its kind's, more if a
    word of the kind stands in the ``CONTEXT`` code points before it (earlier
    matches and what lies between them included)."""
    earlier = F.slice(found, F.greatest(i - _BACK, F.lit(0)) + 1, F.least(i, F.lit(_BACK)))
    before = F.aggregate(earlier, F.lit(""), lambda acc, e: F.concat(
        acc, F.substring(e["gap"], -CONTEXT, CONTEXT), F.substring(e["match"], 1, e["len"])))
    near = F.lower(F.substring(F.concat(before, F.substring(x["gap"], -CONTEXT, CONTEXT)), -CONTEXT, CONTEXT))
    bonus = F.when(near.rlike(rf"\b(?:{CONTEXT_WORDS[kind]})"), CONTEXT_BONUS[kind]).otherwise(0.0)
    return F.lit(BASE_SCORE[kind]) + bonus


def accepted(kind: str, found: Column, x: Column, i: Column) -> Column:
    """Whether a proposed match passes its kind's check and scores enough."""
    ok = x["match"].isNotNull() & confirmed(kind, x["match"])
    # a kind that scores enough by itself needs no look at its context
    return ok if BASE_SCORE[kind] >= MIN_SCORE else ok & (score(kind, found, x, i) >= MIN_SCORE)


def _spans(kind: str, found: Column, starts: Column) -> Column:
    """Accepted matches of one kind as structs (kind, start, end, match,
    score); positions in code points, end exclusive. Running lengths are taken
    per block of matches, so many matches in one text don't cost their square.
    ``found`` and ``starts`` must be plain columns."""
    def place(x: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        at = F.get(starts, block) + _total(F.slice(found, block * _BLOCK + 1, i % _BLOCK)) + x["before"]
        return F.struct(F.lit(kind).alias("kind"), at.cast("bigint").alias("start"),
                        (at + F.length(x["match"])).cast("bigint").alias("end"), x["match"].alias("match"),
                        score(kind, found, x, i).alias("score"))

    good = F.transform(found, lambda x, i: F.when(accepted(kind, found, x, i), place(x, i)))
    return F.coalesce(F.filter(good, lambda s: s.isNotNull()), F.array().cast(_SPAN))


def _once(df: DataFrame, cols: list[str], **parts: Column) -> DataFrame:
    """``cols`` plus ``parts``, through a one-row generator: each part is
    evaluated once per row, and later steps read it as a plain column."""
    return df.select(*[F.col(f"`{c}`") for c in cols],
                     F.inline(F.array(F.struct(*[e.alias(k) for k, e in parts.items()]))))


def find_pii(docs: DataFrame, out: str = "pii") -> DataFrame:
    """``docs`` plus ``out``: array of (kind, start, end, match, score), by
    kind as listed in ``PATTERNS``, then start. Spans that score less than
    ``MIN_SCORE`` are left out (a national phone number without a word for it).

    Defined cases: NULL and empty texts have no spans; NULL ids, repeated
    rows and other columns stay as they are; a text of any length takes
    linear time; empty tables give empty tables.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    p, kinds = free_name("pii_", [c[:4] for c in [*docs.columns, out]]), list(PATTERNS)
    found, totals, starts = ([f"{p}{k}_{x}" for k in kinds] for x in "fts")
    df = _once(docs, docs.columns, **{f: _found(k, text) for k, f in zip(kinds, found)})
    df = _once(df, [*docs.columns, *found], **{t: _block_totals(F.col(f)) for t, f in zip(totals, found)})
    df = _once(df, [*docs.columns, *found], **{s: _block_starts(F.col(t)) for s, t in zip(starts, totals)})
    return _once(df, docs.columns, **{out: F.concat(*[
        _spans(k, F.col(f), F.col(s)) for k, f, s in zip(kinds, found, starts)])})


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every accepted match in ``text`` replaced by its kind's
    placeholder, one kind after the other (placeholders match no pattern, and
    where matches of two kinds overlap the kind listed first takes it; the
    context of a later kind is the text that the earlier ones left). Texts
    without a match are unchanged; ``n_chars``, where there is one, follows
    the text where it changed.

    Defined cases: NULL and empty texts stay as they are; NULL ids, repeated
    rows, ties and other columns (whatever their names) pass unchanged; a text
    of any length takes linear time; empty tables give empty tables."""
    p = free_name("pii_", [c[:4] for c in docs.columns])
    new, f, over = f"{p}text", f"{p}found", f"{p}over"
    df = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("text").alias(new))
    for kind in PATTERNS:
        df = _once(df, [*docs.columns, new], **{f: _found(kind, F.col(new))})
        if kind in HEAD:
            df = _once(df, [*docs.columns, new, f], **{over: _overhangs(F.col(f), kind)})
            parts = _parts_beyond_heads(F.col(f), F.col(over), kind)
        else:
            parts = _parts(F.col(f), kind)
        df = _once(df, docs.columns, **{new: F.coalesce(F.array_join(parts, ""), F.col(new))})
    cols = []
    for c in docs.columns:
        e = F.col(f"`{c}`")
        if c == "text":
            e = F.col(new)
        elif c == "n_chars":
            e = F.when(F.col(new) != F.col("text"), F.length(F.col(new)).cast(dict(docs.dtypes)[c])).otherwise(e)
        cols.append(e.alias(c))
    return df.select(*cols)


def _parts(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x, i: F.concat(x["gap"], F.when(x["match"].isNull(), "").when(
        accepted(kind, found, x, i), PLACEHOLDERS[kind]).otherwise(x["match"])))


_REACH = 16      # matches that can start within one: 34 characters and 33 spaces, a head and a space each


def _overhangs(found: Column, kind: str) -> Column:
    """How far each confirmed match reaches beyond its head."""
    return F.transform(found, lambda x: F.when(
        x["match"].isNotNull() & confirmed(kind, x["match"]), F.length(x["match"]) - x["len"]).otherwise(0))


def _parts_beyond_heads(found: Column, over: Column, kind: str) -> Column:
    """``_parts`` where matches reach into the following gaps; NULL without a
    confirmed match. Numbers that overlap get one placeholder."""
    def part(x: Column, i: Column) -> Column:
        covered = F.when(i > 0, F.aggregate(
            F.sequence(F.greatest(i - _REACH, F.lit(0)), i - 1), F.lit(0),
            lambda left, j: F.greatest(left - F.get(found, j)["before"] - F.get(found, j)["len"],
                                       F.get(over, j)))).otherwise(0)
        own = F.when(x["match"].isNull() | (covered > x["before"]), "").when(
            F.get(over, i) > 0, PLACEHOLDERS[kind]).otherwise(F.substring(x["match"], 1, HEAD[kind]))
        return F.concat(F.substring(x["gap"], covered + 1, x["before"]), own)

    return F.when(F.exists(over, lambda n: n > 0), F.transform(found, part))
