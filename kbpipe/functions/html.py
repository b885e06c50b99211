"""Main-content text and links of an HTML page, as column expressions.

Steps in a fixed order: (1) drop comments, scripts and styles over the whole
page (their bodies may hold markup-like text); (2) pick the first ``main``,
else the first ``article``, else ``body`` (none -> NULL); (3) keep what lies
inside it and outside its ``nav``, ``footer`` and ``header`` blocks; (4)
every tag becomes a space; (5) decode entities, ``&amp;`` last; (6) collapse
whitespace.

Steps 2 and 3 cut the page at its structure tags (``rx.HTML_CODES``) and fold
over them with the stack of open elements, so blocks nest: a ``nav`` inside a
``nav`` ends with the outer one, an element that is never closed ends with
the one around it, an end tag without a start tag is ignored, and a container
that is never closed runs to the end of the page. A self-closed tag
(``<nav/>``) opens nothing.

Known limits: elements outside ``rx.HTML_CODES`` (``p``, ``li``, ``span``)
don't close what is open inside them; named entities outside the fixed list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kbpipe.functions import regexes as rx
from kbpipe.functions.text import col_of, collapse_ws


def strip_inert(html) -> Column:
    h = F.regexp_replace(col_of(html), rx.HTML_COMMENT, " ")
    h = F.regexp_replace(h, rx.HTML_SCRIPT, " ")
    return F.regexp_replace(h, rx.HTML_STYLE, " ")


def _codes(tags: Column) -> Column:
    """Each structure tag as one character: its element's letter, upper case
    for an end tag, ``-`` for a self-closed one."""
    letters = F.create_map(*[F.lit(x) for pair in rx.HTML_CODES.items() for x in pair])

    def code(tag):
        letter = letters[F.lower(F.regexp_extract(tag, rx.HTML_STRUCTURE_NAME, 1))]
        return (F.when(tag.startswith("</"), F.upper(letter))
                 .when(tag.endswith("/>"), F.lit("-")).otherwise(letter))
    return F.transform(tags, code)


def _container_at(codes: Column) -> Column:
    """Number (from 1) of the tag that opens the container, NULL if none."""
    at = [F.array_position(codes, F.lit(rx.HTML_CODES[t])) for t in rx.HTML_CONTAINERS]
    return F.coalesce(*[F.when(a > 0, a) for a in at])


def _moved(stack: Column, code: Column) -> Column:
    """The stack of open elements (one letter each) after a tag."""
    letter = F.lower(code)
    above = F.call_function("substring_index", stack, letter, F.lit(-1))
    closed = F.left(stack, F.octet_length(stack) - F.octet_length(above) - 1)
    return (F.when(code == "-", stack).when(code == letter, F.concat(stack, code))
             .when(F.contains(stack, letter), closed).otherwise(stack))


def _kept_flags(codes: Column, at: Column) -> Column:
    """One ``0`` or ``1`` per piece of the page (before the first tag, then
    after each): whether its text belongs to the content. ``base`` and
    ``drop`` are the stack's heights at the open container and at the
    outermost open dropped block; 0 means none. ``at`` travels in the state,
    so it is computed once a page and not once a tag."""
    dropped = [rx.HTML_CODES[t] for t in rx.HTML_DROPPED_BLOCKS]
    start = F.struct(F.lit("").alias("stack"), F.lit(0).alias("base"), F.lit(0).alias("drop"),
                     F.lit("0").alias("kept"), at.alias("at"))

    def step(s, code):
        def then(stack):
            height = F.octet_length(stack)
            base = (F.when(F.octet_length(s["kept"]) == s["at"], height)
                     .when(height < s["base"], F.lit(0)).otherwise(s["base"]))
            drop = (F.when((s["base"] > 0) & (s["drop"] == 0) & code.isin(dropped), height)
                     .when(height < s["drop"], F.lit(0)).otherwise(s["drop"]))
            flag = F.when((base > 0) & (drop == 0), F.lit("1")).otherwise(F.lit("0"))
            return F.struct(stack.alias("stack"), base.alias("base"), drop.alias("drop"),
                            F.concat(s["kept"], flag).alias("kept"), s["at"].alias("at"))
        # the element of a one-element array: the new stack is computed once
        return F.transform(F.array(_moved(s["stack"], code)), then)[0]
    return F.split(F.aggregate(codes, start, step, lambda s: s["kept"]), "")


def content_markup(h: Column) -> Column:
    """Markup inside the preferred container and outside its dropped blocks,
    NULL when there is no container (an empty one gives '')."""
    pieces = F.split(h, rx.HTML_STRUCTURE, -1)

    def kept(codes):
        flags = _kept_flags(codes, _container_at(codes))
        text = F.zip_with(pieces, flags, lambda p, f: F.when(f == "1", p))
        return F.when(_container_at(codes).isNotNull(), F.array_join(text, " "))
    return F.transform(F.array(_codes(F.regexp_extract_all(h, F.lit(rx.HTML_STRUCTURE), 0))), kept)[0]


def _character(code: Column) -> Column:
    """``8217`` or ``x2019`` -> the character; U+FFFD where there is none."""
    n = F.when(F.lower(code).startswith("x"), F.conv(F.substr(code, F.lit(2)), 16, 10)).otherwise(code).cast("int")
    bad = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    n = F.when(bad, F.lit(0xFFFD)).otherwise(n)
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _numeric_entities(c: Column) -> Column:
    codes = F.array_distinct(F.regexp_extract_all(c, F.lit(rx.NUMERIC_ENTITY), 1))
    return F.when(c.contains("&#"), F.aggregate(codes, c, lambda text, code: F.replace(
        text, F.concat(F.lit("&#"), code, F.lit(";")), _character(code)))).otherwise(c)


def decode_entities(c: Column) -> Column:
    """Named entities of the fixed list, then numeric ones, ``&amp;`` last."""
    *named, (amp, ampersand) = rx.HTML_ENTITIES
    for ent, ch in named:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    # the element of a one-element array: the chain above is evaluated once
    c = F.transform(F.array(c), _numeric_entities)[0]
    return F.replace(c, F.lit(amp), F.lit(ampersand))


def main_text(html) -> Column:
    return F.transform(F.array(strip_inert(html)), main_text_of_inert)[0]


def main_text_of_inert(h) -> Column:
    """Steps 2 to 6 on markup already stripped of comments, scripts, styles."""
    c = F.regexp_replace(content_markup(col_of(h)), rx.HTML_TAG, " ")
    return collapse_ws(decode_entities(c))


def hrefs(html) -> Column:
    """Array of ``href`` values of anchors, in document order, duplicates
    kept, quotes removed and entities decoded."""
    raw = F.regexp_extract_all(strip_inert(html), F.lit(rx.ANCHOR_HREF), 1)

    def unquote(v):
        quoted = v.startswith('"') | v.startswith("'")
        return decode_entities(F.when(quoted, F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v))
    return F.transform(raw, unquote)
