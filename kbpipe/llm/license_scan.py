"""License scans: fuzzy search for short notices.

Each notice allows ``errors`` character edits. It is cut into ``errors + 1``
pieces; by the pigeonhole principle any text within that distance holds one
piece unchanged. The exact pieces (seeds) locate candidate places, and the
``regex`` library's bounded-error matching verifies the edits there and
reports the span. Row-local: no shuffle, one pass over the table.
"""

from __future__ import annotations

from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from kbpipe.llm.common import arrow_map, texts, words

# Fixed values of the query contract: phrase -> label.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# The method's own notices: (label, normalised phrase, character edits allowed).
NOTICES = (
    ("apache", "licensed under the apache license version 2 0", 4),
    ("bsd", "redistribution and use in source and binary forms", 5),
    ("bsl", "boost software license version 1 0", 3),
    ("cc-by", "licensed under cc by", 1),
    ("cc-by-nc", "licensed under cc by nc", 1),
    ("cc-by-sa", "licensed under cc by sa", 1),
    ("cc0", "dedicated to the public domain", 3),
    ("gpl", "licensed under the gnu general public license", 4),
    ("isc", "permission to use copy modify and or distribute this software", 5),
    ("mit", "released under the mit license", 2),
    ("mit", "permission is hereby granted free of charge to any person", 5),
    ("mpl", "subject to the terms of the mozilla public license", 4),
    ("noncommercial", "for non commercial use only", 2),
    ("proprietary", "unauthorized copying of this file is strictly prohibited", 5),
    ("reserved", "all rights reserved", 2),
    ("unlicense", "free and unencumbered software released into the public domain", 5),
)

SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
          "base_labels string, labels string, score double, spans array<string>")


def pieces(phrase: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of near equal length: (offset in phrase, piece)."""
    n = errors + 1
    cuts = [i * len(phrase) // n for i in range(n + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=None)
def _compiled(notices: tuple) -> list:
    """Per notice: label, phrase, errors, seeds as (offset, text, bytes) and
    the pattern, which takes the first match and then betters its fit (the
    best of a whole stretch would pass over weaker ones before it)."""
    out = []
    for label, phrase, errors in notices:
        pat = regex.compile(rf"(?<![^ ])(?:{regex.escape(phrase)}){{e<={errors}}}(?![^ ])",
                            regex.ENHANCEMATCH)
        seeds = [(off, s, s.encode()) for off, s in pieces(phrase, errors)]
        out.append((label, phrase, errors, seeds, pat))
    return out


def _places(text: str, seed: str):
    at = text.find(seed)
    while at >= 0:
        yield at
        at = text.find(seed, at + 1)


def _windows(text: str, phrase: str, errors: int, seeds) -> list[list[int]]:
    """Merged stretches of ``text`` that can hold the notice."""
    found = sorted((at - off - errors, at - off + len(phrase) + errors)
                   for off, seed, _ in seeds for at in _places(text, seed))
    out: list[list[int]] = []
    for a, b in found:
        # one more character on either side for the word boundary rule
        a, b = max(0, a - 1), min(len(text), b + 1)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def find_notices(norm: bytes, notices: tuple = NOTICES) -> list[tuple[str, int, int, int, int]]:
    """(label, first char, end char, edits, phrase length) of every notice in
    a normalised text (words joined by one space); a match fills whole words."""
    out, text = [], None
    for label, phrase, errors, seeds, pat in _compiled(notices):
        if not any(raw in norm for _, _, raw in seeds):
            continue
        text = norm.decode() if text is None else text
        for a, b in _windows(text, phrase, errors, seeds):
            at = a
            while (m := pat.search(text, at, b)) is not None:
                s, e = m.span()
                while s < e and text[s] == " ":      # an edit may add a space at an end
                    s += 1
                while e > s and text[e - 1] == " ":
                    e -= 1
                out.append((label, s, e, sum(m.fuzzy_counts), len(phrase)))
                at = max(m.end(), at + 1)
    return out


def find_phrases(norm: bytes, phrases: dict[str, str]) -> list[tuple[str, int]]:
    """(label, byte offset) of every place where a phrase's words stand."""
    out, padded = [], b" " + norm + b" "
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at = padded.find(needle)
        while at >= 0:
            out.append((label, at))
            at = padded.find(needle, at + 1)
    return out


def word_numbers(norm, space, places) -> dict[int, int]:
    """Word number of every place, in one pass over the text."""
    out, at, n = {}, 0, 0
    for place in sorted(set(places)):
        n += norm.count(space, at, place)
        at = place
        out[place] = n
    return out


def scan_text(raw: bytes, notices: tuple = NOTICES, phrases: dict[str, str] = BASE_PHRASES) -> dict:
    """All results for one text; see ``scan_licenses``."""
    ws = words(raw)
    norm = b" ".join(ws)
    base = find_phrases(norm, phrases)
    starts = word_numbers(norm, b" ", (at for _, at in base)).values()
    fuzzy = find_notices(norm, notices)
    spans, best = [], 1.0 if base else 0.0
    if fuzzy:
        word = word_numbers(norm.decode(), " ", (at for _, s, e, _, _ in fuzzy for at in (s, e)))
        for label, s, e, edits, size in fuzzy:
            spans.append((word[s], word[e], label, edits))
            best = max(best, 1.0 - edits / size)
    base_labels = sorted({label for label, _ in base})
    return {"n_words": len(ws), "n_base": len(base),
            "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(base_labels),
            "labels": ",".join(sorted({*base_labels, *(x[0] for x in fuzzy)})),
            "score": best,
            "spans": [f"{label}:{a}:{b}:{edits}" for a, b, label, edits in sorted(set(spans))]}


def scan_licenses(docs: DataFrame, notices: tuple = NOTICES,
                  phrases: dict[str, str] = BASE_PHRASES) -> DataFrame:
    """License notices of every whole ``text``.

    Per row: word count, base phrase places (``n_base``, ``first_word``,
    ``last_word``), ``base_labels``, ``labels``, ``score`` (1 for a base
    phrase, else 1 - edits / length of the best notice, 0 without any) and
    ``spans`` as ``label:first word:last word:edits``.

    Defined cases: NULL and empty texts have no words, empty labels, NULL
    places and score 0; NULL and repeated ids keep their rows; other columns
    are ignored, whatever they are called; an empty table gives an empty one.
    """
    keys = [k.strip().split(" ")[0] for k in SCHEMA.split(", ")][1:]

    def run(batch):
        rows = [scan_text(t, notices, phrases) for t in texts(batch, "text")]
        return {"doc_id": batch.column("doc_id"), **{k: [r[k] for r in rows] for k in keys}}

    return arrow_map(docs.select("doc_id", "text"), run, SCHEMA)
