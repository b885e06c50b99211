"""Plain-Python versions of the training-data contracts, row by row, for
small tables. They share no code with the operators."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import xxhash

UPPER = {i: i + 32 for i in range(65, 91)}


def low(text):
    return (text or "").translate(UPPER)


def ws_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def license_base(text):
    ws = alnum_words(text)
    found = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found += [(i, label) for i in range(len(ws) - len(p) + 1) if ws[i:i + len(p)] == p]
    at = [i for i, _ in found]
    return (len(ws), len(found), min(at, default=None), max(at, default=None),
            ",".join(sorted({x for _, x in found})))


def edit_distance_inside(needle, text):
    """Smallest edit distance of ``needle`` to a stretch of whole words."""
    best = len(needle)
    starts = [0] + [i + 1 for i, c in enumerate(text) if c == " "]
    for s in starts:
        row = list(range(len(needle) + 1))
        for j in range(s, len(text)):
            new = [row[0] + 1]
            for k, c in enumerate(needle, 1):
                new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (c != text[j])))
            row = new
            if j + 1 == len(text) or text[j + 1] == " ":
                best = min(best, row[-1])
            if min(row) > 6:
                break
    return best


def fingerprint(text):
    ws = ws_words(low(text))
    if not ws:
        return 0
    sh = [" ".join(ws[i:i + 4]) for i in range(len(ws) - 3)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash(rows, bits=4):
    """rows: (doc_id, text) -> list of (doc_id, fingerprint hex, component id)."""
    fps = [fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)]


def quality(text):
    ws = ws_words(text)
    t = text or ""
    lines = [x for x in t.split("\n") if ws_words(x)]
    wins = Counter(tuple(ws[i:i + 8]) for i in range(len(ws) - 7))
    hit = {j for i in range(len(ws) - 7) if wins[tuple(ws[i:i + 8])] > 1 for j in range(i, i + 8)}
    n = len(ws)
    return (n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit),
            n < 20 or 100 * len(hit) > 30 * n)


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def pii(text):
    t = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    text_ = ",".join(f"{k}:{a}:{b}" for k, a, b in out)
    return out, hashlib.sha256(text_.encode()).hexdigest()


def url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(UPPER), re.match(r"[^?#]*", rest[len(host):])[0]


def rule(host, path):
    rules = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
             ("allow", "org", "/fr/"))
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fit, key=lambda r: len(r[1] + r[2]), default=None)


def unigram(rows):
    """rows: (doc_id, text) -> per row (held_out, n_tokens, n_known, N, base score)."""
    held = [crc32(str(d).encode()) % 7 == 2 if d is not None else False for d, _ in rows]
    toks = [[*ws_words(low(t)), None] for _, t in rows]
    c = Counter(x for h, ts in zip(held, toks) if not h for x in ts)
    n, v = sum(c.values()), len(c)
    return [(h, len(ts), sum(c[x] > 0 for x in ts), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ts))
            for h, ts in zip(held, toks)]


def contamination(text, items):
    """items: (item id, text)."""
    ws = alnum_words(text)
    hit, ids = set(), set()
    for item, t in items:
        iw = alnum_words(t)
        n = min(13, len(iw))
        if not n:
            continue
        wins = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(ws) - n + 1):
            if tuple(ws[i:i + n]) in wins:
                hit.update(range(i, i + n))
                ids.add(str(item) if item is not None else "")
    return (len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
            len(hit) > 0 and 20 * len(hit) >= len(ws))


def ngram_vector(text, dim):
    """Square-rooted, length-1 counts of hashed 1- to 3-byte grams, gram by gram."""
    low = text.encode().lower()
    counts = [0] * dim
    for n, mult in ((1, 40503), (2, 2654435761), (3, 2246822519)):
        for i in range(len(low) - n + 1):
            code = sum(byte << 8 * (n - 1 - k) for k, byte in enumerate(low[i:i + n]))
            counts[((code * mult + n) % 2 ** 32 >> 16) % dim] += 1
    size = math.sqrt(sum(counts))
    return [math.sqrt(c) / size if size else 0.0 for c in counts]


def language(text, model):
    """(language, score) by the model's weights: the family that scores best,
    then one vote per pair of its languages, margins deciding ties."""
    x = [*ngram_vector(text, model.dim), 1.0]

    def dot(w):
        return sum(float(a) * b for a, b in zip(w, x))

    def squash(v):
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, v))))

    scored = [(dot(w), f) for w, f in zip(model.family_w, model.families)]
    top, family = max(scored, key=lambda s: s[0])
    sure = 1.0 if len(scored) == 1 else squash(4 * top)
    langs = [v for v in model.langs if v in model.members[family]]
    if len(langs) == 1:
        return langs[0], sure
    votes, margins = {v: 0 for v in langs}, {v: 0.0 for v in langs}
    for i, a in enumerate(langs):
        for b in langs[i + 1:]:
            m = dot(model.pair_w[a, b])
            votes[a if m >= 0 else b] += 1
            margins[a] += m
            margins[b] -= m
    best = sorted(langs, key=lambda v: (-votes[v], -margins[v], v))[0]
    return best, sure * squash(4 * margins[best] / (len(langs) - 1))
