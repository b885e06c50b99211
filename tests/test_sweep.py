"""The one-pass name sweep against one regular expression per name, in order."""

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kbpipe.functions import redact as R
from kbpipe.functions import regexes as rx

WORDS = ["Ann", "Bo", "Cy", "Ann1", "bo", "Éa", "Ann_Bo", "D"]
GAPS = [" ", "  ", "\t", " ", ", ", ". ", "", "[", "]-"]


def _slow(text, names):
    for n in names:
        text = re.sub(rf"(?<!\w){re.escape(n)}(?!\w)", rx.NAME_TOKEN, text)
    return text


def _cut(text):
    return re.findall(r"\w+", text), re.split(r"\w+", text)


_name = st.lists(st.tuples(st.sampled_from(["Ann", "Bo", "Cy"]), st.sampled_from(GAPS[:4])), min_size=1, max_size=4) \
    .map(lambda ps: "".join(w + g for w, g in ps[:-1]) + ps[-1][0])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from(GAPS)), max_size=25), st.lists(_name, max_size=6))
def test_one_pass_equals_one_pattern_per_name(pieces, names):
    text = "".join(w + g for w, g in pieces)
    names = sorted(set(names), key=lambda n: (-len(n), n))
    words, gaps = _cut(text)
    assert R.sweep_words(words, gaps, names, [_cut(n)[0] for n in names]) == _slow(text, names)


def test_column_equals_one_pattern_per_name(spark):
    rows = [("Ann Bo met Bo Cy. Ann Bo Cy left; Bo", ["Ann Bo", "Bo Cy", "Bo"]), ("Ann\tBo Ann  Bo AnnBo Ann_Bo", ["Ann\tBo", "Ann"]),
            ("no names", []), (None, ["Ann"]), ("", ["Ann"]), ("Ann", None), ("[NAME_REDACTED] Ann é Anné", ["Ann"]),
            ("Bo " * 5000, ["Bo Bo Bo", "Bo Bo"])]
    df = spark.createDataFrame(rows, "text string, names array<string>")
    pattern = F.aggregate("names", F.col("text"), lambda t, n: F.regexp_replace(
        t, F.concat(F.lit(rx.BL + r"\Q"), n, F.lit(r"\E" + rx.BR)), F.lit(rx.NAME_TOKEN)))
    got = df.select(R.sweep_names("text", "names").alias("a"),
                    F.when(F.size("names") > 0, pattern).otherwise(F.col("text")).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]


def test_many_names_take_linear_time(spark):
    def word(i):
        return "N" + "".join(chr(97 + int(d)) for d in str(i))

    n = 100_000
    names = [f"{word(i)} {word(i + 1)}" for i in range(0, n)]
    text = ". ".join(names[::-1])
    words, gaps = _cut(text)
    began = time.time()
    out = R.sweep_words(words, gaps, sorted(names, key=lambda x: (-len(x), x)), [x.split() for x in sorted(names, key=lambda x: (-len(x), x))])
    assert time.time() - began < 20
    assert out.count(rx.NAME_TOKEN) == n and "N" not in out.replace(rx.NAME_TOKEN, "")
    same = "Aa " * 60_000        # one name over all words: every place starts it
    assert R.sweep_words(*_cut(same), ["Aa " * 29_999 + "Aa"], [["Aa"] * 30_000]).count(rx.NAME_TOKEN) == 2
