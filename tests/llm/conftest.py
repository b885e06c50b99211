import pytest

LONG = " ".join(f"w{i % 997}" for i in range(60_000))

EDGE = [
    (1, "The quick brown fox jumps over the lazy dog " * 5, "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog " * 5, "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (None, "no id here but some words anyway, and more of them", "en", "a"),
    (None, None, None, None),
    (4, " \t\n\x0b\x0c\r ", "de", "b"),
    (5, "\u00a0\u2003 unicode \U0001F600 \u00e9\u00c9 \u0130", "fr", "b"),
    (6, LONG, "en", "a"),
    (7, "x" * 50_000, "en", "a"),
    (8, "12345 67890", "en", "c"),
    (-9, "one", "xx", "c"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Rows with NULLs, empty and long texts, repeats, and extra columns whose
    names clash with those of results."""
    schema = ("doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, "
              "kept string, contaminated string, pii string, component_id string, words string, host string, "
              "uid string, grp string, held_out string, score string")
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, *["clash"] * 11) for r in EDGE], schema)


@pytest.fixture(scope="session")
def edge_rows():
    return EDGE


def by_row(df):
    """Sorted plain tuples (NULL first)."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: [(x is not None, x) for x in t])
