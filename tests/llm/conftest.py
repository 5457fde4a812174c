import pytest

LONG = " ".join(f"word{i % 9973}" for i in range(40_000))
#: Nulls, empty, blank and very long texts, ties and repeated rows.
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, None),
    (3, ""),
    (4, " \t\n \x0b"),
    (5, LONG),
    (6, "a"),
    (None, "A text without an id, which is still a text of several words."),
    (7, "Ünïcode — «textes» 漢字かな 🙂 with odd spaces\x1cand\x85marks"),
    (8, "\n\nline one is long enough to count\nline one is long enough to count \n\nLINE ONE is long enough to count"),
    (9, "line one is long enough to count\nother"),
    (10, "\tline one is long enough to count"),
]
EXTRA = ["score", "n_lines", "sig", "_lines", "words", "hit", "tokens", "kept", "row", "dense", "_gone", "toxic", "held_out", "labels", "doc"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """DOCS with further columns whose names operators use, too."""
    rows = [(i, t, *(f"x{k}" for k in range(len(EXTRA)))) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in EXTRA))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
