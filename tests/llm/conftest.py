import pytest

WORDS = [f"w{chr(97 + i % 26)}{i}" for i in range(400)]


def passage(start, n, step=1):
    return " ".join(WORDS[(start + i * step) % len(WORDS)] for i in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Copies, near copies, benchmark passages, repeated rows and lines, odd texts, and columns that clash by name."""
    base = passage(0, 60)
    near = base.replace("wd3 ", "changed ", 1)
    item = passage(100, 14, 3)
    rows = [
        (1, base, 0.5), (2, base.upper(), 0.5), (3, near, 0.5), (4, passage(200, 60, 7), 0.1), (4, passage(200, 60, 7), 0.1),
        (5, f"before {item} after\nsecond line here", None), (6, item, None), (7, "", None), (8, None, None), (9, " \t\n", None),
        (None, passage(50, 30, 11), None), (10, "one two", None), (11, "One  two", None), (12, "idiot clown", 9.0),
        (13, "line one is long enough to hold words\nline one is long enough to hold words\n\nshort", None),
        (14, (passage(0, 400) + " ") * 20, None), (15, "<|endoftext|> 日本語 🎉 é\x00 don't 123", None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, score double").selectExpr(
        "doc_id", "text", "'en' as lang", "'s' as source", "score", "1 as n_hit", "2 as node", "3 as words", "length(text) as n_chars"
    )


@pytest.fixture(scope="session")
def bench(spark):
    rows = [(1, passage(100, 14, 3)), (2, "one two"), (3, ""), (4, None), (None, passage(0, 20)), (5, passage(100, 14, 3)), (5, passage(100, 14, 3))]
    return spark.createDataFrame(rows, "item_id long, text string")
