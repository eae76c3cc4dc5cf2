"""Small fixtures with every awkward row the operators must take."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int, lang: str = "en") -> str:
    """Invented words, the same for the same seed."""
    import random

    rng = random.Random(f"{lang}{seed}")
    parts = {"en": ["the", "er", "on", "tion", "ing"], "de": ["sch", "ung", "ein", "über", "ich"]}[lang]
    return " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(words))


def awkward(spark):
    """Nulls in any column, empty and blank texts, repeated rows, copies, a long text, one long word."""
    rows = [
        (1, prose(1, 60), "en", "a", 1), (2, prose(1, 60), "en", "a", 1), (2, prose(1, 60), "en", "a", 1),
        (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \n\t \n", "de", None, 5), (None, prose(2, 40), None, "b", 3),
        (None, prose(2, 40), None, "b", 3), (6, "?! 12 #", "de", "b", 7), (7, prose(3, 3000), "en", "a", 9),
        (8, "x" * 3000, "de", "a", 9), (9, prose(1, 60) + "\n" + prose(9, 30, "de"), "de", "c", 9), (10, "Ünï 日本語 🙂 e\u0301", "de", "c", 9),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)
