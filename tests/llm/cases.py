"""Documents with every odd case, for all operators."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
_LONG = " ".join(f"word{i % 97} and{i % 13}" for i in range(4000))
_PASSAGE = " ".join(f"passage{i}" for i in range(60))
ROWS = [
    (0, "The quick brown fox. " * 3 + _PASSAGE, "en", "a", 1), (1, "Other words come first here, then: " + _PASSAGE + " and an end", "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \t\n\x0b\x0c\r ", "en", None, 7),
    (5, "one", "en", "a", 3), (6, "one two", "de", "a", 7), (7, _LONG, "en", "hot", len(_LONG)), (8, _LONG, "en", "hot", len(_LONG)), (8, _LONG, "en", "hot", len(_LONG)), (9, _LONG + " changed", "en", "hot", 0),
    (10, "a b c d e f g h i j " * 6, "fr", "hot", 0), (11, "a " * 45, "fr", "hot", 0), (12, "Üch bēlich \U0001d400 𝔘𝔫𝔦 naïve café ▁ ▁▁ x  y", "de", "b", 0), (13, "mail bob.smith@example.com card 4111111111111111 on 2024-02-29 from 10.0.0.1", "en", "b", 0), (None, "no id at all, but text", "en", "b", 0),
    (None, "no id at all, but text", "en", "b", 0), (-5, "negative id, same words as no other text", "es", "b", 0), (2**62, "large id <|im_start|> <|endoftext|> &amp; # $ %", "en", "b", 0), (14, "trailing space and line \n\n", "en", "b", 0), (15, "12345 !!! ???", "en", "b", 0),
    (16, "THE QUICK BROWN FOX. " * 20, "en", "b", 0), (17, "the quick brown fox. " * 20, "en", "b", 0),
    (18, "Para one.\n\nPara two.\n\n", "en", "b", 0), (19, "if x:\n    y = 1\n\n\n    z\r\n\r\n\u3000", "en", "b", 0), (20, "né" * 3000 + "𝔘x" * 500, "fr", "b", 0),
]


def documents(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)


def clashing(docs):
    """With extra columns named like what operators use inside."""
    from pyspark.sql import functions as F

    names = ("id", "mark", "fp", "h", "w", "x", "r", "tail", "task", "piece", "length", "kept", "score", "fingerprint", "n_words", "anchor", "place")
    return docs.withColumns({c: F.lit("clash") for c in names})
