"""Documents with every awkward case, and plain versions of what the operators compute."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double, shard int, text_key string"


def low(text):
    return (text or "").encode().lower().decode()


def word_list(text):
    return WORD.findall(low(text))


def documents(spark, texts, start=0):
    """A documents table whose extra columns clash with names that operators use inside."""
    rows = [(start + i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, len(t or ""), "x", 0.5, 3, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [
    None,
    "",
    " \n\t ",
    "!!! ???",
    "one",
    "Ünïcödé wörds, and 日本語 text; token = \"abcdef123\"",
    "x" * 50_000,
    "9" * 3_000,
    "+1" * 2_000,
    "a@b.c " * 500,
    "the quick brown fox jumps over the lazy dog again and again " * 300,
    "same text same text",
    "same text same text",
]
