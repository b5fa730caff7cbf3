"""Tables and texts that the operators' tests share."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, size int, start string"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def docs_of(spark, texts, sources=None):
    """Documents with null ids, null texts, repeats, and extra columns whose names clash with outputs."""
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], 1, 9, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, None, None, None, None, None, None), *rows[:1]], DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


TEXTS = ["one two three four five six", "", " \n ", "zwölf Boxkämpfer jagen Viktor  quer über den Sylter Deich", "word " * 3000, "<|endoftext|> token = \"abc123def\"", "a\nb\n\nc é ü 日本語 🙂 x", "x"]
