"""Rows that every operator on documents has to bear, and plain versions of the word rules."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h string, word string, spans string, digest string"
LONG = " ".join(f"w{i % 977} x{i}" for i in range(30_000))


def hard_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns whose names clash with those used inside."""
    texts = ["a b c d e f g h i j k l m n", "", None, LONG, "same text here twice", "same text here twice", "  \n\t \n", "é漢字 🎉 <s> <|endoftext|> &amp;", "one\ntwo\nthree\nfour", "one\ntwo\nthree\nfive", "x" * 70_000]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None, "size", "h", None, "spans", "digest") for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, "no id at all", None, None, 1, None, None, "w", None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
