"""Awkward document tables that every operator must take."""

from __future__ import annotations

EDGES = [
    (1, "plain words in one line", "x"),
    (2, None, "x"),
    (3, "", None),
    (4, " \t\n ", "y"),
    (5, "plain words in one line", "z"),
    (5, "plain words in one line", "z"),
    (6, "word " * 30_000, "long"),
    (7, "a" * 50_000, "long"),
    (8, "é漢😀\u0085\x1c\x01\x02 tail\xa0end", "odd"),
    (9, "line one\nline two\n\nline three\nline one\nline two\n", "y"),
]
#: Columns whose names operators use themselves.
CLASH = "doc_id long, text string, score string"


def edges(spark):
    return spark.createDataFrame(EDGES, CLASH).repartition(3)


def empty(spark):
    return spark.createDataFrame([], CLASH)
