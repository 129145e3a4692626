"""Odd rows for every operator: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, c0 string, word long, node int, _score double, key string, piece int"


def texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, lang); the same every time."""
    rng = random.Random(11)
    words = ["river", "stone", "Morgen", "Über", "naïve", "qu'il", "mañana", "token", "x1", "été", "Ж", "北京", "a", "I", "end."]
    long_text = " ".join(rng.choice(words) for _ in range(6000))
    same = " ".join(rng.choice(words) for _ in range(60))
    near = same.split(" ")
    near[-1] = "changed"
    rows: list[tuple[int | None, str | None, str | None]] = [
        (1, None, "en"), (2, "", "en"), (3, "   \t\n\x0b\x0c\r ", None), (4, "one two", "en"), (5, "One TWO", "en"), (6, long_text, "de"),
        (7, same, "en"), (8, same, "en"), (8, same, "en"), (9, " ".join(near), "en"), (None, same, "en"), (None, None, None),
        (10, "x" * 30_000, "en"), (11, "▁▁ marks ▁ and  double   spaces ", "fr"), (12, "<|endoftext|> special <s> </s> ids", "en"),
        (13, "no break spaces 😀 \x00 nul", "es"), (-5, "negative id here", "en"), (14, "12345 !!! ???", None), (15, same + " " + same, "en"),
        (16, " lead and trail ", "en"), (17, "\n\nlines\nlines\n", "en"), (18, "ÀÉÎ õü", "pt"), (19, long_text[:40_000], "de"), (20, "ab́c ﬁ Ａ", "en"),
    ]
    return rows


def frame(spark, rows=None):
    """The rows as a table of documents with further columns whose names clash with inner ones."""
    rows = texts() if rows is None else rows
    full = [(i, t, g, "s", None if t is None else len(t), "c", 1, 2, 0.5, "k", 3) for i, t, g in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
