"""Spelling variants against comparison of all words with all others."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from seriesloom.llm import spelling
from seriesloom.llm.queries import op13_spelling

from . import odd


def plain_words(rows, shortest=6, fewest=5):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= fewest}


def plain_distance_one(a, b):
    if a == b:
        return False
    for k in range(len(b) + 1):
        if k < len(b) and a == b[:k] + b[k + 1 :]:
            return True
        if len(a) == len(b) and k < len(b) and a[:k] == b[:k] and a[k + 1 :] == b[k + 1 :]:
            return True
        if k <= len(a) and len(a) == len(b) + 1 and k < len(a) and a[:k] + a[k + 1 :] == b:
            return True
    return False


def plain_forms(words, factor=5):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and plain_distance_one(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= factor * words[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, words[w], len(near[w]), form.get(w), words[form[w]] if w in form else None, root))
    return sorted(out)


def rows_of(frame):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in frame.collect())


@pytest.fixture(scope="module")
def crowded():
    """Many words that share halves, with chains of forms, ties, repeated letters and letters beyond ASCII."""
    rng = random.Random(17)
    words = {}
    for start in ("unter", "aaaa", "strasse", "éléph"):
        for _ in range(120):
            words[start + "".join(rng.choice("abéè") for _ in range(rng.randint(2, 4)))] = rng.choice((5, 5, 6, 30, 31, 200, 1100, 6000))
    words |= {"x" * k: 5 * 6 ** (k - 6) for k in range(6, 12)}
    words |= {"y" * 40: 5, "y" * 41: 25, "y" * 20 + "z" + "y" * 20: 5, "y" * 70: 7, "lonely": 9}
    return words


@pytest.mark.parametrize("together", [4096, 3])
def test_forms_of_crowded_words(spark, crowded, together):
    frame = spark.createDataFrame(list(crowded.items()), "word string, n long").repartition(3)
    assert rows_of(spelling.variant_forms(frame, together=together)) == plain_forms(crowded)


def test_words_of_odd_rows(spark):
    rows = [(k, t) for k, t, _ in odd.texts()] * 5
    got = {r.word: r.n for r in spelling.word_table(odd.frame(spark, [(k, t, None) for k, t in rows])).collect()}
    assert got == plain_words(rows)
    assert spelling.spelling_variants(odd.frame(spark, [])).count() == 0


def test_misspelt_and_parts(monkeypatch):
    monkeypatch.setattr(spelling, "PART_BYTES", 7)
    text = "Straßenbahn÷über ×mal wortwörtlich " * 5
    assert [r for p in spelling._parts(text.encode()) for r in spelling._RUN.findall(p)] == spelling._RUN.findall(text.encode())
    hits = [k for k in range(2_000) if spelling.misspelt("wörter".encode(), f"{k}:".encode()) != "wörter".encode()]
    assert hits == [k for k in range(2_000) if zlib.crc32(f"{k}:wörter".encode()) % 199 == 0] and hits


def test_one_edit_of_matrix_and_plain():
    rng = random.Random(2)
    words = ["".join(rng.choice("abé") for _ in range(rng.choice((6, 7, 31, 32, 33, 40)))) for _ in range(60)]
    words += [w[:k] + w[k + 1 :] for w in words for k in (0, 3, len(w) - 1)] + [w[:5] + "q" + w[6:] for w in words]
    import numpy as np

    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    letters = spelling._letters(words)
    got = spelling.one_edit(letters, letters, a, b, words, words)
    assert got.tolist() == [plain_distance_one(words[i], words[j]) for i, j in zip(a, b)] == [spelling.is_one_edit(words[i], words[j]) for i, j in zip(a, b)]


def test_query_against_all_pairs(spark):
    docs = odd.documents(spark).collect()
    want = plain_forms(plain_words([(r.doc_id, r.text) for r in docs]))
    got = op13_spelling(spark, odd.SF)
    assert rows_of(got) == want and any(r[3] for r in want)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
