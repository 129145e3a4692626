"""Phrases against a plain count of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from seriesloom.llm import collocations
from seriesloom.llm.queries import op11_collocations

from . import odd


def plain(rows, longest=5, least=3, top=2000):
    """(lang, text) rows -> (lang, rank, phrase, a, l, r, n, score)."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split("[ \t]", piece) if w]
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    counts[lang][tuple(words[k : k + size])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {(q[i:j], a) for q, a in found.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q)}
        ranked = []
        for p, a in found.items():
            if (p, a) in inside:
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def told(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = ["The", "of", "und", "straße", "Éa", "x", "9", "北京", "\x00", "New", "York"]
    made = []
    for _ in range(150):
        body = ""
        for _ in range(rng.randint(0, 60)):
            body += rng.choice(["New York city hall", rng.choice(words), rng.choice(words), f"rare{rng.randint(0, 99999)}"]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"])
        made.append((rng.choice(["en", "de", None, ""]), body))
    return made + [("en", None), ("en", ""), ("de", " .,; \t\n")] + [("en", "so it goes on and on and on")] * 40


@pytest.mark.parametrize("dictionary, held", [(1 << 21, 1 << 19), (3, 1 << 19), (1 << 21, 50)])
def test_small_texts(spark, rows, dictionary, held, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", held)
    frame = spark.createDataFrame([(k, t, g, "s", 1, "c", 1, 2, 0.5, "k", 3) for k, (g, t) in enumerate(rows)], odd.SCHEMA).repartition(4)
    assert told(collocations.mine_phrases(frame, least=3, dictionary=dictionary)) == plain(rows)
    assert told(collocations.mine_phrases(frame, least=2, longest=3, top=7, dictionary=dictionary)) == plain(rows, 3, 2, 7)


def test_odd_rows(spark):
    table = odd.texts() * 3
    got = collocations.mine_phrases(odd.frame(spark, table), least=3)
    assert told(got) == plain([(g, t) for _, t, g in table])
    assert collocations.mine_phrases(odd.frame(spark, [])).count() == 0


def test_runs_over_ranges(spark):
    """One phrase in all ranges, whose windows differ behind it."""
    rng = random.Random(1)
    rows = [("en", " ".join(["hot pair"] + [f"w{rng.randint(0, 30)}" for _ in range(3)])) for _ in range(2_000)]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(8)
    assert told(collocations.mine_phrases(frame, least=5)) == plain(rows, least=5)


def test_many_ranges(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "RANGE_KEYS", 40)
    monkeypatch.setattr(collocations, "HELD", 200)
    monkeypatch.setattr(collocations, "MOST_SAMPLE", 300)
    frame = spark.createDataFrame([(g, t) for g, t in rows], "lang string, text string").repartition(4)
    assert told(collocations.mine_phrases(frame, least=2)) == plain(rows, least=2)


def test_radix_order_and_packing():
    rng = np.random.default_rng(4)
    keys, counts = collocations.sum_equal(rng.integers(0, 4, (900, 5), dtype=np.uint8))
    back = collocations.unpack_block(collocations.pack_block(keys, counts), 5)
    assert (back[0] == keys).all() and (back[1] == counts).all() and counts.sum() == 900
    assert (np.sort(keys.view("S5").ravel()) == keys.view("S5").ravel()).all()
    keys = rng.integers(0, 3, (500, 7), dtype=np.uint8)
    assert [bytes(k) for k in keys[collocations.radix_order(keys)]] == sorted(bytes(k) for k in keys)
    coder = collocations.Coder.__new__(collocations.Coder)
    coder.sieve, coder.width = None, 3
    ids = rng.integers(0, 1 << 24, (50, 5)).astype(np.uint64)
    assert (coder.unpack(coder.pack(ids)) == ids).all()


def test_query(spark):
    got = op11_collocations(spark, odd.SF)
    docs = odd.documents(spark).collect()
    assert told(got) == plain([(r.lang, r.text) for r in docs], least=100)
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
