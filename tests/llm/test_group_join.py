from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np

from seriesloom.llm import group_join

from . import odd

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(rows, width=5):
    out = []
    for _, text in rows:
        words = _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out.append({tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set())
    return out


def brute(rows, percent=80):
    own = sets(rows)
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    by_shingle = defaultdict(set)
    for k, s in enumerate(own):
        for x in s:
            by_shingle[x].add(k)
    for k, s in enumerate(own):
        for j in {j for x in s for j in by_shingle[x] if j < k}:
            if 100 * len(s & own[j]) >= percent * len(s | own[j]):
                parent[find(k)] = find(j)
    least = defaultdict(list)
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[find(k)].append(key)
    return sorted((str(key), len(own[k]), str(min(least[find(k)], default=None) if own[k] else key)) for k, (key, _) in enumerate(rows))


def told(frame):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in frame.collect())


def test_odd_rows(spark):
    rows = [(i, t) for i, t, _ in odd.texts()]
    assert told(group_join.similarity_classes(odd.frame(spark))) == brute(rows)
    assert group_join.similarity_classes(odd.frame(spark, [])).count() == 0
    kept = group_join.keep_one(odd.frame(spark))
    assert kept.columns == odd.frame(spark).columns
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    heads = {c for i, _, c in brute(rows) if i != "None" and i == c}
    # one row for each class; the two rows of key 8 and the null key's copy go, rows without shingles stay
    assert sorted(i for i, _ in got) == sorted(["None", *heads])


def test_rows_are_told_apart_by_their_texts(spark):
    rng = random.Random(3)
    one, two, three = (" ".join(f"{c}{rng.randint(0, 99)}" for _ in range(30)) for c in "abc")
    rows = [(1, one, "en"), (1, two, "en"), (2, two, "en"), (None, three, "en"), (None, three, "en"), (3, one, "en"), (4, "", "en"), (4, "", "en"), (None, None, "en")]
    got = sorted((str(r.doc_id), r.text or "") for r in group_join.keep_one(odd.frame(spark, rows)).collect())
    assert got == sorted([("1", one), ("1", two), ("None", three), ("4", ""), ("4", ""), ("None", "")])
    assert group_join.keep_one(odd.frame(spark, [])).count() == 0


def test_hot_groups(spark, monkeypatch):
    """Many copies, followers and queries of one text: the hot ways give the same classes."""
    from seriesloom.llm import shared

    monkeypatch.setattr(shared, "HOT_LEAST", 3)
    monkeypatch.setattr(shared, "HOT_SHARE", 20)
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 400)}" for _ in range(80)]
    rows = [(k, " ".join(words)) for k in range(40)]
    for k in range(120):
        changed = list(words)
        for _ in range(rng.randint(0, 3)):
            changed[rng.randrange(80)] = f"x{rng.randint(0, 9)}"
        rows.append((100 + k, " ".join(changed)))
    rows += [(500 + k, "") for k in range(30)] + [(None, " ".join(words))] * 5
    rows += [(600 + k, " ".join(words[:40] + [f"y{rng.randint(0, 99)}" for _ in range(rng.randint(2, 40))])) for k in range(60)]
    rng.shuffle(rows)
    assert told(group_join.similarity_classes(odd.frame(spark, [(i, t, None) for i, t in rows]))) == brute(rows)


def test_codes_keep_the_order_of_counts():
    counts = np.array([0, 1, 2, 5, 255, 256, 10_000, 10**6, 10**9, 10**11])
    assert (np.diff(group_join._codes(counts).astype(int)) >= 0).all() and group_join._codes(counts).max() < 255
    assert group_join._codes(np.array([1])) < group_join._codes(np.array([2]))


def test_chains_and_borders(spark):
    """Texts at and about the threshold, chained so that ends link only through the middle."""
    rng = random.Random(9)
    rows, key = [], 100
    for _ in range(25):
        words = [f"w{rng.randint(0, 60)}" for _ in range(rng.choice([5, 6, 14, 29, 54]))]
        for _ in range(rng.randint(1, 6)):
            rows.append((key, " ".join(words)))
            key += 1
            words = [*words[rng.randint(0, 2) :], *(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 3)))]
    for percent in (80, 55):
        assert told(group_join.similarity_classes(odd.frame(spark, [(i, t, None) for i, t in rows]), percent=percent)) == brute(rows, percent)


def test_documents(spark):
    docs = odd.documents(spark)
    assert told(group_join.similarity_classes(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
