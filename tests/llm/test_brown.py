from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from seriesloom.llm import brown_lm, shared

from . import odd

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def base(rows):
    """(n_tokens, n_known, N, base score) of every row by the formula alone."""
    counts, held = Counter(), []
    for key, text in rows:
        held.append(key is not None and zlib.crc32(str(key).encode()) % 7 == 2)
        if not held[-1]:
            counts.update([*_WORD.findall(lower(text or "")), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for (key, text), h in zip(rows, held):
        tokens = [*_WORD.findall(lower(text or "")), None]
        out.append((str(key), h, len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)))
    return out


def same(got, want):
    key = lambda r: (r[0], r[2], round(r[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))


def told(frame):
    return [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in frame.collect()]


def test_base_of_odd_rows(spark):
    rows = [(i, t) for i, t, _ in odd.texts()]
    same(told(brown_lm.score_texts(odd.frame(spark))), base(rows))
    # with few held words, counts come by the join
    same(told(brown_lm.score_texts(odd.frame(spark), held_words=4, context_words=4, head_words=2)), base(rows))
    assert brown_lm.score_texts(odd.frame(spark, [])).count() == 0


def scores(frame, **more):
    return sorted((str(r.doc_id), round(r.score, 6)) for r in brown_lm.score_texts(frame, **more).collect())


def test_joined_words_score_as_held_ones(spark):
    small = {"context_words": 4, "head_words": 3}
    one, two = (scores(odd.frame(spark), held_words=n, **small) for n in (1000, 4))
    assert one == two


def test_model_against_the_formula(spark, monkeypatch):
    """The model's score from its classes alone, word by word."""
    rows = [(i, t) for i, t, _ in odd.texts() if i is not None and len(t or "") < 5000]
    learned = {}
    original = brown_lm.cluster_words

    def spy(*args, **more):
        words, known = original(*args, **more)
        learned["of"] = {r.word: r.cls for r in words.collect()}
        learned["n"] = {r.word: r.n_train for r in words.collect()}
        return words, known

    monkeypatch.setattr(brown_lm, "cluster_words", spy)
    got = {r.doc_id: r.score for r in brown_lm.score_texts(odd.frame(spark, [(i, t, None) for i, t in rows]), head_words=5, context_words=20).collect()}

    def tokens(text):
        words = shared.Words([(text or "").encode()])
        return [*words.hash.astype(np.int64).tolist(), None]

    taught = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in taught for w in t)
    ended = counts.pop(None)
    of, k = learned["of"], brown_lm.CLASSES
    assert learned["n"] == dict(counts) and set(of.values()) <= set(range(k))
    pairs = np.zeros((k + 1, k + 1))
    for t in taught:
        for a, b in zip([None, *t[:-1]], t):
            pairs[k if a is None else of[a], k if b is None else of[b]] += 1
    once, twice = (sum(c == n for c in counts.values()) for n in (1, 2))
    d = min(max(once / (once + 2 * twice), 0.1), 0.9)
    size, types = Counter(), Counter()
    for w, c in counts.items():
        size[of[w]] += c
        types[of[w]] += 1
    token = np.array([size[c] for c in range(k)] + [ended], float)
    share = (token + 1) / (token.sum() + k + 1)
    trans = (pairs + brown_lm.PRIOR * share) / (pairs.sum(axis=1, keepdims=True) + brown_lm.PRIOR)
    left = np.array([d * types[c] / size[c] if size[c] else 1.0 for c in range(k)] + [0.0])
    new = share * left / (share * left).sum()
    # every state's outcomes sum to one
    for row in (*trans, new @ trans):
        seen = sum(row[of[w]] * (c - d) / size[of[w]] for w, c in counts.items())
        assert abs(seen + row[k] + row @ left - 1) < 1e-9
    for i, t in rows:
        state, total = np.eye(k + 1)[k], 0.0
        for w in tokens(t):
            row = state @ trans
            if w is None:
                total += math.log10(row[k])
            elif w in of:
                total += math.log10(row[of[w]] * (counts[w] - d) / size[of[w]])
                state = np.eye(k + 1)[of[w]]
            else:
                total += math.log10(row @ left)
                state = new
        assert abs(total - got[i]) < 1e-6 * max(1, abs(total)), i


def test_held_out_texts_teach_nothing(spark):
    docs = odd.documents(spark)
    before = brown_lm.score_texts(docs, context_words=300, head_words=60).where("not held_out").collect()
    changed = docs.withColumn("text", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit("quite other words zyx " * 50)).otherwise(F.col("text")))
    after = brown_lm.score_texts(changed, context_words=300, head_words=60).where("not held_out").collect()
    key = lambda rows: {r.doc_id: round(r.score, 8) for r in rows}
    assert key(before) == key(after)


def test_assigned_classes_are_the_best_of_all():
    rng = np.random.default_rng(1)
    table = rng.integers(0, 50, (brown_lm.CLASSES + 1, brown_lm.CLASSES + 1)).astype(float)
    cells = np.array([3, 70, 5, 64, 128], np.int64)
    counts = np.array([2, 1, 4, 1, 2], np.int64)
    bounds = np.array([0, 2, 5])
    home = np.array([-1, 7])
    got = brown_lm._best_classes(np.array([1, 2]), home, cells, counts, bounds, table)

    def value(n):
        return float(brown_lm._xlogx(np.array(max(n, 0.0))))

    for w in range(2):
        gains = []
        for c in range(brown_lm.CLASSES):
            gain, sums = 0.0, [0, 0]
            for k in range(bounds[w], bounds[w + 1]):
                right, d = divmod(int(cells[k]), brown_lm._SIDES)
                n = int(counts[k])
                x = table[c, d] if right else table[d, c]
                x = max(x - n, 0) if c == home[w] else x
                gain += value(x + n) - value(x)
                sums[right] += n
            for right, m in ((1, table[c].sum()), (0, table[:, c].sum())):
                m = max(m - sums[right], 0) if c == home[w] else m
                gain -= value(m + sums[right]) - value(m)
            gains.append(gain)
        assert got[w] == int(np.argmax(gains))


def test_hash_index():
    rng = np.random.default_rng(9)
    values = np.unique(rng.integers(1, 2**63, 5000, dtype=np.uint64))
    values = np.append(values, values[:50] + np.uint64(1))  # neighbours in the table
    values = np.unique(values)
    index = shared.HashIndex(values)
    asked = np.concatenate([values, rng.integers(1, 2**63, 3000, dtype=np.uint64)])
    at = {int(v): k for k, v in enumerate(values)}
    assert index.find(asked).tolist() == [at.get(int(v), -1) for v in asked]
    assert shared.HashIndex(np.zeros(0, np.uint64)).find(asked).max() == -1


def test_model_beats_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = brown_lm.score_texts(docs).where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum() + 0.1 * got["n_tokens"].sum()
    assert (got["score"] < 0).all()


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(4)
    truth = rng.integers(0, 3, 40)
    flow = np.array([[1, 30, 1], [1, 1, 30], [30, 1, 1]])
    bigrams = rng.poisson(flow[truth][:, truth])
    of = brown_lm.exchange_classes(bigrams, classes=3, rounds=20)

    def likelihood(classes):
        m = np.eye(3)[classes]
        t = m.T @ bigrams @ m
        return brown_lm._xlogx(t).sum() - brown_lm._xlogx(t.sum(0)).sum() - brown_lm._xlogx(t.sum(1)).sum()

    assert likelihood(of) >= likelihood(truth) - 1e-6


def test_contexts_of_asked_words_are_the_same(spark):
    from types import SimpleNamespace

    from seriesloom.llm.shared import HashIndex, Words

    docs = spark.createDataFrame([("a b c a d e b",), ("e d c a",), (None,), ("f a f",)], "text string")
    order = Words([b"a b c d e"]).hash
    context = SimpleNamespace(value=(HashIndex(order), np.array([0, 1, 2, 0, 1, -1], np.int16)))
    seen = lambda *among: {r.word: bytes(r.seen) for r in brown_lm.context_counts(docs.coalesce(1), context, np.sort(order[:1]), *among).collect()}
    few, every = seen(3), seen()
    assert set(few) == set(order[1:3].view(np.int64).tolist()) and len(every) == 5
    assert all(every[w] == s for w, s in few.items())
