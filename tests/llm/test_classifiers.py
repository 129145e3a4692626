"""Quality and language models by held-out accuracy, their odd rows, and their stages' rules."""

from __future__ import annotations

import zlib

import numpy as np

from seriesloom.llm import hyperlang, quality

from . import odd


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out and quality is not null").toPandas()
    assert (got["predicted"] == (got["score"] >= 0.5)).all() and got["score"].between(0, 1).all()
    assert auc(got["score"].to_numpy(), got["quality"].to_numpy()) > 0.9


def test_forest_follows_its_arrays():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.fit_forest(x, y)

    def one(row):
        total = forest.base
        for at in forest.roots:
            while forest.child[at]:
                at = forest.child[at] + int(row[forest.feature[at]] > forest.threshold[at])
            total += forest.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.scores(x), [one(r) for r in x])
    assert ((forest.scores(x) > 0.5) == (y == 1)).mean() > 0.97


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (6, 1, 0), (7, None, 0), (None, 1, 0), (9, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(odd.frame(spark), labels).collect()
    assert len(got) == len(odd.texts()) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    for empty in (labels.limit(0), labels.where("doc_id is null")):
        assert {r.score for r in quality.score_documents(odd.frame(spark), empty).collect()} == {0.5}
    assert quality.score_documents(odd.frame(spark, []), labels).count() == 0
    kept = quality.keep_good(odd.frame(spark), labels)
    assert kept.columns == odd.frame(spark).columns


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = hyperlang.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").toPandas()
    assert len(got) > 100 and (got["lang"] == got["lang_pred"]).mean() > 0.95


def test_language_odd_rows(spark):
    got = hyperlang.predict_languages(odd.frame(spark)).collect()
    assert len(got) == len(odd.texts())
    letterless = {1, 2, 3, 14}
    for r in got:
        if r.doc_id in letterless:
            assert r.lang_pred == "und" and r.score == 0
        elif r.doc_id is not None:
            assert r.lang_pred in {"en", "de", "fr", "es", "pt"} and 0 <= r.score <= 1
    untaught = hyperlang.predict_languages(odd.frame(spark, [(1, "abc def", None), (2, None, "en")])).collect()
    assert {r.lang_pred for r in untaught} == {"und"}
    assert hyperlang.predict_languages(odd.frame(spark, [])).count() == 0
    kept = hyperlang.keep_identified(odd.frame(spark))
    assert kept.columns == odd.frame(spark).columns and not {r.doc_id for r in kept.collect()} & letterless


def test_grams_are_bound_by_rotation():
    spelled = np.array([[ord("a"), ord("b"), ord("c")]], np.uint32)
    a, b, c = (hyperlang.letter_vector(ord(x)).astype(int) for x in "abc")
    assert (hyperlang.gram_vectors(spelled)[0] == np.roll(a, 2) * np.roll(b, 1) * c).all()


def test_short_texts_of_a_language_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    short = ["This.", "De.", "A.", "A.\nAll rights reserved.", "I", "12345 !!!", "", "x" * 30 + " " + " ".join(a + b + "qzx" + b + a for a in "qxzjwkv" for b in "qxzjwkv")]
    more = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(short)], docs.schema)
    told = {r.doc_id: r for r in hyperlang.predict_languages(docs.unionByName(more)).where("doc_id < 0").collect()}
    assert {k for k, r in told.items() if r.lang_pred == "und"} == {-6, -7}
    kept = {r.doc_id for r in hyperlang.keep_identified(docs.unionByName(more)).where("doc_id < 0").collect()}
    # the last text is long and like no language
    assert kept == {-1, -2, -3, -4, -5}


def test_bundles_against_one_by_one(monkeypatch):
    """Vectors and cosines, an n-gram at a time, whatever the block."""
    texts = ["Straße und Wort", "", "北京 is far", "a a a", "12 !", "naïve café naïve"]

    def grams(text):
        letters = [c.lower()[0] if c.isalpha() else " " for c in text]
        kept = [" "] + [c for k, c in enumerate(letters) if c != " " or k and letters[k - 1] != " "] + [" "]
        kept = "".join(c for k, c in enumerate(kept) if c != " " or k == 0 or kept[k - 1] != " ")
        return [kept[k : k + 3] for k in range(len(kept) - 2)]

    def slow(text):
        out, own = np.zeros(hyperlang.DIMENSIONS), grams(text)
        for g in sorted(set(own)):
            a, b, c = (hyperlang.letter_vector(0 if x == " " else ord(x)).astype(float) for x in g)
            out += np.log1p(own.count(g)) * np.roll(a, 2) * np.roll(b, 1) * c
        return out, len(set(own))

    for block in (1, 3, 4096):
        monkeypatch.setattr(hyperlang, "BLOCK_GRAMS", block)
        vectors, counts = hyperlang.document_vectors(texts)
        for v, n, text in zip(vectors, counts, texts):
            want, grams_of = slow(text)
            assert n == grams_of and np.allclose(v, want, atol=1e-3), text


def plain_statistics(text: bytes) -> dict[str, float]:
    """The statistics of one text, byte by byte and word by word."""
    import math
    from collections import Counter

    words, n = [w for w in __import__("re").split(rb"[ \t\n\x0b\x0c\r]+", text) if w], len(text)
    lower = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    some = max(len(words), 1)
    count = lambda good: sum(map(good, text)) / max(n, 1)
    share = lambda good: sum(map(good, words)) / some
    lengths = [len(w) for w in words]
    mean = sum(lengths) / some
    pairs = Counter(zip(lower, lower[1:]))
    lines = [tuple(bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in __import__("re").split(rb"[ \t\n\x0b\x0c\r]+", line) if w) for line in text.split(b"\n")]
    lines = [line for line in lines if line]
    symbols, letters = b"!#$%&*+/<=>@[\\]^_`{|}~", lambda w: [b for b in w if 65 <= b <= 90 or 97 <= b <= 122]
    return {
        "log_bytes": math.log1p(n), "log_words": math.log1p(len(words)), "mean_word": mean, "sd_word": math.sqrt(max(0.0, sum(x * x for x in lengths) / some - mean * mean)), "longest_word": math.log1p(max(lengths, default=0)),
        "upper": count(lambda b: 65 <= b <= 90), "digit": count(lambda b: 48 <= b <= 57), "space": count(lambda b: b in b" \t\n\x0b\x0c\r"), "punct": count(lambda b: b in b".,;:'\"()-?"), "symbol": count(lambda b: b in symbols), "high": count(lambda b: b >= 128),
        "exclaim": share(lambda w: w.endswith(b"!")), "pipe_words": share(lambda w: w == b"|"), "symbol_end": share(lambda w: w[-1] in symbols), "distinct_words": len(set(lower)) / some, "top_word": max(Counter(lower).values(), default=0) / some,
        "repeat_next": sum(a == b for a, b in zip(lower, lower[1:])) / some, "upper_words": share(lambda w: len(letters(w)) > 1 and all(b <= 90 for b in letters(w))), "lines_per_word": len(lines) / some, "distinct_lines": len(set(lines)) / max(len(lines), 1),
        "short_lines": sum(len(line) <= 3 for line in lines) / max(len(lines), 1), "stop_end": share(lambda w: w.endswith(b".")), "distinct_pairs": len(pairs) / max(len(words) - 1, 1), "top_pair": max(pairs.values(), default=0) / max(len(words) - 1, 1),
        "digit_words": share(lambda w: any(48 <= b <= 57 for b in w)),
    }


def test_statistics_against_plain(spark):
    texts = [(t or "").encode() for _, t, _ in odd.texts()] + [r.text.encode() for r in odd.documents(spark).limit(60).collect()]
    texts += [b"| a | B!\n\nb b b\n B! |x| A1 2B end.\nend.\r\n", b"!", b"\n", b"AB ab Ab AB 12 1a"]
    got = quality.statistics(texts)
    for row, text in zip(got, texts):
        want = plain_statistics(text)
        for k, name in enumerate(quality.FEATURES):
            assert abs(row[k] - want[name]) < 1e-9, (name, row[k], want[name], text[:80])


def test_predictions_against_plain(spark):
    """Prototypes as sums of all taught texts' vectors, one by one, and the nearest of them by cosine."""
    docs = [(r.doc_id, r.text, r.lang) for r in odd.documents(spark).limit(80).collect()] + [r for r in odd.texts() if r[0] != 6]
    sums = {}
    for key, text, lang in docs:
        if text is not None and lang is not None and not (key is not None and zlib.crc32(str(key).encode()) % 4 == 2):
            vector = hyperlang.document_vectors([text])[0][0].astype(float)
            sums[lang] = sums.get(lang, 0) + vector
    names = sorted(n for n, v in sums.items() if np.linalg.norm(v) > 0)
    want = []
    for key, text, _ in docs:
        vectors, grams = hyperlang.document_vectors([text or ""])
        v = vectors[0].astype(float)
        if not grams[0]:
            want.append((str(key), "und", 0.0))
            continue
        cosines = [v @ sums[n] / np.linalg.norm(v) / np.linalg.norm(sums[n]) for n in names]
        want.append((str(key), names[int(np.argmax(cosines))], max(0.0, max(cosines))))
    got = [(str(r.doc_id), r.lang_pred, r.score) for r in hyperlang.predict_languages(odd.frame(spark, docs)).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4, (a, b)
