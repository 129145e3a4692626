from __future__ import annotations

import hashlib

import numpy as np

from seriesloom.llm import digest
from seriesloom.llm.queries import op4_fingerprints

from . import odd


def slow_counts(text: bytes) -> np.ndarray:
    counts = np.zeros(digest.BUCKETS, int)
    for k in range(len(text) - 3):
        for places, table in zip(digest.TRIPLETS, digest._TABLES):
            counts[table[0][text[k + places[0]]] ^ table[1][text[k + places[1]]] ^ table[2][text[k + places[2]]]] += 1
    return counts


def test_digest_against_slow_version():
    for text in (b"", b"abc", b"abcd", b"the quick brown fox jumps over the lazy dog" * 9):
        counts = slow_counts(text)
        q1, q2, q3 = (np.sort(counts)[64 * q - 1] for q in (1, 2, 3))
        quarter = (counts > q1).astype(int) + (counts > q2) + (counts > q3)
        packed = [sum(int(quarter[4 * k + j]) << 2 * j for j in range(4)) for k in range(64)]
        assert digest.digests([text])[0, 3:].tolist() == packed


def test_odd_rows_and_order(spark):
    rows = [r for r in odd.texts() if r[0] is not None and r[0] != 8]
    got = {r.doc_id: r for r in digest.compare_with_next(odd.frame(spark, rows)).collect()}
    ordered = sorted(rows)
    for k, (key, text, _) in enumerate(ordered):
        own, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(own) // 2
        assert got[key].edited == own[: len(own) - half] + following[:half]
        assert got[key].n_chars == len(own)
        mine, new, nxt = (digest.digests([t.encode()]) for t in (own, got[key].edited, following))
        assert got[key].fingerprint == mine[0].tobytes().hex()
        assert got[key].near_edited == digest.likeness(mine, new)[0] and got[key].near_next == digest.likeness(mine, nxt)[0]
    assert len(digest.compare_with_next(odd.frame(spark)).collect()) == len(odd.texts())
    assert digest.compare_with_next(odd.frame(spark, [])).count() == 0
    alone = digest.compare_with_next(odd.frame(spark, [(3, "alone abc", "en")])).first()
    assert alone.near_next == 1.0


def test_whole_table(spark):
    docs = sorted((r.doc_id, r.text or "") for r in odd.documents(spark).collect())
    got = {r.doc_id: r for r in op4_fingerprints(spark, odd.SF).collect()}
    assert len(got) == len(docs)
    for k, (key, text) in enumerate(docs):
        half = len(text) // 2
        edited = text[: len(text) - half] + docs[(k + 1) % len(docs)][1][:half]
        assert got[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    near = np.mean([r.near_edited for r in got.values()])
    assert near > np.mean([r.near_next for r in got.values()])
