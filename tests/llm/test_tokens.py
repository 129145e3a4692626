"""Token counts by spliced chunks and the distinct-chunk codec, against the library on whole texts."""

from __future__ import annotations

import random

from seriesloom.llm import chunk_codec, token_counts
from seriesloom.llm.queries import PIECE_BPE

from . import odd


def test_chunks_splice_exactly():
    model = token_counts.piece_model(PIECE_BPE)
    assert token_counts.marks_are_walls(PIECE_BPE)
    rng = random.Random(5)
    texts = [t for _, t, _ in odd.texts() if t]
    texts += ["".join(rng.choice("ab  ▁\n.é北 ") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    for text in texts:
        for chunk, overlap in ((64, 8), (300, 40)):
            if len(text) < 45_000:
                assert token_counts.count_by_chunks(PIECE_BPE, text[:3000], chunk, overlap)[0] == len(model.encode(text[:3000]))
    long_text = max(texts, key=len)
    counted, chunks = token_counts.count_by_chunks(PIECE_BPE, long_text)
    assert counted == len(model.encode(long_text)) and chunks > 1


def test_counts_of_odd_rows(spark):
    model = token_counts.piece_model(PIECE_BPE)
    got = token_counts.count_tokens(odd.frame(spark), PIECE_BPE, limit=50, chunk=100, overlap=10).collect()
    want = sorted((str(i), len((t or "").encode()), n := len(model.encode(t or "")), n > 50) for i, t, _ in odd.texts())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.count_tokens(odd.frame(spark, []), PIECE_BPE).count() == 0


def test_codec_of_odd_rows_and_documents(spark):
    model = token_counts.piece_model(PIECE_BPE)
    rows = [(r.doc_id, r.text, None) for r in odd.documents(spark).collect()]
    for table in (odd.texts(), rows):
        got = chunk_codec.encode_documents(odd.frame(spark, table), PIECE_BPE).collect()
        want = [(str(i), [*model.encode(t or ""), model.eos_id()]) for i, t, _ in table]
        assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted(want)
        decoded = sorted((str(i), model.decode(ids)) for i, ids in want)
        assert sorted((str(r.doc_id), r.decoded) for r in got) == decoded
    assert chunk_codec.encode_documents(odd.frame(spark, []), PIECE_BPE).count() == 0


def test_table_starts_anew(spark, monkeypatch):
    monkeypatch.setattr(chunk_codec, "TABLE_CHUNKS", 5)
    table = chunk_codec.ChunkTable(PIECE_BPE)
    model = token_counts.piece_model(PIECE_BPE)
    for text in ("a b c d e f g h", "b c i j k", "a  b ▁ c"):
        ids, ends, decoded = table.codes([text, text])
        assert ids.tolist() == model.encode(text) * 2 and decoded[0] == model.decode(model.encode(text))


def test_long_texts_without_spaces():
    """Work in proportion to the length, and the library's counts."""
    model = token_counts.piece_model(PIECE_BPE)
    rng = random.Random(4)
    chinese = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(120_000))
    code = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(150_000))
    for text in (chinese, code, "x" * 90_000, "ab" * 50_000, " " * 70_000, "\U0001f600" * 20_000, "the" * 30_000 + " end"):
        counted, encoded = token_counts.count_by_chunks(PIECE_BPE, text)
        assert counted == len(model.encode(text)), text[:20]
        assert encoded <= 3 * len(text) / token_counts.CHUNK_CHARS + 12, (text[:20], encoded)


def test_walls_are_token_bounds():
    model, walls, spans = token_counts.piece_model(PIECE_BPE), token_counts.walls_of(PIECE_BPE), token_counts._spans(PIECE_BPE)
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice("abcdeXYZ 01.,\n▁é北京の😀") for _ in range(rng.randint(1, 200)))
        starts = set(token_counts._starts(model, spans, text, 0, len(text)).tolist())
        assert set(walls.places(text, 0, len(text)).tolist()) <= starts


def test_runs_without_walls_behind_a_splice():
    """Prose, a long run, prose: the left chunk is begun anew behind a splice, where the text has no mark."""
    model = token_counts.piece_model(PIECE_BPE)
    rng = random.Random(21)
    words = ["river", "stone", "the", "of", "and", "Morgen", "über", "end."]
    runs = ["=" * 40_000, "-" * 17_000, " " * 60_000, "a" * 50_000, "ab" * 30_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000)), "京" * 20_000, "x" * 100_000]
    for run in runs:
        prose = " ".join(rng.choice(words) for _ in range(4_000))
        for text in (prose + run, prose + " " + run + "\n" + prose):
            assert token_counts.count_by_chunks(PIECE_BPE, text)[0] == len(model.encode(text)), run[:5]


def test_tiny_chunks_of_random_strings():
    model = token_counts.piece_model(PIECE_BPE)
    rng = random.Random(22)
    letters = ["ab", "ab =", "the ", "=-", "▁ a\n", "abcdefghij ", "北京ab ", "thing and "]
    for k in range(1_500):
        text = "".join(rng.choice(letters[k % len(letters)]) for _ in range(rng.randint(20, 400)))
        chunk, overlap = rng.choice(((16, 4), (40, 8), (300, 40)))
        assert token_counts.count_by_chunks(PIECE_BPE, text, chunk, overlap)[0] == len(model.encode(text)), text
