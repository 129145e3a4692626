from __future__ import annotations

import random
import string
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from seriesloom.llm import packing
from seriesloom.llm.queries import WORD_BPE
from seriesloom.llm.shared import read_only_path

from . import odd


def least_cost(places, penalties, window, free):
    """Quadratic version of the dynamic program."""
    best = [0.0] + [float("inf")] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            size = places[j] - places[i]
            if size <= window:
                best[j] = min(best[j], best[i] + (0 if size in free else window - size) + penalties[j] + packing.WINDOW_COST)
    return best[-1]


def cost_of(cuts, places, penalties, window, free):
    at = dict(zip(places, penalties))
    return sum((0 if b - a in free else window - (b - a)) + at[b] + packing.WINDOW_COST for a, b in zip([0, *cuts], cuts))


def test_monotone_queue_finds_the_least_cost():
    rng = random.Random(3)
    for _ in range(150):
        window = rng.choice([8, 13, 16])
        places = [0]
        for _ in range(rng.randint(1, 25)):
            places.append(places[-1] + rng.randint(1, window))
        penalties = [float(rng.choice([0, 12, 40])) for _ in places]
        free = tuple(1 << k for k in range(5) if 1 << k < window)
        cuts = packing.choose_cuts(places, penalties, window, free)
        assert cuts[-1] == places[-1] and all(b - a <= window for a, b in zip([0, *cuts], cuts))
        assert abs(cost_of(cuts, places, penalties, window, free) - least_cost(places, penalties, window, free)) < 1e-6


def check_pieces(rows, docs, window):
    tokenizer = Tokenizer.from_file(read_only_path(WORD_BPE))
    want = defaultdict(list)
    for key, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want[key].append(np.array(ids, "<u4").tobytes())
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(got) == set(want)
    for key, pieces in got.items():
        assert sum(p.length for p in pieces) == sum(len(w) // 4 for w in want[key])
        if len(want[key]) == 1:
            pieces.sort(key=lambda p: p.start)
            assert b"".join(bytes(p.ids) for p in pieces) == want[key][0]
            assert [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
            assert {p.doc_tokens for p in pieces} == {len(want[key][0]) // 4}
    for pieces in sequences.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
        assert sum(p.length for p in pieces) <= window
    return sequences


def test_odd_rows(spark):
    rows = packing.pack_documents(odd.frame(spark), WORD_BPE, window=256).collect()
    check_pieces(rows, [(i, t) for i, t, _ in odd.texts()], 256)
    assert packing.pack_documents(odd.frame(spark, []), WORD_BPE).count() == 0


def test_little_padding(spark):
    docs = odd.documents(spark)
    rows = packing.pack_documents(docs, WORD_BPE).collect()
    sequences = check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    sizes = [sum(p.length for p in s) for s in sequences.values()]
    padded = sum(n if n & (n - 1) == 0 else 2048 for n in sizes)
    assert sum(sizes) / padded > 0.98


def test_query_checksums(spark):
    from seriesloom.llm.queries import op1_packing

    one = op1_packing(spark, odd.SF).orderBy("doc_id", "start").first()
    full = packing.pack_documents(odd.documents(spark), WORD_BPE).where(f"doc_id = {one.doc_id} and start = {one.start}").first()
    assert one.ids_crc32 == zlib.crc32(bytes(full.ids))


def test_words_that_end_in_mixed_punctuation():
    from seriesloom.llm.word_table import WordTable

    table = WordTable(WORD_BPE)
    words = ["word).", 'said",', "10%,", "f(x);", "dogs'.", "a).", 'b",', "[SECRET],", '9B"!!', "Plain.", "...", "?!)", "it's.", "'s,", "a\t.", "x_.", "é).", "#!", "A1:"]
    texts = [*words, " ".join(words), "\n".join(reversed(words))]
    for text, (ids, _) in zip(texts, table.encode(texts), strict=True):
        assert ids.tolist() == table.tokenizer.encode(text, add_special_tokens=False).ids, text


def library_ids(texts):
    tokenizer = Tokenizer.from_file(read_only_path(WORD_BPE))
    return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_random_texts_get_the_library_ids(monkeypatch):
    from seriesloom.llm import word_table

    monkeypatch.setattr(word_table, "MEMO_WORDS", 3000)
    monkeypatch.setattr(word_table, "SLICE_BYTES", 5000)
    rng = random.Random(17)
    signs = string.punctuation + "abcXYZ019éÜßİŉक़ńǅº²  \n\t́北。"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    texts += ["w" * 80, "Long" * 30 + "!", "a" * 6000 + "."]
    table = word_table.WordTable(WORD_BPE)
    for a in range(0, len(texts), 1000):
        part = texts[a : a + 1000]
        for text, (ids, _), want in zip(part, table.encode(part), library_ids(part), strict=True):
            assert ids.tolist() == want, text
    # one text of more than a slice is worked on in parts
    for text in (" ".join(texts[:4000]), "\n".join(texts[:2000]), "x.y" * 4000, " " * 12_000 + "end."):
        (ids, ends), want = table.encode([text])[0], library_ids([text])[0]
        assert ids.tolist() == want and (np.diff(ends) >= 0).all() and (len(ends) == 0 or ends[-1] <= len(ids))


def test_words_share_what_their_pieces_cost():
    """Cases, brackets and endings of a word are no words of their own, so that little is learned of a large text."""
    from seriesloom.llm.word_table import WordTable

    table = WordTable(WORD_BPE)
    texts = [f"{a}{w}{b}{c}" for w in ("hause", "Hause", "HAUSE", "élan", "Élan", "it's") for a in ("", "(", '"') for b in ("", ".", ",", "?!", "%%%", "'") for c in ("", "\n", " 1998,")]
    table.encode([" ".join(texts)])
    assert len(table.index) < 40
    for text, (ids, ends), want in zip(texts, table.encode(texts), library_ids(texts), strict=True):
        assert ids.tolist() == want, text
        # sentences end at stops before white space or the text's end, not at those within numbers or before quotes
        stop = any(word.endswith((".", "!")) for word in text.replace("\n", " ").split(" "))
        assert len(ends) == stop, text
    assert len(table.encode(["It is 3.14 or 2.7.1 now."])[0][1]) == 1


def test_long_words_leave_the_numbers_of_others_alone(monkeypatch):
    from seriesloom.llm import word_table

    monkeypatch.setattr(word_table, "MEMO_WORDS", 200)
    table = word_table.WordTable(WORD_BPE)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    for turn in range(12):
        texts = [" ".join([*words[:40], "x" * (70 + turn), *words[40:100]]), "北 " + " ".join([*words[:40], "y." * (70 + turn), *rng.sample(words, 90)])]
        for text, (ids, _), want in zip(texts, table.encode(texts), library_ids(texts), strict=True):
            assert ids.tolist() == want, text


def test_capital_spellings_of_special_tokens_are_text():
    from seriesloom.llm.word_table import WordTable

    table = WordTable(WORD_BPE)
    texts = ["<|ENDOFTEXT|>", "北 <|EndOfText|>", "北 x<|ENDOFTEXT|>y.", "a <|endoftext|> b", "<|StartOfText|>,"]
    for text, (ids, _), want in zip(texts, table.encode(texts), library_ids(texts), strict=True):
        assert ids.tolist() == want, text


def test_every_known_character_is_split_as_the_library_does(monkeypatch):
    from seriesloom.llm import word_table

    table = word_table.WordTable(WORD_BPE)
    rng = random.Random(11)
    known = [chr(k) for k in word_table._KNOWN]
    latin = [k for k in known if table.latin.whole(k)]
    assert "İ" not in latin and set(known) - set(latin) <= {k for k in known if k.isalpha()}
    texts = [f"a{k}b {k}{k}. '{k}s {k}'s 1{k}2" for k in known]
    texts += ["".join(rng.choice(rng.choice((latin, "'strevmld", " .,!?\n"))) for _ in range(40)) for _ in range(5000)]
    for text, (ids, _), want in zip(texts, table.encode(texts), library_ids(texts), strict=True):
        assert ids.tolist() == want, text


def test_tokenizers_that_join_over_spaces_are_refused():
    import pytest
    from seriesloom.llm.word_table import WordTable

    with pytest.raises(ValueError):
        WordTable("byte_bpe_50k.json")


def test_documents_of_more_than_a_unit(spark):
    rng = random.Random(2)
    text = " ".join(rng.choice(["One", "two,", "three.", "four", "five!"]) for _ in range(9000))
    rows = [(1, text, "en"), (2, "short one.", "en"), (3, "word " * 5000, "en"), (4, "", "en")]
    got = packing.pack_documents(odd.frame(spark, rows), WORD_BPE, window=128, unit_tokens=1000).collect()
    check_pieces(got, [(i, t) for i, t, _ in rows], 128)
