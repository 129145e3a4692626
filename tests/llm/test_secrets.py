from __future__ import annotations

import re

from seriesloom.llm import token_efficiency as secrets
from seriesloom.llm.queries import op10_secrets

from . import odd

RANKS = "byte_bpe_50k.tiktoken"
BASE = {
    "assign": (re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (pattern, good) in BASE.items() for m in pattern.finditer(text) if good(m))


def test_planted():
    random_string = "q7Xb2LkP9vZt4RmW8sYd3HnC6f"
    found = secrets.find_spans(f"value {random_string} here", RANKS)
    assert found == [("sparse", 6, 6 + len(random_string))]
    for harmless in ("internationalization_of_everything2", "D41D8CD98F00B204E9800998ECF8427E", "123e4567-e89b-12d3-a456-426614174000", "a plain sentence with plain words", "configuration-manager-service-v12"):
        assert [s for s in secrets.find_spans(harmless, RANKS) if s[0] == "sparse"] == []
    assert secrets.find_spans("é PassWord = 'abc123'", RANKS) == [("assign", 2, 20)]
    assert secrets.find_spans("token: abc", RANKS) == []
    assert secrets.find_spans("AKIAAKIA" + "A" * 12, RANKS)[0] == ("access", 0, 20)


def test_base_spans_stay(spark):
    rows = [(r.doc_id, r.text, None) for r in odd.documents(spark).collect()] + odd.texts()
    got = secrets.find_secrets(odd.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), base_spans(t or "")) for i, t, _ in rows)
    assert sorted((str(r.doc_id), sorted((s.start, s.kind, s.end) for s in r.spans if s.kind != "sparse")) for r in got) == want
    assert secrets.find_secrets(odd.frame(spark, [])).count() == 0


def test_query_columns(spark):
    got = op10_secrets(spark, odd.SF)
    assert {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"} <= set(got.columns)
    assert got.count() == odd.documents(spark).count()


def test_redaction(spark):
    frame = odd.frame(spark, [(1, "x password=hunter22 y", "en"), (2, None, None), (3, "", "en"), (4, "clean", "en")])
    got = {r.doc_id: r.text for r in secrets.redact(frame).collect()}
    assert got == {1: "x [SECRET] y", 2: None, 3: "", 4: "clean"}
    assert secrets.redact(frame).columns == frame.columns


def test_random_letters_are_found():
    for key in ("qZxVbTkLpWvRtHmGsYdJ", "XqkzWvbnTrpLmdGhZcsF42", "QWZXKVTRBNPLMDGHFCSJ-zqvkxwtbnrpl", "xkqz-wvbn-trpl-mdgh-zcsf"):
        assert secrets.find_spans(f"value {key} here", RANKS) == [("sparse", 6, 6 + len(key))], key
    for harmless in ("Donaudampfschifffahrtsgesellschaft", "internationalization-of-everything", "a/b/c/d/e/f/g/h/i/j/k", "x____________________", "getUserByIdentifierFromTable", "src/main/java/org/example/service2"):
        assert secrets.find_spans(f"value {harmless} here", RANKS) == [], harmless


def plain_added(text):
    """The added spans, said as one walk over maximal runs of the alphabet."""
    import tiktoken

    encoding: tiktoken.Encoding = secrets._encoding(RANKS)
    alphabet = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
    tokens = lambda s: len(encoding.encode_ordinary(s))
    covered = [(s, e) for s, _, e in base_spans(text)]
    out, k = [], 0
    while k < len(text):
        if text[k] not in alphabet:
            k += 1
            continue
        end = k
        while end < len(text) and text[end] in alphabet:
            end += 1
        inner = text[k:end].strip("=-_/")
        free = not any(s < end and k < e for s, e in covered)
        letters, digits = any(c.isalpha() for c in inner), any(c.isdigit() for c in inner)
        hexes = inner != "" and all(c in "0123456789abcdefABCDEF" for c in inner)
        parts = inner.split("-")
        uuid = [len(p) for p in parts] == [8, 4, 4, 4, 12] and all(c in "0123456789abcdefABCDEF" for p in parts for c in p)
        name = re.fullmatch("[A-Za-z]+[0-9]{0,3}(?:[_/-](?:[A-Za-z]+[0-9]{0,3}|[0-9]{1,4}))*", inner) is not None
        if name:
            words = [w for w in re.findall("[A-Za-z]+", inner) if len(w) >= 3]
            name = not words or sum(map(len, words)) > 2.2 * sum(tokens(w) for w in words)
        random_like = letters and (len(inner) >= 20 or digits) and not (hexes and len(inner) in (32, 40, 56, 64, 96, 128)) and not uuid and len(inner) <= 2.2 * tokens(inner) and not name
        if end - k >= 20 and free and random_like:
            out.append(("sparse", k, end))
        k = end
    return out


def test_added_spans_against_plain(spark):
    import random

    rng = random.Random(31)
    texts = [t or "" for _, t, _ in odd.texts()] + [r.text for r in odd.documents(spark).collect()]
    bits = ["qZ7x", "river", "_", "-", "/", "=", "12", "password: ", "AKIA", "deadbeef", " ", "Kp9", "é", "getUser", "."]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(5, 40))) for _ in range(1_500)]
    texts += [d[:n] for d in ("d41d8cd98f00b204e9800998ecf8427e" * 4, "D41D8CD98F00B204E9800998ECF8427E" * 4) for n in (31, 32, 33, 40, 64, 128)]
    found = 0
    for text in texts:
        own = [s for s in secrets.find_spans(text, RANKS) if s[0] == "sparse"]
        assert own == plain_added(text), text[:200]
        found += len(own)
    assert found > 50


def test_redaction_of_clashing_columns_and_repeated_rows(spark):
    from pyspark.sql import functions as F

    frame = odd.frame(spark, [(1, "x password=hunter22 y", "en")] * 3 + [(None, "token: abcdef1", None)])
    frame = frame.withColumn("c1", F.lit("secret=abcdef12")).withColumn("text2", F.col("text"))
    got = secrets.redact(frame)
    assert got.columns == frame.columns and got.schema.simpleString() == frame.schema.simpleString()
    rows = got.collect()
    assert sorted(r.text for r in rows) == ["[SECRET]"] + ["x [SECRET] y"] * 3
    assert {r.c1 for r in rows} == {"secret=abcdef12"} and all("[SECRET]" not in r.text2 for r in rows)
    assert secrets.redact(odd.frame(spark, [])).count() == 0
