"""Layouts by fingerprint, the template's round trip, and the digests against plain Python."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from seriesloom.llm import chat_format as chat
from seriesloom.llm.queries import op12_chat_format

from . import odd

RECORDS = [
    ("m", {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "extra": {"a": [1, {"b": 2}]}}),
    ("p", {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}),
    ("s", {"system": "be kind", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]}),
    ("i", {"instruction": "do", "input": "this", "output": "done"}),
    ("j", {"instruction": "do", "input": "", "output": None}),
    ("c", {"prompt": "p", "completion": "c", "meta": {"k.k": 1}}),
    ("l", {"prompt": [{"role": "user", "content": "p"}], "completion": [{"role": "assistant", "content": "c"}]}),
    ("q", {"question": "q", "context": "ctx", "answer": "a"}),
    ("d", {"dialog": {"turns": [{"speaker": "human", "utterance": "x"}, {"speaker": "bot", "utterance": "y"}]}}),
    ("r", {"conv_id": 7, "turn": 3, "role": "user", "text": None}),
    ("u", {"unknown": 1}),
    ("e", {"messages": []}),
]
WANT = {
    "m": [("m", 0, "system", "s"), ("m", 1, "user", "hi"), ("m", 2, "assistant", "yo")],
    "p": [("p", 0, "user", "ab")],
    "s": [("s", 0, "system", "be kind"), ("s", 1, "user", "q"), ("s", 2, "assistant", "a"), ("s", 3, "tool", "t")],
    "i": [("i", 0, "user", "do\n\nthis"), ("i", 1, "assistant", "done")],
    "j": [("j", 0, "user", "do"), ("j", 1, "assistant", "")],
    "c": [("c", 0, "user", "p"), ("c", 1, "assistant", "c")],
    "l": [("l", 0, "user", "p"), ("l", 1, "assistant", "c")],
    "q": [("q", 0, "user", "q\n\nctx"), ("q", 1, "assistant", "a")],
    "d": [("d", 0, "user", "x"), ("d", 1, "assistant", "y")],
    "r": [("7", 3, "user", None)],
}


def test_layouts(spark):
    rows = [(k, json.dumps(v)) for k, v in RECORDS] + [("n", None), ("x", "{broken"), ("y", "[1]"), ("z", "[" * 100_000)]
    got = chat.canonical_turns(spark.createDataFrame(rows, "key string, record string"), key="key").collect()
    named = sorted(((r.conv, r.turn, r.role, r.text) for r in got if r.layout), key=repr)
    assert named == sorted((t for v in WANT.values() for t in v), key=repr)
    assert sorted(r.conv for r in got if not r.layout) == ["e", "n", "u", "x", "y", "z"]
    assert chat.canonical_turns(spark.createDataFrame([], "record string")).count() == 0


def test_fingerprints_tell_fields_apart():
    one = chat.field_paths({"a": {"b": 1}, "c": [{"d": 1}, {"e": 2}]})
    assert one == {"a.b", "c[].d", "c[].e"}
    assert chat.fingerprint(one) == chat.fingerprint(chat.field_paths({"c": [{"e": "x", "d": None}], "a": {"b": [] or 0}}))
    assert chat.field_paths({"a.b": 1}) != chat.field_paths({"a": {"b": 1}})
    assert chat.field_paths({"a": []}) == {"a[]"} != chat.field_paths({"a": "x"})
    assert chat.layout_of({"messages[].role", "messages[].content", "prompt", "completion", "conv_id"}).name == "messages"


CONTROLS = ["<|turn|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<|im_start|>"]


def test_template_round_trip(spark):
    rng = random.Random(3)
    bits = [*CONTROLS, "\\", "<", "[", "\n", "x", "é😀", "<\\|end|>", "|end|>", "[\\\\INST]"]
    rows = [(str(c), t, rng.choice(["user", "assistant", "a\nb\\n", "<|end|>", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for c in range(60) for t in range(4)]
    rows += [(None, None, None, None), ("t", 0, "user", "b"), ("t", 0, "user", "a"), ("t", 0, "user", "a")]
    frame = spark.createDataFrame(rows, "conv string, turn long, role string, text string").repartition(3)
    segments = chat.format_turns(frame).collect()
    texts: dict = {}
    for s in sorted(segments, key=lambda s: s.place):
        assert s.start == len(texts.get(s.conv, ""))
        texts[s.conv] = texts.get(s.conv, "") + s.segment
        inner = s.segment[len(chat.TURN) : -len(chat.END) - 1]
        assert not any(c in inner for c in CONTROLS)
    back = chat.read_back(chat.format_turns(frame)).collect()
    want = sorted((repr(c), r or "", t or "") for c, _, r, t in rows)
    assert sorted((repr(r.conv), r.role, r.text) for r in back) == want
    for r in back:
        assert (r.learned == r.text) if r.role == "assistant" else r.learned is None
    assert [r.text for r in sorted((r for r in back if r.conv == "t"), key=lambda r: r.place)] == ["a", "a", "b"]
    assert chat.format_turns(frame.limit(0)).count() == 0
    with pytest.raises(Exception, match="template"):
        chat.read_back(spark.createDataFrame([("c", 0, "no mark", 0, None, None)], "conv string, place long, segment string, start long, loss_start long, loss_end long")).collect()


def test_query_against_plain_python(spark):
    rows = spark.read.parquet(f"{odd.SF}/conversations.parquet").collect()
    same = "</s>[INST] ok [/INST]"
    turns = [(r.conv_id, r.turn, r.role, r.text or "") for r in rows] + [(-1, 0, "user", same), (-1, 1, "assistant", same)]
    want = []
    for conv in sorted({t[0] for t in turns}):
        own = sorted(t for t in turns if t[0] == conv)
        told = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        want.append((conv, len(own), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    got = op12_chat_format(spark, odd.SF)
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint", "bigint", "string", "bigint", "string", "bigint"]
    assert sorted(tuple(r)[:5] for r in got.collect()) == want


def test_one_long_conversation_streams(spark):
    frame = spark.range(30_000).select(F.lit("one").alias("conv"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("x").alias("text"))
    (row,) = chat.conversation_digests(chat.read_back(chat.format_turns(frame))).collect()
    assert (row.n_turns, row.loss_chars) == (30_000, 15_000)
    assert row.turns_sha256 == hashlib.sha256(b"user\nx\nassistant\nx\n" * 15_000).hexdigest()
