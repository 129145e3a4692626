"""Chat formatting: records of any known layout become turns by a fingerprint of their fields, turns become marked text with a loss mask."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import give_back, slices

# ---- layouts


@dataclass(frozen=True)
class Each:
    """A turn for every element of the list at ``items``."""

    items: str
    role: str
    text: str

    def needs(self) -> set[str]:
        return {f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"}


@dataclass(frozen=True)
class Said:
    """One turn of a given role from the first of ``texts`` and, where they aren't empty, the others; ``spare`` ones may be absent."""

    role: str
    texts: tuple[str, ...]
    spare: bool = False

    def needs(self) -> set[str]:
        return set() if self.spare else {self.texts[0]}


@dataclass(frozen=True)
class Row:
    """The record itself is one turn of a conversation."""

    conv: str
    turn: str
    role: str
    text: str

    def needs(self) -> set[str]:
        return {self.conv, self.turn, self.role, self.text}


@dataclass(frozen=True)
class Layout:
    name: str
    steps: tuple[Each | Said | Row, ...]
    #: What roles are called in the canonical form; others stay as they are.
    roles: tuple[tuple[str, str], ...] = ()

    def needs(self) -> set[str]:
        return set().union(*(s.needs() for s in self.steps))


_SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

#: Of several layouts whose fields a record has, the one that needs most fields counts, then the first.
LAYOUTS = (
    Layout("turn row", (Row("conv_id", "turn", "role", "text"),)),
    Layout("messages", (Each("messages", "role", "content"),)),
    Layout("messages in parts", (Each("messages", "role", "content[].text"),)),
    Layout("speakers", (Said("system", ("system",), spare=True), Each("conversations", "from", "value")), _SPEAKERS),
    Layout("nested turns", (Each("dialog.turns", "speaker", "utterance"),), _SPEAKERS),
    Layout("prompt and completion messages", (Each("prompt", "role", "content"), Each("completion", "role", "content"))),
    Layout("instruction", (Said("system", ("system",), spare=True), Said("user", ("instruction", "input")), Said("assistant", ("output",)))),
    Layout("instruction and response", (Said("user", ("instruction", "context")), Said("assistant", ("response",)))),
    Layout("prompt and completion", (Said("system", ("system",), spare=True), Said("user", ("prompt",)), Said("assistant", ("completion",)))),
    Layout("prompt and response", (Said("system", ("system",), spare=True), Said("user", ("prompt",)), Said("assistant", ("response",)))),
    Layout("question and answer", (Said("user", ("question", "context")), Said("assistant", ("answer",)))),
)


def field_paths(record) -> set[str]:
    """Paths of all nested fields: names joined by dots (dots in a name are doubled), ``[]`` for a list's elements."""
    found, todo = set(), [("", record)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict) and value:
            todo += [(f"{path}.{k.replace('.', '..')}" if path else k.replace(".", ".."), v) for k, v in value.items()]
        elif isinstance(value, list):
            # an element without fields of its own still tells that there is a list
            todo += [(f"{path}[]", v) for v in value] or [(f"{path}[]", None)]
        elif path:
            found.add(path)
    return found


def fingerprint(paths: set[str]) -> int:
    """64 bits that are equal for records with the same fields, whatever their values, counts and order."""
    return int.from_bytes(hashlib.blake2b("\n".join(sorted(paths)).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def layout_of(paths: set[str], layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    fitting = [x for x in layouts if x.needs() <= paths]
    return max(fitting, key=lambda x: len(x.needs()), default=None)


#: Fingerprints whose layouts a task remembers; beyond them it starts anew.
MOST_FINGERPRINTS = 50_000


def _value(record, path: str):
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def _text(value) -> str | None:
    """A text as it is, parts of a text joined, other values as JSON."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(_text(v.get("text") if isinstance(v, dict) else v) or "" for v in value)
    return json.dumps(value, ensure_ascii=False)


def _whole(value) -> int | None:
    return int(value) if isinstance(value, (int, float)) and value == value and abs(value) < 2**63 else None


def read_turns(record, layout: Layout, key: str | None) -> Iterator[tuple[str | None, int | None, str | None, str | None]]:
    """(conversation, turn, role, text) of a record; records that are no rows of a conversation are one, named by their key."""
    roles, place = dict(layout.roles), 0
    for step in layout.steps:
        if isinstance(step, Row):
            conv = _value(record, step.conv)
            yield None if conv is None else _text(conv), _whole(_value(record, step.turn)), _text(_value(record, step.role)), _text(_value(record, step.text))
        elif isinstance(step, Each):
            for item in _value(record, step.items) or []:
                role = _text(_value(item, step.role))
                yield key, place, roles.get(role, role), _text(_value(item, step.text.split("[]")[0]))
                place += 1
        else:
            parts = [_text(_value(record, t)) for t in step.texts]
            if not (step.spare and not parts[0]):
                yield key, place, step.role, "\n\n".join([parts[0] or "", *(p for p in parts[1:] if p)])
                place += 1


TURNS = "conv string, turn long, role string, text string, layout string, fingerprint long"


def canonical_turns(records: DataFrame, record: str = "record", key: str | None = None, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The turns of JSON records of mixed layouts: ``conv, turn, role, text, layout, fingerprint``.

    Each record's nested field paths are hashed; the hash finds the layout that was
    chosen for the first record with these fields in the task. Records are
    independent, so nothing is shuffled, whatever the number of fingerprints.

    A record that is null, no JSON or of no known layout gives one row without
    layout and turn, so that none is lost silently; one with an empty list gives
    none. A null text or role stays null, repeated records give repeated turns,
    an empty table gives none; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Layout | None] = {}
        for batch in batches:
            keys, raw = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices([len(x.as_buffer()) if x.is_valid else 0 for x in raw.cast(pa.large_binary())]):
                out: list[tuple] = []
                for name, text in zip(keys[a:b], raw.slice(a, b - a).to_pylist()):
                    try:
                        value = json.loads(text) if text else None
                    except (ValueError, RecursionError):
                        value = None
                    if not isinstance(value, dict):
                        out.append((name, None, None, None, None, None))
                        continue
                    paths = field_paths(value)
                    mark = fingerprint(paths)
                    if mark not in known:
                        if len(known) >= MOST_FINGERPRINTS:
                            known.clear()
                        known[mark] = layout_of(paths, layouts)
                    layout = known[mark]
                    if layout is None:
                        out.append((name, None, None, None, None, mark))
                    else:
                        out += [(*t, layout.name, mark) for t in read_turns(value, layout, name)]
                if out:
                    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv", "turn", "role", "text", "layout", "fingerprint"])
        give_back()

    own = F.col(key).cast("string") if key else F.lit(None).cast("string")
    return records.select(own.alias("conv"), F.col(record).cast("string").alias("record")).mapInArrow(run, TURNS)


# ---- the template

TURN, END = "<|turn|>", "<|end|>"
#: Control strings: of this template, and what trainers' vocabularies commonly hold. An opener, then the rest.
_CONTROL = r"<(?=\\*(?:\|[A-Za-z0-9_]+\|>|/?s>|unk>|pad>|</?SYS>>))|\[(?=\\*/?INST\])"
_ESCAPED = r"(<)\\(?=\\*(?:\|[A-Za-z0-9_]+\|>|/?s>|unk>|pad>|</?SYS>>))|(\[)\\(?=\\*/?INST\])"


def escape(text: Column) -> Column:
    """The text with a backslash behind the opener of every control string, those among them that have backslashes there already.

    So no control string is left, and ``unescape`` takes exactly one backslash off each.
    """
    return F.regexp_replace(text, _CONTROL, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def _role_line(role: Column) -> Column:
    """A role on one line: backslashes doubled, line feeds as ``\\n``, control strings escaped."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_of(line: Column) -> Column:
    plain = F.replace(unescape(line), F.lit("\\\\"), F.lit("\x00\x00"))
    return F.replace(F.replace(plain, F.lit("\\n"), F.lit("\n")), F.lit("\x00\x00"), F.lit("\\"))


def format_turns(turns: DataFrame, conv: str = "conv", turn: str = "turn", role: str = "role", text: str = "text", learned: str = "assistant") -> DataFrame:
    """A ``segment`` of the formatted text per turn: ``conv, place, segment, start, loss_start, loss_end``.

    The formatted text of a conversation is its segments in order of ``place``; it is
    kept in segments, as a conversation may be longer than a row should be.
    ``start`` is where a segment begins in that text; ``loss_start`` and ``loss_end``
    bound the part of it that is learned (the texts of the role ``learned``), null
    elsewhere. All places count code points. One shuffle, by conversation; the
    rows of one are streamed and may spill.

    Turns are ordered by ``turn`` (null first), equal ones by role and text; repeated
    turns all stay. A null role or text counts as empty; a null conversation is one
    of its own. An empty table gives no rows; further columns are ignored.
    """
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(TURN), _role_line(F.col("role")), F.lit("\n"))
    rows = rows.select("conv", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("segment", F.concat("head", "body", F.lit(f"{END}\n")))
    w = W.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("place", F.row_number().over(w).cast("long") - 1)
    rows = rows.withColumn("start", F.sum(F.char_length("segment").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.char_length("segment"))
    taught = F.col("role") == learned
    loss = F.when(taught, F.col("start") + F.char_length("head"))
    return rows.select("conv", "place", "segment", "start", loss.alias("loss_start"), (loss + F.char_length("body")).alias("loss_end"))


def read_back(segments: DataFrame) -> DataFrame:
    """``conv, place, role, text, learned, segment_chars`` from formatted segments; ``learned`` is the plain text under the mask.

    A segment that isn't of the template ends the job with a message.
    """
    line = F.locate("\n", F.col("segment"))
    n = F.char_length("segment")
    good = F.col("segment").startswith(TURN) & F.col("segment").endswith(f"{END}\n")
    checked = segments.withColumn("segment", F.when(good, F.col("segment")).otherwise(F.raise_error(F.lit("a segment is not of the template"))))
    role = F.substring(F.col("segment"), F.lit(len(TURN) + 1), line - F.lit(len(TURN) + 1))
    text = F.substring(F.col("segment"), line + 1, n - line - F.lit(len(END) + 1))
    learned = F.substring(F.col("segment"), (F.col("loss_start") - F.col("start")).cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return checked.select("conv", "place", _role_of(role).alias("role"), unescape(text).alias("text"), unescape(learned).alias("learned"), n.cast("long").alias("segment_chars"))


DIGESTS = "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Counts and SHA-256 of each conversation's turns and learned texts, from rows as ``read_back`` gives them.

    Rows are streamed in order; a task holds two running digests, not the
    conversation. A null conversation comes last of its partition and counts as one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        done: list[tuple] = []

        def close(h: list) -> tuple:
            return (h[0], h[1], h[2].hexdigest(), h[3], h[4].hexdigest(), h[5])

        for batch in batches:
            for conv, role, text, learned, chars in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if held is None or conv != held[0]:
                    if held is not None:
                        done.append(close(held))
                    held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                held[1] += 1
                held[2].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                if learned is not None:
                    held[3] += len(learned)
                    held[4].update(learned.encode("utf-8", "replace"))
                held[5] += chars
            if done:
                yield _digest_rows(done)
                done = []
        if held is not None:
            yield _digest_rows([close(held)])

    dealt = turns.repartition("conv").sortWithinPartitions("conv", "place")
    return dealt.select("conv", "role", "text", "learned", "segment_chars").mapInArrow(run, DIGESTS)


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
