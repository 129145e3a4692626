"""Secrets in texts: fixed patterns, and random strings that a tokenizer cannot shorten."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import numbered, read_only_path, text_slices

# The base patterns and the least lengths of what they must catch.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "sparse")

#: Strings of the added kind: at least so long, with letters (and digits, where less is left between separators), and at most so many characters a token.
SPARSE_LEAST = 20
CHARS_PER_TOKEN = 2.2
#: Lengths of hexadecimal digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512), which are no secrets.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)

_ASSIGN = re.compile(f"(?ai:{ASSIGN})")
# a run shorter than asked fails wherever in it the match starts, so the least length can stand in the pattern
_ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
_HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SPARSE_LEAST},}}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_ONLY_HEX = re.compile(r"[0-9A-Fa-f]+")
#: Words, each with at most three digits behind it, joined by single separators: names of things, if the words are such.
_IDENTIFIER = re.compile(r"[A-Za-z]+[0-9]{0,3}([_/-][A-Za-z]+[0-9]{0,3}|[_/-][0-9]{1,4})*")

#: Shorter words cannot have more characters a token than ``CHARS_PER_TOKEN`` and tell nothing.
_WORD = re.compile(r"[A-Za-z]{3,}")

SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"


@lru_cache(maxsize=2)
def _encoding(ranks_file: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(read_only_path(ranks_file), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _is_sparse(string: str, ranks_file: str) -> bool:
    return len(string) <= CHARS_PER_TOKEN * len(_encoding(ranks_file).encode_ordinary(string))


def _is_name(string: str, ranks_file: str) -> bool:
    """Whether it has the form of an identifier and its words, taken together, are no random letters."""
    if not _IDENTIFIER.fullmatch(string):
        return False
    words = _WORD.findall(string)
    encoding = _encoding(ranks_file)
    return not words or sum(map(len, words)) > CHARS_PER_TOKEN * sum(len(encoding.encode_ordinary(w)) for w in words)


def is_random(string: str, ranks_file: str) -> bool:
    """Whether the vocabulary needs a token for every ``CHARS_PER_TOKEN`` characters or fewer, digests and names aside."""
    if not any(c.isalpha() for c in string) or len(string) < SPARSE_LEAST and not any(c.isdigit() for c in string):
        return False
    if _ONLY_HEX.fullmatch(string) and len(string) in DIGEST_LENGTHS or _UUID.fullmatch(string):
        return False
    return _is_sparse(string, ranks_file) and not _is_name(string, ranks_file)


def find_spans(text: str, ranks_file: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start and then kind; an added span never overlaps a base one."""
    base = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    base += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    base += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    added = []
    for m in _RUN.finditer(text):
        if not any(s < m.end() and m.start() < e for _, s, e in base) and is_random(m[0].strip("=-_/"), ranks_file):
            added.append(("sparse", m.start(), m.end()))
    return sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(docs: DataFrame, ranks_file: str = "byte_bpe_50k.tiktoken", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document its ``spans``: base kinds ``assign``, ``access``, ``hex`` and the added kind ``sparse``.

    Rows are independent; nothing is shuffled. Null and empty texts have no
    spans, a null key stays null, repeated rows give repeated rows, an empty
    table gives none, and further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in text_slices(batches):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t.decode("utf-8", "replace"), ranks_file)] for t in raw]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def spans_text(spans: Column) -> Column:
    """Spans as ``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, ranks_file: str = "byte_bpe_50k.tiktoken", mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """The documents with every span's text replaced by ``mark``; other columns and texts without spans stay as they are.

    Rows are independent; nothing is shuffled, and texts are handled in slices. A null
    text stays null and an empty one empty, a null key changes nothing, repeated rows are
    changed alike, an empty table stays empty with the same columns, and columns may have
    any names, equal ones among them as long as one is called ``text``'s.
    """

    def cleaned(value: str) -> str:
        spans = find_spans(value, ranks_file)
        out, at = [], 0
        for _, start, end in spans:
            if start >= at:
                out += [value[at:start], mark]
            at = max(at, end)
        return "".join([*out, value[at:]]) if spans else value

    plain, types = numbered(docs)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in text_slices(batches, place):
            null = part.column(place).is_null().to_numpy(zero_copy_only=False)
            new = pa.array([cleaned(t.decode("utf-8", "replace")) for t in raw], pa.string(), mask=null)
            yield pa.RecordBatch.from_arrays([new if k == place else c for k, c in enumerate(part.columns)], names=part.schema.names)

    return plain.mapInArrow(run, types).toDF(*docs.columns)
