"""Token counts of documents, huge ones by overlapping chunks that are spliced at proven boundaries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import read_only_path, text_slices

#: Texts of more characters are counted by chunks.
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int"
_MARK = "▁"


@lru_cache(maxsize=2)
def piece_model(model_file: str):
    """The sentencepiece processor of a file, held once per worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=read_only_path(model_file))


@lru_cache(maxsize=2)
def marks_are_walls(model_file: str) -> bool:
    """Whether no piece holds a white space mark after another character.

    Merges only ever build pieces of the vocabulary, so then no merge can join a
    mark to what stands before it: the place between a character and the first
    mark after it is a token boundary of every text, whatever stands around it.
    """
    model = piece_model(model_file)
    return all(_MARK not in model.id_to_piece(i).lstrip(_MARK) for i in range(model.get_piece_size()))


class Walls:
    """Places that no token of a model can reach over, and the splices they allow.

    Merges only ever build pieces of the vocabulary, so a token of several
    characters spells two neighbours that stand side by side in some piece. Between
    two characters that are neighbours in no piece, every text has a token boundary,
    whatever stands around them; characters that the vocabulary does not hold become
    bytes and are cut off on both sides. Beyond such a wall, encodings do not depend
    on what stands before it.
    """

    def __init__(self, model) -> None:
        pairs: set[int] = set()
        for i in range(model.get_piece_size()):
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
                continue
            piece = model.id_to_piece(i)
            for a, b in zip(piece, piece[1:]):
                pairs.add(ord(a) << 21 | ord(b))
        self.pairs = np.sort(np.fromiter(pairs, np.int64, len(pairs)))

    def places(self, text: str, start: int, end: int) -> np.ndarray:
        """Walls in [max(start, 1), end): places before a character that its neighbour before cannot join."""
        start = max(start, 1)
        if end <= start:
            return np.zeros(0, np.int64)
        codes = np.frombuffer(text[start - 1 : end].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes[codes == 0x20] = ord(_MARK)
        pair = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.flatnonzero(self.pairs[at] != pair) + start


@lru_cache(maxsize=2)
def walls_of(model_file: str) -> Walls | None:
    """The walls of a model, or None where its normalisation may change what stands side by side."""
    model = piece_model(model_file)
    same = all(model.normalize(t) == _MARK + t.replace(" ", _MARK) for t in ("ab  c", " a b ", "é é", "①ａ", "\tx\n"))
    return Walls(model) if same else None


@lru_cache(maxsize=2)
def _spans(model_file: str) -> np.ndarray:
    """How many characters of the text each token covers; of a character in bytes the first byte covers it."""
    model = piece_model(model_file)
    sizes = np.zeros(model.get_piece_size(), np.int64)
    for i in range(len(sizes)):
        piece = model.id_to_piece(i)
        sizes[i] = int(not 0x80 <= int(piece[3:5], 16) < 0xC0) if model.is_byte(i) else len(piece)
    return sizes


def _starts(model, spans: np.ndarray, text: str, left: int, end: int) -> np.ndarray:
    """Where the tokens of ``text[left:end]`` begin, in characters of the whole text; the library puts a mark before it."""
    own = spans[model.encode(text[left:end], return_type="numpy", num_threads=1)]
    return np.maximum(np.cumsum(own) - own - 1, 0) + left


def count_by_chunks(model_file: str, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[int, int]:
    """Tokens of the text and the number of encodings made, for a model that has ``walls_of``.

    Each chunk starts ``overlap`` characters before the last one's end. The two are
    spliced at the last place of the overlap that is a wall and at which a token
    begins in both encodings: tokens before it are the left chunk's, the others
    the right one's. Where there is none the overlap is doubled; where it has come
    to hold all of the left chunk behind the last splice, there is no wall in that,
    and the left chunk is begun anew with twice its length. It begins one character
    before the last splice: the library sets a mark before all that it encodes, which
    the text does not have there and which may join what follows it; it can join the
    character before the splice only, as the splice is a wall, and what lies before
    the splice is not counted again. So the work follows the text's length, with
    walls or without.
    """
    model, walls, spans = piece_model(model_file), walls_of(model_file), _spans(model_file)
    n = len(text)
    left, end, splice, total = 0, min(chunk, n), 0, 0
    own = _starts(model, spans, text, left, end)
    encoded = 1
    while end < n:
        width = overlap
        while True:
            after = max(splice, end - width)
            places = walls.places(text, after + 1, end)
            if len(places):
                after_end = min(n, after + max(chunk, 2 * (end - after)))
                following = _starts(model, spans, text, after, after_end)
                encoded += 1
                both = places[np.isin(places, own) & np.isin(places, following)]
                if len(both):
                    place = int(both[-1])
                    total += int(np.searchsorted(own, place) - np.searchsorted(own, splice))
                    left, end, splice, own = after, after_end, place, following
                    break
            if after == splice:
                left, end = max(splice - 1, 0), min(n, splice + 2 * (end - splice))
                own = _starts(model, spans, text, left, end)
                encoded += 1
                break
            width *= 2
    return total + len(own) - int(np.searchsorted(own, splice)), encoded


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """UTF-8 bytes and tokens of every whole text, as the sentencepiece model gives them without begin or end ids.

    Texts of up to ``chunk`` characters are encoded at once, longer ones by
    ``count_by_chunks``; a model for which splices cannot be proven exact encodes
    them whole. ``n_chunks`` tells the number of encodings. Rows are independent,
    so nothing is shuffled.

    Null and empty texts have 0 bytes and 0 tokens. A null key stays null,
    repeated rows give repeated rows, an empty table gives none, and further
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_file)
        proven = walls_of(model_file) is not None
        for part, raw in text_slices(batches):
            if raw:
                own = [t.decode("utf-8", "replace") for t in raw]
                short = [k for k, t in enumerate(own) if len(t) <= chunk or not proven]
                counts, chunks = np.zeros(len(own), np.int64), np.ones(len(own), np.int32)
                for k, ids in zip(short, model.encode([own[k] for k in short], num_threads=1, return_type="numpy")):
                    counts[k] = len(ids)
                for k in set(range(len(own))) - set(short):
                    counts[k], chunks[k] = count_by_chunks(model_file, own[k], chunk, overlap)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(t) for t in raw], pa.int64()),
                        pa.array(counts),
                        pa.array(counts > limit),
                        pa.array(chunks),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks"],
                )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
