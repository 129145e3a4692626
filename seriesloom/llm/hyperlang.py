"""Language identification by hyperdimensional n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_fold, numbered, text_slices

DIMENSIONS = 512
#: Letters per n-gram, spaces at words' edges included.
GRAM = 3
#: A document needs this cosine to be taken as of a language by the pipeline; a short one needs less, see ``keep_identified``.
LEAST_LIKENESS = 0.15
#: Standard deviations of the noise of ``DIMENSIONS`` dimensions by which a short text may fall below its language's likeness.
NOISE_MARGIN = 3.0
UNKNOWN = "und"
_SEED = 7919
#: Documents whose vectors are held at once.
SLICE_ROWS = 256
#: Distinct n-grams whose vectors are held at once.
BLOCK_GRAMS = 4_096


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point its lower-case letter's code point, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = ord(s.lower()[0])
    return out


_vectors: dict[int, np.ndarray] = {}


def letter_vector(code: int) -> np.ndarray:
    """The random vector of -1 and 1 of a letter, drawn from its code point alone; 0 is the space."""
    if code not in _vectors:
        bits = np.random.default_rng([_SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8)
        _vectors[code] = 2 * bits - 1
    return _vectors[code]


def _numbered(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order, and each value's number among them; values are below ``limit``."""
    if limit > 1 << 22:
        return np.unique(values, return_inverse=True)
    present = np.zeros(limit, bool)
    present[values] = True
    distinct = np.flatnonzero(present)
    number = np.zeros(limit, np.int32)
    number[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct, number[values]


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text: text number, n-gram number, count; and the n-grams' letters by number.

    Everything that is no letter counts as one space, and one stands before a text's first letter; n-grams of more than
    one space in a row or outside the text do not exist. So every text with a letter has an n-gram, and no other has one.
    """
    codes = np.frombuffer("".join(f"\n{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letters()[codes]
    keep = letters > 0
    keep[1:] |= letters[:-1] > 0
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    keep[np.cumsum(sizes) - sizes] = True
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letters, doc = letters[keep], doc[keep]
    alphabet, small = _numbered(letters, 0x110000)
    n, size = len(small) - GRAM + 1, len(alphabet)
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros((0, GRAM), np.uint32)
    code = small[:n].astype(np.int64)
    for k in range(1, GRAM):
        code = code * size + small[k : k + n]
    same = doc[:n] == doc[GRAM - 1 :]
    code, own = code[same], doc[:n][same]
    cells, counts = np.unique(own.astype(np.int64) * size**GRAM + code, return_counts=True)
    of = cells // size**GRAM
    grams, number = _numbered(cells - of * size**GRAM, size**GRAM)
    spelled = np.stack([alphabet[(grams // size ** (GRAM - 1 - k)) % size] for k in range(GRAM)], axis=1) if len(grams) else np.zeros((0, GRAM), np.uint32)
    return of, number, counts, spelled


def gram_vectors(spelled: np.ndarray) -> np.ndarray:
    """Bound vectors: the product of the letters' vectors, each rotated by its place from the n-gram's end."""
    alphabet, small = np.unique(spelled, return_inverse=True)
    small = small.reshape(spelled.shape)
    base = np.stack([letter_vector(int(c)) for c in alphabet]) if len(alphabet) else np.zeros((0, DIMENSIONS), np.int8)
    out = base[small[:, GRAM - 1]]
    for k in range(GRAM - 1):
        out = out * np.roll(base, GRAM - 1 - k, axis=1)[small[:, k]]
    return out


def document_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each text, its n-grams' vectors summed with weight log(1 + count), and its number of distinct n-grams; zero without letters.

    The logarithm keeps a repeated line or word from drowning the rest of a text.
    """
    of, number, counts, spelled = gram_counts(texts)
    return _bundles(of, number, np.log1p(counts), len(texts), spelled), np.bincount(of, minlength=len(texts))


def _bundles(row: np.ndarray, number: np.ndarray, weight: np.ndarray, rows: int, spelled: np.ndarray) -> np.ndarray:
    """Per row the sum of its n-grams' vectors by weight, so many n-grams at a time that memory does not follow the texts."""
    out = np.zeros((rows, DIMENSIONS), np.float32)
    order = np.argsort(number, kind="stable")
    starts = np.searchsorted(number[order], np.arange(0, len(spelled) + BLOCK_GRAMS, BLOCK_GRAMS))
    for k, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        own = order[a:b]
        first = k * BLOCK_GRAMS
        vectors = gram_vectors(spelled[first : first + BLOCK_GRAMS]).astype(np.float32)
        met, place = np.unique(row[own], return_inverse=True)
        dense = np.bincount(place * len(vectors) + number[own] - first, weights=weight[own], minlength=len(met) * len(vectors))
        out[met] += dense.reshape(len(met), -1).astype(np.float32) @ vectors
    return out


def _language_sums(texts: list[str], languages: np.ndarray) -> dict[str, np.ndarray]:
    """The sum of the bundles of each language's texts, without making the bundles, and behind it the sum of their n-grams' weights."""
    of, number, counts, spelled = gram_counts(texts)
    names, own = np.unique(languages, return_inverse=True)
    if not len(spelled):
        return {}
    weight = np.log1p(counts)
    total = np.bincount(own[of], weights=weight, minlength=len(names))
    return dict(zip(names, np.hstack([_bundles(own[of], number, weight, len(names), spelled), total[:, None]])))


def language_prototypes(docs: DataFrame, fold: tuple[int, int] = (4, 2), text: str = "text", key: str = "doc_id", lang: str = "lang") -> dict[str, np.ndarray]:
    """One vector per language: the sum of the bundles of its documents outside the held-out fold.

    Behind its ``DIMENSIONS`` numbers it has the sum of the n-grams' weights. Tasks send one partial sum per language, so what is shuffled and what the
    driver receives are (languages x dimensions) numbers whatever the number of documents.
    """
    modulus, left_out = fold
    taught = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    taught = taught.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(crc_fold(F.col("doc_id"), modulus) == left_out, F.lit(False))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part, texts in _slices(batches):
            for name, v in _language_sums(texts, np.array(part.column(0).to_pylist(), object)).items():
                sums[name] = sums.get(name, 0) + v.astype(np.float64)
        # whole numbers make the sum the same in whatever order tasks end
        rows = [(name, k, int(round(x * 2**8))) for name in sorted(sums) for k, x in enumerate(sums[name])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "k", "x"])

    parts = taught.mapInArrow(run, "lang string, k long, x long").groupBy("lang", "k").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for name, k, x in parts.collect():
        out.setdefault(name, np.zeros(DIMENSIONS + 1))[k] = x / 2**8
    return out


def _slices(batches: Iterator[pa.RecordBatch], text: int = -1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices bounded in bytes and in rows, as each row needs a vector."""
    for part, texts in text_slices(batches, text):
        for a in range(0, len(texts), SLICE_ROWS):
            own = texts[a : a + SLICE_ROWS]
            yield part.slice(a, len(own)), [t.decode("utf-8", "replace") for t in own]


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """All columns of ``docs`` under the names c0, c1, ..., with ``lang_pred``, ``score`` and ``grams``.

    These are the language of the nearest prototype, its cosine (at least 0) and the text's number of distinct n-grams.
    A text that is null, empty or without a letter, and every text if there are no
    prototypes, gets ``und`` and 0. Ties go to the first language in alphabetical
    order. Repeated rows stay repeated.
    """
    names = sorted(prototypes)
    units = np.stack([prototypes[n][:DIMENSIONS] / max(np.linalg.norm(prototypes[n][:DIMENSIONS]), 1e-9) for n in names]) if names else np.zeros((0, DIMENSIONS))
    units = units.astype(np.float32)
    plain, types = numbered(docs)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches, place):
            v, grams = document_vectors(texts)
            norm = np.linalg.norm(v, axis=1)
            has_letter = grams > 0
            if len(names):
                cosines = v @ units.T / np.maximum(norm, 1e-9)[:, None]
                best = cosines.argmax(axis=1)
                found = [names[b] if ok else UNKNOWN for b, ok in zip(best, has_letter)]
                score = np.where(has_letter, np.clip(cosines[np.arange(len(v)), best], 0, 1), 0.0)
            else:
                found, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(grams, pa.int32())], names=[*part.schema.names, "lang_pred", "score", "grams"])

    return plain.mapInArrow(run, f"{types}, lang_pred string, score double, grams int")


def predict_languages(docs: DataFrame, fold: tuple[int, int] = (4, 2), text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Learn prototypes outside the fold of the id's crc32 and predict every whole text's language.

    Returns ``doc_id, held_out, lang_pred, score``. A null key is not held out; a
    null language teaches nothing. Further columns are ignored. See ``identify``
    for texts without letters. An empty table gives no rows.
    """
    modulus, left_out = fold
    prototypes = language_prototypes(docs, fold, text, key, lang)
    told = identify(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), prototypes)
    return told.select(F.col("c0").alias("doc_id"), F.coalesce(crc_fold(F.col("c0"), modulus) == left_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def likeness_by_length(prototypes: dict[str, np.ndarray]) -> dict[str, float]:
    """Per language the cosine that a text of it has, divided by the root of its number of n-grams, while these are few and differ.

    Such n-grams, drawn as the language draws them, meet a prototype of weights w at
    the mean of w squared over w, so the quotient is the norm of w over its sum. An
    n-gram's vector has norm ``sqrt(DIMENSIONS)``.
    """
    return {name: float(np.linalg.norm(v[:DIMENSIONS]) / DIMENSIONS**0.5 / max(v[DIMENSIONS], 1e-9)) for name, v in prototypes.items()}


def keep_identified(docs: DataFrame, fold: tuple[int, int] = (4, 2), least: float = LEAST_LIKENESS, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is like some language of the table.

    The score must be ``least``, or what a text of the language with as few n-grams
    has (see ``likeness_by_length``) less ``NOISE_MARGIN`` deviations of the noise,
    if that is smaller. A text too short to tell from its language's own is kept.
    Null texts, empty ones and ones without a letter go, as does every row where no
    row teaches a language. Rows are judged one by one, so repeated rows stay or go
    together; an empty table gives no rows, and further columns, whatever their
    names, stay as they are. A null key only decides that its row teaches.
    """
    prototypes = language_prototypes(docs, fold, text, key, lang)
    told = identify(docs, prototypes, text)
    bar = F.lit(least)
    for name, share in likeness_by_length(prototypes).items():
        own = F.lit(share) * F.sqrt("grams") - NOISE_MARGIN / DIMENSIONS**0.5
        bar = F.when(F.col("lang_pred") == name, F.least(F.lit(least), own)).otherwise(bar)
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= bar)).drop("lang_pred", "score", "grams").toDF(*docs.columns)
