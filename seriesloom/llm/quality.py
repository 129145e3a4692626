"""Quality scores by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, crc_fold, numbered, text_slices

#: At most so many labelled rows are used to fit (those whose hashed id is smallest); the bound of what the driver holds.
MAX_TRAINING_ROWS = 20_000
BINS = 64
TREES, DEPTH, RATE, L2, LEAST_LEAF = 60, 4, 0.2, 1.0, 10

FEATURES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "longest_word", "upper", "digit", "space", "punct", "symbol", "high",
    "exclaim", "pipe_words", "symbol_end", "distinct_words", "top_word", "repeat_next", "upper_words", "lines_per_word",
    "distinct_lines", "short_lines", "stop_end", "distinct_pairs", "top_pair", "digit_words",
)

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 5
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_CLASS[128:] = 7


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds; empty ranges give 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct_and_top(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes per text, and how often its most frequent one occurs."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(doc):
        order = np.lexsort((hashes, doc))
        d, h = doc[order], hashes[order]
        first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]))
        runs = np.diff(np.concatenate([first, [len(d)]]))
        distinct += np.bincount(d[first], minlength=n)
        np.maximum.at(top, d[first], runs)
    return distinct, top


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` per text, over the whole text; the rows depend on nothing but the texts."""
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes + 1)])
    kinds = _CLASS[raw]
    words = Words(texts, lower=True)
    w_bounds = words.bounds
    lengths = (words.end - words.start).astype(float)
    count = np.diff(w_bounds).astype(float)
    some, size = np.maximum(count, 1), np.maximum(sizes, 1)
    upper = kinds == 1
    up_total = np.concatenate([[0], np.cumsum(upper)])
    letters = np.concatenate([[0], np.cumsum((kinds == 1) | (kinds == 2))])
    digits = np.concatenate([[0], np.cumsum(kinds == 3)])
    last = kinds[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    last_byte = raw[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    w_upper = up_total[words.end] - up_total[words.start]
    w_letters = letters[words.end] - letters[words.start]
    w_digits = digits[words.end] - digits[words.start]
    mean = _per_text(lengths, w_bounds) / some
    longest = np.zeros(n)
    np.maximum.at(longest, words.doc, lengths)
    distinct, top = _distinct_and_top(words.doc, words.hash, n)
    same = np.zeros(len(words.hash))
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    pair_doc = words.doc[1:][words.doc[1:] == words.doc[:-1]]
    pairs = (words.hash[:-1] * np.uint64(31) + words.hash[1:])[words.doc[1:] == words.doc[:-1]]
    pair_distinct, pair_top = _distinct_and_top(pair_doc, pairs, n)
    # lines: sums of word hashes between line feeds
    feeds = np.flatnonzero(raw == 10)
    line_of_word = np.searchsorted(feeds, words.start)
    line_doc = np.searchsorted(edges[1:], feeds, side="right")
    filled, first_word = np.unique(line_of_word, return_index=True)
    line_hash = np.add.reduceat(words.hash * (np.arange(len(words.hash), dtype=np.uint64) - np.repeat(first_word, np.diff(np.append(first_word, len(words.hash)))).astype(np.uint64) + np.uint64(1)), first_word) if len(first_word) else np.zeros(0, np.uint64)
    line_words = np.diff(np.append(first_word, len(words.hash))).astype(float)
    l_doc = line_doc[filled] if len(filled) else np.zeros(0, np.int64)
    lines = np.bincount(l_doc, minlength=n).astype(float) if len(l_doc) else np.zeros(n)
    line_distinct, _ = _distinct_and_top(l_doc, line_hash, n)
    short = np.bincount(l_doc, weights=line_words <= 3, minlength=n) if len(l_doc) else np.zeros(n)
    columns = {
        "log_bytes": np.log1p(sizes), "log_words": np.log1p(count), "mean_word": mean,
        "sd_word": np.sqrt(np.maximum(0, _per_text(lengths**2, w_bounds) / some - mean**2)), "longest_word": np.log1p(longest),
        "upper": _per_text(upper, edges) / size, "digit": _per_text(kinds == 3, edges) / size, "space": (_per_text(kinds == 4, edges) - 1) / size,
        "punct": _per_text(kinds == 5, edges) / size, "symbol": _per_text(kinds == 6, edges) / size, "high": _per_text(kinds == 7, edges) / size,
        "exclaim": _per_text(last_byte == 33, w_bounds) / some, "pipe_words": _per_text((last_byte == 124) & (lengths == 1), w_bounds) / some,
        "symbol_end": _per_text(last == 6, w_bounds) / some, "distinct_words": distinct / some, "top_word": top / some,
        "repeat_next": _per_text(same, w_bounds) / some, "upper_words": _per_text((w_letters > 1) & (w_upper == w_letters), w_bounds) / some,
        "lines_per_word": lines / some, "distinct_lines": line_distinct / np.maximum(lines, 1), "short_lines": short / np.maximum(lines, 1),
        "stop_end": _per_text(last_byte == 46, w_bounds) / some, "distinct_pairs": pair_distinct / np.maximum(count - 1, 1),
        "top_pair": pair_top / np.maximum(count - 1, 1), "digit_words": _per_text(w_digits > 0, w_bounds) / some,
    }
    for k, name in enumerate(FEATURES):
        out[:, k] = columns[name]
    return out


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays: an inner node k goes on to ``child[k]`` (value at most the threshold) or the node after that."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; all rows walk one tree level at a time."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                inner = self.child[at] > 0
                step = self.child[at] + (x[rows, self.feature[at]] > self.threshold[at])
                at = np.where(inner, step, at)
            total += self.value[at]
        return 1.0 / (1.0 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosted trees for the logistic loss; each split is the best of all features' histograms of gradients.

    Without rows or with one label only, the forest has no trees and gives the smoothed share of label 1.
    """
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(share / (1 - share)))
    feature, threshold, child, value, roots = [], [], [], [], []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        offset = np.arange(x.shape[1]) * BINS
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            roots.append(len(feature))
            todo = [(roots[-1], np.arange(len(y)), 0)]
            for arr, v in ((feature, 0), (threshold, 0.0), (child, 0), (value, 0.0)):
                arr.append(v)
            while todo:
                node, rows, level = todo.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                leaf = -RATE * gs / (hs + L2)
                value[node] = leaf
                split = None
                if level < depth and len(rows) >= 2 * LEAST_LEAF:
                    slots = (binned[rows] + offset).ravel()
                    shape = (x.shape[1], BINS)
                    sums = [np.bincount(slots, weights=w, minlength=x.shape[1] * BINS).reshape(shape).cumsum(axis=1) for w in (np.repeat(g[rows], x.shape[1]), np.repeat(h[rows], x.shape[1]), np.ones(len(slots)))]
                    gl, hl, nl = sums
                    gain = gl**2 / (hl + L2) + (gs - gl) ** 2 / (hs - hl + L2) - gs**2 / (hs + L2)
                    gain[(nl < LEAST_LEAF) | (len(rows) - nl < LEAST_LEAF)] = -1
                    f, b = np.unravel_index(int(np.argmax(gain)), shape)
                    if gain[f, b] > 1e-6 and b < len(cuts[f]):
                        split = int(f), int(b)
                if split is None:
                    margin[rows] += leaf
                    continue
                f, b = split
                feature[node], threshold[node], child[node], value[node] = f, float(cuts[f][b]), len(feature), 0.0
                go = binned[rows, f] > b
                for part in (rows[~go], rows[go]):
                    todo.append((len(feature), part, level + 1))
                    for arr, v in ((feature, 0), (threshold, 0.0), (child, 0), (value, 0.0)):
                        arr.append(v)
    return Forest(np.array(feature, np.int64), np.array(threshold), np.array(child, np.int64), np.array(value), np.array(roots, np.int64), base)


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS, fold: tuple[int, int] = (3, 1), text: str = "text", key: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``limit`` labelled documents outside the held-out fold.

    The rows are those with the smallest hashed ids, so they do not depend on the
    input's layout. Only their ids, at most ``limit``, are broadcast to the scan,
    and only their statistics, at most ``limit`` rows, come to the driver.
    """
    modulus, left_out = fold
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.where(crc_fold(F.col("doc_id"), modulus) != left_out)
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    ids = {r[0]: r[1] for r in chosen.collect()}
    if not ids:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    small = docs.sparkSession.createDataFrame(list(ids.items()), "doc_id long, quality int")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(small), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            x = statistics(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    # a repeated id may bring more rows than ids: the bound holds for rows as well
    got = rows.mapInArrow(run, "doc_id long, quality int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(limit).toPandas()
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(FEATURES)))
    return x, got["quality"].to_numpy(float)


def _scored(docs: DataFrame, labels: DataFrame, fold: tuple[int, int], limit: int, text: str, key: str) -> DataFrame:
    """All columns of ``docs`` under the names c0, c1, ... and the ``_score`` of each text."""
    forest = fit_forest(*training_rows(docs, labels, limit, fold, text, key))
    plain, types = numbered(docs)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, place):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(forest.scores(statistics(texts)))], names=[*part.schema.names, "_score"])

    return plain.mapInArrow(run, f"{types}, _score double")


def score_documents(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (3, 1), limit: int = MAX_TRAINING_ROWS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Score every whole text: ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from 0.5 on).

    The forest is fitted on at most ``limit`` labelled rows outside the fold
    ``(modulus, remainder)`` of the id's crc32; those inside are ``held_out``.
    Inputs are statistics of the text alone.

    Null texts count as empty and get a score like any other. A null key is not
    held out; labels that are null, not 0 or 1, or of a null key are not used; of
    a key's several labels the largest counts. Without usable labels every score
    is the smoothed share 0.5. Repeated rows are scored once each, empty tables
    give no rows, further columns are ignored.
    """
    modulus, left_out = fold
    only = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored = _scored(only, labels.select(F.col(key).alias("doc_id"), "quality"), fold, limit, "text", "doc_id")
    return scored.select(
        F.col("c0").alias("doc_id"),
        F.coalesce(crc_fold(F.col("c0"), modulus) == left_out, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (3, 1), limit: int = MAX_TRAINING_ROWS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores 0.5 or more (see ``score_documents``)."""
    scored = _scored(docs, labels, fold, limit, text, key)
    return scored.where("_score >= 0.5").drop("_score").toDF(*docs.columns)
