"""Language-model scores from a class-based bigram model with exchange-clustered classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HashIndex, Words, crc_fold, release, settle, text_slices
from .summaries import CHUNK_SCHEMA, chunk_rows, merged

#: Words, the most frequent of the training texts, whose classes every task holds (a fixed bound): they are the
#: neighbours by which words are clustered. Every training word gets a class, and all others meet theirs by a join.
CONTEXT_WORDS = 1 << 18
#: Of these, so many are clustered first, one by one, and give the classes their shape.
HEAD_WORDS = 1_536
CLASSES = 64
#: Rounds over the head; rounds over all other words.
HEAD_ROUNDS, ROUNDS = 4, 2
#: Weight, in observations, of the class frequencies in the transitions.
PRIOR = 4.0
#: Words gathered before a task sums them up.
GATHER = 1 << 21

# Classes by number: 0 to CLASSES - 1 are words, then the end alone, then words that training does not hold.
_END, _UNSEEN = CLASSES, CLASSES + 1
_SIDES = CLASSES + 1
#: Counts up to this take their gains from a table made beforehand.
SMALL = 8


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n_train`` for every distinct word of ``docs (text)``; words go by 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        size = 0

        def summed() -> pa.RecordBatch:
            distinct, count = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(distinct.astype(np.int64)), pa.array(count.astype(np.int64))], names=["word", "n_train"])

        for _, texts in text_slices(batches):
            parts.append(Words(texts).hash)
            size += len(parts[-1])
            if size > GATHER:
                yield summed()
                parts, size = [], 0
        if size:
            yield summed()

    return docs.select("text").mapInArrow(run, "word long, n_train long").groupBy("word").agg(F.sum("n_train").alias("n_train"))


class _Known:
    """The index of words that every task holds, broadcast once, and their classes at one time (-1: none), a small broadcast each."""

    def __init__(self, spark, index, classes: np.ndarray) -> None:
        self.index, self.classes = index, spark.sparkContext.broadcast(classes.astype(np.int16))

    @property
    def value(self) -> tuple[HashIndex, np.ndarray]:
        return self.index.value, self.classes.value


def _closed(words: Words, numbers: np.ndarray, end: int) -> np.ndarray:
    """The texts' words by number in one row, an end behind each text and before the first."""
    return np.concatenate([np.array([end], numbers.dtype), np.insert(numbers, words.bounds[1:], end)])


def _matrix(cells: Iterator[np.ndarray], size: int) -> Iterator[pa.RecordBatch]:
    """The sum of cell numbers over a task, as chunks of a table of counts."""
    total = np.zeros(size, np.int64)
    for part in cells:
        total += np.bincount(part, minlength=size)
    rows = list(chunk_rows(total))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "cells"])


def head_bigrams(docs: DataFrame, head: np.ndarray) -> np.ndarray:
    """Counts of neighbours among the head's words and the end (the last number), over all texts of ``docs``."""
    n = len(head) + 1
    index = HashIndex(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells() -> Iterator[np.ndarray]:
            for _, texts in text_slices(batches):
                words = Words(texts)
                row = _closed(words, index.find(words.hash), n - 1)
                good = (row[:-1] >= 0) & (row[1:] >= 0)
                yield row[:-1][good] * n + row[1:][good]

        yield from _matrix(cells(), n * n)

    return merged(docs.select("text").mapInArrow(run, CHUNK_SCHEMA), n * n, "int64", np.add).reshape(n, n)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange_classes(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = HEAD_ROUNDS, end_apart: bool = False) -> np.ndarray:
    """Each unit's class, by exchange: units move, by falling count, to the class with the greatest likelihood.

    The likelihood of the class bigram model is, up to what no move changes,
    sum N(c,d) log N(c,d) - sum N(c) log N(c) over left and right counts. Rounds
    end when nothing moves. Ties go to the smallest class. With ``end_apart`` the
    last unit stays alone in the class after the others.
    """
    n = len(bigrams)
    counts = bigrams.astype(np.float64)
    moving = n - end_apart
    order = np.argsort(-(counts.sum(axis=0) + counts.sum(axis=1))[:moving], kind="stable")
    of = np.full(n, classes, np.int64)
    of[order] = np.arange(moving) % classes
    size = classes + end_apart
    member = np.zeros((n, size))
    member[np.arange(n), of] = 1
    table = member.T @ counts @ member
    for _ in range(rounds):
        moved = False
        for u in order:
            if not counts[u].any() and not counts[:, u].any():
                continue
            right = np.bincount(of, weights=counts[u], minlength=size)
            left = np.bincount(of, weights=counts[:, u], minlength=size)
            self_pair = counts[u, u]
            home = of[u]
            right[home] -= self_pair
            left[home] -= self_pair
            table[home] -= right
            table[:, home] -= left
            table[home, home] -= self_pair
            plain = _xlogx(table)
            gain = (_xlogx(table + right) - plain).sum(axis=1) + (_xlogx(table + left[:, None]) - plain).sum(axis=0)
            diagonal = np.diagonal(table)
            both = _xlogx(diagonal + right + left + self_pair) - _xlogx(diagonal)
            gain += both - (_xlogx(diagonal + right) - _xlogx(diagonal)) - (_xlogx(diagonal + left) - _xlogx(diagonal))
            for margin, own in ((table.sum(axis=1), right.sum() + self_pair), (table.sum(axis=0), left.sum() + self_pair)):
                gain -= _xlogx(margin + own) - _xlogx(margin)
            best = int(gain[:classes].argmax())
            moved |= best != home
            of[u] = best
            table[best] += right
            table[:, best] += left
            table[best, best] += self_pair
        if not moved:
            break
    return of


def context_counts(docs: DataFrame, context, skip: np.ndarray, among: int | None = None) -> DataFrame:
    """``word, seen``: how often each word occurs and has a neighbour of each class on either side, over all texts of ``docs``.

    Of the words in ``context``, neighbours whose
    class is -1 or that are not in it do not count, nor does a word beside itself.
    ``seen`` packs (side and class as one number, count) as pairs of 32-bit numbers,
    the number after the last standing for the word itself, a row for each word and
    task's gathering. Words of the sorted ``skip`` are left out, and all but the first
    ``among`` words of the context, if that is given: before anything is gathered, and
    by the same worker, as each one more holds the context once more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, classes = context.value
        words_of: list[np.ndarray] = []
        cells_of: list[np.ndarray] = []
        size = 0

        def summed() -> Iterator[pa.RecordBatch]:
            # what is not needed any more is let go at once: a worker's memory is a few times what it gathered
            word, cell = np.concatenate(words_of), np.concatenate(cells_of)
            words_of.clear()
            cells_of.clear()
            order = np.argsort(word)
            word, cell = word[order], cell[order]
            del order
            first = np.concatenate([[True], word[1:] != word[:-1]])
            distinct = word[first]
            del word
            keys = np.cumsum(first, dtype=np.int64)
            keys -= 1
            keys *= 2 * _SIDES + 1
            keys += cell
            del first, cell
            keys.sort()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            count = np.diff(starts, append=len(keys))
            keys = keys[starts]
            owner, cell = keys // (2 * _SIDES + 1), keys % (2 * _SIDES + 1)
            pairs = np.stack([cell, count], axis=1).astype("<i4")
            starts = np.searchsorted(owner, np.arange(len(distinct) + 1)) * 8
            raw = pa.Array.from_buffers(pa.binary(), len(distinct), [None, pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(pairs.tobytes())])
            table = pa.RecordBatch.from_arrays([pa.array(distinct.astype(np.int64)), raw], names=["word", "seen"])
            for a in range(0, len(distinct), 10_000):
                yield table.slice(a, 10_000)

        for _, texts in text_slices(batches):
            words = Words(texts)
            number = index.find(words.hash)
            cls = np.where(number >= 0, classes[number], -1).astype(np.int64)
            row, hashes = _closed(words, cls, _END), _closed(words, words.hash, 0)
            inner = np.flatnonzero(hashes[1:] != 0) + 1
            own = hashes[inner]
            if len(skip):
                at = np.minimum(np.searchsorted(skip, own), len(skip) - 1)
                inner = inner[skip[at] != own]
                own = hashes[inner]
            if among is not None:
                place = _closed(words, number, -1)[inner]
                inner = inner[(place >= 0) & (place < among)]
                own = hashes[inner]
            left, right = row[inner - 1], row[inner + 1]
            by_left = (left >= 0) & (hashes[inner - 1] != own)
            by_right = (right >= 0) & (hashes[inner + 1] != own)
            words_of += [own[by_left], own[by_right], own]
            cells_of += [x.astype(np.int16) for x in (left[by_left], right[by_right] + _SIDES, np.full(len(own), 2 * _SIDES))]
            size += len(own)
            if size > GATHER:
                yield from summed()
                size = 0
        if words_of:
            yield from summed()

    return docs.select("text").mapInArrow(run, "word long, seen binary")


def _best_classes(word: np.ndarray, home: np.ndarray, cell_of: np.ndarray, count: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of the greatest likelihood for each word, against a fixed table of class pairs.

    Word k has the cells ``bounds[k]:bounds[k + 1]``; ``home`` is its present class or
    -1. What it has put into its home's counts is taken out before it is tried there.
    """
    out = np.zeros(len(word), np.int64)
    # a left neighbour d counts in N(d, c), a right one in N(c, d)
    cells = np.concatenate([table[:, :CLASSES], table[:CLASSES].T])
    margins = np.stack([table.sum(axis=0)[:CLASSES], table.sum(axis=1)[:CLASSES]])
    steps = np.arange(SMALL + 1)[:, None, None]
    of_cells, of_margins = (_xlogx(x + steps) - _xlogx(x) for x in (cells, margins))

    def gains(base: np.ndarray, small: np.ndarray, at: np.ndarray, n: np.ndarray, homes: np.ndarray) -> np.ndarray:
        out = small[np.minimum(n, SMALL), at]
        slow = np.flatnonzero((n > SMALL) | (homes >= 0))
        x = base[at[slow]].astype(np.float64)
        own = np.flatnonzero(homes[slow] >= 0)
        x[own, homes[slow][own]] = np.maximum(x[own, homes[slow][own]] - n[slow][own], 0)
        out[slow] = _xlogx(x + n[slow][:, None]) - _xlogx(x)
        return out

    for a in range(0, len(word), 4096):
        b = min(len(word), a + 4096)
        low, high = bounds[a], bounds[b]
        cell, n, sizes = cell_of[low:high], count[low:high], np.diff(bounds[a : b + 1])
        owner = np.repeat(np.arange(b - a), sizes)
        gain = np.zeros((b - a, CLASSES))
        some = np.flatnonzero(sizes)
        if len(some):
            gain[some] = np.add.reduceat(gains(cells, of_cells, cell, n, home[a:b][owner]), bounds[a:b][some] - low, axis=0)
        for side in range(2):
            total = np.bincount(owner, weights=np.where(cell >= _SIDES, side, 1 - side) * n, minlength=b - a).astype(np.int64)
            gain -= gains(margins, of_margins, np.full(b - a, side), total, home[a:b])
        out[a:b] = gain.argmax(axis=1)
    return out


def assign_classes(contexts: DataFrame, context, table: np.ndarray) -> DataFrame:
    """``word, cls, n_train`` for every word of ``contexts``: the best class by all that its rows have seen together, and its occurrences.

    A word's rows meet in one partition, sorted, and are summed as they stream;
    what a task holds are a batch's words.
    """
    spark = contexts.sparkSession
    fixed = spark.sparkContext.broadcast(table.astype(np.float64))
    dealt = contexts.repartition("word").sortWithinPartitions("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, classes = context.value
        last: int | None = None
        held = np.zeros(2 * _SIDES + 1, np.int64)

        def told(word: np.ndarray, cell: np.ndarray, count: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
            size = 2 * _SIDES + 1
            keys, place = np.unique(owner * np.int64(size) + cell, return_inverse=True)
            total = np.bincount(place, weights=count).astype(np.int64)
            itself = keys % size == 2 * _SIDES
            times = np.zeros(len(word), np.int64)
            times[keys[itself] // size] = total[itself]
            keys, total = keys[~itself], total[~itself]
            bounds = np.searchsorted(keys // size, np.arange(len(word) + 1))
            number = index.find(word.view(np.uint64))
            home = np.where(number >= 0, classes[number], -1).astype(np.int64)
            best = _best_classes(word, home, keys % size, total, bounds, fixed.value)
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(best.astype(np.int32)), pa.array(times)], names=["word", "cls", "n_train"])

        def row_of(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            cell = np.flatnonzero(held)
            return cell, held[cell]

        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = batch.column(1)
            sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64) // 8
            pairs = np.frombuffer(b"".join(raw.to_pylist()), "<i4").reshape(-1, 2).astype(np.int64)
            first = np.concatenate([[True], words[1:] != words[:-1]])
            owner = np.repeat(np.cumsum(first) - 1, sizes)
            distinct = words[first]
            cell, count = pairs[:, 0], pairs[:, 1]
            if last is not None:
                # the word that the batch before ended with may go on
                same = distinct[0] == last
                kept, n = row_of(held)
                if same:
                    cell, count, owner = np.concatenate([kept, cell]), np.concatenate([n, count]), np.concatenate([np.zeros(len(kept), np.int64), owner])
                else:
                    cell, count, owner = np.concatenate([kept, cell]), np.concatenate([n, count]), np.concatenate([np.zeros(len(kept), np.int64), owner + 1])
                    distinct = np.concatenate([[last], distinct])
            ending = owner == len(distinct) - 1
            held = np.bincount(cell[ending], weights=count[ending], minlength=2 * _SIDES + 1).astype(np.int64)
            last = int(distinct[-1])
            if len(distinct) > 1:
                yield told(distinct[:-1], cell[~ending], count[~ending], owner[~ending])
        if last is not None:
            cell, count = row_of(held)
            yield told(np.array([last], np.int64), cell, count, np.zeros(len(cell), np.int64))

    return dealt.mapInArrow(run, "word long, cls int, n_train long")


def class_pairs(docs: DataFrame, context) -> np.ndarray:
    """Counts of neighbouring classes over all texts of ``docs`` among the context's words and the end."""
    size = CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = context.value

        def cells() -> Iterator[np.ndarray]:
            for _, texts in text_slices(batches):
                words = Words(texts)
                number = index.find(words.hash)
                row = _closed(words, np.where(number >= 0, known[number], -1).astype(np.int64), _END)
                good = (row[:-1] >= 0) & (row[1:] >= 0)
                yield row[:-1][good] * size + row[1:][good]

        yield from _matrix(cells(), size * size)

    return merged(docs.select("text").mapInArrow(run, CHUNK_SCHEMA), size * size, "int64", np.add).reshape(size, size)


def cluster_words(taught: DataFrame, distinct: int, frequent, index: HashIndex, context_words: int, head_words: int, rounds: int = ROUNDS) -> tuple[DataFrame, _Known]:
    """``word, cls, n_train`` for every word of ``taught (text)``, and the classes of the ``frequent`` ones (pandas) for every task."""
    spark = taught.sparkSession
    hashes = frequent["word"].to_numpy(np.int64).view(np.uint64)
    head = hashes[:head_words]
    bigrams = head_bigrams(taught, head)
    of = exchange_classes(bigrams, end_apart=True)
    member = np.eye(CLASSES + 1, dtype=np.int64)[of]
    table = member.T @ bigrams @ member
    classes = np.full(len(hashes) + 1, -1, np.int64)  # the last stands for words not found
    classes[: len(head)] = of[:-1]
    shared_index = spark.sparkContext.broadcast(index)
    words = settle(spark.createDataFrame(list(zip(head.view(np.int64).tolist(), of[:-1].tolist(), frequent["n_train"].tolist())), "word long, cls int, n_train long"), "classes")
    for turn in range(rounds if distinct > len(head) else 0):
        context = _Known(spark, shared_index, np.where(np.arange(len(classes)) < min(context_words, len(hashes)), classes, -1))
        table = class_pairs(taught, context) if turn else table
        final = turn == rounds - 1
        seen = context_counts(taught, context, np.sort(head), None if final else context_words)
        if not final:
            moved = assign_classes(seen, context, table).toPandas()
        else:
            rest = settle(assign_classes(seen, context, table), "classes")
            words, before = settle(words.union(rest), "classes"), words
            release(rest, before)
            moved = _among(words, shared_index, len(hashes)).toPandas()
        classes[index.find(moved["word"].to_numpy(np.int64).view(np.uint64))] = moved["cls"].to_numpy()
    return words, _Known(spark, shared_index, classes)


_TOLD = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, pairs binary, word long, other long, left int, right int"


def _told(source: DataFrame, known: _Known, n_train: np.ndarray, ended: int, discount: float, log_tokens: np.ndarray, base_log: float) -> DataFrame:
    """What the held words tell: a row per text and a row per occurrence of another word.

    A text's row has its sums over held words and, as two bytes each, its ``pairs`` of
    neighbouring classes that are both known. The others have their text's ``row``,
    the ``word``, the classes of the words beside it where these are held, and the
    ``other`` word behind it where that one is not.
    """
    spark = source.sparkSession
    times = spark.sparkContext.broadcast(np.append(n_train, 0))
    names = [f.split()[0] for f in _TOLD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, class_of = known.value
        counts_of = times.value
        row = TaskContext.get().partitionId() << 40
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        for part, texts in text_slices(batches):
            words = Words(texts)
            n_docs = len(texts)
            number = index.find(words.hash)
            n, cls = counts_of[number], class_of[number].astype(np.int64)
            held = number >= 0
            emission = np.where(held, np.log10(np.maximum(n - discount, 1e-9)) - log_tokens[np.maximum(cls, 0)], 0.0)
            base = np.where(held, np.log10(n + 1.0), 0.0)
            edge, hashes = _closed(words, cls, _END), _closed(words, words.hash, 0)
            both = (edge[:-1] >= 0) & (edge[1:] >= 0)
            codes = (edge[:-1] * _SIDES + edge[1:])[both].astype("<u2")
            a, b = words.bounds[:-1], words.bounds[1:]
            # step k of all lies before token k, ends counted as tokens
            reached = np.concatenate([[0], np.cumsum(both)])[np.append(a, b[-1:]) + np.arange(n_docs + 1)] * 2
            pairs = pa.Array.from_buffers(pa.binary(), n_docs, [None, pa.py_buffer(reached.astype(np.int32).tobytes()), pa.py_buffer(codes.tobytes())])

            def per_doc(x: np.ndarray) -> np.ndarray:
                s = np.concatenate([[0], np.cumsum(x)])
                return s[b] - s[a]

            tokens = (b - a) + 1
            rows = row + np.arange(n_docs)
            row += n_docs
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows), part.column(0), part.column(1), pa.array(tokens.astype(np.int64)), pa.array(per_doc(held.astype(np.int64)) + (ended > 0)),
                    pa.array(per_doc(base) + np.log10(ended + 1.0) - tokens * base_log), pa.array(per_doc(emission)), pairs, *(pa.nulls(n_docs, t) for t in types[8:]),
                ],
                names=names,
            )
            at = np.flatnonzero(edge[1:] < 0) + 1
            if len(at):
                doc, before, after = words.doc[~held], edge[at - 1], edge[at + 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[doc]), pa.nulls(len(at), pa.int64()), part.column(1).take(pa.array(doc)), *(pa.nulls(len(at), t) for t in types[3:8]),
                        pa.array(hashes[at].astype(np.int64)), pa.array(hashes[at + 1].astype(np.int64), mask=after >= 0),
                        pa.array(before.astype(np.int32), mask=before < 0), pa.array(after.astype(np.int32), mask=after < 0),
                    ],
                    names=names,
                )

    return source.select("doc_id", "held_out", "text").mapInArrow(run, _TOLD)


def _codes_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The numbers packed in a batch's last column, in a row, and where each row's end."""
    raw = batch.column(batch.num_columns - 1)
    sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    return np.frombuffer(b"".join(raw.to_pylist()), "<u2").astype(np.int64), np.cumsum(sizes)


def told_pairs(texts: DataFrame) -> np.ndarray:
    """The sum of all rows' ``pairs`` as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _matrix((_codes_of(batch)[0] for batch in batches), _SIDES * _SIDES)

    return merged(texts.select("pairs").mapInArrow(run, CHUNK_SCHEMA), _SIDES * _SIDES, "int64", np.add).reshape(_SIDES, _SIDES)


def _numbers(column: pa.Array) -> np.ndarray:
    """Whole numbers, -1 for null."""
    return column.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def score_texts(docs: DataFrame, fold: tuple[int, int] = (7, 2), text: str = "text", key: str = "doc_id", held_words: int = 0, context_words: int = CONTEXT_WORDS, head_words: int = HEAD_WORDS) -> DataFrame:
    """Base and model log10 probabilities of every whole text, learned from the documents outside the fold.

    Tokens are lower-cased (A-Z) words and one end. The model's probability of a
    token is P(class | class before) P(token | class): transitions are interpolated
    with the class frequencies, and within a class every training word gives up
    the discount d = n1 / (n1 + 2 n2), which goes to words not seen in training,
    taken together as one outcome, as the base takes them: such a word's probability
    is summed over the classes it may have, and so is what follows it.

    Every training word is clustered by exchange. The ``head_words`` most frequent
    move one by one on the driver (a table of fixed size). Then, in ``ROUNDS`` rounds,
    all other words move to the class that is the most likely by the classes of
    their neighbours, against the table of class pairs of the round before; in the
    first these are the ``context_words`` most frequent, in the last all words. What
    counts as a neighbour are the ``context_words``. The class pairs of the model are
    counted over all training texts and words. Nothing is learned from held-out
    documents.

    All documents are counted. Counts and classes of the context words (or of
    ``held_words``, if these are more) go to every task; each text's other words are
    joined with the table of all words, so no word is frequent in that join.

    Null and empty texts consist of the end alone. A null key is not held out,
    repeated rows are scored once each, an empty table gives no rows; without
    training documents N is 0, the base score 0. Further columns are ignored.
    Different words share a hash with probability about 2**-64.
    """
    modulus, left_out = fold
    source = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(crc_fold(F.col(key).cast("long"), modulus) == left_out, F.lit(False)).alias("held_out"),
        F.col(text).cast("string").alias("text"),
    )
    taught = source.where("not held_out").select("text")
    counts = settle(word_counts(taught), "counts")
    ended = taught.count()
    sums = counts.agg(F.sum("n_train"), F.count("*"), *(F.count_if(F.expr(c)) for c in ("n_train = 1", "n_train = 2"))).first()
    total, distinct = (sums[0] or 0) + ended, sums[1] + (ended > 0)
    discount = sums[2] / (sums[2] + 2 * sums[3]) if sums[2] else 0.5
    discount = min(max(discount, 0.1), 0.9)

    frequent = counts.orderBy(F.desc("n_train"), "word").limit(max(held_words, context_words, head_words)).toPandas()
    hashes = frequent["word"].to_numpy(np.int64).view(np.uint64)
    words, known = cluster_words(taught, sums[1], frequent, HashIndex(hashes), context_words, head_words)
    release(counts)
    by_class = {r[0]: (r[1], r[2]) for r in words.groupBy("cls").agg(F.sum("n_train"), F.count("*")).collect()}
    class_tokens = np.array([by_class.get(c, (0, 0))[0] for c in range(CLASSES)] + [ended], np.float64)
    class_types = np.array([by_class.get(c, (0, 0))[1] for c in range(CLASSES)], np.float64)
    log_tokens = np.log10(np.maximum(np.append(class_tokens[:-1], [1, 1]), 1))
    base_log = float(np.log10(total + distinct + 1))
    told = settle(_told(source, known, frequent["n_train"].to_numpy(np.int64), ended, discount, log_tokens, base_log), "told")

    # the other words' classes, and the pairs that they make
    classes = words.select("word", "cls", F.col("n_train").alias("n"))
    met = told.where("word is not null").select("row", "held_out", "word", "other", "left", "right").join(classes, "word", "left")
    met = settle(met.select("row", "held_out", "other", "left", "right", F.coalesce("cls", F.lit(_UNSEEN)).alias("cls"), F.coalesce("n", F.lit(0)).alias("n")), "met")
    beside = met.where("other is not null").join(classes.select(F.col("word").alias("other"), F.col("cls").alias("next")), "other", "left")
    beside = settle(beside.select("row", "held_out", F.col("cls").alias("a"), F.coalesce("next", F.lit(_UNSEEN)).alias("b")), "beside")
    pairs = told_pairs(told.where("n_tokens is not null and not held_out"))
    around = F.explode(F.array(F.struct(F.col("left").alias("a"), F.col("cls").alias("b")), F.struct(F.col("cls").alias("a"), F.col("right").alias("b")))).alias("p")
    more = met.where("not held_out").select(around).select("p.*").where("a is not null and b is not null").unionByName(beside.where("not held_out").select("a", "b"))
    for one, two, n in more.groupBy("a", "b").count().collect():
        pairs[one, two] += n

    share = (class_tokens + 1) / (class_tokens.sum() + len(class_tokens))
    seen_pairs = (pairs + PRIOR * share) / (pairs.sum(axis=1, keepdims=True) + PRIOR)
    # what a class leaves to words not seen, and which class such a word then has
    left_over = np.append(np.where(class_tokens[:-1] > 0, discount * class_types / np.maximum(class_tokens[:-1], 1), 1.0), 0.0)
    unseen_class = share * left_over / max((share * left_over).sum(), 1e-300)
    whole = np.vstack([seen_pairs, unseen_class @ seen_pairs])
    # the last column and row, of zeros, stand for neighbours counted elsewhere
    transition = np.zeros((CLASSES + 3, CLASSES + 3))
    transition[:-1, :-1] = np.log10(np.hstack([whole, np.maximum(whole @ left_over, 1e-300)[:, None]]))
    result = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    names = [f.split()[0] for f in result.split(", ")]

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = transition[:_SIDES, :_SIDES].ravel()
        for batch in batches:
            codes, ends = _codes_of(batch)
            reached = np.concatenate([[0], np.cumsum(flat[codes])])[np.concatenate([[0], ends])]
            score = batch.column(6).to_numpy(zero_copy_only=False) + np.diff(reached)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(score)], names=names)

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, cls, n = (_numbers(batch.column(k)) for k in range(1, 5))
            emission = np.where(n > 0, np.log10(np.maximum(n - discount, 1e-9)) - log_tokens[np.minimum(cls, CLASSES)], 0.0)
            score = emission + transition[left, cls] + transition[cls, right]
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.nulls(size, pa.int64()), pa.nulls(size, pa.bool_()), pa.nulls(size, pa.int64()), pa.array((n > 0).astype(np.int64)), pa.array(np.log10(n + 1.0)), pa.array(score)], names=names)

    def of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            score = transition[_numbers(batch.column(1)), _numbers(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.nulls(size, pa.int64()), pa.nulls(size, pa.bool_()), *(pa.array(np.zeros(size, np.int64)) if k else pa.nulls(size, pa.int64()) for k in range(2)), pa.array(np.zeros(size)), pa.array(score)], names=names)

    texts = told.where("n_tokens is not null").select(*names, "pairs").mapInArrow(of_texts, result)
    parts = texts.unionAll(met.select("row", "left", "right", "cls", "n").mapInArrow(of_words, result)).unionAll(beside.select("row", "a", "b").mapInArrow(of_pairs, result))
    scored = parts.groupBy("row").agg(*(F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")), *(F.sum(c).alias(c) for c in ("n_known", "base_score", "score")))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _among(rows: DataFrame, index, first: int) -> DataFrame:
    """The rows whose word is one of the ``first`` in a broadcast index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = index.value.find(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            yield batch.filter(pa.array((at >= 0) & (at < first)))

    return rows.mapInArrow(run, rows.schema)
