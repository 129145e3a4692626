"""Spelling variants: words at one edit from each other, found by automata over their halves, and the form that each belongs to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import release, settle, text_slices

# Fixed values of the word rule: runs of these letters (in UTF-8), and how some occurrences are misspelt.
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xbf\xc3]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MISSPELT_EVERY = 199

#: Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 200_000
#: Texts are searched for runs in parts of about this many bytes.
PART_BYTES = 1 << 20


def misspelt(run: bytes, key: bytes) -> bytes:
    """The lower-cased run, or where its checksum with the document's key says so, the run without one code point."""
    h = zlib.crc32(run, zlib.crc32(key))
    if h % MISSPELT_EVERY:
        return run
    letters = run.decode("utf-8")
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode("utf-8")


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts that begin and end between runs."""
    at = 0
    while len(text) - at > PART_BYTES:
        gap = _GAP.search(text, at + PART_BYTES)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:] if at else text


def word_table(docs: DataFrame, shortest: int = 6, fewest: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``word, n``: the words of at least ``shortest`` code points that occur at least ``fewest`` times in all texts.

    Tasks count what they read before anything is shuffled, so a frequent word is
    one row a task. Null texts have no words; a null key is the empty key; repeated
    rows count each time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for part, raw in text_slices(batches):
            for name, body in zip(part.column(0).to_pylist(), raw):
                name = f"{'' if name is None else name}:".encode()
                runs: Counter[bytes] = Counter()
                for piece in _parts(body.translate(_LOWER)):
                    runs.update(_RUN.findall(piece))
                for letters, n in runs.items():
                    # no run gets longer, so shorter ones need no look
                    if len(letters) - letters.count(b"\xc3") >= shortest:
                        word = misspelt(letters, name)
                        if word is letters or len(word) - word.count(b"\xc3") >= shortest:
                            held[word] += n
                if len(held) > HELD_WORDS:
                    yield told()
        if held:
            yield told()

    rows = docs.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


# ---- segments


def bounds(length: int, level: int) -> list[int]:
    """Where a word of this length is cut into 2**level segments; each level cuts the segments of the one before."""
    parts = 1 << level
    return [k * length // parts for k in range(parts + 1)]


#: (level, length of the held word, free segment) as one number.
def _slot(level: int, length: int, free: int) -> int:
    return (level << 56) | (length << 24) | free


def _unslot(slot: int) -> tuple[int, int, int]:
    return slot >> 56, (slot >> 24) & 0xFFFFFFFF, slot & 0xFFFFFF


def _free_letters(slot: Column) -> Column:
    """How many code points of the held word the slot's segment leaves free."""
    level, length, free = F.shiftright(slot, 56), F.shiftright(slot, 24).bitwiseAND(F.lit(0xFFFFFFFF)), slot.bitwiseAND(F.lit(0xFFFFFF))

    def cut(k: Column) -> Column:
        return F.floor(k * length / F.pow(F.lit(2.0), level))

    return cut(free + 1) - cut(free)


def _kept(word: str, slot: int) -> tuple[str, str] | None:
    """What of ``word`` lies before and behind the free segment, seen from a held word of the slot's length."""
    level, length, free = _unslot(slot)
    cut = bounds(length, level)
    behind = length - cut[free + 1]
    if cut[free] + behind > len(word):
        return None
    return word[: cut[free]], word[len(word) - behind :]


def _place(slot: int, kept: tuple[str, str]) -> int:
    """Where a slot and what is kept meet: 63 bits."""
    return (zlib.crc32(kept[0].encode(), slot & 0xFFFFFFFF) << 31) ^ zlib.crc32(kept[1].encode(), slot >> 32) ^ (slot >> 24) * 0x9E3779B1 & 0x7FFFFFFFFFFFFFFF


ROWS = "place long, slot long, word string, n long, held boolean"


def _places(words: DataFrame) -> DataFrame:
    """Every word as a held word (both halves) and as a scanned one (at the halves that words of near lengths may have)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                rows = []
                for word, n in zip(*(batch.column(c).slice(k, 4096).to_pylist() for c in range(2))):
                    size = len(word)
                    rows += [(_place(s, _kept(word, s)), s, word, n, True) for s in (_slot(1, size, 0), _slot(1, size, 1))]
                    for s in (_slot(1, size + d, free) for d in (-1, 0, 1) for free in (0, 1)):
                        kept = _kept(word, s)
                        if kept is not None:
                            rows.append((_place(s, kept), s, word, n, False))
                yield _row_batch(rows)

    return words.mapInArrow(run, ROWS)


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=["place", "slot", "word", "n", "held"])


def _finer(rows: DataFrame) -> DataFrame:
    """The rows at the two segments that each one's free segment is cut into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                out = []
                for slot, word, n, held in zip(*(batch.column(c).slice(k, 4096).to_pylist() for c in range(1, 5))):
                    level, length, free = _unslot(slot)
                    cut = bounds(length, level + 1)
                    for child in (2 * free, 2 * free + 1):
                        # an empty segment frees nothing; an insertion there is one into its neighbour too
                        if cut[child] < cut[child + 1]:
                            s = _slot(level + 1, length, child)
                            kept = _kept(word, s)
                            if kept is not None:
                                out.append((_place(s, kept), s, word, n, held))
                yield _row_batch(out)

    return rows.select("place", "slot", "word", "n", "held").mapInArrow(run, ROWS)


#: More held words than this at one place are told apart by finer segments.
MOST_TOGETHER = 4_096
#: Held segments of one automaton.
SHARD_SEGMENTS = 1 << 16
#: Tables of up to so many rows (of two numbers) are broadcast.
BROADCAST_ROWS = 1 << 17


class Shard:
    """An automaton over the kept segments of a shard's held words, and what is near to a scanned word."""

    def __init__(self, rows: list[tuple[int, str, int]]) -> None:
        self.words = [w for _, w, _ in rows]
        self.counts = np.array([n for _, _, n in rows], np.int64)
        groups: dict[str, dict[tuple[int, bool, str], list[int]]] = {}
        for k, (slot, word, _) in enumerate(rows):
            before, behind = _kept(word, slot)
            first = len(before) >= len(behind)
            segment, other = (before, behind) if first else (behind, before)
            groups.setdefault(segment, {}).setdefault((slot, first, other), []).append(k)
        self.automaton = ahocorasick.Automaton()
        for segment, held in groups.items():
            by_slot: dict[tuple[int, bool], dict[str, np.ndarray]] = {}
            for (slot, first, other), ks in held.items():
                by_slot.setdefault((slot, first), {})[other] = np.array(ks, np.int64)
            self.automaton.add_word(segment, (len(segment), [(_unslot(s)[1], f, s, m) for (s, f), m in by_slot.items()]))
        self.automaton.make_automaton()
        self.letters = _letters(self.words)

    def candidates(self, word: str) -> Iterator[np.ndarray]:
        """Held words of which a segment stands where it must in ``word``, and whose length fits."""
        size = len(word)
        for end, (length, held) in self.automaton.iter(word):
            at_start, at_end = end == length - 1, end == size - 1
            if at_start or at_end:
                for own, first, slot, others in held:
                    if -1 <= own - size <= 1 and (at_start if first else at_end):
                        kept = _kept(word, slot)
                        if kept is not None:
                            found = others.get(kept[1] if first else kept[0])
                            if found is not None:
                                yield found

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``words``, held word) that are one edit apart; a pair may come twice."""
        scanned, held = [], []
        left, right, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        letters = _letters(words)

        def verify() -> None:
            nonlocal scanned, held, size
            if held:
                a, b = np.repeat(np.array([s for s, _ in scanned]), [n for _, n in scanned]), np.concatenate(held)
                good = one_edit(letters, self.letters, a, b, words, self.words)
                left.append(a[good])
                right.append(b[good])
            scanned, held, size = [], [], 0

        for k, word in enumerate(words):
            for found in self.candidates(word):
                scanned.append((k, len(found)))
                held.append(found)
                size += len(found)
                if size > 1 << 16:
                    verify()
        verify()
        return np.concatenate(left), np.concatenate(right)


#: Words of up to so many code points are compared as rows of a matrix, longer ones one by one.
MATRIX_LETTERS = 32


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of code points (all below 256, 0 behind their ends), and their lengths."""
    sizes = np.array([len(w) for w in words], np.int64)
    rows = np.array([w[:MATRIX_LETTERS].encode("latin-1", "replace") for w in words], f"S{MATRIX_LETTERS}")
    return rows.view(np.uint8).reshape(len(words), MATRIX_LETTERS), sizes


def is_one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def one_edit(left, right, a: np.ndarray, b: np.ndarray, left_words: list[str], right_words: list[str]) -> np.ndarray:
    """Which of the pairs (a of the left, b of the right) are exactly one edit apart."""
    (rows, sizes), (other_rows, other_sizes) = left, right
    na, nb = sizes[a], other_sizes[b]
    x, y = rows[a], other_rows[b]
    longer = na > nb
    x[longer], y[longer] = y[longer], x[longer].copy()
    differ = x != y
    none = ~differ.any(axis=1)
    same = np.where(none, MATRIX_LETTERS, differ.argmax(axis=1))
    place = np.arange(MATRIX_LETTERS - 1)
    shifted = ((x[:, :-1] == y[:, 1:]) | (place[None, :] < same[:, None])).all(axis=1)
    good = np.where(na == nb, differ.sum(axis=1) == 1, shifted & (abs(na - nb) == 1))
    for k in np.flatnonzero((na > MATRIX_LETTERS) | (nb > MATRIX_LETTERS)):
        good[k] = is_one_edit(left_words[a[k]], right_words[b[k]])
    return good


PAIRS = "word string, near string, near_n long"


def near_words(words: DataFrame, together: int = MOST_TOGETHER) -> DataFrame:
    """``word, near, near_n``: all pairs of different words at exactly one edit, both ways round, each once.

    ``words`` has ``word`` (distinct, code points below 256) and ``n``. Every word is
    held by its two halves and scanned against the automata of those shards that
    may hold a half of a near word: if a word is one edit from a held word, the half
    that the edit doesn't touch stands unchanged at its start or its end. Where more
    than ``together`` words share a half, the other half is halved again, and so on
    down to single letters, so no place holds more words than that or than there are
    letters. Places, not pairs, are shuffled: at most eight rows a word and level.
    """
    spark = words.sparkSession
    level = _places(words)
    kept, spent = [], []
    while True:
        level = settle(level, "places")
        spent.append(level)
        # single letters cannot be halved, and words that differ in one letter only are few
        at_place = level.where("held").groupBy("place", "slot").agg(F.count("*").alias("many"))
        hot = settle(at_place.where((F.col("many") > together) & (_free_letters(F.col("slot")) > 1)).select("place", "slot"), "crowded")
        spent.append(hot)
        crowded = hot.count()
        if not crowded:
            kept.append(level)
            break
        few = F.broadcast(hot) if crowded <= BROADCAST_ROWS else hot
        kept.append(level.join(few, ["place", "slot"], "left_anti"))
        level = _finer(level.join(few, ["place", "slot"], "left_semi"))
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    segments = rows.where("held").count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(tasks, -(-segments // SHARD_SEGMENTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, shard = None, [], None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if numbers[a] != current:
                    current, held, shard = numbers[a], [], None
                part = batch.slice(a, b - a)
                is_held = part.column(1).to_numpy(zero_copy_only=False)
                own = int(np.searchsorted(~is_held, True))
                if own:
                    held += list(zip(*(part.column(c).slice(0, own).to_pylist() for c in (2, 3, 4))))
                for k in range(own, len(is_held), 2048):
                    scanned = list(dict.fromkeys(part.column(3).slice(k, min(2048, len(is_held) - k)).to_pylist()))
                    if not held:
                        break
                    shard = shard or Shard(held)
                    left, right = shard.near(scanned)
                    if len(left):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([scanned[i] for i in left], pa.string()), pa.array([shard.words[i] for i in right], pa.string()), pa.array(shard.counts[right])],
                            names=["word", "near", "near_n"],
                        )

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("place", "slot"), F.lit(shards)).cast("int"))
    # a scanned word comes to a shard once, however many of its places lie there
    scanned = dealt.where(~F.col("held")).select("shard", "held", F.lit(0).cast("long").alias("slot"), "word", "n").dropDuplicates(["shard", "word"])
    dealt = dealt.where("held").select("shard", "held", "slot", "word", "n").unionByName(scanned)
    sorted_rows = dealt.repartition(tasks if shards == tasks else min(shards, 4 * tasks), "shard").sortWithinPartitions("shard", F.desc("held"))
    pairs = settle(sorted_rows.mapInArrow(run, PAIRS).repartition("word").dropDuplicates(["word", "near"]), "near")
    release(*spent)
    return pairs


#: Chains of forms grow by a factor of five in n at every step, so they are short; pointers double in each round.
MOST_ROUNDS = 64


def variant_forms(words: DataFrame, factor: int = 5, together: int = MOST_TOGETHER) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for a table of distinct words and their counts.

    A word's form is its most frequent near word (ties: the first in code-point
    order), if that is at least ``factor`` (2 or more) times as frequent; its root is where forms
    lead in the end, itself if it has none. An empty table gives no rows.
    """
    words = settle(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_words(words, together)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    all_words = words.join(best, "word", "left")
    enough = -F.col("best.less") >= F.lit(factor) * F.col("n")
    told = settle(
        all_words.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")),
        "forms",
    )
    release(pairs)
    links = settle(told.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    for _ in range(MOST_ROUNDS):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        jumped = settle(links.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        moved = jumped.where("moved").limit(1).count()
        release(links)
        links = jumped.drop("moved")
        if not moved:
            break
    return told.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, shortest: int = 6, fewest: int = 5, factor: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Words of all texts with their forms and roots (see ``word_table`` and ``variant_forms``)."""
    return variant_forms(word_table(docs, shortest, fewest, text, key), factor)
