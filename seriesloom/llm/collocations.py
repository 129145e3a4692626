"""Phrases whose words keep together: n-grams of frequent words as fixed-width keys, sorted by ranges and counted by runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .shared import _BYTE_VALUES, _LOWER, HashIndex, _power_tables, give_back, mix64, release, settle, slices
from .summaries import Sieve, sieve_of

# Fixed values of the word rule: bytes that end words, and those among them that end pieces.
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True

#: Distinct words or keys that a task holds before it hands them on.
HELD = 1 << 19
#: Frequent words up to this number get ids from a dictionary that every task holds (some 24 bytes a word). Where there
#: are more, a word's id is its 64-bit hash, and a sieve of fixed size sifts out most rare words; results are the same.
DICTIONARY_WORDS = 1 << 21
#: Tables of up to so many words or languages are joined by a broadcast.
BROADCAST_ROWS = 1 << 16


class Pieces:
    """Words of a slice of texts: ``piece``, ``start``, ``end`` (in ``data``) and a 64-bit ``hash`` of the language and the word."""

    def __init__(self, texts: list[bytes], salts: np.ndarray) -> None:
        joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.data = _LOWER[joined]
        broken = _BREAK[joined]
        edges = np.flatnonzero(np.diff((broken | _GAP[joined]).view(np.int8), prepend=1, append=1))
        self.start, self.end = edges[::2], edges[1::2]
        self.piece = np.cumsum(broken)[self.start]
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.doc = np.searchsorted(ends, self.start, side="right")
        up, down = _power_tables(len(joined) + 1)
        total = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[self.data] * up[: len(joined)], out=total[1:])
        self.hash = mix64(mix64((total[self.end] - total[self.start]) * down[self.start]) ^ salts[self.doc])


def _salt(lang: str) -> int:
    """A language's share in its words' hashes."""
    raw = np.frombuffer(lang.encode("utf-8"), np.uint8)
    up, _ = _power_tables(len(raw) + 1)
    return int(mix64(np.array([(_BYTE_VALUES[raw] * up[: len(raw)]).sum(dtype=np.uint64) + np.uint64(len(raw) + 1)], np.uint64))[0])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes], np.ndarray]]:
    """Slices of (language, text) rows: their languages, texts and languages' salts."""
    salts: dict[str, int] = {}
    give_back()
    for batch in batches:
        langs = batch.column(0).to_pylist()
        raw = batch.column(1).cast(pa.large_binary())
        for a, b in slices(pc.binary_length(raw).to_pylist()):
            own = langs[a:b]
            for lang in set(own) - salts.keys():
                if len(salts) > 10_000:
                    salts.clear()
                salts[lang] = _salt(lang)
            yield own, raw.slice(a, b - a).to_pylist(), np.array([salts[x] if x in salts else _salt(x) for x in own], np.uint64)
    give_back()


def _spelt(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges of ``data`` as an Arrow array of strings."""
    sizes = end - start
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    own = data[np.repeat(start - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(own)])


class Tally:
    """Counts of distinct words by hash, with their languages and spellings, merged whenever many have come together."""

    def __init__(self) -> None:
        self.size = 0
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]] = []

    def add(self, words: Pieces, langs: list[str]) -> None:
        found, first, counts = np.unique(words.hash, return_index=True, return_counts=True)
        self.parts.append((found, counts, pa.array(langs, pa.string()).take(pa.array(words.doc[first])), _spelt(words.data, words.start[first], words.end[first])))
        self.size += len(found)

    def merge(self) -> None:
        hashes, counts = (np.concatenate([p[k] for p in self.parts]) for k in range(2))
        found, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        counts = np.bincount(place, counts, len(found)).astype(np.int64)
        self.parts = [(found, counts, *(pa.concat_arrays([p[k] for p in self.parts]).take(pa.array(first)) for k in (2, 3)))]
        self.size = len(found)

    def rows(self) -> pa.RecordBatch:
        self.merge()
        ((_, counts, langs, words),) = self.parts
        return pa.RecordBatch.from_arrays([langs, words, pa.array(counts)], names=["lang", "word", "n"])


def _counted_words(texts: DataFrame) -> DataFrame:
    """``lang, word, n``: how often each word occurs in each language, and without a word each language's number of words."""

    def totals_of(totals: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, totals = Tally(), {}
        for langs, raw, salts in _slices(batches):
            words = Pieces(raw, salts)
            for lang, n in zip(langs, np.bincount(words.doc, minlength=len(langs)).tolist()):
                totals[lang] = totals.get(lang, 0) + n
            if len(words.hash):
                tally.add(words, langs)
            if tally.size > 2 * HELD:
                tally.merge()
                if tally.size > HELD:
                    yield tally.rows()
                    tally = Tally()
            if len(totals) > HELD:
                yield totals_of(totals)
                totals = {}
        if tally.size:
            yield tally.rows()
        if totals:
            yield totals_of(totals)

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _hashed(words: DataFrame) -> DataFrame:
    """The words with the ``hash`` that they have in texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                salts = np.array([_salt(x) for x in batch.column(0).to_pylist()], np.uint64)
                own = Pieces(batch.column(1).cast(pa.binary()).to_pylist(), salts)
                yield pa.RecordBatch.from_arrays([pa.array(own.hash.view(np.int64)), *batch.columns], names=["hash", "lang", "word", "n"])

    return words.select("lang", "word", "n").mapInArrow(run, "hash long, lang string, word string, n long")


class Coder:
    """Ids of frequent words, in ``width`` bytes; 0 stands for all others."""

    def __init__(self, words: DataFrame, count: int, most: int = DICTIONARY_WORDS) -> None:
        self.sieve: Sieve | None = None
        if count <= most:
            found = words.orderBy(F.desc("n"), "hash").select("hash").toArrow()
            self.index = HashIndex(found.column(0).to_numpy().astype(np.int64).view(np.uint64))
            self.width = max(1, ((count + 1).bit_length() + 7) // 8)
        else:
            self.sieve, self.width = sieve_of(words.select("hash")), 8

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if self.sieve is not None:
            return np.where(self.sieve.passes(hashes), hashes, np.uint64(0))
        return (self.index.find(hashes) + 1).astype(np.uint64)

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        return ids if self.sieve is not None else self.index.hashes[ids.astype(np.int64) - 1]

    def pack(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ids as rows of bytes that sort like them."""
        wide = ids.astype(">u8").view(np.uint8).reshape(*ids.shape, 8)[..., 8 - self.width :]
        return np.ascontiguousarray(wide).reshape(len(ids), -1)

    def unpack(self, keys: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(keys), keys.shape[1] // self.width, 8), np.uint8)
        wide[..., 8 - self.width :] = keys.reshape(len(keys), -1, self.width)
        return wide.view(">u8")[..., 0].astype(np.uint64)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of fixed-width byte rows, by a radix sort over digits of two bytes, the last first."""
    if keys.shape[1] % 2:
        keys = np.concatenate([keys, np.zeros((len(keys), 1), np.uint8)], axis=1)
    digits = np.ascontiguousarray(keys).view(">u2")
    order = np.arange(len(keys))
    for k in range(digits.shape[1] - 1, -1, -1):
        column = digits[:, k].astype(np.uint16)
        if column.any():
            # the stable sort of 16-bit values is a radix sort
            order = order[np.argsort(column[order], kind="stable")]
    return order


def _binary(rows: np.ndarray) -> pa.Array:
    """Byte rows of one width as an Arrow array."""
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows))])


_CODEC = "zstd"


def pack_block(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts (below 2**32) in few bytes: the keys' first bytes together, then their second ones, and so on."""
    planes = pa.compress(np.ascontiguousarray(keys.T).tobytes(), _CODEC, asbytes=True)
    times = pa.compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), _CODEC, asbytes=True)
    return len(keys).to_bytes(8, "little") + len(planes).to_bytes(8, "little") + planes + times


def unpack_block(raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    n, size = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
    planes = np.frombuffer(pa.decompress(raw[16 : 16 + size], n * width, _CODEC), np.uint8).reshape(width, n)
    times = np.frombuffer(pa.decompress(raw[16 + size :], n * 4, _CODEC), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T), np.ascontiguousarray(times.T).view("<u4").ravel().astype(np.int64)


def sum_equal(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs (or the sum of its counts): a radix sort, then runs."""
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    sums = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts[order], first)
    return keys[first], sums


#: Of each block so many keys tell where ranges are cut, and of all blocks at most about so many.
BLOCK_SAMPLE, MOST_SAMPLE = 256, 1 << 17
#: Keys of a range, about: what a task sorts at once.
RANGE_KEYS = 1 << 21


def _windows(texts: DataFrame, shared, longest: int) -> DataFrame:
    """``block, keys, sample``: windows of ids, sorted and counted together in blocks.

    Every place where two frequent words or more follow each other gives a window: the
    ids of up to ``longest`` of them, zeros behind. A block holds a task's windows since
    its last one; ``keys`` tells how many, ``sample`` holds some of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder: Coder = shared.value
        held, size = [], 0

        def told() -> pa.RecordBatch:
            keys, counts = sum_equal(np.concatenate(held))
            some = keys[np.linspace(0, len(keys) - 1, min(len(keys), BLOCK_SAMPLE)).astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array([pack_block(keys, counts)], pa.binary()), pa.array([len(keys)], pa.int64()), pa.array([some.tobytes()], pa.binary())], names=["block", "keys", "sample"])

        for _, raw, salts in _slices(batches):
            words = Pieces(raw, salts)
            ids = coder.ids(words.hash)
            goes_on = np.zeros(len(ids) + longest, bool)
            goes_on[: max(len(ids) - 1, 0)] = (ids[:-1] > 0) & (ids[1:] > 0) & (words.piece[:-1] == words.piece[1:])
            start = np.flatnonzero(goes_on)
            window = np.zeros((len(start), longest), np.uint64)
            window[:, 0] = ids[start]
            on = np.ones(len(start), bool)
            for k in range(1, longest):
                on &= goes_on[start + k - 1]
                window[on, k] = ids[start[on] + k]
            if len(window):
                held.append(coder.pack(window))
                size += len(window)
                if size > HELD:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()
        give_back()

    return texts.mapInArrow(run, "block binary, keys long, sample binary")


def _counted_runs(blocks: DataFrame, width: int, longest: int, least: int) -> DataFrame:
    """``phrase, a``: how often each phrase of two words or more occurs, if at least ``least`` times, from blocks of windows.

    Blocks are cut at bounds that a sample of their keys gives, so ranges hold about as many
    keys, a common phrase being one key a block. A range is sorted as a whole. A phrase's
    occurrences are the windows that begin with it, which lie side by side: one run of
    its bytes. Runs at a range's edges may go on in the next one and are summed
    afterwards, so no phrase, however frequent, has to lie in one task.
    """
    spark = blocks.sparkSession
    row = width * longest
    total, many = blocks.agg(F.sum("keys"), F.count("*")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(tasks, -(-(total or 0) // RANGE_KEYS))
    share = MOST_SAMPLE / max(1, many * BLOCK_SAMPLE)
    some = blocks.select("sample") if share >= 1 else blocks.select("sample").sample(share, seed=5)
    found = np.concatenate([np.zeros((0, row), np.uint8), *(np.frombuffer(r[0], np.uint8).reshape(-1, row) for r in some.collect())])
    found = found[radix_order(found)]
    bounds = np.unique(np.ascontiguousarray(found[np.linspace(0, len(found) - 1, ranges + 1).astype(np.int64)[1:-1]]).view(f"S{row}").ravel()) if len(found) else np.zeros(0, f"S{row}")
    shared = spark.sparkContext.broadcast(bounds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                keys, counts = unpack_block(raw.as_py(), row)
                # fixed-width strings of bytes compare like the rows
                edges = [0, *np.searchsorted(keys.view(f"S{row}").ravel(), shared.value, side="left").tolist(), len(keys)]
                parts = [(k, pack_block(keys[a:b], counts[a:b])) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["range", "block"])

    def runs_of(held: list[bytes]) -> pa.RecordBatch:
        parts = [unpack_block(raw, row) for raw in held]
        keys, counts = sum_equal(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        changed = np.zeros(len(keys) - 1, bool)
        phrases, times = [], []
        differ = (keys[1:] != keys[:-1]).reshape(len(keys) - 1, longest, width).any(axis=2)
        for k in range(longest):
            changed = changed | differ[:, k]
            if k:
                first = np.concatenate([[0], np.flatnonzero(changed) + 1])
                sums = np.add.reduceat(counts, first)
                good = sums >= least
                good[[0, -1]] = True
                good &= keys[first][:, k * width : (k + 1) * width].any(axis=1)
                phrases += [keys[f, : (k + 1) * width].tobytes() for f in first[good]]
                times.append(sums[good])
        return pa.RecordBatch.from_arrays([pa.array(phrases, pa.binary()), pa.array(np.concatenate(times), pa.int64())], names=["phrase", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and number != current:
                    yield runs_of(held)
                    held = []
                current = number
                held.append(raw.as_py())
        if held:
            yield runs_of(held)
        give_back()

    dealt = blocks.select("block").mapInArrow(cut, "range int, block binary").repartition(min(ranges, 4 * tasks), "range").sortWithinPartitions("range")
    return dealt.mapInArrow(run, "phrase binary, a long").groupBy("phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _checked(df: DataFrame, rows: int) -> DataFrame:
    """For a broadcast, where it has few enough rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def mine_phrases(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, lang: str = "lang", text: str = "text", dictionary: int = DICTIONARY_WORDS) -> DataFrame:
    """Each language's phrases of 2 to ``longest`` words whose words keep together: ``lang, rank, phrase, a, l, r, n, score``.

    Words are lower-cased (A-Z), end at blanks and tabs, and phrases don't reach over
    ``.,;:!?`` or line ends. ``a`` is how often the phrase occurs (``least`` times or
    more), ``l`` and ``r`` its two parts at the cut that scores lowest, ``n`` the
    language's number of words, ``score`` floor(1000 a n / (l r)); the first of cuts
    with equal scores counts. A phrase inside a longer one that occurs as often is
    left out. The first ``top`` by score, count and phrase are returned.

    Two passes over the texts: words are counted by hash, then windows of frequent
    words' ids are sorted and counted in blocks per task. Blocks are written, cut into
    ranges of their keys, dealt by range, sorted, and counted by runs; what is shuffled
    are packed arrays of keys. A common phrase is one key a block.

    A null text has no words, a null language is ``und``; repeated rows count each
    time; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    counted = settle(_counted_words(texts), "words")
    totals = counted.where("word is null").select("lang", F.col("n").alias("total"))
    words = settle(_hashed(counted.where((F.col("n") >= least) & F.col("word").isNotNull())), "frequent")
    frequent, languages = words.count(), totals.count()
    coder = Coder(words, frequent, dictionary)
    width = coder.width
    shared = spark.sparkContext.broadcast(coder)
    windows = settle(_windows(texts, shared, longest), "windows")
    phrases = settle(_counted_runs(windows, width, longest, least), "phrases")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            if len(hashes):
                yield pa.RecordBatch.from_arrays([_binary(shared.value.pack(shared.value.ids(hashes)[:, None])), *batch.columns[1:]], names=["part", *batch.schema.names[1:]])

    named = words.join(_checked(totals, languages), "lang").select("hash", "lang", "word", "n", "total")
    named = settle(named.mapInArrow(coded, "part binary, lang string, word string, n long, total long"), "named")

    # parts' counts: of single words from the table of words, of others from the phrases
    size = F.octet_length("phrase")
    cuts = phrases.select("phrase", "a", F.explode(F.sequence(F.lit(1), (size / width).cast("int") - 1)).alias("cut"))
    cuts = cuts.select("phrase", "a", "cut", F.expr(f"substring(phrase, 1, cut * {width})").alias("left"), F.expr(f"substring(phrase, cut * {width} + 1)").alias("right"))
    single = _checked(named.select("part", "n"), frequent)
    several = phrases.select(F.col("phrase").alias("part"), F.col("a").alias("many"))
    for side, count in (("left", "l"), ("right", "r")):
        alone = F.octet_length(side) == width
        short = cuts.where(alone).join(single.withColumnsRenamed({"part": side, "n": count}), side)
        long = cuts.where(~alone).join(several.withColumnsRenamed({"part": side, "many": count}), side)
        cuts = short.unionByName(long)
    firsts = _checked(named.select(F.col("part").alias("first"), "lang", "total"), frequent)
    cuts = cuts.withColumn("first", F.expr(f"substring(phrase, 1, {width})")).join(firsts, "first").select("phrase", "lang", "a", "cut", "l", "r", F.col("total").alias("n"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # whole numbers of any size: the products pass 64 bits
            scores = [1000 * a * n // (l * r) for a, l, r, n in zip(*(batch.column(c).to_pylist() for c in ("a", "l", "r", "n")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.int64())], names=[*batch.schema.names, "score"])

    cuts = cuts.mapInArrow(scored, T.StructType([*cuts.schema.fields, T.StructField("score", T.LongType())]))
    lowest = cuts.groupBy("phrase").agg(F.min(F.struct("score", "cut", "lang", "a", "l", "r", "n")).alias("best")).select("phrase", "best.*")

    # a longer phrase that occurs as often covers all between, so one word more is all that has to be looked at
    longer = phrases.where(size > 2 * width).select("a", F.explode(F.array(F.expr(f"substring(phrase, 1, octet_length(phrase) - {width})"), F.expr(f"substring(phrase, {width} + 1)"))).alias("phrase"))
    kept = lowest.join(longer.distinct(), ["phrase", "a"], "left_anti")

    spelt = phrases.select("phrase", F.posexplode(F.sequence(F.lit(0), (size / width).cast("int") - 1)).alias("place", "_")).select("phrase", "place", F.expr(f"substring(phrase, place * {width} + 1, {width})").alias("part"))
    spelt = spelt.join(_checked(named.select("part", "word"), frequent), "part").groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))
    spelt = spelt.select("phrase", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("spelt"))

    w = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "spelt")
    ranked = kept.join(spelt, "phrase").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    out = settle(ranked.select("lang", F.col("rank").cast("long").alias("rank"), F.col("spelt").alias("phrase"), "a", "l", "r", "n", "score"), "phrases-ranked")
    release(counted, words, windows, phrases, named)
    shared.destroy()
    return out
