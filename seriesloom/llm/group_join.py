"""Exact Jaccard self-join of word shingles through a token-group matrix."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .shared import hot_keys, map_batches, mix64, numbered, parts_of, release, settle, shingle_sets, spread_join, text_slices
from .summaries import CHUNK_SCHEMA, chunk_rows, merged, sieve_of

WIDTH = 5
PERCENT = 80
#: Minimum hashes per document, used to form the first groups.
BANDS = 6
#: Members of a group, about; larger classes are cut into several groups.
GROUP = 32
#: Cells of the shingle counts that order a document's shingles from rare to frequent.
SKETCH_BITS = 24
#: Steps of a cell's code for a doubling of its count; 255 is reached beyond any number of documents.
CODE_STEPS = 6

_BAND_FACTORS = np.random.default_rng(15485863).integers(1, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def links(inter: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """Whether the intersection is at least ``percent`` hundredths of the union."""
    return inter * (100 + percent) >= percent * (a + b)


def node_of(shingles: np.ndarray) -> int:
    """A set's 64-bit name; different sets share one with probability about 2**-64."""
    raw = int(np.bitwise_xor.reduce(shingles)) * 0x9E3779B97F4A7C15 + int(shingles.sum(dtype=np.uint64)) + len(shingles)
    return int(mix64(np.array([raw & (1 << 64) - 1], np.uint64)).astype(np.int64)[0])


def _cell(shingles: np.ndarray) -> np.ndarray:
    return shingles >> np.uint64(64 - SKETCH_BITS)


def _capped_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of one task's counts of a byte; 255 stands for that many or more."""
    return np.minimum(a.astype(np.int64) + b, 255).astype(np.uint8)


def _codes(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of a byte, which keeps their order and has no end that counts reach."""
    return np.minimum(np.round(CODE_STEPS * np.log2(1.0 + counts)), 255).astype(np.uint8)


def _sketch(docs: DataFrame, width: int) -> np.ndarray:
    """About how many documents hold a shingle of each hash cell, as ``_codes``: of fixed size, made from all documents.

    Tasks count up to 255 in themselves, the tasks that merge add these up without a
    bound, and only the sums become codes. Rare shingles of one cell cannot be told apart, so where there
    are many more shingles than cells only the frequent ones stand out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint8)
        for _, texts in text_slices(batches):
            cells, held = np.unique(np.concatenate([_cell(s) for s in shingle_sets(texts, width)]), return_counts=True)
            counts[cells] = _capped_sum(counts[cells], held)
        rows = list(chunk_rows(counts))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "cells"])

    return merged(map_batches(docs, ["text"], CHUNK_SCHEMA, run), 1 << SKETCH_BITS, "uint8", lambda a, b: a.astype(np.int64) + b, _codes, "uint8")


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many of a set's n shingles are probed and how many indexed.

    Sets that link share ``ceil(p n)`` shingles at least, so one of the first
    ``n - ceil(p n) + 1`` is shared; against sets that are no smaller, the first
    ``n - ceil(2 p n / (1 + p)) + 1`` are enough. If two sets link, the larger
    one's probed shingles meet the smaller one's indexed ones.
    """
    return n + 1 - -(-percent * n // 100), n + 1 - -(-2 * percent * n // (100 + percent))


def _signatures(docs: DataFrame, sketch, width: int, percent: int) -> DataFrame:
    """A row per document: its row's name, name, size and minimum hashes of its set, how common its shingles are, and the probed ones.

    ``rare`` holds a set's probed shingles, ordered by their sketch count and then
    by hash (the same order for all sets). Of several documents of a slice with
    one set, only the first has ``keys`` and ``rare``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for part, texts in text_slices(batches):
            nodes, sizes, keys, common, rare = [], [], [], [], []
            seen: set[int] = set()
            for s in shingle_sets(texts, width):
                n = len(s)
                node = node_of(s) if n else None
                nodes.append(node)
                sizes.append(n)
                if not n or node in seen:
                    for column in (keys, common, rare):
                        column.append(None)
                    continue
                seen.add(node)
                held = counts[_cell(s)]
                keys.append((s[:, None] * _BAND_FACTORS).min(axis=0).astype(np.int64))
                common.append(float(held.mean()))
                rank = held.astype(np.uint64) << np.uint64(40) | s >> np.uint64(24)
                rare.append(s[np.argsort(rank, kind="stable")[: prefix_lengths(n, percent)[0]]].astype(np.int64))
            listed = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, listed), pa.array(common, pa.float64()), pa.array(rare, listed)],
                names=["doc_id", "row", "node", "n", "keys", "common", "rare"],
            )

    return map_batches(docs, ["doc_id", "row", "text"], "doc_id long, row long, node long, n long, keys array<long>, common double, rare array<long>", run)


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text``: the text of the row that stands for each wanted node ``(node, row)``, packed by zlib for its travels.

    Rows are found by their names, so no set is made again. A sieve keeps most
    other texts from being packed and shuffled.
    """
    sieve = docs.sparkSession.sparkContext.broadcast(sieve_of(nodes.select("row")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = (b.filter(pa.array(sieve.value.passes(b.column(0).to_numpy().view(np.uint64)))) for b in batches)
        for part, texts in text_slices(passed):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([zlib.compress(t, 1) for t in texts], pa.binary())], names=["row", "text"])

    found = map_batches(docs, ["row", "text"], "row long, text binary", run)
    return found.dropDuplicates(["row"]).join(nodes, "row").select("node", "text")


def _in_streams(members: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """Rows ``(key, part, asks, node, text)``, sorted so that a task reads each key's members and then its queries.

    Members and queries have ``(key, node, text)``. A key of many queries is cut
    into parts that each get its members; no part is held by a task as a whole.
    """
    hot = hot_keys(queries.select(key), key)
    if hot:
        parts = parts_of(queries.sparkSession, hot, key)
        asked = queries.join(parts, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0)).cast("int"))
        told = members.join(parts, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), (F.coalesce("parts", F.lit(1)) - 1).cast("int"))))
    else:
        asked, told = (rows.withColumn("part", F.lit(0)) for rows in (queries, members))
    asked, told = (rows.select(key, "part", F.lit(asks).alias("asks"), "node", "text") for rows, asks in ((asked, True), (told, False)))
    return told.unionByName(asked).repartition(key, "part").sortWithinPartitions(key, "part", "asks")


def _linked(streams: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between the queries of a stream and one member each of the same key.

    The members' shingles make the key's row of the token-group matrix: a query is
    compared with the members only if its overlap with their union reaches what a
    link with any of them needs. A task holds the members of one key and a slice
    of queries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, sets = None, [], []
        union, holds, sizes = np.zeros(0, np.uint64), None, np.zeros(0, np.int64)
        for part, texts in text_slices(batches, packed=True):
            found: list[tuple[int, int]] = []
            key, piece, asks, node = (part.column(k).to_pylist() for k in range(4))
            for k, own in enumerate(shingle_sets(texts, width)):
                if (key[k], piece[k]) != at:
                    at, names, sets, holds = (key[k], piece[k]), [], [], None
                if not asks[k]:
                    names.append(node[k])
                    sets.append(own)
                    continue
                if holds is None and names:
                    sizes = np.array([len(s) for s in sets])
                    union, place = np.unique(np.concatenate(sets), return_inverse=True)
                    holds = np.zeros((len(sets), len(union)), bool)
                    holds[np.repeat(np.arange(len(sets)), sizes), place] = True
                    sets = []
                if not names or not len(union) or not len(own):
                    continue
                seen = np.minimum(np.searchsorted(union, own), len(union) - 1)
                seen = seen[union[seen] == own]
                if 100 * len(seen) < percent * len(own):
                    continue
                good = links(np.count_nonzero(holds[:, seen], axis=1), len(own), sizes, percent)
                if good.any():
                    found.append((node[k], names[int(good.argmax())]))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return streams.mapInArrow(run, "a long, b long")


def _tokens(told: DataFrame, percent: int, standing, sieve=None) -> DataFrame:
    """The rare shingles ``token, node, n, indexed, rest`` of every set, or only ``token``; with a sieve those that it lets pass.

    Of the rows that have one set only those take part that ``standing``, a sieve of
    rows, lets pass. ``rest`` tells how many of the set's shingles come at or after
    the token in the common order.
    """
    narrow = sieve is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = whole.filter(pa.array(standing.value.passes(whole.column(3).to_numpy().view(np.uint64))))
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                rare = part.column(2)
                token = rare.flatten().to_numpy()
                if narrow:
                    yield pa.RecordBatch.from_arrays([pa.array(token)], names=["token"])
                    continue
                lengths = pc.list_value_length(rare).to_numpy(zero_copy_only=False)
                n = part.column(1).to_numpy()
                owner = np.repeat(np.arange(len(n)), lengths)
                place = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                hit = sieve.value.passes(token.view(np.uint64))
                token, owner, place = token[hit], owner[hit], place[hit]
                size = n[owner]
                indexed = place < size + 1 - -(-2 * percent * size // (100 + percent))
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(part.column(0).to_numpy()[owner]), pa.array(size), pa.array(indexed), pa.array(size - place)], names=["token", "node", "n", "indexed", "rest"])

    schema = "token long" if narrow else "token long, node long, n long, indexed boolean, rest long"
    return told.where("rare is not null").select("node", "n", "rare", "row").mapInArrow(run, schema)


def _classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows ``(doc_id, row, node, n)`` of ``docs (doc_id, row, text)``, and per node ``(node, root, copies, first)``.

    ``first`` is the row that stands for the node: ``(no key, key, row)``, the least.
    """
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(_sketch(docs, width))
    told = settle(_signatures(docs, sketch, width, percent), "signatures")
    sketch.destroy()
    named = told.where("keys is not null").groupBy("node").agg(F.max("common").alias("common"), F.first("keys").alias("keys"))
    stands = F.min(F.struct(F.col("doc_id").isNull().alias("no_key"), "doc_id", "row")).alias("first")
    nodes = settle(named.join(told.where("node is not null").groupBy("node").agg(stands, F.count("*").alias("copies")), "node"), "nodes")
    row_of = nodes.select("node", F.col("first.row").alias("row"))

    keyed = nodes.select("node", "common", F.posexplode("keys").alias("band", "key"))
    leaders = keyed.groupBy("band", "key").agg(F.max(F.struct("common", "node"))["node"].alias("leader"), F.count("*").alias("many")).where("many > 1")
    pairs = keyed.select(F.xxhash64("band", "key").alias("at"), "node").transform(lambda d: spread_join(d, leaders.select(F.xxhash64("band", "key").alias("at"), "leader"), "at"))
    first = settle(pairs.where("node <> leader").select("node", "leader").distinct(), "pairs")
    ends = settle(first.select("node").union(first.select(F.col("leader").alias("node"))).distinct().join(row_of, "node"), "ends")
    texts = settle(_texts_of(docs, ends), "texts")
    led = first.select(F.col("leader").alias("node")).distinct().join(texts, "node").select(F.col("node").alias("leader"), "node", "text")
    near = settle(_linked(_in_streams(led, first.join(texts, "node"), "leader"), width, percent), "links")
    release(first, ends, texts)
    classes = components(near)

    # the token-group matrix
    roots = nodes.select("node").join(classes, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    part = F.when(F.col("size") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / GROUP)))
    assigned = settle(spread_join(roots, sizes, "root").select("node", "root", F.xxhash64("root", part).alias("group")), "assigned")
    standing = spark.sparkContext.broadcast(sieve_of(row_of.select("row")))
    shared = settle(_tokens(told, percent, standing).groupBy("token").count().where("count > 1").select("token"), "tokens")
    sieve = spark.sparkContext.broadcast(sieve_of(shared))
    rare = settle(_tokens(told, percent, standing, sieve).join(assigned, "node"), "rare")
    sieve.destroy()
    standing.destroy()
    # of two sets that link, the first token they share leaves enough in both to reach what the link needs
    enough = f"{100 + percent} * least(rest, other_rest) >= {percent} * (fewest + {{}})"
    by_token = rare.repartition("token")
    probed = by_token.groupBy("token", "root").agg(F.max("n").alias("most"), F.min("n").alias("smallest"), F.max("rest").alias("rest"))
    matrix = by_token.where("indexed").groupBy("token", F.col("root").alias("other"), "group").agg(F.min("n").alias("fewest"), F.max("n").alias("largest"), F.max("rest").alias("other_rest"))
    indexed = matrix.groupBy("token", "other").agg(F.min("fewest").alias("fewest"), F.max("other_rest").alias("other_rest"))
    met = indexed.join(probed, "token").where("other <> root and fewest <= most").where(enough.format("smallest")).select("token", "root", "other")
    asked = by_token.select("token", "root", "node", "n", "rest").join(met, ["token", "root"])
    candidates = asked.join(matrix, ["token", "other"]).where(f"fewest <= n and 100 * largest >= {percent} * n").where(enough.format("n")).select("node", "group").distinct()
    # all of these meet by token first, so that one shuffle by token serves them
    candidates = settle(candidates, "candidates", {"spark.sql.requireAllClusterKeysForCoPartition": "false"})
    members = candidates.select("group").distinct().join(assigned.select("node", "group"), "group")
    wanted = settle(candidates.select("node").union(members.select("node")).distinct().join(row_of, "node"), "wanted")
    if wanted.isEmpty():
        final = classes
    else:
        texts = settle(_texts_of(docs, wanted), "texts")
        far = settle(_linked(_in_streams(members.join(texts, "node"), candidates.join(texts, "node"), "group"), width, percent), "links")
        final = components(near.union(far))
        release(texts, far, classes)
    release(shared, rare, candidates, wanted)
    by_node = settle(nodes.select("node", "copies", "first").join(final, "node", "left").withColumn("root", F.coalesce("root", "node")), "classes")
    release(assigned, near, nodes, final)
    return told.select("doc_id", "row", "node", "n"), by_node


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def similarity_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document the size of its shingle set and the smallest id reachable by links.

    1. Documents with one and the same set become one node. 2. Each node is
    compared with one node for each of its minimum hashes, the one whose shingles
    are the most common, so as a rule the text that the others were made from
    (linear in the nodes); what links is joined into classes. 3. Classes are cut into groups, and
    the token-group matrix holds each group's union of rare (indexed) shingles.
    Queries meet, by their own rare shingles, only groups of other classes; of
    these, the ones whose whole union can reach the threshold are opened and
    their members compared. 4. All links give the components. Steps 2 and 3 leave
    out only pairs that are in one class already or that cannot link, so the
    result is exact up to equal 64-bit hashes of different shingles, sets or rows.

    Texts travel once to the rows' names and once to each leader or group they
    are compared with; followers of one leader, queries of one group and copies
    of one text are dealt over tasks where they are many.

    Null, empty and blank texts have no shingles and are their own component. A
    null key takes part (its row's component is the least key that is not null,
    or null). Repeated rows are returned once each. An empty table gives no rows;
    further columns are ignored.
    """
    told, by_node = _classes(_rows(docs, text, key), width, percent)
    smallest = by_node.groupBy("root").agg(F.min("first.doc_id").alias("component"))
    component = settle(spread_join(by_node.select("node", "root"), smallest, "root").select("node", "component"), "components")
    release(by_node)
    return spread_join(told, component, "node", nulls=True).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per similarity class, with all columns, and every row without shingles, as these are linked with nothing.

    Of a class the row with the smallest key stays (a null key only where there is
    no other), of rows with one key and text one. Rows that share a key but not
    their class are told apart by their texts. An empty table gives no rows.
    """
    named, _ = numbered(docs)
    key_at, text_at = f"c{docs.columns.index(key)}", f"c{docs.columns.index(text)}"
    _, by_node = _classes(_rows(docs, text, key), width, percent)
    kept = by_node.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_row"))
    named = named.withColumn("_row", F.xxhash64(F.col(key_at).cast("long"), F.col(text_at).cast("string")))
    one = named.join(kept, "_row", "left_semi").withColumn("_n", F.row_number().over(W.partitionBy("_row").orderBy(F.xxhash64(*(c for c, t in named.dtypes if "map<" not in t))))).where("_n = 1")
    blank = named.where(F.coalesce(F.length(F.regexp_replace(text_at, r"[\x20\x09-\x0D]+", "")), F.lit(0)) == 0)
    return one.drop("_n", "_row").unionAll(blank.drop("_row")).toDF(*docs.columns)
