"""Exact top-k by inner product: ball-tree branch and bound over shards of the vectors."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import release, settle

#: Vectors of a shard, about: the most a task holds at once, and the fewest worth a shard of their own.
SHARD_MOST, SHARD_LEAST = 65_536, 2_048
LEAF = 128
#: Queries that travel together.
BLOCK = 256
#: Each wave of shards is so many times what was searched before it.
WAVE = 8


def upper_bounds(queries: np.ndarray, centre: np.ndarray, radius: np.ndarray, nearest: np.ndarray, farthest: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """For each query (row) and node no less than the inner product with any member: by the ball, and by norms and angles."""
    norm = np.sqrt((queries**2).sum(axis=1))[:, None]
    size = np.sqrt((centre**2).sum(axis=1))
    along = queries @ centre.T
    ball = along + norm * radius
    ball += 1e-9 * (np.abs(ball) + norm * size) + 1e-6
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.clip(along / (norm * size), -1.0, 1.0)
    between = np.cos(np.maximum(np.arccos(np.where(np.isfinite(cosine), cosine, 1.0)) - spread - 1e-7, 0.0))
    cone = norm * np.where(between >= 0, farthest, nearest) * between
    cone += 1e-9 * norm * farthest + 1e-6
    # where there is no direction, angles tell nothing
    return np.where((size > 0) & (norm > 0), np.minimum(ball, cone), ball)


class BallTree:
    """A binary tree of balls over integer vectors; children are closer to one of two far-apart members.

    ``low[n]:high[n]`` are the node's rows of ``ids`` and ``vectors``, ``left[n]`` is
    its first child (0: a leaf; the other child follows the first one's subtree,
    at ``right[n]``), and ``least[n]`` is its smallest id. Beside its ball a node knows
    its members' least and greatest norm and their greatest angle from its centre.
    """

    ARRAYS = (
        ("ids", np.int64), ("vectors", np.int32), ("low", np.int64), ("high", np.int64), ("left", np.int64), ("right", np.int64), ("least", np.int64),
        ("radius", np.float64), ("nearest", np.float64), ("farthest", np.float64), ("spread", np.float64), ("centre", np.float64),
    )

    def __init__(self, **arrays: np.ndarray) -> None:
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> BallTree:
        order = np.arange(len(ids))
        nodes: list[list] = []

        def node(low: int, high: int) -> int:
            own = vectors[order[low:high]].astype(np.float64)
            centre = own.mean(axis=0)
            radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            norms, size = np.sqrt((own**2).sum(axis=1)), float(np.sqrt((centre**2).sum()))
            if size > 0 and norms.min() > 0:
                spread = float(np.arccos(np.clip(own @ centre / (norms * size), -1.0, 1.0)).max())
            else:
                spread = float(np.pi)
            nodes.append([low, high, 0, 0, int(ids[order[low:high]].min()), radius, float(norms.min()), float(norms.max()), spread, centre])
            return len(nodes) - 1

        todo = [node(0, len(ids))]
        while todo:
            at = todo.pop()
            low, high, radius = nodes[at][0], nodes[at][1], nodes[at][5]
            if high - low <= leaf or radius == 0:
                continue
            own = vectors[order[low:high]].astype(np.float64)
            one = own[((own - nodes[at][9]) ** 2).sum(axis=1).argmax()]
            two = own[((own - one) ** 2).sum(axis=1).argmax()]
            side = own @ (one - two)
            middle = (high - low) // 2
            part = np.argpartition(side, middle)
            order[low:high] = order[low:high][part]
            nodes[at][2], nodes[at][3] = node(low, low + middle), node(low + middle, high)
            todo += nodes[at][2:4]
        columns = list(zip(*nodes))
        made = {name: np.array(columns[k], kind) for k, (name, kind) in enumerate(cls.ARRAYS[2:11])}
        return cls(ids=ids[order], vectors=np.ascontiguousarray(vectors[order]), centre=np.array(columns[9], np.float64).reshape(len(nodes), -1), **made)

    def pack(self) -> list[bytes]:
        """The arrays as bytes; vectors of components beyond 31 bits take eight bytes each."""
        out = [getattr(self, name).astype(kind).tobytes() for name, kind in self.ARRAYS]
        if np.abs(self.vectors).max(initial=0) >= 1 << 31:
            out[1] = self.vectors.astype(np.int64).tobytes()
        return out

    @classmethod
    def unpack(cls, parts: list[bytes]) -> BallTree:
        arrays = {name: np.frombuffer(raw, kind) for (name, kind), raw in zip(cls.ARRAYS, parts) if name != "vectors"}
        n = len(arrays["ids"])
        dim = len(arrays["centre"]) // len(arrays["low"])
        flat = np.frombuffer(parts[1], np.int32 if len(parts[1]) == 4 * n * dim else np.int64)
        tree = cls(vectors=flat.reshape(n, dim).astype(np.int64), **(arrays | {"centre": arrays["centre"].reshape(-1, dim)}))
        tree.real = tree.vectors.astype(np.float64)
        tree.greatest = int(np.abs(tree.vectors).max(initial=0))
        return tree

    def search_block(self, names: list[int], queries: np.ndarray, k: int, known: list[list[tuple[int, int, int]]]) -> list[tuple[list[tuple[int, int, int]], int]]:
        """``search`` for a block of queries, each from what is known; products are floats where these are exact."""
        real = queries.astype(np.float64)
        bounds = upper_bounds(real, self.centre, self.radius, self.nearest, self.farthest, self.spread)
        exact = self.greatest * int(np.abs(queries).max(initial=0)) * max(queries.shape[1], 1) < 1 << 53
        vectors, asked = (self.real, real) if exact else (self.vectors, queries)
        return [self.search(name, asked[q], vectors, bounds[q], k, sorted(known[q])) for q, name in enumerate(names)]

    def search(self, query_id: int, query: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, k: int, best: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], int]:
        """The k best (-score, id, 1) of this tree and ``best`` (ascending, ending in 0), and how many vectors were compared.

        ``bounds`` are the nodes' upper bounds; nodes are visited by falling bound. The
        search ends at the first bound below the current kth score; a node that can
        only tie is left out if all its ids are greater than the kth one. Repeated
        ids with one score are as many results.
        """
        heap = [(-bounds[0], 0)]
        compared = 0
        while heap:
            bound, at = heapq.heappop(heap)
            if len(best) == k:
                worst, worst_id = best[-1][:2]
                if bound > worst:
                    break
                if np.floor(-bound) == -worst and self.least[at] > worst_id:
                    continue
            if self.left[at]:
                for child in (int(self.left[at]), int(self.right[at])):
                    heapq.heappush(heap, (-bounds[child], child))
                continue
            low, high = self.low[at], self.high[at]
            compared += int(high - low)
            scores = (vectors[low:high] @ query).astype(np.int64)
            names = self.ids[low:high]
            good = names != query_id
            if len(best) == k:
                good &= scores >= -best[-1][0]
            scores, names = scores[good], names[good]
            if len(scores) > k:
                first = np.lexsort((names, -scores))[:k]
                scores, names = scores[first], names[first]
            if len(scores):
                best = sorted([*best, *((s, n, 1) for s, n in zip((-scores).tolist(), names.tolist()))])[:k]
        return best, compared


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, v``: each component as floor(scale * x); vectors that are null or hold null, NaN or infinity go, as do null ids."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    good = vectors.where(F.col(key).isNotNull() & v.isNotNull() & finite)
    return good.select(F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


#: Vectors at most, about, from which the planes are found that deal vectors to shards by place.
SAMPLE = 16_384
#: Shards whose bounds go to every task at once; more are taken in turns.
ROOTS = 1 << 16


class Planes:
    """Cells of space cut by planes, each halfway through the members of a cell along the line of two far-apart ones."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.nodes: list[tuple[np.ndarray, float, int, int]] = []
        self.cells = 0
        fewest = max(1, -(-len(sample) // max(cells, 1)))
        self.root = self._cut(sample.astype(np.float64), fewest)

    def _cut(self, own: np.ndarray, fewest: int) -> int:
        """A node's number, or for a cell its own as -1 - cell."""
        if len(own) > fewest:
            one = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            two = own[((own - one) ** 2).sum(axis=1).argmax()]
            side = own @ (one - two)
            middle = float(np.median(side))
            low = side < middle
            if low.any():
                at = len(self.nodes)
                self.nodes.append((one - two, middle, 0, 0))
                self.nodes[at] = (one - two, middle, self._cut(own[low], fewest), self._cut(own[~low], fewest))
                return at
        self.cells += 1
        return -self.cells

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int32)
        todo = [(self.root, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                line, middle, low, high = self.nodes[node]
                left = vectors[rows].astype(np.float64) @ line < middle
                todo += [(low, rows[left]), (high, rows[~left])]
        return out


def _by_place(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """The rows with their ``shard``: cells of space by planes through a bounded sample, and of cells that hold more than their
    share, so of vectors that repeat, as many parts as they are worth."""
    spark = rows.sparkSession
    sample = rows.select("dim", "v").sample(min(1.0, SAMPLE / max(total, 1)), seed=7).limit(2 * SAMPLE).toArrow()
    dims = sample.column("dim").to_numpy()
    planes: dict[int, Planes] = {}
    for dim in np.unique(dims).tolist():
        own = sample.filter(pa.array(dims == dim)).column("v").combine_chunks()
        planes[dim] = Planes(own.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), -(-shards * int((dims == dim).sum()) // max(len(dims), 1)))
    shared = spark.sparkContext.broadcast(planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            cells = np.zeros(len(sizes), np.int32)
            for dim in np.unique(sizes).tolist():
                if dim in shared.value and dim:
                    own = sizes == dim
                    part = batch.column(1).filter(pa.array(own))
                    cells[own] = shared.value[dim].cell(part.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=["vec_id", "v", "dim", "cell"])

    placed = rows.select("vec_id", "v", "dim").mapInArrow(run, "vec_id long, v array<long>, dim int, cell int")
    share = max(1, total // shards)
    # a row per cell of each length: about as many as there are shards
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("many")).withColumn("parts", F.greatest(F.lit(1), F.round(F.col("many") / share).cast("int")))
    w = Window.partitionBy("dim").orderBy("cell")
    numbered = settle(sizes.select("dim", "cell", "parts", (F.sum("parts").over(w) - F.col("parts")).cast("int").alias("first")), "cells")
    few = F.broadcast(numbered) if numbered.count() <= ROOTS else numbered
    part = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts")).cast("int")
    return placed.join(few, ["dim", "cell"]).select("vec_id", "v", "dim", (F.col("first") + part).alias("shard"))


def _build(rows: pa.Table) -> pa.Table:
    """One shard's tree as a row of packed arrays, and what bounds it as a whole."""
    ids = rows.column("vec_id").to_numpy()
    flat = rows.column("v").combine_chunks()
    dim = rows.column("dim")[0].as_py()
    matrix = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
    tree = BallTree.build(ids, matrix)
    parts = tree.pack()
    root = [*tree.centre[0].tolist(), float(tree.radius[0]), float(tree.nearest[0]), float(tree.farthest[0]), float(tree.spread[0])]
    columns = [pa.array([dim], pa.int32()), rows.column("shard").slice(0, 1), pa.array([root], pa.list_(pa.float64())), *(pa.array([p], pa.binary()) for p in parts)]
    return pa.table(columns, names=["dim", "shard", "root", *(f"t{k}" for k in range(len(parts)))])


def _wave(asked: DataFrame, trees: DataFrame, chunk: tuple[int, int], done: int, now: int, k: int) -> DataFrame:
    """``query_id, shard``: of the shards of a chunk, ordered for each query by falling bound, those at places done to done + now
    that may hold a better score than its kth."""
    spark = asked.sparkSession
    roots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    rows = trees.where(F.col("shard").between(*chunk)).select("dim", "shard", "root").collect()
    for dim in {r.dim for r in rows}:
        own = sorted((r for r in rows if r.dim == dim), key=lambda r: r.shard)
        roots[dim] = (np.array([r.shard for r in own], np.int32), np.array([r.root for r in own]).reshape(len(own), -1))
    shared = spark.sparkContext.broadcast(roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                names, dims, kth = own.column(0).to_numpy(), own.column(1).to_numpy(), own.column(3).to_numpy(zero_copy_only=False).astype(float)
                for dim in np.unique(dims).tolist():
                    here = dims == dim
                    shards, root = shared.value[dim] if dim in shared.value else (np.zeros(0, np.int32), np.zeros((0, dim + 4)))
                    real = own.column(2).filter(pa.array(here)).flatten().to_numpy(zero_copy_only=False).reshape(int(here.sum()), dim).astype(np.float64)
                    bounds = upper_bounds(real, root[:, :dim], *(root[:, dim + c] for c in range(4)))
                    order = np.argsort(-bounds, axis=1, kind="stable")[:, done : done + now]
                    # a query with fewer than k results has no kth score yet
                    good = ~(np.take_along_axis(bounds, order, axis=1) < kth[here][:, None])
                    q, c = np.nonzero(good)
                    yield pa.RecordBatch.from_arrays([pa.array(names[here][q]), pa.array(shards[order[q, c]])], names=["query_id", "shard"])

    kth = F.when(F.size("best") >= k, F.get("best", F.lit(k - 1))["score"].cast("double"))
    return asked.select("query_id", "dim", "v", kth.alias("kth")).mapInArrow(run, "query_id long, shard int")


_BEST = "array<struct<score:long,vec_id:long>>"
_PARTS = len(BallTree.ARRAYS)


def _search(asked: DataFrame, trees: DataFrame, shards: DataFrame, k: int, parts: int) -> DataFrame:
    """Searches every query ``(query_id, dim, v, best)`` in its ``shards (query_id, shard)``: per shard ``query_id, compared, best``.

    A shard's tree and its queries meet in a task that reads the tree once and then
    streams the queries in blocks; with ``parts`` a shard's queries are cut over so
    many tasks. ``compared`` counts the vectors whose product was computed, ``best``
    holds only what this shard adds.
    """
    nothing = [F.lit(None).cast("binary").alias(f"t{p}") for p in range(_PARTS)]
    told = trees.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(False).alias("asks"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<long>").alias("v"), F.lit(None).cast(_BEST).alias("best"), *(f"t{p}" for p in range(_PARTS)))
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")
    queries = asked.join(shards, "query_id").select("dim", "shard", part, F.lit(True).alias("asks"), "query_id", "v", "best", *nothing)
    together = told.unionByName(queries).repartition("dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, None
        for batch in batches:
            asks = batch.column(3).to_pylist()
            place = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            start = 0
            while start < batch.num_rows:
                if not asks[start]:
                    tree, at = BallTree.unpack([batch.column(7 + p)[start].as_py() for p in range(_PARTS)]), place[start]
                    start += 1
                    continue
                stop = start + 1
                while stop < batch.num_rows and stop - start < BLOCK and asks[stop] and place[stop] == place[start]:
                    stop += 1
                own = batch.slice(start, stop - start)
                names = own.column(4).to_pylist()
                if place[start] == at:
                    known = [[(-b["score"], b["vec_id"], 0) for b in best or []] for best in own.column(6).to_pylist()]
                    flat = own.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    found = tree.search_block(names, flat.reshape(len(names), -1), k, known)
                else:
                    found = [([], 0)] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()),
                        pa.array([compared for _, compared in found], pa.int64()),
                        pa.array([[{"score": -b[0], "vec_id": b[1]} for b in best if b[2]] for best, _ in found], pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))),
                    ],
                    names=["query_id", "compared", "best"],
                )
                start = stop

    return together.mapInArrow(run, f"query_id long, compared long, best {_BEST}")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", scale: int = 256, shard_most: int = SHARD_MOST, shard_least: int = SHARD_LEAST) -> DataFrame:
    """The k greatest inner products of each query with all other vectors: ``query_id, rank, vec_id, score, compared``.

    Queries are the rows whose id is divisible by ``every``. Vectors are dealt to
    shards of at most about ``shard_most`` by place: cells of space between planes that
    are found from at most about ``SAMPLE`` vectors; every vector is indexed, and a cell
    that holds more than its share (vectors that repeat, among others) is cut into
    several shards. Each shard is one ball tree. Queries go through the shards in waves,
    first the one of greatest bound, then ``WAVE`` times as many each, by falling bound;
    a shard is left out, before anything moves, if its bound is below the kth score
    that earlier waves have found, and inside a shard balls are left out likewise.
    In a wave a shard moves once (or to as many tasks as keep all cores busy where
    shards are few), a query once to each shard that it needs. ``compared`` tells with
    how many vectors the query's product was computed in all.

    Ties go to the smaller id. Vectors that are null or hold a null or non-finite
    component, and null ids, take no part; vectors of other lengths than the
    query's neither. Rows with the query's id are its own and no candidates; a
    repeated query id is asked once (with its greatest vector), a repeated
    candidate counts once per row. An empty table gives no rows; further columns
    are ignored. Scores are exact while they fit into 63 bits.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, key, vector, scale).select("vec_id", "v", F.size("v").alias("dim"))
    total = rows.count()
    cores = spark.sparkContext.defaultParallelism
    shards = max(-(-total // shard_most), min(2 * cores, -(-total // shard_least)), 1)
    tree_schema = "dim int, shard int, root array<double>, " + ", ".join(f"t{p} binary" for p in range(_PARTS))
    trees = settle(_by_place(rows, total, shards).groupBy("dim", "shard").applyInArrow(_build, tree_schema), "trees")
    # shards of each length are numbered from 0
    shards = (trees.agg(F.max("shard")).first()[0] or 0) + 1

    asked = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"), "dim").agg(F.max("v").alias("v"))
    # of a repeated query id only the greatest vector is asked
    asked = asked.groupBy("query_id").agg(F.max(F.struct("v", "dim")).alias("g")).select("query_id", "g.dim", "g.v")
    asked = settle(asked.withColumn("best", F.lit(None).cast(_BEST)).withColumn("compared", F.lit(0).cast("long")), "queries")
    steps, first = [], 0
    while first < shards:
        done, size = 0, min(ROOTS, shards - first)
        while done < size:
            now = min(max(done * (WAVE - 1), 1), size - done)
            steps.append(((first, first + size - 1), done, now))
            done += now
        first += size
    for chunk, done, now in steps:
        parts = max(1, min(-(-2 * cores // now), -(-total // (every * BLOCK))))
        wave = _wave(asked, trees, chunk, done, now, k)
        found = _search(asked, trees, wave, k, parts).groupBy("query_id").agg(F.sum("compared").alias("more"), F.flatten(F.collect_list("best")).alias("new"))
        every_one = F.concat(F.coalesce("best", F.array().cast(_BEST)), F.coalesce("new", F.array().cast(_BEST)))
        ranked = F.array_sort(F.transform(every_one, lambda b: F.struct((-b["score"]).alias("neg"), b["vec_id"].alias("vec_id"))))
        top = F.transform(F.slice(ranked, 1, k), lambda b: F.struct((-b["neg"]).alias("score"), b["vec_id"].alias("vec_id")))
        before = asked
        joined = asked.join(found, "query_id", "left")
        asked = settle(joined.select("query_id", "dim", "v", top.alias("best"), (F.col("compared") + F.coalesce("more", F.lit(0))).alias("compared")), "queries")
        release(before)
    release(trees)
    return asked.select("query_id", "compared", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score", "compared")
