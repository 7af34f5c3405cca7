"""Exact nearest neighbours by a block matrix join: products of int8 codes bound distances, what survives is measured in doubles."""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lean
from .embeddings import _by_length

#: Bytes of the vectors of a block of candidates, which one task holds while the queries pass.
BLOCK_BYTES = 64 << 20
#: Candidates and queries of a tile.
TILE, QUERIES = 4096, 256
#: Coordinates whose products of codes a float32 sums without rounding: 127 * 127 * 1040 < 2**24.
EXACT = 1040
#: Pairs measured at once.
PAIRS = 1 << 18


def vectors_of(vectors: DataFrame) -> tuple[DataFrame, type]:
    """(vec_id, key, dim, vector binary) of the rows that take part, and the type of its components: floats where the column has these, else doubles. Equal vectors have equal keys."""
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64

    def run(batches):
        for batch in batches:
            keys, dims, data = ([None] * len(batch) for _ in range(3))
            for at, x, good in _by_length(batch.column(1)):
                for i, v in zip(at[good].tolist(), x[good].astype(kind), strict=True):
                    data[i], dims[i] = v.tobytes(), len(v)
                    keys[i] = hashlib.blake2b(data[i], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "key", "dim", "vector"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    return rows.mapInArrow(lean(run), "vec_id bigint, key binary, dim int, vector binary").where("key is not null"), kind


class Codes:
    """Vectors as int8 codes with a scale each: c * scale is within ``off`` of the vector, and ``near`` long."""

    def __init__(self, x: np.ndarray):
        scale = np.abs(x).max(1) / 127
        self.scale = np.where(scale > 0, scale, 1.0)
        self.codes = np.rint(x / self.scale[:, None]).clip(-127, 127).astype(np.int8)
        back = self.codes * self.scale[:, None]
        self.off, self.near = np.sqrt(((x - back) ** 2).sum(1)), np.sqrt((back**2).sum(1))
        self.norm2 = (x * x).sum(1)
        self.norm = np.sqrt(self.norm2)


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of codes, whole numbers without rounding: the matrix library has no int8 product, and a float32 holds what EXACT coordinates sum to."""
    out = None
    for i in range(0, a.shape[1], EXACT):
        part = a[:, i : i + EXACT].astype(np.float32) @ b[:, i : i + EXACT].astype(np.float32).T
        out = part if a.shape[1] <= EXACT else part.astype(np.float64) + (0 if out is None else out)
    return out


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in doubles, coordinate after coordinate."""
    total = np.zeros(len(q))
    for k in range(q.shape[1]):
        gap = q[:, k] - x[:, k]
        total += gap * gap
    return np.sqrt(total)


class Block:
    """Candidates of one length; ``search`` gives each query its k nearest among them, by heaps over tiles."""

    def __init__(self, x: np.ndarray, ids: list[list[int]], k: int):
        self.x, self.ids, self.k = x, ids, k
        self.tiles = [(i, Codes(x[i : i + TILE].astype(np.float64))) for i in range(0, len(x), TILE)]

    def search(self, q: np.ndarray, own: np.ndarray) -> list[list[tuple[float, int]]]:
        """(distance, vec_id) lists, nearest first; own are the queries' vec_ids, which are no candidates of theirs."""
        heaps: list[list] = [[] for _ in q]
        worst = np.full(len(q), np.inf)
        mine = Codes(q)
        # squares may overflow; such bounds leave nothing out
        for first, tile in self.tiles:
            dot = code_products(mine.codes, tile.codes) * mine.scale[:, None] * tile.scale
            # |q.x - dot| <= |q'| |x - x'| + |q - q'| |x|
            error = mine.near[:, None] * tile.off + mine.off[:, None] * tile.norm
            square = mine.norm2[:, None] + tile.norm2 - 2 * dot
            slack = 2 * error + 1e-9 * (mine.norm2[:, None] + tile.norm2) + 1e-300
            limit = worst * worst * (1 + 1e-9)
            if np.isinf(limit).any() and len(tile.norm) > self.k:
                # one more than k, since the query itself may be among them
                limit = np.minimum(limit, np.partition(square + slack, self.k, axis=1)[:, self.k])
            i, j = np.nonzero(~(square - slack > limit[:, None]))
            for a in range(0, len(i), PAIRS):
                self._measure(q, own, heaps, worst, i[a : a + PAIRS], first + j[a : a + PAIRS])
        return [sorted((-d, -v) for d, v in heap) for heap in heaps]

    def _measure(self, q, own, heaps, worst, i, j) -> None:
        d = distances(q[i], self.x[j].astype(np.float64))
        keep = d <= worst[i]
        for row, at, x in zip(i[keep].tolist(), j[keep].tolist(), d[keep].tolist(), strict=True):
            heap = heaps[row]
            for vec in self.ids[at]:
                if vec == own[row]:
                    continue
                item = (-x, -vec)
                if len(heap) < self.k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
                else:
                    break  # the ids of equal vectors ascend
            if len(heap) == self.k:
                worst[row] = -heap[0][0]


def distinct_vectors(units: DataFrame, k: int) -> DataFrame:
    """(key, dim, vector, ids): each distinct vector with its k + 1 smallest vec_ids, k rows of each at most, which is all that a search for k can return of it. Rows are counted, and of a hot vector k + 1 ids stay, before they meet."""
    rows = units.groupBy("key", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("m"))
    first = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    few = rows.withColumn("n", first).where(F.col("n") <= k + 1)
    ids = few.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("vec_id", "m"))).alias("ids"))
    ids = ids.select("key", F.flatten(F.transform("ids", lambda x: F.array_repeat(x.vec_id, x.m))).alias("ids"))
    return units.groupBy("key").agg(F.first("dim").alias("dim"), F.first("vector").alias("vector")).join(ids, "key")


def found_in_blocks(candidates: DataFrame, queries: DataFrame, blocks: int, k: int, kind) -> DataFrame:
    """(query_id, query_key, vec_id, score): the k nearest of each query in each block of candidates (key, dim, vector, ids).

    The queries (vec_id, key, dim, vector) go to each block. A task meets a block's candidates
    first and then the queries, batch by batch: it holds one block and no more.
    """

    def run(batches):
        with np.errstate(over="ignore", invalid="ignore"):
            yield from search(batches)

    def search(batches):
        at_block, rows, held = None, {}, {}
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "is_query", "dim")])
            edges = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0), True])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                block, is_query, dim = key[:, a].tolist()
                part = batch.slice(a, b - a)
                x = np.frombuffer(b"".join(part.column("vector").to_pylist()), kind).reshape(-1, dim)
                ids = part.column("ids").to_pylist()
                if block != at_block:
                    at_block, rows, held = block, {}, {}
                if not is_query:
                    rows.setdefault(dim, []).append((x, ids))
                    continue
                if dim in rows:
                    held[dim] = Block(np.concatenate([v for v, _ in rows[dim]]), [i for _, own in rows.pop(dim) for i in own], k)
                if dim in held:
                    own, keys = [i[0] for i in ids], part.column("key").to_pylist()
                    for i in range(0, len(x), QUERIES):
                        near = held[dim].search(x[i : i + QUERIES].astype(np.float64), own[i : i + QUERIES])
                        hits = [(q, m, v, d) for q, m, some in zip(own[i:], keys[i:], near) for d, v in some]  # noqa: B905
                        if hits:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.float64()), strict=True)], ["query_id", "query_key", "vec_id", "score"])

    wanted = ["block", "is_query", "dim", "key", "vector", "ids"]
    left = candidates.withColumns({"block": F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"), "is_query": F.lit(False)}).select(wanted)
    right = queries.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "is_query": F.lit(True), "ids": F.array("vec_id")}).select(wanted)
    dealt = left.unionByName(right).repartition(blocks, "block").sortWithinPartitions("block", "is_query", "dim")
    return dealt.mapInArrow(lean(run), "query_id bigint, query_key binary, vec_id bigint, score double")


def nearest(vectors: DataFrame, k: int = 10, is_query: Column | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query among all vectors (vec_id, embedding) of its length but its own, by Euclidean distance in doubles, ties to the smaller vec_id.

    is_query tells by vec_id which rows are queries; all are if it is None. Vectors that are
    null, empty, zero or hold null or non-finite components take no part, nor do rows without a
    vec_id. Rows that repeat a vec_id are candidates of their own; they are none for a query of
    that vec_id, and equal ones are one query. An empty table gives none; other columns, whatever
    their names, are left out. Nothing is approximate: a tile leaves out only what its bounds
    show to be farther than k others.
    """
    spark = vectors.sparkSession
    with Scratch(spark) as s:
        units, kind = vectors_of(vectors)
        units = s.table(units)
        asked = units if is_query is None else units.where(is_query)
        queries = s.table(asked.dropDuplicates(["vec_id", "key"]))
        distinct = s.table(distinct_vectors(units, k))
        n_bytes = distinct.agg(F.coalesce(F.sum(F.octet_length("vector")), F.lit(0))).head()[0]
        blocks = max(spark.sparkContext.defaultParallelism, math.ceil(n_bytes / BLOCK_BYTES))
        found = found_in_blocks(distinct, queries, blocks, k, kind)
        place = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id"))
        ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
        return s.keep(ranked.select("query_id", "rank", "vec_id", "score"))


def op11_neighbours(spark, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vec_id among all embeddings."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 10, F.col("vec_id") % 100 == 0)
