"""Near duplicates among vectors by a pigeonhole join of rotated subspaces."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, lean

#: Vectors of a cell that one task takes as rows, and as columns.
TILE = 8192


#: Vectors that the rotation is fitted to.
SAMPLE = 10_000


def bounds(dim: int, blocks: int) -> list[tuple[int, int]]:
    """First and end coordinate of each block."""
    cut = [round(dim * i / blocks) for i in range(blocks + 1)]
    return [(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]


def _by_length(col: pa.ListArray):
    """Of an Arrow column of lists: for each length the rows of it, their values as a matrix of doubles, and which of them are vectors: not zero, without null or non-finite components."""
    n = col.value_lengths().fill_null(0).to_numpy()
    flat = col.flatten()
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    first = np.cumsum(n) - n
    for dim in np.unique(n[n > 0]).tolist():
        rows = np.flatnonzero(n == dim)
        at = first[rows][:, None] + np.arange(dim)
        yield rows, values[at], ~bad[at].any(1) & np.isfinite(values[at]).all(1) & (values[at] != 0).any(1)


def scaled_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, dim, vector binary): doubles, divided by the power of two that brings the largest component to 0.5..1, which is exact. The others are null for rows without a vec_id and for null, empty or zero vectors and those with null or non-finite components. Equal vectors have equal keys."""

    def run(batches):
        for batch in batches:
            keys, dims, data = ([None] * len(batch) for _ in range(3))
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for rows, x, good in _by_length(batch.column(1)):
                rows, x = rows[good & known[rows]], x[good & known[rows]]
                y = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=1e-300))[1][:, None])
                for i, own, to in zip(rows.tolist(), x, y, strict=True):
                    keys[i], dims[i], data[i] = hashlib.blake2b(own.tobytes(), digest_size=16).digest(), x.shape[1], to.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "key", "dim", "vector"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(lean(run), "vec_id bigint, key binary, dim int, vector binary")


def _matrix(col, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(-1, dim)


def _rotated(x: np.ndarray, bases: dict[int, np.ndarray]) -> np.ndarray:
    """Unit vectors of the rows, rotated where their length has a rotation."""
    u = x / np.sqrt((x * x).sum(1))[:, None]
    return u @ bases[x.shape[1]] if x.shape[1] in bases else u


def rotations(heads: DataFrame, blocks: int) -> dict[int, np.ndarray]:
    """Of each length of vectors in a sample, the rotation to its principal axes, dealt to the blocks in turn, so that each begins with the widest.

    The sample is that of the SAMPLE smallest keys, which are digests. The rotation changes how
    many candidates there are, never which pairs are found.
    """
    sample = heads.orderBy("key").limit(SAMPLE).select("dim", "vector").toArrow()
    dims, out = sample.column(0).to_numpy(), {}
    for dim in np.unique(dims).tolist():
        x = _matrix(sample.column(1).filter(pa.array(dims == dim)), dim)
        u = _rotated(x, {})
        _, axes = np.linalg.eigh(u.T @ u)
        axes, parts = axes[:, ::-1], bounds(dim, blocks)
        order = sorted(range(dim), key=lambda i: (i % len(parts), i))
        # as many axes to each block as it has coordinates
        out[dim] = axes[:, order]
    return out


def cells(heads: DataFrame, least: float, blocks: int, bases: dict[int, np.ndarray]) -> DataFrame:
    """(dim, block, x, y, home, d, m, vector): each vector in the grid cell of each block, and as a guest in those neighbours that come later.

    Two vectors whose block distance is within the block's share of the budget differ by at most
    one cell's side in each coordinate.
    """

    def run(batches):
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                r = _rotated(_matrix(batch.column(3).take(pa.array(at)), dim), bases)
                for b, (first, end) in enumerate(bounds(dim, blocks)):
                    side = np.sqrt((2 - 2 * least) * (end - first) / dim + 1e-9)
                    x = np.floor(r[:, first] / side).astype(np.int32)
                    y = np.floor(r[:, first + 1] / side).astype(np.int32) if end > first + 1 else np.zeros(len(at), np.int32)
                    for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)):
                        n = len(at)
                        rows = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(x + np.int32(dx)), pa.array(y + np.int32(dy)), pa.array(np.full(n, dx == dy == 0)), *(rows.column(k) for k in (1, 2, 3))], ["dim", "block", "x", "y", "home", "d", "m", "vector"])

    return heads.select("dim", "d", "m", "vector").mapInArrow(lean(run), "dim int, block int, x int, y int, home boolean, d bigint, m bigint, vector binary")


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 by the links i-j."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def linked(tiles: DataFrame, least: float, blocks: int, bases: dict[int, np.ndarray]) -> DataFrame:
    """(d, links, root) of the vectors that link with others in a tile: how many, copies counted, and the smallest one that they reach there.

    A pair is a candidate if it is within a block's share of the budget; the first such block
    counts it, so a pair counts once. The cosine is then taken of the vectors themselves, in
    doubles: their product over that of their lengths.
    """

    def tile(table: pa.Table) -> pa.Table:
        dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
        same = table.column("s")[0].as_py() == table.column("t")[0].as_py()
        table = table.sort_by("d")
        d, m, row = (table.column(c).to_numpy() for c in ("d", "m", "is_row"))
        x = _matrix(table.column("vector"), dim)
        size, r = np.sqrt((x * x).sum(1)), _rotated(x, bases)
        parts = bounds(dim, blocks)
        budget = [(2 - 2 * least) * (b - a) / dim + 1e-9 for a, b in parts]
        a, b = parts[block]
        left = np.flatnonzero(row)
        right = left if same else np.flatnonzero(~row)
        low = r[:, a:b].astype(np.float32)
        norm = (low * low).sum(1)
        links, pi, pj = np.zeros(len(d), np.int64), [], []
        for i0 in range(0, len(left), 1024):
            for j0 in range(i0 // 1024 * 1024 if same else 0, len(right), 4096):
                li, rj = left[i0 : i0 + 1024], right[j0 : j0 + 4096]
                near = norm[li][:, None] + norm[rj][None, :] - 2 * (low[li] @ low[rj].T) <= np.float32(budget[block] + 1e-4)
                i, j = np.nonzero(near)
                i, j = li[i], rj[j]
                if same:
                    i, j = i[i < j], j[i < j]
                for k in range(0, len(i), 200_000):
                    u, w = i[k : k + 200_000], j[k : k + 200_000]
                    gap = (r[u] - r[w]) ** 2
                    own = gap[:, a:b].sum(1) <= budget[block]
                    for p in range(block):
                        own &= gap[:, parts[p][0] : parts[p][1]].sum(1) > budget[p]
                    own &= (x[u] * x[w]).sum(1) / (size[u] * size[w]) >= least
                    u, w = u[own], w[own]
                    np.add.at(links, u, m[w])
                    np.add.at(links, w, m[u])
                    if len(u):
                        keep = _roots(u, w, len(d))
                        moved = np.flatnonzero(keep != np.arange(len(d)))
                        pi.append(moved)
                        pj.append(keep[moved])
        root = _roots(np.concatenate(pi), np.concatenate(pj), len(d)) if pi else np.arange(len(d))
        hit = np.flatnonzero(links)
        return pa.table({"d": d[hit], "links": links[hit], "root": d[root[hit]]})

    return tiles.groupBy("dim", "block", "x", "y", "s", "t").applyInArrow(tile, "d bigint, links bigint, root bigint")


def near_duplicates(vectors: DataFrame, least: float = 0.9, blocks: int = 2) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors linked by cosine >= least.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    nor do vectors of different lengths, nor rows without a vec_id, which are their own component
    and are kept. Rows that repeat a vec_id are vectors of their own: if near, they link like
    others. Equal vectors link and are searched once, with their number. An empty table gives
    none; other columns are left out. Cells of the grid are dealt into tiles of TILE by TILE
    vectors, so that no task grows with a dense region; links are counted where they are found,
    and only as many edges leave a tile as join its vectors.
    """
    with Scratch(vectors.sparkSession) as s:
        units = s.table(scaled_vectors(vectors))
        good = units.where("key is not null")
        heads = good.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
        heads = s.table(heads.withColumn("d", F.monotonically_increasing_id()))
        bases = rotations(heads, blocks)
        cell = ["dim", "block", "x", "y"]
        rows = s.table(cells(heads, least, blocks, bases))
        size = rows.groupBy(cell).agg(F.ceil(F.count_if("home") / TILE).cast("int").alias("n_home"), F.ceil(F.count_if(~F.col("home")) / TILE).cast("int").alias("n_guest")).where("n_home > 0")
        dealt = rows.join(size, cell).withColumn("k", F.pmod(F.xxhash64("d"), F.when(F.col("home"), F.col("n_home")).otherwise(F.greatest("n_guest", F.lit(1)))).cast("int"))
        as_row = F.expr("transform(sequence(k, n_home + n_guest - 1), i -> struct(k as s, i as t, true as is_row))")
        as_column = F.expr("transform(filter(sequence(0, k), i -> i < k), i -> struct(i as s, k as t, false as is_row))")
        as_guest = F.expr("transform(sequence(0, n_home - 1), i -> struct(i as s, n_home + k as t, false as is_row))")
        tiles = dealt.withColumn("to", F.explode(F.when(F.col("home"), F.concat(as_row, as_column)).otherwise(as_guest))).select(*cell, "to.s", "to.t", "to.is_row", "d", "m", "vector")
        found = s.table(linked(tiles, least, blocks, bases))
        links = found.groupBy("d").agg(F.sum("links").alias("links"))
        comp = s.table(components(found.select(F.col("d").alias("a"), F.col("root").alias("b")), s))
        named = comp.withColumnRenamed("node", "d").join(heads.select("d", "id"), "d")
        named = named.select("d", "component").join(named.groupBy("component").agg(F.min("id").alias("component_id")), "component")
        own = heads.select("key", "d", "m", "id").join(links, "d", "left").join(named, "d", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
        out = units.select("vec_id", "key").join(own, "key", "left")
        return s.keep(out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
