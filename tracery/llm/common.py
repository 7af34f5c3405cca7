"""What the operators of this subpackage share: scratch tables, word hashing and components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import root_of

U64 = np.uint64
#: `[^\x20\x09-\x0D]+` is a word: every other byte belongs to one.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, the rest unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_MUL = [U64(int(x) | 1) for x in _RNG.integers(2**62, 2**63, 8, dtype=np.int64)]
#: Bytes of text that are hashed at once.
CHUNK = 1 << 19
#: Bytes of a batch that goes to Python; its buffers on both sides are a few times this.
BATCH_BYTES = 1 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


class Scratch:
    """Tables under spark.checkpoint.dir: they cut lineage and outlive a lost executor.

    ``table`` writes a frame there and reads it again; ``keep`` does so for the result. Leaving
    the block drops all but what was kept. Within it, batches for Python hold BATCH_BYTES, not
    10,000 rows whatever their length.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = root_of(spark)
        self.root = f"{root}/tracery-{uuid.uuid4().hex}"
        self.n, self.shared = 0, []

    def __enter__(self) -> Scratch:
        self.batch_bytes = self.spark.conf.get(_BATCH_CONF, None)
        self.spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
        return self

    def _write(self, df: DataFrame, place: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{place}{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame) -> DataFrame:
        return self._write(df, "work/t")

    def keep(self, df: DataFrame) -> DataFrame:
        return self._write(df, "kept/t")

    def share(self, value):
        """A broadcast that goes with the tables: what is kept doesn't need it."""
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def __exit__(self, *_) -> None:
        if self.batch_bytes is None:
            self.spark.conf.unset(_BATCH_CONF)
        else:
            self.spark.conf.set(_BATCH_CONF, self.batch_bytes)
        for x in self.shared:
            x.destroy()
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/work")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def lean(run):
    """The same function of batches; once a partition is done, what it used goes back to the system, since Python workers outlive their tasks and share an executor's memory."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def text_only(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator needs under fixed names; others, whatever their names, stay out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and the offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_runs(offsets: np.ndarray, most: int = CHUNK):
    """Slices of rows with at most ``most`` bytes together, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def spans(raw: np.ndarray, space: np.ndarray, most: int = CHUNK):
    """Start and end of slices of one long text, of ``most`` bytes or to the end of a longer word; none parts a word."""
    at, n = 0, len(raw)
    while at < n:
        end = min(at + most, n)
        while end < n and not space[raw[end - 1]]:
            gap = np.flatnonzero(space[raw[end : end + most]])
            end = end + int(gap[0]) + 1 if len(gap) else min(end + most, n)
        yield at, end
        at = end


def _new_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(n, U64), np.ones(n, U64)
    up[1:], down[1:] = U64(_P), U64(_P_INV)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_kept_powers = functools.lru_cache(maxsize=1)(_new_powers)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, n or more of each; those for a slice of ordinary rows are kept, those for a longer text aren't."""
    return _kept_powers(CHUNK) if n <= CHUNK else _new_powers(n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of UTF-8 text: the start and end byte of each word, its 64-bit hash, and the first word of each row (with an end)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    if lower:
        raw = LOWER[raw]
    solid = ~space[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return a, b, piece_hashes(raw, a, b), np.searchsorted(a, offsets)


def piece_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each start to its end."""
    n = len(raw)
    up, down = _powers(n)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[raw] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k (a power of two) successive word hashes; runs that pass a row's end are to be left out by the caller."""
    span, level = 1, 0
    while span < k:
        h = h[:-span] + h[span:] * _MUL[level] if len(h) > span else h[:0]
        span, level = span * 2, level + 1
    return mix(h)


#: Slots of a bitmap: DOC_SLOTS for one of documents, 8 MB as bits, whatever the input; at most MOST_SLOTS, 128 MB, for one that follows it. A fuller one lets more pass, never less.
DOC_SLOTS, MOST_SLOTS = 1 << 26, 1 << 30
_BLOCK_BITS = 18


def slots_for(n: int) -> int:
    """Slots of a bitmap of n entries: eight for each, a power of two, within the bounds."""
    return min(MOST_SLOTS, max(1 << _BLOCK_BITS, 1 << int(8 * max(n, 1) - 1).bit_length()))


def bitmap(slots: DataFrame, size: int) -> np.ndarray:
    """Bits of the slots (column slot, 0..size-1): blocks of 2**18 are made on the executors, and only those that have any reach the driver."""

    def fill(table: pa.Table) -> pa.Table:
        slot = table.column("slot").to_numpy()
        bits = np.zeros(1 << _BLOCK_BITS, np.uint8)
        bits[slot & (1 << _BLOCK_BITS) - 1] = 1
        return pa.table({"block": pa.array([int(slot[0]) >> _BLOCK_BITS], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    rows = slots.select(F.col("slot").cast("long").alias("slot")).distinct().groupBy(F.shiftright("slot", _BLOCK_BITS).alias("block_of")).applyInArrow(fill, "block bigint, bits binary").toArrow()
    out = np.zeros(size // 64, U64)
    wide = (1 << _BLOCK_BITS) // 64
    for block, bits in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
        out[block * wide : (block + 1) * wide] = np.frombuffer(bits.as_buffer(), U64)
    return out


def in_bitmap(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 6] >> (slot & 63).astype(U64)) & U64(1) == 1


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the nodes of undirected edges (a, b); component is the smallest node reachable.

    Alternates two star contractions until none changes an edge; the number of rounds grows with
    the logarithm of the longest path. Hubs only meet in joins, which split hot keys, and in
    minima, which combine before the shuffle.
    """
    e = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # large star: each larger neighbour points to the smallest of the neighbourhood
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large)
        # small star: each node and its smaller neighbours point to the smallest of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = scratch.table(small)
        # done when each node has one edge and no root has one upwards
        roots = small.select(F.col("v").alias("u")).distinct()
        tangled = small.join(roots, "u", "left_semi").limit(1).count()
        many = 0 if tangled else small.groupBy("u").count().where("count > 1").limit(1).count()
        e = small
        if not tangled and not many:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
