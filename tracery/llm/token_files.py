"""Token ids in patched frame-of-reference blocks, written as tables and read back."""

from __future__ import annotations

import itertools
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column_bytes, doc_runs, lean, text_only
from .tokens import encoder, with_end

#: Ids a block holds.
BLOCK = 512
#: This share of a block's offsets must fit the packed width; the others are exceptions.
PERCENTILE = 95
MAGIC = b"PFR1"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of BLOCK * width / 64 words."""
    if width in (8, 16, 32):
        return np.ascontiguousarray(values.astype(f"<u{width // 8}")).view("<u8")
    v = values.reshape(len(values), BLOCK // 64, 64).astype(np.uint64)
    out = np.zeros((len(values), BLOCK // 64, width), np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        out[:, :, word] |= v[:, :, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= v[:, :, i] >> np.uint64(64 - shift)
    return out.reshape(len(values), -1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    n = len(packed)
    if width in (8, 16, 32):
        return np.ascontiguousarray(packed).view(f"<u{width // 8}").astype(np.uint32)
    out = np.zeros((n, BLOCK // 64, 64), np.uint64)
    p = packed.reshape(n, BLOCK // 64, width)
    mask = np.uint64((1 << width) - 1)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        x = p[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | p[:, :, word + 1] << np.uint64(64 - shift)
        out[:, :, i] = x & mask
    return out.reshape(n, BLOCK).astype(np.uint32)


def encode_ids(ids: np.ndarray) -> bytes:
    """Unsigned 32-bit ids as a file: header, block index (start of each block), blocks.

    A block holds its minimum, its width, its number of exceptions, the packed offsets, and the
    places and values of the exceptions, whose packed offset is 0.
    """
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return MAGIC + struct.pack("<QI", 0, 0)
    full = np.concatenate([ids.astype(np.uint32), np.full(blocks * BLOCK - n, ids[-1], np.uint32)]).reshape(blocks, BLOCK)
    low = full.min(1)
    off = full - low[:, None]
    at = np.partition(off, (BLOCK * PERCENTILE + 99) // 100 - 1, axis=1)[:, (BLOCK * PERCENTILE + 99) // 100 - 1]
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.int64)
    # where exceptions would take more room than the widest offset does, there are none
    widest = np.ceil(np.log2(off.max(1).astype(np.float64) + 1)).astype(np.int64)
    late = off >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    plain = (widest - width) * BLOCK <= late.sum(1) * 48
    width = np.where(plain, widest, width)
    late &= ~plain[:, None]
    late_n = late.sum(1)
    where = np.nonzero(late)[1].astype("<u2")
    value = off[late].astype("<u4")
    off[late] = 0
    body = {}
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        for k, x in zip(own.tolist(), _pack(off[own], w).view(np.uint8).reshape(len(own), -1), strict=True):
            body[k] = x.tobytes()
    ends = np.cumsum(late_n).tolist()
    parts = [
        struct.pack("<IBH", int(low[k]), int(width[k]), int(late_n[k])) + body[k] + where[e - c : e].tobytes() + value[e - c : e].tobytes()
        for k, (e, c) in enumerate(zip(ends, late_n.tolist(), strict=True))
    ]
    starts = np.cumsum([0, *map(len, parts[:-1])]).astype("<u8")
    return MAGIC + struct.pack("<QI", n, blocks) + starts.tobytes() + b"".join(parts)


def decode_ids(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids first..last-1 of such a file; only the blocks that hold them are unpacked."""
    if data[:4] != MAGIC:
        raise ValueError("not a patched frame-of-reference file")
    n, blocks = struct.unpack_from("<QI", data, 4)
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(data, "<u8", blocks, 16).astype(np.int64) + 16 + 8 * blocks
    b0, b1 = first // BLOCK, (last - 1) // BLOCK + 1
    heads = [struct.unpack_from("<IBH", data, s) for s in starts[b0:b1].tolist()]
    low, width, late = (np.array(x, np.int64) for x in zip(*heads, strict=True))
    out = np.zeros((b1 - b0, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        size = BLOCK * w // 8
        rows = np.frombuffer(b"".join(data[s + 7 : s + 7 + size] for s in starts[b0:b1][own].tolist()), "<u8").reshape(len(own), -1)
        out[own] = _unpack(rows, w)
    for k in np.flatnonzero(late).tolist():
        s = int(starts[b0 + k]) + 7 + BLOCK * int(width[k]) // 8
        c = int(late[k])
        out[k, np.frombuffer(data, "<u2", c, s)] = np.frombuffer(data, "<u4", c, s + 2 * c)
    return (out + low.astype(np.uint32)[:, None]).reshape(-1)[first - b0 * BLOCK : last - b0 * BLOCK]


FILE_SCHEMA = "part int, seq int, before bigint, doc_ids array<bigint>, n_tokens array<int>, n bigint, ids binary"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, ids_per_file: int = 1 << 20) -> None:
    """Write the ids of every whole text, in ascending doc_id order, to a table at path.

    One row is one file image: successive documents whose ids together reach ids_per_file, each
    closed by end_id. Rows of a partition follow one another by seq, partitions by part. Null and
    empty texts are the end id alone (nothing, without one); equal doc_ids stay next to each other,
    null ones come first; an empty table gives an empty one.
    """

    def encode(batches):
        from pyspark import TaskContext

        enc, part, seq = encoder(tokenizer_path), TaskContext.get().partitionId(), itertools.count()
        names, numbers, ids, before = [], [], [], 0

        def files(last: bool):
            """Images of the documents held, but for those at the end that don't make a whole one yet."""
            nonlocal names, numbers, ids, before
            key, n, flat = pa.concat_arrays(names), np.concatenate(numbers), np.concatenate(ids)
            ends, i, a = np.cumsum(n), 0, 0
            while i < len(n):
                j = int(np.searchsorted(ends, a + ids_per_file, "left")) + 1
                if j > len(n):
                    if not last:
                        break
                    j = len(n)
                b = int(ends[j - 1])
                lists = [pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), x) for x in (key.slice(i, j - i), pa.array(n[i:j], pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([next(seq)], pa.int32()), pa.array([before], pa.int64()), *lists, pa.array([b - a], pa.int64()), pa.array([encode_ids(flat[a:b])], pa.binary())], ["part", "seq", "before", "doc_ids", "n_tokens", "n", "ids"])
                before += b - a
                i, a = j, b
            names, numbers, ids = [key.slice(i)], [n[i:]], [flat[a:]]

        for batch in batches:
            raw, offsets = column_bytes(batch.column(1))
            for i, j in doc_runs(offsets):
                flat, ends = with_end(*enc.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), end_id)
                names.append(batch.column(0).slice(i, j - i))
                numbers.append(np.diff(ends, prepend=0))
                ids.append(flat)
                if sum(map(len, ids)) >= ids_per_file:
                    yield from files(False)
        if names:
            yield from files(True)

    rows = text_only(docs)
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(lean(encode), FILE_SCHEMA).write.parquet(path)


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) from the table written; ids are unpacked from the files, start counts all ids before.

    A file knows the ids before it in its part; what comes before each part is one row a part, as
    many as the range partitions, and is broadcast, so that no file is shuffled.
    """
    parts = files.groupBy("part").agg(F.sum("n").alias("in_part"))
    base = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("base"))
    rows = files.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("base"), "doc_ids", "n_tokens", "ids")

    def decode(batches):
        for batch in batches:
            for k, base in enumerate(batch.column(0).to_pylist()):
                ids = decode_ids(batch.column(3)[k].as_buffer().to_pybytes()).astype("<u4")
                names, n = batch.column(1)[k].values, batch.column(2)[k].values.to_numpy().astype(np.int64)
                ends = np.cumsum(n)
                cut = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([names, pa.array(ends - n + base), pa.array(n), cut.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(lean(decode), "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files read back."""
    import public_tokenizers

    with Scratch(spark) as s:
        path = f"{s.root}/kept/token_files"
        write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    files = spark.read.parquet(path)
    return read_token_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
