"""Best-fit packing of documents into training sequences by large-item matching."""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column_bytes, doc_runs, lean, text_only
from .tokens import encoder, with_end

CAPACITY = 2048


def pack(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], int]:
    """(bin of each item, its offset there, number of bins). Items must be 1..capacity long.

    Items above a third of the capacity go first, from the longest: each opens a bin and takes the
    longest other such item that still fits, so that at most two meet. The rest, from the longest,
    go to the bin with the smallest gap that holds them, or open one.
    """
    by = [[] for _ in range(capacity + 1)]
    for i, n in enumerate(lengths):
        by[n].append(i)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps: list[int] = []  # sorted, without repetition
    count = 0

    def leave(b: int, gap: int) -> None:
        if not gaps[gap]:
            bisect.insort(open_gaps, gap)
        gaps[gap].append(b)

    third = capacity // 3
    large = [n for n in range(third + 1, capacity + 1) if by[n]]
    while large:
        n = large[-1]
        i = by[n].pop()
        if not by[n]:
            large.pop()
        bins[i], gap = count, capacity - n
        k = bisect.bisect_right(large, gap) - 1
        if k >= 0:
            m = large[k]
            j = by[m].pop()
            if not by[m]:
                large.pop(k)
            bins[j], offsets[j] = count, n
            gap -= m
        leave(count, gap)
        count += 1
    for n in range(third, 0, -1):
        for i in by[n]:
            k = bisect.bisect_left(open_gaps, n)
            if k < len(open_gaps):
                gap = open_gaps[k]
                b = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(k)
            else:
                gap, b = capacity, count
                count += 1
            bins[i], offsets[i] = b, capacity - gap
            leave(b, gap - n)
    return bins, offsets, count


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids binary): every document's ids with end_id, cut only if longer than capacity; then the first piece takes the remainder."""

    def cut(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            raw, offsets = column_bytes(batch.column(1))
            for i, j in doc_runs(offsets):
                ids, ends = with_end(*enc.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), end_id)
                n = np.diff(ends, prepend=0)
                parts = -(-n // capacity)
                doc = np.repeat(np.arange(j - i), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                head = (n - (parts - 1) * capacity)[doc]
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                size = np.where(piece == 0, head, capacity)
                data, upto = ids.astype("<u4").tobytes(), np.cumsum(size * 4)
                sums = [zlib.crc32(data[x:y]) for x, y in zip((upto - size * 4).tolist(), upto.tolist(), strict=True)]
                own = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(np.concatenate([[0], upto]).tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(sums, pa.int64()), own.cast(pa.binary())], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return text_only(docs).mapInArrow(lean(cut), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary")


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY, group: int = 50_000) -> DataFrame:
    """The pieces (doc_id, piece, length, more) with sequence_id and offset.

    Pieces as long as a sequence are one each and need no company. The others are dealt by their
    place in the table, so that no doc_id, however often it repeats, fills a group, into groups of about ``group``, packed each by itself; a group leaves a few sequences less than
    full, whatever its size, so the loss against one global packing is about one in ``group``.
    """
    n = pieces.where(F.col("length") < capacity).count()
    groups = max(1, -(-n // group))
    full = pieces.where(F.col("length") >= capacity)
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < capacity).withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    fields = [f for f in rest.schema.fields if f.name != "group"]

    def pack_group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets, _ = pack(table.column("length").to_pylist(), capacity)
        base = table.column("group")[0].as_py() << 40
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(np.array(bins, np.int64) + base)).append_column("offset", pa.array(offsets, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id bigint, offset bigint"
    return rest.groupBy("group").applyInArrow(pack_group, schema).unionByName(full)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


def packed(spark, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Places and checksums of all pieces. Null text is the end id alone; rows that repeat a doc_id are packed like others; an empty table gives none."""
    with Scratch(spark) as s:
        pieces = s.table(token_pieces(docs, tokenizer_path).drop("ids"))
        return s.keep(assign_sequences(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
