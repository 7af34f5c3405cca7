"""What filters remove together: sorted lists of failing ids, united and subtracted by galloping merges."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, U64, Scratch, column_bytes, doc_runs, lean, spans, words

#: The filters in natural order; bit k of a document's failures is the k-th one's.
FILTERS = "ABCDE"
#: Least words, least percentage of distinct words, most percentage of capitals, characters that no text may hold.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, "#$%&*|"
#: A text that more than one row in HEAVY holds is sent to every task: there are fewer than HEAVY of these.
HEAVY = 10_000
#: Failing documents of an id range, whose lists one task merges.
RANGE_ROWS = 500_000

_BAD = np.zeros(256, bool)
_BAD[[ord(c) for c in MARKS]] = True
SUMS = ["removed", "good", "toxic"]


def _word_counts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of each row; one long row is hashed span by span."""
    n = len(offsets) - 1
    if n > 1:
        _, _, h, first = words(raw, offsets, lower=False)
        bits = (n - 1).bit_length()
        row = np.repeat(np.arange(n), np.diff(first)).astype(U64)
        key = np.sort(row << U64(64 - bits) | h >> U64(bits))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        return np.diff(first), np.bincount((key[new] >> U64(64 - bits)).astype(np.int64), minlength=n)
    hashes = [words(raw[a:b], np.array([0, b - a]), lower=False)[2] for a, b in spans(raw, SPACE)]
    h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    return np.array([len(h)]), np.array([len(np.unique(h))])


def _held(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row a mask holds."""
    if len(offsets) == 2:
        return np.array([np.count_nonzero(mask)])
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])


def own_failures(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that each row of UTF-8 text fails."""
    out = []
    for i, j in doc_runs(offsets):
        text, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n, distinct = _word_counts(text, at)
        capitals, chars = _held((text >= 65) & (text <= 90), at), _held((text & 0xC0) != 0x80, at)
        fails = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * chars, _held(_BAD[text], at) > 0]
        out.append(sum(f.astype(np.int32) << k for k, f in enumerate(fails)))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def tested(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, bits): A to D of each document, and a 128-bit digest of its text; one pass over the texts, no shuffle."""

    def run(batches):
        for batch in batches:
            raw, offsets = column_bytes(batch.column(2))
            digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in itertools.pairwise(offsets.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(own_failures(raw, offsets), pa.int32())], ["doc_id", "part", "digest", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id bigint, part string, digest binary, bits int")


def with_copies(rows: DataFrame, bit: int, s: Scratch) -> DataFrame:
    """The rows with the bit set where a smaller doc_id has the same digest.

    Only digests met under several ids are joined. Those of more than one row in HEAVY are fewer
    than HEAVY and travel with the scan; the others, which no task can have many of, are shuffled.
    """
    groups = s.table(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most"))
    bound = rows.count() / HEAVY
    heavy = groups.where(F.col("n") > bound).select("digest", F.col("least").alias("heavy"))
    light = groups.where(F.col("n") <= bound).select("digest", "least")
    known = rows.join(F.broadcast(heavy), "digest", "left")
    fails = lambda c: F.when(F.col("doc_id") > F.col(c), 1 << bit).otherwise(0)
    of_heavy = known.where("heavy is not null").select("doc_id", "part", F.col("bits").bitwiseOR(fails("heavy")).alias("bits"))
    of_light = known.where("heavy is null").join(light, "digest", "left").select("doc_id", "part", F.col("bits").bitwiseOR(fails("least")).alias("bits"))
    return of_heavy.unionByName(of_light)


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids of a sorted list that another lacks: the shorter one's are sought in the longer, each search from where the last one ended."""
    if not len(a) or not len(b):
        return a
    if len(a) <= len(b):
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        return a[b[at] != a]
    at = np.searchsorted(a, b)
    at = at[(at < len(a)) & (a[np.minimum(at, len(a) - 1)] == b)]
    return np.delete(a, at)


def union(lists: list[np.ndarray]) -> np.ndarray:
    """Ids of several sorted lists: runs of the longest are kept whole, and what the shorter ones add is put between them."""
    longest, *rest = sorted(lists, key=len, reverse=True)
    for short in rest:
        new = minus(short, longest)
        longest = np.insert(longest, np.searchsorted(longest, new), new)
    return longest


def range_sums(failing: np.ndarray, good: np.ndarray, toxic: np.ndarray, weight: np.ndarray, part: np.ndarray, n_filters: int):
    """Of one id range, sorted by part: for each filter and each set of others before it, the part's documents that it still removes, how many are good or toxic, and how many are gone then.

    Yields (filter, before, part, removed, good, toxic) arrays; before is a bit set.
    """
    ids = [np.flatnonzero(failing >> f & 1) for f in range(n_filters)]
    marked = [np.flatnonzero(x) for x in (good, toxic)]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    sums = lambda xs: np.diff(np.concatenate([[0], np.cumsum(weight[xs])])[np.append(np.searchsorted(xs, starts), len(xs))])
    gone = {0: np.zeros(0, np.int64)}
    for before in range(1 << n_filters):
        if before:
            top = before.bit_length() - 1
            gone[before] = union([gone[before ^ (1 << top)], ids[top]])
        for f in range(n_filters):
            if not before >> f & 1:
                removed = minus(ids[f], gone[before])
                yield f, before, part[starts], sums(removed), *(sums(minus(removed, minus(removed, m))) for m in marked)


def overlap_sums(failures: DataFrame, parts: int, n_filters: int = len(FILTERS)) -> DataFrame:
    """(part, filter, before, removed, good, toxic) over all failures (part, doc_id, bits, good, toxic, m), dealt by ranges of ids; m equal rows count as m."""

    def run(batches):
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found)
        names = table.column("part").combine_chunks().dictionary_encode()
        bits, good, toxic, m = (table.column(c).to_numpy() for c in ("bits", "good", "toxic", "m"))
        for f, before, part, *sums in range_sums(bits, good, toxic, m, names.indices.to_numpy(), n_filters):
            n = len(part)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(part)), pa.array(np.full(n, f, np.int32)), pa.array(np.full(n, before, np.int32)), *(pa.array(x.astype(np.int64)) for x in sums)], ["part", "filter", "before", *SUMS])

    dealt = failures.repartitionByRange(parts, "doc_id").sortWithinPartitions("part", "doc_id", "bits").select("part", "bits", "good", "toxic", "m")
    sums = dealt.mapInArrow(lean(run), "part string, filter int, before int, removed bigint, good bigint, toxic bigint")
    return sums.groupBy("part", "filter", "before").agg(*(F.sum(c).alias(c) for c in SUMS))


def orders(filters: str = FILTERS) -> list[tuple]:
    """(n, filter_order, step, letter, filter, before) of each step of all orders."""
    rows = [("".join(filters[f] for f in p), k + 1, filters[p[k]], p[k], sum(1 << f for f in p[:k])) for p in itertools.permutations(range(len(filters))) for k in range(len(filters))]
    return [(i, *r) for i, r in enumerate(rows)]


def audit(rows: DataFrame, labels: DataFrame, s: Scratch, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order and step from rows (doc_id, part, bits) and labels (doc_id, quality, toxic)."""
    spark, n = rows.sparkSession, len(filters)
    totals = rows.groupBy("part").agg(F.count("*").alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    units = rows.where("bits > 0").groupBy("part", "doc_id", "bits").agg(F.count("*").alias("m"))
    units = s.table(units.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"]))
    # so many ranges that none holds more than RANGE_ROWS, and some for every core
    parts = max(spark.sparkContext.defaultParallelism, units.count() // RANGE_ROWS + 1)
    sums = s.table(overlap_sums(units, parts, n))
    size = F.bit_count("before").cast("int")
    orders_of = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))), size + 1)
    each = sums.groupBy("part", "filter").agg(F.sum(F.when(size == n - 1, F.col("removed"))).alias("unique_fails"), F.sum(F.when(size == 0, F.col("removed"))).alias("fails"), F.sum(F.col("removed") * orders_of).alias("shapley"))
    steps = spark.createDataFrame(orders(filters), "k int, filter_order string, step int, letter string, filter int, before int")
    grid = totals.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n * math.factorial(n) - 1)))).join(F.broadcast(steps), "k")
    got = grid.join(sums, ["part", "filter", "before"], "left").join(each, ["part", "filter"], "left").fillna(0)
    return with_kept(got)


def with_kept(rows: DataFrame) -> DataFrame:
    """The columns of the report; kept is what the steps up to this one leave."""
    so_far = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    return rows.select("part", "filter_order", "step", (F.col("n") - so_far).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of documents (doc_id, text, source).

    A part is a source, a null one the empty string. A null text is empty. A document is good or
    toxic if any of its labels says so. Rows that repeat a doc_id are documents of their own, and
    copies of one another only under different ids; rows without a doc_id copy nothing and carry
    no label. An empty table gives none; other columns, whatever their names, are left out. Words
    of a document are told apart by 64-bit hashes, texts by 128-bit digests.
    """
    with Scratch(docs.sparkSession) as s:
        base = s.table(tested(docs))
        rows = s.table(with_copies(base, FILTERS.index("E"), s))
        return s.keep(audit(rows, labels.select("doc_id", "quality", "toxic"), s))


def op12_filters(spark, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, by source."""
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
