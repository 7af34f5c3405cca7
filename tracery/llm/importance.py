"""Importance resampling towards a target distribution: an automaton over a dictionary of words emits CRCs, which compose to those of n-grams."""

from __future__ import annotations

import functools
import itertools
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Scratch, column_bytes, doc_runs, lean, spans

#: Words of a feature at most, buckets, words that a document needs to be drawn, percentage drawn, and the draw's seed.
MOST_WORDS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, 42
#: The dictionary: words met most often in so many documents of up to so many bytes. It bounds what travels with the scan, not what is counted.
DICTIONARY, SAMPLE, SAMPLE_BYTES = 200_000, 20_000, 1 << 20
#: Words whose features are composed at once.
STEP = 1 << 19

U32 = np.uint32
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` is a word of lower-cased text: digits, a-z and what is beyond ASCII.
GAP = np.ones(256, bool)
GAP[48:58] = GAP[97:123] = GAP[128:] = False
#: What the automaton reads: lower case, each byte of no word a space.
PLAIN = np.where(GAP[LOWER], np.uint8(32), LOWER)
_SHORT = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=U32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ U32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _past_zeros(c: np.ndarray, n: int) -> np.ndarray:
    """What n zero bytes make of a CRC's register."""
    for _ in range(n):
        c = _CRC[c & U32(255)] ^ c >> U32(8)
    return c


@functools.cache
def _shifts() -> np.ndarray:
    """shifts[n, j, b]: what n zero bytes, for n < _SHORT, make of byte b at place j of a register; it is linear, so the four are added."""
    byte = np.arange(256, dtype=U32)
    one = np.stack([byte << U32(8 * j) for j in range(4)])
    out = [one]
    for _ in range(_SHORT - 1):
        out.append(_past_zeros(out[-1], 1))
    return np.stack(out)


@functools.cache
def _doubled(k: int) -> np.ndarray:
    """The same for 2**k zero bytes, by doing those of half as many twice."""
    byte = np.arange(256, dtype=U32)
    if k == 0:
        return _shifts()[1]
    half = _doubled(k - 1)
    return np.stack([_apply(half, half[j][byte]) for j in range(4)])


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & U32(255)] ^ table[1][c >> U32(8) & U32(255)] ^ table[2][c >> U32(16) & U32(255)] ^ table[3][c >> U32(24)]


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs moved past n bytes each: shifted(crc(a), len(b)) ^ crc(b) is that of a and b together."""
    flat = _shifts().reshape(-1)
    at = np.minimum(n, _SHORT - 1).astype(np.int64) << 10
    out = flat[at + (c & U32(255))] ^ flat[at + 256 + (c >> U32(8) & U32(255))] ^ flat[at + 512 + (c >> U32(16) & U32(255))] ^ flat[at + 768 + (c >> U32(24))]
    long = np.flatnonzero(n >= _SHORT)
    if len(long):
        x, rest = c[long], n[long].astype(np.int64)
        for k in range(int(rest.max()).bit_length()):
            has = rest >> k & 1 == 1
            x[has] = _apply(_doubled(k), x[has])
        out[long] = x
    return out


_SPACE = U32(zlib.crc32(b" "))


def feature_crcs(crc: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Of the payloads of successive words: the CRCs of all runs of 1, 2 and 3 words joined by a space, each at its first word."""
    runs = [crc]
    for k in range(1, MOST_WORDS):
        if len(crc) <= k:
            runs.append(crc[:0])
            continue
        before = runs[-1][: len(crc) - k]
        runs.append(shifted(shifted(before, np.ones(len(before), np.int64)) ^ _SPACE, length[k:]) ^ crc[k:])
    return runs


class Dictionary:
    """An Aho-Corasick automaton over words between spaces; what an entry carries, its CRC and its length, lies at its number in two arrays."""

    def __init__(self, words: list[bytes]):
        import ahocorasick

        self.tree = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(words):
            self.tree.add_word(f" {w.decode('latin-1')} ", i)
        if words:
            self.tree.make_automaton()
        self.crc, self.length = np.array([zlib.crc32(w) for w in words], U32), np.array([len(w) for w in words], np.int64)

    def payloads(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC and length of each word of the rows, and the first word of each row (with an end).

        The automaton emits those of the dictionary's words, where these end; the words between,
        which it doesn't hold, are taken as they stand.
        """
        # a space before, after and between rows: no word goes over a row's end
        n = len(offsets) - 1
        wide = np.full(len(raw) + n + 1, 32, np.uint8)
        wide[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = PLAIN[raw]
        solid = wide != 32
        edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        first, end = edge[::2], edge[1::2]
        crc, length = np.zeros(len(first), U32), end - first
        text = wide.tobytes()
        new = np.arange(len(first))
        if len(self.crc) and len(first):
            flat = np.fromiter(itertools.chain.from_iterable(self.tree.iter(text.decode("latin-1"))), np.int64)
            at = np.searchsorted(end, flat[::2])
            crc[at], length[at] = self.crc[flat[1::2]], self.length[flat[1::2]]
            missed = np.ones(len(first), bool)
            missed[at] = False
            new = np.flatnonzero(missed)
        if len(new):
            crc[new] = np.fromiter((zlib.crc32(text[a:b]) for a, b in zip(first[new].tolist(), end[new].tolist(), strict=True)), U32, len(new))
        return crc, length, np.searchsorted(first, offsets + np.arange(n + 1))


@functools.lru_cache(maxsize=1)
def _made(key: str, shared) -> Dictionary:
    return Dictionary(shared.value)


class SharedDictionary:
    """A dictionary that travels as its words; each worker makes the automaton once."""

    def __init__(self, s: Scratch, words: list[bytes]):
        self.key, self.words = uuid.uuid4().hex, s.share(words)

    def get(self) -> Dictionary:
        return _made(self.key, self.words)


def dictionary_of(docs: DataFrame, most: int = DICTIONARY, sample: int = SAMPLE) -> list[bytes]:
    """The words met most often in a sample of documents, those of smallest hashes: at most ``most``.

    It decides what the automaton knows, not what is counted.
    """
    short = docs.where((F.octet_length("text") <= SAMPLE_BYTES) & F.col("doc_id").isNotNull())
    ids = short.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample).distinct()
    chosen = short.select("text", F.xxhash64("doc_id").alias("h")).join(F.broadcast(ids), "h", "left_semi")
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = chosen.select(F.explode(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")).alias("word")).where("word <> ''")
    top = each.groupBy("word").count().orderBy(F.desc("count"), "word").limit(most).select("word").toArrow()
    return [w.encode() for w in top.column(0).to_pylist()]


def _texts(batch_column, known: Dictionary):
    """(first row, payloads, first words) of slices of rows; one long row is scanned span by span, and its payloads joined."""
    raw, offsets = column_bytes(batch_column)
    for i, j in doc_runs(offsets):
        text = raw[offsets[i] : offsets[j]]
        if j - i > 1 or len(text) <= 1 << 20:
            yield i, *known.payloads(text, offsets[i : j + 1] - offsets[i])
            continue
        parts = [known.payloads(text[a:b], np.array([0, b - a]))[:2] for a, b in spans(text, GAP[LOWER])]
        crc, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield i, crc, length, np.array([0, len(crc)])


def _buckets(crc: np.ndarray, length: np.ndarray, first: np.ndarray):
    """(bucket, row) arrays of all features of the rows, a bounded number of words at a time; a feature doesn't go over a row's end."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for a in range(0, len(crc), STEP):
        b = min(a + STEP, len(crc))
        wide = min(b + MOST_WORDS - 1, len(crc))
        for k, c in enumerate(feature_crcs(crc[a:wide], length[a:wide])):
            n = min(b - a, len(c))
            own = row[a : a + n]
            whole = own == row[a + k : a + k + n]
            yield (c[:n] % U32(BUCKETS)).astype(np.int64)[whole], own[whole]


def bucket_counts(texts: DataFrame, words: SharedDictionary) -> DataFrame:
    """(bucket, n) of all features of a column text: a task counts its own, one row a bucket leaves it."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, *payloads in _texts(batch.column(0), words.get()):
                for bucket, _ in _buckets(*payloads):
                    counts += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["bucket", "n"])

    return texts.select(F.col("text").cast("string")).mapInArrow(lean(run), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, words: SharedDictionary) -> np.ndarray:
    """Gain of each bucket: floor(1000 ln) of its smoothed share in the target over that in the documents."""
    spark = docs.sparkSession
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    for name, df in (("s", docs), ("t", target)):
        both = both.join(bucket_counts(df, words).withColumnRenamed("n", name), "bucket", "left")
    rows = both.fillna(0).orderBy("bucket").toArrow()
    s, t = (rows.column(c).to_numpy().astype(np.float64) for c in ("s", "t"))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighed(docs: DataFrame, gain, words: SharedDictionary) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of documents (doc_id, text); gain is a broadcast of BUCKETS numbers."""

    def run(batches):
        for batch in batches:
            n_words, weight, n_features = (np.zeros(len(batch), np.int64) for _ in range(3))
            for i, crc, length, first in _texts(batch.column(1), words.get()):
                n = len(first) - 1
                n_words[i : i + n] = np.diff(first)
                for bucket, row in _buckets(crc, length, first):
                    n_features[i : i + n] += np.bincount(row, minlength=n)
                    # whole numbers below 2**53, which a double sums exactly
                    weight[i : i + n] += np.bincount(row, weights=gain.value[bucket], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id, seed: int = SEED):
    """floor(-1000 ln(-ln u)) with u drawn from the id's digest: the largest of weight and noise together are a draw by weight without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def with_rank(rows: DataFrame, n_drawn: int, s: Scratch) -> DataFrame:
    """With rank: 1, 2, 3.. of the n_drawn highest scores (eligible rows only, ties to the smaller doc_id), null for others.

    Eligible rows are dealt by ranges of score; the rows before each range are counted, and each
    numbers its own. No task holds more than a range, and only ranges that are drawn from are numbered.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = s.table(rows.where("eligible").select("doc_id", "score", "n_features", "weight").repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))
    sizes = sorted((r["range"], r["count"]) for r in dealt.groupBy("range").count().collect())
    before, drawn = 0, []
    for k, n in sizes:
        if before < n_drawn:
            drawn.append((k, before))
        before += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(drawn, "range int, before long"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    own = dealt.join(starts, "range", "left")
    ranked = own.where("before is not null").withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    none = F.lit(None).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, "rank").unionByName(own.where("before is null").select(*columns, none)).unionByName(rows.where("not eligible").select(*columns, none))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of documents (doc_id, text) towards the texts of target (text).

    Null and empty texts have no words, no features and the weight 0. Rows that repeat a doc_id are
    documents of their own, with equal noise; rows without one draw theirs from the empty id and
    come last among equals. Empty tables on either side are fine; other columns, whatever their
    names, are left out. Every text is counted whole.
    """
    with Scratch(docs.sparkSession) as s:
        words = SharedDictionary(s, dictionary_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))))
        gain = s.share(gains(docs, target, words))
        rows = weighed(docs, gain, words).withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "eligible": F.col("n_words") >= LEAST_WORDS})
        rows = s.table(rows)
        n_drawn = rows.where("eligible").count() * percent // 100
        return s.keep(with_rank(rows, n_drawn, s))


def op13_importance(spark, sf_dir: str) -> DataFrame:
    """Weights and the draw of all documents towards the benchmark's texts."""
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
