"""Exact n-gram Jaccard join as a blocked sparse product of document by n-gram incidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOC_SLOTS, Scratch, bitmap, column_bytes, components, doc_runs, in_bitmap, lean, mix, rolled, text_only, words

#: An n-gram of so many documents in one block at most is multiplied out there; a larger column first meets its smallest document only.
WIDE = 24
#: Documents of a wide column that meet those of another part of it, or themselves, in one tile.
TILE = 4096
#: N-grams of more documents than FREQUENT go last in each document's order; so many of them at most.
FREQUENT, MOST_FREQUENT = 24, 500_000
#: Bits of a set's parity signature; each n-gram flips one.
SIGNATURE = 512


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's runs of n words; of fewer words, of them all as one run."""
    _, _, h, first = words(raw, offsets, lower)
    if n & (n - 1):
        grams = _rolled_any(h, n)
    else:
        grams = rolled(h, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mix(np.array([sum(int(x) * 0xD6E8FEB86659FD93 ** (i + 1) for i, x in enumerate(h[a:b])) + b - a & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _rolled_any(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        return h[:0]
    total = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        total += h[i : len(h) - n + 1 + i] * np.uint64(0x9E3779B97F4A7C15 ** (i + 1) & (1 << 64) - 1)
    return mix(total)


def _batches_of_sets(batches, n: int, lower: bool):
    for batch in batches:
        raw, offsets = column_bytes(batch.column(1))
        for i, j in doc_runs(offsets):
            yield batch.column(0).slice(i, j - i), shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n, lower)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def frequent_ngrams(docs: DataFrame, n: int, lower: bool) -> np.ndarray:
    """N-grams of the most documents, rarest first.

    A task reports those that two of its documents or more share. Which n-grams come last
    changes how many candidates there are, never which pairs are found, so the bound on their
    number and what a task leaves out cost no result.
    """

    def count(batches):
        held, size = [], 0

        def flush():
            v, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= 2
            return pa.RecordBatch.from_arrays([pa.array(v[often].view(np.int64)), pa.array(c[often])], ["h", "c"])

        for _, sets in _batches_of_sets(batches, n, lower):
            held += sets
            size += sum(map(len, sets))
            if size > 2_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    rows = docs.mapInArrow(lean(count), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") > FREQUENT)
    got = rows.orderBy(F.desc("c"), "h").limit(MOST_FREQUENT).select("h").toArrow().column(0).to_numpy()
    return got[::-1].view(np.uint64)


def _needed(size: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of this size with any that it links with."""
    return -(-size * percent // 100)


def _signature(grams: np.ndarray) -> bytes:
    """Parity of the n-grams of each bit. Common n-grams cancel out, so two sets differ in at least as many n-grams as their signatures do in bits."""
    slot = (grams >> np.uint64(64 - SIGNATURE.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=SIGNATURE) & 1).astype(bool)).tobytes()


def prefixes(docs: DataFrame, n: int, percent: int, lower: bool, frequent: np.ndarray, scratch: Scratch) -> DataFrame:
    """(doc_id, n_shingles, key, sig, prefix): the size, a digest of the set, its signature, and the n-grams of which linked documents share one.

    N-grams are ordered by hash, the frequent ones after all others. If two sets overlap in at
    least percent of the larger, the first size - needed + 1 of each share one.
    """
    place = np.argsort(frequent)
    shared = scratch.share((frequent[place], place))

    def run(batches):
        known, rank = shared.value
        for keys, sets in _batches_of_sets(batches, n, lower):
            short, digest, sig = [], [], []
            for s in sets:
                take = len(s) - int(_needed(np.int64(len(s)), percent)) + 1 if len(s) else 0
                sig.append(_signature(s))
                digest.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(len(s)))).view(np.int64)) if len(s) else 0)
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hot = known[at] == s
                    plain = s[~hot]
                    if take > len(plain):
                        late = s[hot][np.argsort(rank[at[hot]])]
                        plain = np.concatenate([plain, late])
                    short.append(plain[:take])
                else:
                    short.append(s[:take])
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.int64()), pa.array(sig, pa.binary()), _lists(short)], ["doc_id", "n_shingles", "key", "sig", "prefix"])

    return docs.mapInArrow(lean(run), "doc_id bigint, n_shingles bigint, key bigint, sig binary, prefix array<bigint>")


def _blocks(batches, width: int):
    """Columns of a sorted block in turn: arrays that end with the end of a key, none of which has more rows than a column up to WIDE or a tile."""
    parts, rows = [], 0
    for batch in batches:
        parts.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)])
        rows += len(batch)
        if rows < 200_000:
            continue
        held = [np.concatenate(x) for x in zip(*parts, strict=True)]
        cut = int(np.searchsorted(held[0], held[0][-1], "left"))
        if cut:
            yield [x[:cut] for x in held]
        parts, rows = [[x[cut:] for x in held]], len(held[0]) - cut
    if rows:
        yield [np.concatenate(x) for x in zip(*parts, strict=True)]


def shared_columns(postings: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, n, d, c, first, n_first) of the postings (h, n, d) of n-grams that c documents share, two or more, the first of them being ``first``.

    Columns are counted in an aggregate that combines before the shuffle; the join back is one that
    Spark splits where a column is long.
    """
    counts = postings.groupBy("h").agg(F.count("*").alias("c"), F.min("d").alias("first"), F.min_by("n", "d").alias("n_first")).where("c > 1")
    return scratch.table(postings.join(counts, "h"))


def _fits(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def overlaps(columns: DataFrame, percent: int) -> DataFrame:
    """(a, b) candidates from the shared columns: rows of the sparse product that no bound rules out.

    A task multiplies a block of columns. Columns up to WIDE give all their pairs whose sizes can
    go together; wider ones, which never meet in one task, join each document to the column's
    first, which is the same for all columns of a group of copies. What these leave open is for
    ``rest``.
    """

    def run(batches):
        for h, size, d in _blocks(batches, 3):
            pairs = [np.zeros((2, 0), np.int64)]
            for k in range(1, WIDE):
                i = np.flatnonzero(h[:-k] == h[k:]) if len(h) > k else np.zeros(0, np.int64)
                if not len(i):
                    break
                fits = np.minimum(size[i], size[i + k]) * 100 >= np.maximum(size[i], size[i + k]) * percent
                pairs.append(np.stack([d[i[fits]], d[i[fits] + k]]))
            p = np.concatenate(pairs, 1)
            p = np.unique(np.stack([p.min(0), p.max(0)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], ["a", "b"])

    narrow = columns.where(F.col("c") <= WIDE).select("h", "n", "d").repartition("h").sortWithinPartitions("h", "d")
    wide = columns.where((F.col("c") > WIDE) & (F.col("d") != F.col("first")) & _fits("n", "n_first", percent)).select(F.col("first").alias("a"), F.col("d").alias("b"))
    return narrow.mapInArrow(lean(run), "a bigint, b bigint").unionByName(wide).distinct()


def tiled(postings: DataFrame) -> DataFrame:
    """The postings (h, d, count, ..) of wide columns with tile and side: a column of more than TILE documents is cut into parts by hash, and each two parts meet in a tile of their own, so that every pair meets once and no task holds a column."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("count") / TILE)).cast("int")
    rows = postings.withColumn("parts", parts).withColumn("k", F.pmod(F.xxhash64("d"), F.col("parts")).cast("int"))
    as_row = F.expr("transform(sequence(k, parts - 1), i -> struct(k as s, i as t, if(i = k, 2, 0) as side))")
    as_column = F.expr("transform(filter(sequence(0, k), i -> i < k), i -> struct(i as s, k as t, 1 as side))")
    to = rows.withColumn("to", F.explode(F.concat(as_row, as_column)))
    return to.withColumns({"tile": F.xxhash64("h", "to.s", "to.t"), "side": F.col("to.side").cast("long")}).drop("to", "parts", "k", "count")


def rest(tiles: DataFrame, percent: int) -> DataFrame:
    """(a, b) candidates that ``overlaps`` left open, from (tile, n, d, c, p, side, sig) of wide columns: pairs of documents that still lie in different components c.

    p is the column's place in the document's order. What two sets have in common begins, at the
    first column they share, with no more than what either has from there on; and they differ in
    no fewer n-grams than their signatures in bits. Pairs that either bound rules out aren't made.
    Sides of a tile meet each other; 2 stands for both.
    """

    def run(batches):
        for tile, size, d, c, p, side, sig in _blocks(batches, 7):
            start = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            pairs = []
            for i, j in zip(start.tolist(), [*start[1:].tolist(), len(tile)], strict=True):
                if j - i < 2 or (c[i:j] == c[i]).all():
                    continue
                order = np.argsort(size[i:j], kind="stable") + i
                s, e, g, left, of = size[order], d[order], c[order], size[order] - p[order], side[order]
                bits = np.frombuffer(b"".join(sig[order]), np.uint64).reshape(len(order), -1)
                ends = np.searchsorted(s, s * 100 // percent, "right")
                # a document's bound with a partner of its least size; most have none
                for k in np.flatnonzero((ends > np.arange(len(s)) + 1) & (left * (100 + percent) >= 2 * percent * s)).tolist():
                    end = int(ends[k])
                    both = s[k] + s[k + 1 : end]
                    open_ = (g[k + 1 : end] != g[k]) & ((of[k] == 2) | (of[k + 1 : end] != of[k]))
                    at = k + 1 + np.flatnonzero(open_ & (np.minimum(left[k], left[k + 1 : end]) * (100 + percent) >= percent * both))
                    differ = np.bitwise_count(bits[at] ^ bits[k]).sum(1, dtype=np.int64)
                    other = e[at[differ * (100 + percent) <= (100 - percent) * (s[k] + s[at])]]
                    if len(other):
                        pairs.append(np.stack([np.minimum(other, e[k]), np.maximum(other, e[k])]))
            if pairs:
                found = np.unique(np.concatenate(pairs, 1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    rows = tiles.select("tile", "n", "d", "c", "p", "side", "sig").repartition("tile").sortWithinPartitions("tile", "d")
    return rows.mapInArrow(lean(run), "a bigint, b bigint").distinct()


def possible(pairs: DataFrame, short: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes overlap so much that the sets may link, from (d, n, prefix).

    Of two prefixes, all that the one which ends earlier in the order has in common with the other
    set lies within the other's prefix. So the sets have no more in common than the prefixes have,
    and what comes after that prefix: the larger of the two remainders at most.
    """
    side = lambda x: short.select(F.col("d").alias(x), F.col("n").alias(f"n_{x}"), F.col("prefix").alias(f"prefix_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "prefix_a", "prefix_b")

    def compare(batches):
        for batch in batches:
            n = [batch.column(k).to_numpy() for k in (2, 3)]
            lists = [batch.column(k) for k in (4, 5)]
            size = [x.value_lengths().to_numpy() for x in lists]
            values = np.concatenate([x.flatten().to_numpy() for x in lists])
            row = np.concatenate([np.repeat(np.arange(len(x)), k) for x, k in zip(lists, size, strict=True)])
            order = np.lexsort((values, row))
            v, r = values[order], row[order]
            common = np.bincount(r[1:][(v[1:] == v[:-1]) & (r[1:] == r[:-1])], minlength=len(batch))
            most = common + np.maximum(n[0] - size[0], n[1] - size[1])
            yield batch.select([0, 1]).filter(pa.array(most * (100 + percent) >= percent * (n[0] + n[1])))

    return both.mapInArrow(lean(compare), "a bigint, b bigint")


def verified(pairs: DataFrame, short: DataFrame, docs: DataFrame, n: int, percent: int, lower: bool, scratch: Scratch) -> DataFrame:
    """The pairs whose sets, from the whole texts, overlap enough: 100 * common >= percent * union.

    A bitmap of the documents in pairs goes to the tasks that make the sets, so that no text is shuffled.
    """
    pairs = scratch.table(possible(pairs, short, percent))
    slot = lambda c: F.expr(f"cast(pmod(xxhash64({c}), {DOC_SLOTS}) as int)").alias("slot")
    shared = scratch.share(bitmap(pairs.select(slot("a")).unionByName(pairs.select(slot("b"))), DOC_SLOTS))

    def pick(batches):
        bits = shared.value
        for batch in batches:
            keep = in_bitmap(bits, batch.column(2).to_numpy())
            yield batch.filter(pa.array(keep)).select([0, 1])

    def run(batches):
        for keys, sets in _batches_of_sets(pick(batches), n, lower):
            yield pa.RecordBatch.from_arrays([keys, pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "grams"])

    sets = scratch.table(docs.select("doc_id", "text", slot("doc_id")).mapInArrow(lean(run), "doc_id bigint, grams binary"))
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("grams_b")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("grams_a")), "a").select("a", "b", "grams_a", "grams_b")

    def compare(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(lean(compare), "a bigint, b bigint")


def jaccard_groups(docs: DataFrame, n: int, percent: int, lower: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents joined by links of n-gram sets with 100 * common >= percent * union.

    component_id is the smallest doc_id of those reachable. Sets without n-grams (null or empty
    text) link with nothing. Documents of equal sets are linked and stand for each other in all
    that follows; so equal rows, however many, cost one. Rows that repeat a doc_id are one document,
    linked if any of its texts is; each gives a row with its own size. Rows without a doc_id link with nothing and have no component. An empty
    table gives none; other columns are left out.
    """
    spark = docs.sparkSession
    docs = text_only(docs)
    with Scratch(spark) as s:
        frequent = frequent_ngrams(docs, n, lower)
        own = s.table(prefixes(docs, n, percent, lower, frequent, s))
        known = own.where("n_shingles > 0 and doc_id is not null")
        # a table of its own, so that Spark can split the join with a group of many copies
        heads = s.table(known.groupBy("key", "n_shingles").agg(F.min("doc_id").alias("d")))
        member = known.select("doc_id", "key", "n_shingles").join(heads, ["key", "n_shingles"]).select("doc_id", "n_shingles", "d")
        member = s.table(member)
        # what stands for the texts of one doc_id is linked
        low = member.groupBy("doc_id").agg(F.min("d").alias("a"), F.max("d").alias("high")).where("a < high").select("doc_id", "a")
        same = s.table(member.join(low, "doc_id").where("d <> a").select("a", F.col("d").alias("b")).distinct())
        lead = member.where("doc_id = d").select("doc_id").distinct()
        short = s.table(known.join(lead, "doc_id", "left_semi").dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("d"), F.col("n_shingles").alias("n"), "sig", "prefix"))
        postings = short.select(F.explode("prefix").alias("h"), "n", "d")
        pairs = s.table(overlaps(shared_columns(postings, s), percent))
        # a pair for each document first: what these join need not be compared any more
        links = s.table(verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), short, docs, n, percent, lower, s).unionByName(same))
        comp = s.table(components(links, s))
        named = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
        left = pairs.join(named("a"), "a", "left").join(named("b"), "b", "left").where("coalesce(c_a, a) <> coalesce(c_b, b)").select("a", "b")
        links = s.table(links.unionByName(verified(s.table(left), short, docs, n, percent, lower, s)))
        comp = s.table(components(links, s))
        # wide columns of documents in different components; the signature joins these rows alone
        placed = short.join(comp.withColumnRenamed("node", "d"), "d", "left").select(F.posexplode("prefix").alias("p", "h"), "n", "d", F.coalesce("component", "d").alias("c"))
        mixed = placed.groupBy("h").agg(F.count("*").alias("count"), F.min("c").alias("low"), F.max("c").alias("high")).where(F.col("count") > WIDE).where("low < high").select("h", "count")
        open_ = s.table(placed.join(mixed, "h")).join(short.select("d", "sig"), "d").select("h", "count", "n", "d", "c", F.col("p").cast("long").alias("p"), "sig")
        more = s.table(rest(tiled(open_), percent))
        if more.limit(1).count():
            links = links.unionByName(s.table(verified(more, short, docs, n, percent, lower, s)))
            comp = s.table(components(links, s))
        out = member.join(comp.withColumnRenamed("node", "d"), "d", "left").select("doc_id", "n_shingles", F.coalesce("component", "d").alias("component_id"))
        empty = own.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return s.keep(out.unionByName(empty))


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of the documents by shingles of 4 words at 0.85."""
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)
