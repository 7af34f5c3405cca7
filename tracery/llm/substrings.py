"""Removal of passages that occur earlier, through FM-indexes of shards of the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, _powers, bitmap, column_bytes, doc_runs, in_bitmap, lean, mix, rolled, slots_for, text_only, words
from .fm_index import FMIndex

#: Successive words whose hashes choose where a window is sent; the window takes the smallest such hash in it.
ANCHOR = 8
#: Low bits of a word run's place, below the bits of its hash.
PLACE = np.uint64(28)
#: Bytes of a word's hash that go with a run: windows are taken as equal if these agree for each of their words.
WIDTH = 5
#: Words that one index holds at least (anchors that follow one another share an index), and places of one anchor above which its windows are told apart by digests instead.
SHARD, MOST = 300_000, 4_000
#: Rounds in which a shard's runs are searched for in the earliest of their anchor, before the rest is indexed together.
ROUNDS = 2
_OTHER = np.uint64(0xA0761D6478BD642F)


def anchored(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, end window) of the runs of successive windows of one row that share an anchor."""
    size = np.maximum(np.diff(first) - window + 1, 0)
    starts = np.repeat(first[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    if not len(starts):
        return np.zeros(0, np.int64), starts, starts
    grams = rolled(h, ANCHOR)
    best = (grams >> PLACE << PLACE) | np.arange(len(grams), dtype=np.uint64)
    wide, reach = window - ANCHOR + 1, 1
    low = best
    while reach * 2 <= wide:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < wide:
        low = np.minimum(low[: len(best) - wide + 1], low[wide - reach : len(best) - reach + 1])
    own = low[starts]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)])
    at = np.flatnonzero(new)
    return (own[at] >> PLACE).astype(np.int64), starts[at], starts[np.append(at[1:], len(starts)) - 1] + 1


def _runs(batches, window: int):
    """Of each slice of rows (doc_id, text, t): ids, text digests, word hashes, first words, runs."""
    for batch in batches:
        raw, offsets = column_bytes(batch.column(1))
        for i, j in doc_runs(offsets):
            _, _, h, first = words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], False)
            yield batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), h, first, anchored(h, first, window)


def repeated_anchors(docs: DataFrame, window: int, s: Scratch) -> DataFrame:
    """(anchor, c) of the anchors that are met at c places, two or more: counted on the executors, combined before the shuffle."""

    def count(batches):
        held, size = [], 0

        def flush():
            v, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(v), pa.array(c.astype(np.int64))], ["anchor", "c"])

        for *_, (anchor, _, _) in _runs(batches, window):
            held.append(anchor)
            size += len(anchor)
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return s.table(docs.mapInArrow(lean(count), "anchor bigint, c bigint").groupBy("anchor").agg(F.sum("c").alias("c")).where("c > 1"))


def _slot_bits(anchors: DataFrame, slots: int) -> np.ndarray:
    return bitmap(anchors.select(F.col("anchor").bitwiseAND(F.lit(slots - 1)).alias("slot")), slots)


def _flat(h: np.ndarray, a: np.ndarray, size: np.ndarray) -> np.ndarray:
    return h[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def occurrences(docs: DataFrame, window: int, shared) -> DataFrame:
    """(anchor, doc_id, t, start, words binary): the runs of windows whose anchor may be met again, but for common anchors."""

    def run(batches):
        bits, common = shared.value
        for keys, digests, h, first, (anchor, a, b) in _runs(batches, window):
            slot = anchor & (len(bits) * 64 - 1)
            keep = in_bitmap(bits, slot)
            if common is not None:
                keep &= ~in_bitmap(common, slot)
            anchor, a, b = anchor[keep], a[keep], b[keep]
            if not len(a):
                continue
            size = b + window - 1 - a
            doc = np.searchsorted(first, a, "right") - 1
            flat = np.ascontiguousarray(_flat(h, a, size).view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :])
            offsets = np.concatenate([[0], np.cumsum(size * WIDTH)]).astype(np.int32)
            own = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), keys.take(at), digests.take(at), pa.array((a - first[doc]).astype(np.int32)), own], ["anchor", "doc_id", "t", "start", "words"])

    return docs.mapInArrow(lean(run), "anchor bigint, doc_id bigint, t bigint, start int, words binary")


def _numbers(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // WIDTH, 8), np.uint8)
    wide[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return wide.view(np.uint64).ravel()


def _laid(symbols: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs one after another, a 0 after each, and the end of each."""
    ends = np.cumsum(n + 1) - 1
    text = np.zeros(int(n.sum()) + len(n), np.int64)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    text[np.repeat(ends - n, n) + step] = symbols[np.repeat(begin, n) + step]
    return text, ends


def _searched(anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, parts: list[bytes], window: int) -> np.ndarray:
    """Of runs with their places: bits of the windows whose words also occur at an earlier place.

    In rounds, the earliest open run of each anchor is indexed, and the other open runs are
    streamed against it as symbols: a window that matches an interval with an earlier place is
    late. A run is open until it was indexed or all its windows are late, so each is searched for
    in all earlier ones that tell more. A run that is alone with its anchor has no other to be
    found in. Only one that may repeat itself is streamed against its own index: as many repeated words as a
    window has leave it so many fewer distinct ones. What is open after ROUNDS is indexed at once. Only the
    intervals of the search say what is equal.
    """
    n = np.array([len(x) // WIDTH for x in parts])
    begin, many = np.cumsum(n) - n, n - window + 1
    _, ids = np.unique(_numbers(b"".join(parts)), return_inverse=True)
    _, rank = np.unique(doc, return_inverse=True)
    place = (rank.astype(np.int64) << 32) + start
    pairs = np.unique(np.repeat(np.arange(len(n)), n) << 32 | ids)
    again = np.bincount(pairs >> 32, minlength=len(n)) <= n - window
    mask, full = np.zeros(len(n), np.int64), (np.int64(1) << many) - 1
    left = np.lexsort((place, anchor))
    for step in range(ROUNDS + 1):
        new = np.concatenate([[True], anchor[left][1:] != anchor[left][:-1]]) if len(left) else np.zeros(0, bool)
        left = left[~(new & np.append(new[1:], True)) | again[left]]
        if not len(left):
            break
        new = np.concatenate([[True], anchor[left][1:] != anchor[left][:-1]]) | (step == ROUNDS)
        heads, read = left[new], left[~new | again[left] | (step == ROUNDS)]
        text, ends = _laid(ids + 1, begin[heads], n[heads])
        known, text = np.unique(text, return_inverse=True)
        index = FMIndex(text, window, np.repeat(place[heads] - (ends - n[heads]), n[heads] + 1) + np.arange(len(text)))
        number = np.zeros(int(ids.max()) + 2, np.int64)
        number[known] = np.arange(len(known))
        text, ends = _laid(number[ids + 1], begin[read], n[read])
        least = np.full(len(text), np.iinfo(np.int64).max)
        for _, at, block in index.statistics(text, ends, n[read]):
            least[at] = index.least[block]
        row = np.repeat(np.arange(len(read)), many[read])
        shift = np.arange(len(row)) - np.repeat(np.cumsum(many[read]) - many[read], many[read])
        late = least[(ends - n[read])[row] + shift] < place[read][row] + shift
        np.bitwise_or.at(mask, read[row[late]], np.int64(1) << shift[late])
        left = left[~new & (mask[left] != full[left])]
    return mask


def repeated_runs(runs: DataFrame, window: int) -> DataFrame:
    """(doc_id, t, start, mask) from the occurrences: bit j of mask tells that window start + j also starts at an earlier place.

    Runs of an anchor meet in a shard, MOST at most but for anchors that share a slot with no
    common one; anchors share an index until it is large enough.
    """

    def run(batches):
        held, size, last = [], 0, None  # columns of slices of rows, whole anchors until the last slice

        def flush(cols):
            anchor, doc, t, start, data = cols
            mask = _searched(anchor, doc, start, data, window)
            hit = np.flatnonzero(mask)
            return pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(t[hit]), pa.array(start[hit].astype(np.int32)), pa.array(mask[hit])], ["doc_id", "t", "start", "mask"])

        def joined():
            return [np.concatenate([x[i] for x in held]) for i in range(4)] + [[y for x in held for y in x[4]]]

        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(4)] + [batch.column(4).to_pylist()])
            size += sum(map(len, held[-1][4])) // WIDTH
            if size < SHARD:
                continue
            cols = joined()
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if cut:
                # whole anchors, as many to an index as make its size
                done, upto = 0, np.cumsum([len(x) // WIDTH for x in cols[4][:cut]])
                while done < cut:
                    goal = int(np.searchsorted(upto, (upto[done - 1] if done else 0) + SHARD))
                    end = cut if goal >= cut else int(np.searchsorted(cols[0][:cut], cols[0][goal], "right"))
                    yield flush([x[done:end] for x in cols])
                    done = end
            held = [[x[cut:] for x in cols]]
            size = sum(map(len, held[0][4])) // WIDTH
        if held and len(held[0][0]):
            yield flush(joined())

    rows = runs.repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(lean(run), "doc_id bigint, t bigint, start int, mask bigint")


def _window_digests(h: np.ndarray, a: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of the windows that start at words a."""
    up, down = _powers(len(h))
    out = []
    for x in (h, mix(h ^ _OTHER)):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(x * up[: len(h)], out=sums[1:])
        out.append(mix((sums[a + window] - sums[a]) * down[a]).view(np.int64))
    return out[0], out[1]


def _common_windows(anchor: np.ndarray, a: np.ndarray, b: np.ndarray, common: np.ndarray) -> np.ndarray:
    """First words of the windows whose anchor is common."""
    own = np.flatnonzero(in_bitmap(common, anchor & (len(common) * 64 - 1)))
    size = (b - a)[own]
    return np.repeat(a[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def first_places(docs: DataFrame, window: int, shared) -> DataFrame:
    """(doc_id, place, tag): where each distinct window of a common anchor starts first; tag is half its digest.

    Of a window only the first place is wanted: a task drops the others of each slice, the
    aggregate those of a task before the shuffle, so no task holds the places of one.
    """

    def run(batches):
        _, common = shared.value
        for keys, _, h, first, (anchor, a, b) in _runs(batches, window):
            at = _common_windows(anchor, a, b, common)
            if not len(at):
                continue
            x, y = _window_digests(h, at, window)
            row = np.searchsorted(first, at, "right") - 1
            doc, place = keys.to_numpy()[row], at - first[row]
            order = np.lexsort((place, doc, y, x))
            lead = order[np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])])]
            yield pa.RecordBatch.from_arrays([pa.array(v[lead]) for v in (x, y, doc, place.astype(np.int32))], ["x", "y", "doc_id", "place"])

    rows = docs.mapInArrow(lean(run), "x bigint, y bigint, doc_id bigint, place int")
    return rows.groupBy("x", "y").agg(F.min(F.struct("doc_id", "place")).alias("at")).select("at.doc_id", "at.place", F.col("y").alias("tag"))


def without_repeats(docs: DataFrame, window: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, and the columns in carry as they are): each text's words, joined by single spaces, without those of windows of ``window`` words that also start earlier.

    Earlier is: in a document of smaller doc_id, or before in the same one. Windows are judged on
    the input. Null and empty texts have no words; shorter texts lose none. Rows that repeat a
    doc_id count as one document: a window at the same place of another of them is no repeat. Rows
    without a doc_id have no place: they lose nothing and make nothing a repeat. An empty table
    gives none.
    """
    if not ANCHOR <= window <= 50:
        raise ValueError(f"windows are {ANCHOR} to 50 words long")
    spark = docs.sparkSession
    all_rows = text_only(docs, *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry))).withColumn("t", F.xxhash64("text"))
    docs = all_rows.where("doc_id is not null").select("doc_id", "text", "t")
    with Scratch(spark) as s:
        met = repeated_anchors(docs, window, s)
        often = met.where(F.col("c") > MOST)
        slots = slots_for(met.count())
        any_common = often.limit(1).count() > 0
        shared = s.share((_slot_bits(met, slots), _slot_bits(often, slots) if any_common else None))
        marks = repeated_runs(occurrences(docs, window, shared), window).groupBy("doc_id").agg(F.collect_set(F.struct("t", "start", "mask")).alias("marks"))
        if any_common:
            # what is known of a document meets before its text does, so that the text is shuffled once
            firsts = first_places(docs, window, shared).groupBy("doc_id").agg(F.collect_list(F.struct("place", "tag")).alias("firsts"))
            side = s.keep(marks.join(firsts, "doc_id", "full"))
        else:
            side = s.keep(marks.withColumn("firsts", F.lit(None).cast("array<struct<place:int,tag:bigint>>")))
        common = shared.value[1]
    rows = all_rows.join(side, "doc_id", "left")
    # a bitmap of the common anchors goes with the function: small, as most of its bits are 0
    packed = (np.flatnonzero(common), common[common != 0], len(common)) if any_common else None

    def gone_words(h, first, anchors, marked, leads, texts, known, bits) -> np.ndarray:
        """Which words of the slice's documents go."""
        edge = np.zeros(int(first[-1]) + 1, np.int64)
        doc = np.repeat(np.arange(len(marked)), marked.value_lengths().fill_null(0).to_numpy())
        flat = marked.flatten()
        if len(flat):
            own = flat.field("t").to_numpy() == texts[doc]
            begin = (flat.field("start").to_numpy().astype(np.int64) + first[doc])[own]
            row, bit = np.nonzero((flat.field("mask").to_numpy()[own][:, None] >> np.arange(window)) & 1)
            np.add.at(edge, begin[row] + bit, 1)
            np.add.at(edge, begin[row] + bit + window, -1)
        if bits is not None:
            at = _common_windows(*anchors, bits)
            if len(at):
                _, tag = _window_digests(h, at, window)
                row = np.searchsorted(first, at, "right") - 1
                own = np.stack([row, at - first[row], tag], 1)
                lead_doc = np.repeat(np.arange(len(leads)), leads.value_lengths().fill_null(0).to_numpy())
                flat = leads.flatten()
                lead = np.stack([lead_doc, flat.field("place").to_numpy().astype(np.int64), flat.field("tag").to_numpy()], 1)
                both = np.concatenate([lead, own]) if len(lead) else own
                _, inverse = np.unique(both, axis=0, return_inverse=True)
                inverse = inverse.ravel()
                late = at[~np.isin(inverse[len(lead) :], inverse[: len(lead)]) & known[row]]
                np.add.at(edge, late, 1)
                np.add.at(edge, late + window, -1)
        return np.cumsum(edge)[:-1] > 0

    def cut(batches):
        bits = None
        if packed is not None:
            bits = np.zeros(packed[2], np.uint64)
            bits[packed[0]] = packed[1]
        for batch in batches:
            raw, offsets = column_bytes(batch.column(1))
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            texts_of = batch.column(4).to_numpy()
            for i, j in doc_runs(offsets):
                data = raw[offsets[i] : offsets[j]]
                a, b, h, first = words(data, offsets[i : j + 1] - offsets[i], False)
                anchors = anchored(h, first, window) if bits is not None else None
                gone = gone_words(h, first, anchors, batch.column(2).slice(i, j - i), batch.column(3).slice(i, j - i), texts_of[i:j], known[i:j], bits)
                kept = np.flatnonzero(~gone)
                size = b[kept] - a[kept] + 1  # a space after each
                to = np.cumsum(size)
                out = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
                plain = size - 1
                src = np.repeat(a[kept] - (np.cumsum(plain) - plain), plain) + np.arange(int(plain.sum()))
                dst = np.repeat(to - size - (np.cumsum(plain) - plain), plain) + np.arange(int(plain.sum()))
                out[dst] = data[src]
                upto = np.concatenate([[0], to])[np.searchsorted(kept, first)]
                body = out.tobytes()
                texts = [body[x : max(x, y - 1)].decode() for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                n = np.diff(first)
                left = np.diff(np.searchsorted(kept, first))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(n - left, pa.int64()), pa.array(texts, pa.string()), *(batch.column(5 + k).slice(i, j - i) for k in range(len(carry)))], ["doc_id", "n_words", "n_removed", "kept", *carry])

    carried = [f"carried_{i}" for i in range(len(carry))]
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string" + "".join(f", `{c}` {all_rows.schema[x].dataType.simpleString()}" for c, x in zip(carry, carried, strict=True))
    return rows.select("doc_id", "text", "marks", "firsts", "t", *carried).mapInArrow(lean(cut), schema)


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    """Every document without the passages of 20 words or more that occur earlier."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
