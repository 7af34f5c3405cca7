"""Language identification by cross-parsing against labelled text of each language."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_bytes, doc_runs, lean, text_only

#: Letters told apart, the separator and the unknown letter included.
ALPHABET = 64
UNKNOWN = ALPHABET - 1
#: A parse starts anew after so many symbols, so that long texts are parsed in parallel.
BLOCK = 512
#: Characters of a text read at once, and parses, by language and block, that go side by side.
SLICE, LANES = 1 << 20, 1 << 20
#: Bits of a letter by itself, and of one that the language's text lacks.
LITERAL, ESCAPE = math.log2(ALPHABET), 12.0


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of a text: letters in lower case by the table, each run of anything else as one 0; a long text is read slice by slice."""
    low, parts, gap = text.lower(), [], True
    for a in range(0, len(low), SLICE):
        s = table[np.frombuffer(low[a : a + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = s != 0
        keep[1:] |= s[:-1] != 0
        keep[0] |= not gap
        gap = bool(s[-1] == 0)
        s = s[keep]
        if s.dtype != np.uint8:
            # six bits a symbol, the first ones lowest; a 0 within a code is no symbol
            s = (s[:, None] >> np.arange(0, 30, 6)) & (ALPHABET - 1)
            used = s != 0
            used[:, 0] = True
            s = s[used].astype(np.uint8)
        parts.append(s)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def symbol_table(letters: str) -> np.ndarray:
    """Symbol of each code point: 1.. for the letters given, UNKNOWN for other letters, 0 for the rest.

    Of more letters than there are symbols, the last ones take several each: digits, from symbols
    that are kept for this, as few as do with two digits if two are enough.
    """
    table, most = np.where(_letters(), UNKNOWN, 0).astype(np.uint8), UNKNOWN - 1
    if len(letters) <= most:
        base, digits = 0, 0
    else:
        table = table.astype(np.int32)
        base = next((b for b in range(2, 33) if b**2 >= len(letters) - most + b), 32)
        digits = next(d for d in range(2, 6) if base**d >= len(letters) - most + base)
    for i, c in enumerate(letters):
        if i < most - base:
            table[ord(c)] = i + 1
        else:
            table[ord(c)] = sum(((i - most + base) // base**d % base + most - base + 1) << 6 * d for d in range(digits))
    return table


@functools.lru_cache(maxsize=2)
def _table(letters: str) -> np.ndarray:
    return symbol_table(letters)


def automaton(seq: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix automaton of a sequence: of each state the symbols that lead on, as bits, and its first transition; the transitions, by symbol within a state."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in seq:
        cur, p = len(go), last
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                new = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = new
                    p = link[p]
                link[q] = link[cur] = new
        last = cur
    degree = np.array([len(x) for x in go])
    symbol = np.fromiter((c for x in go for c in x), np.uint64, int(degree.sum()))
    target = np.fromiter((t for x in go for t in x.values()), np.int32, int(degree.sum()))
    state = np.repeat(np.arange(len(go)), degree)
    order = np.lexsort((symbol, state))
    first = np.cumsum(degree) - degree
    used = np.zeros(len(go), np.uint64)
    np.bitwise_or.at(used, state, np.uint64(1) << symbol)
    return used, first.astype(np.int32), target[order]


@functools.lru_cache(maxsize=2)
def _automata(seqs: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The automata of all sequences in one: symbols and first transition of each state, transitions, and each one's root. Made once a Python worker."""
    base, edges, parts = 0, 0, []
    for seq in seqs:
        used, first, target = automaton(seq)
        parts.append((used, first + np.int32(edges), target + np.int32(base), [base]))
        base, edges = base + len(used), edges + len(target)
    used, first, target, roots = (np.concatenate(x) for x in zip(*parts, strict=True))
    return used, first, np.append(target, np.int32(0)), roots.astype(np.int32)


class Model:
    """Bounded labelled text of each language, as symbols, the most frequent language first: what is sent to the workers, where automata are made of it."""

    def __init__(self, letters: str, langs: list[str], seqs: list[bytes]):
        self.letters, self.langs, self.seqs = letters, langs, tuple(seqs)

    def bits(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Bits, by language, of the phrases that parse each sequence: each is the longest match in the language's text.

        A phrase takes the bits of a place in the text, no fewer than a letter takes, or of its
        letters one by one if that is less; so little text is no advantage. A letter that the
        text lacks takes ESCAPE.
        """
        n = np.array([len(s) for s in seqs])
        blocks = -(-n // BLOCK)
        owner = np.repeat(np.arange(len(seqs)), blocks)
        if not len(owner) or not self.langs:
            return np.zeros((len(self.langs), len(seqs)))
        used, first, target, roots = _automata(self.seqs)
        pointer = np.array([max(LITERAL, math.log2(len(s) + 2)) for s in self.seqs])
        longest = int(np.ceil(pointer.max() / LITERAL))
        cost = np.minimum(np.arange(longest + 1)[None, :] * LITERAL, pointer[:, None]).astype(np.float32).ravel()
        row = np.arange(len(self.langs))[:, None] * (longest + 1)
        symbol = np.arange(ALPHABET, dtype=np.uint64)
        has = (used[roots][:, None] >> symbol[None, :] & np.uint64(1)).astype(bool)
        at = first[roots][:, None] + np.bitwise_count(used[roots][:, None] & (np.uint64(1) << symbol)[None, :] - np.uint64(1))
        anew = np.where(has, target[np.minimum(at, len(target) - 1)], roots[:, None]).ravel()
        lost = np.where(has, 0, ESCAPE).astype(np.float32).ravel()
        begun = has.astype(np.int32).ravel()
        lang = np.arange(len(self.langs))[:, None] * ALPHABET
        size = np.full(len(owner), BLOCK)
        last = np.cumsum(blocks)[blocks > 0] - 1
        size[last] = (n - (blocks - 1) * BLOCK)[blocks > 0]
        flat = np.concatenate(seqs)
        start = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        out = np.zeros((len(self.langs), len(seqs)))
        step = max(1, LANES // len(self.langs))
        for a in range(0, len(order), step):
            own = order[a : a + step]
            begin, long = start[own], size[own]
            state = np.repeat(roots[:, None], len(own), 1)
            length = np.zeros(state.shape, np.int32)
            total = np.zeros(state.shape, np.float32)
            active = np.searchsorted(-long, -np.arange(int(long[0])), "left")  # blocks longer than the step
            for at_symbol, k in enumerate(active.tolist()):
                c = flat[begin[:k] + at_symbol]
                u = used[state[:, :k]]
                bit = np.uint64(1) << c.astype(np.uint64)
                on = (u & bit) != 0
                to = target[first[state[:, :k]] + np.bitwise_count(u & (bit - np.uint64(1)))]
                i, j = np.nonzero(~on)
                new = lang[i, 0] + c[j]
                to[i, j] = anew[new]
                total[i, j] += cost[row[i, 0] + np.minimum(length[i, j], longest)] + lost[new]
                length[:, :k] += 1
                length[i, j] = begun[new]
                state[:, :k] = to
            total += cost[row + np.minimum(length, longest)]
            for i in range(len(self.langs)):
                out[i] += np.bincount(owner[own], total[i], len(seqs))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language of fewest bits, of equals the more frequent one, and its share when bits are taken as evidence; `und`, 0 without letters."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        table = _table(self.letters)
        seqs = [symbols(x, table) for x in texts]
        bits = self.bits(seqs)
        best = bits.argmin(0)
        odds = np.exp2(np.maximum(bits.min(0) - bits, -1000) / 4)
        score = 1 / odds.sum(0)
        known = np.array([bool(len(s)) and bool(s.any()) for s in seqs])
        return [self.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0).tolist()


def held_out():
    """Documents that no model learns from: crc32 of the id's text leaves 2 by 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, docs_per_lang: int = 200, symbols_per_lang: int = 40_000, max_langs: int = 200) -> Model:
    """Learn from labelled rows that aren't held out.

    Bounds: docs_per_lang whole documents of each language, by hash of doc_id, joined until
    symbols_per_lang; the max_langs most frequent languages, of equal ones those first by name.
    What reaches the driver and the workers grows with these bounds alone. Null and empty langs
    are no labels. Texts without letters teach nothing. Rows with a null doc_id are not learnt from.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null and lang <> ''").where(~held_out())
    langs = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()]
    pick = rows.where(F.col("lang").isin(langs)).distinct().withColumn("h", F.xxhash64("doc_id")).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("n") <= docs_per_lang)
    wanted = [(r.doc_id, r.lang, r.h) for r in pick.select("doc_id", "lang", "h").collect()]
    if not wanted:
        return Model("", [], [])
    ids = spark.createDataFrame(wanted, "doc_id long, lang string, h long")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(ids), "doc_id")
    # letters by frequency in the sample, from the characters of its texts
    chars = sample.select(F.explode(F.split(F.lower("text"), "")).alias("c")).where(F.col("c").rlike(r"^\p{L}$")).groupBy("c").count().orderBy(F.desc("count"), "c")
    letters = "".join(r.c for r in chars.collect() if len(r.c) == 1)

    def shortened(batches):
        """Of each text the first symbols_per_lang symbols, which is all that may be used of one."""
        table = _table(letters)
        for batch in batches:
            seqs = [symbols(x, table)[:symbols_per_lang].tobytes() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(seqs, pa.binary())], ["lang", "h", "doc_id", "seq"])

    def join(rows: pa.Table) -> pa.Table:
        parts, n = [], 0
        for seq in rows.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("seq", "ascending")]).column("seq").to_pylist():
            s = np.frombuffer(seq, np.uint8)
            if n < symbols_per_lang and s.any():
                parts += [s[: symbols_per_lang - n], np.zeros(1, np.uint8)]
                n += len(parts[-2])
        seq = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return pa.table({"lang": rows.column("lang").slice(0, len(parts) and 1), "seq": pa.array([seq[seq != UNKNOWN].tobytes()][: len(parts) and 1], pa.binary())})

    short = sample.select("lang", "h", "doc_id", "text").mapInArrow(lean(shortened), "lang string, h bigint, doc_id bigint, seq binary")
    found = {r.lang: bytes(r.seq) for r in short.groupBy("lang").applyInArrow(join, "lang string, seq binary").collect()}
    langs = [x for x in langs if x in found]
    return Model(letters, langs, [found[x] for x in langs])


def _predicted(batches, at: int, model: Model):
    """Of each slice of rows: the batch, its first and end row, languages and scores; texts are column ``at``."""
    for batch in batches:
        col = batch.column(at)
        _, offsets = column_bytes(col)
        for i, j in doc_runs(offsets):
            yield batch, i, j, *model.predict([x or "" for x in col.slice(i, j - i).to_pylist()])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; only the text is read.

    Null, empty and letterless texts: `und`, 0. A model without languages gives `und` for all.
    Rows that repeat a doc_id, or have none, are predicted one by one. An empty table gives none.
    No shuffle; the model travels with the function.
    """

    def run(batches):
        for batch, i, j, lang, score in _predicted(batches, 1, model):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return text_only(docs).mapInArrow(lean(run), "doc_id bigint, lang_pred string, score double")


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they are, whose text has a language: no shuffle and no join."""
    at = docs.columns.index("text")

    def run(batches):
        for batch, i, j, lang, _ in _predicted(batches, at, model):
            yield batch.slice(i, j - i).filter(pa.array([x != "und" for x in lang], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op1_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the labelled ones that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
