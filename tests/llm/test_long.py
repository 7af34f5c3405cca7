"""Very long texts through the operators, and toxicity as a whole by plain sums."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracery.llm import common, filter_audit, jaccard, jpeg, langid, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SIZE = 5 << 20


@pytest.fixture(scope="module")
def long_docs(spark):
    """Two texts of five million bytes, one with the other's end, one of a single word, and a short one."""
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    one = some(SIZE // 7)
    rows = [(1, one), (2, some(20_000) + " " + one[-SIZE // 2 :]), (3, "w" * SIZE), (4, "short text of seven words and more")]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], DOCS).repartition(4)
    return dict(rows), df


def test_op1_long_texts(spark, sf, long_docs):
    rows, df = long_docs
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet").unionByName(df))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert set(got) == set(rows) and all(r.lang_pred in model.langs for r in got.values())
    table = langid.symbol_table(model.letters)
    bits = model.bits([langid.symbols(rows[4], table)])[:, 0]
    assert got[4].lang_pred == model.langs[int(bits.argmin())]


def test_op3_long_texts(long_docs):
    rows, df = long_docs
    got = {r.doc_id: r for r in substrings.without_repeats(df).collect()}
    seen = set()
    for k in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", rows[k])
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 19):
            q = hash(tuple(w[i : i + 20]))
            if q in seen:
                gone[i : i + 20] = True
            seen.add(q)
        kept = " ".join(x for x, g in zip(w, gone.tolist(), strict=True) if not g)
        assert (got[k].n_words, got[k].n_removed) == (len(w), int(gone.sum())) and got[k].kept == kept
    assert got[2].n_removed > 200_000


def test_op7_long_texts(spark, long_docs):
    rows, df = long_docs
    got = {r.doc_id: r for r in jpeg.stored_features(df).collect()}
    for k, t in rows.items():
        payload = t.encode() + b" " * (-len(t) % jpeg.ROW)
        assert got[k].n_bytes == len(t) and got[k].payload_sha256 == hashlib.sha256(payload).hexdigest()
    assert got[1].feature != got[2].feature


def test_op10_and_op12_long_texts(spark, long_docs):
    rows, df = long_docs
    copies = df.unionByName(df.where("doc_id = 1").withColumn("doc_id", F.lit(9).cast("long")).withColumn("text", F.concat("text", F.lit(" and a tail"))))
    got = {r.doc_id: r for r in jaccard.jaccard_groups(copies, 4, 85).collect()}
    w = rows[1].split()
    assert got[9].component_id == got[1].component_id == 1 and got[2].component_id == 2 and got[1].n_shingles == len({tuple(w[i : i + 4]) for i in range(len(w) - 3)})
    bits = {r.doc_id: r.bits for r in filter_audit.tested(df).collect()}
    for k, t in rows.items():
        w = t.split()
        assert bits[k] == (len(w) < 50) + 2 * (100 * len(set(w)) < 65 * len(w))


def test_op9_features_chances_and_grades_by_plain_sums(spark, sf, long_docs):
    rows, df = long_docs
    sf = sf.replace("0.001", "0.01")  # as many labels as words can be told by
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, toxicity.grades(spark.read.parquet(f"{sf}/labels.parquet")))
    texts = {r.doc_id: r.text for r in docs.collect()} | {10**6 + k: t for k, t in rows.items()} | {10**7: None, 10**7 + 1: ""}
    plain = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in toxicity.predict(plain, model).collect()}
    weight = dict(zip(model.features.tolist(), zip(model.weights.tolist(), model.telling.tolist(), strict=False), strict=False))

    def hashed(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        return int(common.piece_hashes(raw, np.array([0]), np.array([len(raw)]))[0])

    known: dict[str, tuple] = {}
    for k, t in texts.items():
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        score, telling = 0.0, False
        for w in set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)):
            if w not in known:
                known[w] = weight.get(hashed(w), (0.0, False))
            score, telling = score + known[w][0], telling or known[w][1]
        score += model.weights[-1] * telling
        p = [1 / (1 + math.exp(-(score - x))) for x in model.thresholds]
        r = got[k]
        assert abs(r.p_toxic - p[0]) < 1e-6 and abs(r.severity - sum(p)) < 1e-6 and r.grade == sum(x >= 0.5 for x in p)
    assert len(got) == len(texts) and any(r.grade for r in got.values())


def test_op9_a_chance_of_one_half_is_toxic(spark):
    tie = toxicity.Ordinal(np.zeros(0, np.uint64), np.zeros(1), np.array([0.0, 1.0]), np.zeros(0, bool))
    docs = spark.createDataFrame([(1, "any text", "en", "s", 8)], DOCS)
    assert toxicity.predict(docs, tie).head().grade == 1 and toxicity.without_toxic(docs, tie).count() == 0
