"""Nearest neighbours, the filter audit and importance resampling against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tracery.llm import filter_audit, importance, neighbours

DOCS = "doc_id long, text string, source string, bits string, digest long, part string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_nearest(rows, is_query, k):
    ok = [(v, np.array(x)) for v, x in rows if v is not None and x and None not in x and np.isfinite(x).all() and np.any(x)]
    out = []
    for q, x in {(v, tuple(x)): (v, x) for v, x in ok if is_query(v)}.values():
        found = []
        for v, y in ok:
            if v != q and len(x) == len(y):
                total = 0.0
                for a, b in zip(x.tolist(), y.tolist(), strict=True):
                    total += (a - b) * (a - b)
                found.append((math.sqrt(total), v))
        out += [(q, i + 1, v, d) for i, (d, v) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_op11_edges_ties_and_repeats(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 5)).tolist()
    rows = [(i, base[i % 40]) for i in range(90)]
    rows += [(200, None), (201, []), (202, [0.0] * 5), (203, [1.0, None, 2.0, 0.0, 0.0]), (204, [1.0, float("nan"), 2.0, 0.0, 0.0]), (205, [float("inf")] + [0.0] * 4), (None, base[0])]
    rows += [(300, [1.0, 2.0]), (310, [1.0, 2.5]), (10, base[10]), (20, base[3]), (400, [1e-200] * 5), (410, [3e200] * 5), (420, [1e-320] * 5)]
    rows += [(500 + i, base[7]) for i in range(40)]
    df = spark.createDataFrame([(v, x, 1, "k") for v, x in rows], "vec_id long, embedding array<double>, block int, key string").repartition(4)
    monkeypatch.setattr(neighbours, "TILE", 8)
    monkeypatch.setattr(neighbours, "QUERIES", 4)
    for k in (1, 3, 30):
        got = neighbours.nearest(df, k, F.col("vec_id") % 10 == 0)
        assert sorted(tuple(r) for r in got.collect()) == plain_nearest(rows, lambda v: v % 10 == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert neighbours.nearest(df.limit(0), 3).count() == 0
    assert neighbours.nearest(df.where("vec_id = 300"), 3).count() == 0


def test_op11_wide_vectors_and_a_hot_one(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 1500))
    rows = [(i, x[i].tolist()) for i in range(60)] + [(100 + i, x[5].tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted(tuple(r) for r in neighbours.nearest(df, 4, F.col("vec_id") % 20 == 0).collect())
    assert got == plain_nearest(rows, lambda v: v % 20 == 0, 4)


def test_op11_bounds_hold_the_distance():
    rng = np.random.default_rng(5)
    for dim, size in ((1, 1.0), (3, 1e-3), (64, 1e6), (2100, 1.0)):
        q, x = rng.normal(size=(7, dim)) * size, rng.standard_cauchy(size=(9, dim)) * size
        a, b = neighbours.Codes(q), neighbours.Codes(x)
        dot = neighbours.code_products(a.codes, b.codes) * a.scale[:, None] * b.scale
        assert (np.abs(q @ x.T - dot) <= a.near[:, None] * b.off + a.off[:, None] * b.norm + 1e-9 * a.norm[:, None] * b.norm).all()
        assert (neighbours.code_products(a.codes, b.codes) == a.codes.astype(int) @ b.codes.astype(int).T).all()


def plain_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for d, t, source in docs:
        t = t or ""
        ws = WORD.findall(t)
        fails = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs)}
        rows.append((d, source or "", {k for k, v in fails.items() if v}))
    out = {}
    for part in {p for _, p, _ in rows}:
        mine = [(d, f) for d, p, f in rows if p == part]
        total = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [(d, x) for d, x in left if f in x]
                left = [(d, x) for d, x in left if f not in x]
                total[f] += len(gone)
                fails = sum(f in x for _, x in mine)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(x == {f} for _, x in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_op12_against_every_order_applied(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeABé") for _ in range(rng.randint(1, 4)))
    texts = [None, "", " \n", "one", "#", "A" * 30, "é " * 60] + [" ".join(word() for _ in range(rng.choice([3, 49, 50, 51, 120]))) + rng.choice(["", "", "|", "%"]) for _ in range(60)]
    docs = [(rng.randint(0, 400) * 10**12, rng.choice(texts), rng.choice([None, "", "a", "b", "hot", "hot", "hot"])) for _ in range(300)]
    docs += [(7, "same text", "hot")] * 50 + [(None, "same text", "b"), (None, None, "a"), (9, "same text", "lone"), (3, " ".join(f"w{i}" for i in range(80)), "clean")]
    docs += [(11, "tail " * 400_000 + "$", "long"), (12, "x" * 1_500_000, "long")]
    labels = [(d, rng.choice([0, 1]), rng.choice([0, 1])) for d in {d for d, _, _ in docs if d is not None}] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (10**9, 1, 1)]
    df = spark.createDataFrame([(d, t, s, "x", 1, "y") for d, t, s in docs], DOCS).repartition(5)
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    want = plain_audit(docs, labels)
    for heavy in (10_000, 20):
        monkeypatch.setattr(filter_audit, "HEAVY", heavy)
        got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.filter_audit(df, marks).collect()}
        assert got == want
    assert filter_audit.filter_audit(df.limit(0), marks).count() == 0
    assert filter_audit.filter_audit(df.where("doc_id = 3"), marks.limit(0)).where("removed + redundant + unique_fails + shapley <> 0 or kept <> 1").count() == 0


def test_op12_lists():
    rng = np.random.default_rng(7)
    for _ in range(200):
        lists = [np.unique(rng.integers(0, rng.integers(1, 60), rng.integers(0, 40))) for _ in range(4)]
        assert filter_audit.union(lists).tolist() == sorted(set().union(*map(set, map(np.ndarray.tolist, lists))))
        a, b = lists[:2]
        assert filter_audit.minus(a, b).tolist() == sorted(set(a.tolist()) - set(b.tolist()))


def features(text):
    ws = TERM.findall((text or "").translate(LOW))
    return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(ws) - k + 1)]


def plain_draw(docs, target):
    parts = [(d, *features(t)) for d, t in docs]
    s, t = collections.Counter(b for _, _, f in parts for b in f), collections.Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for d, n, f in parts:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = i + 1
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r[:5]) for r in rows), key=key)


def drawn(df, target):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in importance.resampled(df, target).collect()), key=key)


def test_op13_against_plain_counts(spark, monkeypatch):
    rng = random.Random(8)
    words = ["a", "the", "Größe", "日本", "x" * 63, "y" * 64, "z" * 200, "12", "ab9", "\x85q", "ÀB", "İI"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "-", "\n", "\x00", "'", "_", "{"]) for _ in range(n))
    docs = [(i, text(rng.choice([1, 2, 3, 19, 20, 21, 60]))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, " . "), (1003, "one"), (None, text(30)), (5, docs[5][1]), (6, text(40)), (1004, "w" * 1_300_000 + " tail"), (1005, text(250_000))]
    target = [text(30) for _ in range(8)] + [None, ""]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, score string, rank int").repartition(4)
    items = spark.createDataFrame([(1, t) for t in target], "doc_id long, text string")
    monkeypatch.setattr(importance, "STEP", 1000)
    want = plain_draw(docs, target)
    assert drawn(df, items) == want
    monkeypatch.setattr(importance, "dictionary_of", lambda docs: [b"the", b"12", "日本".encode()])
    assert drawn(df, items) == want
    monkeypatch.setattr(importance, "dictionary_of", lambda docs: [])
    assert drawn(df, items) == want
    assert drawn(df.limit(0), items) == [] and drawn(df.where("doc_id < 40"), items.limit(0)) == plain_draw([x for x in docs if x[0] is not None and x[0] < 40], [])


def test_op13_query_is_the_plain_draw(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = importance.op13_importance(spark, sf).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=lambda r: r[0]) == sorted(plain_draw(docs, target), key=lambda r: r[0])
