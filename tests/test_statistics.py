"""Statistics against plain computations on small tables, nulls, ties and hot groups included."""

import collections
import hashlib
import itertools
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tracery.operators import calibration, ranges, statistics


def near(a, b, off=1e-9):
    return a is b is None or a is not None and b is not None and abs(a - b) <= off * max(1, abs(b))


def plain_weights(cluster, n):
    digits = [hashlib.md5(f"{cluster}|{b}".encode()).hexdigest() for b in range(n // 5 + 1)]
    us = [int(digits[r // 5][r % 5 * 6 : r % 5 * 6 + 6], 16) / 2**24 for r in range(n)]
    return [sum(x <= u for x in statistics.POISSON) for u in us]


def test_poisson_weights(spark):
    rows = spark.createDataFrame([(i,) for i in range(400)], "c long")
    got = {r.c: r.w for r in rows.select("c", statistics.poisson_weights(F.col("c"), 23).alias("w")).collect()}
    assert all(w == plain_weights(c, 23) for c, w in got.items())
    each = collections.Counter(x for w in got.values() for x in w)
    total = sum(each.values())
    assert all(abs(each[k] / total - math.exp(-1) / math.factorial(k)) < 0.02 for k in range(4))


def test_bootstrap_against_a_plain_one(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice(["u1", "u2", "u3", None, *[f"v{i}" for i in range(20)]]), rng.choice([None, 0.0, 1.0, 2.5])) for g in ("a", "b") for _ in range(200)]
    rows += [("one", "u1", 3.0), ("none", "u1", None)]
    got = {r.g: r for r in statistics.bootstrap(spark.createDataFrame(rows, "g string, c string, v double"), ["g"], "c", "v", 50).collect()}
    assert set(got) == {"a", "b", "one"}
    for g, r in got.items():
        sums, counts = collections.Counter(), collections.Counter()
        for k, c, v in rows:
            if k == g and v is not None:
                sums[c or ""] += v
                counts[c or ""] += 1
        w = {c: plain_weights(c, 50) for c in counts}
        means = sorted(sum(w[c][i] * sums[c] for c in counts) / n for i in range(50) if (n := sum(w[c][i] * counts[c] for c in counts)))
        assert r.n == sum(counts.values()) and r.clusters == len(counts) and near(r["mean"], sum(sums.values()) / r.n)
        assert near(r.low, means[math.ceil(0.025 * len(means)) - 1]) and near(r.high, means[math.ceil(round(0.975 * len(means), 9)) - 1])
    assert statistics.bootstrap(spark.createDataFrame([], "g string, c string, v double"), ["g"], "c", "v", 5).count() == 0


def test_bootstrap_sends_one_row_a_group(spark):
    plan = statistics.bootstrap(spark.createDataFrame([("a", "b", 1.0)], "g string, c string, v double"), ["g"], "c", "v", 20)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "collect_list" not in plan


@pytest.mark.parametrize(("b", "c"), [(0, 0), (1, 0), (0, 9), (5, 5), (3, 11), (19, 20), (60, 40), (500, 420), (5200, 4800), (10_000, 10_000), (30_000, 29_000)])
def test_mcnemar_is_the_exact_binomial(spark, b, c):
    n, k = b + c, min(b, c)
    term = total = 1 if n == 0 else None
    if n:
        term, total = 1, 0
        for i in range(k + 1):
            total += term
            term = term * (n - i) // (i + 1)
    want = min(1.0, float(Fraction(2 * total, 2**n))) if n else 1.0
    got = spark.range(1).select(statistics.mcnemar_p(F.lit(b).cast("long"), F.lit(c).cast("long")).alias("p")).head().p
    assert near(got, want, 1e-9) and (want == 0 or abs(got / want - 1) < 1e-8)


def test_mcnemar_of_huge_counts(spark):
    rows = spark.createDataFrame([(10**9, 10**9 + 200_000), (10**9, 10**9)], "b long, c long")
    got = [r.p for r in rows.select(statistics.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()]
    z = (200_000 - 1) / math.sqrt(2 * 10**9 + 200_000)
    assert abs(got[0] / math.erfc(z / math.sqrt(2)) - 1) < 1e-3 and got[1] == 1.0


def test_mcnemar_tables_and_nulls(spark):
    rows = [("x", True, False)] * 3 + [("x", True, True)] * 2 + [("x", False, None), ("x", None, True), ("x", False, False), ("y", True, True), ("z", None, None)]
    got = {r.g: r for r in statistics.mcnemar(spark.createDataFrame(rows, "g string, a boolean, b boolean"), ["g"]).collect()}
    assert set(got) == {"x", "y"} and (got["x"].n, got["x"].both, got["x"].only_a, got["x"].only_b, got["x"].neither) == (6, 2, 3, 0, 1)
    assert near(got["x"].p, 0.25) and near(got["x"].difference, 0.5) and got["y"].p == 1.0


def test_paired_takes_the_mean_of_passes(spark):
    a = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (4, None)], "q int, ok int")
    b = spark.createDataFrame([(1, 1), (2, 0), (2, None), (4, 1)], "q int, ok int")
    assert {tuple(r) for r in statistics.paired(a, b, ["q"], "ok").collect()} == {(1, 0.5, 1.0), (2, 1.0, 0.0)}


GRADES = "rubric string, row_id long, finding_idx int, grade int"


def test_kappa_margins_single_class_and_unpaired(spark):
    a = [("s", i, None, g) for i, g in enumerate([0, 0, 1, 2, 2, 1, 0])] + [("one", i, 0, 1) for i in range(4)] + [("s", 50, 0, 1), ("lone", 1, None, 1), ("s", 60, None, 2), ("s", 60, None, 1)]
    b = [("s", i, None, g) for i, g in enumerate([0, 1, 1, 2, 0, 1, 0])] + [("one", i, 0, 1) for i in range(4)] + [("s", 51, 0, 1), ("s", 60, None, 1)]
    x, y = spark.createDataFrame(a, GRADES), spark.createDataFrame(b, GRADES)
    got = {r.rubric: r for r in statistics.kappa(x, y).collect()}
    pairs = [(0, 0), (0, 1), (1, 1), (2, 2), (2, 0), (1, 1), (0, 0), (1, 1)]
    po = sum(p == q for p, q in pairs) / 8
    pe = sum(sum(p == g for p, _ in pairs) * sum(q == g for _, q in pairs) for g in range(3)) / 64
    assert (got["s"].n, got["s"].unpaired) == (8, 2) and near(got["s"].kappa, (po - pe) / (1 - pe))
    assert got["one"].kappa is None and got["one"].agreement == 1.0 and got["lone"].n == 0 and got["lone"].kappa is None
    assert {tuple(r) for r in statistics.adjudication(x, y).collect()} == {("s", 1, None, 0, 1), ("s", 4, None, 2, 0)}
    done = {(r.rubric, r.row_id, r.finding_idx): r.grade for r in statistics.adjudicated(x, y, spark.createDataFrame([("s", 1, None, 7)], GRADES)).collect()}
    assert done["s", 1, None] == 7 and done["s", 4, None] is None and done["s", 50, 0] == 1 and done["s", 51, 0] == 1 and done["s", 2, None] == 1


def test_ranking_quality(spark):
    runs = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 12), (5, 10)], "run_id int, query_id int")
    targets = spark.createDataFrame([(10, "primary", "a", 5, 9), (10, "primary", "a", 5, 9), (10, "equivalent", "b", None, None), (10, "equivalent", "c", 1, None), (10, "distractor", "d", None, None), (12, "distractor", "d", 1, 2)], "query_id int, role string, path string, span_start int, span_end int")
    found = [(1, 1, "./b", 3, 4), (1, 2, "a", 9, 9), (1, 3, "a", 5, 5), (1, 4, "c", 1, 1), (2, 1, "d", None, None), (2, 2, "a", None, None), (2, 2, "c", 9, 9), (3, 1, "a", 5, 9), (4, 1, "d", 1, 2)]
    got = {r.run_id: r for r in statistics.ranking_quality(runs, spark.createDataFrame(found, "run_id int, pos int, path string, line_start int, line_end int"), targets).collect()}
    ideal = 3 / math.log2(2) + 1 / math.log2(3) + 1 / math.log2(4)
    # the second finding in the same target earns nothing
    assert near(got[1].ndcg, (1 + 3 / math.log2(3)) / ideal) and near(got[1].precision, 2 / 3) and got[1].n_targets == 3
    assert near(got[2].ndcg, 3 / math.log2(3) / ideal) and near(got[2].precision, 1 / 3)
    assert got[3].ndcg is None and got[3].n_targets == 0 and got[4].ndcg is None and got[5].ndcg == 0 and got[5].precision == 0


def test_pass_variance(spark):
    runs = spark.createDataFrame([(1, "q", 1, "verify"), (2, "q", 2, "verify"), (3, "q", 3, "cache"), (4, "e", 1, None), (5, "e", 2, None), (6, "l", 3, "x"), (7, "q", 9, "far")], "run_id int, query_id string, pass int, stage string")
    found = [(1, 1, "a", 1, 2), (1, 2, "b", 1, 1), (2, 1, "./a", 1, 2), (2, 2, "b", 1, 1), (2, 3, "b", 1, 1), (3, 1, "b", 1, 1), (7, 1, "z", 1, 1)]
    got = {r.query_id: tuple(r)[1:] for r in statistics.pass_variance(runs, spark.createDataFrame(found, "run_id int, pos int, path string, line_start int, line_end int"), [1, 2, 3]).collect()}
    assert got["q"][:2] == (3, 2) and near(got["q"][2], (1 + 0.5 + 0.5) / 3) and near(got["q"][3], 1 / 3)
    assert got["e"] == (2, 0, 1.0, 1.0) and got["l"] == (1, 0, None, None)


def test_quantiles_of_hot_and_tied_groups(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([1, 2, 3])) for _ in range(3000)] + [("wide", rng.randint(0, 10**6)) for _ in range(500)] + [(None, 5), (None, 7), ("none", None), ("two", 1), ("two", None), ("two", 9)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(6)
    asked = {"p00": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0, "over": 1.5, "upper": lambda n: F.floor(n / 2) + 1}
    got = {r.g: r for r in ranges.quantiles(df, ["g"], "v", asked, F.count("*").alias("rows")).collect()}
    for g in {g for g, _ in rows}:
        vs = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g].n == len(vs) and got[g].rows == sum(k == g for k, _ in rows)
        for name, q in asked.items():
            k = len(vs) // 2 + 1 if name == "upper" else math.ceil(q * len(vs))
            assert got[g][name] == (vs[min(max(k, 1), len(vs)) - 1] if vs else None)
    assert ranges.quantiles(df, [], "v", {"p50": 0.5}).head().p50 == sorted(v for _, v in rows if v is not None)[math.ceil(0.5 * sum(v is not None for _, v in rows)) - 1]
    assert ranges.quantiles(df.limit(0), ["g"], "v", {"p50": 0.5}).count() == 0


def test_numbering_and_auroc_by_range(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.random() // 0.01, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, x double, i int")
    got = ranges.numbered(df, [F.desc("x"), "i"], "n").collect()
    assert [r.i for r in sorted(got, key=lambda r: r.n)] == [i for _, _, i in sorted(rows, key=lambda r: (-r[1], r[2]))] and {r.n for r in got} == set(range(1, 2001))
    by = ranges.numbered(df, ["x", "i"], "n", ["g"]).collect()
    for g in ("a", "b", None):
        assert [r.i for r in sorted((r for r in by if r.g == g), key=lambda r: r.n)] == [i for k, _, i in sorted(rows, key=lambda r: (r[1], r[2])) if k == g]
    scored = spark.createDataFrame([(g, rng.choice([0.1, 0.5, rng.random()]), rng.randint(0, 1)) for g in "aab" for _ in range(150)], "k string, p double, positive int")
    plain = lambda ps: sum((x > y) + (x == y) / 2 for x, a in ps if a for y, b in ps if not b) / (sum(a for _, a in ps) * sum(1 - b for _, b in ps))
    all_ = scored.collect()
    assert {r.k: round(r.auroc, 9) for r in calibration.auroc(scored, "k").collect()} == {k: round(plain([(r.p, r.positive) for r in all_ if r.k == k]), 9) for k in "ab"}
    assert near(calibration.auroc(scored).head().auroc, plain([(r.p, r.positive) for r in all_]))
    assert calibration.auroc(scored.where("positive = 1")).head().auroc is None


def test_blind_export(spark):
    rows = spark.createDataFrame([(i, f"q{i % 3}", "arm" if i % 2 else "base") for i in range(60)], "run_id int, query string, arm string")
    blind, key = statistics.blind_export(rows, ["query"], ["run_id", "arm"], "1")
    a, b = blind.collect(), {r.row_id: r for r in key.collect()}
    assert blind.columns == ["row_id", "query"] and {r.row_id for r in a} == set(b) == set(range(1, 61))
    assert all(r.query == f"q{b[r.row_id].run_id % 3}" for r in a)
    again = {r.row_id: r.run_id for r in statistics.blind_export(rows.repartition(5), ["query"], ["run_id", "arm"], "1")[1].collect()}
    other = {r.row_id: r.run_id for r in statistics.blind_export(rows, ["query"], ["run_id", "arm"], "2")[1].collect()}
    assert again == {k: r.run_id for k, r in b.items()} != other


@pytest.mark.parametrize("name", ["ranking_quality", "pass_variance"])
def test_no_run_table_goes_through_the_driver(spark, sf, name):
    """Neither runs nor their findings and targets, which small files hold many of."""
    from tracery.plans.queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
