"""Paths between nodes, upserts, the judge's report and fixed columns on small tables."""

import itertools
import os
import random
import tempfile

from pyspark.sql import functions as F

from tracery.operators import evaluation, incremental, retrieval, runs


def plain_path(edges, a, b, depth):
    found = [(a,)]
    for hops in range(depth + 1):
        done = sorted(p for p in found if p[-1] == b)
        if done:
            return hops, list(done[0])
        found = [(*p, y) for p in found for x, y in edges if x == p[-1] and y not in p]
    return None


def test_shortest_paths_between_pairs(spark):
    rng = random.Random(12)
    nodes = [f"n{i:02d}" for i in range(14)]
    edges = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(26)}) + [("n00", "n00"), ("x", "y"), ("y", "x")]
    pairs = [(f"{a}{b}", a, b) for a, b in itertools.product([*nodes, "x", "gone"], [*nodes[:6], "y", "gone"])]
    e, p = spark.createDataFrame(edges * 2, "src string, dst string"), spark.createDataFrame(pairs, "pair string, src string, dst string")
    for depth in (0, 1, 4):
        want = {k: plain_path(set(edges), a, b, depth) for k, a, b in pairs}
        got = {r.pair: (r.hops, r.path) for r in incremental.path_between(e, p, depth).collect()}
        assert got == {k: v for k, v in want.items() if v is not None}
    assert incremental.path_between(e, p.limit(0), 2).count() == 0


def files_of(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_upsert_touches_only_the_folders_of_its_keys(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/cache"
    schema = "grp string, key int, hit long, body string"
    put = lambda rows: incremental.upsert(spark.createDataFrame(rows, schema), f"file://{root}", ["grp", "key"], ["hit"], 8)
    put([("a", i, 1, f"v{i}") for i in range(60)])
    before = files_of(root)
    assert len({os.path.dirname(f) for f in before}) == 8
    new = [("a", 3, 2, "new"), ("a", 3, 1, "older"), ("b", 3, 1, "other"), (None, None, 5, None)]
    put(new)
    after = files_of(root)
    changed = {os.path.dirname(f) for f in set(before) ^ set(after)}
    assert 0 < len(changed) <= 3 and all(after[f] == t for f, t in before.items() if os.path.dirname(f) not in changed)
    read = lambda: sorted(map(tuple, spark.read.parquet(f"file://{root}").drop("bucket").collect()), key=str)
    want = sorted([("a", i, 1, f"v{i}") for i in range(60) if i != 3] + [("a", 3, 2, "new"), ("b", 3, 1, "other"), (None, None, 5, None)], key=str)
    assert read() == want
    put(new)
    put([])
    assert read() == want


def test_judge_report_tells_nothing_of_what_no_row_tells(spark):
    schema = "judge_mode string, fallback_mode string, judge_outcome string, shadow_agreement string, judge_ms double, judge_candidates int, judge_selected int, judge_max_p double"
    rows = [("shadow", None, "ok", "exact", 10.0, 3, 0, None), ("shadow", None, "timeout", "disjoint", 30.0, 3, 2, None), (None, None, None, None, None, None, None, None), ("active", None, "ok", "x-escalated", 20.0, None, None, None)]
    got = {r.metric: r.value for r in runs.judge_report(spark.createDataFrame(rows, schema)).collect()}
    assert got["judge_mode.shadow"] == 2 and got["judge_outcome.ok"] == 2 and got["shadow_agreement.x-escalated"] == 1 and got["shadow_agreement_rate"] == 0.5
    assert (got["judge_ms.n"], got["judge_ms.mean"], got["judge_ms.p50"], got["judge_ms.p95"]) == (3, 20, 20, 30) and got["judge_selected.p50"] == 0
    assert not any(k.startswith(("fallback_mode", "judge_max_p")) for k in got)
    assert runs.judge_report(spark.createDataFrame(rows[2:3], schema)).count() == 0


def test_metrics_have_their_fixed_columns(spark):
    rows = spark.createDataFrame([("r", 1, 0.1234567, ["c1", "c2"], "extra"), ("r", 2, None, None, None)], "run_id string, pass int, cost_usd double, cited_candidate_ids array<string>, other string")
    root = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    runs.write_metrics_csv(rows, spark.createDataFrame([("m", 1.0)], "metric string, value double"), root)
    got = spark.read.option("header", True).csv(f"{root}/runs").orderBy("pass")
    assert got.columns == runs.METRICS_COLUMNS
    one, two = got.collect()
    assert (one.cost_usd, one.cited_candidate_ids, one.stage) == ("0.123457", "c1 c2", None) and (two.cost_usd, two["pass"]) == (None, "2")


def test_naive_search(spark):
    lines = spark.createDataFrame([("a", "Alpha beta"), ("a", "ALPHA"), ("b", "beta alpha"), ("c", None), ("d", "the alpha beta thing")], "path string, line string")
    queries = spark.createDataFrame([(1, " alpha  Beta "), (2, "beta beta"), (3, ""), (4, None), (5, "alpha beta")], "query_id int, text string")
    got = {(r.query_id, r.path): (r.n, r["rank"]) for r in evaluation.naive_search(lines, queries).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, "a"): (3, 1), (1, "b"): (2, 2), (1, "d"): (2, 3)}
    assert {k: v for k, v in got.items() if k[0] == 5} == {(5, "a"): (4, 1), (5, "b"): (2, 3), (5, "d"): (3, 2)}
    assert {k[1] for k in got if k[0] == 2} == {"a", "b", "d"} and not {k for k in got if k[0] in (3, 4)}
    assert evaluation.naive_search(lines, queries.where(F.lit(False))).count() == 0


def test_naive_search_counts_in_the_scan(spark, monkeypatch):
    """No line leaves the scan and no query's files lie in one task; more words than travel with the scan give the same rows."""
    lines = spark.createDataFrame([(f"f{i % 9}", w) for i in range(60) for w in ("The cat", "a CAT sat", None, f"x{i % 4} the")] + [(None, "cat")], "path string, line string").repartition(3)
    queries = spark.createDataFrame([(1, "the cat"), (2, "cat x1 cat"), (2, "cat"), (None, "a x3"), (4, None), (5, "nowhere")], "query_id long, text string")
    got = evaluation.naive_search(lines, queries)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan and "Window" in plan
    have = sorted(map(tuple, got.collect()), key=str)
    monkeypatch.setattr(retrieval, "MOST_PATTERNS", 1)
    assert sorted(map(tuple, evaluation.naive_search(lines, queries).collect()), key=str) == have and {r[0] for r in have} == {1, 2, None}
