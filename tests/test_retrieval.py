"""Retrieval that loses nothing: what a leg finds in a repository and scope is what it finds when they stand alone."""

import pytest
from pyspark.sql import functions as F

from tracery.operators import retrieval
from tracery.operators import retrieve as job

FILES, SYMBOLS, LINES = "repo string, path string, content string", "repo string, path string, qualified_name string, line_start int, line_end int", "repo string, path string, line_no int, line string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("most", [100, 0])
def test_literals_by_smart_case_on_both_ways(spark, most):
    lines = spark.createDataFrame([("r", "a", 1, "see ΟΔΟΣΑ here"), ("r", "a", 2, "see οδοσα here"), ("r", "a", 3, "ΟΔΟΣ"), ("r", "a", 4, "οδος"), ("r", "b", 1, "İstanbul ISTANBUL"), ("r", "b", 2, "ǅ ab"), ("r", "b", 3, None), ("r", "b", 3, ""), ("r", "c", 1, "x"), ("r", "c", 1, "x")], LINES)
    patterns = spark.createDataFrame([(1, "ΟΔΟΣ"), (2, "οδος"), (3, "οδοσ"), (4, "İ"), (5, "i"), (6, "ab"), (7, "x"), (7, "x"), (8, ""), (9, None), (10, "Ab")], "query_id long, pattern string")
    got = [(r.query_id, r.path, r.line_no) for r in retrieval.substring_hits(lines, patterns, most).collect()]
    low, cased = lambda p: f"contains(lower(line), lower('{p}'))", lambda p: f"contains(line, '{p}')"
    plain = {1: cased("ΟΔΟΣ"), 2: low("οδος"), 3: low("οδοσ"), 4: cased("İ"), 5: low("i"), 6: low("ab"), 7: low("x"), 10: cased("Ab")}
    want = [(q, r.path, r.line_no) for q, test in plain.items() for r in lines.where(test).collect()]
    assert sorted(got) == sorted(want) and (1, "a", 1) in got


@pytest.mark.parametrize("most", [100, 0])
def test_literals_keep_to_their_repository_and_scope(spark, most):
    lines = spark.createDataFrame([(r, f"{d}/f", i, "find me Here") for r in ("r1", "r2", None) for d in ("a", "ab", "a/b") for i in (1, 2)], LINES).withColumns({"_low": F.lit("find"), "query_id": F.lit(9), "pattern": F.lit("p"), "scope": F.lit("z")})
    asked = spark.createDataFrame([("q1", "me", "r1", None, 0), ("q2", "me", "r2", "a", 1), ("q3", "Here", "r1", "./a/b/", 2), ("q4", "me", None, None, 0), ("q5", "me", "r1", "../a", 0)], "query_id string, pattern string, repo string, scope string, nth int")
    got = retrieval.substring_hits(lines.drop("scope"), asked, most)
    found = {(r.query_id, r.repo, r.path, r.nth) for r in got.collect()}
    assert found == {("q1", "r1", "a/f", 0), ("q1", "r1", "ab/f", 0), ("q1", "r1", "a/b/f", 0), ("q2", "r2", "a/f", 1), ("q2", "r2", "a/b/f", 1), ("q3", "r1", "a/b/f", 2), ("q5", "r1", "a/f", 0), ("q5", "r1", "ab/f", 0), ("q5", "r1", "a/b/f", 0)}
    assert got.count() == 18 and got.columns[:3] == ["query_id", "pattern", "nth"] and "_low" in got.columns


def test_scope_holds_before_the_limit(spark):
    files = spark.createDataFrame([("r", f"a/f{i:02d}.py", "needle_one\n") for i in range(30)] + [("r", "z/g.py", "needle_one\n")], FILES)
    symbols = spark.createDataFrame([("r", f"a/f{i:02d}.py", f"m.needle_one{i}", 1, 1) for i in range(30)] + [("r", "z/g.py", "m.needle_one", 1, 1)], SYMBOLS)
    queries = spark.createDataFrame([(1, "where is needle_one in g.py", "r", "z"), (2, "where is needle_one", "r", "z/"), (3, "needle_one", "r", "nowhere")], "query_id long, text string, repo string, scope string")
    patterns = job.patterns_of(queries)
    for leg in job.LEGS:
        found = {(r.query_id, r.path) for r in job.candidates_of(queries, patterns, files, symbols, (leg,)).collect()}
        assert found == ({(1, "z/g.py")} if leg == "file" else {(1, "z/g.py"), (2, "z/g.py")}), leg
    assert {r.path for r in job.retrieve(queries, files, symbols).ranked.collect()} == {"z/g.py"}


def test_other_repositories_change_nothing(spark):
    own = [("mine", "m/a.py", "def parseConfig():\n    pass\n"), ("mine", "m/b.py", "call parseConfig\n")]
    symbols = [("mine", "m/a.py", "core.parseConfig", 1, 2), ("mine", "m/b.py", "core.other_thing", 1, 1)]
    others = [(f"r{i}", f"o{i}/a.py", "parseConfig config parse\n" * 3) for i in range(40)]
    other_symbols = [(f"r{i}", f"o{i}/a.py", f"x{i}.parseConfig", 1, 3) for i in range(40)]
    queries = spark.createDataFrame([(7, "where does config parse", "mine"), (8, "parseConfig", "mine")], "query_id long, text string, repo string")
    alone = job.retrieve(queries, spark.createDataFrame(own, FILES), spark.createDataFrame(symbols, SYMBOLS))
    among = job.retrieve(queries, spark.createDataFrame(others + own, FILES), spark.createDataFrame(other_symbols + symbols, SYMBOLS))
    assert rows(alone.candidates) == rows(among.candidates) and rows(alone.ranked) == rows(among.ranked) and rows(alone.decisions) == rows(among.decisions)
    # the words of a camelCase name are found by themselves
    assert "core.parseConfig" in {r.symbol for r in alone.candidates.where("query_id = 7").collect()}


def test_bm25_ids_of_any_type_nulls_and_repeats(spark):
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, ""), (4, None)], "query_id int, text string")
    texts = [("a", "alpha alpha x"), ("b", "beta"), ("c", None), ("d", ""), (None, "alpha"), ("e", "x"), ("e", "alpha x x")]
    by_text = spark.createDataFrame(texts, "doc_id string, text string")
    got = retrieval.bm25(by_text, queries, 2)
    assert [(r.query_id, r.doc_id, r["rank"]) for r in got.orderBy("query_id", "rank").collect()] == [(1, "b", 1), (1, "a", 2)]
    number = F.create_map(*(F.lit(x) for i, c in enumerate("abcde") for x in (c, i)))[F.col("doc_id")]
    by_number = retrieval.bm25(by_text.withColumn("doc_id", number), queries, 2)
    assert [(r.doc_id, r.score) for r in by_number.orderBy("rank").collect()] == [("abcde".index(r.doc_id), r.score) for r in got.orderBy("rank").collect()]
    joined = spark.createDataFrame([("e", "x alpha x x"), *texts[:4]], "doc_id string, text string")
    assert rows(retrieval.bm25(by_text, queries, 9)) == rows(retrieval.bm25(joined, queries, 9))


def test_files_are_limited_for_each_token(spark):
    files = spark.createDataFrame([("r", f"d/f{i:02d}", "") for i in range(30)] + [("r", f"e/g{i}", "") for i in range(3)] + [("s", f"a/{i:02d}", "") for i in range(30)], FILES)
    tokens = spark.createDataFrame([(1, "f", 0), (1, "g", 1), (2, "", 0), (3, "g", 0), (3, "f", 1)], "query_id long, token string, nth int")
    within = spark.createDataFrame([(1, "r"), (2, "r"), (3, "r")], "query_id long, repo string")
    got = {q: [r.path for r in retrieval.file_leg(files, tokens, within).where(f"query_id = {q}").orderBy("raw_seq").collect()] for q in (1, 2, 3)}
    fs, gs = [f"d/f{i:02d}" for i in range(20)], [f"e/g{i}" for i in range(3)]
    assert got == {1: fs + gs, 2: fs, 3: gs + fs}
    scoped = spark.createDataFrame([(2, "r", "e"), (1, "s", "a"), (3, "r", "d/f")], "query_id long, repo string, scope string")
    assert {(r.query_id, r.path) for r in retrieval.file_leg(files, tokens, scoped).collect()} == {(2, p) for p in gs}
    assert [r.path for r in retrieval.file_leg(files, tokens.where("token = ''")).orderBy("raw_seq").collect()] == [f"a/{i:02d}" for i in range(20)]


def test_tokens_keep_their_order_within_a_leg(spark):
    files = spark.createDataFrame([("r", "a.py", "zeta_one\n"), ("r", "b.py", "alpha_two\n")], FILES)
    symbols = spark.createDataFrame([("r", "b.py", "alpha_two", 1, 1), ("r", "a.py", "zeta_one", 1, 1)], SYMBOLS)
    queries = spark.createDataFrame([(1, "alpha_two zeta_one"), (2, "zeta_one alpha_two")], "query_id long, text string")
    found = job.candidates_of(queries, job.patterns_of(queries), files, symbols, ("symbol",))
    assert [(r.query_id, r.symbol) for r in found.orderBy("query_id", "raw_seq").collect()] == [(1, "alpha_two"), (1, "zeta_one"), (2, "zeta_one"), (2, "alpha_two")]


def _nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_scores_documents_where_they_are(spark, monkeypatch):
    """Pairs of query and document are summed in the task that holds the document: only a task's best are shuffled; more terms than are sent to all give the same rows."""
    texts = spark.createDataFrame([(i, "the " * (1 + i % 3) + f"w{i % 7} v{i % 5}") for i in range(200)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, f"the w{q} v{q % 5}") for q in range(7)], "query_id long, text string")
    sent = retrieval.bm25(texts, queries, 5)
    plan = _nodes(sent)
    assert plan.count("hashpartitioning(query_id") == 1 and plan.index("WindowGroupLimit") < plan.index("hashpartitioning(query_id") < plan.rindex("WindowGroupLimit") < plan.index("HashAggregate")
    assert "BroadcastHashJoin [term" in plan
    want = rows(sent)
    monkeypatch.setattr(retrieval, "MOST_TERMS", 3)
    assert rows(retrieval.bm25(texts, queries, 5)) == want and len(want) == 35


def test_bm25_makes_tasks_for_the_pairs_that_meet(spark, monkeypatch):
    """Not for all documents times all queries: a repository's queries meet its own documents alone, and of these the ones that hold a term."""
    import re

    texts = spark.createDataFrame([(f"r{i % 20}", i, f"w{i % 40} all" if i < 20 else f"w{i % 40}") for i in range(400)], "repo string, doc_id long, text string")
    queries = spark.createDataFrame([(q, f"r{q % 20}", f"w{q % 40} all") for q in range(200)], "query_id long, repo string, text string")
    want = rows(retrieval.bm25(texts, queries, 5))
    monkeypatch.setattr(retrieval, "PAIRS", 100)
    monkeypatch.setattr(retrieval, "SHARED", 100, raising=False)
    found = retrieval.bm25(texts, queries, 5)
    # 400 x 200 pairs would be 800 tasks; ten documents of a repository hold a query's word, one holds all
    met = 200 * (10 + 1)
    tasks = int(re.search(r"RepartitionByExpression \[doc_id[^\n]*?\], (\d+)", found._jdf.queryExecution().optimizedPlan().toString())[1])
    assert tasks == met // 100 and rows(found) == want and len(want) == 1000


@pytest.mark.parametrize("single", [False, True])
def test_bm25_of_one_row_a_document(spark, single):
    texts = spark.createDataFrame([("r", 1, "a b b"), ("r", 2, "a c"), ("s", 1, "b"), ("s", 3, None), ("s", 4, "")], "repo string, doc_id long, text string")
    queries = spark.createDataFrame([(1, "r", "a b"), (2, "s", "b c")], "query_id long, repo string, text string")
    got = [(r.query_id, r.doc_id, r["rank"]) for r in retrieval.bm25(texts, queries, 5, single=single).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 1)]


def test_bodies_are_found_by_their_lines(spark):
    """As in the text of each body: nested ones, long ones, equal symbols, files of one path, and patterns across line ends."""
    import random

    rng = random.Random(9)
    text = lambda n: "\n".join(rng.choice(["", "ab", "Cd", "xÄy", "é"]) + rng.choice(["", "ab", "q"]) + rng.choice(["", "\r"]) for _ in range(n))
    files = [("r", "a", text(150)), ("r", "a", text(20)), ("s", "a", text(90)), ("s", "b/c", None), ("s", "d", "")]
    spans = [("r", "a", f"n{i}", s := rng.randint(1, 160), s + rng.choice([-2, 0, 1, 5, 40, 130])) for i in range(60)] + [("s", "a", "all", 1, 90), ("s", "a", "all", 1, 90), ("s", "d", "d", 1, 1), ("s", "b/c", "n", 1, 2)]
    asked = [(q, w, "rs"[q % 2]) for q in range(4) for w in ("ab", "Cd", "äy", "Äy", "q\r\n", "b\nC", "é", "", "none")]
    hit = lambda p, t: p in t if any(c.isupper() for c in p) else p in t.lower()
    body = lambda t, a, b: "\n".join(t.split("\n")[a - 1 : max(a, b)])
    want = []
    for q, w, repo in asked:
        found = sorted((a, name, b) for r, p, t in files for r2, p2, name, a, b in spans if (r, p) == (r2, p2) and r == repo and t is not None and w and hit(w, body(t, a, b)))
        want += [(q, *x) for x in found[:20]]
    leg = retrieval.body_leg(spark.createDataFrame(spans, SYMBOLS), spark.createDataFrame(files, FILES), spark.createDataFrame([x[:2] for x in asked], "query_id int, pattern string"), spark.createDataFrame([(q, "rs"[q % 2]) for q in range(4)], "query_id int, repo string"))
    assert sorted((r.query_id, r.line_start, r.symbol, r.line_end) for r in leg.collect()) == sorted(want) and want


def test_no_text_is_shuffled_to_search_bodies(spark):
    files = spark.createDataFrame([("r", "a", "one\ntwo")], FILES)
    symbols = spark.createDataFrame([("r", "a", "m::two", 1, 2)], SYMBOLS)
    leg = retrieval.body_leg(symbols, files, spark.createDataFrame([(1, "two")], "query_id int, pattern string"))
    plan = _nodes(leg)
    assert "MapInArrow" in plan and "array_join" not in plan and "split(content" not in plan[: plan.index("MapInArrow")]
    assert [r.symbol for r in leg.collect()] == ["m::two"]


def test_rows_among_few_and_many_keys(spark, monkeypatch):
    some = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "path string, n int")
    asked = spark.createDataFrame([("b",), ("b",), ("c",), (None,)], "path string")
    sent = retrieval.among(some, asked, ["path"])
    assert "BroadcastHashJoin" in _nodes(sent) and sorted(map(tuple, sent.collect())) == [("b", 2), ("b", 3)]
    monkeypatch.setattr(retrieval, "MOST_KEYS", 1)
    assert rows(retrieval.among(some, asked, ["path"])) == rows(sent)
