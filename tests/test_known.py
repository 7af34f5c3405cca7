"""Known answers on small inputs."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracery.functions import text as fn
from tracery.operators import calibration, evaluation, incremental, labels, ranking, retrieval
from tracery.sources import corpus

CANDIDATE = "query_id string, raw_seq long, path string, line_start int, line_end int, symbol string, kind string, snippet string"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).head().y


def test_patterns(spark):
    got = one(spark, "where does `merge_and_rank` call Session.request in src/search.rs:120:5 'it isn't' the HTTPServer", fn.derive_patterns)
    assert got.literals == ["merge_and_rank", "it isn't"]
    assert got.path_tokens == ["Session.request", "src/search.rs"]
    assert "HTTPServer" in got.identifiers and "http_server" in got.identifiers
    assert "where" not in got.identifiers and got.identifiers[: got.n_original] == ["call", "Session", "request", "search", "HTTPServer"]
    got = one(spark, "where is Session::request in src/my_search.rs", fn.derive_patterns)
    assert got.identifiers == ["Session", "request", "my_search", "mySearch"] and got.n_original == 3 and got.path_tokens == ["src/my_search.rs"]
    assert one(spark, "", fn.derive_patterns).grep_patterns == []


def test_leg_identifiers_keep_variants_with_their_originals(spark):
    p = spark.createDataFrame([("find_one getTwo three four five_six",)], "x string").select(fn.derive_patterns(F.col("x")).alias("p"))
    got = p.select(fn.leg_identifiers(F.col("p"), F.lit(2)).alias("y")).head().y
    assert got == ["find_one", "getTwo", "findOne", "get_two"]


def test_names_scopes_and_keys(spark):
    assert [one(spark, x, fn.short_name) for x in ("a::b.c", "a/b#c$", "...", "x")] == ["c", "c", "...", "x"]
    assert [one(spark, x, fn.is_strong_identifier) for x in ("Wilson", "HTTPBasicAuth", "merge_and_rank", "gemini3", "plain")] == [False, True, True, True, False]
    assert [one(spark, x, fn.scope_escapes) for x in ("/etc", "../x", "a/../../x", "a/../x", "src")] == [True, True, True, False, False]
    assert [one(spark, x, lambda s: fn.in_scope(F.lit("src/a.rs"), s)) for x in ("src", "./src/", "sr", "", None, "/src", "src/a.rs")] == [True, True, False, True, True, True, True]
    assert one(spark, " Where IS ", lambda t: fn.cache_key(t, F.lit("../up"))) == "8:where is0:"
    assert one(spark, "a.b(c)", fn.escape_regex) == r"a\.b\(c\)"
    assert one(spark, "ab\ncdef\ng", lambda x: fn.cap_lines(x, 2, 3)) == "ab\ncde" and one(spark, "abcd", lambda x: fn.cap_snippet(x, 3)) == "abc…"


@pytest.mark.parametrize(("name", "want"), [("HTTPServer", ["http", "server"]), ("snake_case-x", ["snake", "case", "x"]), ("parseURL2Path", ["parse", "url2path"]), ("", []), ("fooBar", ["foo", "bar"])])
def test_words(spark, name, want):
    assert one(spark, name, fn.words) == want


def test_case_variant(spark):
    assert [one(spark, x, fn.case_variant) for x in ("merge_and_rank", "mergeAndRank", "plain")] == ["mergeAndRank", "merge_and_rank", None]


def test_urls_and_keys(spark):
    assert one(spark, "HTTPS://Host/A.git/", fn.normalize_url) == "https://host/a"
    assert one(spark, "ab", lambda c: fn.length_prefixed(c, c)) == "2:ab2:ab"
    assert one(spark, "abcde", fn.estimate_tokens) == 2


def ranked(spark, rows, keys=(), k=12):
    c = spark.createDataFrame(rows, CANDIDATE)
    kk = spark.createDataFrame([("q", list(keys), list(keys))], "query_id string, keys array<string>, strong array<string>")
    return ranking.merge_and_rank(c, kk, k)


def decided(spark, rows, text, keys=("sessionrun",)):
    """The route of one query with these candidates."""
    c = spark.createDataFrame(rows, CANDIDATE)
    p = spark.createDataFrame([("q", text), ("none", "other words")], "query_id string, text string")
    patterns = p.select("query_id", fn.derive_patterns(F.col("text")).alias("p"))
    got = ranked(spark, rows, list(keys))
    rows = ranking.route(ranking.confidence(got, p, ranking.trusted_symbols(c, got, patterns))).collect()
    return {r.query_id: r for r in rows}


def test_lone_exact_symbol(spark):
    rows = [("q", 1, "a.rs", 3, 9, "session_run", "SymbolExact", None)]
    assert ranked(spark, rows, ["sessionrun"]).head().score == 730
    got = decided(spark, rows, "where is session_run")
    assert (got["q"].confidence, got["q"].route, got["q"].unique_trusted) == (100, "confidence", True)
    assert (got["none"].confidence, got["none"].route) == (0, "fallback")


def test_symbols_that_are_not_trusted(spark):
    rows = [("q", 1, "a.rs", 3, 9, "server", "SymbolExact", None)]
    # a plain word in a long query, a name that is only part of a path, an unknown place
    assert decided(spark, rows, "why does the server answer slowly under load", ["server"])["q"].has_exact is False
    assert decided(spark, [("q", 1, "a.rs", 3, 9, "verify", "SymbolExact", None)], "src/verify.rs:35 constant", ["verify"])["q"].has_exact is False
    assert decided(spark, rows, "explain server", ["server"])["q"].has_exact is True
    lost = decided(spark, [("q", 1, "a.rs", 0, 0, "session_run", "SymbolExact", None)], "where is session_run")["q"]
    assert lost.has_exact and not lost.unique_trusted


def test_distinct_trusted_symbols_count_qualified_names(spark):
    text = "who calls session_run"
    patterns = spark.createDataFrame([("q", text)], "query_id string, text string").select("query_id", fn.derive_patterns(F.col("text")).alias("p"))
    count = lambda names: ranking.trusted_symbols(c := spark.createDataFrame([("q", i, f"{i}.rs", 3, 9, n, "SymbolExact", None) for i, n in enumerate(names)], CANDIDATE), c, patterns).head().distinct_trusted
    assert [count(x) for x in (["session_run"], ["A::session_run", "session_run"], ["A::session_run", "B::session_run", "session_run"])] == [1, 1, 2]


def test_two_equal_exact_symbols_are_verified(spark):
    got = decided(spark, [("q", i, f"{i}.rs", 3, 9, "session_run", "SymbolExact", None) for i in (1, 2)], "where is session_run")["q"]
    assert (got.confidence, got.route) == (73, "verify")


def test_early_exit_is_taken_back_without_its_candidate(spark):
    routes = spark.createDataFrame([("a", "confidence"), ("b", "unique-symbol"), ("c", "verify")], "query_id string, route string")
    place = spark.createDataFrame([("a", "p", 1), ("b", "p", 1)], "query_id string, path string, line_start int")
    got = ranking.reauthorised(routes, place, place.where("query_id = 'a'")).collect()
    assert {r.query_id: r.route for r in got} == {"a": "confidence", "b": "verify", "c": "verify"}


def test_candidates_without_keys_and_with_repeated_ones(spark):
    c = spark.createDataFrame([("q", 1, "a", 1, 2, None, "ContentHit", "x foo"), ("lost", 1, "a", 1, 2, None, "ContentHit", "x")], CANDIDATE)
    keys = spark.createDataFrame([("q", ["foo0"], []), ("q", ["x foo"], [])], "query_id string, keys array<string>, strong array<string>")
    assert {r.query_id: r.score for r in ranking.merge_and_rank(c, keys).collect()} == {"q": 180, "lost": 150}


def test_findings_and_responses(spark):
    rows = [("q", 1, "a.rs", 3, 9, "f", "SymbolExact", None), ("q", 2, "b.rs", 0, 0, None, "ContentHit", "code")]
    found = ranking.findings(ranked(spark, rows))
    assert {r.note for r in found.collect()} == {"exact symbol match: `f`", "text match"}
    import json

    got = json.loads(ranking.response(found).head().response)["findings"]
    assert got == [{"location": {"path": "a.rs", "line_start": 3, "line_end": 9}, "note": "exact symbol match: `f`", "symbol": "f"}, {"location": {"path": "b.rs"}, "snippet": "code", "note": "text match"}]
    twice = found.unionByName(found.withColumn("rank", F.col("rank") + 5))
    assert sorted(r["rank"] for r in ranking.first_findings(twice, 9).collect()) == [1, 2] and ranking.first_findings(twice, 1).count() == 1


def test_overlaps_merge_and_unknown_places_do_not(spark):
    got = ranked(spark, [("q", 1, "a", 1, 5, None, "ContentHit", "x"), ("q", 2, "a", 5, 8, "s", "SymbolFuzzy", None), ("q", 3, "a", 9, 9, None, "ContentHit", "y"), ("q", 4, "a", 0, 0, None, "ContentHit", "z"), ("q", 5, "a", 0, 0, None, "ContentHit", "w")])
    assert sorted((r.line_start, r.line_end, r.kind) for r in got.collect()) == [(0, 0, "ContentHit"), (0, 0, "ContentHit"), (1, 8, "SymbolFuzzy"), (9, 9, "ContentHit")]


def test_three_of_a_file_first_then_backfill(spark):
    rows = [("q", i, "a", 10 * i, 10 * i, None, "SymbolFuzzy", None) for i in range(1, 7)] + [("q", 9, "b", 1, 1, None, "ContentHit", "x")]
    assert sorted(r.path for r in ranked(spark, rows, k=4).collect()) == ["a", "a", "a", "b"]
    assert sorted(r.path for r in ranked(spark, rows, k=5).collect()) == ["a", "a", "a", "a", "b"]


def test_islands_against_a_sweep(spark):
    rng = random.Random(1)
    rows = [("q", i, "p", s := rng.randint(1, 200), s + rng.randint(0, 9), None, "ContentHit", "x") for i in range(60)]
    spans, last = [], None
    for s, e in sorted((r[3], r[4]) for r in rows):
        if last and s <= last[1]:
            last[1] = max(last[1], e)
        else:
            last = [s, e]
            spans.append(last)
    got = ranking.islands(spark.createDataFrame(rows, CANDIDATE)).groupBy("island").agg(F.min("line_start"), F.max("line_end"))
    assert sorted((r[1], r[2]) for r in got.collect()) == sorted(map(tuple, spans))


def scored(spark, rows):
    return spark.createDataFrame(rows, "query_id string, rank int, positive int, p double")


def test_auroc(spark):
    auroc = lambda ps: calibration.auroc(scored(spark, [("q", i, y, p) for i, (y, p) in enumerate(ps)])).head()[0]
    assert auroc([(1, 0.9), (0, 0.1)]) == 1 and auroc([(1, 0.1), (0, 0.9)]) == 0
    assert auroc([(1, 0.5), (0, 0.5)]) == 0.5 and auroc([(1, 0.5), (1, 0.6)]) is None


def test_thresholds_and_top1(spark):
    assert calibration.pick_threshold(scored(spark, [("q", 1, 1, 0.31), ("q", 2, 0, 0.1)])).head().tau == 30
    assert calibration.pick_threshold(scored(spark, [("q", 1, 0, 0.95)])).head().tau == 90
    tie = scored(spark, [("q", 1, 0, 0.5), ("q", 2, 1, 0.5)])
    assert calibration.query_top1(tie).head().top1 == 0
    none = calibration.none_rate(scored(spark, [("a", 1, 0, 0.2), ("b", 1, 0, 0.9)]), 0.5).head()
    assert none.none_rate == 0.5


def test_scorer_needs_an_answer_each(spark):
    states = spark.createDataFrame([("a",), ("bb",)], "state string")
    got = calibration.score_states(states, lambda: (lambda xs: [len(x) / 10 for x in xs]))
    assert sorted(r.p for r in got.collect()) == [0.1, 0.2]


def test_labels(spark):
    c = spark.createDataFrame([("q", i, "p", 10 * i, 10 * i + 5) for i in range(1, 9)], "query_id string, rank int, path string, line_start int, line_end int")
    t = spark.createDataFrame([("q", "p", 15, 16)], "query_id string, path string, span_start int, span_end int")
    got = labels.interval_labels(c, t)
    assert [r["rank"] for r in got.where("label = 'A'").collect()] == [1]
    assert labels.capped_negatives(got).count() == 5
    assert labels.capped_negatives(labels.interval_labels(c, t.limit(0))).count() == 2


def test_training_row(spark):
    row = one(spark, 'say "x"', lambda c: labels.training_row(F.lit(7), c, c, F.lit("A")))
    assert row.id == "000007" and row.gold == '{"q1":"A"}'


def test_wilson_of_nothing(spark):
    row = spark.range(1).select(*evaluation.wilson(F.lit(0), F.lit(0))).head()
    assert tuple(row) == (0.0, 0.0, 1.0)


def test_unpriced_model_makes_cost_null(spark):
    calls = spark.createDataFrame([("q", "a", 10.0), ("q", "b", 1.0), ("r", "a", 1e6)], "query_id string, model string, tokens double")
    prices = spark.createDataFrame([("a", 2.0)], "model string, usd_per_1m double")
    assert {r.query_id: r.usd for r in evaluation.cost_per_query(calls, prices).collect()} == {"q": None, "r": 2.0}


def test_refresh_keeps_the_rest(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, digest string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, digest string")
    diff = incremental.snapshot_diff(old, new)
    assert sorted(map(tuple, diff.collect())) == [("b", "modified"), ("c", "deleted"), ("d", "added")]
    got = incremental.refreshed(old, diff, lambda f: f, new)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, new.collect()))


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id":"1","label":"A"}\n\n{"id":"2"}\nnot json\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType())])
    rows, bad = corpus.read_jsonl(spark, str(tmp_path), schema, ["id", "label"])
    assert [r.id for r in rows.collect()] == ["1"] and bad.count() == 2
    with pytest.raises(ValueError, match="missing label|not a JSON"):
        corpus.read_jsonl(spark, str(tmp_path), schema, ["id", "label"], strict=True)


def test_results_do_not_depend_on_partitions(spark):
    rows = [("q", i, p, s, s + 2, None, "ContentHit", "x") for i, (p, s) in enumerate(itertools.product("ab", range(1, 12)))]
    a, b = (ranked(spark, r).orderBy("rank").collect() for r in (rows, rows[::-1]))
    assert a == b


def test_file_leg_without_a_nested_loop(spark):
    names = [f"a/b/{x}" for x in ("12", "121", "x12y", "main.rs", "domain.rs", "mainé日本語.txt", "z\nq", "aaaa", "Main")] + ["c/12/d"]
    tokens = ["", "1", "12", "121", "main", "main.rs", "é", "日本", "語.txt", "é日本語", "aaa", "\nq", "none", "b/", None]
    files = spark.createDataFrame([(x,) for x in names], "path string")
    got = retrieval.file_leg(files, spark.createDataFrame(list(enumerate(tokens)), "query_id long, token string"))
    base = {x: x.split("/")[-1] for x in names}
    want = {(i, x) for i, t in enumerate(tokens) if t is not None for x in names if (base[x] == t if re.match(r"^.+\.[^.]+$", t) else t in base[x])}
    assert {(r.query_id, r.path) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
