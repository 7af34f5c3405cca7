"""Scoring, generation, logs and streams on small inputs with known answers."""

import itertools
import json
import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tracery.operators import calibration, generation, incremental, labels, retrieval, runs
from tracery.operators import retrieve as job
from tracery.sources import corpus, logs
from tracery.streaming import state, telemetry


def new_folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


FILE = ["fn alpha() {", "    let x = 1;", "", "    go(x);", "}", *[f"line {i}" for i in range(6, 40)], "    let x = 1;"]
SNIPPETS = [
    ("let x = 1;", 2, 3, "ok"),
    ("let   x =\t1;", 2, 3, "ok"),
    ("let x = 1;\n...\n}", 1, 5, "ok"),
    ("fn alpha() {\n let x = 1;\n\n go(x);", 1, 4, "ok"),
    ("let x = 1;…[truncated]", 2, 2, "ok"),
    ("… (truncated)\nlet x = 1;", 2, 2, "ok"),
    ("let y = 1;", 2, 3, "not_found"),
    ("fn alpha() {\ngo(x);", 1, 4, "not_found"),
    ("line 30", 2, 3, "misaligned"),
    ("line 30", None, None, "ok"),
    ("line 30", 1, 40, "ok"),
    ("let x = 1;", 40, 40, "ok"),
    ("line 12", 9, None, "ok"),
    ("line 13", 9, None, "misaligned"),
    ("...", 2, 3, "ok"),
]


def test_snippets_against_files(spark):
    rows = [(i, [FILE[k] for k in range(len(FILE))], *x) for i, x in enumerate(SNIPPETS)]
    df = spark.createDataFrame(rows, "i int, rows array<string>, snippet string, a int, b int, want string")
    got = df.select("i", "want", runs.snippet_status(F.transform("rows", runs.folded), F.col("a"), F.col("b"), F.col("snippet")).alias("got")).collect()
    assert [(r.i, r.got) for r in got] == [(r.i, r.want) for r in got]


def test_snippet_chunks(spark):
    text = "a  b\n\nc\n...\n\nd…[truncated after 3 lines; request a narrower line range]\n…[truncated]\ne"
    assert spark.range(1).select(runs.snippet_chunks(F.lit(text)).alias("c")).head().c == [["a b", "", "c"], ["d"], ["e"]]


def test_scored_findings(spark):
    files = spark.createDataFrame([("a.rs", "\n".join(FILE) + "\n")], "path string, content string")
    rows = [(1, "./a.rs", 1, 2, None), (2, "b.rs", 1, 2, None), (3, "a.rs", 5, 99, None), (4, "a.rs", 2, 2, "made up"), (5, "a.rs", None, None, "line 9"), (6, "a.rs", 0, 1, None)]
    got = {r.run_id: r for r in runs.scored_findings(spark.createDataFrame(rows, "run_id int, path string, line_start int, line_end int, snippet string"), files).collect()}
    assert [got[i].hallucination for i in range(1, 7)] == [None, "fabricated_path", "range_outside_file", "fabricated_snippet", None, "range_outside_file"]
    assert got[5].symbol_only and got[5].line_valid is None and got[1].line_valid


@pytest.mark.parametrize(("change", "want"), [({}, "fallback-miss"), ({"file_hit_any": True}, None), ({"timeout": True}, "timeout"), ({"is_error": True}, "error"), ({"n_made_up": 1}, "fabricated-path"), ({"cand_recall": False}, "retrieval-miss"), ({"stage": "verify"}, "verify-rejected-correct"), ({"forced_finish": True}, "fallback-budget"), ({"stage": "early-exit"}, "rank>k"), ({"cand_recall": None}, "fallback-miss"), ({"cand_recall": None, "stage": "verify"}, None), ({"is_negative": True, "negative_ok": 1.0}, None)])
def test_attribution(spark, change, want):
    row = {"file_hit_any": False, "is_negative": False, "negative_ok": None, "timeout": False, "is_error": False, "n_made_up": 0, "cand_recall": True, "stage": "fallback", "forced_finish": False} | change
    schema = "file_hit_any boolean, is_negative boolean, negative_ok double, timeout boolean, is_error boolean, n_made_up int, cand_recall boolean, stage string, forced_finish boolean"
    assert spark.createDataFrame([tuple(row.values())], schema).select(runs.attribution_class().alias("a")).head().a == want


def test_run_rows_and_specs_from_files(spark):
    root = new_folder()
    df = spark.createDataFrame([("q1", 1), ("q2-warmup", 2)], "query_id string, tokens int")
    df.coalesce(1).write.json(f"file://{root}/one/raw")
    import glob
    import os
    import shutil

    os.makedirs(f"{root}/run/repo_a")
    shutil.copy(glob.glob(f"{root}/one/raw/part*.json")[0], f"{root}/run/repo_a/pass1.jsonl")
    got = runs.read_run_rows(spark, f"file://{root}/run", "query_id string, tokens int").collect()
    assert [(r.query_id, r.tokens, r.repo) for r in got] == [("q1", 1, "repo_a")]
    spec = {"id": "q1", "cat": "c", "expect": {"primary": [{"path": "a", "span": [1, 2]}, {"path": "b"}], "distractor": [{"path": "d"}], "stage": "verify"}}
    with open(f"{root}/specs.json", "w") as f:
        f.write(json.dumps(spec) + "\n" + json.dumps({"id": "q2", "cat": "c"}) + "\n")
    specs, targets = runs.read_query_specs(spark, f"file://{root}/specs.json")
    assert {(r.query_id, r.primary_mode, r.stage_expected) for r in specs.collect()} == {("q1", "all", "verify"), ("q2", "all", None)}
    assert {tuple(r) for r in targets.collect()} == {("q1", "primary", "a", 1, 2), ("q1", "primary", "b", None, None), ("q1", "distractor", "d", None, None)}
    unknown = spark.createDataFrame([("r", "q1"), ("r", "q9")], "repo string, query_id string")
    assert [r.query_id for r in runs.without_spec(unknown, specs).collect()] == ["q9"]


def test_metrics_and_telemetry_files(spark):
    root = new_folder()
    rows = spark.createDataFrame([(1, "verify", 10, 2, 100.0)], "run_id int, stage string, tokens int, llm_calls int, latency_ms double")
    runs.write_metrics_csv(rows, runs.efficiency_report(rows), f"file://{root}/csv")
    got = {r.metric: float(r.value) for r in spark.read.option("header", True).csv(f"file://{root}/csv/aggregate").collect()}
    assert got["tokens.p95"] == 10 and got["stage_exit.verify"] == 1
    for _ in range(2):
        runs.append_telemetry(rows, f"file://{root}/telemetry")
    assert spark.read.json(f"file://{root}/telemetry").count() == 2


@pytest.mark.parametrize(
    ("text", "start", "python", "want"),
    [
        ("/// Parses the given input text. More here.\nfn f() {\n}", 2, False, "Parses the given input text."),
        ("/**\n * Opens one file\n * for reading only.\n */\n@Override\nvoid f() {\n}", 6, False, "Opens one file for reading only."),
        ("x = 1\ndef f():\n    '''Reads all of it.'''\n    pass", 2, True, "Reads all of it."),
        ("x = 1\ndef f():\n    '''Reads all of it.'''\n    pass", 2, False, None),
        ("// TODO: fix this thing soon\nfn f() {}", 2, False, None),
        ("// too short\nfn f() {}", 2, False, None),
        ("// Far above is this comment.\n\nfn f() {}", 3, False, None),
        ("fn f() {}", 1, False, None),
    ],
)
def test_doc_sentence(spark, text, start, python, want):
    rows = F.split(F.lit(text), "\n")
    assert spark.range(1).select(generation.doc_sentence(rows, F.lit(start), F.lit(start + 2), F.lit(python)).alias("d")).head().d == want


@pytest.mark.parametrize(("line", "want"), [('bail!("cannot open the file")', "cannot open the file"), ('raise X("it \\"really\\" failed")', 'it \\"really\\" failed'), ('print("cannot open the file")', None), ('panic!("short")', None), ('Err("onelongwordwithoutspace")', None)])
def test_error_literal(spark, line, want):
    rows = F.array(F.lit("fn f() {"), F.lit(line), F.lit("}"))
    assert spark.range(1).select(generation.error_literal(rows, F.lit(1), F.lit(3)).alias("e")).head().e == want


def test_generated_queries_are_repeatable_and_bounded(spark):
    text = "/// Sorts all of the rows. Fast.\nfn sort_rows() {\n}\n\nfn other_name() {\n}\n"
    files = spark.createDataFrame([("r", f"src/{i}.rs", text) for i in range(5)], "repo string, path string, content string")
    symbols = spark.createDataFrame([("r", f"src/{i}.rs", f"m{i}::sort_rows", 2, 3) for i in range(5)] + [("r", "src/0.rs", "m::run", 5, 6), ("r", "src/0.rs", "m::other", 5, 5)], "repo string, path string, qualified_name string, line_start int, line_end int")
    got = [generation.generated_queries(symbols, files, "1", 3).orderBy("query_index").collect() for _ in range(2)]
    assert got[0] == got[1] and [r.query_index for r in got[0]] == [0, 1, 2]
    assert {r.query for r in got[0]} <= {"where is sort_rows defined", "where is the code that handles sort rows", "how does this project sort rows", "where do we sort rows", "where is the code that sorts all of the rows"}


def test_splits_manifest_and_cache_folders(spark):
    root = new_folder()
    corpus.write_splits(spark.createDataFrame([("train", 1), ("val", 2)], "split string, x int"), f"file://{root}/splits")
    assert spark.read.json(f"file://{root}/splits/split=val").head().x == 2
    repos = spark.createDataFrame([("r", "train")], "repo string, split string")
    counters = spark.createDataFrame([("r", 3)], "repo string, n long")
    files = spark.createDataFrame([("r", "a", "d1")], "repo string, path string, digest string")
    generation.write_manifest(generation.manifest(counters, repos, files, {"seed": 7}), f"file://{root}/manifest")
    row = spark.read.json(f"file://{root}/manifest").head()
    assert json.loads(row.repos) == [{"repo": "r", "split": "train", "n": 3}] and json.loads(row.settings) == {"seed": 7} and len(row.corpus_sha256) == 64
    incremental.write_cache(spark.createDataFrame([("k", 1), ("l", 2)], "key string, schema_version int"), f"file://{root}/cache")
    assert [r.key for r in spark.read.parquet(f"file://{root}/cache").where("schema_version = 2").collect()] == ["l"]


def test_files_and_decontamination(spark):
    root = new_folder()
    for name, data in (("a.txt", "x\ny\n"), ("b.txt", "nul\0"), (".hidden", "z")):
        with open(f"{root}/{name}", "w") as f:
            f.write(data)
    assert [r.path.rsplit("/", 1)[1] for r in corpus.read_files(spark, f"file://{root}").collect()] == ["a.txt"]
    rows = spark.createDataFrame([("https://H/a.git",), ("https://h/b",)], "url string")
    bad = spark.createDataFrame([("https://h/A/",)], "bad string")
    assert labels.decontaminated(rows, "url", bad, "bad").count() == 1
    with pytest.raises(ValueError, match=r"https://H/a\.git"):
        labels.decontaminated(rows, "url", bad, "bad", fail=True)


def test_outline_aliases(spark):
    df = spark.createDataFrame([("a.rs", "m", "1-981", "Module", None), ("a.rs", None, "5-9", "Function", "f"), ("a.rs", None, None, "Class", "c"), (None, "x", "1-2", None, None), ("a.rs", "one", "1-1", "Module", None)], "file string, qn string, lines string, label string, name string")
    got = {r.qualified_name: (r.line_start, r.line_end) for r in corpus.read_outline(df).collect()}
    assert got == {"m": (1, 980), "f": (5, 9), "c": (0, 0), "one": (1, 1)}


def test_line_ends(spark):
    files = spark.createDataFrame([("r", "p", "a\r\nb\r\r\n\nc")], "repo string, path string, content string")
    assert [r.line for r in corpus.corpus_lines(files).orderBy("line_no").collect()] == ["a", "b\r", "", "c"]


def test_literal_search_of_repeated_lines_and_both_ways(spark):
    rng = random.Random(5)
    rows = [("p", 1, "same Line"), ("p", 1, "same Line"), ("q", 2, "SAME line"), ("q", 3, "")] + [("r", i, "".join(rng.choice("abC ") for _ in range(12))) for i in range(60)]
    lines = spark.createDataFrame(rows, "path string, line_no int, line string")
    wanted = [(1, "same line"), (1, "Line"), (2, "ab"), (2, ""), (3, "C"), (3, "a"), (4, "nowhere"), (1, "Line")]
    patterns = spark.createDataFrame(wanted, "query_id int, pattern string")
    hit = lambda p, t: p in t if any(c.isupper() for c in p) else p in t.lower()
    want = sorted((q, p, *r) for q, p in set(wanted) if p for r in rows if hit(p, r[2]))
    for most in (100, 2):
        assert sorted(map(tuple, retrieval.substring_hits(lines, patterns, most).collect())) == want


def test_bm25_against_plain_scores(spark):
    rng = random.Random(6)
    texts = {i: [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))] for i in range(60)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a B c"), (2, "h"), (3, "zz"), (4, "")], "query_id long, text string")
    mean = sum(map(len, texts.values())) / 60
    want = []
    for q, terms in ((1, "abc"), (2, "h")):
        score = {}
        for x in terms:
            df = sum(x in t for t in texts.values())
            for i, t in texts.items():
                if x in t:
                    score[i] = score.get(i, 0) + math.log(1 + (60 - df + 0.5) / (df + 0.5)) * t.count(x) * 2.2 / (t.count(x) + 1.2 * (0.25 + 0.75 * len(t) / mean))
        best = sorted(((-round(s, 6), i) for i, s in score.items()))[:5]
        want += [(q, i, -s, k + 1) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, retrieval.bm25(docs, queries, 5).collect())) == sorted(want)


def test_symbol_and_body_legs(spark):
    symbols = spark.createDataFrame([("a", "m::parse_url", 1, 2), ("a", "m::Parse", 3, 4), ("b", "x.parser.run", 1, 1)], "path string, qualified_name string, line_start int, line_end int")
    names = spark.createDataFrame([("q", "parse_url"), ("q", "parse")], "query_id string, name string")
    got = {(r.symbol, r.kind) for r in retrieval.symbol_leg(symbols, names, fuzzy=True).collect()}
    assert got == {("m::parse_url", "SymbolExact"), ("m::parse_url", "SymbolFuzzy"), ("m::Parse", "SymbolFuzzy"), ("x.parser.run", "SymbolFuzzy")}
    files = spark.createDataFrame([("r", "a", "one\ntwo\nThree\nfour"), ("r", "b", "five")], "repo string, path string, content string")
    asked = spark.createDataFrame([("q", "Three"), ("q", "TWO"), ("q", "FOUR")], "query_id string, pattern string")
    assert [r.symbol for r in retrieval.body_leg(symbols, files, asked).collect()] == ["m::Parse"]


def test_retrieve_over_all_legs_and_scopes(spark):
    files = spark.createDataFrame([("r", "src/net/url_parse.rs", "fn parse_url() {\n  split(url)\n}\n"), ("r", "src/main.rs", "fn main() {\n  parse_url()\n}\n"), ("r", "docs/a.md", "parse_url is here\n")], "repo string, path string, content string")
    symbols = spark.createDataFrame([("r", "src/net/url_parse.rs", "net::parse_url", 1, 3), ("r", "src/main.rs", "main", 1, 3)], "repo string, path string, qualified_name string, line_start int, line_end int")
    queries = spark.createDataFrame([("a", "where is parse_url", None), ("b", "parse_url", "src"), ("c", "url_parse.rs", None), ("d", "the", None)], "query_id string, text string, scope string")
    got = job.retrieve(queries, files, symbols)
    rows = {q: [(r.path, r.kind) for r in rs] for q, rs in itertools.groupby(got.ranked.orderBy("query_id", "rank").collect(), lambda r: r.query_id)}
    assert rows["a"][0] == ("src/net/url_parse.rs", "SymbolExact") and ("docs/a.md", "ContentHit") in rows["a"]
    assert {p for p, _ in rows["b"]} == {"src/net/url_parse.rs", "src/main.rs"}
    assert ("src/net/url_parse.rs", "FileNameHit") in rows["c"] and "d" not in rows
    routes = {r.query_id: r.route for r in got.decisions.collect()}
    assert routes["d"] == "fallback" and routes["a"] in ("confidence", "unique-symbol") and len(routes) == 4


def test_context_lines_go_to_one_hit(spark):
    files = spark.createDataFrame([("p", "\n".join(map(str, range(1, 11))))], "path string, content string")
    hits = spark.createDataFrame([("p", 3), ("p", 6), ("p", 10)], "path string, line_no int")
    got = {r.line_no: (r.before, r.after) for r in retrieval.context_lines(hits, files, 2).collect()}
    assert got == {3: (["1", "2"], ["4", "5"]), 6: ([], ["7", "8"]), 10: (["9"], [])}


def test_log_fields(spark):
    line = 'k=1 a="x y" b=[1, "z"] k=2 c={"d": 1} e=true f=1.5 g=word'
    got = spark.range(1).select(logs.fields(F.lit(line)).alias("f")).head().f
    assert got == {"k": "2", "a": "x y", "b": '[1, "z"]', "c": '{"d": 1}', "e": "true", "f": "1.5", "g": "word"}
    kinds = [spark.range(1).select(logs.value_kind(F.lit(x)).alias("k")).head().k for x in ('"q"', "[1]", "[a", "true", "12", "1.5", "w")]
    assert kinds == ["str", "json", "str", "bool", "int", "float", "str"]
    named = [spark.range(1).select(logs.line_kind(F.lit(x)).alias("k")).head().k for x in ("provider call ok", "provider call succeeded", "exploration complete", "nothing")]
    assert named == ["provider_call", None, "complete", None]


def test_late_events_are_dropped_in_append_mode(spark):
    root = new_folder()
    schema = "ts timestamp, event_type string, value double"
    first = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-03 00:00:00", "a", 2.0)]
    # a watermark drops rows from the second batch after it was reached on
    for i, rows in enumerate((first, [("2024-01-03 01:00:00", "a", 16.0)], [("2024-01-01 00:20:00", "a", 4.0), ("2024-01-05 00:00:00", "a", 8.0)])):
        spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value").coalesce(1).write.parquet(f"file://{root}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{root}/in")
    got = {str(r.window_start): r.total for r in telemetry.run_available(telemetry.rollup(stream, late="1 hour"), "append").collect()}
    batch = {str(r.window_start): r.total for r in telemetry.rollup(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"file://{root}/in")).collect()}
    # the window of the first day closed before its late event came; the last one is still open
    assert got["2024-01-01 00:00:00"] == 1.0 and batch["2024-01-01 00:00:00"] == 5.0 and "2024-01-05 00:00:00" not in got


def test_first_findings_and_requests_as_streams(spark):
    root = new_folder()
    rows = [("2024-01-01 00:00:00", "k", 1), ("2024-01-01 00:00:01", "k", 2), ("2024-01-01 00:00:02", "l", 3)]
    spark.createDataFrame(rows, "ts string, key string, x int").selectExpr("cast(ts as timestamp) ts", "key", "x").coalesce(1).write.parquet(f"file://{root}/in")
    stream = spark.readStream.schema("ts timestamp, key string, x int").parquet(f"file://{root}/in")
    got = telemetry.run_available(telemetry.first_findings(stream, ["key"]), "append").collect()
    assert {r.key for r in got} == {"k", "l"} and len(got) == 2
    line = lambda n, t, text: (t, n, f"INFO explore{{req_id=aa-{n // 10}}}: {text}")
    lines = [line(1, "2024-01-01 00:00:00", 'retrieval leg done leg="grep" hits=3'), line(2, "2024-01-01 00:00:05", 'exploration complete path="verify" tokens=7'), line(11, "2024-01-02 00:00:00", "verification escalated to the fallback loop"), line(21, "2024-01-09 00:00:00", "retrieval leg done leg=x")]
    spark.createDataFrame(lines, "ts string, seq int, line string").selectExpr("cast(ts as timestamp) ts", "seq", "line").coalesce(1).write.parquet(f"file://{root}/log")
    events = logs.log_events(spark.readStream.schema("ts timestamp, seq int, line string").parquet(f"file://{root}/log"))
    got = {r.request: r for r in telemetry.run_available(logs.request_stream(events), "append").collect()}
    assert set(got) == {0, 1} and (got[0].stage, got[0].tokens, got[0].legs) == ("verify", 7, ["grep:3"]) and got[1].escalated


def test_continuous_retrieval(spark):
    root = new_folder()
    spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, text string").coalesce(1).write.parquet(f"file://{root}/q")
    index = spark.createDataFrame([("a", "p1")], "text string, path string")
    stream = spark.readStream.schema("query_id int, text string").parquet(f"file://{root}/q")
    state.answered(stream, lambda batch: batch.join(index, "text"), f"file://{root}/out", f"file://{root}/state")
    assert [(r.query_id, r.path) for r in spark.read.parquet(f"file://{root}/out").collect()] == [(1, "p1")]


def test_gate_fails_on_missing_values(spark):
    row = spark.createDataFrame([(0.95, None, float("nan"), 0.5)], "query_top1 double, auroc double, ece double, precision double")
    assert {r.metric: r.passed for r in calibration.acceptance_gate(row).collect()} == {"query_top1": True, "auroc": False, "ece": False, "precision": False}


def test_calibrated_gate_and_promotion(spark):
    rows = [("q", i, int(i % 2 == 0), 4.0 if i % 2 == 0 else -4.0) for i in range(40)]
    val = spark.createDataFrame(rows, "query_id string, rank int, positive int, z double")
    assert all(r.passed for r in calibration.calibrated_gate(val, val).collect())
    rate = spark.createDataFrame([(0.85,)], "rate double")
    assert [runs.promoted(rate, spark.createDataFrame([(n,)], "n int")).head().promoted for n in (0, 1)] == [True, False]


def test_permille_and_caps(spark):
    row = spark.range(1).select(calibration.permille(F.lit(0.12345)).alias("a"), calibration.permille(F.lit(1.7)).alias("b"), calibration.clamped_temperature(F.lit(9.0)).alias("c"), incremental.response_cap(F.lit(True), F.lit(100), F.lit(40)).alias("d"), incremental.response_cap(F.lit(True), F.lit(0), F.lit(40)).alias("e"), incremental.response_cap(F.lit(False), F.lit(7), F.lit(40)).alias("f")).head()
    assert tuple(row) == (123, 1000, 5.0, 100, 0, 7)
    skip = lambda *x: spark.range(1).select(incremental.may_skip_refresh(*map(F.lit, x), 10).alias("s")).head().s
    assert [skip("a", "a", 9), skip("a", "a", 10), skip("a", "b", 1), skip(None, "a", 1)] == [True, False, False, False]


def test_auroc_by_range_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [("q", i, rng.randint(0, 1), rng.randint(0, 300) / 300) for i in range(900)]
    pos, neg = [[p for *_, y, p in rows if y == v] for v in (1, 0)]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert calibration.auroc(spark.createDataFrame(rows, "query_id string, rank int, positive int, p double")).head().auroc == pytest.approx(want, abs=1e-12)


def test_compute_once_and_refresh(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, key string")
    seen = []
    got = incremental.compute_once(queries, ["key"], lambda keys: (seen.append(keys.count()), keys.withColumn("v", F.upper("key")))[1])
    assert sorted((r.id, r.v) for r in got.collect()) == [(1, "A"), (2, "A"), (3, "B")] and seen == [2]


def test_generated_rows_end_to_end(spark):
    body = "/// Sorts all of the rows.\nfn sort_rows() {\n  a\n}\n\nfn other_name() {\n  sort_rows()\n}\n"
    files = spark.createDataFrame([(r, f"{r}/src/{i}.rs", body) for r in ("one", "two") for i in range(3)], "repo string, path string, content string")
    symbols = spark.createDataFrame([(r, f"{r}/src/{i}.rs", f"m{i}::{n}", a, b) for r in ("one", "two") for i in range(3) for n, a, b in (("sort_rows", 2, 4), ("other_name", 6, 8))], "repo string, path string, qualified_name string, line_start int, line_end int")
    repos = spark.createDataFrame([("one", "rust", "train"), ("two", "rust", "val")], "repo string, lang string, split string")
    rows, counters = generation.generate_training_rows(files, symbols, repos, max_queries=4)
    got, by = rows.collect(), {r.repo: r for r in counters.collect()}
    assert {r.repo for r in got} == {"one", "two"} and all(json.loads(r.state)["state"].split("candidate: ")[1].startswith(r.repo) for r in got)
    assert all(r.id.startswith(r.query_id) and json.loads(r.gold)["relevant"]["label"] == r.label for r in got)
    for r in by.values():
        own = [x for x in got if x.repo == r.repo]
        assert (r.symbols_total, r.queries_generated) == (6, 4) and r.rows_positive == sum(x.label == "A" for x in own) > 0 and r.rows_negative == sum(x.label == "B" for x in own)
        queries = {x.query_id for x in own}
        assert len(queries) + r.filtered_early_exit + r.filtered_fallback == 4


def test_responses_and_cache_layers(spark):
    answer = json.dumps({"findings": [{"location": {"path": "a", "line_start": 1}, "snippet": "s"}, {"location": {"path": "b"}}], "stage_exit": "verify", "retrieval_confidence": 7})
    df = spark.createDataFrame([(1, answer, False), (2, answer, True), (3, "{oops", False), (4, None, False)], "run_id int, response string, is_error boolean")
    rows, found = runs.parsed_responses(df)
    assert {(r.run_id, r.response_stage_exit, r.response_confidence) for r in rows.collect()} == {(1, "verify", 7), (2, None, None), (3, None, None), (4, None, None)}
    assert sorted(map(tuple, found.collect())) == [(1, 0, "a", 1, None, "s"), (1, 1, "b", None, None, None)]
    entry = "key string, valid boolean, turns int, tokens int"
    memory, disk = spark.createDataFrame([("a", True, 1, 10), ("b", False, 2, 20)], entry), spark.createDataFrame([("a", True, 9, 90), ("b", True, 3, 30)], entry)
    got = incremental.classified_hits(spark.createDataFrame([("a",), ("b",), ("c",)], "key string"), memory, disk)
    assert {tuple(r) for r in got.collect()} == {("a", "l1", 1, 10), ("b", "l2", 3, 30), ("c", "miss", None, None)}
    calls = spark.createDataFrame([("ok", 5), ("ok", 7), (None, 1)], "outcome string, latency_ms int")
    assert [tuple(r) for r in runs.outcome_counts(calls, "outcome").collect()] == [("ok", 2, 12)]


@pytest.mark.parametrize("name", ["score_run", "answer_rates", "query_summary", "category_hits", "location_subtypes"])
def test_no_run_table_goes_through_the_driver(spark, sf, name):
    """Small files of many rows look small enough to be sent to all; only the files' lines and single rows are."""
    import re

    from tracery.plans.queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"BroadcastHashJoin \[(?!path)\w+", plan) and "SortMergeJoin" in plan


@pytest.mark.parametrize("name", ["score_run", "category_hits"])
def test_no_run_table_that_is_written_first_goes_through_the_driver(spark, sf, name, monkeypatch):
    """Nor in the tables that a query writes on its way: that of runs with their specs met all customers in one broadcast."""
    import re

    from tracery.plans.queries import QUERIES

    plans, cut = [], runs.cut
    monkeypatch.setattr(runs, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    plans.append(QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 4 and not [x for p in plans for x in re.findall(r"BroadcastHashJoin \[(?!path)\w+", p)]
