"""The generation job: which files make queries, and what its counters tell."""

from pyspark.sql import functions as F

from tracery.operators import generation


def test_only_source_files_make_queries(spark):
    body = "/// Sorts all of the rows.\nfn sort_rows() {\n  a\n}\n\nfn other_name() {\n  sort_rows()\n}\n"
    paths = ["one/src/a.rs", "one/tests/vendor/x.rs", "one/src/b_test.go", "one/src/x.txt", "two/src/b.rs", "three/docs/c.rs"]
    repo = lambda p: p.split("/")[0]
    files = spark.createDataFrame([(repo(p), p, body) for p in paths], "repo string, path string, content string")
    symbols = spark.createDataFrame([(repo(p), p, f"{p}::{n}", a, b) for p in paths for n, a, b in (("sort_rows", 2, 4), ("other_name", 6, 8), ("new", 6, 7))], "repo string, path string, qualified_name string, line_start int, line_end int")
    repos = spark.createDataFrame([("one", "rust", "train"), ("two", "rust", "val"), ("three", "rust", "val")], "repo string, lang string, split string")
    failed = spark.createDataFrame([("two", "two/src/b.rs"), ("one", "one/src/x.txt")], "repo string, path string")
    rows, counters = generation.generate_training_rows(files, symbols, repos, max_queries=1, failed=failed)
    by = {r.repo: r.asDict() for r in counters.collect()}
    # three has no source file, so nothing is walked there
    assert set(by) == {"one", "two"}
    for r in by.values():
        assert (r["files"], r["symbols_total"], r["symbols_sampled"], r["queries_generated"]) == (1, 2, 2, 1)
        assert sum(r["templates"].values()) == 1 and r["filtered_early_exit"] + r["filtered_fallback"] + r["queries_with_positive"] + r["queries_without_positive"] == 1
    assert by["one"]["outline_errors"] == 0 and by["two"]["outline_errors"] == 1
    # what is not source is no query's subject, and may still be found
    truth = {r.query_id for r in rows.where("label = 'A'").collect()}
    assert truth <= {"one:000000", "two:000000"}
    totals = {r.split: r for r in generation.totals_by_split(counters, repos).collect()}
    assert totals["train"].files == totals["val"].files == 1 and sum(totals["val"].templates.values()) == 1


def test_a_query_without_rows_counts_as_without_positive(spark):
    files = spark.createDataFrame([("r", "a.rs"), ("r", "a.rs"), ("r", "b.rs"), ("s", "c.rs")], "repo string, path string")
    one = spark.createDataFrame([("r",)], "repo string")
    queries = spark.createDataFrame([("r", 1, "define-en"), ("r", 2, "doc-en"), ("r", 3, "doc-en"), ("r", 4, "doc-en")], "repo string, query_id int, template string")
    routes = spark.createDataFrame([(1, "verify"), (2, "verify"), (3, "fallback"), (4, "unique-symbol")], "query_id int, route string")
    rows = spark.createDataFrame([("r", 1, "A"), ("r", 1, "B"), ("r", 1, "B")], "repo string, query_id int, label string")
    got = {r.repo: r for r in generation.repo_counters(files, one, one, queries, routes, rows).collect()}
    r, s = got["r"], got["s"]
    assert (r.files, r.queries_generated, r.filtered_early_exit, r.filtered_fallback, r.queries_with_positive, r.queries_without_positive, r.rows_positive, r.rows_negative) == (2, 4, 1, 1, 1, 1, 1, 2)
    assert r.templates == {"define-en": 1, "doc-en": 3} and s.files == 1 and s.queries_generated == 0 and s.templates == {} and s.outline_errors == 0
    assert generation.repo_counters(files.limit(0), one, one, queries, routes, rows).count() == 0
    assert generation.template_map(queries.withColumn("x", F.lit(1)), "x").head().templates == r.templates


def test_long_texts_in_quotes(spark):
    long = "word " * 60_000
    rows = spark.createDataFrame([(1, f"bail!(\"{long}\")", f"find '{long}it's there' and 'x'", f'leg="{long}" hits=3 error="a\\"b"')], "i int, code string, ask string, line string")
    from tracery.functions import text
    from tracery.sources import logs

    got = rows.select(generation.error_literal(F.array("code"), F.lit(1), F.lit(1)).alias("e"), text.literals(F.col("ask")).alias("l"), logs.fields(F.col("line")).alias("f")).head()
    assert got.e is None and got.l == [f"{long}it's there", "x"] and got.f == {"leg": long, "hits": "3", "error": 'a\\"b'}


def test_generated_rows_neither_joins_nor_writes_its_files(spark, sf, monkeypatch):
    """Paths are made in the scan; of the lines only their first words are shuffled for the outline."""
    from tracery.plans import training

    seen = []
    monkeypatch.setattr(training, "cut", lambda df: (seen.append(df), df)[1])
    monkeypatch.setattr(generation, "generate_training_rows", lambda files, symbols, repos: (seen.append(files), (files.select("path").withColumns({c: F.lit(1) for c in ("id", "repo", "split", "query", "template", "rank", "kind", "label", "state", "gold")}), None))[1])
    training.generated_rows(spark, sf)
    symbols, files = seen
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(files) and "Exchange" not in plan(files) and "documents.parquet" in plan(files)
    assert "Join" not in plan(symbols) and plan(symbols).count("Exchange") == 1
    old = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("concat_ws('/', source, lang, doc_id) AS old", "doc_id", "source AS repo", "text").withColumn("path", training._source_path(F.col("doc_id"), "repo"))
    assert files.select("repo", "path", "content").exceptAll(old.select("repo", "path", "text")).isEmpty() and files.count() == old.count()
    moved = training._sections(spark, sf).join(old.select(F.col("path").alias("new"), F.col("old").alias("path")), "path").select("repo", F.col("new").alias("path"), "qualified_name", "line_start", "line_end")
    assert symbols.select(*moved.columns).exceptAll(moved).isEmpty() and symbols.count() == moved.count()
