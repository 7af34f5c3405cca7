"""The stored index: a search after a change is a search of a fresh index, and what is unchanged is not read."""

import os
import random
import tempfile

from pyspark.sql import functions as F

from tracery.operators.postings import Postings
from tracery.operators.retrieval import substring_hits
from tracery.sources.corpus import corpus_lines

FILES = "repo string, path string, content string"


def new_root():
    return f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/index"


def corpus(spark, rows):
    files = spark.createDataFrame(rows, FILES)
    return files, files.select("repo", "path", F.sha2("content", 256).alias("digest"))


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "pattern", "repo", "path", "line_no", "line").collect()), key=str)


def test_search_after_changes_is_that_of_a_fresh_index(spark):
    rng = random.Random(14)
    text = lambda: "\n".join("".join(rng.choice("abcAB _") for _ in range(rng.randint(0, 14))) for _ in range(6))
    now = {(r, f"{r}/d{i % 3}/f{i}"): text() for r in ("one", "two", "o'dd repo=x") for i in range(12)}
    asked = [(q, "".join(rng.choice("abcA ") for _ in range(rng.choice([1, 2, 3, 4, 5]))), r, rng.choice([None, f"{r}/d1"])) for q in range(40) for r in ("one", "two", "o'dd repo=x")]
    patterns = spark.createDataFrame([*asked, (99, "abc", None, None), (98, "", "one", None)], "query_id int, pattern string, repo string, scope string")
    index, root = Postings(new_root()), None
    for step in range(3):
        files, stats = corpus(spark, [(*k, v) for k, v in now.items()])
        changes = {(r.repo, r.path): r.change for r in index.refresh(files, stats).collect()}
        assert step or set(changes.values()) == {"added"}
        got = rows_of(index.search(files, patterns))
        assert got == rows_of(substring_hits(corpus_lines(files), patterns)) and got
        fresh = Postings(new_root())
        fresh.refresh(files, stats)
        named = lambda x: {(r.query_id, r.pattern, r.repo, r.path) for r in x.candidates(patterns).collect()}
        assert named(fresh) == named(index)
        keys = sorted(now)
        for k in rng.sample(keys, 4):
            now[k] = text()
        del now[keys[step * 2]]
        now["one", f"one/new{step}"] = text()
    assert index.refresh(files, stats).count() == 0
    index.compact(files)
    assert rows_of(index.search(files, patterns)) == got


def test_letters_whose_case_depends_on_what_follows(spark):
    index = Postings(new_root())
    files, stats = corpus(spark, [("r", "a", "see ΟΔΟΣΑ here"), ("r", "b", "οδος"), ("r", "c", "İstanbul")])
    index.refresh(files, stats)
    asked = spark.createDataFrame([(1, "ΟΔΟΣ", "r"), (2, "οδος", "r"), (3, "İst", "r"), (4, "stan", "r")], "query_id int, pattern string, repo string")
    got = rows_of(index.search(files, asked))
    assert got == rows_of(substring_hits(corpus_lines(files), asked)) and {(r[0], r[3]) for r in got} == {(1, "a"), (2, "b"), (3, "c"), (4, "c")}


def test_a_refresh_reads_and_writes_changed_files_alone(spark):
    index = Postings(new_root())
    files, stats = corpus(spark, [("r", f"f{i}", f"needle {i}") for i in range(30)])
    index.refresh(files, stats)
    # of an unchanged file not even the content is looked at: it is spoilt here, and still found as it was
    later = files.withColumn("content", F.when(F.col("path") == "f3", "needle changed").otherwise(F.lit("spoilt")))
    digests = stats.withColumn("digest", F.when(F.col("path") == "f3", "new").otherwise(F.col("digest")))
    assert [tuple(r) for r in index.refresh(later, digests).collect()] == [("r", "f3", "modified")]
    asked = spark.createDataFrame([(1, "needle", "r"), (2, "changed", "r"), (3, "spoilt", "r")], "query_id int, pattern string, repo string")
    named = {(r.query_id, r.path) for r in index.candidates(asked).collect()}
    assert named == {(1, f"f{i}") for i in range(30)} | {(2, "f3")}
    second = spark.read.parquet(f"{index.root}/grams/segment=2")
    assert {r.path for r in second.select("path").distinct().collect()} == {"f3"}


def test_reads_are_pruned_by_repository_and_bucket(spark):
    index = Postings(new_root())
    files, stats = corpus(spark, [(f"r{i}", f"r{i}/f", "alpha beta gamma delta") for i in range(5)])
    assert index.candidates(spark.createDataFrame([(1, "abc", "r1")], "query_id int, pattern string, repo string")).count() == 0
    index.refresh(files, stats)
    rows = index._read(files, [1], ["r2"], [3, 4])
    assert {os.path.basename(os.path.dirname(os.path.dirname(f))) for f in rows.inputFiles()} >= {"repo=r2"}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1] and "repo" in plan.split("PartitionFilters")[1]
