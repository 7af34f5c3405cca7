"""Every registered query of the engine against its SQL."""

import pytest
from oracle import differences

from tracery.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        assert differences(df, SQL[name], sf) == ""
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["grep_hits", "file_hits", "bm25_topk", "hit_at_k", "retrieve", "auroc", "first_wins", "score_run"])
def test_no_nested_loop_over_the_corpus(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_grep_reads_the_lines_once(spark, sf):
    plan = QUERIES["grep_hits"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 1 and "Exchange" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[:2] == ["query_id", "path"]
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture
def cased(spark, tmp_path):
    """Names that fall into words where a run of capitals ends."""
    spark.createDataFrame([(7, "XAb one\nplain two\n", "de", "src1"), (8, "Xab one\n", "de", "src1"), (9, "XYAbAb one\n", "de", "src1")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Ab is asked for")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def _sql_of(spark, sf, name):
    from oracle import plain

    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    got = con.execute(SQL[name])
    names = [d[0] for d in got.description]
    df = QUERIES[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=str)
    return key(df.select(names).collect()), key(got.fetchall())


def test_sql_of_retrieve_parts_names_at_changes_of_case(spark, cased):
    have, want = _sql_of(spark, cased, "retrieve")
    assert have == want and {r[1] for r in want} == {"src1/de/7", "src1/de/9"}


def test_calls_do_not_meet_by_model(spark, sf):
    """Neither are the calls of a model shuffled to one task nor the orders sent to all."""
    plan = QUERIES["cost_by_priority"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin [model") == 1 and plan.count("BroadcastHashJoin") == 1 and "hashpartitioning(model" not in plan


@pytest.mark.parametrize("name, work", [("snippet_check", "transform(rows#"), ("doc_sentences", "regexp_extract_all(")])
def test_what_a_row_is_read_by_is_found_once(spark, sf, name, work):
    """An expression named twice is worked out twice a row, and one named in a loop over lines once a line."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(work) == 1


def test_sql_of_retrieve_routes_parts_names_at_changes_of_case(spark, cased):
    have, want = _sql_of(spark, cased, "retrieve_routes")
    assert have == want and want[0][1] == 26


@pytest.fixture
def odd_items(spark, tmp_path):
    """Items without a text, without a first word, and with one that the question has itself; documents whose names and lines hold it."""
    text = "Handled here\nhandled there\nPlain line handled\n\nWhere it is\nAbc def\n"
    spark.createDataFrame([(d, text, lang, f"src{k}") for k in range(1, 8) for d, lang in ((k, "de"), (k + 10, "en"), (k + 100, "fr"))], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, None), (2, ""), (3, "ñadir"), (4, "HANDLED by"), (5, "handled by"), (6, "abc"), (7, "Plain text")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["retrieve", "retrieve_routes"])
def test_items_without_a_word_and_with_that_of_the_question(spark, odd_items, name):
    """A missing text asks as an empty one does, and a key that two spellings share counts once."""
    have, want = _sql_of(spark, odd_items, name)
    assert have == want and len({r[0] for r in have}) == 7
