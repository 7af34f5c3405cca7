"""Measures of runs: rates, distributions, cost, hits."""

from __future__ import annotations

from collections import Counter
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered, quantiles

Z = 1.959963984540054
#: Words of queries that travel with a scan, repeats counted, and rows that a task holds before it passes them on.
MOST_ASKED, MOST_HELD = 1_000_000, 100_000


def wilson(hits: Column, n: Column) -> tuple[Column, Column, Column]:
    """Rate and 95 % interval of a proportion; (0, 0, 1) of nothing."""
    n = n.cast("double")
    p = F.try_divide(hits, n)
    mid = F.try_divide(p + F.try_divide(F.lit(Z * Z / 2), n), 1 + F.try_divide(F.lit(Z * Z), n))
    half = F.try_divide(F.lit(Z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(Z * Z / 4), n * n)), 1 + F.try_divide(F.lit(Z * Z), n))
    return F.coalesce(p, F.lit(0.0)), F.coalesce(F.greatest(F.lit(0.0), mid - half), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), mid + half), F.lit(1.0))


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by.., n, mean, p50, p95), exact, by nearest rank; nulls don't count. No group's values lie in one task."""
    got = quantiles(df, by, value, {"p50": 0.5, "p95": 0.95}, F.avg(value).alias("mean"))
    return got.select(*by, "n", "mean", "p50", "p95")


def cost_per_query(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(query_id, calls, priced_calls, tokens, usd) from calls (query_id, model, tokens) and prices (model, usd_per_1m); usd is null if any model has no price. prices is one row a model and sent to all calls: joined by shuffles, the calls of a model would meet in one task."""
    rows = calls.join(F.broadcast(prices), "model", "left")
    usd = F.sum(F.col("tokens") * F.col("usd_per_1m") / 1e6)
    return rows.groupBy("query_id").agg(F.count("*").alias("calls"), F.count("usd_per_1m").alias("priced_calls"), F.sum("tokens").alias("tokens"), F.when(F.bool_and(F.col("usd_per_1m").isNotNull()), usd).alias("usd"))


def hit_at_k(ranked: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, file_rank, hit_1, hit_3, hit_any): place of the first true path among the distinct paths by their best rank."""
    paths = ranked.groupBy("query_id", "path").agg(F.min("rank").alias("best"))
    placed = paths.withColumn("file_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("best")))
    first = placed.join(truth.select("query_id", "path").distinct(), ["query_id", "path"]).groupBy("query_id").agg(F.min("file_rank").alias("file_rank"))
    rank = F.col("file_rank")
    return queries.select("query_id").join(first, "query_id", "left").select("query_id", "file_rank", F.coalesce(rank <= 1, F.lit(False)).alias("hit_1"), F.coalesce(rank <= 3, F.lit(False)).alias("hit_3"), rank.isNotNull().alias("hit_any"))


def naive_search(lines: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, path, n, rank): what a plain search finds by hand: lines that hold the whole query or one of its words, whatever the case, files ranked by how many such lines a word.

    A word that repeats in a query is searched once, and one that several queries have once for
    all of them. Up to MOST_PATTERNS words travel with the scan, which counts a file's lines by
    word and hands on what they come to for each query, no line; more are searched by
    ``substring_hits`` and counted by word and file before they meet the queries. Files are
    numbered by ranges.
    """
    from . import retrieval

    words = F.array_distinct(F.filter(F.concat(F.array(F.trim(F.lower("text"))), F.split(F.lower("text"), r"\s+")), lambda w: w != ""))
    asked = queries.select("query_id", F.explode(words).alias("pattern"))
    low = lines.select("path", F.lower("line").alias("line"))
    known = asked.select("pattern").distinct().limit(retrieval.MOST_PATTERNS + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length("pattern")).alias("size")).head()
    if known.n <= retrieval.MOST_PATTERNS and (known.size or 0) <= retrieval.MOST_BYTES and asked.limit(MOST_ASKED + 1).count() <= MOST_ASKED:
        by = _counted(low, asked)
    else:
        found = retrieval.substring_hits(low, asked.select(F.lit(0).alias("query_id"), "pattern").distinct())
        by = asked.join(found.groupBy("pattern", "path").agg(F.count("*").alias("n")), "pattern")
    by = by.groupBy("query_id", "path").agg(F.sum("n").alias("n"))
    return numbered(by, [F.desc("n"), "path"], "rank", ["query_id"]).withColumn("rank", F.col("rank").cast("int"))


def _counted(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, path, n) of lines (path, line): over the words asked for (query_id, pattern), how many of a file's lines hold them; a file whose lines lie apart has several rows."""
    rows = asked.toArrow()
    patterns = {p: i for i, p in enumerate(dict.fromkeys(rows.column("pattern").to_pylist()))}
    ids, place = rows.column("query_id").combine_chunks(), {}
    of: list[list[int]] = [[] for _ in patterns]
    for i, (q, p) in enumerate(zip(ids.to_pylist(), rows.column("pattern").to_pylist(), strict=True)):
        of[patterns[p]].append(place.setdefault(repr(q), i))
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, path string, n long"

    def run(batches):
        import ahocorasick
        import numpy as np
        import pyarrow as pa

        tree = ahocorasick.Automaton()
        for p, i in patterns.items():
            tree.add_word(p, i)
        if patterns:
            tree.make_automaton()
        queries = [np.array(q, np.int64) for q in of]
        second, counts, at, found, paths, sums, held = itemgetter(1), Counter(), None, [], [], [], 0

        def close():
            nonlocal held
            if counts:
                n = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), [len(queries[i]) for i in counts])
                q, back = np.unique(np.concatenate([queries[i] for i in counts]), return_inverse=True)
                found.append(q)
                sums.append(np.bincount(back, n).astype(np.int64))
                paths.append((at, len(q)))
                held += len(q)
                counts.clear()

        def flush():
            nonlocal held
            names = pa.array([p for p, _ in paths], pa.string()).take(pa.array(np.repeat(np.arange(len(paths)), [n for _, n in paths])))
            out = pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(found))), names, pa.array(np.concatenate(sums))], ["query_id", "path", "n"])
            for x in (found, paths, sums):
                x.clear()
            held = 0
            return out

        for batch in batches if patterns else ():
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != at:
                    close()
                    at = path
                    if held >= MOST_HELD:
                        yield flush()
                if text:
                    counts.update(set(map(second, tree.iter(text))))
        close()
        if held:
            yield flush()

    return lines.mapInArrow(run, schema)


def pass_classes(runs: DataFrame) -> DataFrame:
    """(query_id, n, passed, class) of repeated runs (query_id, ok)."""
    got = runs.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("passed"))
    return got.withColumn("class", F.when(F.col("passed") == F.col("n"), "pass").when(F.col("passed") > 0, "flaky").otherwise("deterministic_failure"))
