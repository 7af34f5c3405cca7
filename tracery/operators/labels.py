"""Labelled rows for training: interval labels, capped negatives, samples, decontamination, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_url
from .retrieval import path_order


def interval_labels(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidates with label A where a true span (query_id, path, span_start, span_end) touches them, else B."""
    spans = candidates.join(truth, ["query_id", "path"]).where("line_start <= span_end and span_start <= line_end").select("query_id", "rank").distinct().withColumn("hit", F.lit(True))
    return candidates.join(spans, ["query_id", "rank"], "left").withColumn("label", F.when(F.col("hit"), "A").otherwise("B")).drop("hit")


def capped_negatives(labelled: DataFrame, most: int = 4, without_positive: int = 2) -> DataFrame:
    """All positives, and of the negatives the first by rank: most, or fewer for a query without a positive."""
    has = F.bool_or(F.col("label") == "A").over(Window.partitionBy("query_id"))
    nth = F.row_number().over(Window.partitionBy("query_id", "label").orderBy("rank"))
    rows = labelled.withColumn("has", has).withColumn("nth", nth)
    return rows.where((F.col("label") == "A") | (F.col("nth") <= F.when(F.col("has"), most).otherwise(without_positive))).drop("has", "nth")


def sampled(symbols: DataFrame, k: int, seed: str) -> DataFrame:
    """k symbols of each repository, those of the smallest digest of seed and place, numbered in their original order."""
    draw = F.md5(F.concat_ws("|", F.lit(seed), "repo", "path", F.col("line_start").cast("string")))
    w = Window.partitionBy("repo").orderBy("draw", "path", "line_start")
    kept = symbols.withColumn("draw", draw).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    return kept.withColumn("query_index", F.row_number().over(Window.partitionBy("repo").orderBy(path_order(), "line_start")) - 1).drop("draw", "n")


def decontaminated(rows: DataFrame, url: str, excluded: DataFrame, excluded_url: str, fail: bool = False) -> DataFrame:
    """Rows whose normalised URL isn't excluded; with fail, an error names the first that is."""
    bad = excluded.select(normalize_url(F.col(excluded_url)).alias("norm_url")).distinct()
    rows = rows.withColumn("norm_url", normalize_url(F.col(url)))
    if fail and (hit := rows.join(bad, "norm_url", "left_semi").head()):
        raise ValueError(f"{hit[url]} is in the evaluation set")
    return rows.join(bad, "norm_url", "left_anti")


def has_licence(files: DataFrame) -> DataFrame:
    """(repo, licensed): whether a licence file lies at the root."""
    name = F.lower(F.col("path"))
    return files.groupBy("repo").agg(F.bool_or(name.rlike(r"^(licen[sc]e|copying|unlicense)[^/]*$")).alias("licensed"))


def split_stats(rows: DataFrame) -> DataFrame:
    """Rows, positives, negatives, queries, and queries with a positive, of each split."""
    positive = F.col("label") == "A"
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_if(positive).alias("n_pos"), F.count_if(~positive).alias("n_neg"), F.countDistinct("query_id").alias("n_queries"), F.countDistinct(F.when(positive, F.col("query_id"))).alias("n_with_pos"))


def training_row(index: Column, query: Column, state: Column, label: Column) -> Column:
    """struct(id, state, questions, gold) with JSON inside of strings."""
    ask = F.lit("Is the candidate relevant to the query? A: yes. B: no.")
    return F.struct(F.lpad(index.cast("string"), 6, "0").alias("id"), F.to_json(F.struct(query.alias("query"), state.alias("code"))).alias("state"), F.to_json(F.array(F.struct(F.lit("q1").alias("id"), ask.alias("text")))).alias("questions"), F.to_json(F.struct(label.alias("q1"))).alias("gold"))
