"""Merging, scoring and choosing candidates, and the route of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_symbol, last_segment
from .retrieval import path_order, verified_locations

# Scores out of 1000.
BASE = {"SymbolExact": 700, "SymbolFuzzy": 400, "FileNameHit": 300, "SemanticHit": 260, "ContentHit": 150}
STRONG_CONTENT = 650
NOTES = {"SymbolExact": "exact symbol match", "SymbolFuzzy": "symbol name match", "SemanticHit": "semantic search match", "FileNameHit": "file name match", "ContentHit": "text match"}
COVERAGE_STEP, COVERAGE_MOST, DENSITY_STEP, DENSITY_MOST, SCORE_MOST = 30, 120, 15, 4, 1000


def normalized(candidates: DataFrame) -> DataFrame:
    """Paths without ./, ends that are missing or before the start put right."""
    end = F.when(F.col("line_end") == 0, F.col("line_start")).otherwise(F.col("line_end"))
    rows = candidates.withColumn("path", F.regexp_replace("path", r"^(\./)+", "")).withColumn("line_end", end)
    return rows.withColumns({"line_start": F.least("line_start", "line_end"), "line_end": F.greatest("line_start", "line_end")})


def islands(candidates: DataFrame) -> DataFrame:
    """With island: rows of a query and path whose known ranges overlap, directly or through others, share one. Row 0 means an unknown place, which merges with nothing."""
    w = Window.partitionBy("query_id", "path").orderBy("line_start", "line_end", "raw_seq")
    reach = F.max(F.when(F.col("line_start") > 0, F.col("line_end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = ((F.col("line_start") == 0) | reach.isNull() | (F.col("line_start") > reach)).cast("int")
    return candidates.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def merge_and_rank(candidates: DataFrame, keys: DataFrame, top_k: int = 12) -> DataFrame:
    """Ranked candidates: (query_id, path, line_start, line_end, symbol, kind, snippet, score, rank).

    keys: (query_id, keys, strong) folded arrays; queries without any have no keys, and of repeated
    rows the keys count together. Overlapping ranges become one, which keeps the
    identity of the stronger; then score, at most three of a file first, others fill up.
    """
    merged_keys = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    keys = keys.groupBy("query_id").agg(merged_keys("keys"), merged_keys("strong"))
    none = F.array().cast("array<string>")
    rows = islands(normalized(candidates)).join(keys, "query_id", "left").withColumns({"keys": F.coalesce("keys", none), "strong": F.coalesce("strong", none)})
    base = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in BASE.items()))
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ_", "abcdefghijklmnopqrstuvwxyz")
    strong = (F.col("kind") == "ContentHit") & F.exists("strong", lambda k: F.contains(fold(F.col("snippet")), k))
    rows = rows.withColumn("base", F.when(strong, STRONG_CONTENT).otherwise(base))
    one = F.struct("line_start", "line_end", "raw_seq", "base", "kind", "symbol", "snippet")
    grouped = rows.groupBy("query_id", "path", "island").agg(F.array_sort(F.collect_list(one)).alias("rows"), F.first("keys").alias("keys"))

    def step(a, b):
        wins = b.base > a.base
        return F.struct(
            F.least(a.line_start, b.line_start).alias("line_start"),
            F.greatest(a.line_end, b.line_end).alias("line_end"),
            a.raw_seq.alias("raw_seq"),
            F.greatest(a.base, b.base).alias("base"),
            F.when(wins, b.kind).otherwise(a.kind).alias("kind"),
            F.when(wins, F.coalesce(b.symbol, a.symbol)).otherwise(F.coalesce(a.symbol, b.symbol)).alias("symbol"),
            F.when(wins, F.coalesce(b.snippet, a.snippet)).otherwise(F.coalesce(a.snippet, b.snippet)).alias("snippet"),
        )

    merged = grouped.withColumn("m", F.aggregate(F.slice("rows", 2, F.size("rows")), F.element_at("rows", 1), step)).select("query_id", "path", "keys", "m.*")
    hay = fold(F.concat_ws("\n", "symbol", "path", "snippet"))
    covered = F.size(F.filter("keys", lambda k: F.contains(hay, k)))
    per_file = F.count("*").over(Window.partitionBy("query_id", "path"))
    score = F.least(F.lit(SCORE_MOST), F.col("base") + F.least(F.lit(COVERAGE_MOST), covered * COVERAGE_STEP) + F.least(F.lit(DENSITY_MOST), per_file - 1) * DENSITY_STEP)
    scored = merged.withColumn("score", score.cast("int"))
    order = [F.desc("score"), path_order(), "line_start"]
    by_file = F.row_number().over(Window.partitionBy("query_id", "path").orderBy(*order))
    capped = scored.withColumn("in_file", by_file).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("in_file") > 3, *order))).where(F.col("place") <= top_k)
    return capped.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).select("query_id", "path", "line_start", "line_end", "symbol", "kind", "snippet", "score", "rank")


def _trusted(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Exact symbols that a query named: not as part of a path, and plain words only in queries of two identifiers at most."""
    last = last_segment(F.col("symbol"))
    own = (F.col("kind") == "SymbolExact") & F.col("symbol").isNotNull()
    named = ~F.exists(F.col("p.path_tokens"), lambda t: F.contains(t, last))
    return rows.join(patterns.select("query_id", "p"), "query_id").where(own & named & (is_symbol(last) | (F.col("p.n_original") <= 2))).withColumn("segment", last)


def trusted_symbols(candidates: DataFrame, ranked: DataFrame, patterns: DataFrame) -> DataFrame:
    """(query_id, distinct_trusted, has_exact, unique_trusted) from the candidates before they are merged and after, and patterns (query_id, p).

    Distinct counts the qualified names of each last segment, one for a segment met only bare.
    unique_trusted tells that one ranked candidate alone is trusted, at a known line, and one name before.
    """
    raw = _trusted(candidates, patterns)
    qualified = F.when(F.col("symbol") != F.col("segment"), F.col("symbol"))
    names = raw.groupBy("query_id", "segment").agg(F.greatest(F.lit(1), F.countDistinct(qualified)).alias("n")).groupBy("query_id").agg(F.sum("n").cast("int").alias("distinct_trusted"))
    kept = _trusted(ranked, patterns).groupBy("query_id").agg(F.count("*").alias("n"), F.min("line_start").alias("first"))
    rows = patterns.select("query_id").distinct().join(names, "query_id", "left").join(kept, "query_id", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("query_id", F.coalesce("distinct_trusted", F.lit(0)).alias("distinct_trusted"), (n > 0).alias("has_exact"), ((n == 1) & (F.col("first") > 0) & (F.coalesce("distinct_trusted", F.lit(0)) <= 1)).alias("unique_trusted"))


def confidence(ranked: DataFrame, queries: DataFrame, trusted: DataFrame | None = None) -> DataFrame:
    """(query_id, confidence 0..100, has_exact, unique_trusted): from the best score and its lead; 0 without candidates. Without trusted, from ``trusted_symbols``, no symbol is."""
    top = ranked.where("rank <= 2").groupBy("query_id").agg(F.max("score").alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    c = F.least(F.lit(100), F.expr("top div 10 + (top - coalesce(second, 0)) div 20"))
    rows = queries.select("query_id").distinct().join(top, "query_id", "left")
    rows = rows.join(trusted.select("query_id", "has_exact", "unique_trusted"), "query_id", "left") if trusted is not None else rows.withColumns({"has_exact": F.lit(False), "unique_trusted": F.lit(False)})
    return rows.select("query_id", F.when(F.col("top").isNull(), 0).otherwise(c.cast("int")).alias("confidence"), F.coalesce("has_exact", F.lit(False)).alias("has_exact"), F.coalesce("unique_trusted", F.lit(False)).alias("unique_trusted"))


def route(rows: DataFrame, early: int = 90, fallback: int = 30) -> DataFrame:
    """With route: confidence where a trusted exact symbol carries it, unique-symbol where one alone is trusted, verify from the fallback bound on, else fallback."""
    return rows.withColumn("route", F.when((F.col("confidence") >= early) & F.col("has_exact"), "confidence").when(F.col("unique_trusted"), "unique-symbol").when(F.col("confidence") >= fallback, "verify").otherwise("fallback"))


def reauthorised(routes: DataFrame, authority: DataFrame, findings: DataFrame) -> DataFrame:
    """Routes (query_id, route) where an early exit stands only if the candidate that allowed it (query_id, path, line_start) is among the final findings; else it becomes verify."""
    held = authority.join(findings.select("query_id", "path", "line_start").distinct(), ["query_id", "path", "line_start"], "left_semi").select("query_id").distinct().withColumn("held", F.lit(True))
    early = F.col("route").isin("confidence", "unique-symbol")
    return routes.join(held, "query_id", "left").withColumn("route", F.when(early & F.col("held").isNull(), "verify").otherwise(F.col("route"))).drop("held")


def findings(ranked: DataFrame) -> DataFrame:
    """Ranked candidates as findings: with a note of their kind and symbol."""
    label = F.create_map(*(F.lit(x) for k, v in NOTES.items() for x in (k, v)))[F.col("kind")]
    return ranked.withColumn("note", F.concat(label, F.when(F.col("symbol").isNotNull(), F.concat(F.lit(": `"), F.col("symbol"), F.lit("`"))).otherwise(F.lit(""))))


def response(found: DataFrame) -> DataFrame:
    """(query_id, response): findings as JSON in their order, without what is unknown."""
    known = lambda c: F.when(F.col("line_start") > 0, F.col(c))
    one = F.struct("rank", F.struct(F.struct("path", known("line_start").alias("line_start"), known("line_end").alias("line_end")).alias("location"), "snippet", "note", "symbol").alias("f"))
    return found.groupBy("query_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.f).alias("findings"))).alias("response"))


def first_findings(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` findings of each query by rank, after those that repeat a place; at an unknown place the note tells them apart."""
    key = ["query_id", "path", "line_start", "line_end", F.when(F.col("line_start") == 0, F.col("note"))]
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("rank"))).where("nth = 1").drop("nth")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= most).drop("place")


def selected(scored: DataFrame, tau: float) -> DataFrame:
    """Candidates (query_id, rank, p) from a threshold on, numbered by score and then rank."""
    return scored.where(F.col("p") >= tau).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("p"), "rank")))


def offline_answers(candidates: DataFrame, scores: DataFrame, stats: DataFrame, most: int = 5) -> DataFrame:
    """Answers without a model: candidates by score, those without one after them by rank, of which the first ``most`` that lie in their files stay."""
    rows = verified_locations(candidates.join(scores.select("query_id", "rank", "p"), ["query_id", "rank"], "left"), stats)
    w = Window.partitionBy("query_id").orderBy(F.col("p").isNull(), F.desc("p"), "rank")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
