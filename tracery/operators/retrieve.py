"""Retrieval as one job: patterns of free-text queries, all legs, merging, ranking, trust and route."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources.corpus import corpus_lines
from ..sources.scratch import cut
from . import ranking, retrieval

LEGS = ("symbol", "bm25", "semantic", "grep", "file")
# Words of a query that get a search of their own in each leg.
SYMBOL_WORDS, BODY_WORDS, FILE_WORDS = 4, 4, 3


class Retrieved(NamedTuple):
    """Candidates before merging, ranked ones, and for each query confidence, trust and route."""

    candidates: DataFrame
    ranked: DataFrame
    decisions: DataFrame


def patterns_of(queries: DataFrame) -> DataFrame:
    """(query_id, p) of queries (query_id, text)."""
    return queries.select("query_id", fn.derive_patterns(F.col("text")).alias("p"))


def keys_of(patterns: DataFrame) -> DataFrame:
    """(query_id, keys, strong): folded identifiers and literals of four bytes or more; strong ones are literals and what is shaped like code."""
    folded = lambda xs: F.array_distinct(F.filter(F.transform(xs, fn.coverage_key), lambda k: F.octet_length(k) >= 4))
    p = F.col("p")
    return patterns.select("query_id", folded(F.concat(p.identifiers, p.literals)).alias("keys"), folded(F.concat(p.literals, F.filter(p.identifiers, fn.is_strong_identifier))).alias("strong"))


def candidates_of(queries: DataFrame, patterns: DataFrame, files: DataFrame, symbols: DataFrame, legs: tuple[str, ...] = LEGS) -> DataFrame:
    """The candidates of the legs asked for, in the order of LEGS. queries may have a scope, which limits paths, and a repo: each leg searches these alone, before its limits."""
    p = F.col("p")
    each = lambda xs, name: patterns.select("query_id", F.posexplode(xs).alias("nth", name)).groupBy("query_id", name).agg(F.min("nth").alias("nth"))
    body_words = F.concat(F.slice(p.literals, 1, BODY_WORDS), fn.leg_identifiers(p, F.greatest(F.lit(0), F.lit(BODY_WORDS) - F.size(p.literals))))
    name = lambda t: F.element_at(F.split(t, "/"), -1)
    place = [c for c in ("repo", "scope") if c in queries.columns]
    within = queries.select("query_id", *place).distinct() if place else None
    made = {
        "symbol": lambda: retrieval.symbol_leg(symbols, each(fn.leg_identifiers(p, F.lit(SYMBOL_WORDS)), "name"), fuzzy=True, within=within),
        "bm25": lambda: retrieval.bm25_leg(symbols, queries),
        "semantic": lambda: retrieval.body_leg(symbols, files, each(body_words, "pattern"), within),
        "grep": lambda: retrieval.grep_leg(corpus_lines(files), each(p.grep_patterns, "pattern"), within=within),
        "file": lambda: retrieval.file_leg(files, each(F.transform(F.slice(p.path_tokens, 1, FILE_WORDS), name), "token"), within),
    }
    return retrieval.union_of_legs(*(made[x]() for x in LEGS if x in legs))


def retrieve(queries: DataFrame, files: DataFrame, symbols: DataFrame, top_k: int = 12, legs: tuple[str, ...] = LEGS) -> Retrieved:
    """Answers queries (query_id, text, and a repo and a scope if there are any) from files and symbols.

    What the legs find is written once and read for all that follows. A query without words to
    search by has no candidates, confidence 0 and the route fallback.
    """
    patterns = cut(patterns_of(queries))
    candidates = cut(candidates_of(queries, patterns, files, symbols, legs))
    ranked = cut(ranking.merge_and_rank(candidates, keys_of(patterns), top_k))
    trusted = ranking.trusted_symbols(candidates, ranked, patterns)
    return Retrieved(candidates, ranked, ranking.route(ranking.confidence(ranked, queries, trusted)))
