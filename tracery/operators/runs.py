"""Scoring of runs: findings against files and expected targets, failure classes, and what a run cost.

Tables: runs (run_id, query_id, repo, stage, is_error, timeout, forced_finish, ..), findings
(run_id, pos, path, line_start, line_end, snippet), targets (query_id, role, path, span_start,
span_end) with the roles primary, equivalent and distractor, specs (query_id, cat, primary_mode,
stage_expected), candidates (run_id, path, rank, kind), files (path, content).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import once
from ..sources.scratch import cut
from .evaluation import distribution, wilson
from .ranges import quantiles

# Fixed values.
STAGES = ("early-exit", "verify", "fallback", "cache")
MEMORY_LEGS = ("symbol", "semantic", "bm25")
# What stands for lines left out, alone or with a word after it, and what ends a line that was cut.
DOTS, SAYS, CUT_MARK = ("...", "…"), ("", "(truncated)", "[truncated]"), "…[truncated"


def read_run_rows(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Run rows from <root>/<repo>/pass*.jsonl, without those of warm-up queries; repo is the folder's name."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "pass*.jsonl").json(root)
    return rows.withColumn("repo", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)).where(~F.endswith("query_id", F.lit("-warmup")))


def read_query_specs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(specs, targets) from JSON rows with an expect block: lists of places by role, mode and stage."""
    place = "array<struct<path:string,span:array<int>>>"
    rows = spark.read.schema(f"id string, cat string, expect struct<primary:{place},equivalent:{place},distractor:{place},primary_mode:string,stage:string>").json(path)
    specs = rows.select(F.col("id").alias("query_id"), "cat", F.coalesce("expect.primary_mode", F.lit("all")).alias("primary_mode"), F.col("expect.stage").alias("stage_expected"))
    one = lambda role: rows.select(F.col("id").alias("query_id"), F.lit(role).alias("role"), F.explode(f"expect.{role}").alias("t"))
    all_ = one("primary").unionByName(one("equivalent")).unionByName(one("distractor"))
    return specs, all_.select("query_id", "role", "t.path", F.try_element_at("t.span", F.lit(1)).alias("span_start"), F.try_element_at("t.span", F.lit(2)).alias("span_end"))


def without_spec(runs: DataFrame, specs: DataFrame) -> DataFrame:
    """Queries of runs that no spec knows: to be reported, not scored."""
    return runs.select("repo", "query_id").distinct().join(specs.select("query_id"), "query_id", "left_anti")


def parsed_responses(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, findings) from the JSON answers of runs (run_id, response, is_error): their own stage and confidence, and a row for each finding in its order; answers in error or that don't parse have neither."""
    shape = "struct<findings:array<struct<location:struct<path:string,line_start:int,line_end:int>,snippet:string>>,stage_exit:string,retrieval_confidence:int>"
    rows = runs.withColumn("parsed", F.when(~F.coalesce("is_error", F.lit(False)), F.from_json("response", shape)))
    found = rows.select("run_id", F.posexplode("parsed.findings").alias("pos", "f")).select("run_id", "pos", "f.location.path", "f.location.line_start", "f.location.line_end", "f.snippet")
    return rows.withColumns({"response_stage_exit": F.col("parsed.stage_exit"), "response_confidence": F.col("parsed.retrieval_confidence")}).drop("parsed"), found


def outcome_counts(calls: DataFrame, by: str) -> DataFrame:
    """(value, n, total_ms): how many calls each value of a column has (index status, outcome, route, ..), without null ones."""
    return calls.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("value")).agg(F.count("*").alias("n"), F.sum("latency_ms").alias("total_ms"))


def apart(df: DataFrame) -> DataFrame:
    """Joined by shuffles, however small its files look: what has a row a run, query or finding grows with the runs and is not sent through the driver."""
    return df.hint("merge")


def live_findings(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings of the runs that aren't in error."""
    return findings.join(apart(runs.where("not is_error").select("run_id")), "run_id", "left_semi")


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def folded(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+", " ")


def left_out(line: Column) -> Column:
    """Whether a line stands for others: dots, and no more than a word that says so."""
    low = F.lower(line)
    return F.exists(F.array(*map(F.lit, DOTS)), lambda d: F.startswith(low, d) & F.ltrim(F.substring(low, F.char_length(d) + 1, F.char_length(low))).isin(*SAYS))


def snippet_chunks(snippet: Column) -> Column:
    """Quoted lines in runs that belong together: parted where the quote leaves lines out; a blank line in a run matches any."""
    lines = F.transform(F.split(snippet, r"\r?\n"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), none.alias("now"))

    def step(a, t):
        real = F.regexp_replace(F.regexp_replace(t, re.escape(CUT_MARK) + r"[^\]]*\]\s*$", ""), r"\s+$", "")
        closed = F.struct(F.when(F.size(a.now) > 0, F.concat(a.done, F.array(a.now))).otherwise(a.done).alias("done"), none.alias("now"))
        blank = F.struct(a.done.alias("done"), F.when(F.size(a.now) > 0, F.concat(a.now, F.array(F.lit("")))).otherwise(a.now).alias("now"))
        more = F.struct(a.done.alias("done"), F.concat(a.now, F.array(F.regexp_replace(real, r"\s+", " "))).alias("now"))
        return F.when(t == "", blank).when(left_out(t) | (real == ""), closed).otherwise(more)

    return F.aggregate(lines, start, step, lambda a: F.when(F.size(a.now) > 0, F.concat(a.done, F.array(a.now))).otherwise(a.done))


def snippet_status(rows: Column, line_start: Column, line_end: Column, snippet: Column) -> Column:
    """ok, misaligned or not_found: a quote against a file's lines (folded). Near is within four lines of the range; a range as long as the file is near everything, an unknown one too."""
    return once(rows, lambda lines: once(snippet_chunks(snippet), lambda chunks: _status(lines, line_start, line_end, chunks)))


def _status(rows: Column, line_start: Column, line_end: Column, chunks: Column) -> Column:
    """The same of lines and of the quote's chunks, both found."""
    n = F.size(rows)
    whole = line_start.isNotNull() & line_end.isNotNull() & (line_end - line_start >= n - 2)
    bounded = line_start.isNotNull() & (line_start > 0) & ~whole
    low, high = F.greatest(F.lit(0), line_start - 4), F.least(n, F.coalesce(line_end + 4, line_start + 3))

    def places(chunk):
        at = F.when(n >= F.size(chunk), F.sequence(F.lit(0), n - F.size(chunk))).otherwise(F.array().cast("array<int>"))
        rest = F.slice(chunk, 2, F.size(chunk))
        return F.filter(at, lambda i: F.contains(F.get(rows, i), F.get(chunk, F.lit(0))) & F.forall(F.transform(rest, lambda t, j: F.contains(F.get(rows, i + j + 1), t)), lambda x: x))

    # 2: nowhere, 1: only elsewhere, 0: fine
    one = lambda at: F.when(F.size(at) == 0, 2).when(line_start.isNull() | whole | F.exists(at, lambda i: F.coalesce(bounded & (i >= low) & (i < high), F.lit(False))), 0).otherwise(1)
    worst = F.array_max(F.transform(F.transform(chunks, places), one))
    return once(worst, lambda w: F.when(w == 2, "not_found").when(w == 1, "misaligned").otherwise("ok"))


def scored_findings(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with path, path_valid, line_valid, symbol_only and hallucination: what is made up about them, the first that holds. Lines stay one array a file."""
    rows = F.split("content", "\n")
    rows = F.when(F.element_at(rows, -1) == "", F.slice(rows, 1, F.size(rows) - 1)).otherwise(rows)
    split = files.select("path", rows.alias("rows"))
    f = findings.withColumn("path", plain_path(F.col("path"))).join(split, "path", "left")
    exists, known = F.col("rows").isNotNull(), F.col("line_start").isNotNull() & F.col("line_end").isNotNull()
    valid = F.when(exists & known, (F.col("line_start") >= 1) & (F.col("line_start") <= F.col("line_end")) & (F.col("line_end") <= F.size("rows")))
    status = F.when(exists & (F.col("snippet") != ""), snippet_status(F.transform("rows", folded), F.col("line_start"), F.col("line_end"), F.col("snippet")))
    made_up = F.when(~exists, "fabricated_path").when(~F.coalesce(valid, F.lit(True)), "range_outside_file").otherwise(once(status, lambda x: F.when(x == "not_found", "fabricated_snippet").when(x == "misaligned", "misaligned_snippet")))
    return f.withColumns({"path_valid": exists, "line_valid": valid, "symbol_only": F.col("line_start").isNull(), "hallucination": made_up}).drop("rows")


def range_length_ok(start: Column, end: Column, span_start: Column, span_end: Column) -> Column:
    return end - start + 1 <= F.greatest(3 * F.greatest(F.lit(1), span_end - span_start + 1), F.lit(40))


def schema_valid(stage_exit: Column, confidence: Column) -> Column:
    """Whether an answer's own fields are well formed; null where it has neither."""
    ok = F.coalesce(stage_exit.isin(*STAGES), F.lit(False)) & F.coalesce(confidence.between(0, 100), F.lit(False))
    return F.when(stage_exit.isNotNull() | confidence.isNotNull(), ok)


def goals_by_path(targets: DataFrame) -> DataFrame:
    """(query_id, path, primary, equivalent, distractor, n_primary, n_equivalent, spans) of targets: what a file is to a query; spans are those of its targets that have one."""
    n = lambda role: F.count_if(F.col("role") == role)
    span = F.when((F.col("role") != "distractor") & F.col("span_start").isNotNull(), F.struct("span_start", "span_end"))
    by = targets.groupBy("query_id", "path").agg(n("primary").alias("n_primary"), n("equivalent").alias("n_equivalent"), (n("distractor") > 0).alias("distractor"), F.collect_set(span).alias("spans"))
    return by.withColumns({"primary": F.col("n_primary") > 0, "equivalent": F.col("n_equivalent") > 0})


def expected_matches(runs: DataFrame, findings: DataFrame, targets: DataFrame, specs: DataFrame) -> DataFrame:
    """(run_id, n_findings, file_hit_1, file_hit_3, file_hit_any, range_hit, recall, twin_confusion, dedupe_defect, is_negative, negative_ok) of every run."""
    return _matches(runs.join(apart(specs.select("query_id", "primary_mode")), "query_id"), findings, goals_by_path(targets))


def _matches(runs: DataFrame, findings: DataFrame, goals: DataFrame) -> DataFrame:
    """The same of runs with their primary_mode: findings meet what their file is to the query, then are grouped by file and by run."""
    f = findings.withColumn("path", plain_path(F.col("path"))).join(apart(runs.select("run_id", "query_id")), "run_id").join(apart(goals), ["query_id", "path"], "left")
    start, end = F.col("line_start"), F.col("line_end")
    in_range = F.exists("spans", lambda s: (start <= s.span_end) & (s.span_start <= end) & range_length_ok(start, end, s.span_start, s.span_end))
    files = f.groupBy("run_id", "path").agg(F.min("pos").alias("first"), F.count("*").alias("n"), F.bool_or(F.coalesce(in_range, F.lit(False))).alias("in_range"), *(F.first(c).alias(c) for c in ("primary", "equivalent", "distractor", "n_equivalent")))
    files = files.withColumn("file_rank", F.row_number().over(Window.partitionBy("run_id").orderBy("first", "path")))
    goal = F.col("primary") | F.col("equivalent")
    hits = files.groupBy("run_id").agg(F.min(F.when(goal, F.col("file_rank"))).alias("best"), F.count_if("primary").alias("primaries"), F.bool_or("distractor").alias("twin"), F.sum("n_equivalent").alias("members"), F.bool_or("in_range").alias("range_hit"), F.sum("n").alias("n_findings"))
    rows = runs.select("run_id", "query_id", "primary_mode").join(apart(known_goals(goals)), "query_id", "left").join(apart(hits), "run_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n, any_, negative = zero("n_findings"), F.col("best").isNotNull(), (zero("n_primary") == 0) & (zero("n_equivalent") == 0)
    recall = F.when((F.col("primary_mode") == "all") & (zero("n_primary") > 0), zero("primaries") / F.col("n_primary")).when(any_ | negative & (n == 0), 1.0).otherwise(0.0)
    return rows.select("run_id", n.alias("n_findings"), F.coalesce(F.col("best") == 1, F.lit(False)).alias("file_hit_1"), F.coalesce(F.col("best") <= 3, F.lit(False)).alias("file_hit_3"), any_.alias("file_hit_any"), F.coalesce("range_hit", F.lit(False)).alias("range_hit"), recall.alias("recall"), F.coalesce("twin", F.lit(False)).alias("twin_confusion"), (zero("members") >= 2).alias("dedupe_defect"), negative.alias("is_negative"), F.when(negative, F.when(n == 0, 1.0).otherwise(0.5)).alias("negative_ok"))


def known_goals(goals: DataFrame) -> DataFrame:
    """(query_id, n_primary, n_equivalent) of all targets of a query."""
    return goals.groupBy("query_id").agg(F.sum("n_primary").alias("n_primary"), F.sum("n_equivalent").alias("n_equivalent"))


def candidate_recall(runs: DataFrame, candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """(run_id, cand_recall, cand_rank, cand_kind): whether a target was among the candidates, its best rank and kind; null without targets or candidates."""
    return _recalled(runs, candidates, goals_by_path(targets))


def _recalled(runs: DataFrame, candidates: DataFrame, goals: DataFrame) -> DataFrame:
    own = goals.where(F.col("primary") | F.col("equivalent"))
    c = candidates.withColumn("path", plain_path(F.col("path"))).join(apart(runs.select("run_id", "query_id")), "run_id")
    c = c.join(apart(own.select("query_id", "path", F.lit(True).alias("goal"))), ["query_id", "path"], "left")
    by = c.groupBy("run_id", "query_id").agg(F.min(F.when(F.col("goal"), F.col("rank"))).alias("cand_rank"), F.min_by(F.when(F.col("goal"), F.col("kind")), F.when(F.col("goal"), F.struct("rank", "kind"))).alias("cand_kind"))
    return by.join(apart(own.select("query_id").distinct()), "query_id", "left_semi").select("run_id", F.col("cand_rank").isNotNull().alias("cand_recall"), "cand_rank", "cand_kind")


def attribution_class() -> Column:
    """Why a scored row failed, the first that holds; null for success."""
    return (
        F.when(F.col("file_hit_any") | F.coalesce(F.col("is_negative") & (F.col("negative_ok") == 1.0), F.lit(False)), F.lit(None).cast("string"))
        .when(F.col("timeout"), "timeout")
        .when(F.col("is_error"), "error")
        .when(F.col("n_made_up") > 0, "fabricated-path")
        .when(~F.col("cand_recall"), "retrieval-miss")
        .when(F.col("cand_recall") & (F.col("stage") == "verify"), "verify-rejected-correct")
        .when(F.col("cand_recall") & (F.col("stage") == "fallback"), F.when(F.col("forced_finish"), "fallback-budget").otherwise("fallback-miss"))
        .when(F.col("cand_recall"), "rank>k")
        .when(F.col("stage") == "fallback", "fallback-miss")
    )


def score_run(runs: DataFrame, findings: DataFrame, targets: DataFrame, specs: DataFrame, candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Every run of a known query with its scores: hits, hallucinations, recall of candidates, stage checks and failure class. Findings of rows in error don't count."""
    # runs with their query and what its files are, and findings that count, are written once for all that reads them
    runs, goals = cut(runs.join(apart(specs), "query_id")), cut(goals_by_path(targets))
    live = cut(live_findings(findings, runs))
    judged = scored_findings(live, files).groupBy("run_id").agg(F.bool_and("path_valid").alias("path_valid_all"), F.count("hallucination").alias("n_hallucinations"), F.count_if(F.col("hallucination").isin("fabricated_path", "fabricated_snippet")).alias("n_made_up"))
    rows = runs.join(apart(_matches(runs, live, goals)), "run_id").join(apart(_recalled(runs, candidates, goals)), "run_id", "left").join(apart(judged), "run_id", "left")
    rows = rows.withColumns({"path_valid_all": F.coalesce("path_valid_all", F.lit(True)), "n_hallucinations": F.coalesce("n_hallucinations", F.lit(0)), "n_made_up": F.coalesce("n_made_up", F.lit(0))})
    return rows.withColumns({
        "hallucinated": F.col("n_hallucinations") > 0,
        "stage_match": F.coalesce(F.col("stage_expected") == F.coalesce("stage", F.lit("")), F.lit(True)),
        "confident_wrong": F.coalesce((F.col("stage") == "early-exit") & ~F.col("file_hit_any"), F.lit(False)),
        "attribution": attribution_class(),
    })


def stage_agreement(stage_exit: Column, stage: Column) -> Column:
    """Whether an answer's stage is the log's; null where the answer names none."""
    return F.when(stage_exit.isNotNull(), stage_exit.eqNullSafe(stage))


def query_summary(scored: DataFrame) -> DataFrame:
    """(repo, query_id, cat, n_passes, n_ok, classification, any_hallucination, any_confident_wrong, stages_seen) of all passes of a query."""
    ok = F.col("file_hit_any") | F.coalesce(F.col("is_negative") & (F.col("negative_ok") == 1.0), F.lit(False))
    rows = scored.groupBy("repo", "query_id").agg(F.min("cat").alias("cat"), F.count("*").alias("n_passes"), F.count_if(ok).alias("n_ok"), F.bool_or("hallucinated").alias("any_hallucination"), F.bool_or("confident_wrong").alias("any_confident_wrong"), F.array_join(F.sort_array(F.collect_set("stage")), ",").alias("stages_seen"))
    return rows.withColumn("classification", F.when(F.col("n_ok") == F.col("n_passes"), "pass").when(F.col("n_ok") == 0, "deterministic_failure").otherwise("flaky"))


def category_hits(scored: DataFrame) -> DataFrame:
    """(cat, n, rate, low, high, n_negative, negative_ok): hits among the first three files without negative queries, and the mean of these."""
    own = ~F.col("is_negative")
    by = scored.groupBy("cat").agg(F.count_if(own).alias("n"), F.count_if(own & F.col("file_hit_3")).alias("hits"), F.count_if("is_negative").alias("n_negative"), F.avg("negative_ok").alias("negative_ok"))
    rate, low, high = wilson(F.col("hits"), F.col("n"))
    return by.select("cat", "n", rate.alias("rate"), low.alias("low"), high.alias("high"), "n_negative", "negative_ok")


def leg_health(done: DataFrame, failed: DataFrame) -> DataFrame:
    """(leg, runs, failed, with_hits, median_ms, memory_dead) from legs that ended (run_id, leg, hits, duration_ms) and that failed (run_id, leg).

    The median is the upper one of two. memory_dead tells that memory legs ran and none of them found anything in the whole run.
    """
    leg = F.coalesce("leg", F.lit("?")).alias("leg")
    rows = done.select(leg, (F.coalesce("hits", F.lit(0)) > 0).cast("int").alias("hit"), F.lit(0).alias("bad"), F.coalesce("duration_ms", F.lit(0)).cast("double").alias("ms")).unionByName(failed.select(leg, F.lit(0).alias("hit"), F.lit(1).alias("bad"), F.lit(None).cast("double").alias("ms")))
    by = quantiles(rows, ["leg"], "ms", {"median_ms": lambda n: F.floor(n / 2) + 1}, F.count("*").alias("runs"), F.sum("bad").alias("failed"), F.sum("hit").alias("with_hits")).select("leg", "runs", "failed", "with_hits", "median_ms")
    memory = F.col("leg").isin(*MEMORY_LEGS)
    dead = by.agg((F.count_if(memory) > 0).alias("ran"), F.coalesce(F.sum(F.when(memory, F.col("with_hits"))), F.lit(0)).alias("found"))
    return by.crossJoin(F.broadcast(dead)).withColumn("memory_dead", F.col("ran") & (F.col("found") == 0)).drop("ran", "found")


def cost_report(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: usd, priced calls, calls by model without a price, rows fully priced, rows, usd a query (null if any call has no price).

    calls: (run_id, model, prompt_tokens, completion_tokens, reasoning_tokens), prices: (model, usd_in, usd_out) by million.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    usd = (zero("prompt_tokens") * F.col("usd_in") + (zero("completion_tokens") + zero("reasoning_tokens")) * F.col("usd_out")) / 1e6
    rows = calls.join(F.broadcast(prices), "model", "left").withColumn("usd", usd)
    by_model = rows.groupBy("model").agg(F.count("*").alias("n"), F.count("usd").alias("priced"), F.sum("usd").alias("usd"))
    total = by_model.agg(F.sum("usd").alias("usd_total_priced"), F.sum("priced").alias("priced_calls"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("priced") == 0, F.concat("model", F.lit("="), F.col("n").cast("string"))))), ",").alias("unpriced"))
    by_run = rows.groupBy("run_id").agg(F.bool_and(F.col("usd").isNotNull()).alias("full")).agg(F.count_if("full").alias("rows_fully_priced"), F.count("*").alias("n_rows"))
    return total.crossJoin(F.broadcast(by_run)).withColumn("usd_per_query", F.when(F.col("unpriced") == "", F.col("usd_total_priced") / F.col("n_rows")))


def cache_ratio(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: tokens read from caches over prompt tokens; where no row tells what it read, the calls do; null where either is missing."""
    read = rows.agg(F.sum("cache_read_tokens").alias("own"), F.sum("cache_write_tokens").alias("cache_write_tokens"))
    used = calls.agg(F.sum("cached_tokens").alias("by_call"), F.sum("prompt_tokens").alias("prompt_tokens"))
    both = read.crossJoin(F.broadcast(used)).withColumn("cache_read_tokens", F.coalesce("own", "by_call"))
    return both.select("cache_read_tokens", "cache_write_tokens", "prompt_tokens", F.try_divide(F.col("cache_read_tokens").cast("double"), F.col("prompt_tokens").cast("double")).alias("ratio"), F.col("cache_read_tokens").isNotNull().alias("reported"))


def provider_usage(calls: DataFrame) -> DataFrame:
    """(run_id, n_calls, prompt, completion, reasoning, cached): sums of what calls report; null where none does, which is not 0."""
    return calls.groupBy("run_id").agg(F.count("*").alias("n_calls"), *(F.sum(f"{c}_tokens").alias(c) for c in ("prompt", "completion", "reasoning", "cached")))


def model_drift(calls: DataFrame, pinned: str) -> DataFrame:
    """One row: models served, those that aren't the pinned one, and calls that didn't end well."""
    served = F.sort_array(F.collect_set("model"))
    row = calls.agg(served.alias("served"), F.count_if(~F.coalesce(F.col("outcome") == "ok", F.lit(False))).alias("events"))
    return row.select(F.array_join("served", ",").alias("served"), F.array_join(F.array_except("served", F.array(F.lit(pinned))), ",").alias("drift"), "events")


def answer_rates(scored: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: shares of well-formed answers and of stages that agree with the log, both over rows that have any, and of findings whose path is made up."""
    valid, agree = schema_valid(F.col("response_stage_exit"), F.col("response_confidence")), stage_agreement(F.col("response_stage_exit"), F.col("stage"))
    rows = scored.agg(F.count(valid).alias("schema_judged"), F.avg(valid.cast("double")).alias("schema_valid_rate"), F.avg(agree.cast("double")).alias("log_agreement"))
    made_up = findings.agg(F.count("*").alias("n_findings"), F.count_if(F.col("hallucination") == "fabricated_path").alias("fabricated_paths"))
    return rows.crossJoin(F.broadcast(made_up)).withColumn("hallucinated_path_rate", F.try_divide(F.col("fabricated_paths").cast("double"), F.col("n_findings").cast("double")))


def location_subtypes(scored: DataFrame, findings: DataFrame) -> DataFrame:
    """(stage, range_outside_file, misaligned_snippet): findings whose lines are wrong, by the stage that gave them."""
    rows = findings.where(F.col("hallucination").isin("range_outside_file", "misaligned_snippet")).join(apart(scored.select("run_id", F.coalesce("stage", F.lit("<none>")).alias("stage"))), "run_id")
    return rows.groupBy("stage").agg(*(F.count_if(F.col("hallucination") == x).alias(x) for x in ("range_outside_file", "misaligned_snippet")))


#: What a judge tells of itself: kinds that are counted, and numbers.
JUDGE_KINDS = ("judge_mode", "fallback_mode", "judge_outcome", "shadow_agreement")
JUDGE_NUMBERS = ("judge_ms", "judge_candidates", "judge_selected", "judge_max_p")


def judge_report(rows: DataFrame) -> DataFrame:
    """(metric, value): how often each mode, fallback, outcome and agreement of a judge was told, the distributions of its numbers, and the share of its selections that met the model's.

    What no row tells has no metric, which is not 0: a run without a judge reports nothing.
    """
    kinds = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("x")) for c in JUDGE_KINDS))).alias("k")).select("k.*").where("x is not null")
    counted = kinds.groupBy("name", "x").agg(F.count("*").cast("double").alias("value")).select(F.concat_ws(".", "name", "x").alias("metric"), "value")
    numbers = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in JUDGE_NUMBERS))).alias("k")).select("k.*").where("x is not null")
    by = distribution(numbers, ["name"], "x").withColumn("n", F.col("n").cast("double"))
    spread = by.select("name", F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.col(m).alias("value")) for m in ("n", "mean", "p50", "p95")))).alias("v")).select(F.concat_ws(".", "name", "v.m").alias("metric"), "v.value")
    rate = judge_agreement(rows).where("rate is not null").select(F.lit("shadow_agreement_rate").alias("metric"), F.col("rate").alias("value"))
    return counted.unionByName(spread).unionByName(rate)


def judge_agreement(rows: DataFrame) -> DataFrame:
    """One row: how often a judge's selection (shadow_agreement: exact, overlap, disjoint) met the model's; null if it never ran."""
    n = lambda x: F.count_if(F.col("shadow_agreement") == x)
    by = rows.agg(n("exact").alias("exact"), n("overlap").alias("overlap"), n("disjoint").alias("disjoint"), F.count_if(F.startswith("shadow_agreement", F.lit("x-"))).alias("escalated"))
    return by.withColumn("rate", F.try_divide((F.col("exact") + F.col("overlap")).cast("double"), (F.col("exact") + F.col("overlap") + F.col("disjoint")).cast("double")))


def agreement_class(selected: Column, findings: Column) -> Column:
    """exact, overlap, disjoint of two sets of indexes; x-escalated where nothing was selected (null)."""
    a, b = F.sort_array(F.array_distinct(selected)), F.sort_array(F.array_distinct(findings))
    return F.when(selected.isNull(), "x-escalated").when(a == b, "exact").when(F.size(F.array_intersect(selected, findings)) > 0, "overlap").otherwise("disjoint")


def cache_savings(rows: DataFrame) -> DataFrame:
    """One row: hits over all rows, by layer where any hit names one, and turns and tokens saved over hits alone."""
    hit = F.col("stage") == "cache"
    layer = lambda x: F.when(F.count(F.when(hit, F.col("cache_layer"))) > 0, F.count_if(hit & (F.col("cache_layer") == x)) / F.count("*")).alias(f"hit_{x}")
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(hit).alias("hit_rows"), (F.count_if(hit) / F.count("*")).alias("hit_rate"), layer("l1"), layer("l2"), F.avg("turns_saved").alias("turns_saved"), F.avg("tokens_saved").alias("tokens_saved"))


def efficiency_report(scored: DataFrame) -> DataFrame:
    """(metric, value): distributions of latency, calls and tokens (those of rows with calls apart) and shares of stages, one pass each, with no row where there is nothing to tell."""
    measured = ("latency_ms", "llm_calls", "tokens", "tokens_llm")
    with_calls = scored.withColumn("tokens_llm", F.when(F.col("llm_calls") > 0, F.col("tokens")))
    stacked = with_calls.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in measured))).alias("m")).select("m.*")
    by = distribution(stacked, ["name"], "x").withColumn("n", F.col("n").cast("double"))
    # a measure is told of even if there are no rows at all
    names = scored.sparkSession.createDataFrame([(c,) for c in measured], "name string").join(by, "name", "left").fillna(0.0, ["n"])
    flat = names.select("name", F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.col(m).alias("value")) for m in ("n", "mean", "p50", "p95")))).alias("v")).select(F.concat_ws(".", "name", "v.m").alias("metric"), "v.value").where("value is not null")
    total = scored.agg(F.count("*").alias("all"))
    stages = scored.groupBy(F.coalesce("stage", F.lit("<none>")).alias("stage")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    return flat.unionByName(stages.select(F.concat(F.lit("stage_exit."), "stage").alias("metric"), (F.col("n") / F.col("all")).alias("value")))


def compared_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, before, after, change) of two reports; a metric that one lacks has no change."""
    both = a.select("metric", F.col("value").alias("before")).join(b.select("metric", F.col("value").alias("after")), "metric", "full")
    return both.withColumn("change", F.col("after") - F.col("before"))


def promoted(agreement: DataFrame, errors: DataFrame, least: float = 0.8) -> DataFrame:
    """One row: whether a judge may take over: agreement (rate) of at least ``least``, none of the errors (n)."""
    return agreement.select("rate").crossJoin(F.broadcast(errors.select("n"))).select("rate", F.col("n").alias("errors"), (F.coalesce(F.col("rate") >= least, F.lit(False)) & (F.col("n") == 0)).alias("promoted"))


# The columns of the metrics file, in their order.
METRICS_COLUMNS = """run_id repo pass query_id cat stage early_exit_route llm_calls tokens prompt_tokens completion_tokens reasoning_tokens
cache_read_tokens cache_write_tokens cost_usd latency_ms total_ms confidence candidate_count brief_tokens orientation_calls_in_loop cache_layer
turns_saved_by_cache tokens_saved_by_cache cited_candidate_ids judge_mode fallback_mode judge_outcome judge_ms judge_candidates judge_selected
judge_max_p shadow_agreement""".split()


def metrics_rows(rows: DataFrame) -> DataFrame:
    """Rows with the columns of the metrics file alone, as text and in their order: what is missing is empty, costs have six digits, lists are joined by a blank."""
    kinds = dict(rows.dtypes)

    def text(c: str) -> Column:
        if c not in kinds:
            return F.lit("")
        x = F.format_string("%.6f", F.col(c).cast("double")) if c == "cost_usd" else F.array_join(F.col(c).cast("array<string>"), " ") if kinds[c].startswith("array") else F.col(c).cast("string")
        return F.when(F.col(c).isNull(), "").otherwise(x)

    return rows.select(*(text(c).alias(c) for c in METRICS_COLUMNS))


def write_metrics_csv(rows: DataFrame, report: DataFrame, path: str) -> None:
    """Two CSV folders with headers: a row a run with the fixed columns, and metric,value."""
    metrics_rows(rows).write.option("header", True).option("emptyValue", "").mode("overwrite").csv(f"{path}/runs")
    report.select("metric", "value").write.option("header", True).mode("overwrite").csv(f"{path}/aggregate")


def append_telemetry(rows: DataFrame, path: str) -> None:
    """Adds rows as JSON lines to what is there."""
    rows.write.mode("append").json(path)
