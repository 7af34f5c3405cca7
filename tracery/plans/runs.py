"""Registered queries on runs, derived from the order tables: an order is a run of its customer's query, its lines are findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as op
from .queries import LINES, _files, _t, query

STAGE = "CASE o_orderkey % 5 WHEN 0 THEN 'early-exit' WHEN 1 THEN 'verify' WHEN 2 THEN 'fallback' WHEN 3 THEN 'cache' END"
RUNS = f"""runs AS (SELECT o_orderkey AS run_id, o_custkey AS query_id, o_orderpriority AS repo, {STAGE} AS stage, o_orderkey % 29 = 0 AS is_error, o_orderkey % 31 = 0 AS timeout, o_orderkey % 4 < 2 AS forced_finish, CASE WHEN o_orderkey % 7 > 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN 'odd' ELSE {STAGE} END END AS response_stage_exit, CASE WHEN o_orderkey % 7 > 1 THEN o_orderkey % 104 END AS response_confidence FROM orders)"""
FINDINGS = """findings AS (SELECT l_orderkey AS run_id, l_linenumber AS pos, CASE WHEN l_partkey % 2 = 1 THEN './' ELSE '' END||'p'||(l_partkey % 50) AS path, CASE WHEN l_suppkey % 10 > 0 THEN l_partkey % 40 + 1 END AS line_start, CASE WHEN l_suppkey % 10 > 0 THEN l_partkey % 40 + 1 + l_quantity::BIGINT % 30 END AS line_end, NULL::VARCHAR AS snippet FROM lineitem)"""
SPECS = """specs AS (SELECT c_custkey AS query_id, c_mktsegment AS cat, CASE WHEN c_custkey % 2 = 0 THEN 'all' ELSE 'any' END AS primary_mode, CASE c_custkey % 4 WHEN 0 THEN 'verify' WHEN 1 THEN 'early-exit' END AS stage_expected FROM customer)"""
TARGETS = """targets AS (SELECT c_custkey AS query_id, 'primary' AS role, 'p'||(c_custkey % 50) AS path, 5 AS span_start, 12 AS span_end FROM customer WHERE c_custkey % 11 > 0
UNION ALL SELECT c_custkey, 'primary', 'p'||((c_custkey + 1) % 50), NULL, NULL FROM customer WHERE c_custkey % 11 > 0 AND c_custkey % 5 = 0
UNION ALL SELECT c_custkey, 'equivalent', 'p'||((c_custkey + 7 + i) % 50), 1, 30 FROM customer, range(2) r(i) WHERE c_custkey % 11 > 0 AND c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'distractor', 'p'||((c_custkey + 3) % 50), NULL, NULL FROM customer)"""
CANDIDATES = "candidates AS (SELECT l_orderkey AS run_id, 'p'||(l_suppkey % 50) AS path, l_linenumber AS rank, l_returnflag AS kind FROM lineitem WHERE l_orderkey % 13 > 0)"
FILES = "fl AS (SELECT 'p'||(p_partkey % 50) AS path, max(p_size) AS n FROM part WHERE p_partkey % 50 < 45 GROUP BY 1)"
JUDGED = f"""{RUNS}, {FINDINGS}, {SPECS}, {TARGETS}, {CANDIDATES}, {FILES},
live AS (SELECT f.run_id, pos, regexp_replace(f.path, '^\\./', '') AS path, line_start, line_end FROM findings f JOIN runs r ON f.run_id = r.run_id WHERE NOT is_error),
hal AS (SELECT live.*, CASE WHEN n IS NULL THEN 'fabricated_path' WHEN line_start IS NOT NULL AND NOT (line_start >= 1 AND line_start <= line_end AND line_end <= n) THEN 'range_outside_file' END AS hallucination FROM live LEFT JOIN fl USING (path))"""
SCORED = f"""{JUDGED}, fr AS (SELECT run_id, path, row_number() OVER (PARTITION BY run_id ORDER BY min(pos), path) AS file_rank FROM live GROUP BY run_id, path),
g AS (SELECT r.run_id, coalesce((SELECT count(*) FROM live l WHERE l.run_id = r.run_id), 0) AS n_findings,
 (SELECT min(file_rank) FROM fr JOIN targets t ON fr.path = t.path WHERE fr.run_id = r.run_id AND t.query_id = r.query_id AND role <> 'distractor') AS best,
 (SELECT count(*) FROM targets t WHERE t.query_id = r.query_id AND role = 'primary') AS n_primary,
 (SELECT count(DISTINCT t.path) FROM fr JOIN targets t ON fr.path = t.path WHERE fr.run_id = r.run_id AND t.query_id = r.query_id AND role = 'primary') AS primaries,
 (SELECT count(*) FROM targets t WHERE t.query_id = r.query_id AND role = 'equivalent') AS n_equivalent,
 (SELECT count(*) FROM fr JOIN targets t ON fr.path = t.path WHERE fr.run_id = r.run_id AND t.query_id = r.query_id AND role = 'equivalent') AS members,
 (SELECT count(*) FROM fr JOIN targets t ON fr.path = t.path WHERE fr.run_id = r.run_id AND t.query_id = r.query_id AND role = 'distractor') > 0 AS twin_confusion,
 (SELECT count(*) FROM live l JOIN targets t ON l.path = t.path WHERE l.run_id = r.run_id AND t.query_id = r.query_id AND role <> 'distractor' AND span_start IS NOT NULL AND line_start <= span_end AND span_start <= line_end AND line_end - line_start + 1 <= greatest(3 * greatest(1, span_end - span_start + 1), 40)) > 0 AS range_hit,
 (SELECT count(*) FROM candidates c WHERE c.run_id = r.run_id) AS n_candidates,
 (SELECT min(rank) FROM candidates c JOIN targets t ON c.path = t.path WHERE c.run_id = r.run_id AND t.query_id = r.query_id AND role <> 'distractor') AS cand_rank,
 (SELECT arg_min(kind, (rank, kind)) FROM candidates c JOIN targets t ON c.path = t.path WHERE c.run_id = r.run_id AND t.query_id = r.query_id AND role <> 'distractor') AS cand_kind,
 (SELECT count(hallucination) FROM hal h WHERE h.run_id = r.run_id) AS n_hallucinations,
 (SELECT count(*) FROM hal h WHERE h.run_id = r.run_id AND hallucination = 'fabricated_path') AS n_made_up
 FROM runs r),
s1 AS (SELECT r.*, cat, stage_expected, n_findings, coalesce(best = 1, false) AS file_hit_1, coalesce(best <= 3, false) AS file_hit_3, best IS NOT NULL AS file_hit_any, range_hit, n_primary = 0 AND n_equivalent = 0 AS is_negative,
 CASE WHEN primary_mode = 'all' AND n_primary > 0 THEN primaries / n_primary::DOUBLE WHEN best IS NOT NULL OR n_primary + n_equivalent = 0 AND n_findings = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall, twin_confusion, members >= 2 AS dedupe_defect,
 CASE WHEN n_primary + n_equivalent = 0 THEN CASE WHEN n_findings = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END END AS negative_ok, CASE WHEN n_candidates > 0 AND n_primary + n_equivalent > 0 THEN cand_rank IS NOT NULL END AS cand_recall, cand_rank, cand_kind, n_made_up = 0 AS path_valid_all, n_hallucinations > 0 AS hallucinated, n_made_up
 FROM runs r JOIN g USING (run_id) JOIN specs USING (query_id)),
scored AS (SELECT * EXCLUDE (n_made_up), coalesce(stage_expected = coalesce(stage, ''), true) AS stage_match, coalesce(stage = 'early-exit' AND NOT file_hit_any, false) AS confident_wrong,
 CASE WHEN file_hit_any OR coalesce(is_negative AND negative_ok = 1, false) THEN NULL WHEN timeout THEN 'timeout' WHEN is_error THEN 'error' WHEN n_made_up > 0 THEN 'fabricated-path' WHEN NOT cand_recall THEN 'retrieval-miss' WHEN cand_recall AND stage = 'verify' THEN 'verify-rejected-correct' WHEN cand_recall AND stage = 'fallback' THEN CASE WHEN forced_finish THEN 'fallback-budget' ELSE 'fallback-miss' END WHEN cand_recall THEN 'rank>k' WHEN stage = 'fallback' THEN 'fallback-miss' END AS attribution FROM s1)"""


def _runs(spark, sf):
    k = F.col("o_orderkey")
    stage = F.when(k % 5 == 0, "early-exit").when(k % 5 == 1, "verify").when(k % 5 == 2, "fallback").when(k % 5 == 3, "cache")
    named = F.when(k % 7 > 0, F.when(k % 11 == 0, "odd").otherwise(stage))
    return _t(spark, sf, "orders").select(k.alias("run_id"), F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("repo"), stage.alias("stage"), (k % 29 == 0).alias("is_error"), (k % 31 == 0).alias("timeout"), (k % 4 < 2).alias("forced_finish"), named.alias("response_stage_exit"), F.when(k % 7 > 1, k % 104).alias("response_confidence"))


def _findings(spark, sf):
    start = F.when(F.col("l_suppkey") % 10 > 0, F.col("l_partkey") % 40 + 1)
    path = F.concat(F.when(F.col("l_partkey") % 2 == 1, "./").otherwise(""), F.lit("p"), (F.col("l_partkey") % 50).cast("string"))
    return _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("pos"), path.alias("path"), start.alias("line_start"), (start + F.col("l_quantity").cast("long") % 30).alias("line_end"), F.lit(None).cast("string").alias("snippet"))


def _specs(spark, sf):
    k = F.col("c_custkey")
    return _t(spark, sf, "customer").select(k.alias("query_id"), F.col("c_mktsegment").alias("cat"), F.when(k % 2 == 0, "all").otherwise("any").alias("primary_mode"), F.when(k % 4 == 0, "verify").when(k % 4 == 1, "early-exit").alias("stage_expected"))


def _targets(spark, sf):
    k = F.col("c_custkey")
    one = lambda role, add, a, b, where: _t(spark, sf, "customer").where(where).select(k.alias("query_id"), F.lit(role).alias("role"), F.concat(F.lit("p"), ((k + add) % 50).cast("string")).alias("path"), F.lit(a).cast("int").alias("span_start"), F.lit(b).cast("int").alias("span_end"))
    own = "c_custkey % 11 > 0"
    rows = one("primary", 0, 5, 12, own).union(one("primary", 1, None, None, f"{own} and c_custkey % 5 = 0"))
    for i in (7, 8):
        rows = rows.union(one("equivalent", i, 1, 30, f"{own} and c_custkey % 3 = 0"))
    return rows.union(one("distractor", 3, None, None, "true"))


def _candidates(spark, sf):
    return _t(spark, sf, "lineitem").where("l_orderkey % 13 > 0").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("p"), (F.col("l_suppkey") % 50).cast("string")).alias("path"), F.col("l_linenumber").alias("rank"), F.col("l_returnflag").alias("kind"))


def _run_files(spark, sf):
    k = F.col("p_partkey") % 50
    return _t(spark, sf, "part").where(k < 45).groupBy(F.concat(F.lit("p"), k.cast("string")).alias("path")).agg(F.max("p_size").alias("n")).select("path", F.expr("repeat('x\n', n)").alias("content"))


def _scored(spark, sf):
    return op.score_run(_runs(spark, sf), _findings(spark, sf), _targets(spark, sf), _specs(spark, sf), _candidates(spark, sf), _run_files(spark, sf))


@query(f"WITH {SCORED} SELECT * FROM scored")
def score_run(spark, sf):
    return _scored(spark, sf).drop("primary_mode", "n_hallucinations", "n_made_up")


@query(f"""WITH {SCORED} SELECT repo, query_id, min(cat) AS cat, count(*) AS n_passes, count(*) FILTER (file_hit_any OR coalesce(is_negative AND negative_ok = 1, false)) AS n_ok, bool_or(hallucinated) AS any_hallucination, bool_or(confident_wrong) AS any_confident_wrong, coalesce(string_agg(DISTINCT stage, ',' ORDER BY stage), '') AS stages_seen, CASE WHEN count(*) FILTER (file_hit_any OR coalesce(is_negative AND negative_ok = 1, false)) = count(*) THEN 'pass' WHEN count(*) FILTER (file_hit_any OR coalesce(is_negative AND negative_ok = 1, false)) = 0 THEN 'deterministic_failure' ELSE 'flaky' END AS classification FROM scored GROUP BY 1, 2""")
def query_summary(spark, sf):
    return op.query_summary(_scored(spark, sf))


@query(f"""WITH {SCORED}, b AS (SELECT cat, count(*) FILTER (NOT is_negative) AS n, count(*) FILTER (NOT is_negative AND file_hit_3) AS h, count(*) FILTER (is_negative) AS n_negative, avg(negative_ok) AS negative_ok FROM scored GROUP BY 1), z AS (SELECT *, h / n::DOUBLE AS p, 1.959963984540054::DOUBLE AS z FROM b)
SELECT cat, n, round(p, 9) AS rate, round(greatest(0, (p + z*z/2/n) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/4/(n*n::DOUBLE)) / (1 + z*z/n)), 9) AS low, round(least(1, (p + z*z/2/n) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/4/(n*n::DOUBLE)) / (1 + z*z/n)), 9) AS high, n_negative, round(negative_ok, 9) AS negative_ok FROM z""")
def category_hits(spark, sf):
    rows = op.category_hits(_scored(spark, sf))
    return rows.select("cat", "n", *(F.round(c, 9).alias(c) for c in ("rate", "low", "high")), "n_negative", F.round("negative_ok", 9).alias("negative_ok"))


@query(f"""WITH {SCORED}, v AS (SELECT *, CASE WHEN response_stage_exit IS NOT NULL OR response_confidence IS NOT NULL THEN coalesce(response_stage_exit IN ('early-exit', 'verify', 'fallback', 'cache'), false) AND coalesce(response_confidence BETWEEN 0 AND 100, false) END AS valid, CASE WHEN response_stage_exit IS NOT NULL THEN response_stage_exit IS NOT DISTINCT FROM stage END AS agree FROM scored), f AS (SELECT count(*) AS n_findings, count(*) FILTER (hallucination = 'fabricated_path') AS fabricated_paths FROM hal)
SELECT count(valid) AS schema_judged, round(avg(valid::INT), 9) AS schema_valid_rate, round(avg(agree::INT), 9) AS log_agreement, any_value(n_findings) AS n_findings, any_value(fabricated_paths) AS fabricated_paths, round(any_value(fabricated_paths) / any_value(n_findings)::DOUBLE, 9) AS hallucinated_path_rate FROM v, f""".replace("any_value(n_findings)", "any_value(f.n_findings)"))
def answer_rates(spark, sf):
    runs = _runs(spark, sf)
    found = op.scored_findings(op.live_findings(_findings(spark, sf), runs), _run_files(spark, sf))
    rows = op.answer_rates(_scored(spark, sf), found)
    return rows.select("schema_judged", "n_findings", "fabricated_paths", *(F.round(c, 9).alias(c) for c in ("schema_valid_rate", "log_agreement", "hallucinated_path_rate")))


@query(f"""WITH {JUDGED} SELECT coalesce(stage, '<none>') AS stage, count(*) FILTER (hallucination = 'range_outside_file') AS range_outside_file, 0 AS misaligned_snippet FROM hal JOIN runs USING (run_id) WHERE hallucination = 'range_outside_file' GROUP BY 1""")
def location_subtypes(spark, sf):
    found = op.scored_findings(op.live_findings(_findings(spark, sf), _runs(spark, sf)), _run_files(spark, sf))
    return op.location_subtypes(_runs(spark, sf), found)


@query(f"""WITH {LINES}, d AS (SELECT doc_id, path, p, 1 + doc_id % 5 AS line_start, 1 + doc_id % 5 + doc_id % 7 AS line_end, p[(doc_id % 11 + 1)::BIGINT] AS own FROM (SELECT d.doc_id, g.* FROM g JOIN documents d ON g.path = d.source||'/'||d.lang||'/'||d.doc_id)),
s AS (SELECT *, CASE WHEN doc_id % 17 = 0 THEN 'gone/' ELSE '' END||path AS cited, CASE WHEN trim(own) <> '' THEN CASE WHEN doc_id % 13 = 0 THEN own||' zzz' ELSE own END END AS snippet, len(p) AS n FROM d),
h AS (SELECT *, regexp_replace(trim(snippet), '\\s+', ' ', 'g') AS q, [i FOR x, i IN p IF contains(regexp_replace(trim(x), '\\s+', ' ', 'g'), regexp_replace(trim(snippet), '\\s+', ' ', 'g'))] AS spots FROM s)
SELECT doc_id, doc_id % 17 > 0 AS path_valid, CASE WHEN doc_id % 17 > 0 THEN line_end <= n END AS line_valid, CASE WHEN doc_id % 17 = 0 THEN 'fabricated_path' WHEN line_end > n THEN 'range_outside_file' WHEN snippet IS NULL THEN NULL WHEN len(spots) = 0 THEN 'fabricated_snippet' WHEN line_end - line_start >= n - 2 THEN NULL WHEN len([i FOR i IN spots IF i - 1 >= line_start - 4 AND i - 1 < least(n, line_end + 4)]) = 0 THEN 'misaligned_snippet' END AS hallucination FROM h""")
def snippet_check(spark, sf):
    docs = _t(spark, sf, "documents")
    files = _files(spark, sf)
    k = F.col("doc_id")
    rows = F.split("text", "\n")
    rows = F.when(F.element_at(rows, -1) == "", F.slice(rows, 1, F.size(rows) - 1)).otherwise(rows)
    path = F.concat(F.when(k % 17 == 0, "gone/").otherwise(""), F.concat_ws("/", "source", "lang", k.cast("string")))
    own = F.get(rows, (k % 11).cast("int"))
    snippet = F.when(F.trim(own) != "", F.when(k % 13 == 0, F.concat(own, F.lit(" zzz"))).otherwise(own))
    found = docs.select("doc_id", path.alias("path"), (1 + k % 5).cast("int").alias("line_start"), (1 + k % 5 + k % 7).cast("int").alias("line_end"), snippet.alias("snippet"))
    return op.scored_findings(found, files).select("doc_id", "path_valid", "line_valid", "hallucination")


EVENT_RUNS = "er AS (SELECT event_id AS run_id, CASE event_type WHEN 'click' THEN 'grep' WHEN 'view' THEN 'symbol' WHEN 'purchase' THEN 'bm25' WHEN 'signup' THEN 'file' END AS leg, value FROM events)"


@query(f"""WITH {EVENT_RUNS}, r AS (SELECT coalesce(leg, '?') AS leg, value >= 90 AS bad, CASE WHEN leg IN ('symbol', 'bm25') THEN 0 ELSE floor(value / 30) END AS hits, value FROM er),
b AS (SELECT leg, count(*) AS runs, count(*) FILTER (bad) AS failed, count(*) FILTER (NOT bad AND hits > 0) AS with_hits, list(value ORDER BY value) FILTER (NOT bad) AS l FROM r GROUP BY 1)
SELECT leg, runs, failed, with_hits, l[len(l) // 2 + 1] AS median_ms, (SELECT sum(with_hits) FROM b WHERE leg IN ('symbol', 'bm25')) = 0 AS memory_dead FROM b""")
def leg_health(spark, sf):
    leg = F.when(F.col("event_type") == "click", "grep").when(F.col("event_type") == "view", "symbol").when(F.col("event_type") == "purchase", "bm25").when(F.col("event_type") == "signup", "file")
    rows = _t(spark, sf, "events").select(F.col("event_id").alias("run_id"), leg.alias("leg"), F.when(leg.isin("symbol", "bm25"), 0).otherwise(F.floor(F.col("value") / 30)).alias("hits"), F.col("value").alias("duration_ms"))
    return op.leg_health(rows.where("duration_ms < 90"), rows.where("duration_ms >= 90").select("run_id", "leg"))


@query("""WITH p(model, i, o) AS (VALUES ('A', 3.0::DOUBLE, 15.0::DOUBLE), ('R', 0.3::DOUBLE, 2.5::DOUBLE)), c AS (SELECT l_orderkey AS run_id, l_returnflag AS model, (l_quantity * i + coalesce(l_suppkey, 0) * o) / 1e6 AS usd FROM lineitem LEFT JOIN p ON model = l_returnflag), r AS (SELECT run_id, bool_and(usd IS NOT NULL) AS fullp FROM c GROUP BY 1)
SELECT round(sum(usd), 6) AS usd_total_priced, count(usd) AS priced_calls, (SELECT string_agg(model||'='||n, ',' ORDER BY model) FROM (SELECT model, count(*) AS n FROM c GROUP BY 1 HAVING count(usd) = 0)) AS unpriced, (SELECT count(*) FILTER (fullp) FROM r) AS rows_fully_priced, (SELECT count(*) FROM r) AS n_rows, NULL::DOUBLE AS usd_per_query FROM c""")
def cost_report(spark, sf):
    calls = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("prompt_tokens"), F.col("l_suppkey").alias("completion_tokens"), F.lit(None).cast("double").alias("reasoning_tokens"))
    prices = spark.createDataFrame([("A", 3.0, 15.0), ("R", 0.3, 2.5)], "model string, usd_in double, usd_out double")
    return op.cost_report(calls, prices).withColumn("usd_total_priced", F.round("usd_total_priced", 6))


CALLS = "calls AS (SELECT l_orderkey AS run_id, l_returnflag AS model, CASE WHEN l_linestatus = 'O' THEN 'ok' ELSE 'retry' END AS outcome, l_quantity AS prompt_tokens, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey END AS completion_tokens, NULL::DOUBLE AS reasoning_tokens, CASE WHEN l_returnflag = 'N' THEN l_quantity / 2 END AS cached_tokens FROM lineitem)"


def _calls(spark, sf):
    return _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("model"), F.when(F.col("l_linestatus") == "O", "ok").otherwise("retry").alias("outcome"), F.col("l_quantity").alias("prompt_tokens"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey")).alias("completion_tokens"), F.lit(None).cast("double").alias("reasoning_tokens"), F.when(F.col("l_returnflag") == "N", F.col("l_quantity") / 2).alias("cached_tokens"))


@query(f"WITH {CALLS} SELECT run_id, count(*) AS n_calls, sum(prompt_tokens) AS prompt, sum(completion_tokens) AS completion, sum(reasoning_tokens) AS reasoning, sum(cached_tokens) AS cached FROM calls GROUP BY 1")
def provider_usage(spark, sf):
    return op.provider_usage(_calls(spark, sf))


@query(f"WITH {CALLS} SELECT string_agg(DISTINCT model, ',' ORDER BY model) AS served, string_agg(DISTINCT model, ',' ORDER BY model) FILTER (model <> 'A') AS drift, count(*) FILTER (outcome <> 'ok') AS events FROM calls")
def model_drift(spark, sf):
    return op.model_drift(_calls(spark, sf), "A")


@query(f"WITH {CALLS} SELECT sum(cached_tokens) AS cache_read_tokens, NULL::DOUBLE AS cache_write_tokens, sum(prompt_tokens) AS prompt_tokens, round(sum(cached_tokens) / sum(prompt_tokens), 9) AS ratio, true AS reported FROM calls")
def cache_ratio(spark, sf):
    none = F.lit(None).cast("double")
    rows = _t(spark, sf, "orders").select(none.alias("cache_read_tokens"), none.alias("cache_write_tokens"))
    return op.cache_ratio(rows, _calls(spark, sf)).withColumn("ratio", F.round("ratio", 9))


RUN_EVENTS = "re AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'early-exit' WHEN 'view' THEN 'verify' WHEN 'purchase' THEN 'cache' WHEN 'signup' THEN 'fallback' END AS stage, value AS latency_ms, CASE WHEN event_type <> 'purchase' THEN event_id % 4 END AS llm_calls, CASE WHEN event_type <> 'purchase' THEN (event_id * 37) % 5000 END AS tokens, CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'l1' ELSE 'l2' END END AS cache_layer, CASE event_id % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'overlap' WHEN 2 THEN 'disjoint' WHEN 3 THEN 'x-escalated' END AS shadow_agreement FROM events)"


def _run_events(spark, sf):
    k, kind = F.col("event_id"), F.col("event_type")
    cached = kind == "purchase"
    stage = F.when(kind == "click", "early-exit").when(kind == "view", "verify").when(cached, "cache").when(kind == "signup", "fallback")
    return _t(spark, sf, "events").select("event_id", stage.alias("stage"), F.col("value").alias("latency_ms"), F.when(~cached, k % 4).alias("llm_calls"), F.when(~cached, (k * 37) % 5000).alias("tokens"), F.when(cached, F.when(k % 3 == 0, "l1").otherwise("l2")).alias("cache_layer"), F.when(k % 5 == 0, "exact").when(k % 5 == 1, "overlap").when(k % 5 == 2, "disjoint").when(k % 5 == 3, "x-escalated").alias("shadow_agreement"), F.when(cached, k % 3).alias("turns_saved"), F.when(cached, (k * 11) % 900).alias("tokens_saved"))


DIST = " UNION ALL ".join(f"SELECT '{name}.'||m AS metric, v AS value FROM (SELECT unnest(['n', 'mean', 'p50', 'p95']) AS m, unnest([count(x)::DOUBLE, avg(x), quantile_disc(x, 0.5)::DOUBLE, quantile_disc(x, 0.95)::DOUBLE]) AS v FROM (SELECT {expr} AS x FROM re))" for name, expr in (("latency_ms", "latency_ms"), ("llm_calls", "llm_calls"), ("tokens", "tokens"), ("tokens_llm", "CASE WHEN llm_calls > 0 THEN tokens END")))


@query(f"WITH {RUN_EVENTS} SELECT metric, round(value, 6) AS value FROM ({DIST} UNION ALL SELECT 'stage_exit.'||coalesce(stage, '<none>'), count(*) / (SELECT count(*) FROM re)::DOUBLE FROM re GROUP BY stage)")
def efficiency_report(spark, sf):
    return op.efficiency_report(_run_events(spark, sf)).withColumn("value", F.round("value", 6))


@query(f"WITH {RUN_EVENTS}, w AS (SELECT metric, value, half FROM (SELECT event_id % 2 AS half, 'stage_exit.'||coalesce(stage, '<none>') AS metric, count(*) / sum(count(*)) OVER (PARTITION BY event_id % 2)::DOUBLE AS value FROM re GROUP BY 1, 2)) SELECT metric, round(a.value, 9) AS before, round(b.value, 9) AS after, round(b.value - a.value, 9) AS change FROM (SELECT * FROM w WHERE half = 0) a FULL JOIN (SELECT * FROM w WHERE half = 1) b USING (metric)")
def compare_runs(spark, sf):
    rows = _run_events(spark, sf)
    half = lambda n: op.efficiency_report(rows.where(F.col("event_id") % 2 == n)).where("metric like 'stage_exit.%'")
    return op.compared_runs(half(0), half(1)).select("metric", *(F.round(c, 9).alias(c) for c in ("before", "after", "change")))


@query("SELECT count(*) AS n_rows, count(*) FILTER (event_type = 'purchase') AS hit_rows, round(avg((event_type = 'purchase')::INT), 9) AS hit_rate, round(avg((event_type = 'purchase' AND event_id % 3 = 0)::INT), 9) AS hit_l1, round(avg((event_type = 'purchase' AND event_id % 3 > 0)::INT), 9) AS hit_l2, round(avg(CASE WHEN event_type = 'purchase' THEN event_id % 3 END), 9) AS turns_saved, round(avg(CASE WHEN event_type = 'purchase' THEN (event_id * 11) % 900 END), 9) AS tokens_saved FROM events")
def cache_savings(spark, sf):
    rows = op.cache_savings(_run_events(spark, sf))
    return rows.select("n_rows", "hit_rows", *(F.round(c, 9).alias(c) for c in ("hit_rate", "hit_l1", "hit_l2", "turns_saved", "tokens_saved")))


@query(f"WITH {RUN_EVENTS}, b AS (SELECT count(*) FILTER (shadow_agreement = 'exact') AS exact, count(*) FILTER (shadow_agreement = 'overlap') AS overlap, count(*) FILTER (shadow_agreement = 'disjoint') AS disjoint, count(*) FILTER (shadow_agreement = 'x-escalated') AS escalated FROM re) SELECT *, round((exact + overlap) / (exact + overlap + disjoint)::DOUBLE, 9) AS rate FROM b")
def judge_agreement(spark, sf):
    return op.judge_agreement(_run_events(spark, sf)).withColumn("rate", F.round("rate", 9))
