"""Registered queries on calibration, caches, logs and keyed streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import calibration, evaluation, incremental, ranking, retrieval
from ..operators import runs as run_ops
from ..sources import corpus, logs
from ..streaming import state, telemetry
from .queries import HITS, LINES, OUTLINE, RANKED, SCORED, _files, _hits, _labelled, _lines, _ranked, _scored, _t, query

BREAKDOWN = f"""{SCORED}, sx AS (SELECT s.*, d.lang FROM scored s JOIN documents d ON d.doc_id = s.rank), g AS (SELECT 'overall' AS key, 'all' AS value, * FROM sx UNION ALL SELECT 'lang', lang, * FROM sx),
base AS (SELECT key, value, count(*) AS n_rows, count(DISTINCT query_id) AS n_queries, count(*) FILTER (p >= 0.5) AS selected, sum(positive) FILTER (p >= 0.5) AS hits, sum(positive) AS all_pos FROM g GROUP BY ALL),
eb AS (SELECT key, value, count(*) AS n, avg(p) AS c, avg(positive) AS a FROM g GROUP BY key, value, greatest(0, least(14, ceil(p * 15) - 1))), e AS (SELECT key, value, sum(n * abs(c - a)) / sum(n) AS ece FROM eb GROUP BY ALL),
qb AS (SELECT key, value, query_id, max(positive) AS m, arg_min(positive, (-p, rank)) AS t, max(p) AS best FROM g GROUP BY ALL), q AS (SELECT key, value, avg(t) FILTER (m = 1) AS query_top1, avg((best < 0.5)::INT) FILTER (m = 0) AS none_rate FROM qb GROUP BY ALL),
ab AS (SELECT key, value, p, sum(positive) AS pos, sum(1 - positive) AS neg FROM g GROUP BY ALL), aw AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY key, value ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ab),
a AS (SELECT key, value, sum(pos * (below + neg / 2::DOUBLE)) / (sum(pos) * sum(neg)) AS auroc FROM aw GROUP BY ALL),
breakdown AS (SELECT key, value, n_rows, n_queries, round(auroc, 9) AS auroc, round(ece, 9) AS ece, round(query_top1, 9) AS query_top1, round(none_rate, 9) AS none_rate, round(hits / selected::DOUBLE, 9) AS precision, round(hits / all_pos::DOUBLE, 9) AS recall, selected FROM base JOIN e USING (key, value) JOIN q USING (key, value) JOIN a USING (key, value))"""


def _breakdown(spark, sf):
    lang = _t(spark, sf, "documents").select(F.col("doc_id").alias("rank"), "lang")
    rows = calibration.metric_breakdown(_scored(spark, sf).join(lang, "rank"), 0.5, ["lang"])
    return rows.select("key", "value", "n_rows", "n_queries", *(F.round(c, 9).alias(c) for c in ("auroc", "ece", "query_top1", "none_rate", "precision", "recall")), "selected")


@query(f"WITH {BREAKDOWN} SELECT * FROM breakdown")
def metric_breakdown(spark, sf):
    return _breakdown(spark, sf)


@query(f"""WITH {BREAKDOWN}, o AS (SELECT * FROM breakdown WHERE key = 'overall') SELECT 'query_top1' AS metric, query_top1 AS value, '>= 0.90' AS threshold, query_top1 >= 0.9 AS passed FROM o UNION ALL SELECT 'auroc', auroc, '>= 0.90', auroc >= 0.9 FROM o UNION ALL SELECT 'ece', ece, '<= 0.10', ece <= 0.1 FROM o UNION ALL SELECT 'precision', precision, '>= 0.85', precision >= 0.85 FROM o""")
def acceptance_gate(spark, sf):
    return calibration.acceptance_gate(_breakdown(spark, sf).where("key = 'overall'"))


@query(f"""WITH {SCORED}, m AS (SELECT s.*, CASE WHEN rank % 2 = 0 THEN 'even' ELSE 'odd' END AS model FROM scored s), t AS (SELECT unnest(range(30, 95, 5)) AS tau), g AS (SELECT model, min(tau) AS tau FROM (SELECT model, tau FROM t JOIN m ON p >= tau / 100::DOUBLE GROUP BY 1, 2 HAVING avg(positive) >= 0.9) GROUP BY 1),
p AS (SELECT m.*, coalesce(tau, 90) AS tau FROM m LEFT JOIN g USING (model)), b AS (SELECT model, p, sum(positive) AS pos, sum(1 - positive) AS neg FROM m GROUP BY 1, 2), w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b), a AS (SELECT model, sum(pos * (below + neg / 2::DOUBLE)) / (sum(pos) * sum(neg)) AS auroc FROM w GROUP BY 1)
SELECT model, any_value(tau) AS tau, count(*) AS n_rows, count(DISTINCT query_id) AS n_queries, count(*) FILTER (p >= tau / 100::DOUBLE) AS selected, round(sum(positive) FILTER (p >= tau / 100::DOUBLE) / count(*) FILTER (p >= tau / 100::DOUBLE)::DOUBLE, 9) AS precision, round(sum(positive) FILTER (p >= tau / 100::DOUBLE) / sum(positive)::DOUBLE, 9) AS recall, round(any_value(auroc), 9) AS auroc FROM p JOIN a USING (model) GROUP BY 1""")
def bake_off(spark, sf):
    rows = calibration.bake_off(_scored(spark, sf).withColumn("model", F.when(F.col("rank") % 2 == 0, "even").otherwise("odd")))
    return rows.select("model", "tau", "n_rows", "n_queries", "selected", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "auroc")))


@query(f"""WITH {SCORED}, b AS (SELECT query_id, max(positive) AS m, max(p) AS best FROM scored GROUP BY 1) SELECT count(*) AS n_queries, avg((best < 0.9)::INT) AS none_rate FROM b WHERE m = 0""")
def none_rate(spark, sf):
    return calibration.none_rate(_scored(spark, sf), 0.9)


@query(f"WITH {SCORED} SELECT query_id, rank, p, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, rank) AS place FROM scored WHERE p >= 0.5")
def selected_candidates(spark, sf):
    return ranking.selected(_scored(spark, sf), 0.5).select("query_id", "rank", "p", "place")


@query(f"""WITH {RANKED}, st AS (SELECT path, len(p) AS n FROM g), x AS (SELECT r.query_id, r.path, r.rank, CASE WHEN r.rank % 3 > 0 THEN (r.rank * 7 % 5) / 5::DOUBLE END AS p FROM ranked r JOIN st USING (path) WHERE line_start <= n)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p IS NULL, p DESC, rank) AS place FROM x) WHERE place <= 5""")
def offline_answers(spark, sf):
    ranked = _ranked(spark, sf)
    scores = ranked.where("rank % 3 > 0").select("query_id", "rank", ((F.col("rank") * 7 % 5) / 5).alias("p"))
    return ranking.offline_answers(ranked, scores, corpus.file_stats(_files(spark, sf))).select("query_id", "path", "rank", "p", "place")


@query(f"""WITH {HITS}, hl AS (SELECT DISTINCT path, line_no FROM hits), n AS (SELECT *, lag(line_no) OVER w AS prev, lead(line_no) OVER w AS nxt FROM hl WINDOW w AS (PARTITION BY path ORDER BY line_no)), x AS (SELECT n.*, g.p, greatest(line_no - 2, coalesce(prev + 2, 0) + 1, 1) AS h, least(line_no + 2, coalesce(nxt - 1, len(g.p)), len(g.p)) AS t FROM n JOIN g USING (path))
SELECT path, line_no, coalesce(array_to_string(CASE WHEN h < line_no THEN p[h:line_no - 1] ELSE [] END, chr(10)), '') AS before, coalesce(array_to_string(CASE WHEN t > line_no THEN p[line_no + 1:t] ELSE [] END, chr(10)), '') AS after FROM x""")
def context_lines(spark, sf):
    hits = _hits(spark, sf).select("path", "line_no").distinct()
    got = retrieval.context_lines(hits, _files(spark, sf))
    return got.select("path", "line_no", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


@query(f"""WITH {RANKED} SELECT query_id, rank, array_to_string(list_slice(string_split(text, chr(10)), greatest(1, line_start - 3), least(line_end + 5, len(string_split(text, chr(10))))), chr(10)) AS body FROM ranked JOIN f USING (path)""")
def body_windows(spark, sf):
    rows = retrieval.body_window(_ranked(spark, sf), _files(spark, sf))
    return rows.select("query_id", "rank", "body")


@query(f"""WITH {OUTLINE} SELECT qualified_name AS name, path, line_start, line_end, array_to_string(list_slice(string_split(text, chr(10)), line_start, line_end), chr(10)) AS body FROM symbols JOIN f USING (path)""")
def symbol_snippets(spark, sf):
    symbols = corpus.outline(_files(spark, sf)).drop("repo")
    wanted = symbols.select(F.col("qualified_name").alias("name")).distinct()
    return retrieval.snippets(wanted, symbols, _files(spark, sf)).select("name", "path", "line_start", "line_end", "body")


CITED = """reg AS (SELECT l_orderkey AS query_id, l_linenumber AS candidate_id, min('p'||(l_partkey % 9)) AS path, min(l_partkey % 30 + 1) AS c_start, min(l_partkey % 30 + 1) + 10 AS c_end FROM lineitem GROUP BY 1, 2),
fi AS (SELECT l_orderkey AS query_id, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS finding_id, (l_linenumber + l_suppkey % 2) AS candidate_id, CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE l_suppkey % 40 + 1 END AS line_start, CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE l_suppkey % 40 + 4 END AS line_end FROM lineitem)"""


def _cited(spark, sf):
    li = _t(spark, sf, "lineitem")
    start = F.col("l_partkey") % 30 + 1
    registry = li.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("candidate_id")).agg(F.min(F.concat(F.lit("p"), (F.col("l_partkey") % 9).cast("string"))).alias("path"), F.min(start).alias("c_start"), (F.min(start) + 10).alias("c_end"))
    unknown = F.col("l_suppkey") % 5 == 0
    key = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    found = key.withColumn("finding_id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return found.select(F.col("l_orderkey").alias("query_id"), "finding_id", (F.col("l_linenumber") + F.col("l_suppkey") % 2).cast("int").alias("candidate_id"), F.when(unknown, 0).otherwise(F.col("l_suppkey") % 40 + 1).alias("line_start"), F.when(unknown, 0).otherwise(F.col("l_suppkey") % 40 + 4).alias("line_end")), registry


SNAP = "line_start = 0 OR line_start <= c_end AND c_start <= line_end AND NOT (line_start > c_start AND line_end < c_end)"


@query(f"""WITH {CITED}, v AS (SELECT f.query_id, f.candidate_id, path, CASE WHEN {SNAP} THEN c_start ELSE line_start END AS line_start, CASE WHEN {SNAP} THEN c_end ELSE line_end END AS line_end FROM fi f LEFT JOIN reg USING (query_id, candidate_id)) SELECT * FROM v WHERE path IS NOT NULL""")
def resolved_citations(spark, sf):
    found, registry = _cited(spark, sf)
    return retrieval.resolved_citations(found, registry).drop("finding_id")


@query(f"""WITH {CITED}, v AS (SELECT f.query_id, f.candidate_id, path, bool_and(path IS NOT NULL) OVER (PARTITION BY f.query_id) AS ok FROM fi f LEFT JOIN reg USING (query_id, candidate_id)) SELECT query_id, candidate_id, path FROM v WHERE ok""")
def strict_citations(spark, sf):
    found, registry = _cited(spark, sf)
    return retrieval.resolved_citations(found, registry, strict=True).select("query_id", "candidate_id", "path")


@query(f"""WITH {OUTLINE}, fd AS (SELECT doc_id AS finding_id, source AS query_id, source||'/'||lang||'/'||doc_id AS path, doc_id % 6 + 1 AS s, doc_id % 6 + 2 AS e FROM documents), h AS (SELECT finding_id, count(*) AS n, any_value(qualified_name) AS symbol FROM fd JOIN symbols y ON fd.path = y.path AND s <= y.line_end AND y.line_start <= e GROUP BY 1) SELECT fd.finding_id, CASE WHEN n = 1 THEN symbol END AS symbol FROM fd LEFT JOIN h USING (finding_id)""")
def attributed_symbols(spark, sf):
    k = F.col("doc_id")
    found = _t(spark, sf, "documents").select(k.alias("finding_id"), F.col("source").alias("query_id"), F.concat_ws("/", "source", "lang", k.cast("string")).alias("path"), (k % 6 + 1).alias("line_start"), (k % 6 + 2).alias("line_end"))
    symbols = corpus.outline(_files(spark, sf)).select(F.col("repo").alias("query_id"), "path", "line_start", "line_end", F.col("qualified_name").alias("symbol"))
    return retrieval.attributed(found, symbols).select("finding_id", "symbol")


@query(f"""WITH {RANKED} SELECT query_id, path, rank FROM ranked r WHERE EXISTS (SELECT 1 FROM truth t WHERE t.query_id = r.query_id AND t.path = r.path AND line_start <= span_end AND span_start <= line_end)""")
def overlapping_findings(spark, sf):
    rows = _labelled(spark, sf)
    spans = rows.where("label = 'A'").select("query_id", "path", "line_start", "line_end")
    return retrieval.legs_overlap(rows.select("query_id", "path", "line_start", "line_end", "rank"), spans).select("query_id", "path", "rank")


@query(f"""WITH {LINES}, i AS (SELECT item_id AS query_id, lower(text) AS t FROM benchmark), w AS (SELECT DISTINCT query_id, unnest([trim(t)] || string_split_regex(t, '\\s+')) AS word FROM i),
c AS (SELECT word, path, count(*) AS n FROM (SELECT DISTINCT word FROM w WHERE word <> '') JOIN lines ON contains(lower(line), word) GROUP BY 1, 2),
h AS (SELECT query_id, path, sum(n)::BIGINT AS n FROM w JOIN c USING (word) GROUP BY 1, 2) SELECT query_id, path, n, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, path) AS rank FROM h""")
def naive_baseline(spark, sf):
    return evaluation.naive_search(_lines(spark, sf), _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


JUDGED_EVENTS = "je AS (SELECT CASE event_id % 7 WHEN 0 THEN 'shadow' WHEN 1 THEN 'active' END AS judge_mode, CASE WHEN event_id % 11 = 0 THEN 'offline' END AS fallback_mode, event_type AS judge_outcome, CASE event_id % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'overlap' WHEN 2 THEN 'disjoint' END AS shadow_agreement, value AS judge_ms, event_id % 12 AS judge_candidates, CASE WHEN event_id % 3 > 0 THEN event_id % 5 END AS judge_selected, NULL::DOUBLE AS judge_max_p FROM events)"
_KINDS = " UNION ALL ".join(f"SELECT '{c}.'||{c} AS metric, count(*)::DOUBLE AS value FROM je WHERE {c} IS NOT NULL GROUP BY 1" for c in run_ops.JUDGE_KINDS)
_NUMBERS = " UNION ALL ".join(f"SELECT '{c}.'||m, v FROM (SELECT unnest(['n', 'mean', 'p50', 'p95']) AS m, unnest([count({c})::DOUBLE, avg({c}), quantile_disc({c}, 0.5)::DOUBLE, quantile_disc({c}, 0.95)::DOUBLE]) AS v FROM je HAVING count({c}) > 0)" for c in run_ops.JUDGE_NUMBERS)


@query(f"WITH {JUDGED_EVENTS} SELECT metric, round(value, 6) AS value FROM ({_KINDS} UNION ALL {_NUMBERS} UNION ALL SELECT 'shadow_agreement_rate', count(*) FILTER (shadow_agreement IN ('exact', 'overlap')) / count(shadow_agreement)::DOUBLE FROM je)")
def judge_report(spark, sf):
    k = F.col("event_id")
    rows = _t(spark, sf, "events").select(F.when(k % 7 == 0, "shadow").when(k % 7 == 1, "active").alias("judge_mode"), F.when(k % 11 == 0, "offline").alias("fallback_mode"), F.col("event_type").alias("judge_outcome"), F.when(k % 5 == 0, "exact").when(k % 5 == 1, "overlap").when(k % 5 == 2, "disjoint").alias("shadow_agreement"), F.col("value").alias("judge_ms"), (k % 12).alias("judge_candidates"), F.when(k % 3 > 0, k % 5).alias("judge_selected"), F.lit(None).cast("double").alias("judge_max_p"))
    return run_ops.judge_report(rows).withColumn("value", F.round("value", 6))


DEPS = """en AS (SELECT o_orderkey AS key, o_custkey % 7 AS repo, CASE WHEN o_orderkey % 3 = 0 THEN 's1' ELSE 's0' END AS snapshot FROM orders), sn AS (SELECT DISTINCT o_custkey % 7 AS repo, 's1' AS now FROM orders WHERE o_custkey % 7 < 6),
dp AS (SELECT l_orderkey AS key, 'p'||(l_partkey % 20) AS path, (l_partkey % 20)::VARCHAR AS digest FROM lineitem WHERE l_orderkey % 4 > 0), fi AS (SELECT r.repo, 'p'||i AS path, CASE WHEN i = 7 THEN 'new' ELSE i::VARCHAR END AS digest FROM range(19) t(i), (SELECT DISTINCT o_custkey % 7 AS repo FROM orders) r)"""


@query(f"""WITH {DEPS}, st AS (SELECT en.key, bool_and(coalesce(dp.digest = fi.digest, false)) AS same FROM en JOIN dp USING (key) LEFT JOIN fi ON fi.repo = en.repo AND fi.path = dp.path GROUP BY 1) SELECT key, en.repo, snapshot, coalesce(snapshot = now, false) OR coalesce(same, false) AS valid FROM en LEFT JOIN sn USING (repo) LEFT JOIN st USING (key)""")
def cache_validity(spark, sf):
    k = F.col("o_orderkey")
    orders = _t(spark, sf, "orders")
    repo = (F.col("o_custkey") % 7).alias("repo")
    entries = orders.select(k.alias("key"), repo, F.when(k % 3 == 0, "s1").otherwise("s0").alias("snapshot"))
    now = orders.select(repo).distinct().where("repo < 6").withColumn("now", F.lit("s1"))
    n = (F.col("l_partkey") % 20).cast("string")
    deps = _t(spark, sf, "lineitem").where("l_orderkey % 4 > 0").select(F.col("l_orderkey").alias("key"), F.concat(F.lit("p"), n).alias("path"), n.alias("digest"))
    files = orders.select(repo).distinct().select("repo", F.explode(F.sequence(F.lit(0), F.lit(18))).alias("i")).select("repo", F.concat(F.lit("p"), F.col("i").cast("string")).alias("path"), F.when(F.col("i") == 7, "new").otherwise(F.col("i").cast("string")).alias("digest"))
    return incremental.still_valid(entries, deps, files, now)


@query("""WITH c AS (SELECT p_brand AS repo, p_partkey AS path FROM part), i AS (SELECT p_brand AS repo, p_partkey AS path, CASE WHEN p_brand = 'Brand#1' THEN 'stale' WHEN p_partkey % 2 = 0 THEN 'metadata_match' ELSE 'not_tracked' END AS freshness FROM part WHERE p_partkey % 500 <> 77) SELECT repo, bool_and(coalesce(freshness IN ('metadata_match', 'not_tracked'), false)) AS covered FROM c LEFT JOIN i USING (repo, path) GROUP BY 1""")
def index_coverage(spark, sf):
    rows = _t(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("path"))
    index = rows.where("path % 500 <> 77").withColumn("freshness", F.when(F.col("repo") == "Brand#1", "stale").when(F.col("path") % 2 == 0, "metadata_match").otherwise("not_tracked"))
    return incremental.index_covers(rows, index)


@query("""SELECT event_id AS repo, CASE WHEN event_type <> 'error' AND event_id % 3 = 0 AND event_id % 5 > 0 AND epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', ts)) <= 864000 THEN 'up-to-date' ELSE 'reindex' END AS decision FROM events""")
def index_freshness(spark, sf):
    k = F.col("event_id")
    probes = _t(spark, sf, "events").select(k.alias("repo"), (F.col("event_type") != "error").alias("exists"), F.when(k % 3 == 0, 0).when(k % 3 == 1, 2).alias("changed_files"), F.when(k % 5 > 0, F.col("ts")).alias("indexed_at"))
    return incremental.freshness(probes, F.lit("2024-02-01 00:00:00").cast("timestamp"), 864_000).select("repo", "decision")


@query("""SELECT event_id % 3 AS schema_version, count(*) AS entries, sum(length(props)) AS bytes, min(event_id) AS oldest, max(event_id) AS newest FROM events GROUP BY 1""")
def store_stats(spark, sf):
    return incremental.store_stats(_t(spark, sf, "events").select((F.col("event_id") % 3).alias("schema_version"), F.octet_length("props").alias("bytes"), F.col("event_id").alias("last_hit")))


@query("""SELECT grp, key FROM (SELECT user_id AS grp, event_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5""")
def fifo_cap(spark, sf):
    rows = _t(spark, sf, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("key"), F.col("ts").alias("inserted"))
    return incremental.latest_inserted(rows, "grp", 5).select("grp", "key")


@query("""WITH e AS (SELECT user_id AS grp, event_type AS key, length(props) AS bytes, event_id AS last_hit FROM events WHERE event_id % 4 > 0), m AS (SELECT grp, key, arg_max(bytes, last_hit) AS bytes, max(last_hit) AS last_hit FROM e GROUP BY 1, 2) SELECT grp, key, bytes, last_hit, total FROM (SELECT *, sum(bytes) OVER (PARTITION BY grp ORDER BY last_hit DESC, key ROWS UNBOUNDED PRECEDING) AS total FROM m) WHERE total <= 30""")
def written_cache(spark, sf):
    rows = _t(spark, sf, "events").select(F.col("user_id").alias("grp"), F.col("event_type").alias("key"), F.octet_length("props").alias("bytes"), F.col("event_id").alias("last_hit"), F.when(F.col("event_id") % 4 > 0, 2).otherwise(1).alias("schema_version"))
    return incremental.written_through(rows.where("last_hit % 2 = 0"), rows.where("last_hit % 2 = 1"), 2, 30)


GRAPH = """nodes AS (SELECT 'n'||n_nationkey AS node, 'Package' AS label FROM nation UNION ALL SELECT 'c'||c_custkey, 'Function' FROM customer UNION ALL SELECT 's'||s_suppkey, 'Function' FROM supplier), edges AS (SELECT 'c'||c_custkey AS src, 'n'||c_nationkey AS dst, 'IN' AS type FROM customer UNION ALL SELECT 's'||s_suppkey, 'n'||s_nationkey, 'IN' FROM supplier UNION ALL SELECT 's'||(o_custkey % 10 + 1), 'c'||o_custkey, 'CALLS' FROM orders)"""


def _graph(spark, sf):
    tag = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    nation, customer, supplier = (_t(spark, sf, t) for t in ("nation", "customer", "supplier"))
    nodes = nation.select(tag("n", "n_nationkey").alias("node"), F.lit("Package").alias("label")).union(customer.select(tag("c", "c_custkey"), F.lit("Function"))).union(supplier.select(tag("s", "s_suppkey"), F.lit("Function")))
    calls = _t(spark, sf, "orders").select(F.concat(F.lit("s"), (F.col("o_custkey") % 10 + 1).cast("string")).alias("src"), tag("c", "o_custkey").alias("dst"), F.lit("CALLS").alias("type"))
    edges = customer.select(tag("c", "c_custkey").alias("src"), tag("n", "c_nationkey").alias("dst"), F.lit("IN").alias("type")).union(supplier.select(tag("s", "s_suppkey"), tag("n", "s_nationkey"), F.lit("IN"))).union(calls)
    return nodes, edges


@query(f"""WITH RECURSIVE {GRAPH}, e AS (SELECT DISTINCT src, dst FROM edges UNION SELECT 'n'||n_nationkey, 'r'||n_regionkey FROM nation),
p AS (SELECT 's'||s_suppkey||'>'||t AS pair, 's'||s_suppkey AS src, t AS dst FROM supplier, (SELECT 'n'||n_nationkey AS t FROM nation UNION ALL SELECT 'r'||r_regionkey FROM region) WHERE s_suppkey <= 10),
w AS (SELECT DISTINCT src AS start, src AS node, [src] AS path FROM p UNION ALL SELECT start, dst, list_append(path, dst) FROM w JOIN e ON node = src WHERE len(path) < 4 AND NOT list_contains(path, dst)),
f AS (SELECT pair, path, row_number() OVER (PARTITION BY pair ORDER BY len(path), path) AS n FROM p JOIN w ON start = src AND node = dst)
SELECT pair, (len(path) - 1)::INT AS hops, array_to_string(path, '>') AS path FROM f WHERE n = 1""")
def path_between(spark, sf):
    _, edges = _graph(spark, sf)
    nation, region = _t(spark, sf, "nation"), _t(spark, sf, "region")
    tag = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    edges = edges.select("src", "dst").union(nation.select(tag("n", "n_nationkey"), tag("r", "n_regionkey")))
    ends = nation.select(tag("n", "n_nationkey").alias("dst")).union(region.select(tag("r", "r_regionkey")))
    starts = _t(spark, sf, "supplier").where("s_suppkey <= 10").select(tag("s", "s_suppkey").alias("src"))
    # the pairs asked for: ten nodes and the thirty that stand for places
    pairs = starts.crossJoin(F.broadcast(ends)).select(F.concat_ws(">", "src", "dst").alias("pair"), "src", "dst")
    return incremental.path_between(edges, pairs, 3).withColumn("path", F.array_join("path", ">"))


@query(f"""WITH {GRAPH} SELECT 'label' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'type', type, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'fan_in', node, (SELECT count(*) FROM edges WHERE dst = node) FROM nodes WHERE label = 'Package' UNION ALL SELECT 'entry', node, 1 FROM nodes WHERE label = 'Function' AND node NOT IN (SELECT dst FROM edges WHERE type = 'CALLS')""")
def architecture(spark, sf):
    return incremental.architecture(*_graph(spark, sf))


@query(f"WITH {GRAPH} SELECT src, dst, type FROM edges WHERE src IN (SELECT node FROM nodes WHERE label = 'Function' AND regexp_matches(node, '^s')) AND dst IN (SELECT node FROM nodes)")
def graph_edges(spark, sf):
    nodes, edges = _graph(spark, sf)
    return retrieval.graph_edges(nodes.withColumn("name", F.col("node")), edges, label="Function", name="^s")


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 > 0 THEN list_distinct(list(l_linenumber) FILTER (l_suppkey % 2 = 0)) END AS a, list_distinct(list(l_linenumber) FILTER (l_partkey % 2 = 0)) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'x-escalated' WHEN list_sort(coalesce(a, [])) = list_sort(coalesce(b, [])) THEN 'exact' WHEN len(list_intersect(coalesce(a, []), coalesce(b, []))) > 0 THEN 'overlap' ELSE 'disjoint' END AS agreement FROM s""")
def agreement_classes(spark, sf):
    rows = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.when(F.col("l_suppkey") % 2 == 0, F.col("l_linenumber"))).alias("a"), F.collect_set(F.when(F.col("l_partkey") % 2 == 0, F.col("l_linenumber"))).alias("b"))
    return rows.select("o_orderkey", run_ops.agreement_class(F.when(F.col("o_orderkey") % 6 > 0, F.col("a")), F.col("b")).alias("agreement"))


def _log_lines(spark, sf):
    """Log lines written from events: what they hold is known."""
    k, esc = F.col("event_id"), json.loads('"\\u001b"')
    req = F.concat(F.lit(" explore{req_id=ab"), (k % 3).cast("string"), F.lit("-"), F.floor(k / 4).cast("string"), F.lit("}: "))
    leg = F.concat(F.lit('retrieval leg done leg="'), F.col("event_type"), F.lit('" ctx=defined hits='), (k % 5).cast("string"), F.lit(" duration_ms="), F.col("value").cast("string"))
    done = F.concat(F.lit('exploration complete path="verify" tokens='), (k * 10).cast("string"), F.lit(" llm_calls=2 total_ms="), k.cast("string"))
    call = F.concat(F.lit('provider call model_served="m'), (k % 2).cast("string"), F.lit('" outcome=ok tags=["a", "b"] ok=true'))
    failed = F.concat(F.lit("retrieval leg failed leg=\"bm25\" error=code=7 at "), k.cast("string"))
    other = F.lit("provider call succeeded model_served=ghost")
    text = F.when(k % 4 == 0, leg).when(k % 4 == 1, call).when(k % 4 == 2, F.when(k % 8 == 2, failed).otherwise(other)).otherwise(done)
    return _t(spark, sf, "events").select(k.alias("seq"), "ts", F.concat(F.lit(f"{esc}[32mINFO{esc}[0m"), req, text).alias("line"))


LOGGED = "ev AS (SELECT event_id AS seq, 'ab'||(event_id % 3) AS process, event_id // 4 AS request, event_id % 4 AS k, event_id % 8 AS k8, event_type, value FROM events WHERE event_id % 4 <> 2 OR event_id % 8 = 2)"


@query(f"""WITH {LOGGED} SELECT seq, process, request, CASE k WHEN 0 THEN 'leg_done' WHEN 1 THEN 'provider_call' WHEN 2 THEN 'leg_failed' ELSE 'complete' END AS kind, CASE k WHEN 0 THEN event_type WHEN 2 THEN 'bm25' END AS leg, CASE k WHEN 0 THEN seq % 5 END AS hits, CASE k WHEN 1 THEN 'm'||(seq % 2) END AS model, CASE k WHEN 3 THEN seq * 10 END AS tokens FROM ev""")
def log_events(spark, sf):
    f = lambda c: F.col("f").getItem(c)
    rows = logs.log_events(_log_lines(spark, sf))
    return rows.select("seq", "process", "request", "kind", f("leg").alias("leg"), f("hits").try_cast("long").alias("hits"), f("model_served").alias("model"), f("tokens").try_cast("long").alias("tokens"))


REQUESTS = f"""{LOGGED} SELECT process, request, max(CASE WHEN k = 3 THEN 'verify' END) AS stage, max(CASE WHEN k = 3 THEN seq * 10 END) AS tokens, max(CASE WHEN k = 3 THEN seq END) AS total_ms, coalesce(string_agg(CASE WHEN k = 0 THEN event_type||':'||(seq % 5) END, ',' ORDER BY seq), '') AS legs, coalesce(string_agg(CASE WHEN k = 2 THEN 'code=7 at '||seq END, ',' ORDER BY seq), '') AS leg_errors, coalesce(string_agg(CASE WHEN k = 1 THEN 'm'||(seq % 2) END, ',' ORDER BY seq), '') AS models, count(*) AS n_lines FROM ev GROUP BY 1, 2"""


def _flat_requests(rows):
    return rows.select("process", "request", "stage", "tokens", "total_ms", *(F.array_join(c, ",").alias(c) for c in ("legs", "leg_errors", "models")), "n_lines")


@query(f"WITH {REQUESTS}")
def log_requests(spark, sf):
    return _flat_requests(logs.requests(logs.log_events(_log_lines(spark, sf))))


def _requests(spark, sf):
    return _t(spark, sf, "events").select(F.concat("event_type", F.lit(":"), (F.col("user_id") % 20).cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("request_id"), F.when(F.col("value") < 95, F.floor(F.col("value") / 48).cast("string")).alias("fingerprint"))


def _request_stream(spark, sf):
    rows = telemetry.event_stream(spark, f"{sf}/events.parquet").select(F.concat("event_type", F.lit(":"), (F.col("user_id") % 20).cast("string")).alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("request_id"), F.when(F.col("value") < 95, F.floor(F.col("value") / 48).cast("string")).alias("fingerprint"))
    return telemetry.ended(rows, "at")


TRUST = """rq AS (SELECT event_type||':'||(user_id % 20) AS key, ts AS met, event_id AS request_id, CASE WHEN value < 95 THEN floor(value / 48)::INT::VARCHAR END AS fingerprint, row_number() OVER (PARTITION BY event_type||':'||(user_id % 20) ORDER BY ts, event_id) AS n FROM events)"""
TRUST_SQL = f"""WITH RECURSIVE {TRUST}, t AS (SELECT key, n, request_id, fingerprint, true AS refreshed, fingerprint AS fp, met AS mark FROM rq WHERE n = 1
UNION ALL SELECT r.key, r.n, r.request_id, r.fingerprint, NOT coalesce(r.fingerprint = t.fp AND date_diff('microsecond', t.mark, r.met) < 172800000000, false), CASE WHEN coalesce(r.fingerprint = t.fp AND date_diff('microsecond', t.mark, r.met) < 172800000000, false) THEN t.fp ELSE r.fingerprint END, CASE WHEN coalesce(r.fingerprint = t.fp AND date_diff('microsecond', t.mark, r.met) < 172800000000, false) THEN t.mark ELSE r.met END FROM t JOIN rq r ON r.key = t.key AND r.n = t.n + 1)
SELECT key, request_id, fingerprint, refreshed FROM t"""


@query(TRUST_SQL)
def trust_window(spark, sf):
    return state.trust_window(_requests(spark, sf), 172_800).select("key", "request_id", "fingerprint", "refreshed")


@query(TRUST_SQL)
def trust_window_stream(spark, sf):
    got = telemetry.run_available(state.trust_window_stream(_request_stream(spark, sf), 172_800), "append", state_store=True)
    return got.select("key", "request_id", "fingerprint", "refreshed")


CACHE_SQL = TRUST_SQL.replace("true AS refreshed", "'miss' AS layer").replace("NOT coalesce(r.fingerprint = t.fp AND date_diff('microsecond', t.mark, r.met) < 172800000000, false)", "CASE WHEN coalesce(r.fingerprint = t.fp AND date_diff('microsecond', t.mark, r.met) <= 172800000000, false) THEN 'hit' ELSE 'miss' END").replace("SELECT key, request_id, fingerprint, refreshed FROM t", "SELECT key, request_id, layer FROM t")


@query(CACHE_SQL)
def cache_lookup(spark, sf):
    return state.cache_table(_requests(spark, sf).withColumnRenamed("fingerprint", "snapshot"), 172_800).select("key", "request_id", "layer")


@query(CACHE_SQL)
def cache_lookup_stream(spark, sf):
    got = telemetry.run_available(state.cache_stream(_request_stream(spark, sf).withColumnRenamed("fingerprint", "snapshot"), 172_800), "append", state_store=True)
    return got.select("key", "request_id", "layer")


@query("SELECT CAST(t AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS t FROM events) GROUP BY ALL")
def sliding_rollup(spark, sf):
    return telemetry.rollup(_t(spark, sf, "events"), "2 hours", slide="1 hour").select("window_start", "event_type", "n")


@query(f"WITH {LINES} SELECT repo, count(*) AS n_lines, count(*) FILTER (line = '') AS n_empty FROM lines GROUP BY 1")
def line_counts(spark, sf):
    return _lines(spark, sf).groupBy("repo").agg(F.count("*").alias("n_lines"), F.count_if(F.col("line") == "").alias("n_empty"))
