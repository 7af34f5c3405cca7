"""Registered queries of the statistics: events are graded calls of users, labels two raters' grades, orders three passes of customers' queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics as op
from .queries import _t, query
from .runs import FINDINGS, RUNS, TARGETS, _findings, _runs, _targets

REPLICATES = 200
WEIGHTS = f"""rep AS (SELECT unnest(range({REPLICATES})) AS r), bounds AS (SELECT [{', '.join(f'{x!r}::DOUBLE' for x in op.POISSON)}] AS bs),
weights AS (SELECT cluster, r, len([b FOR b IN bs IF b <= ('0x'||substr(md5(cluster||'|'||(r // {op.DRAWS})), (r % {op.DRAWS} * 6 + 1)::INT, 6))::BIGINT / 16777216::DOUBLE]) AS w FROM (SELECT DISTINCT cluster FROM c), rep, bounds)"""
# from c (g, cluster, s, n)
INTERVALS = f"""{WEIGHTS}, m AS (SELECT g, r, sum(w * s) / sum(w * n)::DOUBLE AS mean FROM c JOIN weights USING (cluster) GROUP BY ALL HAVING sum(w * n) > 0),
l AS (SELECT g, list(mean ORDER BY mean) AS ms FROM m GROUP BY 1), t AS (SELECT g, sum(n)::BIGINT AS n, count(*) AS clusters, sum(s) / sum(n) AS mean FROM c GROUP BY 1)
SELECT g, n, clusters, round(mean, 9) AS mean, round(ms[ceil(0.025::DOUBLE * len(ms))::INT], 9) AS low, round(ms[ceil(round(0.975::DOUBLE * len(ms), 9))::INT], 9) AS high FROM t LEFT JOIN l USING (g)"""


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(f"WITH c AS (SELECT event_type AS g, user_id::VARCHAR AS cluster, sum((value > 50)::INT)::DOUBLE AS s, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL), {INTERVALS}")
def bootstrap_intervals(spark, sf):
    rows = _t(spark, sf, "events").select(F.col("event_type").alias("g"), "user_id", (F.col("value") > 50).cast("int").alias("ok"))
    return _rounded(op.bootstrap(rows, ["g"], "user_id", "ok", REPLICATES), "mean", "low", "high")


@query(f"""WITH e AS (SELECT event_type AS g, user_id, event_id % 2 AS side, avg((value > 50)::INT) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL),
c AS (SELECT a.g, a.user_id::VARCHAR AS cluster, a.v - b.v AS s, 1 AS n FROM e a JOIN e b ON a.g = b.g AND a.user_id = b.user_id AND a.side = 0 AND b.side = 1), {INTERVALS}""")
def paired_bootstrap(spark, sf):
    rows = _t(spark, sf, "events").select(F.col("event_type").alias("g"), "user_id", (F.col("event_id") % 2).alias("side"), (F.col("value") > 50).cast("int").alias("ok"))
    pairs = op.paired(rows.where("side = 0"), rows.where("side = 1"), ["g", "user_id"], "ok")
    return _rounded(op.bootstrap(pairs.withColumn("gap", F.col("a") - F.col("b")), ["g"], "user_id", "gap", REPLICATES), "mean", "low", "high")


def _labelled(spark, sf):
    return _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "source"), "doc_id")


@query("""WITH r AS (SELECT source, quality = 1 AS a, toxic = 0 AS b FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL),
m AS (SELECT source, count(*) AS n, count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM r GROUP BY 1),
k AS (SELECT *, (only_a + only_b)::DOUBLE AS d, least(only_a, only_b) AS low FROM m)
SELECT source, n, "both", only_a, only_b, neither, round((only_a - only_b) / n::DOUBLE, 9) AS difference, CASE WHEN d = 0 THEN 1 ELSE round(least(1, 2 * list_sum([exp(lgamma(d + 1) - lgamma(i + 1) - lgamma(d - i + 1) - d * ln(2)) FOR i IN range(0, low + 1)])), 9) END AS p FROM k""")
def mcnemar_by_source(spark, sf):
    rows = _labelled(spark, sf).select("source", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))
    return _rounded(op.mcnemar(rows, ["source"]), "difference", "p")


RATERS = """a AS (SELECT source AS rubric, doc_id AS row_id, quality AS grade_a FROM labels JOIN documents USING (doc_id) WHERE doc_id % 11 > 0), b AS (SELECT source AS rubric, doc_id AS row_id, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 - toxic END AS grade_b FROM labels JOIN documents USING (doc_id) WHERE doc_id % 7 > 0),
x AS (SELECT rubric, row_id, grade_a, grade_b FROM a FULL JOIN b USING (rubric, row_id))"""


def _raters(spark, sf):
    rows, k = _labelled(spark, sf), F.col("doc_id")
    own = ["rubric", "row_id", F.lit(None).cast("int").alias("finding_idx")]
    rows = rows.withColumnsRenamed({"source": "rubric"}).withColumn("row_id", k)
    return rows.where(k % 11 > 0).select(*own, F.col("quality").alias("grade")), rows.where(k % 7 > 0).select(*own, F.when(k % 5 == 0, 2).otherwise(1 - F.col("toxic")).alias("grade"))


@query(f"""WITH {RATERS}, o AS (SELECT rubric, count(*) FILTER (grade_a IS NOT NULL AND grade_b IS NOT NULL) AS n, count(*) FILTER (grade_a IS NULL OR grade_b IS NULL) AS unpaired, count(*) FILTER (grade_a = grade_b) AS same FROM x GROUP BY 1), p AS (SELECT * FROM x WHERE grade_a IS NOT NULL AND grade_b IS NOT NULL),
h AS (SELECT l.rubric, sum(na * nb)::DOUBLE AS product FROM (SELECT rubric, grade_a AS grade, count(*) AS na FROM p GROUP BY ALL) l JOIN (SELECT rubric, grade_b AS grade, count(*) AS nb FROM p GROUP BY ALL) r ON l.rubric = r.rubric AND l.grade = r.grade GROUP BY 1),
k AS (SELECT rubric, n, unpaired, same / n::DOUBLE AS agreement, coalesce(product, 0) / (n * n) AS chance FROM o LEFT JOIN h USING (rubric))
SELECT rubric, n, unpaired, round(agreement, 9) AS agreement, round(chance, 9) AS chance, round((agreement - chance) / nullif(1 - chance, 0), 9) AS kappa FROM k""")
def rater_kappa(spark, sf):
    return _rounded(op.kappa(*_raters(spark, sf)), "agreement", "chance", "kappa")


@query(f"WITH {RATERS} SELECT rubric, row_id, NULL::INT AS finding_idx, grade_a, grade_b FROM x WHERE grade_a <> grade_b")
def adjudication(spark, sf):
    return op.adjudication(*_raters(spark, sf))


@query(f"""WITH {RUNS}, {FINDINGS}, {TARGETS}, t AS (SELECT DISTINCT query_id, path, span_start, span_end, CASE role WHEN 'primary' THEN 2 WHEN 'equivalent' THEN 1 END AS rel FROM targets WHERE role <> 'distractor'),
f AS (SELECT run_id, query_id, pos, regexp_replace(path, '^\\./', '') AS path, line_start, line_end FROM findings JOIN runs USING (run_id)),
met AS (SELECT f.run_id, f.path, span_start, span_end, rel, min(pos) AS pos FROM f JOIN t ON f.query_id = t.query_id AND f.path = t.path WHERE line_start IS NULL OR span_start IS NULL OR line_start <= span_end AND span_start <= line_end GROUP BY ALL),
best AS (SELECT run_id, path, pos, max(rel) AS rel FROM met GROUP BY ALL),
o AS (SELECT f.run_id, coalesce(rel, 0) AS rel, row_number() OVER (PARTITION BY f.run_id ORDER BY f.pos, coalesce(rel, 0) DESC) AS k FROM f LEFT JOIN best ON f.run_id = best.run_id AND f.pos = best.pos AND f.path = best.path),
g AS (SELECT run_id, count(*) FILTER (rel > 0) AS relevant, sum((2 ** rel - 1) / log2(k + 1)) AS dcg FROM o WHERE k <= 3 GROUP BY 1),
i AS (SELECT query_id, count(*) AS n_targets, sum((2 ** rel - 1) / log2(k + 1)) FILTER (k <= 3) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS k FROM t) GROUP BY 1)
SELECT r.run_id, r.query_id, coalesce(n_targets, 0) AS n_targets, round(coalesce(relevant, 0) / 3::DOUBLE, 9) AS "precision", round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal END, 9) AS ndcg FROM runs r LEFT JOIN i USING (query_id) LEFT JOIN g USING (run_id)""")
def ranking_quality(spark, sf):
    return _rounded(op.ranking_quality(_runs(spark, sf), _findings(spark, sf), _targets(spark, sf)), "precision", "ndcg")


PASSES = [1, 2, 3]


@query(f"""WITH {RUNS}, {FINDINGS}, p AS (SELECT *, run_id % 4 AS pass FROM runs WHERE run_id % 4 > 0),
f AS (SELECT query_id, pass, run_id, pos, regexp_replace(path, '^\\./', '') AS path, line_start, line_end FROM findings JOIN p USING (run_id)),
s AS (SELECT query_id, pass, list(DISTINCT path||':'||coalesce(line_start::VARCHAR, '?')||':'||coalesce(line_end::VARCHAR, '?')) AS places, arg_min(path, (pos, path)) AS top FROM f GROUP BY 1, 2),
g AS (SELECT query_id, pass, min(stage) AS stage FROM p GROUP BY 1, 2), x AS (SELECT g.*, coalesce(places, []) AS places, top FROM g LEFT JOIN s USING (query_id, pass)),
pairs AS (SELECT a.query_id, CASE WHEN len(list_distinct(a.places || b.places)) = 0 THEN 1 ELSE len(list_intersect(a.places, b.places)) / len(list_distinct(a.places || b.places))::DOUBLE END AS near, (a.stage IS NOT DISTINCT FROM b.stage)::INT AS same FROM x a JOIN x b ON a.query_id = b.query_id AND a.pass < b.pass),
v AS (SELECT query_id, round(avg(near), 9) AS jaccard, round(avg(same), 9) AS stage_agreement FROM pairs GROUP BY 1)
SELECT query_id, count(*)::INT AS n_passes, count(DISTINCT top)::INT AS distinct_top, any_value(jaccard) AS jaccard, any_value(stage_agreement) AS stage_agreement FROM x LEFT JOIN v USING (query_id) GROUP BY 1""")
def pass_variance(spark, sf):
    runs = _runs(spark, sf).withColumn("pass", F.col("run_id") % 4)
    return _rounded(op.pass_variance(runs, _findings(spark, sf), PASSES), "jaccard", "stage_agreement")
