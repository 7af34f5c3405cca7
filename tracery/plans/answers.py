"""Registered queries on the text of questions and answers: literals, tokens, keys, caps, findings and their form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import calibration, incremental, ranking
from ..sources import logs
from ..streaming import telemetry
from .queries import SCORED, _scored, _t, query


@query("""WITH t AS (SELECT doc_id, translate(replace(replace(coalesce(text, ''), '. ', '" '), ', ', '` '), '''', ' ') AS t FROM documents), l AS (SELECT doc_id, [trim(x[2:-2]) FOR x IN regexp_extract_all(t, '"[^"]*"|`[^`]*`')] AS xs FROM t)
SELECT doc_id, len(list_distinct([x FOR x IN xs IF x <> ''])) AS n, sha256(array_to_string(list_sort(list_distinct([x FOR x IN xs IF x <> ''])), chr(10))) AS digest FROM l""")
def quoted_literals(spark, sf):
    """Literals of every text, ends of sentences read as quotes."""
    t = F.translate(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit('" ')), F.lit(", "), F.lit("` ")), "'", " ")
    found = fn.literals(t)
    return _t(spark, sf, "documents").select("doc_id", F.size(found).alias("n"), F.sha2(F.array_join(F.array_sort(found), "\n"), 256).alias("digest"))


@query("SELECT doc_id, 'see|'||source||'/'||lang||'/'||doc_id||'.py|and|'||lang||'|./'||source AS tokens FROM documents")
def located_tokens(spark, sf):
    """Paths with lines and columns behind them, as tokens of a question."""
    k = F.col("doc_id").cast("string")
    ask = F.concat(F.lit("see ("), F.concat_ws("/", "source", "lang", k), F.lit(".py:"), F.col("n_chars").cast("string"), F.lit(":3), and "), F.col("lang"), F.lit(":7. ./"), F.col("source"), F.lit(":12"))
    return _t(spark, sf, "documents").select("doc_id", F.array_join(fn.tokens(ask), "|").alias("tokens"))


@query("""SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200]||'…' ELSE text END AS snippet, array_to_string([x[1:40] FOR x IN string_split(text, chr(10))[1:3]], chr(10)) AS head FROM documents""")
def capped_texts(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", fn.cap_snippet(F.col("text"), 200).alias("snippet"), fn.cap_lines(F.col("text"), 3, 40).alias("head"))


@query("""WITH s AS (SELECT doc_id, lower(trim(text)) AS t, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '../up' WHEN 2 THEN '/root' WHEN 3 THEN source ELSE source||'/'||lang END AS scope FROM documents),
c AS (SELECT doc_id, t, CASE WHEN doc_id % 5 < 3 THEN '' ELSE scope END AS scope FROM s)
SELECT doc_id, sha256(octet_length(encode(t))||':'||t||octet_length(encode(scope))||':'||scope) AS key FROM c""")
def cache_keys(spark, sf):
    k = F.col("doc_id") % 5
    scope = F.when(k == 1, "../up").when(k == 2, "/root").when(k == 3, F.col("source")).when(k == 4, F.concat_ws("/", "source", "lang"))
    return _t(spark, sf, "documents").select("doc_id", F.sha2(fn.cache_key(F.col("text"), scope), 256).alias("key"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 1 THEN event_id % 5 * 100 WHEN event_id % 5 = 0 OR event_id % 3 = 0 THEN 0 ELSE greatest(event_id % 5 * 100, event_id % 3 * 200) END AS cap FROM events""")
def response_caps(spark, sf):
    k = F.col("event_id")
    return _t(spark, sf, "events").select("event_id", incremental.response_cap(k % 2 == 0, k % 5 * 100, k % 3 * 200).alias("cap"))


RAW = ['"12"', "[1, 2]", "{bad", "true", "-12", "3.5e2", "word", '{"a": 1}', "+7", "1x"]
RAW_KINDS = ["str", "json", "str", "bool", "int", "float", "str", "json", "int", "str"]


@query(f"SELECT event_id, ({RAW_KINDS!r})[(event_id % 10 + 1)::INT] AS kind FROM events")
def value_kinds(spark, sf):
    """The kind of a raw log value; each event has one of ten."""
    raw = F.element_at(F.array(*map(F.lit, RAW)), (F.col("event_id") % 10 + 1).cast("int"))
    return _t(spark, sf, "events").select("event_id", logs.value_kind(raw).alias("kind"))


@query("""WITH h AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 3 = l_orderkey % 3)
SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 4 < 2 AND l_orderkey IS NULL THEN 'verify' ELSE ['confidence', 'unique-symbol', 'verify', 'fallback'][(o_orderkey % 4 + 1)::INT] END AS route FROM orders LEFT JOIN h ON o_orderkey = l_orderkey""")
def reauthorised_routes(spark, sf):
    """Routes of orders' questions; the candidate that allowed an early exit is at line 1 of a file drawn from the order."""
    k = F.col("o_orderkey")
    orders = _t(spark, sf, "orders")
    routes = orders.select(k.alias("query_id"), F.element_at(F.array(*map(F.lit, ("confidence", "unique-symbol", "verify", "fallback"))), (k % 4 + 1).cast("int")).alias("route"))
    authority = orders.select(k.alias("query_id"), (k % 3).alias("path"), F.lit(1).alias("line_start"))
    found = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") % 3).alias("path"), F.col("l_linenumber").cast("int").alias("line_start"))
    return ranking.reauthorised(routes, authority, found)


ANSWERS = """a AS (SELECT l_orderkey AS query_id, 'p'||(l_partkey % 3) AS path, (l_linenumber % 3)::INT AS line_start, (l_linenumber % 3 + 2)::INT AS line_end, CASE WHEN l_suppkey % 2 = 0 THEN 's'||(l_suppkey % 5) END AS symbol, ['SymbolExact', 'SymbolFuzzy', 'SemanticHit', 'FileNameHit', 'ContentHit'][(l_partkey % 5 + 1)::INT] AS kind, CASE WHEN l_partkey % 4 > 0 THEN 'x'||l_returnflag END AS snippet, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank FROM lineitem),
n AS (SELECT *, CASE kind WHEN 'SymbolExact' THEN 'exact symbol match' WHEN 'SymbolFuzzy' THEN 'symbol name match' WHEN 'SemanticHit' THEN 'semantic search match' WHEN 'FileNameHit' THEN 'file name match' ELSE 'text match' END||CASE WHEN symbol IS NOT NULL THEN ': `'||symbol||'`' ELSE '' END AS note FROM a)"""


def _answers(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    kinds = F.array(*map(F.lit, ("SymbolExact", "SymbolFuzzy", "SemanticHit", "FileNameHit", "ContentHit")))
    start = (F.col("l_linenumber") % 3).cast("int")
    named = lambda a, c, n: F.concat(F.lit(a), (F.col(c) % n).cast("string"))
    return _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), named("p", "l_partkey", 3).alias("path"), start.alias("line_start"), (start + 2).alias("line_end"), F.when(F.col("l_suppkey") % 2 == 0, named("s", "l_suppkey", 5)).alias("symbol"), F.element_at(kinds, (F.col("l_partkey") % 5 + 1).cast("int")).alias("kind"), F.when(F.col("l_partkey") % 4 > 0, F.concat(F.lit("x"), "l_returnflag")).alias("snippet"), F.row_number().over(w).alias("rank"))


@query(f"WITH {ANSWERS} SELECT query_id, rank, path, note FROM n")
def finding_notes(spark, sf):
    return ranking.findings(_answers(spark, sf)).select("query_id", "rank", "path", "note")


@query(f"""WITH {ANSWERS}, j AS (SELECT query_id, rank, '{{"location":{{"path":"'||path||'"'||CASE WHEN line_start > 0 THEN ',"line_start":'||line_start||',"line_end":'||line_end ELSE '' END||'}}'||CASE WHEN snippet IS NOT NULL THEN ',"snippet":"'||snippet||'"' ELSE '' END||',"note":"'||note||'"'||CASE WHEN symbol IS NOT NULL THEN ',"symbol":"'||symbol||'"' ELSE '' END||'}}' AS f FROM n)
SELECT query_id, '{{"findings":['||string_agg(f, ',' ORDER BY rank)||']}}' AS response FROM j GROUP BY 1""")
def responses(spark, sf):
    return ranking.response(ranking.findings(_answers(spark, sf)))


@query(f"""WITH {ANSWERS}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id, path, line_start, line_end, CASE WHEN line_start = 0 THEN note END ORDER BY rank) AS nth FROM n),
p AS (SELECT query_id, path, line_start, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM d WHERE nth = 1) SELECT query_id, path, line_start, rank FROM p WHERE place <= 3""")
def first_findings(spark, sf):
    return ranking.first_findings(ranking.findings(_answers(spark, sf)), 3).select("query_id", "path", "line_start", "rank")


class ByLength:
    """A scorer as a model would be one: longer states are likelier."""

    def __call__(self, states: list[str]) -> list[float]:
        return [min(1.0, len(x or "") / 1000) for x in states]


@query("SELECT doc_id, round(least(1, coalesce(length(text), 0) / 1000::DOUBLE), 9) AS p FROM documents")
def scored_states(spark, sf):
    return calibration.score_states(_t(spark, sf, "documents").select("doc_id", "text"), ByLength, "text").select("doc_id", F.round("p", 9).alias("p"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def first_findings_stream(spark, sf):
    """Of a stream of events the first of each user and kind."""
    rows = telemetry.event_stream(spark, f"{sf}/events.parquet")
    return telemetry.run_available(telemetry.first_findings(rows, ["user_id", "event_type"], "400 days"), "append").select("user_id", "event_type")


GATE = f"""{SCORED}, z AS (SELECT query_id, rank, positive, rank % 2 AS half, ln(greatest(0.001, least(0.999, p)) / (1 - greatest(0.001, least(0.999, p)))) AS z FROM scored),
tg AS (SELECT unnest(range(50, 501)) AS t100), tx AS (SELECT t100, CASE WHEN positive = 1 THEN z ELSE -z END / (t100 / 100::DOUBLE) AS s FROM z, tg WHERE half = 0), tl AS (SELECT t100, round(avg(ln(1 + exp(-abs(s))) + greatest(-s, 0)), 9) AS nll FROM tx GROUP BY 1), tt AS (SELECT t100 / 100::DOUBLE AS t FROM tl ORDER BY nll, t100 LIMIT 1),
pp AS (SELECT query_id, rank, positive, half, 1 / (1 + exp(-z / t)) AS p FROM z, tt), tau AS (SELECT coalesce(min(tau), 90) / 100::DOUBLE AS tau FROM (SELECT tau FROM pp, (SELECT unnest(range(30, 95, 5)) AS tau) WHERE half = 0 AND p >= tau / 100::DOUBLE GROUP BY 1 HAVING avg(positive) >= 0.9)),
te AS (SELECT * FROM pp WHERE half = 1), m1 AS (SELECT avg(t) AS v FROM (SELECT max(positive) AS m, arg_min(positive, (-p, rank)) AS t FROM te GROUP BY query_id) WHERE m = 1),
m2 AS (SELECT sum(pos * (below + neg / 2::DOUBLE)) / (sum(pos) * sum(neg)) AS v FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT p, sum(positive) AS pos, sum(1 - positive) AS neg FROM te GROUP BY 1))),
m3 AS (SELECT sum(n * abs(c - a)) / sum(n) AS v FROM (SELECT count(*) AS n, avg(p) AS c, avg(positive) AS a FROM te GROUP BY greatest(0, least(14, ceil(p * 15) - 1)))), m4 AS (SELECT sum(positive) / nullif(count(*), 0)::DOUBLE AS v FROM te, tau WHERE p >= tau)"""


@query(f"""WITH {GATE} SELECT 'query_top1' AS metric, round(v, 9) AS value, '>= 0.90' AS threshold, coalesce(v >= 0.9, false) AS passed FROM m1 UNION ALL SELECT 'auroc', round(v, 9), '>= 0.90', coalesce(v >= 0.9, false) FROM m2 UNION ALL SELECT 'ece', round(v, 9), '<= 0.10', coalesce(v <= 0.1, false) FROM m3 UNION ALL SELECT 'precision', round(v, 9), '>= 0.85', coalesce(v >= 0.85, false) FROM m4""")
def calibrated_gate(spark, sf):
    """Temperature and threshold from one half of the scored rows, the gate on the other."""
    p = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("p")))
    rows = _scored(spark, sf).withColumns({"z": F.log(p / (1 - p)), "half": F.col("rank") % 2})
    return calibration.calibrated_gate(rows.where("half = 0"), rows.where("half = 1")).withColumn("value", F.round("value", 9))
