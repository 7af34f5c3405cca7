"""Registered queries over the driver's tables, each with its SQL where SQL can express it.

Documents are files (a repository for each source), benchmark items give literal queries, labels
give truth, events are telemetry, orders with their lines are requests with calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import calibration, evaluation, incremental, labels, ranking, retrieval
from ..operators import retrieve as retrieve_job
from ..sources import corpus
from ..sources.scratch import cut
from ..streaming import telemetry

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _files(spark, sf) -> DataFrame:
    return corpus.corpus_files(_t(spark, sf, "documents"))


def _lines(spark, sf) -> DataFrame:
    return corpus.corpus_lines(_files(spark, sf))


def _items(spark, sf) -> DataFrame:
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _literals(spark, sf) -> DataFrame:
    """Every line of every item is a literal to look for."""
    rows = _items(spark, sf).select("query_id", F.explode(F.split("text", "\n")).alias("pattern"))
    return rows.select("query_id", F.trim("pattern").alias("pattern")).where("pattern <> ''").distinct()


def _keys(spark, sf) -> DataFrame:
    key = fn.coverage_key(F.col("pattern"))
    keys = F.when(F.octet_length(key) >= 4, F.array(key)).otherwise(F.array().cast("array<string>"))
    return _literals(spark, sf).select("query_id", keys.alias("keys"), keys.alias("strong"))


def _hits(spark, sf) -> DataFrame:
    """What the literal search finds, written once for all that a query makes of it."""
    return cut(retrieval.substring_hits(_lines(spark, sf), _literals(spark, sf)))


def _ranked(spark, sf, hits: DataFrame | None = None) -> DataFrame:
    found = retrieval.grep_candidates(_hits(spark, sf) if hits is None else hits, context=2)
    return ranking.merge_and_rank(found, _keys(spark, sf))


def _truth(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.min(F.struct(F.split("path", "/").alias("p"), "line_no", "path")).alias("m")).select("query_id", "m.path", F.col("m.line_no").alias("span_start"), (F.col("m.line_no") + 1).alias("span_end"))


def _labelled(spark, sf) -> DataFrame:
    hits = _hits(spark, sf)
    return labels.interval_labels(_ranked(spark, sf, hits), _truth(hits))


def _draw(column: str):
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 6), 16, 10).cast("long") / 16777216


def _scored(spark, sf) -> DataFrame:
    """Labelled documents as scored candidates: a query for each source, quality as truth, a drawn score that leans to it."""
    rows = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    p = F.round(F.lit(0.35) * F.col("quality") + F.lit(0.65) * _draw("doc_id"), 3)
    return rows.select(F.concat_ws("/", "source", F.col("toxic").cast("string")).alias("query_id"), F.col("doc_id").alias("rank"), F.col("quality").alias("positive"), p.alias("p"))


LINES = """f AS (SELECT source AS repo, source||'/'||lang||'/'||doc_id AS path, text, string_split(text, chr(10)) AS p FROM documents),
g AS (SELECT repo, path, CASE WHEN p[-1] = '' THEN p[1:-2] ELSE p END AS p FROM f),
lines AS (SELECT repo, path, unnest(generate_series(1, len(p))) AS line_no, unnest([regexp_replace(x, '\\r$', '') FOR x IN p]) AS line FROM g)"""
ALNUM = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ_', 'abcdefghijklmnopqrstuvwxyz'"
HITS = f"""{LINES}, q AS (SELECT DISTINCT item_id AS query_id, trim(unnest(string_split(text, chr(10)))) AS pattern FROM benchmark), qp AS (SELECT * FROM q WHERE pattern <> ''),
hits AS (SELECT query_id, pattern, path, line_no, line FROM lines JOIN qp ON CASE WHEN regexp_matches(pattern, '\\p{{Lu}}') THEN contains(line, pattern) ELSE contains(lower(line), lower(pattern)) END)"""
# from c (query_id, raw_seq, path, s, e, symbol, kind, snippet) and kk (query_id, keys, strong)
MERGED = f"""cb AS (SELECT c.*, kk.keys, CASE kind WHEN 'SymbolExact' THEN 700 WHEN 'SymbolFuzzy' THEN 400 WHEN 'FileNameHit' THEN 300 WHEN 'SemanticHit' THEN 260 ELSE CASE WHEN len([k FOR k IN kk.strong IF contains(translate(snippet, {ALNUM}), k)]) > 0 THEN 650 ELSE 150 END END AS base FROM c LEFT JOIN kk USING (query_id)),
ci AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY query_id, path ORDER BY s, e, raw_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS fresh FROM cb),
cj AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id, path ORDER BY s, e, raw_seq) AS island FROM ci),
cp AS (SELECT *, row_number() OVER w AS pos, coalesce(base > max(base) OVER (PARTITION BY query_id, path, island ORDER BY s, e, raw_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS rec FROM cj WINDOW w AS (PARTITION BY query_id, path, island ORDER BY s, e, raw_seq)),
m AS (SELECT query_id, path, island, min(s) AS line_start, max(e) AS line_end, max(base) AS base, any_value(keys) AS keys, arg_max(kind, pos) FILTER (rec) AS kind, coalesce(arg_max(symbol, pos) FILTER (rec AND symbol IS NOT NULL), arg_min(symbol, pos) FILTER (symbol IS NOT NULL)) AS symbol, coalesce(arg_max(snippet, pos) FILTER (rec AND snippet IS NOT NULL), arg_min(snippet, pos) FILTER (snippet IS NOT NULL)) AS snippet FROM cp GROUP BY query_id, path, island),
sc AS (SELECT *, least(1000, base + least(120, 30 * coalesce(len([k FOR k IN keys IF contains(translate(concat_ws(chr(10), symbol, path, snippet), {ALNUM}), k)]), 0)) + 15 * least(4, count(*) OVER (PARTITION BY query_id, path) - 1)) AS score FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, line_start) AS in_file FROM sc),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY in_file > 3, score DESC, string_split(path, '/'), line_start) AS place FROM b),
ranked AS (SELECT query_id, path, line_start, line_end, symbol, kind, snippet, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, string_split(path, '/'), line_start) AS rank FROM t WHERE place <= 12)"""
RANKED = f"""{HITS}, h20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pattern ORDER BY string_split(path, '/'), line_no) AS rn FROM hits) WHERE rn <= 20),
c AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY string_split(path, '/'), line_no, pattern) AS raw_seq, path, greatest(1, line_no - 2) AS s, line_no + 2 AS e, NULL::VARCHAR AS symbol, 'ContentHit' AS kind, line AS snippet FROM h20),
kk AS (SELECT query_id, list(k) AS keys, list(k) AS strong FROM (SELECT DISTINCT query_id, translate(pattern, {ALNUM}) AS k FROM qp) WHERE octet_length(encode(k)) >= 4 GROUP BY 1), {MERGED},
truth AS (SELECT query_id, path, line_no AS span_start, line_no + 1 AS span_end FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY string_split(path, '/'), line_no) AS first FROM hits) WHERE first = 1)"""
SCORED = """scored AS (SELECT source||'/'||toxic AS query_id, doc_id AS rank, quality AS positive, round(0.35::DOUBLE * quality + 0.65::DOUBLE * (('0x'||substr(md5(doc_id::VARCHAR), 1, 6))::BIGINT / 16777216::DOUBLE), 3) AS p FROM labels JOIN documents USING (doc_id))"""
OUTLINE = f"""{LINES}, o AS (SELECT repo, path, line_no, line, lead(line_no) OVER (PARTITION BY repo, path ORDER BY line_no) - 1 AS e, regexp_extract(line, '^(\\w+)', 1) AS name FROM lines WHERE trim(line) <> ''),
symbols AS (SELECT repo, path, repo||'.'||split_part(path, '/', 3)||'.'||name AS qualified_name, name, line_no AS line_start, coalesce(e, line_no) AS line_end FROM o WHERE name <> '')"""


@query(f"WITH {LINES} SELECT * FROM lines")
def corpus_lines(spark, sf):
    return _lines(spark, sf)


@query("SELECT source AS repo, source||'/'||lang||'/'||doc_id AS path, len(string_split(text, chr(10))) - CASE WHEN text = '' OR suffix(text, chr(10)) THEN 1 ELSE 0 END AS line_count, sha256(text) AS digest FROM documents")
def file_stats(spark, sf):
    return corpus.file_stats(_files(spark, sf))


@query(f"WITH {OUTLINE} SELECT repo, path, qualified_name, line_start, line_end FROM symbols")
def outline_symbols(spark, sf):
    return corpus.outline(_files(spark, sf))


@query(f"WITH {HITS} SELECT * FROM hits")
def grep_hits(spark, sf):
    return retrieval.substring_hits(_lines(spark, sf), _literals(spark, sf)).select("query_id", "pattern", "path", "line_no", "line")


@query(f"WITH {RANKED} SELECT * FROM ranked")
def ranked_candidates(spark, sf):
    return _ranked(spark, sf)


@query(f"""WITH {RANKED}, two AS (SELECT query_id, max(score) AS top, max(CASE WHEN rank = 2 THEN score END) AS second FROM ranked WHERE rank <= 2 GROUP BY 1)
SELECT i.item_id AS query_id, CASE WHEN top IS NULL THEN 0 ELSE least(100, top // 10 + (top - coalesce(second, 0)) // 20) END AS confidence, false AS has_exact, false AS unique_trusted, CASE WHEN CASE WHEN top IS NULL THEN 0 ELSE least(100, top // 10 + (top - coalesce(second, 0)) // 20) END >= 30 THEN 'verify' ELSE 'fallback' END AS route FROM benchmark i LEFT JOIN two ON item_id = query_id""")
def confidence(spark, sf):
    return ranking.route(ranking.confidence(_ranked(spark, sf), _items(spark, sf)))


@query(f"""WITH {OUTLINE}, n AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS name FROM benchmark)
SELECT * FROM (SELECT query_id, path, line_start, line_end, qualified_name AS symbol, row_number() OVER (PARTITION BY query_id ORDER BY string_split(path, '/'), line_start, qualified_name, name) AS raw_seq FROM symbols JOIN n USING (name)) WHERE raw_seq <= 20""")
def symbol_hits(spark, sf):
    """Symbols named by any word of an item."""
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_]+)"), F.lit(1))))
    names = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("name"))
    return retrieval.symbol_leg(corpus.outline(_files(spark, sf)), names).select("query_id", "path", "line_start", "line_end", "symbol", "raw_seq")


@query("""WITH p AS (SELECT DISTINCT source||'/'||lang||'/'||doc_id AS path, doc_id::VARCHAR AS base FROM documents)
SELECT * FROM (SELECT item_id AS query_id, path, row_number() OVER (PARTITION BY item_id ORDER BY string_split(path, '/')) AS raw_seq FROM p JOIN benchmark ON contains(base, item_id::VARCHAR)) WHERE raw_seq <= 20""")
def file_hits(spark, sf):
    tokens = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").cast("string").alias("token"))
    return retrieval.file_leg(_files(spark, sf), tokens).select("query_id", "path", "raw_seq")


@query("""WITH a AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS term FROM benchmark),
asked AS (SELECT * FROM a WHERE term <> ''), w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS term FROM documents),
l AS (SELECT doc_id, count(*) FILTER (term <> '') AS len FROM w GROUP BY 1), s AS (SELECT count(*) AS n, avg(len) AS al FROM l),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM asked) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
x AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al))), 6) AS score FROM tf JOIN df USING (term) JOIN asked USING (term) JOIN l USING (doc_id), s GROUP BY ALL)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x) WHERE rank <= 20""")
def bm25_topk(spark, sf):
    return retrieval.bm25(_t(spark, sf, "documents"), _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query(f"""WITH {RANKED}, st AS (SELECT path, len(p) AS n FROM g) SELECT query_id, path, line_start, least(line_end, greatest(n, line_start)) AS line_end, rank FROM ranked JOIN st USING (path) WHERE line_start <= n""")
def verified_locations(spark, sf):
    return retrieval.verified_locations(_ranked(spark, sf), corpus.file_stats(_files(spark, sf))).select("query_id", "path", "line_start", "line_end", "rank")


@query(f"""WITH {RANKED} SELECT r.query_id, r.rank, r.path, CASE WHEN t.query_id IS NOT NULL THEN 'A' ELSE 'B' END AS label FROM ranked r LEFT JOIN truth t ON r.query_id = t.query_id AND r.path = t.path AND line_start <= span_end AND span_start <= line_end""")
def interval_labels(spark, sf):
    return _labelled(spark, sf).select("query_id", "rank", "path", "label")


@query(f"""WITH {RANKED}, l AS (SELECT r.query_id, r.rank, CASE WHEN t.query_id IS NOT NULL THEN 'A' ELSE 'B' END AS label FROM ranked r LEFT JOIN truth t ON r.query_id = t.query_id AND r.path = t.path AND line_start <= span_end AND span_start <= line_end),
lm AS (SELECT *, bool_or(label = 'A') OVER (PARTITION BY query_id) AS has, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS nth FROM l)
SELECT query_id, rank, label FROM lm WHERE label = 'A' OR nth <= CASE WHEN has THEN 4 ELSE 2 END""")
def negatives_capped(spark, sf):
    return labels.capped_negatives(_labelled(spark, sf)).select("query_id", "rank", "label")


@query("""SELECT CASE WHEN lang = 'en' THEN 'train' WHEN lang = 'de' THEN 'val' ELSE 'test' END AS split, count(*) AS n_rows, count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality <> 1) AS n_neg, count(DISTINCT source) AS n_queries, count(DISTINCT CASE WHEN quality = 1 THEN source END) AS n_with_pos FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def split_stats(spark, sf):
    rows = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    split = F.when(F.col("lang") == "en", "train").when(F.col("lang") == "de", "val").otherwise("test")
    return labels.split_stats(rows.select(split.alias("split"), F.col("source").alias("query_id"), F.when(F.col("quality") == 1, "A").otherwise("B").alias("label")))


@query(f"""WITH {OUTLINE}, d AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY md5('7|'||repo||'|'||path||'|'||line_start), path, line_start) AS n FROM symbols)
SELECT repo, path, line_start, qualified_name, row_number() OVER (PARTITION BY repo ORDER BY string_split(path, '/'), line_start) - 1 AS query_index FROM d WHERE n <= 20""")
def sampled_symbols(spark, sf):
    return labels.sampled(corpus.outline(_files(spark, sf)), 20, "7").select("repo", "path", "line_start", "qualified_name", "query_index")


@query("""WITH n AS (SELECT page_id, regexp_replace(regexp_replace(lower(url), '/$', ''), '\\.git$', '') AS norm_url FROM pages) SELECT page_id, norm_url FROM n WHERE norm_url NOT IN (SELECT norm_url FROM n JOIN benchmark ON page_id = item_id)""")
def decontaminated_pages(spark, sf):
    pages = _t(spark, sf, "pages")
    bad = pages.join(_t(spark, sf, "benchmark").select(F.col("item_id").alias("page_id")), "page_id").select("url")
    return labels.decontaminated(pages.select("page_id", "url"), "url", bad, "url").select("page_id", "norm_url")


@query(f"""WITH {RANKED}, p AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS file_rank FROM ranked GROUP BY query_id, path), h AS (SELECT p.query_id, min(file_rank) AS file_rank FROM p JOIN truth USING (query_id, path) GROUP BY 1)
SELECT i.item_id AS query_id, file_rank, coalesce(file_rank <= 1, false) AS hit_1, coalesce(file_rank <= 3, false) AS hit_3, file_rank IS NOT NULL AS hit_any FROM benchmark i LEFT JOIN h ON item_id = query_id""")
def hit_at_k(spark, sf):
    hits = _hits(spark, sf)
    return evaluation.hit_at_k(cut(_ranked(spark, sf, hits)), _truth(hits), _items(spark, sf))


INSIDE = "(folder = '' OR path = folder OR starts_with(path, folder||'/'))"
RETRIEVE = f"""{OUTLINE}, qs AS (SELECT item_id AS query_id, upper(w[1])||lower(w[2:]) AS w, 'src'||(item_id % 10) AS repo, CASE WHEN item_id % 3 > 0 THEN 'src'||(item_id % 10)||CASE WHEN item_id % 2 = 0 THEN '/en' ELSE '/de' END ELSE '' END AS folder FROM (SELECT item_id, regexp_extract(text, '^([A-Za-z]+)', 1) AS w FROM benchmark)),
ia AS (SELECT query_id, repo, folder, [x FOR x IN [w, 'handled'] IF lower(x) NOT IN ({', '.join(f"'{x}'" for x in fn.STOPWORDS)}) AND (len(x) >= 4 OR len(x) = 3 AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]'))] AS names FROM qs),
ids AS (SELECT query_id, repo, folder, unnest(names) AS name, unnest(range(len(names))) AS nth FROM ia),
n_ids AS (SELECT query_id, count(*) AS n_original FROM ids GROUP BY 1),
sy AS (SELECT i.query_id, i.name AS asked, nth, s.*, row_number() OVER (PARTITION BY i.query_id, i.name ORDER BY string_split(path, '/'), line_start, qualified_name) AS n FROM symbols s JOIN ids i ON s.repo = i.repo AND contains(lower(qualified_name), lower(i.name)) WHERE {INSIDE}),
bw AS (SELECT *, [t FOR t IN regexp_split_to_array(lower(regexp_replace(regexp_replace(qualified_name, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')), '[^\\p{{L}}\\p{{N}}]+') IF t <> ''] AS terms FROM symbols),
bs AS (SELECT repo, count(*) AS n, avg(len(terms)) AS al FROM bw GROUP BY 1),
bf AS (SELECT repo, path, line_start, line_end, qualified_name, any_value(len(terms)) AS len, term, count(*) AS tf FROM (SELECT *, unnest(terms) AS term FROM bw) GROUP BY repo, path, line_start, line_end, qualified_name, term),
bd AS (SELECT repo, term, count(*) AS df FROM bf GROUP BY 1, 2),
bq AS (SELECT DISTINCT query_id, repo, folder, unnest(['where', 'is', lower(w), 'handled', 'in', 'src', query_id::VARCHAR]) AS term FROM qs),
bx AS (SELECT query_id, path, line_start, line_end, qualified_name, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al))), 6) AS score FROM bf JOIN bd USING (repo, term) JOIN bs USING (repo) JOIN bq USING (repo, term) WHERE {INSIDE} GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, string_split(path, '/'), line_start, qualified_name) AS n FROM bx),
bodies AS (SELECT s.*, array_to_string(list_slice(f.p, line_start, line_end), chr(10)) AS body FROM symbols s JOIN f USING (path)),
bo AS (SELECT i.query_id, i.name AS asked, nth, s.*, row_number() OVER (PARTITION BY i.query_id, i.name ORDER BY string_split(path, '/'), line_start, qualified_name) AS n FROM bodies s JOIN ids i ON s.repo = i.repo AND CASE WHEN i.name = 'handled' THEN contains(lower(body), 'handled') ELSE contains(body, i.name) END WHERE {INSIDE}),
gr AS (SELECT i.query_id, i.name AS asked, nth, l.*, row_number() OVER (PARTITION BY i.query_id, i.name ORDER BY string_split(path, '/'), line_no) AS n FROM lines l JOIN ids i ON l.repo = i.repo AND CASE WHEN i.name = 'handled' THEN contains(lower(line), 'handled') ELSE contains(line, i.name) END WHERE {INSIDE}),
fi AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY string_split(path, '/')) AS n FROM (SELECT DISTINCT q.query_id, f.path FROM f JOIN qs q ON f.repo = q.repo AND contains(string_split(f.path, '/')[-1], q.query_id::VARCHAR) WHERE {INSIDE})),
c AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY nth, string_split(path, '/'), line_start, qualified_name) AS raw_seq, path, line_start AS s, line_end AS e, qualified_name AS symbol, CASE WHEN name = asked THEN 'SymbolExact' ELSE 'SymbolFuzzy' END AS kind, NULL::VARCHAR AS snippet FROM sy WHERE n <= 20
UNION ALL SELECT query_id, 1000000 + n, path, line_start, line_end, qualified_name, 'SemanticHit', NULL FROM bm WHERE n <= 20
UNION ALL SELECT query_id, 2000000 + row_number() OVER (PARTITION BY query_id ORDER BY nth, string_split(path, '/'), line_start, qualified_name), path, line_start, line_end, qualified_name, 'SemanticHit', NULL FROM bo WHERE n <= 20
UNION ALL SELECT query_id, 3000000 + row_number() OVER (PARTITION BY query_id ORDER BY nth, string_split(path, '/'), line_no), path, line_no, line_no, NULL, 'ContentHit', line FROM gr WHERE n <= 20
UNION ALL SELECT query_id, 4000000 + n, path, 1, 1, NULL, 'FileNameHit', NULL FROM fi WHERE n <= 20),
kk AS (SELECT query_id, list(DISTINCT lower(name)) AS keys, []::VARCHAR[] AS strong FROM ids WHERE len(name) >= 4 GROUP BY 1), {MERGED}"""


def _retrieved(spark, sf):
    """Every item's first word, if it has one, as a question to one repository, two of three with a scope in it."""
    w, k = F.coalesce(F.regexp_extract("text", "^([A-Za-z]+)", 1), F.lit("")), F.col("query_id")
    asked = F.concat(F.lit("where is "), F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.char_length(w))), F.lit(" handled in src/"), k.cast("string"))
    repo = F.concat(F.lit("src"), (k % 10).cast("string"))
    scope = F.when(k % 3 > 0, F.concat(F.when(k % 5 == 0, "./").otherwise(""), repo, F.when(k % 2 == 0, "/en").otherwise("/de/"))).when(k % 2 == 0, "../up")
    queries = _items(spark, sf).select("query_id", asked.alias("text"), repo.alias("repo"), scope.alias("scope"))
    return retrieve_job.retrieve(queries, _files(spark, sf), cut(corpus.outline(_files(spark, sf))))


@query(f"WITH {RETRIEVE} SELECT * FROM ranked")
def retrieve(spark, sf):
    return _retrieved(spark, sf).ranked


@query(f"""WITH {RETRIEVE}, two AS (SELECT query_id, max(score) AS top, max(CASE WHEN rank = 2 THEN score END) AS second FROM ranked WHERE rank <= 2 GROUP BY 1),
trusted AS (SELECT c.query_id, symbol FROM c JOIN n_ids USING (query_id) WHERE kind = 'SymbolExact' AND n_original <= 2), dt AS (SELECT query_id, count(DISTINCT symbol) AS n FROM trusted GROUP BY 1),
rt AS (SELECT query_id, count(*) AS n FROM ranked WHERE kind = 'SymbolExact' GROUP BY 1),
d AS (SELECT i.query_id, CASE WHEN top IS NULL THEN 0 ELSE least(100, top // 10 + (top - coalesce(second, 0)) // 20) END AS confidence, coalesce(rt.n, 0) > 0 AS has_exact, coalesce(rt.n, 0) = 1 AND coalesce(dt.n, 0) <= 1 AS unique_trusted FROM qs i LEFT JOIN two USING (query_id) LEFT JOIN dt USING (query_id) LEFT JOIN rt USING (query_id))
SELECT *, CASE WHEN confidence >= 90 AND has_exact THEN 'confidence' WHEN unique_trusted THEN 'unique-symbol' WHEN confidence >= 30 THEN 'verify' ELSE 'fallback' END AS route FROM d""")
def retrieve_routes(spark, sf):
    return _retrieved(spark, sf).decisions


@query("""WITH s AS (SELECT source, count(*)::DOUBLE AS n, sum(toxic)::DOUBLE AS h FROM labels JOIN documents USING (doc_id) GROUP BY 1), z AS (SELECT *, h / n AS p, 1.959963984540054::DOUBLE AS z FROM s)
SELECT source, n::BIGINT AS n, round(p, 9) AS rate, round(greatest(0, (p + z*z/2/n) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/4/(n*n)) / (1 + z*z/n)), 9) AS low, round(least(1, (p + z*z/2/n) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/4/(n*n)) / (1 + z*z/n)), 9) AS high FROM z""")
def wilson_by_source(spark, sf):
    rows = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"))
    rate, low, high = evaluation.wilson(F.col("hits"), F.col("n"))
    return rows.select("source", "n", F.round(rate, 9).alias("rate"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(value) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, round(avg(value), 6) AS mean, min(CASE WHEN k = ceil(0.5 * n) THEN value END) AS p50, min(CASE WHEN k = ceil(0.95 * n) THEN value END) AS p95 FROM r GROUP BY 1""")
def latency_dist(spark, sf):
    return evaluation.distribution(_t(spark, sf, "events"), ["event_type"], "value").withColumn("mean", F.round("mean", 6))


@query("""WITH p(model, price) AS (VALUES ('A', 3.0::DOUBLE), ('R', 15.0::DOUBLE)), c AS (SELECT l_orderkey AS query_id, count(*) AS calls, count(price) AS priced_calls, sum(l_quantity) AS tokens, CASE WHEN bool_and(price IS NOT NULL) THEN sum(l_quantity * price / 1e6) END AS usd FROM lineitem LEFT JOIN p ON model = l_returnflag GROUP BY 1)
SELECT o_orderpriority AS cat, count(*) AS queries, sum(calls) AS calls, sum(priced_calls) AS priced_calls, count(usd) AS rows_fully_priced, round(sum(usd), 6) AS usd FROM c JOIN orders ON query_id = o_orderkey GROUP BY 1""")
def cost_by_priority(spark, sf):
    calls = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("tokens"))
    prices = spark.createDataFrame([("A", 3.0), ("R", 15.0)], "model string, usd_per_1m double")
    cost = evaluation.cost_per_query(calls, prices).join(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("cat")).hint("merge"), "query_id")
    return cost.groupBy("cat").agg(F.count("*").alias("queries"), F.sum("calls").alias("calls"), F.sum("priced_calls").alias("priced_calls"), F.count("usd").alias("rows_fully_priced"), F.round(F.sum("usd"), 6).alias("usd"))


@query("""WITH r AS (SELECT user_id AS query_id, count(*) AS n, count(*) FILTER (value > 50) AS passed FROM events GROUP BY 1) SELECT *, CASE WHEN passed = n THEN 'pass' WHEN passed > 0 THEN 'flaky' ELSE 'deterministic_failure' END AS class FROM r""")
def pass_classes(spark, sf):
    return evaluation.pass_classes(_t(spark, sf, "events").select(F.col("user_id").alias("query_id"), (F.col("value") > 50).alias("ok")))


@query(f"""WITH {SCORED}, b AS (SELECT p, sum(positive) AS pos, sum(1 - positive) AS neg FROM scored GROUP BY 1), w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b) SELECT round(sum(pos * (below + neg / 2::DOUBLE)) / (sum(pos) * sum(neg)), 9) AS auroc FROM w""")
def auroc(spark, sf):
    return calibration.auroc(_scored(spark, sf)).select(F.round("auroc", 9).alias("auroc"))


@query(f"""WITH {SCORED}, b AS (SELECT greatest(0, least(14, ceil(p * 15) - 1)) AS bin, count(*) AS n, avg(p) AS c, avg(positive) AS a FROM scored GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 9) AS ece FROM b""")
def ece(spark, sf):
    return calibration.ece(_scored(spark, sf)).select(F.round("ece", 9).alias("ece"))


@query(f"""WITH {SCORED}, t AS (SELECT unnest(range(30, 95, 5)) AS tau) SELECT tau, count(p) AS selected, round(sum(positive) / nullif(count(p), 0)::DOUBLE, 9) AS precision, round(coalesce(sum(positive), 0) / (SELECT sum(positive) FROM scored)::DOUBLE, 9) AS recall FROM t LEFT JOIN scored ON p >= tau / 100::DOUBLE GROUP BY 1""")
def precision_recall(spark, sf):
    return calibration.at_thresholds(_scored(spark, sf), list(range(30, 95, 5))).select("tau", "selected", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(f"""WITH {SCORED}, t AS (SELECT unnest(range(30, 95, 5)) AS tau), g AS (SELECT tau FROM t JOIN scored ON p >= tau / 100::DOUBLE GROUP BY 1 HAVING avg(positive) >= 0.9) SELECT coalesce(min(tau), 90) AS tau FROM g""")
def threshold_pick(spark, sf):
    return calibration.pick_threshold(_scored(spark, sf))


@query(f"""WITH {SCORED}, z AS (SELECT ln(greatest(0.001, least(0.999, p)) / (1 - greatest(0.001, least(0.999, p)))) AS z, positive FROM scored), t AS (SELECT unnest(range(50, 501)) AS t100), x AS (SELECT t100, CASE WHEN positive = 1 THEN z ELSE -z END / (t100 / 100::DOUBLE) AS s FROM z, t), l AS (SELECT t100, round(avg(ln(1 + exp(-abs(s))) + greatest(-s, 0)), 9) AS nll FROM x GROUP BY 1)
SELECT t100 / 100::DOUBLE AS temperature, round(nll, 6) AS nll FROM l ORDER BY l.nll, t100 LIMIT 1""")
def temperature_fit(spark, sf):
    p = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("p")))
    return calibration.fit_temperature(_scored(spark, sf).select(F.log(p / (1 - p)).alias("z"), "positive")).withColumn("nll", F.round("nll", 6))


@query(f"""WITH {SCORED}, b AS (SELECT query_id, max(positive) AS m, arg_min(positive, (-p, rank)) AS t FROM scored GROUP BY 1) SELECT count(*) AS n_queries, avg(t) AS top1 FROM b WHERE m = 1""")
def query_top1(spark, sf):
    return calibration.query_top1(_scored(spark, sf))


@query("""WITH o AS (SELECT source||'/'||doc_id AS path, sha256(text) AS d FROM documents WHERE source <> 'src4'), n AS (SELECT source||'/'||doc_id AS path, sha256(CASE WHEN source = 'src5' THEN text||'.' ELSE text END) AS d FROM documents WHERE source <> 'src3')
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.d IS NULL THEN 'added' WHEN n.d IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE o.d IS DISTINCT FROM n.d""")
def snapshot_diff(spark, sf):
    docs = _t(spark, sf, "documents").withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    old = docs.where("source <> 'src4'").select("path", F.sha2("text", 256).alias("digest"))
    new = docs.where("source <> 'src3'").select("path", F.sha2(F.when(F.col("source") == "src5", F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("digest"))
    return incremental.snapshot_diff(old, new)


@query("""WITH s AS (SELECT source AS repo, source||'/'||lang||'/'||doc_id AS path, sha256(text) AS d FROM documents), b AS (SELECT repo, substr(md5(path), 1, 2) AS k, sha256(string_agg(path||':'||d, chr(10) ORDER BY path||':'||d)) AS part FROM s GROUP BY ALL) SELECT repo, sha256(string_agg(k||':'||part, chr(10) ORDER BY k)) AS digest FROM b GROUP BY 1""")
def corpus_fingerprint(spark, sf):
    return incremental.fingerprint(corpus.file_stats(_files(spark, sf)))


@query("""WITH r AS (SELECT event_id, event_type, ts, value > 50 AS snap, lag(ts) OVER w AS l, lag(value > 50) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)), c AS (SELECT event_type, CASE WHEN l IS NULL OR epoch(date_trunc('second', ts)) - epoch(date_trunc('second', l)) > 86400 THEN 'miss' WHEN snap = s THEN 'l1' ELSE 'l2' END AS layer FROM r) SELECT event_type, layer, count(*) AS n FROM c GROUP BY ALL""")
def cache_hits(spark, sf):
    ev = _t(spark, sf, "events").select(F.struct("user_id", "event_type").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("request_id"), (F.col("value") > 50).alias("snapshot"))
    return incremental.cache_hits(ev, 86_400).groupBy(F.col("key.event_type").alias("event_type"), "layer").agg(F.count("*").alias("n"))


@query("""SELECT grp, key, bytes, total FROM (SELECT user_id AS grp, event_id AS key, length(props) AS bytes, sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events) WHERE total <= 200""")
def lru_budget(spark, sf):
    entries = _t(spark, sf, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("key"), F.octet_length("props").alias("bytes"), F.col("ts").alias("last_hit"))
    return incremental.within_budget(entries, "grp", 200).select("grp", "key", "bytes", "total")


@query(f"""WITH {LINES}, r AS (SELECT path, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY path ORDER BY line_no) AS total FROM lines) SELECT path, count(*) AS kept_lines, max(total) AS kept_bytes FROM r WHERE ceil(total / 4::DOUBLE) <= 750 GROUP BY 1""")
def token_budget_prefix(spark, sf):
    return incremental.prefix_within(_lines(spark, sf), 750)


@query("""WITH t AS (SELECT conv_id, turn, ceil(octet_length(encode(text)) / 4::DOUBLE)::BIGINT AS k FROM conversations), r AS (SELECT *, sum(k) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM t) SELECT conv_id, count(*) AS turns, sum(k) AS spent, min(CASE WHEN total >= 100 THEN turn END) AS crossed_at, greatest(count(*) FILTER (total >= 100) - 1, 0) AS after FROM r GROUP BY 1""")
def token_budget_conversation(spark, sf):
    return incremental.conversation_budget(_t(spark, sf, "conversations").select("conv_id", "turn", fn.estimate_tokens(F.col("text")).alias("tokens")), 100)


@query("""WITH RECURSIVE e AS (SELECT 'r'||n_regionkey AS src, 'n'||n_nationkey AS dst FROM nation UNION ALL SELECT 'n'||c_nationkey, 'c'||c_custkey FROM customer UNION ALL SELECT 'n'||s_nationkey, 's'||s_suppkey FROM supplier), t AS (SELECT 'r'||r_regionkey AS node, 0 AS hops FROM region WHERE r_name = 'ASIA' UNION SELECT dst, hops + 1 FROM t JOIN e ON node = src WHERE hops < 2) SELECT node, min(hops) AS hops FROM t GROUP BY 1""")
def path_trace(spark, sf):
    edge = lambda t, a, x, b, y: _t(spark, sf, t).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    edges = edge("nation", "r", "n_regionkey", "n", "n_nationkey").union(edge("customer", "n", "c_nationkey", "c", "c_custkey")).union(edge("supplier", "n", "s_nationkey", "s", "s_suppkey"))
    start = _t(spark, sf, "region").where("r_name = 'ASIA'").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return incremental.path_trace(edges, start, 2)


@query("SELECT conv_id, text, min(turn) AS turn, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id, text")
def first_wins(spark, sf):
    return incremental.first_wins(_t(spark, sf, "conversations"), ["conv_id", "text"], ["turn"])


@query("SELECT DISTINCT source||'_'||lang AS name, source||upper(lang[1])||lang[2:] AS variant FROM documents")
def case_variants(spark, sf):
    names = _t(spark, sf, "documents").select(F.concat_ws("_", "source", "lang").alias("name")).distinct()
    return names.withColumn("variant", fn.case_variant(F.col("name")))


PATTERNS = f"""p0 AS (SELECT item_id, text, string_split_regex(text, '\\s+') AS raw FROM benchmark),
p1 AS (SELECT item_id, [regexp_replace(regexp_replace(t, '^[^\\p{{L}}\\p{{N}}_/.]+', ''), '[^\\p{{L}}\\p{{N}}_/]+$', '') FOR t IN raw] AS toks FROM p0),
p2 AS (SELECT item_id, i, unnest(string_split_regex(toks[i], '[^\\p{{L}}\\p{{N}}_]+')) AS x, generate_subscripts(string_split_regex(toks[i], '[^\\p{{L}}\\p{{N}}_]+'), 1) AS j FROM (SELECT item_id, toks, unnest(generate_series(1, len(toks))) AS i FROM p1)),
p3 AS (SELECT item_id, x, i, j FROM p2 WHERE lower(x) NOT IN ({', '.join(f"'{x}'" for x in fn.STOPWORDS)}) AND NOT regexp_matches(x, '^[0-9]*$') AND (octet_length(encode(x)) >= 4 OR octet_length(encode(x)) = 3 AND (regexp_matches(x, '[_0-9]') OR regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]')))),
p4 AS (SELECT item_id, x, min((i, j)) AS first FROM p3 GROUP BY ALL), p5 AS (SELECT item_id, list(x ORDER BY first) AS identifiers FROM p4 GROUP BY 1)"""


@query(f"""WITH {PATTERNS} SELECT item_id, array_to_string(coalesce(identifiers, []), ' ') AS identifiers, array_to_string(coalesce(identifiers, [])[1:6], ' ') AS grep_patterns, coalesce(len(identifiers), 0) AS n_original, 0 AS n_literals, len([t FOR t IN toks IF contains(t, '/') OR regexp_matches(t, '^.+\\.[^.]+$')]) > 0 AS has_paths FROM p1 LEFT JOIN p5 USING (item_id)""")
def query_patterns(spark, sf):
    p = F.col("p")
    text = lambda xs: F.array_join(xs, " ")
    rows = _t(spark, sf, "benchmark").select("item_id", fn.derive_patterns(F.col("text")).alias("p"))
    return rows.select("item_id", text(p.identifiers).alias("identifiers"), text(p.grep_patterns).alias("grep_patterns"), p.n_original.alias("n_original"), F.size(p.literals).alias("n_literals"), (F.size(p.path_tokens) > 0).alias("has_paths"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL")
def telemetry_rollup(spark, sf):
    return telemetry.rollup(_t(spark, sf, "events"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL")
def telemetry_stream(spark, sf):
    got = telemetry.run_available(telemetry.rollup(telemetry.event_stream(spark, f"{sf}/events.parquet")))
    return got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH s AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS fresh FROM events), g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id, min(ts) AS begin, count(*) AS n, round(sum(value), 2) AS total FROM g GROUP BY user_id, k""")
def sessions(spark, sf):
    return telemetry.sessions(_t(spark, sf, "events"))


from . import answers, runs, state, statistics, training  # noqa: E402, F401
