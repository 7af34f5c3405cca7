"""Registered queries on training rows: filters, templates, states, labelled rows, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generation as gen
from ..operators import labels
from ..sources import corpus
from ..sources.scratch import cut
from .queries import LINES, OUTLINE, SCORED, _files, _scored, _t, query

PATHS = "pt AS (SELECT p_partkey, ['src/', 'tests/', 'lib/Docs/', 'a/vendor/', ''][(p_partkey % 5 + 1)::INT]||'m'||p_partkey||['.rs', '.PY', '.txt', '.test.ts', '_test.go', '.min.js', '.kt'][(p_partkey % 7 + 1)::INT] AS path FROM part)"


def _paths(spark, sf):
    k = F.col("p_partkey")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (k % n + 1).cast("int"))
    path = F.concat(pick(["src/", "tests/", "lib/Docs/", "a/vendor/", ""], 5), F.lit("m"), k.cast("string"), pick([".rs", ".PY", ".txt", ".test.ts", "_test.go", ".min.js", ".kt"], 7))
    return _t(spark, sf, "part").select("p_partkey", path.alias("path"))


@query(f"WITH {PATHS} SELECT path FROM pt WHERE p_partkey % 7 IN (0, 1, 6) AND p_partkey % 5 IN (0, 4)")
def source_paths(spark, sf):
    return _paths(spark, sf).where(gen.is_source_path(F.col("path"))).select("path")


GENERIC = ", ".join(f"'{x}'" for x in gen.GENERIC_NAMES)
SYMBOLS = f"""{OUTLINE}, wide AS (SELECT * REPLACE (line_end + line_start % 3 AS line_end) FROM symbols), good AS (SELECT * FROM wide WHERE line_end > line_start AND len(name) >= 4 AND lower(name) NOT IN ({GENERIC}))"""


def _sections(spark, sf):
    """Symbols of the documents' lines, two of three of them longer than a line."""
    return corpus.outline(_files(spark, sf)).withColumn("line_end", F.col("line_end") + F.col("line_start") % 3)


@query(f"WITH {SYMBOLS} SELECT repo, path, qualified_name, line_start, line_end FROM good")
def query_symbols(spark, sf):
    return gen.query_symbols(_sections(spark, sf))


WORDS = "[lower(w) FOR w IN string_split_regex(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '[_-]') IF w <> '']"
DRAWN = "('0x'||substr(md5('7|{what}|'||repo||'|'||path||'|'||line_start||'|'||qualified_name), 1, 12))::BIGINT"


@query(f"""WITH {SYMBOLS}, w AS (SELECT *, {WORDS} AS parts, CASE WHEN line_start % 3 = 0 THEN 'Returns the '||name||'.' END AS doc, CASE WHEN line_start % 4 = 0 THEN 'cannot open '||name END AS literal FROM good),
d AS (SELECT *, 2 + CASE WHEN len(parts) >= 2 THEN 6 ELSE 0 END + CASE WHEN doc IS NOT NULL THEN 6 ELSE 0 END + CASE WHEN literal IS NOT NULL THEN 4 ELSE 0 END AS total FROM w),
p AS (SELECT *, {DRAWN.format(what='template')} % total AS pick, {DRAWN.format(what='wording')} % 3 AS wording, CASE WHEN len(parts) >= 2 THEN 8 ELSE 2 END AS w2, CASE WHEN doc IS NOT NULL THEN 6 ELSE 0 END AS w3 FROM d),
t AS (SELECT *, CASE WHEN pick < 2 THEN 'define-en' WHEN pick < w2 THEN 'words-en' WHEN pick < w2 + w3 THEN 'doc-en' ELSE 'literal-en' END AS template FROM p)
SELECT repo, path, line_start, template, CASE template WHEN 'define-en' THEN 'where is '||name||' defined' WHEN 'words-en' THEN CASE wording WHEN 0 THEN 'where is the code that handles ' WHEN 1 THEN 'how does this project ' ELSE 'where do we ' END||array_to_string(parts, ' ') WHEN 'doc-en' THEN 'where is the code that returns the '||name ELSE 'where is the error "cannot open '||name||'" raised' END AS query FROM t""")
def templated_queries(spark, sf):
    symbols = gen.query_symbols(_sections(spark, sf))
    name = F.element_at(F.split("qualified_name", r"\."), -1)
    rows = symbols.withColumns({"doc": F.when(F.col("line_start") % 3 == 0, F.concat(F.lit("Returns the "), name, F.lit("."))), "literal": F.when(F.col("line_start") % 4 == 0, F.concat(F.lit("cannot open "), name))})
    return gen.with_query(rows, "7").select("repo", "path", "line_start", "template", "query")


@query("""WITH s AS (SELECT doc_id, unnest(string_split(translate(coalesce(text, ''), '"\\', ''), '. ')) AS s, unnest(range(len(string_split(translate(coalesce(text, ''), '"\\', ''), '. ')))) AS sentence FROM documents),
w AS (SELECT doc_id, sentence, array_to_string(regexp_extract_all(s, '[^ \\t\\n\\r\\f\\v]+'), ' ') AS q FROM s),
x AS (SELECT doc_id, sentence, q, len(string_split(q, ' ')) AS n, 'cannot read '||q AS e FROM w)
SELECT doc_id, sentence::INT AS sentence, CASE WHEN n BETWEEN 4 AND 25 AND NOT regexp_matches(q, 'TODO|FIXME') THEN CASE WHEN contains(q, '. ') THEN q[1:instr(q, '. ')] ELSE q END END AS doc, CASE WHEN len(e) BETWEEN 12 AND 120 THEN e END AS literal FROM x WHERE NOT regexp_matches(q, '^[@#/*!]') AND NOT regexp_matches(q, '\\*/$')""")
def doc_sentences(spark, sf):
    """Every sentence of every document as the comment and the message of a definition."""
    said = F.translate(F.coalesce("text", F.lit("")), '"\\', "")
    each = _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split(said, r"\. ")).alias("sentence", "s"))
    q = F.array_join(F.regexp_extract_all("s", F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0)), " ")
    # a row of one element is a border that filters don't cross: a sentence is put together once
    rows = each.select("doc_id", "sentence", F.explode(F.array(q)).alias("q")).where(~F.col("q").rlike(r"^[@#/*!]") & ~F.col("q").rlike(r"\*/$"))
    code = F.array(F.lit("let x = 1;"), F.concat(F.lit("  // "), F.col("q")), F.lit("#[inline]"), F.lit("fn read() {"), F.lit('log("not an error here");'), F.concat(F.lit('  bail!("cannot read '), F.col("q"), F.lit('")')), F.lit("}"))
    four, seven = F.lit(4), F.lit(7)
    return rows.select("doc_id", "sentence", gen.doc_sentence(code, four, seven, F.lit(False)).alias("doc"), gen.error_literal(code, four, seven).alias("literal"))


LABELLED = f"""{SCORED}, lr AS (SELECT s.*, CASE WHEN d.lang = 'en' THEN 'train' WHEN d.lang = 'de' THEN 'val' ELSE 'test' END AS split, d.source AS repo, d.lang, CASE WHEN s.positive = 1 THEN 'A' ELSE 'B' END AS label, CASE WHEN s.rank % 4 = 0 THEN 'define-en' ELSE 'words-en' END AS template FROM scored s JOIN documents d ON d.doc_id = s.rank)"""


def _labelled_rows(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("rank"), F.col("source").alias("repo"), "lang")
    split = F.when(F.col("lang") == "en", "train").when(F.col("lang") == "de", "val").otherwise("test")
    return _scored(spark, sf).join(docs, "rank").withColumns({"split": split, "label": F.when(F.col("positive") == 1, "A").otherwise("B"), "template": F.when(F.col("rank") % 4 == 0, "define-en").otherwise("words-en")})


@query(f"""WITH {LABELLED} SELECT repo||':'||lpad((rank % 1000)::VARCHAR, 6, '0') AS query_id, repo||':'||lpad((rank % 1000)::VARCHAR, 6, '0')||':'||lpad((rank % 12)::VARCHAR, 2, '0') AS id, '{{"relevant":{{"label":"'||label||'","probabilities":{{"A":'||CASE label WHEN 'A' THEN '1.0' ELSE '0.0' END||',"B":'||CASE label WHEN 'A' THEN '0.0' ELSE '1.0' END||'}}}}}}' AS gold, '{{"state":"q '||p||'"}}' AS state FROM lr""")
def training_rows(spark, sf):
    rows = _labelled_rows(spark, sf)
    rows = rows.select("repo", (F.col("rank") % 1000).alias("query_index"), (F.col("rank") % 12).alias("rank"), "label", F.concat(F.lit("q "), F.col("p").cast("string")).alias("state"))
    return gen.training_rows(rows).select("query_id", "id", "gold", "state")


@query(f"WITH {LABELLED}, k AS (SELECT split, unnest(['template', 'lang', 'query_lang']) AS key, unnest([template, lang, CASE WHEN lang = 'de' THEN 'de' ELSE 'en' END]) AS value FROM lr) SELECT split, key, value, count(*) AS n FROM k GROUP BY ALL")
def count_maps(spark, sf):
    return gen.count_maps(_labelled_rows(spark, sf).withColumn("query_lang", F.when(F.col("lang") == "de", "de").otherwise("en")))


NUMBERS = "files outline_errors symbols_total symbols_sampled queries_generated filtered_early_exit filtered_fallback queries_with_positive queries_without_positive rows_positive rows_negative".split()
COUNTERS = f"""{OUTLINE}, wf AS (SELECT doc_id, source AS repo, source||'/'||lang||'/'||doc_id AS path FROM documents WHERE doc_id % 6 > 0 AND doc_id % 5 > 1),
fn AS (SELECT repo, count(*) AS files, count(*) FILTER (doc_id % 13 = 0) AS outline_errors FROM wf GROUP BY 1), n AS (SELECT s.repo, count(*) AS symbols_total, least(count(*), 30) AS symbols_sampled FROM symbols s JOIN wf USING (path) GROUP BY 1),
lb AS (SELECT doc_id, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg FROM labels GROUP BY 1),
gq AS (SELECT source AS repo, count(*) AS queries_generated, count(*) FILTER (doc_id % 5 = 0) AS filtered_early_exit, count(*) FILTER (doc_id % 5 = 1) AS filtered_fallback, count(*) FILTER (doc_id % 5 > 1 AND coalesce(pos, 0) > 0) AS queries_with_positive, count(*) FILTER (doc_id % 5 > 1 AND coalesce(pos, 0) = 0) AS queries_without_positive, coalesce(sum(pos), 0) AS rows_positive, coalesce(sum(neg), 0) AS rows_negative,
 count(*) FILTER (doc_id % 3 = 0) AS t0, count(*) FILTER (doc_id % 3 > 0) AS t1 FROM documents LEFT JOIN lb USING (doc_id) GROUP BY 1),
counters AS (SELECT repo, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in NUMBERS)}, coalesce(t0, 0) AS t0, coalesce(t1, 0) AS t1 FROM fn LEFT JOIN n USING (repo) LEFT JOIN gq USING (repo))"""
TEMPLATES = "CASE WHEN t0 > 0 THEN 'define-en='||t0 ELSE '' END||CASE WHEN t0 > 0 AND t1 > 0 THEN ',' ELSE '' END||CASE WHEN t1 > 0 THEN 'words-en='||t1 ELSE '' END AS templates"


def _source_path(k, repo="source"):
    """A path for each document: some in a folder of others' code, some no source, some tests."""
    return F.concat(F.col(repo), F.when(k % 6 == 0, "/vendor/").otherwise("/core/"), F.lit("d"), k.cast("string"), F.when(k % 5 == 0, ".txt").when(k % 5 == 1, "_test.go").otherwise(".rs"))


def _counters(spark, sf):
    k = F.col("doc_id")
    rows = _t(spark, sf, "documents").select("doc_id", "source", F.concat_ws("/", "source", "lang", k.cast("string")).alias("old"), _source_path(k).alias("path"))
    files = gen.source_files(rows.select("doc_id", F.col("source").alias("repo"), "path", "old"))
    symbols = corpus.outline(_files(spark, sf)).join(files.select(F.col("old").alias("path"), F.col("path").alias("new")), "path").drop("path").withColumnRenamed("new", "path")
    sampled = labels.sampled(symbols, 30, "7")
    queries = rows.select(F.col("source").alias("repo"), F.col("doc_id").alias("query_id"), F.when(k % 3 == 0, "define-en").otherwise("words-en").alias("template"))
    routes = queries.select("query_id", F.when(F.col("query_id") % 5 == 0, "confidence").when(F.col("query_id") % 5 == 1, "fallback").otherwise("verify").alias("route"))
    labelled = _t(spark, sf, "labels").select(k.alias("query_id"), F.when(F.col("quality") == 1, "A").otherwise("B").alias("label")).join(queries.select("repo", "query_id"), "query_id")
    return gen.repo_counters(files, symbols, sampled, queries, routes, labelled, files.where(k % 13 == 0).select("repo", "path"))


def _told(df):
    """A map of templates as text."""
    return df.withColumn("templates", F.array_join(F.transform(F.map_entries("templates"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ","))


@query(f"WITH {COUNTERS} SELECT repo, {', '.join(NUMBERS)}, {TEMPLATES} FROM counters")
def repo_counters(spark, sf):
    return _told(_counters(spark, sf))


@query(f"WITH {COUNTERS}, t AS (SELECT CASE WHEN repo IN ('src0', 'src1') THEN 'val' ELSE 'train' END AS split, count(*) AS repos, {', '.join(f'sum({c})::BIGINT AS {c}' for c in NUMBERS)}, sum(t0)::BIGINT AS t0, sum(t1)::BIGINT AS t1 FROM counters GROUP BY 1) SELECT split, repos, {', '.join(NUMBERS)}, {TEMPLATES} FROM t")
def totals_by_split(spark, sf):
    counters = _counters(spark, sf)
    return _told(gen.totals_by_split(counters, counters.select("repo", F.when(F.col("repo").isin("src0", "src1"), "val").otherwise("train").alias("split"))))


@query("""WITH s AS (SELECT source AS repo, source||'/'||lang||'/'||doc_id AS path, sha256(text) AS d FROM documents), b AS (SELECT repo, substr(md5(path), 1, 2) AS k, sha256(string_agg(path||':'||d, chr(10) ORDER BY path||':'||d)) AS part FROM s GROUP BY ALL), r AS (SELECT repo, sha256(string_agg(k||':'||part, chr(10) ORDER BY k)) AS digest FROM b GROUP BY 1), c AS (SELECT source AS repo, count(*) AS files FROM documents GROUP BY 1)
SELECT '{"max_queries":400,"seed":"7"}' AS settings, (SELECT '['||string_agg('{"repo":"'||repo||'","split":"train","files":'||files||'}', ',' ORDER BY repo)||']' FROM c) AS repos, (SELECT '[{"split":"train","repos":'||count(*)||',"files":'||sum(files)||'}]' FROM c) AS totals, (SELECT sha256(string_agg(repo||':'||digest, chr(10) ORDER BY repo||':'||digest)) FROM r) AS corpus_sha256""")
def manifest(spark, sf):
    files = _files(spark, sf)
    counters = files.groupBy("repo").agg(F.count("*").alias("files"))
    return gen.manifest(counters, counters.select("repo", F.lit("train").alias("split")), corpus.file_stats(files), {"seed": "7", "max_queries": 400})


@query(f"""WITH {LINES}, s AS (SELECT d.doc_id, d.lang, f.path, f.text, len(f.p) AS n FROM documents d JOIN f ON f.path = d.source||'/'||d.lang||'/'||d.doc_id)
SELECT doc_id, 'query: find '||doc_id||' now'||chr(10)||'candidate: '||path||':1-'||n||' (text match'||CASE WHEN doc_id % 2 = 0 THEN ', symbol `s'||doc_id||'`' ELSE '' END||')'||chr(10)||CASE WHEN text = '' THEN 'code: (unavailable)' ELSE 'code:'||chr(10)||array_to_string(['  '||regexp_replace(x, '\\r$', '')[1:200] FOR x IN string_split(text, chr(10))[1:60]], chr(10)) END||CASE WHEN doc_id % 3 = 0 THEN chr(10)||'outline:'||chr(10)||lang ELSE '' END AS state FROM s""")
def rendered_states(spark, sf):
    k = F.col("doc_id")
    rows = _t(spark, sf, "documents").withColumn("path", F.concat_ws("/", "source", "lang", k.cast("string")))
    n, one, none = F.size(F.split("text", "\n")), F.lit(1), F.lit(None).cast("string")
    ask = F.concat(F.lit(" find "), k.cast("string"), F.lit("\nnow "))
    state = gen.rendered_state(ask, F.col("path"), one, n, F.lit("text match"), F.when(k % 2 == 0, F.concat(F.lit("s"), k.cast("string"))), F.col("text"), none, F.when(k % 3 == 0, F.col("lang")))
    return rows.select("doc_id", state.alias("state"))


@query(f"""WITH {OUTLINE}, o2 AS (SELECT *, lag(qualified_name) OVER (PARTITION BY repo, path ORDER BY line_start, line_end, qualified_name) AS last FROM symbols), o3 AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY line_start, line_end, qualified_name) AS nth FROM o2 WHERE last IS DISTINCT FROM qualified_name)
SELECT repo, path, string_agg(line_start||'-'||line_end||' '||qualified_name, chr(10) ORDER BY nth) AS outline FROM o3 WHERE nth <= 30 GROUP BY 1, 2""")
def file_outlines(spark, sf):
    return gen.file_outlines(corpus.outline(_files(spark, sf)))


@query("""WITH c AS (SELECT l_orderkey AS query_id, 'p'||(l_partkey % 3) AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank, l_returnflag AS kind, l_linenumber AS line_start, 'o'||(l_partkey % 3) AS outline FROM lineitem),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY rank) = 1 AS first FROM c)
SELECT query_id, string_agg(rank||'. '||path||':'||line_start||'-'||(line_start + 3)||' ('||kind||')'||CASE WHEN first THEN chr(10)||outline ELSE '' END, chr(10) ORDER BY rank) AS block FROM d GROUP BY 1""")
def candidates_block(spark, sf):
    from pyspark.sql import Window

    third = (F.col("l_partkey") % 3).cast("string")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("p"), third).alias("path"), F.row_number().over(w).alias("rank"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("line_start"), (F.col("l_linenumber") + 3).alias("line_end"), F.concat(F.lit("o"), third).alias("outline"))
    return gen.candidates_block(rows)


@query("SELECT pass, row_number() OVER (PARTITION BY pass ORDER BY md5(pass||'|'||item_id), item_id) AS place, item_id AS query_id FROM benchmark, range(1, 4) r(pass)")
def shuffled_queries(spark, sf):
    return gen.shuffled(_t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")), 3)


@query("""WITH r AS (SELECT c_custkey % 4 AS version, CASE WHEN c_custkey % 10 = 0 THEN 'Bad Name' ELSE 'repo-'||(c_custkey // 2) END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'http' ELSE 'https' END||'://host/'||c_custkey AS url, CASE WHEN c_custkey % 7 = 0 THEN 'HEAD' ELSE md5(c_custkey::VARCHAR)||'00000000' END AS rev, ['MIT', 'ISC', 'GPL-3.0'][(c_custkey % 3 + 1)::INT] AS license, ['rust', 'go', 'cobol'][(c_custkey % 3 + 1)::INT] AS lang, ['train', 'val', 'other'][(c_custkey % 3 + 1)::INT] AS split FROM customer),
m AS (SELECT *, count(*) OVER (PARTITION BY name) AS many FROM r), v AS (SELECT name, url, [x FOR x IN [CASE WHEN version <> 1 THEN 'version' END, CASE WHEN name = 'Bad Name' THEN 'name' END, CASE WHEN many > 1 THEN 'name is duplicated' END, CASE WHEN url NOT LIKE 'https://%' THEN 'url' END, CASE WHEN rev = 'HEAD' THEN 'rev' END, CASE WHEN license = 'GPL-3.0' THEN 'license' END, CASE WHEN lang = 'cobol' THEN 'lang' END, CASE WHEN split = 'other' THEN 'split' END] IF x IS NOT NULL] AS violations FROM m)
SELECT name, array_to_string(violations, ',') AS violations FROM v WHERE len(violations) > 0""")
def corpus_violations(spark, sf):
    k = F.col("c_custkey")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % 3 + 1).cast("int"))
    name = F.when(k % 10 == 0, "Bad Name").otherwise(F.concat(F.lit("repo-"), F.floor(k / 2).cast("string")))
    rev = F.when(k % 7 == 0, "HEAD").otherwise(F.concat(F.md5(k.cast("string")), F.lit("00000000")))
    repos = _t(spark, sf, "customer").select((k % 4).alias("version"), name.alias("name"), F.concat(F.when(k % 3 == 0, "http").otherwise("https"), F.lit("://host/"), k.cast("string")).alias("url"), rev.alias("rev"), pick(["MIT", "ISC", "GPL-3.0"]).alias("license"), pick(["rust", "go", "cobol"]).alias("lang"), pick(["train", "val", "other"]).alias("split"))
    return gen.corpus_violations(repos).withColumn("violations", F.array_join("violations", ","))


@query("""SELECT conv_id * 1000 + turn AS request_id, CASE WHEN turn % 3 = 0 THEN 'query is blank' ELSE 'max_results is zero' END AS error FROM conversations WHERE turn % 3 = 0 OR turn % 2 = 0""")
def invalid_requests(spark, sf):
    t = F.col("turn")
    rows = _t(spark, sf, "conversations").select((F.col("conv_id") * 1000 + t).alias("request_id"), F.when(t % 3 == 0, F.when(t % 2 == 0, " ")).otherwise("ask").alias("query"), F.when(t % 2 == 0, 0).otherwise(5).alias("max_results"))
    return gen.invalid_requests(rows)


@query("""SELECT source AS repo, bool_or(doc_id % 97 = 0) AS licensed FROM documents GROUP BY 1""")
def licensed_repos(spark, sf):
    k = F.col("doc_id")
    path = F.when(k % 97 == 0, F.element_at(F.array(*map(F.lit, ("LICENSE", "licence.md", "COPYING"))), (k % 3 + 1).cast("int"))).when(k % 5 == 0, "sub/LICENSE").otherwise(F.concat(F.lit("a"), k.cast("string")))
    return labels.has_licence(_t(spark, sf, "documents").select(F.col("source").alias("repo"), path.alias("path")))


@query()
def generated_rows(spark, sf):
    """Training rows of all documents seen as files: retrieval within each source, queries from the symbols of source files, labels from the symbol asked for."""
    # a path ends with its document's number, of which the new one is made
    number = F.element_at(F.split("path", "/"), -1).try_cast("long")
    moved = lambda df: df.withColumn("path", _source_path(number, "repo"))
    files = moved(_files(spark, sf))
    repos = files.groupBy("repo").agg(F.min("lang").alias("lang")).withColumn("split", F.when(F.col("repo").isin("src0", "src1"), "val").otherwise("train"))
    rows, _ = gen.generate_training_rows(files, cut(moved(_sections(spark, sf))), repos)
    return rows.select("id", "repo", "split", "query", "template", "rank", "kind", "label", "state", "gold")
