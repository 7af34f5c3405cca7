"""Training rows from a corpus: filters, queries by template, states, labelled rows, counters and manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once, short_name, words
from ..sources.scratch import cut
from . import labels
from .ranges import numbered
from .ranking import NOTES
from .retrieval import among, body_window

# Fixed values.
EXTENSIONS = ["rs", "py", "ts", "tsx", "js", "jsx", "mjs", "go", "java", "kt"]
EXCLUDED_FOLDERS = ["test", "tests", "testdata", "testing", "__tests__", "vendor", "node_modules", "third_party", "dist", "build", "target", "examples", "benches", "fixtures", "docs"]
GENERIC_NAMES = """main init __init__ new default from into fmt drop clone hash test setup run get set len call next build close open
read write apply invoke equals hashcode tostring compareto iter item value values keys""".split()
LICENCES = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT OR Apache-2.0", "MIT OR Unlicense"]
LANGUAGES = ["rust", "python", "typescript", "javascript", "go", "java", "kotlin"]
SPLITS = ["train", "val", "test"]
ERROR_MARKS = ["panic!(", "bail!(", "anyhow!(", "ensure!(", "Err(", "raise ", "throw ", "errors.New(", "fmt.Errorf(", "Exception(", "Error("]
QUESTION = {"instructions": "Does this code location answer the repository search query?", "A": "yes, this location answers the query", "B": "no, this location does not answer the query"}
WEIGHTS = {"define-en": 2, "words-en": 6, "doc-en": 6, "literal-en": 4}


def is_source_path(path: Column) -> Column:
    """A source file by its extension, outside of folders for tests and the like, and no test or bundle by its name."""
    parts = F.transform(F.split(path, "/"), F.lower)
    name = F.element_at(parts, -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    odd = name.rlike(r"(_test\.go|_test\.py|\.min\.js|\.d\.ts)$|^test_.*\.py$|\.test\.|\.spec\.")
    return F.regexp_extract(name, r"\.([^.]*)$", 1).isin(EXTENSIONS) & ~F.arrays_overlap(folders, F.array(*map(F.lit, EXCLUDED_FOLDERS))) & ~odd


def query_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols (repo, path, qualified_name, line_start, line_end) worth a query: of more than one line, with a name of four characters that isn't generic; the first of each range."""
    name = short_name(F.col("qualified_name"))
    good = symbols.where((F.col("line_start") > 0) & (F.col("line_end") > F.col("line_start")) & (F.char_length(name) >= 4) & ~F.lower(name).isin(GENERIC_NAMES))
    w = Window.partitionBy("repo", "path", "line_start", "line_end").orderBy("qualified_name")
    return good.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def corpus_violations(repos: DataFrame) -> DataFrame:
    """(name, violations) of the rows (version, name, url, rev, license, lang, split) that break a rule, each named by its field."""
    many = F.count("*").over(Window.partitionBy("name")) > 1
    bad = lambda test, field: F.when(~F.coalesce(test, F.lit(False)), F.lit(field))
    rules = [bad(F.col("version") == 1, "version"), bad(F.col("name").rlike("^[a-z0-9._-]+$"), "name"), F.when(F.col("many"), F.lit("name is duplicated")), bad(F.startswith("url", F.lit("https://")), "url"), bad(F.col("rev").rlike("^[0-9a-f]{40}$"), "rev"), bad(F.col("license").isin(LICENCES), "license"), bad(F.col("lang").isin(LANGUAGES), "lang"), bad(F.col("split").isin(SPLITS), "split")]
    return repos.withColumn("many", many).select("name", F.array_compact(F.array(*rules)).alias("violations")).where(F.size("violations") > 0)


def invalid_requests(requests: DataFrame) -> DataFrame:
    """(request_id, error) of requests (request_id, query, max_results) that can't be answered."""
    error = F.when(F.trim(F.coalesce("query", F.lit(""))) == "", "query is blank").when(F.col("max_results") == 0, "max_results is zero")
    return requests.select("request_id", error.alias("error")).where("error is not null")


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def doc_sentence(rows: Column, start: Column, end: Column, python: Column) -> Column:
    """The first sentence of a symbol's documentation, from the lines (array) of its file; null if there is none of 4 to 25 words.

    It is the comment right above the definition, attributes and decorators skipped, or, in
    Python, the docstring's first line.
    """
    above = F.reverse(F.transform(F.slice(rows, F.lit(1), F.greatest(start - 1, F.lit(0))), _stripped))
    plain = F.filter(above, lambda t: ~t.rlike(r"^(#\[|#!|@)"))
    is_comment = lambda t: t.rlike(r"^(//|/\*|\*|#)")
    upto = lambda lines: once(F.array_position(F.transform(lines, is_comment), False), lambda stop: F.reverse(F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)))
    bare = F.transform(once(plain, upto), lambda t: _stripped(F.regexp_replace(_stripped(F.regexp_replace(t, r"\*/$", "")), r"^(///|//!|/\*\*|//|/\*|\*|#)", "")))
    comment = F.filter(bare, lambda t: (t != "") & ~F.startswith(t, F.lit("@")))
    body = F.filter(F.transform(F.slice(rows, start + 1, F.greatest(end - start, F.lit(0))), _stripped), lambda t: t != "")
    first = F.coalesce(F.get(body, F.lit(0)), F.lit(""))
    quoted = _stripped(F.regexp_replace(F.regexp_extract(first, r"^(\"\"\"|''')(.*)$", 2), r"(\"\"\"|''').*$", ""))
    none = F.array().cast("array<string>")
    docstring = F.when(python, once(quoted, lambda q: F.when(q != "", F.array(q)).otherwise(none))).otherwise(none)
    said = once(comment, lambda c: F.array_join(F.when(F.size(c) > 0, c).otherwise(docstring), " "))
    return once(_stripped(F.regexp_replace(said, r"\s+", " ")), _first_sentence)


def _first_sentence(text: Column) -> Column:
    """Of documentation in one line; null unless it has 4 to 25 words."""
    count = F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))
    good = count.between(4, 25) & ~text.rlike(r"TODO|FIXME|^@|^#")
    cut = F.locate(". ", text)
    return F.when(good, F.when(cut > 0, F.substring(text, F.lit(1), cut)).otherwise(text))


def error_literal(rows: Column, start: Column, end: Column) -> Column:
    """The first quoted message of 12 to 120 characters and two words or more on a line that raises an error; null if there is none."""
    own = F.slice(rows, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0)))
    marked = F.filter(own, lambda t: F.reduce(F.array(*map(F.lit, ERROR_MARKS)), F.lit(False), lambda a, m: a | F.contains(t, m)))
    texts = F.transform(marked, lambda t: F.regexp_extract(t, r'^[^"]*"([^"\\]*+(?:\\.[^"\\]*+)*+)"', 1))
    good = F.filter(texts, lambda t: F.char_length(t).between(12, 120) & (F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) >= 2))
    return F.get(good, F.lit(0))


def _draw(parts: list[Column], what: str, seed: str, n: Column) -> Column:
    """A number below n, by digest of a key."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.lit(what), *(p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % n


def with_query(symbols: DataFrame, seed: str) -> DataFrame:
    """Symbols with template, query and query_lang, from qualified_name, doc and literal (either may be null): a template drawn by weight among those that apply, and one of three wordings."""
    name = short_name(F.col("qualified_name"))
    parts = words(name)
    key = [F.col(c) for c in ("repo", "path", "line_start", "qualified_name")]
    applies = {"define-en": F.lit(True), "words-en": F.size(parts) >= 2, "doc-en": F.col("doc").isNotNull(), "literal-en": F.col("literal").isNotNull()}
    weight = {t: F.when(applies[t], w).otherwise(0) for t, w in WEIGHTS.items()}
    total = sum(weight.values(), F.lit(0))
    rows = symbols.withColumns({"pick": _draw(key, "template", seed, total), "wording": _draw(key, "wording", seed, F.lit(3)), **{f"w{i}": w for i, w in enumerate(weight.values())}})
    upto, template = F.lit(0), None
    for i, t in enumerate(WEIGHTS):
        upto = upto + F.col(f"w{i}")
        template = F.when(F.col("pick") < upto, t) if template is None else template.when(F.col("pick") < upto, t)
    said = F.array_join(parts, " ")
    doc = F.regexp_replace(F.concat(F.lower(F.substring("doc", 1, 1)), F.substring("doc", F.lit(2), F.char_length("doc"))), r"\.$", "")
    text = (
        F.when(F.col("template") == "define-en", F.concat(F.lit("where is "), name, F.lit(" defined")))
        .when(F.col("template") == "words-en", F.concat(F.when(F.col("wording") == 0, "where is the code that handles ").when(F.col("wording") == 1, "how does this project ").otherwise("where do we "), said))
        .when(F.col("template") == "doc-en", F.concat(F.lit("where is the code that "), doc))
        .otherwise(F.concat(F.lit('where is the error "'), F.col("literal"), F.lit('" raised')))
    )
    return rows.withColumn("template", template).withColumns({"query": text, "query_lang": F.lit("en")}).drop("pick", "wording", *(f"w{i}" for i in range(len(WEIGHTS))))


def source_files(files: DataFrame) -> DataFrame:
    """The files that queries are made of: source paths alone."""
    return files.where(is_source_path(F.col("path")))


def sampled_symbols(symbols: DataFrame, seed: str = "7", max_queries: int = 400) -> DataFrame:
    """Of each repository a seeded sample of its symbols worth a query, three times as many as there may be queries, numbered in their order (query_index)."""
    return labels.sampled(query_symbols(symbols), 3 * max_queries, seed)


def generated_queries(symbols: DataFrame, files: DataFrame, seed: str = "7", max_queries: int = 400) -> DataFrame:
    """Of each repository up to max_queries symbols with a query, numbered in their order: the first of the sample."""
    return queries_of(cut(sampled_symbols(symbols, seed, max_queries)), files, seed, max_queries)


def queries_of(sampled: DataFrame, files: DataFrame, seed: str, max_queries: int) -> DataFrame:
    picked = sampled.where(F.col("query_index") < max_queries)
    own = among(files, picked, ["repo", "path"])
    split = own.select("repo", "path", F.transform(F.split("content", "\n"), lambda t: F.regexp_replace(t, r"\r\z", "")).alias("rows"))
    start, end = F.col("line_start").cast("int"), F.col("line_end").cast("int")
    rows = picked.join(split, ["repo", "path"]).withColumns({"doc": doc_sentence(F.col("rows"), start, end, F.endswith("path", F.lit(".py"))), "literal": error_literal(F.col("rows"), start, end)}).drop("rows")
    return with_query(rows, seed)


def rendered_state(query: Column, path: Column, start: Column, end: Column, kind: Column, symbol: Column, body: Column, snippet: Column, outline: Column, most_lines: int = 60, most_chars: int = 200, most_outline: int = 30) -> Column:
    """The text that a judge reads: query, candidate, code (its body, else its snippet) and outline."""
    lines = lambda x, n: F.slice(F.split(x, "\n"), 1, n)
    filled = lambda x: F.when(x != "", x)
    named = F.when(symbol.isNotNull(), F.concat(F.lit(", symbol `"), symbol, F.lit("`"))).otherwise("")
    place = F.concat(F.lit("candidate: "), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" ("), kind, named, F.lit(")"))
    source = F.coalesce(filled(body), filled(snippet))
    code = F.concat(F.lit("code:\n"), F.array_join(F.transform(lines(source, most_lines), lambda t: F.concat(F.lit("  "), F.substring(F.regexp_replace(t, r"\r\z", ""), 1, most_chars))), "\n"))
    view = F.concat(F.lit("outline:\n"), F.array_join(lines(filled(outline), most_outline), "\n"))
    return F.concat_ws("\n", F.concat(F.lit("query: "), F.trim(F.translate(query, "\r\n", "  "))), place, F.coalesce(code, F.lit("code: (unavailable)")), view)


def file_outlines(symbols: DataFrame, most: int = 30) -> DataFrame:
    """(repo, path, outline): the first names of each file in the order of their lines, a name that follows itself once."""
    w = Window.partitionBy("repo", "path").orderBy("line_start", "line_end", "qualified_name")
    rows = symbols.withColumn("last", F.lag("qualified_name").over(w)).where(~F.col("last").eqNullSafe(F.col("qualified_name")))
    rows = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    line = F.concat(F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit(" "), F.col("qualified_name"))
    return rows.groupBy("repo", "path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", line.alias("line")))), lambda x: x.line), "\n").alias("outline"))


def candidates_block(candidates: DataFrame) -> DataFrame:
    """(query_id, block): the candidates of a query as a numbered list, each file's outline under its first."""
    first = F.row_number().over(Window.partitionBy("query_id", "path").orderBy("rank")) == 1
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("path"), F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit(" ("), F.col("kind"), F.lit(")"))
    text = F.concat_ws("\n", line, F.when(F.col("first") & (F.col("outline") != ""), F.col("outline")))
    rows = candidates.withColumn("first", first)
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", text.alias("text")))), lambda x: x.text), "\n").alias("block"))


def training_rows(rows: DataFrame) -> DataFrame:
    """Rows (repo, lang, split, query_index, query, query_lang, template, rank, kind, label, state) with id, query_id, and state, questions and gold as JSON in strings."""
    query_id = F.concat(F.col("repo"), F.lit(":"), F.lpad(F.col("query_index").cast("string"), 6, "0"))
    made = rows.withColumn("query_id", query_id).withColumn("id", F.concat("query_id", F.lit(":"), F.lpad(F.col("rank").cast("string"), 2, "0")))
    hit = (F.col("label") == "A").cast("double")
    gold = F.struct(F.struct("label", F.struct(hit.alias("A"), (1 - hit).alias("B")).alias("probabilities")).alias("relevant"))
    asked = F.struct(F.struct(F.struct(F.lit(QUESTION["A"]).alias("A"), F.lit(QUESTION["B"]).alias("B")).alias("criteria"), F.lit(QUESTION["instructions"]).alias("instructions"), F.lit("choice").alias("type")).alias("relevant"))
    return made.withColumns({"state": F.to_json(F.struct("state")), "questions": F.to_json(asked), "gold": F.to_json(gold)})


def generate_training_rows(files: DataFrame, symbols: DataFrame, repos: DataFrame, seed: str = "7", max_queries: int = 400, max_negatives: int = 4, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, counters): labelled rows for training from files (repo, path, content), symbols and repos (repo, lang, split).

    Queries are made of the symbols of source files and answered within their repository, all
    files of it. Queries that an early exit or the fallback would take give no rows. Of the
    others, candidates that touch the symbol asked for are positive, and of the rest the first by
    rank are kept. failed (repo, path) are files whose outline could not be had; they are counted.
    """
    from . import retrieve

    walked = source_files(files)
    worth = cut(query_symbols(symbols.join(walked.select("repo", "path").distinct(), ["repo", "path"], "left_semi")))
    sampled = cut(labels.sampled(worth, 3 * max_queries, seed))
    made = cut(queries_of(sampled, files, seed, max_queries).withColumn("query_id", F.concat(F.col("repo"), F.lit(":"), F.lpad(F.col("query_index").cast("string"), 6, "0"))))
    got = retrieve.retrieve(made.select("query_id", F.col("query").alias("text"), "repo"), files, symbols)
    decisions = cut(got.decisions)
    asked = made.select("query_id", "repo", "query_index", "query", "query_lang", "template")
    judged = got.ranked.join(decisions.where("route = 'verify'").select("query_id"), "query_id", "left_semi").where("line_start > 0")
    truth = made.select("query_id", "path", F.col("line_start").alias("span_start"), F.col("line_end").alias("span_end"))
    picked = cut(labels.capped_negatives(labels.interval_labels(judged, truth), max_negatives))
    # bodies and outlines are made of the files that candidates lie in alone
    near = lambda df: among(df, picked, ["path"])
    seen = body_window(picked.join(asked, "query_id"), near(files)).join(file_outlines(near(symbols)), ["repo", "path"], "left")
    label = F.create_map(*(F.lit(x) for k, v in NOTES.items() for x in (k, v)))[F.col("kind")]
    state = rendered_state(F.col("query"), F.col("path"), F.col("line_start"), F.col("line_end"), label, F.col("symbol"), F.col("body"), F.col("snippet"), F.col("outline"))
    rows = cut(training_rows(seen.withColumn("state", state).withColumn("kind", label).join(repos, "repo").select("repo", "lang", "split", "query_index", "query", "query_lang", "template", "rank", "kind", "label", "state")))
    return rows, repo_counters(walked, worth, sampled, made, decisions, rows, failed)


def repo_counters(files: DataFrame, symbols: DataFrame, sampled: DataFrame, queries: DataFrame, decisions: DataFrame, rows: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row for each repository with a file: what went in and what came of it, zeros included.

    (repo, files, outline_errors, symbols_total, symbols_sampled, queries_generated,
    filtered_early_exit, filtered_fallback, queries_with_positive, queries_without_positive,
    rows_positive, rows_negative, templates), the last a map of queries by template, from source
    files (repo, path), symbols and those sampled (repo), queries (repo, query_id, template), their
    routes (query_id, route), labelled rows (repo, query_id, label) and files that failed (repo, path).
    A query of the route verify without rows has no positive.
    """
    count = lambda df, name: df.groupBy("repo").agg(F.count("*").alias(name))
    walked = files.select("repo", "path").distinct()
    got = count(walked, "files")
    bad = count(failed.select("repo", "path").distinct().join(walked, ["repo", "path"], "left_semi"), "outline_errors") if failed is not None else got.select("repo", F.lit(0).cast("long").alias("outline_errors"))
    by = rows.groupBy("repo", "query_id").agg(F.count_if(F.col("label") == "A").alias("pos"), F.count_if(F.col("label") != "A").alias("neg"))
    routed = queries.select("repo", "query_id").join(decisions.select("query_id", "route"), "query_id", "left").join(by.drop("repo"), "query_id", "left")
    pos, judged = F.coalesce("pos", F.lit(0)), F.col("route") == "verify"
    seen = routed.groupBy("repo").agg(F.count("*").alias("queries_generated"), F.count_if(F.col("route").isin("confidence", "unique-symbol")).alias("filtered_early_exit"), F.count_if(F.col("route") == "fallback").alias("filtered_fallback"), F.count_if(judged & (pos > 0)).alias("queries_with_positive"), F.count_if(judged & (pos == 0)).alias("queries_without_positive"), F.sum(pos).alias("rows_positive"), F.sum(F.coalesce("neg", F.lit(0))).alias("rows_negative"))
    for more in (bad, count(symbols, "symbols_total"), count(sampled, "symbols_sampled"), seen, template_map(queries, "repo")):
        got = got.join(more, "repo", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return got.fillna(0).withColumn("templates", F.coalesce("templates", none))


def template_map(queries: DataFrame, by: str) -> DataFrame:
    """(by, templates): the queries of each template as a map in the order of their names; templates are few."""
    n = queries.groupBy(by, "template").agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("template", "n")))).alias("templates"))


def totals_by_split(counters: DataFrame, repos: DataFrame) -> DataFrame:
    """Counters of all repositories of each split (repo, split), summed, templates by their names."""
    numbers = [c for c, t in counters.dtypes if c != "repo" and not t.startswith("map")]
    rows = counters.join(repos.select("repo", "split"), "repo")
    out = rows.groupBy("split").agg(F.count("*").alias("repos"), *(F.sum(c).alias(c) for c in numbers))
    if "templates" not in counters.columns:
        return out
    n = rows.select("split", F.explode("templates").alias("template", "n")).groupBy("split", "template").agg(F.sum("n").alias("n"))
    maps = n.groupBy("split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("template", "n")))).alias("templates"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return out.join(maps, "split", "left").withColumn("templates", F.coalesce("templates", none))


def count_maps(rows: DataFrame) -> DataFrame:
    """(split, key, value, n): rows by template, language and language of the query, counted in one pass over the three."""
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("template", "lang", "query_lang"))))
    return rows.select("split", keys.alias("k")).groupBy("split", "k.key", "k.value").agg(F.count("*").alias("n"))


def manifest(counters: DataFrame, repos: DataFrame, files: DataFrame, settings: dict) -> DataFrame:
    """One row: settings, an entry a repository, totals by split, and the corpus digest, as JSON. Entries are as many as repositories."""
    digest = F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("repo", F.lit(":"), "digest"))), "\n"), 256)
    from .incremental import fingerprint

    corpus = fingerprint(files).agg(digest.alias("corpus_sha256"))
    entries = counters.join(repos, "repo").agg(F.to_json(F.sort_array(F.collect_list(F.struct("repo", "split", *(c for c in counters.columns if c != "repo"))))).alias("repos"))
    totals = totals_by_split(counters, repos)
    summed = totals.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*totals.columns)))).alias("totals"))
    fixed = F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in sorted(settings.items())))).alias("settings")
    return corpus.crossJoin(F.broadcast(entries)).crossJoin(F.broadcast(summed)).select(fixed, "repos", "totals", "corpus_sha256")


def write_manifest(row: DataFrame, path: str) -> None:
    row.write.mode("overwrite").json(path)


def shuffled(queries: DataFrame, passes: int) -> DataFrame:
    """(pass, place, query_id): the order in which each pass takes the queries, the same in every run. No task orders a whole pass."""
    rows = queries.select(F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("pass"), "query_id")
    draw = F.md5(F.concat_ws("|", F.col("pass").cast("string"), F.col("query_id").cast("string")))
    return numbered(rows.withColumn("draw", draw), ["draw", "query_id"], "place", ["pass"]).select("pass", "place", "query_id")
