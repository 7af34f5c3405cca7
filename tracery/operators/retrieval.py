"""Search legs: every leg takes a table of queries and a table of the corpus, and gives candidates."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_match, in_scope, last_segment, scope_folder, words
from ..sources.corpus import corpus_lines
from ..sources.scratch import cut

#: Rows of a leg for each query and pattern.
LEG_LIMIT = 20
#: Patterns that travel with a scan of the lines, in one automaton, and their bytes together.
MOST_PATTERNS, MOST_BYTES = 20_000, 4 << 20
#: Hits that a task holds before it passes them on.
HELD = 20_000
#: Terms of queries that are sent to all documents, the parts that documents of a term are dealt to where there are more, and pairs of query and document that a task scores, or terms that both have where these are fewer.
MOST_TERMS, TERM_PARTS, PAIRS, SHARED = 200_000, 32, 1_000_000, 500_000
#: Lines of a block, in which symbols meet the lines that they span.
BLOCK = 32
#: Keys of rows asked for (files, parts of names) that are sent to all rows.
MOST_KEYS = 100_000


def path_order(path: str = "path"):
    """Paths sort by their components."""
    return F.split(path, "/")


def narrowed(asked: DataFrame, within: DataFrame | None) -> DataFrame:
    """What is asked with the repo and the scope, if any, of its query (within: query_id, repo, scope): the legs look no farther."""
    return asked if within is None else asked.join(within, "query_id")


def among(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are among those of asked, which should be cheap to read twice: up to MOST_KEYS of these are sent to all rows, so that rows stay where they are; more are joined by a shuffle."""
    wanted = asked.select(*keys).distinct()
    few = wanted.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    return rows.join(F.broadcast(wanted) if few else wanted, keys, "left_semi")


def _own(asked: DataFrame) -> list[str]:
    """The key that keeps a search to a repository."""
    return ["repo"] if "repo" in asked.columns else []


def _inside(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """Hits in the scope of their query, which is dropped."""
    return hits.where(in_scope(F.col("path"), F.col("scope"))).drop("scope") if "scope" in asked.columns else hits


def _nth(asked: DataFrame):
    """The place of a pattern among its query's; all are equal where none is given."""
    return F.col("nth") if "nth" in asked.columns else F.lit(0)


def _searched(lines: DataFrame, asked: DataFrame, rows, columns: list[str]) -> DataFrame:
    """All matches by one pass over the lines: automata of all patterns (rows, an Arrow table of asked), one over lines as they are and one over lower-cased ones, made once a task. What a pattern carries is put beside its hits there, and columns of the lines."""
    own = _own(asked)
    at: dict[bool, dict[str, dict]] = {True: {}, False: {}}
    for i, r in enumerate(rows.to_pylist()):
        at[r["_cased"]].setdefault(r["_key"], {}).setdefault(r["repo"] if own else None, []).append(i)
    kinds = [f for f in asked.schema if not f.name.startswith("_") and f.name not in own]
    told = rows.select([f.name for f in kinds]).combine_chunks()
    name = next(n for n in itertools.chain(["_low"], (f"_low{i}" for i in itertools.count())) if n not in lines.columns)
    types = dict(lines.dtypes)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), *(f"`{c}` {types[c]}" for c in columns)])
    sent = [*columns, *(c for c in ("line", *own) if c not in columns)]

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        trees = {}
        for cased, keys in at.items():
            if keys:
                trees[cased] = ahocorasick.Automaton()
                for key in keys:
                    trees[cased].add_word(key, key)
                trees[cased].make_automaton()
        for batch in batches:
            line = batch.column(sent.index("line")).to_pylist()
            texts = {True: line, False: [t.lower() if t and low is None else low for t, low in zip(line, batch.column(len(sent)).to_pylist())]}
            repos = batch.column(sent.index("repo")).to_pylist() if own else [None] * len(batch)

            def flush(p, row, kept=batch.select(range(len(columns)))):
                own_columns = [c.combine_chunks() for c in told.take(pa.array(p, pa.int64())).columns]
                return pa.RecordBatch.from_arrays([*own_columns, *kept.take(pa.array(row, pa.int64())).columns], [*told.column_names, *columns])

            found, row = [], []
            for cased, tree in trees.items():
                for i, text in enumerate(texts[cased]):
                    for key in {x for _, x in tree.iter(text)} if text else ():
                        hits = at[cased][key].get(repos[i], ())
                        found += hits
                        row += [i] * len(hits)
                    if len(found) >= HELD:
                        yield flush(found, row)
                        found, row = [], []
            yield flush(found, row)

    # of ASCII, lower case is the same everywhere and is found in the task
    low = F.when(F.octet_length("line") != F.char_length("line"), F.lower("line"))
    return lines.select(*sent, low.alias(name)).mapInArrow(run, schema)


def _by_trigram(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """All matches by equi-joins: each pattern is looked up by its rarest trigram, and what shares it is compared."""
    own = _own(asked)
    keys = ["_cased", "_gram", *own]
    gram = lambda c, n: F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(?=([\s\S]{{{n}}}))"), F.lit(1)))
    sized = asked.withColumn("_size", F.least(F.lit(3), F.char_length("_key")))
    kinds = [(r["_cased"], r["_size"]) for r in sized.select("_cased", "_size").distinct().collect()]
    if not kinds:
        return lines.limit(0).join(asked.drop("_cased", "_key"), own or F.lit(False))
    wanted = sized.withColumn("_gram", F.explode(F.coalesce(*(F.when(F.col("_size") == n, gram(F.col("_key"), n)) for n in (1, 2, 3)))))
    marked = lambda cased: lambda g: F.struct(F.lit(cased).alias("_cased"), g.alias("_gram"))
    posts = [F.transform(gram(F.col("line") if cased else F.lower("line"), n), marked(cased)) for cased, n in kinds]
    posts = lines.where(F.col("line").isNotNull()).select(*lines.columns, F.explode(F.concat(*posts)).alias("_g")).select(*lines.columns, "_g._cased", "_g._gram").join(wanted.select(keys).distinct(), keys, "left_semi")
    best = wanted.join(posts.groupBy(keys).count(), keys).groupBy(*(c for c in sized.columns if c != "_size")).agg(F.min_by("_gram", F.struct("count", "_gram")).alias("_gram"))
    held = F.when(F.col("_cased"), F.contains("line", F.col("_key"))).otherwise(F.contains(F.lower("line"), F.col("_key")))
    return posts.join(best, keys).where(held).drop("_cased", "_gram", "_key")


def substring_hits(lines: DataFrame, patterns: DataFrame, most_patterns: int = MOST_PATTERNS, with_line: bool = True) -> DataFrame:
    """Rows of lines joined with the distinct patterns (query_id, pattern) that they contain, by smart case: a pattern with an upper-case letter is looked for as it stands, another in lower-cased lines.

    Patterns may have a repo, outside of which they find nothing, a scope, that paths have to lie
    in, and nth, which is passed on. Up to most_patterns patterns of MOST_BYTES together travel
    with the scan, which finds all of them in one pass and shuffles nothing; more are joined by
    trigrams, with the same rows. Equal lines are hits of their own. Empty and null patterns and
    lines find nothing. Columns of lines by the name of query_id, pattern or nth are replaced.
    Without with_line the hits lack the line, which long ones are spared to carry.
    """
    lines = lines.drop("query_id", "pattern", "nth")
    more = [c for c in ("scope",) if c in patterns.columns]
    own = _own(patterns)
    cased = F.col("pattern").rlike(r"\p{Lu}")
    asked = patterns.where("pattern <> ''").groupBy("query_id", "pattern", *own, *more).agg(F.min(_nth(patterns)).alias("nth"))
    asked = asked.where("repo is not null") if own else asked
    asked = asked.withColumns({"_cased": cased, "_key": F.when(cased, F.col("pattern")).otherwise(F.lower("pattern"))})
    rows = asked.limit(most_patterns + 1).toArrow()
    few = rows.num_rows <= most_patterns and rows.column("_key").nbytes <= MOST_BYTES
    columns = [c for c in lines.columns if with_line or c != "line"]
    found = _inside(_searched(lines, asked, rows, columns) if few else _by_trigram(lines, asked), patterns)
    return found.select("query_id", "pattern", *(["nth"] if "nth" in patterns.columns else []), *columns)


def limited(hits: DataFrame, order: list | None = None, by: str = "pattern", most: int = LEG_LIMIT) -> DataFrame:
    """The first rows of each query and pattern by path and line, numbered (raw_seq) over the query: pattern after pattern where these have a place (nth)."""
    order = order or [path_order(), F.col("line_no")]
    each = Window.partitionBy("query_id", by).orderBy(*order)
    first = hits.withColumn("_n", F.row_number().over(each)).where(F.col("_n") <= most).drop("_n")
    w = Window.partitionBy("query_id").orderBy(*([F.col("nth")] if "nth" in hits.columns else []), *order, by)
    return first.withColumn("raw_seq", F.row_number().over(w).cast("long"))


def grep_leg(lines: DataFrame, patterns: DataFrame, context: int = 0, within: DataFrame | None = None) -> DataFrame:
    """Candidates (query_id, raw_seq, path, line_start, line_end, symbol, kind, snippet) of the literal search."""
    return grep_candidates(substring_hits(lines, narrowed(patterns, within)), context)


def grep_candidates(hits: DataFrame, context: int = 0) -> DataFrame:
    """The same from hits that were found before."""
    return limited(hits).select("query_id", "raw_seq", "path", F.greatest(F.lit(1), F.col("line_no") - context).alias("line_start"), (F.col("line_no") + context).alias("line_end"), F.lit(None).cast("string").alias("symbol"), F.lit("ContentHit").alias("kind"), F.col("line").alias("snippet"))


def symbol_leg(symbols: DataFrame, names: DataFrame, fuzzy: bool = False, within: DataFrame | None = None) -> DataFrame:
    """Candidates of symbols by name (query_id, name), the first LEG_LIMIT of a query and name by path and line, numbered over the query.

    A symbol whose last segment is the name is an exact hit; with fuzzy, one whose qualified name
    holds the name, whatever the case, is a fuzzy one.
    """
    last = last_segment(F.col("qualified_name"))
    asked = narrowed(names, within)
    own, more = _own(asked), [c for c in ("scope", "nth") if c in asked.columns]
    if fuzzy:
        low = asked.withColumn("pattern", F.lower("name"))
        found = substring_hits(symbols.withColumn("line", F.lower("qualified_name")), low.drop("name", "nth"), with_line=False)
        hits = found.join(low.select("query_id", "name", "pattern", *(["nth"] if "nth" in more else [])).distinct(), ["query_id", "pattern"]).drop("pattern")
    else:
        hits = _inside(symbols.withColumn("name", last).join(asked.select("query_id", "name", *own, *more).distinct(), ["name", *own]), asked)
    kind = F.when(last == F.col("name"), "SymbolExact").otherwise("SymbolFuzzy")
    hits = limited(hits, [path_order(), F.col("line_start"), F.col("qualified_name")], "name")
    if not fuzzy:
        hits = hits.where(F.col("raw_seq") <= LEG_LIMIT)
    return hits.select("query_id", "raw_seq", "path", "line_start", "line_end", F.col("qualified_name").alias("symbol"), kind.alias("kind"), F.lit(None).cast("string").alias("snippet"))


def body_leg(symbols: DataFrame, files: DataFrame, patterns: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Candidates of symbols whose body, the lines from its start to its end, holds a pattern (query_id, pattern): the first LEG_LIMIT of each by path and line.

    Lines are searched where they lie, and their hits meet the symbols that span them, so that no
    text is shuffled. Only patterns with a line end are looked for in bodies.
    """
    asked = narrowed(patterns, within)
    ends = F.col("pattern").rlike(r"[\r\n]")
    hits = _spanned(symbols, files, asked.where(~ends))
    if not (across := asked.where(ends)).isEmpty():
        hits = hits.unionByName(_in_bodies(symbols, files, across))
    hits = limited(hits, [path_order(), F.col("line_start"), F.col("qualified_name")])
    return hits.select("query_id", "raw_seq", "path", "line_start", "line_end", F.col("qualified_name").alias("symbol"), F.lit("SemanticHit").alias("kind"), F.lit(None).cast("string").alias("snippet"))


def _spanned(symbols: DataFrame, files: DataFrame, asked: DataFrame) -> DataFrame:
    """Symbols (with query_id, pattern and nth) that span a line which holds a pattern, once each; equal symbols and files of one path count as they come."""
    key = ["path", *_own(asked)]
    block = lambda c: F.floor(c / BLOCK)
    files = files if "repo" in files.columns else files.withColumn("repo", F.lit(None).cast("string"))
    lines = corpus_lines(files.withColumn("_file", F.monotonically_increasing_id()), "_file")
    found = substring_hits(lines.select(*key, "line_no", "line", "_file"), asked, with_line=False).withColumn("_block", block(F.col("line_no")))
    last = F.greatest("line_start", "line_end")
    spans = symbols.select(*key, "line_start", "line_end", "qualified_name", F.monotonically_increasing_id().alias("_symbol"))
    spans = spans.withColumn("_block", F.explode(F.sequence(block(F.col("line_start")), block(last))))
    hits = found.join(spans, [*key, "_block"]).where(F.col("line_no").between(F.col("line_start"), last))
    return hits.drop("line_no", "_block").distinct().drop("_file", "_symbol")


def _in_bodies(symbols: DataFrame, files: DataFrame, asked: DataFrame) -> DataFrame:
    """The same from the text of each body."""
    key = ["path", *_own(asked)]
    split = files.select(*key, F.split("content", "\n").alias("rows"))
    bodies = symbols.join(split, key).withColumn("line", F.array_join(F.slice("rows", F.col("line_start"), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(1))), "\n")).drop("rows")
    return substring_hits(bodies.select(*key, "line_start", "line_end", "qualified_name", "line"), asked, with_line=False)


def bm25_leg(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates of the symbols whose names suit a query's words best, in its repository and scope where it has these. Names fall into words at _, -, other marks and changes of case; ties go by path, line and name."""
    parts = lambda c: F.array_join(words(F.col(c)), " ")
    place = F.struct(path_order().alias("parts"), "line_start", "qualified_name", "line_end")
    path = F.array_join("doc_id.parts", "/")
    key = [c for c in ("repo",) if c in queries.columns]
    each = symbols.select("path", "line_start", "qualified_name", "line_end", *key).distinct()
    docs = cut(each.select(place.alias("doc_id"), *key, parts("qualified_name").alias("text")))
    best = bm25(docs, queries.withColumn("text", parts("text")), path=path, single=True)
    return best.select("query_id", F.col("rank").cast("long").alias("raw_seq"), path.alias("path"), "doc_id.line_start", "doc_id.line_end", F.col("doc_id.qualified_name").alias("symbol"), F.lit("SemanticHit").alias("kind"), F.lit(None).cast("string").alias("snippet"))


def union_of_legs(*legs: DataFrame) -> DataFrame:
    """The candidates of all legs, numbered by leg and then by their place in it: the order in which equals are merged."""
    out = None
    for i, leg in enumerate(legs):
        rows = leg.withColumn("raw_seq", F.col("raw_seq") + i * 1_000_000)
        out = rows if out is None else out.unionByName(rows)
    return out


def file_leg(files: DataFrame, tokens: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Candidates of files whose names match a token (query_id, token), the first LEG_LIMIT of each by path: an equi-join for names with an extension or equal; parts are looked up by their rarest trigram, or by themselves if shorter, and compared. An empty token is part of every name."""
    asked = narrowed(tokens, within)
    own, more = _own(asked), [c for c in ("scope", "nth") if c in asked.columns]
    asked = asked.select("query_id", "token", *own, *more).distinct()
    paths = files.select("path", *own).distinct().withColumn("base", F.element_at(F.split("path", "/"), -1))
    names = ["query_id", "token", "path", *more]
    exact = paths.join(asked.withColumn("base", F.col("token")), ["base", *own]).select(names)
    parts = asked.where(~F.contains("token", F.lit(".")))
    gram = lambda c, n: F.regexp_extract_all(F.col(c), F.lit(rf"(?=([\s\S]{{{n}}}))"), F.lit(1))
    wanted = parts.where("token <> ''").withColumn("gram", F.explode(F.when(F.char_length("token") < 3, F.array("token")).otherwise(F.array_distinct(gram("token", 3)))))
    keys = ["gram", *own]
    posts = among(paths.select("path", *own, F.explode(F.array_distinct(F.concat(*(gram("base", n) for n in (1, 2, 3))))).alias("gram")), wanted, keys)
    best = wanted.join(posts.groupBy(keys).count(), keys).groupBy("query_id", "token", *own, *more).agg(F.min_by("gram", F.struct("count", "gram")).alias("gram"))
    part = posts.join(best, keys).where(glob_match(F.col("token"), F.col("path"))).select(names)
    hits = _inside(exact.union(part).union(_all_names(paths, parts.where("token = ''"), names)).distinct(), asked)
    hits = limited(hits, [path_order()], "token")
    one, none = F.lit(1), F.lit(None).cast("string")
    return hits.select("query_id", "raw_seq", "path", one.alias("line_start"), one.alias("line_end"), none.alias("symbol"), F.lit("FileNameHit").alias("kind"), none.alias("snippet"))


def _all_names(paths: DataFrame, asked: DataFrame, names: list[str]) -> DataFrame:
    """The first LEG_LIMIT paths for each empty token: of each repository and folder that is asked for, found once and then joined to the queries."""
    own = _own(asked)
    if "scope" in asked.columns:
        asked = asked.withColumn("folder", scope_folder(F.col("scope")))
        own = ["folder", *own]
        steps = F.split("path", "/")
        folders = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
        paths = paths.withColumn("folder", F.explode(folders))
    inside = paths.join(asked.select(*own).distinct(), own, "left_semi") if own else paths.orderBy(path_order()).limit(LEG_LIMIT)
    first = F.row_number().over(Window.partitionBy(*own).orderBy(path_order()))
    few = asked.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(LEG_LIMIT))))
    return inside.withColumn("_n", first).where(F.col("_n") <= LEG_LIMIT).join(few, ["_n", *own]).select(names)


def _terms(c: str):
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def _of_terms(rows: DataFrame, terms: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """Rows of documents joined with terms: a few terms are sent to all rows, more are joined by shuffles that part the documents of a term, since a frequent one has nearly all."""
    if few:
        return rows.join(F.broadcast(terms), keys, how)
    parts = F.explode(F.sequence(F.lit(0), F.lit(TERM_PARTS - 1)))
    return rows.withColumn("_part", F.pmod(F.hash("doc_id"), F.lit(TERM_PARTS))).join(terms.withColumn("_part", parts).hint("merge"), [*keys, "_part"], how).drop("_part")


def _parts(pairs: int, known: DataFrame) -> int:
    """Tasks for the pairs of query and document: no more of these meet than the terms that both have (known: a row for each term of a query, with the documents that have it, df), which are far fewer than all where queries have a repository or rare terms."""
    met = known.agg(F.sum("df")).head()[0] or 0
    return max(known.sparkSession.sparkContext.defaultParallelism, min(pairs // PAIRS, met // SHARED))


def bm25(docs: DataFrame, queries: DataFrame, k: int = LEG_LIMIT, k1: float = 1.2, b: float = 0.75, path=None, single: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents (doc_id, text) for each query (query_id, text).

    Where queries have a repo, documents of it alone are ranked, by its own counts of documents,
    lengths and terms; where they have a scope, documents whose path (a column) lies in it. Ids
    may be of any type; rows of one doc_id are one document, rows without one are left out. Only
    terms that are asked for leave the scan; what a document has of them is counted once, for the
    frequencies and for the scores. Up to MOST_TERMS terms of queries are sent to all documents,
    and only a task's best leave it. With single, docs is a table with one row a document (of a
    repository), so that each row tells its own length.
    """
    own = _own(queries)
    docs = docs.where("doc_id is not null")
    asked = cut(queries.select("query_id", *own, F.explode(F.array_distinct(_terms("text"))).alias("term")).distinct())
    few = asked.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    split = docs.select("doc_id", *own, _terms("text").alias("terms"))
    size = F.greatest(F.lit(0), F.size("terms")).cast("long")
    lens = split.select("doc_id", *own, size.alias("len")) if single else cut(split.groupBy("doc_id", *own).agg(F.sum(size).alias("len")))
    told = [size.alias("len")] if single else []
    each = _of_terms(split.select("doc_id", *own, *told, F.explode("terms").alias("term")), asked.select(*own, "term").distinct(), [*own, "term"], few, "left_semi")
    tf = each.groupBy("doc_id", *own, *(["len"] if single else []), "term").agg(F.count("*").alias("tf"))
    tf = cut(tf if single else tf.join(lens.hint("merge"), ["doc_id", *own]))
    measures = F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")
    df = tf.groupBy(*own, "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if own:
        known = df.join(lens.groupBy(*own).agg(*measures), own)
    else:
        one = lens.agg(*measures).head()
        known = df.withColumns({c: F.lit(one[c]).cast(t) for c, t in (("n_docs", "long"), ("avg_len", "double"))})
    known = cut(known.withColumn("idf", idf).join(asked, [*own, "term"]))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    # documents are dealt once: what they have of all queries is summed and cut to the best in the task that holds them
    total = _of_terms(tf.repartition(_parts(lens.count() * asked.select("query_id").distinct().count(), known), "doc_id"), known, [*own, "term"], few).groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    if "scope" in queries.columns and path is not None:
        scopes = queries.select("query_id", "scope").distinct()
        total = total.join(F.broadcast(scopes) if few else scopes, "query_id").where(in_scope(path, F.col("scope"))).drop("scope")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def verified_locations(candidates: DataFrame, stats: DataFrame) -> DataFrame:
    """Candidates whose files exist and whose start lies in them, cut at the last line."""
    return candidates.join(stats.select("path", "line_count"), "path").where("line_start <= line_count").withColumn("line_end", F.least("line_end", F.greatest("line_count", "line_start"))).drop("line_count")


def body_window(candidates: DataFrame, files: DataFrame, before: int = 3, after: int = 5) -> DataFrame:
    """With body: the lines around each candidate, from one array of lines a file, cut at the file's ends; unknown places and files give null."""
    split = files.select("path", F.split("content", "\n").alias("rows"))
    first = F.greatest(F.col("line_start") - before, F.lit(1))
    last = F.least(F.greatest("line_end", "line_start") + after, F.size("rows"))
    body = F.when((F.col("line_start") > 0) & (first <= last), F.array_join(F.slice("rows", first, last - first + 1), "\n"))
    return candidates.join(split, "path", "left").withColumn("body", body).drop("rows")


def context_lines(hits: DataFrame, files: DataFrame, width: int = 2) -> DataFrame:
    """With before and after: up to ``width`` lines on each side of every hit (path, line_no, ..).

    A line between two hits goes to the earlier hit's tail if it is within width of it, else to
    the next hit's head; hits' own lines belong to neither.
    """
    places = hits.select("path", "line_no").distinct()
    w = Window.partitionBy("path").orderBy("line_no")
    near = places.withColumns({"prev": F.lag("line_no").over(w), "next": F.lead("line_no").over(w)})
    split = files.select("path", F.split("content", "\n").alias("rows"))
    # the last empty piece of a text that ends with a line end is no line
    rows = split.withColumn("rows", F.when(F.element_at("rows", -1) == "", F.slice("rows", 1, F.size("rows") - 1)).otherwise(F.col("rows")))
    head = F.greatest(F.col("line_no") - width, F.coalesce(F.col("prev") + width, F.lit(0)) + 1, F.lit(1))
    tail = F.least(F.col("line_no") + width, F.coalesce(F.col("next") - 1, F.size("rows")), F.size("rows"))
    lines = lambda a, n: F.slice("rows", a, F.greatest(n, F.lit(0)))
    cut = near.join(rows, "path").select("path", "line_no", lines(head, F.col("line_no") - head).alias("before"), lines(F.col("line_no") + 1, tail - F.col("line_no")).alias("after"))
    return hits.join(cut, ["path", "line_no"], "left")


def snippets(wanted: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path, line_start, line_end, body) of symbols by qualified name (name)."""
    found = wanted.join(symbols.withColumnRenamed("qualified_name", "name"), "name")
    return body_window(found.select("name", "path", "line_start", "line_end"), files, 0, 0)


def graph_edges(nodes: DataFrame, edges: DataFrame, label: str | None = None, name: str | None = None, path: str | None = None) -> DataFrame:
    """(src, dst, type) of edges whose source has a label, a name that matches and a path that holds a part; each is optional."""
    rows = nodes
    for column, test in (("label", label and F.col("label") == label), ("name", name and F.col("name").rlike(name)), ("path", path and F.contains("path", F.lit(path)))):
        rows = rows.where(test) if test is not None else rows
    return edges.join(rows.select(F.col("node").alias("src")).distinct(), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", "type")


def legs_overlap(findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Findings (query_id, path, line_start, line_end) that overlap a candidate of the query."""
    c = candidates.select("query_id", "path", F.col("line_start").alias("c_start"), F.col("line_end").alias("c_end"))
    return findings.join(c, (findings.query_id == c.query_id) & (findings.path == c.path) & (findings.line_start <= c.c_end) & (c.c_start <= findings.line_end), "left_semi")


def attributed(findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """With symbol: that of the one candidate which a finding (finding_id, query_id, path, line_start, line_end) overlaps; null for none or several."""
    c = candidates.select("query_id", "path", F.col("line_start").alias("c_start"), F.col("line_end").alias("c_end"), "symbol")
    hit = findings.join(c, ["query_id", "path"]).where("line_start <= c_end and c_start <= line_end")
    one = hit.groupBy("finding_id").agg(F.count("*").alias("n"), F.first("symbol").alias("symbol")).where("n = 1").select("finding_id", "symbol")
    return findings.join(one, "finding_id", "left")


def resolved_citations(findings: DataFrame, registry: DataFrame, strict: bool = False) -> DataFrame:
    """Findings (query_id, finding_id, candidate_id, line_start, line_end) with the place of the candidate that they cite, from registry (query_id, candidate_id, path, c_start, c_end), and valid.

    A range that is unknown (0), or overlaps the candidate's without lying strictly inside, becomes
    the candidate's; one that lies apart is kept. Findings that cite nothing known are invalid:
    they go, or with strict all findings of their query go.
    """
    rows = findings.join(registry, ["query_id", "candidate_id"], "left").withColumn("valid", F.col("path").isNotNull())
    overlaps = (F.col("line_start") <= F.col("c_end")) & (F.col("c_start") <= F.col("line_end"))
    inside = (F.col("line_start") > F.col("c_start")) & (F.col("line_end") < F.col("c_end"))
    snap = (F.col("line_start") == 0) | (overlaps & ~inside)
    rows = rows.withColumns({"line_start": F.when(snap, F.col("c_start")).otherwise(F.col("line_start")), "line_end": F.when(snap, F.col("c_end")).otherwise(F.col("line_end"))})
    if strict:
        rows = rows.withColumn("valid", F.bool_and("valid").over(Window.partitionBy("query_id")))
    return rows.where("valid").select("query_id", "finding_id", "candidate_id", "path", "line_start", "line_end")
