"""Column functions on query text, identifiers and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no identifiers.
STOPWORDS = """the and for that this with where what when which does how are was were will would should could into from
used uses using have has been there find show code file files function method class der die das und wird wie welche wo""".split()
# Possessive, so that the pattern library doesn't recurse by character on long texts.
# Fixed value: quoted literals (double quotes, backticks, and single quotes not inside a word).
LITERAL = r"""\"([^\"]*)\"|`([^`]*)`|(?<![\p{L}\p{N}_])'([^']*+(?:(?<=[\p{L}\p{N}_])'(?=[\p{L}\p{N}_])[^']*+)*+)(?:(?<![\p{L}\p{N}_])'|'(?![\p{L}\p{N}_]))"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def once(x: Column, f) -> Column:
    """f of a value that is found once a row, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def coverage_key(x: Column) -> Column:
    """Lower case without underscores."""
    return F.translate(x, UPPER + "_", LOWER)


def literals(text: Column) -> Column:
    """Distinct quoted literals in the order of their first appearance, without their quotes."""
    found = F.regexp_extract_all(text, F.lit(LITERAL), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(F.substring(x, F.lit(2), F.char_length(x) - 2))), lambda x: x != ""))


def _trimmed(text: Column) -> Column:
    """Tokens outside of literals without what is neither word, / nor a leading dot around them."""
    plain = F.regexp_replace(F.regexp_replace(text, LITERAL, " "), "[\"`]", " ")
    return F.filter(F.transform(F.split(plain, r"\s+"), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}_/.]+|[^\p{L}\p{N}_/]+$", "")), lambda t: t != "")


def tokens(text: Column) -> Column:
    """Tokens outside of literals; a leading / or . stays, a trailing . doesn't, nor does :line[:col]."""
    return F.filter(F.transform(_trimmed(text), lambda t: F.regexp_replace(t, r"(:\d+){1,2}$", "")), lambda t: t != "")


def segments(text: Column) -> Column:
    """What the tokens fall into at characters that belong to no word: parts of paths and of qualified names."""
    return F.filter(F.flatten(F.transform(_trimmed(text), lambda t: F.split(t, r"[^\p{L}\p{N}_]+"))), lambda t: t != "")


def is_path(t: Column) -> Column:
    return F.contains(t, F.lit("/")) | F.element_at(F.split(t, "/"), -1).rlike(r"^.+\.[^.]+$")


def is_plain(t: Column) -> Column:
    """Neither a stopword nor digits alone."""
    return ~ascii_lower(t).isin(STOPWORDS) & ~t.rlike(r"^[0-9]*$")


def is_symbol(t: Column) -> Column:
    """Three bytes or more, with an underscore, a digit, or both cases."""
    return (F.octet_length(t) >= 3) & is_plain(t) & (t.rlike("[_0-9]") | (t.rlike("[a-z]") & t.rlike("[A-Z]")))


def is_identifier(t: Column) -> Column:
    return is_symbol(t) | ((F.octet_length(t) >= 4) & is_plain(t))


def is_strong_identifier(t: Column) -> Column:
    """A symbol whose shape is more than a capital letter at the front."""
    return is_symbol(t) & ~t.rlike(r"^[\s\S][a-z]*$")


def case_variant(t: Column) -> Column:
    """snake_case to camelCase and back; null where nothing changes."""
    camel = F.aggregate(F.filter(F.split(t, "_+"), lambda p: p != ""), F.lit(""), lambda a, p: F.concat(a, F.when(a == "", ascii_lower(p)).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), ascii_lower(F.substring(p, F.lit(2), F.char_length(p)))))))
    snake = ascii_lower(F.regexp_replace(t, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_"))
    other = F.when(F.contains(t, F.lit("_")), camel).when(t.rlike("[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"), snake)
    return F.when(other != t, other)


def words(name: Column) -> Column:
    """Words of an identifier: parted by _ and -, from lower to upper case, and at the end of acronyms."""
    cut = F.regexp_replace(F.regexp_replace(name, r"(?<=[a-z])(?=[A-Z])", "_"), r"(?<=[A-Z])(?=[A-Z][a-z])", "_")
    return F.filter(F.transform(F.split(cut, "[_-]"), ascii_lower), lambda w: w != "")


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, "[:.]"), -1)


def short_name(name: Column) -> Column:
    """The last part that isn't empty, by . : / # $; the name itself if there is none."""
    parts = F.filter(F.split(name, r"[.:/#$]"), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), name)


def escape_regex(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\.+*?()\[\]{}|^$])", r"\\$1")


def derive_patterns(text: Column) -> Column:
    """struct(identifiers, literals, path_tokens, grep_patterns, n_original): what a query is searched by.

    Identifiers are the parts of tokens, paths included, that look like one, then their spellings
    in the other case; the first n_original are as typed.
    """
    lits, toks = literals(text), tokens(text)
    originals = F.array_distinct(F.filter(segments(text), is_identifier))
    variants = F.filter(F.transform(originals, case_variant), lambda v: v.isNotNull())
    paths = F.array_distinct(F.filter(toks, is_path))
    ids = F.array_distinct(F.concat(originals, variants))
    return F.struct(ids.alias("identifiers"), lits.alias("literals"), paths.alias("path_tokens"), F.slice(F.array_distinct(F.concat(lits, ids)), 1, 6).alias("grep_patterns"), F.size(originals).alias("n_original"))


def leg_identifiers(p: Column, most: Column) -> Column:
    """The first ``most`` identifiers as typed, and the other spelling of each if it was found."""
    typed = F.slice(p.identifiers, F.lit(1), F.least(most, p.n_original))
    rest = F.slice(p.identifiers, p.n_original + 1, F.size(p.identifiers))
    other = F.filter(F.transform(typed, case_variant), lambda v: v.isNotNull() & F.array_contains(rest, v))
    return F.array_distinct(F.concat(typed, other))


def smart_contains(line: Column, pattern: Column) -> Column:
    """Case matters only where the pattern has an upper-case letter."""
    return F.when(pattern.rlike(r"\p{Lu}"), F.contains(line, pattern)).otherwise(F.contains(F.lower(line), F.lower(pattern)))


def normalize_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(ascii_lower(url), "/$", ""), r"\.git$", "")


def cap_snippet(x: Column, most: int) -> Column:
    return F.when(F.char_length(x) > most, F.concat(F.substring(x, 1, most), F.lit("…"))).otherwise(x)


def estimate_tokens(x: Column) -> Column:
    return F.ceil(F.octet_length(x) / 4)


def cap_lines(x: Column, most_lines: int, most_chars: int) -> Column:
    """The first lines, each cut at a number of characters."""
    return F.array_join(F.transform(F.slice(F.split(x, "\n"), 1, most_lines), lambda t: F.substring(t, 1, most_chars)), "\n")


def scope_escapes(scope: Column) -> Column:
    """Whether a scope leaves the root: absolute, or above it at some point."""
    depth = F.aggregate(F.split(scope, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, p: F.struct((at := a.at + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("at"), F.least(a.low, at).alias("low")), lambda a: a.low)
    return F.coalesce(F.startswith(scope, F.lit("/")) | (depth < 0), F.lit(False))


def scope_folder(scope: Column) -> Column:
    """The folder that a scope names, without leading ./ and trailing /; empty where it is null, empty or escapes and so holds everything."""
    clean = F.regexp_replace(F.regexp_replace(scope, r"^(\./)+", ""), "/+$", "")
    return F.coalesce(F.when((clean == ".") | scope_escapes(scope), F.lit("")).otherwise(clean), F.lit(""))


def in_scope(path: Column, scope: Column) -> Column:
    """Whether a path lies in a scope, by whole components; a null, empty or escaping scope holds everything."""
    folder = scope_folder(scope)
    return F.coalesce((folder == "") | (path == folder) | F.startswith(path, F.concat(folder, F.lit("/"))), F.lit(True))


def length_prefixed(*parts: Column) -> Column:
    """A key that no two different lists of parts share."""
    return F.concat(*(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts))


def cache_key(text: Column, scope: Column) -> Column:
    """Key of a query: text trimmed and in lower case, and its scope, empty where it escapes."""
    return length_prefixed(F.lower(F.trim(text)), F.when(scope.isNull() | scope_escapes(scope), F.lit("")).otherwise(scope))


def glob_match(token: Column, path: Column) -> Column:
    """A token with a dot is the file's name; another is part of it."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.when(F.contains(token, F.lit(".")), base == token).otherwise(F.contains(base, token))
