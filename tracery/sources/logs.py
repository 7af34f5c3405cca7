"""Server log lines as typed events, and events as one row a request."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The escape sequences of terminals, the request in a line, and the messages by which a line is known, each with its kind; where a word goes on, those in WHOLE aren't met.
ANSI = r"\x1b\[[0-9;]*[A-Za-z]"
REQUEST = r"explore\{req_id=[0-9a-f]+-\d+\}:"
MESSAGES = {
    "exploration served from query cache": "cache",
    "exploration complete": "complete",
    "retrieval pre-stage complete": "retrieval_complete",
    "retrieval patterns": "retrieval_patterns",
    "retrieval leg done": "leg_done",
    "retrieval leg failed": "leg_failed",
    "retrieval candidates": "candidates",
    "index status": "index_status",
    "provider call": "provider_call",
    "verify action": "verify_action",
    "fallback turn": "fallback_turn",
    "verification escalated to the fallback loop": "escalated",
    "exploration failed": "exploration_failed",
    "early-exit produced no filesystem-verified candidate; falling through to verification": "early_exit_fallthrough",
    "early-exit dropped an unverifiable candidate": "early_exit_dropped",
}
WHOLE = ("complete", "retrieval_complete", "retrieval_patterns", "leg_done", "leg_failed", "candidates", "index_status", "verify_action", "fallback_turn", "exploration_failed")
#: How a provider's call ended is told in lines of their own, which are of no kind.
OUTCOMES = r"provider call\s+(?:succeeded|failed)"
#: A name and its value: text in quotes with escapes, a list, an object, or what comes before the next blank.
QUOTED, LISTED, OBJECT, BARE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', r"\[[^\]]*\]", r"\{[^}]*\}", r"\S+"
PAIR = rf"\w+=(?:{QUOTED}|{LISTED}|{OBJECT}|{BARE})"


def line_kind(line: Column) -> Column:
    """The first kind, in the order of MESSAGES, whose message the line has; null for other lines. One pass finds all messages of a line."""
    any_ = "|".join([OUTCOMES, *(re.escape(m).replace(r"\ ", " ") + (r"\b" if k in WHOLE else "") for m, k in MESSAGES.items())])
    found = F.regexp_extract_all(line, F.lit(f"({any_})"), F.lit(1))
    place = F.array_min(F.transform(found, lambda m: F.nullif(F.array_position(F.array(*map(F.lit, MESSAGES)), m), F.lit(0))))
    return F.get(F.array(*map(F.lit, MESSAGES.values())), (place - 1).cast("int"))


def fields(line: Column) -> Column:
    """map of the name=value pairs, of a repeated name the last; quotes around values are off."""
    pairs = F.reverse(F.regexp_extract_all(line, F.lit(f"({PAIR})"), F.lit(1)))
    names = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    raw = F.transform(pairs, lambda p: F.substring(p, F.char_length(F.substring_index(p, "=", 1)) + 2, F.char_length(p)))
    values = F.transform(raw, lambda v: F.when(v.rlike(r'^".*"$') & (F.char_length(v) >= 2), F.substring(v, F.lit(2), F.char_length(v) - 2)).otherwise(v))
    known = F.array_distinct(names)
    return F.map_from_arrays(known, F.transform(known, lambda k: F.element_at(values, F.array_position(names, k).cast("int"))))


def value_kind(raw: Column) -> Column:
    """What a raw value is: str (quoted), json (bracketed), bool, int, float, or str."""
    return F.when(raw.rlike(r'^".*"$'), "str").when(raw.rlike(r"^[\[{]"), F.when(F.try_parse_json(raw).isNotNull(), "json").otherwise("str")).when(raw.isin("true", "false"), "bool").when(raw.try_cast("long").isNotNull() & raw.rlike(r"^[+-]?\d+$"), "int").when(raw.try_cast("double").isNotNull(), "float").otherwise("str")


def log_events(lines: DataFrame) -> DataFrame:
    """(process, request, kind, f, line, ..): lines (line, and any others) that belong to a request and have a known message, with their fields."""
    # a row of one element is a border that filters don't cross: what is found in a line is found once
    once = lambda df, x, name: df.withColumn(name, F.explode(F.array(x)))
    rows = once(lines, F.regexp_replace("line", ANSI, ""), "line")
    marked = once(rows, F.struct(line_kind(F.col("line")).alias("kind"), F.regexp_extract("line", REQUEST, 0).alias("request")), "_m").where("_m.kind is not null and _m.request <> ''")
    key = F.substring_index(F.substring_index(F.col("_m.request"), "}", 1), "=", -1)
    named = marked.withColumns({"kind": F.col("_m.kind"), "process": F.substring_index(key, "-", 1), "request": F.substring_index(key, "-", -1).try_cast("long")})
    return named.where("request is not null").withColumn("f", fields(F.replace(F.col("line"), F.col("_m.request"), F.lit("")))).drop("_m")


def request_fields() -> list[Column]:
    """Aggregates of a request's events: of a field its last value, lists in the order of the lines (column seq)."""
    f = lambda k: F.col("f").getItem(k)
    ends = F.col("kind").isin("cache", "complete")
    last = lambda value, where, name: F.max_by(F.when(where, value), F.when(where & value.isNotNull(), F.col("seq"))).alias(name)
    number = lambda k: f(k).try_cast("long")
    listed = lambda value, where, name: F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("seq", value.alias("v"))))), lambda x: x.v).alias(name)
    return [
        last(F.when(F.col("kind") == "cache", F.lit("cache")).otherwise(f("path")), ends, "stage"),
        last(F.when(F.col("kind") == "cache", F.coalesce(number("tokens"), F.lit(0))).otherwise(number("tokens")), ends, "tokens"),
        last(number("llm_calls"), ends, "llm_calls"),
        last(number("total_ms"), ends, "total_ms"),
        last(f("cache_layer"), ends, "cache_layer"),
        last(number("candidates"), F.col("kind") == "retrieval_complete", "candidates"),
        last(number("confidence"), F.col("kind") == "retrieval_complete", "confidence"),
        last(f("outcome"), F.col("kind") == "index_status", "index_status"),
        F.bool_or(F.col("kind") == "escalated").alias("escalated"),
        listed(F.concat(f("leg"), F.lit(":"), F.coalesce(f("hits"), F.lit("?"))), F.col("kind") == "leg_done", "legs"),
        listed(F.regexp_extract("line", r"\berror=(.*)$", 1), F.col("kind") == "leg_failed", "leg_errors"),
        listed(F.coalesce(f("model_served"), F.lit("?")), F.col("kind") == "provider_call", "models"),
        F.count("*").alias("n_lines"),
    ]


def requests(events: DataFrame) -> DataFrame:
    """One row a request (process, request) from its events, which are bounded by what one request logs. Needs seq, the order of the lines."""
    return events.groupBy("process", "request").agg(*request_fields())


def request_stream(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """The same of a stream with an event time ts: a request's row comes when nothing of it was met for ``gap`` and the watermark has passed."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    by = rows.groupBy("process", "request", F.session_window("ts", gap).alias("w")).agg(*request_fields())
    return by.drop("w")
