"""Corpus snapshots, refreshes, result reuse and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of two tables (path, digest): added, deleted or modified."""
    both = old.select("path", F.col("digest").alias("before")).join(new.select("path", F.col("digest").alias("after")), "path", "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").otherwise("modified")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select("path", change.alias("change"))


def fingerprint(stats: DataFrame) -> DataFrame:
    """(repo, digest) over (repo, path, digest): digests of 256 buckets of paths first, then of these, so that no task holds a whole large repository."""
    line = F.concat("path", F.lit(":"), "digest")
    buckets = stats.groupBy("repo", F.substring(F.md5("path"), 1, 2).alias("bucket")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("part"))
    whole = F.concat("bucket", F.lit(":"), "part")
    return buckets.groupBy("repo").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(whole)), "\n"), 256).alias("digest"))


def refreshed(index: DataFrame, changes: DataFrame, rebuild, files: DataFrame) -> DataFrame:
    """The index without rows of changed paths, and what rebuild makes of the changed files that still exist."""
    kept = index.join(changes.select("path"), "path", "left_anti")
    return kept.unionByName(rebuild(files.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi")))


def compute_once(queries: DataFrame, key: list[str], compute) -> DataFrame:
    """Runs compute on the distinct keys and joins its rows back to every query."""
    return queries.join(compute(queries.select(*key).distinct()), key)


def cache_hits(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """Requests (key, at, snapshot) with layer: l1 if the previous one of the key within the time had the same snapshot, l2 if another, else miss."""
    w = Window.partitionBy("key").orderBy("at", "request_id")
    rows = requests.withColumn("last_at", F.lag("at").over(w)).withColumn("last_snapshot", F.lag("snapshot").over(w))
    fresh = F.col("last_at").isNotNull() & (F.unix_timestamp("at") - F.unix_timestamp("last_at") <= ttl_seconds)
    return rows.withColumn("layer", F.when(fresh & (F.col("snapshot") == F.col("last_snapshot")), "l1").when(fresh, "l2").otherwise("miss")).drop("last_at", "last_snapshot")


def within_budget(entries: DataFrame, group: str, budget: int) -> DataFrame:
    """Entries (group, key, bytes, last_hit) that stay when the latest used are kept up to a number of bytes."""
    w = Window.partitionBy(group).orderBy(F.desc("last_hit"), "key").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("total", F.sum("bytes").over(w)).where(F.col("total") <= budget)


def prefix_within(lines: DataFrame, budget: int) -> DataFrame:
    """(path, kept_lines, kept_bytes): lines of each file, a byte for each end, up to the first that exceeds the budget of tokens (4 bytes each)."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    run = lines.withColumn("total", F.sum(F.octet_length("line") + 1).over(w)).where(F.ceil(F.col("total") / 4) <= budget)
    return run.groupBy("path").agg(F.count("*").alias("kept_lines"), F.max("total").alias("kept_bytes"))


def conversation_budget(turns: DataFrame, budget: int) -> DataFrame:
    """(conv_id, turns, spent, crossed_at, after) of turns (conv_id, turn, tokens): the turn that exhausts the budget, and those after it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    run = turns.withColumn("total", F.sum("tokens").over(w))
    over = F.when(F.col("total") >= budget, F.col("turn"))
    by = run.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("tokens").alias("spent"), F.min(over).alias("crossed_at"), F.count(over).alias("n_over"))
    return by.select("conv_id", "turns", "spent", "crossed_at", F.greatest(F.col("n_over") - 1, F.lit(0)).alias("after"))


def path_trace(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, hops) reachable from start (node) over edges (src, dst) in at most depth hops, each at its least; lineage is cut at every hop."""
    seen = start.select("node", F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def _grown(frontier: DataFrame, edges: DataFrame, seen: DataFrame, hop: int) -> DataFrame:
    """(pair, came, node, hops): all links by which a frontier (pair, node) reaches nodes that its pair has not seen."""
    steps = frontier.join(edges, frontier.node == edges.src).select("pair", F.col("node").alias("came"), F.col("dst").alias("node")).distinct()
    return cut(steps.join(seen, ["pair", "node"], "left_anti").withColumn("hops", F.lit(hop)))


def path_between(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(pair, hops, path) of pairs (pair, src, dst) joined by a path of at most depth edges (src, dst): the shortest, of these the first by its nodes.

    All pairs search at once, from both ends in turn, each side keeping the links that it came
    by; a pair stops where its sides meet, so that each side goes half the way. The links on
    shortest paths are then marked from the nodes met, and one path is read along them. Lineage
    is cut at every hop. A node is joined to itself by no edge.
    """
    edges = edges.select("src", "dst").distinct()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    sides = []
    for end, graph in (("src", edges), ("dst", back)):
        first = pairs.select("pair", F.col(end).alias("node")).distinct()
        sides.append({"graph": graph, "seen": first.withColumn("hops", F.lit(0)), "front": first, "links": []})
    met = None
    for step in range(depth + 1):
        # a pair meets first where its sides' hops add up to the least
        a, b = (s["seen"].withColumnRenamed("hops", h) for s, h in zip(sides, ("there", "back"), strict=True))
        now = a.join(b, ["pair", "node"])
        now = cut(now if met is None else now.join(met.select("pair").distinct(), "pair", "left_anti"))
        met = now if met is None else met.unionByName(now)
        if step == depth:
            break
        side = sides[step % 2]
        front = side["front"].join(met.select("pair").distinct(), "pair", "left_anti")
        links = _grown(front, side["graph"], side["seen"].select("pair", "node"), len(side["links"]) + 1)
        side["links"].append(links)
        side["front"] = links.select("pair", "node").distinct()
        side["seen"] = side["seen"].unionByName(links.select("pair", "node", "hops").distinct())
    met = cut(met)
    on = []
    for side, hops in zip(sides, ("there", "back"), strict=True):
        marked = met.select("pair", "node", F.col(hops).alias("hops"))
        for hop in range(len(side["links"]), 0, -1):
            own = cut(side["links"][hop - 1].join(marked.where(F.col("hops") == hop), ["pair", "node", "hops"], "left_semi"))
            on.append(own.select("pair", "came", "node") if side is sides[0] else own.select("pair", F.col("node").alias("came"), F.col("came").alias("node")))
            marked = marked.where(F.col("hops") < hop).unionByName(own.select("pair", F.col("came").alias("node"), F.lit(hop - 1).alias("hops"))).distinct()
    hops = met.groupBy("pair").agg(F.min(F.col("there") + F.col("back")).alias("hops"))
    rows = pairs.join(hops, "pair").select("pair", "hops", F.col("src").alias("node"), F.array("src").alias("path"))
    if not on:
        return rows.select("pair", "hops", "path")
    links = on[0]
    for more in on[1:]:
        links = links.unionByName(more)
    following = cut(links.groupBy("pair", F.col("came").alias("node")).agg(F.min("node").alias("next")))
    for _ in range(depth):
        rows = cut(rows.join(following, ["pair", "node"], "left").select("pair", "hops", F.coalesce("next", "node").alias("node"), F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next"))).alias("path")))
    return rows.select("pair", "hops", "path")


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; a struct minimum combines before the shuffle, so hot keys cost nothing."""
    others = [c for c in rows.columns if c not in key and c not in order]
    return rows.groupBy(*key).agg(F.min(F.struct(*order, *others)).alias("row")).select(*key, "row.*")


def still_valid(entries: DataFrame, deps: DataFrame, files: DataFrame, snapshot: DataFrame, by_paths: bool = True) -> DataFrame:
    """Entries (key, repo, snapshot) with valid: of the current snapshot (repo, now), or, by paths, if all files that they depend on (key, path, digest) are unchanged in files (repo, path, digest); without dependencies only the snapshot counts."""
    state = deps.join(entries.select("key", "repo"), "key").join(files.select("repo", "path", F.col("digest").alias("is")), ["repo", "path"], "left")
    same = state.groupBy("key").agg(F.bool_and(F.coalesce(F.col("digest") == F.col("is"), F.lit(False))).alias("same"))
    rows = entries.join(snapshot, "repo", "left").join(same, "key", "left")
    by = F.coalesce("same", F.lit(False)) if by_paths else F.lit(False)
    return rows.withColumn("valid", F.coalesce(F.col("snapshot") == F.col("now"), F.lit(False)) | by).drop("now", "same")


def classified_hits(requests: DataFrame, memory: DataFrame, disk: DataFrame) -> DataFrame:
    """Requests (key) with layer and what a hit saved (turns, tokens): l1 where memory has a valid entry (key, valid, turns, tokens), l2 where disk has one, else miss."""
    one = lambda t, name: t.where("valid").groupBy("key").agg(F.max("turns").alias(f"{name}_turns"), F.max("tokens").alias(f"{name}_tokens"))
    rows = requests.join(one(memory, "l1"), "key", "left").join(one(disk, "l2"), "key", "left")
    l1, l2 = F.col("l1_turns").isNotNull(), F.col("l2_turns").isNotNull()
    rows = rows.withColumn("layer", F.when(l1, "l1").when(l2, "l2").otherwise("miss"))
    return rows.withColumns({f"{c}_saved": F.when(l1, F.col(f"l1_{c}")).when(l2, F.col(f"l2_{c}")) for c in ("turns", "tokens")}).drop(*(f"{x}_{c}" for x in ("l1", "l2") for c in ("turns", "tokens")))


def index_covers(changed: DataFrame, index: DataFrame) -> DataFrame:
    """(repo, covered): whether the index knows each changed file (repo, path) as it is: freshness (repo, path, freshness) metadata_match or not_tracked; what it doesn't tell counts as not."""
    rows = changed.join(index, ["repo", "path"], "left")
    return rows.groupBy("repo").agg(F.bool_and(F.coalesce(F.col("freshness").isin("metadata_match", "not_tracked"), F.lit(False))).alias("covered"))


def freshness(probes: DataFrame, now, staleness_seconds: int) -> DataFrame:
    """Probes (repo, exists, changed_files, indexed_at) with decision: reindex where there is no index, a change, an unknown, or too great an age; a time to come is none."""
    age = F.unix_timestamp(now) - F.unix_timestamp("indexed_at")
    fresh = F.col("exists") & (F.col("changed_files") == 0) & F.col("indexed_at").isNotNull() & (age <= staleness_seconds)
    return probes.withColumn("decision", F.when(F.coalesce(fresh, F.lit(False)), "up-to-date").otherwise("reindex"))


def may_skip_refresh(current, mark, age_seconds, ttl_seconds: int):
    """Whether a repeated call may trust the last refresh: same known state, younger than the time."""
    return F.coalesce((current == mark) & (age_seconds < ttl_seconds), F.lit(False))


def response_cap(detailed, cap, detailed_cap):
    """Characters of a snippet in an answer; 0 is no bound. A detailed answer never has less than another."""
    return F.when(~detailed, cap).when((cap == 0) | (detailed_cap == 0), 0).otherwise(F.greatest(cap, detailed_cap))


def store_stats(entries: DataFrame) -> DataFrame:
    """(schema_version, entries, bytes, oldest, newest) of a cache table."""
    return entries.groupBy("schema_version").agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"), F.min("last_hit").alias("oldest"), F.max("last_hit").alias("newest"))


def latest_inserted(entries: DataFrame, group: str, cap: int) -> DataFrame:
    """The last ``cap`` entries of each group by insertion (inserted, key)."""
    w = Window.partitionBy(group).orderBy(F.desc("inserted"), F.desc("key"))
    return entries.withColumn("age", F.row_number().over(w)).where(F.col("age") <= cap).drop("age")


def written_through(old: DataFrame, new: DataFrame, schema_version: int, budget: int) -> DataFrame:
    """The cache after new entries (grp, key, bytes, last_hit, schema_version): those of other versions go, of a key the one hit last stays, then each group keeps the latest within a budget of bytes."""
    rows = old.unionByName(new).where(F.col("schema_version") == schema_version)
    kept = rows.groupBy("grp", "key").agg(F.max(F.struct("last_hit", "bytes")).alias("m")).select("grp", "key", "m.bytes", "m.last_hit")
    return within_budget(kept, "grp", budget)


def write_cache(entries: DataFrame, path: str) -> None:
    """Cache rows as a whole, a folder a version; ``upsert`` replaces single keys."""
    entries.write.partitionBy("schema_version").mode("overwrite").parquet(path)


def upsert(rows: DataFrame, path: str, key: list[str], order: list[str], buckets: int = 256) -> None:
    """Puts rows into a table at path, a folder for each of a number of buckets of keys: of a key the row of the greatest order stays.

    Only the folders of the keys that came are read and written anew, from a table apart, so
    that a run that fails can be run again, with the same result; the others keep their files.
    Columns that an older table lacks are null there, and the other way round.
    """
    spark = rows.sparkSession
    new = cut(rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]
    if not touched:
        return
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        new = spark.read.parquet(path).where(F.col("bucket").isin(touched)).unionByName(new, allowMissingColumns=True)
    rest = [c for c in new.columns if c not in (*key, "bucket")]
    best = new.groupBy("bucket", *key).agg(F.max_by(F.struct(*rest), F.struct(*order, *rest)).alias("row")).select(*key, "row.*", "bucket")
    # a folder is one task's
    cut(best).repartition(min(len(touched), buckets), "bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def architecture(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n) of a graph of nodes (node, label) and edges (src, dst, type): nodes by label, edges by type, edges that reach each Package, and Functions that nothing calls."""
    labels = nodes.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("label").alias("kind"), F.col("label").alias("name"), "n")
    types = edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), F.col("type").alias("name"), "n")
    fan_in = nodes.where("label = 'Package'").join(edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")), "node", "left").select(F.lit("fan_in").alias("kind"), F.col("node").alias("name"), F.coalesce("n", F.lit(0)).alias("n"))
    entry = nodes.where("label = 'Function'").join(edges.where("type = 'CALLS'").select(F.col("dst").alias("node")), "node", "left_anti").select(F.lit("entry").alias("kind"), F.col("node").alias("name"), F.lit(1).cast("long").alias("n"))
    return labels.unionByName(types).unionByName(fan_in).unionByName(entry)
