"""A stored index of trigrams: refreshed for what changed, read by repository and trigram, and searched like the lines themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import in_scope
from ..sources.corpus import corpus_lines
from ..sources.scratch import cut
from .incremental import snapshot_diff
from .retrieval import substring_hits

#: Folders of a segment by trigram, besides those by repository.
BUCKETS = 16
GRAM = r"(?=([\s\S]{3}))"


def _grams(text: Column) -> Column:
    """Distinct trigrams of lower-cased text; the one letter whose lower case depends on what follows, the final sigma, counts as the other."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.lower(text), "ς", "σ"), F.lit(GRAM), F.lit(1)))


def _exists(df: DataFrame, path: str) -> bool:
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(place)


class Postings:
    """Trigrams of files under a folder, in segments: a refresh adds one with the files that came or changed.

    grams/segment=../repo=../bucket=..: (gram, path, n), n lines of the file hold the gram. A line
    end is in no gram. files/version=..: (repo, path, digest, segment), which segment speaks for a
    file; the latest whole version counts, so that a refresh that failed halfway changes nothing
    and can be run again.
    """

    def __init__(self, root: str):
        self.root = root

    def _versions(self, df: DataFrame) -> list[int]:
        if not _exists(df, f"{self.root}/files"):
            return []
        jvm, place = df.sparkSession._jvm, df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{self.root}/files")
        fs = place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
        done = [str(s.getPath().getName()) for s in fs.listStatus(place) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(x.split("=")[1]) for x in done if x.startswith("version="))

    def files(self, df: DataFrame) -> DataFrame | None:
        """The files that the index knows; None before the first refresh. df gives the session."""
        known = self._versions(df)
        return df.sparkSession.read.parquet(f"{self.root}/files/version={known[-1]}") if known else None

    def refresh(self, files: DataFrame, stats: DataFrame) -> DataFrame:
        """Brings the index to files (repo, path, content), whose digests are stats (repo, path, digest): gives the changes (repo, path, change).

        Only the contents of files that were added or modified are read.
        """
        old = self.files(files)
        stats = stats.select("repo", "path", "digest")
        before = old if old is not None else stats.limit(0).withColumn("segment", F.lit(0))
        keyed = lambda df: df.select(F.struct("repo", "path").alias("path"), "digest")
        changes = cut(snapshot_diff(keyed(before), keyed(stats)).select("path.repo", "path.path", "change"))
        segment = max([0, *self._versions(files)]) + 1
        wanted = changes.where("change <> 'deleted'").select("repo", "path")
        lines = corpus_lines(files.join(wanted, ["repo", "path"], "left_semi")).select("repo", "path", F.explode(_grams(F.col("line"))).alias("gram"))
        rows = lines.groupBy("repo", "path", "gram").agg(F.count("*").alias("n")).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
        # a row range is a task's, so that no repository or bucket is one
        rows.repartitionByRange("repo", "bucket", "gram", "path").write.partitionBy("repo", "bucket").mode("overwrite").parquet(f"{self.root}/grams/segment={segment}")
        kept = before.join(changes.select("repo", "path"), ["repo", "path"], "left_anti").select("repo", "path", "digest", F.col("segment").cast("int").alias("segment"))
        now = kept.unionByName(stats.join(wanted, ["repo", "path"]).withColumn("segment", F.lit(segment)))
        now.write.mode("overwrite").parquet(f"{self.root}/files/version={segment}")
        return changes

    def _read(self, df: DataFrame, segments: list[int], repos: list[str], buckets: list[int]) -> DataFrame:
        """Postings of the segments, repositories and buckets named: other folders are not opened."""
        spark = df.sparkSession
        rows = spark.read.schema("gram string, path string, n bigint, segment int, repo string, bucket int").option("basePath", f"{self.root}/grams").parquet(*(f"{self.root}/grams/segment={s}" for s in segments))
        return rows.where(F.col("bucket").isin(buckets) & (F.col("repo").isin(repos) if len(repos) <= 1000 else F.lit(True)))

    def candidates(self, patterns: DataFrame) -> DataFrame:
        """(query_id, pattern, repo, path) of the files that hold the rarest trigram of a pattern (query_id, pattern, repo, and a scope if there is one); patterns below three characters have all files of their repository."""
        known = self.files(patterns)
        more = [c for c in ("scope",) if c in patterns.columns]
        asked = patterns.where("pattern <> '' and repo is not null").select("query_id", "pattern", "repo", *more).distinct()
        none = asked.select("query_id", "pattern", "repo", F.lit(None).cast("string").alias("path")).limit(0)
        if known is None:
            return none
        long = F.char_length("pattern") >= 3
        inside = lambda df: df.where(in_scope(F.col("path"), F.col("scope"))).drop("scope") if more else df
        short = inside(asked.where(~long).join(known.select("repo", "path"), "repo")).select("query_id", "pattern", "repo", "path")
        wanted = cut(asked.where(long).withColumn("gram", F.explode(_grams(F.col("pattern")))).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")))
        # folders by name: buckets are few, and repositories are named one by one up to a thousand
        buckets = [r.bucket for r in wanted.select("bucket").distinct().collect()]
        repos = [r.repo for r in wanted.select("repo").distinct().limit(1001).collect()]
        if not buckets:
            return short
        segments = [r.segment for r in known.select("segment").distinct().collect()]
        posts = self._read(patterns, segments, repos, buckets).join(wanted.select("repo", "gram").distinct(), ["repo", "gram"], "left_semi").join(known.select("repo", "path", "segment"), ["repo", "path", "segment"], "left_semi")
        posts = cut(posts)
        counts = posts.groupBy("repo", "gram").agg(F.sum("n").alias("n"))
        # a pattern with a gram that no file has finds nothing
        rare = wanted.join(counts, ["repo", "gram"], "left").groupBy("query_id", "pattern", "repo", *more).agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
        found = inside(rare.join(posts.select("repo", "gram", "path"), ["repo", "gram"])).select("query_id", "pattern", "repo", "path")
        return found.unionByName(short)

    def search(self, files: DataFrame, patterns: DataFrame) -> DataFrame:
        """Lines of files that hold the patterns of their repository, the rows of ``substring_hits``: only files that the index names are read line by line. files are those of the last refresh."""
        named = cut(self.candidates(patterns))
        lines = corpus_lines(files.join(named.select("repo", "path").distinct(), ["repo", "path"], "left_semi"))
        return substring_hits(lines, patterns)

    def compact(self, session: DataFrame) -> None:
        """Writes what the segments hold for known files as one segment."""
        known = self.files(session)
        if known is None:
            return
        segment = max(self._versions(session)) + 1
        segments = [r.segment for r in known.select("segment").distinct().collect()]
        rows = self._read(session, segments, [""] * 1001, list(range(BUCKETS))).join(known.select("repo", "path", "segment"), ["repo", "path", "segment"], "left_semi").drop("segment")
        rows.repartitionByRange("repo", "bucket", "gram", "path").write.partitionBy("repo", "bucket").mode("overwrite").parquet(f"{self.root}/grams/segment={segment}")
        known.withColumn("segment", F.lit(segment)).write.mode("overwrite").parquet(f"{self.root}/files/version={segment}")
