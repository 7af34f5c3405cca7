"""Files, lines and validated JSON rows as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, content) of the text files under root; files with a NUL byte and hidden paths are left out."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return rows.where(~F.contains("content", F.char(F.lit(0))) & ~F.col("path").rlike(r"/\.[^/]"))


def corpus_files(documents: DataFrame) -> DataFrame:
    """(repo, path, content, lang): documents seen as files, a repository for each source."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return documents.select(F.col("source").alias("repo"), path.alias("path"), F.col("text").alias("content"), "lang")


def corpus_lines(files: DataFrame, *more: str) -> DataFrame:
    """(repo, path, line_no, line) and more columns of the files: lines from 1, without line ends; a last empty line is none."""
    parts = F.split("content", "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    bare = F.when(F.endswith("line", F.lit("\r")), F.substring("line", F.lit(1), F.char_length("line") - 1)).otherwise(F.col("line"))
    return files.select("repo", "path", *more, F.posexplode(parts).alias("p", "line")).select("repo", "path", (F.col("p") + 1).alias("line_no"), bare.alias("line"), *more)


def file_stats(files: DataFrame) -> DataFrame:
    """(repo, path, line_count, digest)."""
    n = F.size(F.split("content", "\n")) - F.when(F.endswith("content", F.lit("\n")), 1).otherwise(F.when(F.col("content") == "", 1).otherwise(0))
    return files.select("repo", "path", n.alias("line_count"), F.sha2("content", 256).alias("digest"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, required: list[str], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): rows that parse and have the required keys, and the others with file and error; blank lines are skipped. strict raises where any is rejected."""
    parsed = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "").withColumn("row", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"}))
    missing = F.array_compact(F.array(*(F.when(F.get_json_object("value", f"$.{k}").isNull(), F.lit(k)) for k in required)))
    error = F.when(F.col("row._bad").isNotNull(), F.lit("not a JSON object of this shape")).when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    judged = parsed.withColumn("error", error)
    rejected = judged.where("error is not null").select("file", "value", "error")
    if strict and (first := rejected.head()):
        raise ValueError(f"{first.file}: {first.error}: {first.value[:80]}")
    return judged.where("error is null").select(*(F.col(f"row.{f.name}") for f in schema.fields)), rejected


def write_splits(rows: DataFrame, path: str) -> None:
    """JSON rows by split."""
    rows.write.partitionBy("split").mode("overwrite").json(path)


def read_outline(rows: DataFrame) -> DataFrame:
    """(repo, path, qualified_name, label, line_start, line_end) of symbol rows whose columns go by several names.

    Names: qualified_name, qn, name or symbol, the first that isn't null; paths: file, path or
    file_path; lines: a "start-end" cell (lines), or line_start or start_line and line_end or
    end_line. The end of a whole file's Module is one past its last line and put right. Rows
    without a path or a name go; unknown lines are 0.
    """
    first = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in rows.columns), F.lit(None).cast("string"))
    cell = lambda i: F.regexp_extract(first("lines"), r"^(\d+)(?:-(\d+))?$", i)
    number = lambda x: x.try_cast("int")
    start = F.coalesce(number(cell(1)), number(first("line_start", "start_line")), F.lit(0))
    end = F.coalesce(number(cell(2)), number(cell(1)), number(first("line_end", "end_line")), start)
    label = first("label")
    out = rows.select(first("repo").alias("repo"), first("file", "path", "file_path").alias("path"), first("qualified_name", "qn", "name", "symbol").alias("qualified_name"), label.alias("label"), start.alias("line_start"), F.when((label == "Module") & (end > start), end - 1).otherwise(end).alias("line_end"))
    return out.where("path is not null and qualified_name is not null")


def outline(files: DataFrame) -> DataFrame:
    """(repo, path, qualified_name, line_start, line_end): a symbol for each line that begins a section, up to the line before the next."""
    from pyspark.sql import Window

    # a line's first word is all of it that is shuffled
    lines = corpus_lines(files).where(F.trim("line") != "").select("repo", "path", "line_no", F.regexp_extract("line", r"^(\w+)", 1).alias("name"))
    w = Window.partitionBy("repo", "path").orderBy("line_no")
    rows = lines.withColumn("line_end", F.lead("line_no").over(w) - 1).where("name <> ''")
    doc = F.element_at(F.split("path", "/"), -1)
    return rows.select("repo", "path", F.concat_ws(".", "repo", doc, "name").alias("qualified_name"), F.col("line_no").alias("line_start"), F.coalesce("line_end", "line_no").alias("line_end"))
