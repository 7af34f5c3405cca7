"""The corpus pipeline: language, toxicity, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.llm import jaccard, langid, packing, substrings, toxicity
from tracery.llm.common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: shingles of five words, a similarity of 0.8.
SHINGLE, PERCENT = 5, 80
#: The tokenizer whose ids are packed.
TOKENIZER = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letters, thus no language (null and empty texts among them). Rows that repeat a doc_id are judged one by one."""
    model = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return langid.with_language(docs.select(COLUMNS), model)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are more likely toxic than not. Rows that repeat a doc_id are judged one by one."""
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), toxicity.grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.without_toxic(docs.select(COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest doc_id, of each group; documents without words, and rows without a doc_id, are no group and stay. Rows that repeat a doc_id stay or go together."""
    groups = jaccard.jaccard_groups(docs, SHINGLE, PERCENT)
    kept = docs.join(groups.where("doc_id = component_id").select("doc_id").distinct(), "doc_id", "left_semi")
    return kept.select(COLUMNS).unionByName(docs.where("doc_id is null").select(COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words or more that occur earlier; texts that lose none stay as they are, texts that lose all go. Rows that repeat a doc_id are one document: what stands at the same place of two of them is no repeat; rows without one lose nothing."""
    rows = substrings.without_repeats(docs, carry=("text", "lang", "source", "n_chars")).where("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    n_chars = F.when(changed, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
    return rows.select("doc_id", F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source", n_chars.alias("n_chars"))


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens. Null and empty texts have the end id alone; rows that repeat a doc_id, or have none, are packed one by one."""
    import public_tokenizers

    return packing.packed(spark, docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("passages", passages), ("packing", packs)]
#: SQL has no tokenizer and no trained model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as s:
        for name, stage in STAGES[:-1]:
            docs = s.table(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)
