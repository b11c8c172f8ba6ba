"""The training-data pipeline: stages over documents, each written and read again.

Each stage works on all that the one before has kept and its decisions take effect; all
but the last return the columns of documents.

Defined cases, of every stage: null ids and null values of other columns are kept as they
are; a null, empty or white-space text goes with the quality rules, and the later stages,
given one, keep it (repeated passages drops null and empty ones); rows that repeat
an id with different texts are documents of their own, and of rows equal in id and text
one stays from near duplicates on; texts of any length are taken whole; an empty table
gives an empty table; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_encode, byte_bpe_path
from tessera.llm.minhash import NO_ID, minhash_classes
from tessera.llm.mixing import mix_sources
from tessera.llm.quality_rules import quality_rules
from tessera.llm.store import written
from tessera.llm.suffix_dedup import suffix_dedup

PASSAGE = 51  # words: passages of over 50
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the quality rules reject go."""
    return quality_rules(docs, carry=COLUMNS).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that of smallest id (without one: of least mark), and of rows equal in id and text the first by their other columns.

    Rows that repeat an id with different texts are documents of their own; texts without a word have no class and all stay.
    """
    place = [F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "mark"]
    kept = minhash_classes(docs).filter("kept").select(*place).distinct()
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("mark")).select("*", place[0])
    stay = rows.join(kept, ["_id", "mark"], "left_semi")
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    first = stay.filter(words).groupBy("_id", "mark").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return first.union(stay.filter(~words).select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under repeated windows of `PASSAGE` words go, with what lies between them; what is cut inside a character goes with it; texts of which nothing is left go."""
    cut = suffix_dedup(docs, PASSAGE, PASSAGE // 2, carry=COLUMNS, by_words=True)
    text = F.try_validate_utf8(F.col("kept").cast("string"))
    text = F.coalesce(text, F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("�"), F.lit("")))
    out = cut.select("row.*", text.alias("_kept")).withColumn("text", F.col("_kept")).withColumn("n_chars", F.length("_kept").cast("long"))
    return out.filter("length(text) > 0").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weights: nine tenths of the tokens, each text once at most."""
    return mix_sources(docs, share=0.9, max_epochs=1).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, ready for training."""
    return bpe_encode(docs, byte_bpe_path(), carry=["lang", "source"]).select("doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("source mix", mixture), ("bpe", encoded)]

ORACLE_SQL = None  # suffix arrays, near duplicates and BPE are beyond SQL; tests/llm holds each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
