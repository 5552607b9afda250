"""Corpus preparation: five operators in a row, each on what the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, with the columns of documents in all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflaw.llm import decontam, langid, mixing, shards, simhash
from tabflaw.llm.common import free_name, prepare, written

#: A text whose best cosine is below this resembles no learned language.  Without a common trigram, cosines are noise of
#: 1/sqrt(DIM) about 0; the largest of a few languages stays below 3.5 times that.
MIN_COSINE = 3.5 / langid.DIM ** 0.5
#: The same for texts of LONG_LETTERS letters or more: random letters of a learned script share ever more trigrams the
#: longer they are (up to 0.19), prose has 0.25 or more at that length, but less in a few words.
MIN_COSINE_LONG = 0.2
LONG_LETTERS = 100


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; null texts, texts without letters and texts unlike every language go."""
    prepare(spark)
    prototypes = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))
    name = free_name(docs.columns, "identified")
    score = F.col(f"{name}.score")
    short = F.length(F.regexp_replace("text", r"\P{L}+", "")) < LONG_LETTERS
    return docs.withColumn(name, langid.classify(F.col("text"), prototypes)) \
        .filter((F.col(f"{name}.lang") != langid.UND) & ((score >= MIN_COSINE_LONG) | ((score >= MIN_COSINE) & short))).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class, the one with the smallest id (null ids last).  Null and empty texts are one class;
    repeated rows leave one."""
    prepare(spark)
    return simhash.one_of_each(docs, size=3, distance=2)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: they are cut out, and documents more than a fifth of which they are go.

    The others are returned as they are, null and empty texts among them; n_chars follows a cut text."""
    prepare(spark)
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    cleaned = decontam.clean(docs, items, window=10)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.least("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix of its source takes it (at most twice).

    A null source is a source; null texts have no words and are taken by chance.  Equal rows share their copies."""
    prepare(spark)
    return mixing.apply_mix(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and position; null texts have size 1, equal texts are one group, an empty table gives no rows."""
    prepare(spark)
    return shards.shard(docs, shards=16)


STAGES = [("language_id", identify_language), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_benchmark_leaks), ("mixing", mix_sources), ("sharding", deal_shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read by the next."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs


#: Learned profiles, fingerprints and random rounding are beyond SQL: tests/llm holds run() against brute force.
ORACLE_SQL = None
