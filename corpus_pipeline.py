"""Corpus pipeline: documents in, a mixed and sharded training set out, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back
as the next stage's documents. All stages but the last return the columns of their input. ``documents``
has doc_id, text and source; lang and n_chars are used where they are there. Columns named like those of an operator do no harm:
a stage carries the input row as one struct beside the operator's own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontaminate, mixing, near_dedup, quality, sharding
from larder.llm.store import scratch
from larder.session import tune

SHARD_WEIGHTS = [1.0] * 8


def _row(docs: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def _unpacked(kept: DataFrame, column: str, docs: DataFrame) -> DataFrame:
    return kept.select(*(F.col(f"{column}.`{c}`").alias(c) for c in docs.columns))


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier accepts: prose, without abuse."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.classify(docs, labels, keep=_row(docs))
    return _unpacked(judged.filter("accepted"), "carried", docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, and of equal texts, the document with the smallest doc_id."""
    found = near_dedup.near_duplicates(docs, keep=_row(docs))
    return _unpacked(found.filter("kept"), "carried", docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, items, keep=_row(docs))
    return _unpacked(found.filter(~decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))), "carried", docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: once per whole epoch, then the words that are left of the budget.

    The document in which a source's budget ends is cut after its last taken word (n_chars follows the
    cut). Documents without words carry no tokens; they stay once.
    """
    mixed = mixing.mix_sources(docs, keep=_row(docs))
    size, taken = F.col("size"), F.col("taken")
    times = F.when(size == 0, 1).otherwise(F.ceil(taken / size)).cast("int")
    each = mixed.filter((size == 0) | (taken > 0)).withColumn("pass", F.explode(F.sequence(F.lit(1), times)))
    words = F.when(size == 0, 0).otherwise(F.least(size, taken - (F.col("pass") - 1) * size))
    text = F.col("carried.text")
    cut = F.when(words < size, mixing.first_words(text, words)).otherwise(text)
    out = each.withColumn("cut", cut)
    return out.select(
        *(
            F.col("cut").alias(c) if c == "text" else F.when(words < size, F.length("cut").cast(docs.schema[c].dataType)).otherwise(F.col("carried.n_chars")).alias(c) if c == "n_chars" else F.col(f"carried.`{c}`").alias(c)
            for c in docs.columns
        )
    )


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, their slot in it, and the shard that one more shard would give."""
    placed = sharding.shard(docs, SHARD_WEIGHTS, keep=_row(docs))
    own = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return placed.select(*(F.col(f"carried.`{c}`").alias(c) for c in docs.columns if c not in own), *own)


STAGES = [
    ("quality", accept_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_to_weights),
    ("shard", to_shards),
]

ORACLE_SQL = None  # a fitted classifier and similarity classes are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is a table in the shared folder."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
