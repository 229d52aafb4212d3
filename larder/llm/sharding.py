"""Weighted rendezvous sharding of stable record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.prefix import with_prefix
from larder.llm.store import stored


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of least -ln(u) / weight, with u a uniform hash of key and shard.

    A shard's score depends on its own number and weight alone: another shard takes rows only into
    itself, and a weight that grows draws rows only to its shard.
    """
    def score(shard: int, weight: float) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("long")
        return -F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))

    scored = F.array(*(F.struct(score(i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)))
    return F.array_min(scored)["shard"]


def shard(docs: DataFrame, weights: list[float], doc_id: str = "doc_id", text: str = "text", keep: Column | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The shard follows from doc_id and the weights; ``grown_shard`` is the one with one more shard of
    mean weight. ``slot`` numbers the rows of a shard from 0 in hash order, through prefix sums over
    ranges of the hash. ``keep`` adds a struct column that is carried along.

    A null doc_id hashes as empty, so all such rows share a shard; null texts have size 1 and the
    checksum of no bytes. Rows that repeat a doc_id go to one shard and are numbered by checksum and
    size; equal rows in any order. An empty table gives no rows.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, sum(weights) / len(weights)]).alias("grown_shard"),
        F.md5(F.concat(F.lit("slot:"), key)).alias("key"),
        F.lit(1).cast("long").alias("one"),
        *([keep.alias("carried")] if keep is not None else []),
    )
    placed = with_prefix(stored(rows), ["shard"], "key", ["doc_id", "text_crc32", "size"], "one")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("before").alias("slot"), "grown_shard", *(["carried"] if keep is not None else []))
