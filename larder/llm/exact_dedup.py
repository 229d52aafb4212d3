"""Exact duplicates by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from larder.llm.store import stored

SALTS = 16


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS, digest: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts (null: empty) form a group, of which the largest doc_id stays. Every stage groups by
    the digest and the whole text: partial aggregation combines copies inside a task, the shuffle on
    (digest, text, salt) merges them per salt so that a text with a third of all rows meets in
    ``salts`` tasks, and a second one combines at most ``salts`` winners of a text. The documents then
    pick up their group by the digest alone, after the groups have shown that one digest is one text;
    digests shared by different texts (any weak ``digest`` has them) are matched by text.

    A null doc_id never wins unless all of its group are null; keep_id is then null and all are kept.
    Rows that repeat a doc_id and text tie: ``kept`` names a doc_id, so all of them carry it. An
    empty table gives no rows; further columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    sha = F.sha2(body, 256)
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"), (sha if digest is None else digest).alias("digest"), sha.alias("text_sha256"))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "body", "salt")
        .agg(F.max("doc_id").alias("winner"), F.count("*").alias("n"))
    )
    groups = (
        salted.repartition("digest")
        .groupBy("digest", "body")
        .agg(F.max("winner").alias("keep_id"), F.sum("n").alias("group_size"))
        .withColumn("texts", F.count("*").over(Window.partitionBy("digest")))
        .select("digest", "keep_id", "group_size", "texts", F.when(F.col("texts") > 1, F.col("body")).alias("only_for"))
    )
    groups = stored(groups)
    clear = groups.filter("texts = 1").select("digest", "keep_id", "group_size")
    found = rows.select("doc_id", "digest", "text_sha256").join(clear, "digest")
    mixed = groups.filter("texts > 1")
    if not mixed.isEmpty():
        by_text = mixed.select("digest", F.col("only_for").alias("body"), "keep_id", "group_size")
        found = found.unionByName(rows.join(by_text, ["digest", "body"]).drop("body"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
