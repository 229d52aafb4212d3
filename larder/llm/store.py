"""Tables that cut lineage, and fixed-size filters that spare shuffles."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILTER_BITS = 1 << 25  # 4 MB at any input size
_BUCKET_BITS = 32768  # bits that bitmap_construct_agg packs into one value


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names.

    Only a local session that names none (tests) gets a temporary folder; a cluster without one is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="larder-llm-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/larder-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write the rows as a shared table and read them back: one evaluation, and no lineage to replay."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_filter(keys: DataFrame, key: str) -> np.ndarray:
    """Bitmap of ``FILTER_BITS`` bits over a long key column, for ``may_hold``.

    Its size never depends on the data; past some 10 million keys it lets more rows through, which
    costs a larger join afterwards and never a result.
    """
    place = F.pmod(F.col(key), F.lit(FILTER_BITS)) + 1  # the bitmap functions count from 1
    parts = (
        keys.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        .collect()  # at most FILTER_BITS / 32768 = 1024 rows of 4 KB
    )
    bits = np.zeros(FILTER_BITS // 8 + _BUCKET_BITS // 8, np.uint8)
    for row in parts:
        start = (row.bucket - 1) * (_BUCKET_BITS // 8)
        bits[start : start + len(row.bits)] |= np.frombuffer(bytes(row.bits), np.uint8)
    return bits


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Mask of the signed or unsigned 64-bit keys that the filter may hold."""
    place = keys.astype(np.int64) & np.int64(FILTER_BITS - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def text_key(text: Column) -> Column:
    """128 bits of SHA-256 as lower-case hex: the identity of a text."""
    return F.substring(F.sha2(text, 256), 1, 32)
