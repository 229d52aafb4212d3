"""CSV records of splittable files: quoted line breaks are told from record ends without reading a file whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LINES = "file string, block long, at long, value string, odd int, even_starts long, odd_starts long"


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: per line, whether an odd number of quotes precedes it in its block, and the record starts before it.

    A line starts a record if an even number of quotes precedes it in the file. What precedes the block
    is not known here, so starts are counted for both cases.
    """
    key: tuple[str, int] | None = None
    quotes = even = odd = 0
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        count = pc.count_substring(batch.column("value"), '"').to_numpy(zero_copy_only=False)
        edges = [i for i in range(len(files)) if i == 0 or (files[i], blocks[i]) != (files[i - 1], blocks[i - 1])] + [len(files)]
        parity, evens, odds = (np.zeros(len(files), np.int64) for _ in range(3))
        for a, b in zip(edges, edges[1:]):
            if (files[a], blocks[a]) != key:
                key, quotes, even, odd = (files[a], blocks[a]), 0, 0, 0
            before = (quotes + np.concatenate([[0], np.cumsum(count[a:b])])) % 2
            parity[a:b] = before[:-1]
            evens[a:b] = even + np.cumsum(before[:-1] == 0) - (before[:-1] == 0)
            odds[a:b] = odd + np.cumsum(before[:-1] == 1) - (before[:-1] == 1)
            quotes, even, odd = int(before[-1]), even + int((before[:-1] == 0).sum()), odd + int((before[:-1] == 1).sum())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("file", "block", "at", "value")), pa.array(parity.astype(np.int32)), pa.array(evens), pa.array(odds)],
            ["file", "block", "at", "value", "odd", "even_starts", "odd_starts"],
        )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, value): the CSV records of plain or compressed text files, numbered from 0 in each file.

    Files are split like any text. Each block counts its quotes; the running parity over the blocks of a
    file, one row a block, tells every block whether it begins inside a quoted field. Lines then know
    their record, also one that began blocks before. Only records of several lines are shuffled.
    A carriage return before a record's end is dropped, those inside quotes stay. A quote that is never
    closed makes the rest of its file one record.
    """
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    lines = raw.mapInArrow(_parities, _LINES)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    blocks = lines.groupBy("file", "block").agg(
        (F.sum(quotes) % 2).alias("_odd"), F.count_if(F.col("odd") == 0).alias("_even"), F.count_if(F.col("odd") == 1).alias("_odds")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("open", F.coalesce(F.sum("_odd").over(earlier), F.lit(0)) % 2)
    starts = F.when(F.col("open") == 0, F.col("_even")).otherwise(F.col("_odds"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum(starts).over(earlier), F.lit(0))).select("file", "block", "open", "before")

    placed = lines.withColumn("quotes", quotes % 2).join(blocks, ["file", "block"])
    inside = (F.col("odd") + F.col("open")) % 2 == 1
    own = F.when(F.col("open") == 0, F.col("even_starts")).otherwise(F.col("odd_starts"))
    # a line inside a record belongs to the start before it
    placed = placed.select("file", "block", "at", "value", inside.alias("inside"), (F.col("before") + own - inside.cast("int")).alias("record"), "quotes")
    whole = ~F.col("inside") & (F.col("quotes") == 0)
    several = placed.filter(~whole).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("lines"))
    joined = several.select("file", "record", F.array_join("lines.value", "\n").alias("value"))
    records = placed.filter(whole).select("file", "record", "value").unionByName(joined)
    return records.withColumn("value", F.regexp_replace("value", r"\r\z", ""))
