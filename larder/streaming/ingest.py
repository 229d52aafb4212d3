"""Snapshot files processed as they land; re-delivery changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import ids
from larder.operators import normalize, selection
from larder.policy import SelectionPolicy, SourcePolicy
from larder.sources import jsonl

# Keyed state on local disk with changes in the checkpoint: a batch loads and writes the keys it touches.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def selected_identities(lines: DataFrame, source: SourcePolicy, policy: SelectionPolicy) -> DataFrame:
    """Identity rows, with content ids, of the selected products among raw JSON lines."""
    accepted = lines.filter(jsonl.line_outcome(F.col("value")) == "accepted")
    typed = jsonl.products(accepted).filter(F.col("schema_version") == source.schema_version)
    kept = selection.selected(selection.classify(normalize.candidates(typed, source), policy), policy)
    c = F.col
    fields = {"gtin": c("gtin"), "market": c("market"), "sourceRecordID": c("source_record_id"), "name": c("name"), "brand": c("brand"), "reason": c("reason_code")}
    rows = kept.select("gtin", "market", "source_record_id", "name", "brand", "reason_code")
    return rows.withColumn("id", ids.evidence_id("identity", fields))


def ingest(
    spark: SparkSession, landing: str, table: str, checkpoint: str, source: SourcePolicy = SourcePolicy(), policy: SelectionPolicy = SelectionPolicy(), files_per_batch: int = 100
) -> None:
    """Process all files that landed since the last run, then stop.

    The ids that were seen are the stream's own keyed state: only ids of new lines are looked up, so a
    batch costs what it brings, however many came before. Every batch writes its own partition of the
    table and replaces it when it is retried; the table itself is never read. So a file delivered twice,
    or an executor lost half-way, leaves the table as it was. ``checkpoint`` holds the state and must be
    in a folder that all executors share.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(landing)
        new = selected_identities(lines.withColumn("line", F.lit(0).cast("long")), source, policy).dropDuplicates(["id"])
        query = new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
