"""CSV catalog shards: reading, auditing, and turning rows into evidence."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import barcodes, clock, ids, text
from larder.schemas import SHARD_COLUMNS, SHARD_SCHEMA
from larder.sources.records import read_records

WHOLE_BYTES = 64 * 1024 * 1024  # a file of this size is one cell of a row
_DIGEST = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("records", pa.int64())])
CONFIDENCE = ["low", "medium", "high"]
RETAILER_KINDS = ["community-store-report", "retailer-observation"]
LANGUAGE = r"\A(?:[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})*|und)\z"


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Plain or gzip CSV shards with the fixed header; empty cells are empty text, as in the files.

    Files are split among tasks at any place (``records.read_records``). A file with another header,
    or a record with another number of cells, ends the read with an error that names the file.
    """
    rows = read_records(spark, path)
    header = F.when(F.replace("value", F.lit(chr(34)), F.lit("")) == ",".join(SHARD_COLUMNS), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("unexpected header in "), "file")).cast("boolean")
    )
    cells = F.size(F.split(bare_fields(F.col("value")), ","))
    width = F.when(cells == len(SHARD_COLUMNS), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("record "), F.col("record").cast("string"), F.lit(" has "), cells.cast("string"), F.lit(" cells in "), "file")).cast("boolean")
    )
    # the header is checked where it stands and goes; the check is the filter, so it cannot be optimised away
    good = rows.filter(F.when(F.col("record") == 0, ~header).otherwise(width))
    parsed = good.select("file", "record", F.from_csv("value", SHARD_SCHEMA, {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1", "lineSep": "\u0001"}).alias("r"))
    return parsed.select("file", "record", "r.*").fillna("")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Shard rows from CSV text lines."""
    return lines.select("line", F.from_csv("value", SHARD_SCHEMA, {"escape": '"', "maxCharsPerColumn": "-1"}).alias("r")).select("line", "r.*").fillna("")


# Possessive runs: one step a run, so a field of any length costs no stack.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'


def bare_fields(value: Column) -> Column:
    """A CSV record with each quoted field replaced by ``q``: what is left holds the separators and stray quotes only."""
    return F.regexp_replace(value, _QUOTED, "q")


def csv_violations(lines: DataFrame, max_columns: int = 256, max_field: int = 1_000_000, max_line: int = 4_000_000) -> DataFrame:
    """(line, rule) for lines that break the bounds of the CSV contract."""
    value = F.col("value")
    quoted = bare_fields(value)
    fields = F.regexp_extract_all(value, F.lit(rf'(?:{_QUOTED}|[^,"]++)++'), F.lit(0))
    bare = lambda f: F.regexp_replace(F.regexp_replace(f, r'^"|"$', ""), '""', '"')
    rules = [
        (F.octet_length(value) > max_line, "line-bytes"), (value.contains("\u0000"), "nul"),
        (value.rlike(r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]"), "control-character"),
        (F.size(F.split(quoted, ",")) > max_columns, "columns"),
        (F.coalesce(F.array_max(F.transform(fields, lambda f: F.length(bare(f)))), F.lit(0)) > max_field, "field-length"),
        (quoted.contains('"'), "quotes"),
    ]
    return lines.select("line", F.explode(F.array_compact(F.array(*(F.when(cond, F.lit(name)) for cond, name in rules)))).alias("rule"))


def file_violations(records: DataFrame, max_bytes: int, max_rows: int = 1_000_000) -> DataFrame:
    """(file, rule) for files of CSV records (file, value) that are too long: ``file-bytes`` or ``file-rows``.

    Line breaks count as one byte each. Counts are aggregates, so a large file is no single task.
    """
    sizes = records.groupBy("file").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.count("*").alias("rows"))
    rules = F.array_compact(F.array(F.when(F.col("bytes") > max_bytes, F.lit("file-bytes")), F.when(F.col("rows") > max_rows, F.lit("file-rows"))))
    return sizes.select("file", F.explode(rules).alias("rule"))


def row_violations(rows: DataFrame, policies: DataFrame, market: str) -> DataFrame:
    """(line, rule) against the row contract; hosts and source keys come from the source policies."""
    c = F.col
    policy = policies.select(F.col("source_key"), F.col("hosts"))
    joined = rows
    for role in ("identity", "ingredients", "retailer"):
        joined = joined.join(
            policy.select(F.col("source_key").alias(f"{role}_source_key"), F.col("hosts").alias(f"_{role}_hosts")), f"{role}_source_key", "left"
        )
    blank = lambda name: ~text.has_text(c(name))
    bad_time = lambda name: clock.instant(c(name)).isNull()
    bad_url = lambda role: (c(f"{role}_source_url") != "") & (
        ~c(f"{role}_source_url").rlike(r"\Ahttps://[^/?#@]+") | ~F.coalesce(
            F.array_contains(f"_{role}_hosts", F.lower(F.regexp_extract(f"{role}_source_url", r"\Ahttps://([^/?#:]+)", 1))), F.lit(False))
    )
    has_text, has_retailer = text.has_text(c("ingredients_text")), c("retailer_kind") != ""
    extra = lambda names: F.concat(*map(c, names)) != ""
    checks: list[tuple[str, Column]] = [
        ("gtin", barcodes.gtin14(c("gtin")).isNull() | (F.length("gtin") != 14)),
        ("market", c("market") != market),
        ("blank:original_barcode", blank("original_barcode")), ("blank:product_name", blank("product_name")),
        ("identity-confidence", ~c("identity_confidence").isin(*CONFIDENCE)),
        ("identity-source", c("_identity_hosts").isNull()),
        ("blank:identity_source_record_id", blank("identity_source_record_id")),
        ("identity-time", bad_time("identity_retrieved_at")),
        ("ingredients-source", has_text & c("_ingredients_hosts").isNull()),
        ("ingredients-record", has_text & blank("ingredients_source_record_id")),
        ("ingredients-time", has_text & bad_time("ingredients_retrieved_at")),
        ("ingredients-language", has_text & ~c("ingredients_language").rlike(LANGUAGE)),
        ("ingredients-observed", has_text & (c("ingredients_observed_at") != "") & bad_time("ingredients_observed_at")),
        ("ingredients-url", has_text & bad_url("ingredients")),
        ("ingredient-metadata-without-text", ~has_text & extra(
            ["ingredients_language", "allergens_text", "ingredients_source_key", "ingredients_source_record_id",
             "ingredients_retrieved_at", "ingredients_observed_at", "ingredients_source_url"])),
        ("retailer-kind", has_retailer & ~c("retailer_kind").isin(*RETAILER_KINDS)),
        ("blank:retailer_key", has_retailer & blank("retailer_key")),
        ("retailer-confidence", has_retailer & ~c("retailer_confidence").isin(*CONFIDENCE)),
        ("retailer-source", has_retailer & c("_retailer_hosts").isNull()),
        ("retailer-time", has_retailer & bad_time("retailer_retrieved_at")),
        ("retailer-observed-missing", (c("retailer_kind") == "retailer-observation") & (c("retailer_observed_at") == "")),
        ("retailer-url", has_retailer & bad_url("retailer")),
        ("blank:retailer_limitations", has_retailer & blank("retailer_limitations")),
        ("retailer-metadata-without-kind", ~has_retailer & extra(
            ["retailer_key", "retailer_confidence", "retailer_source_key", "retailer_source_record_id", "retailer_retrieved_at",
             "retailer_observed_at", "retailer_snapshot_at", "retailer_location_id", "retailer_source_url", "retailer_scope", "retailer_limitations"])),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in checks)))
    return joined.select("line", F.explode(found).alias("rule"))


def to_evidence(rows: DataFrame) -> dict[str, DataFrame]:
    """Identity, ingredient, retailer and selection tables of shard rows; all row-local."""
    c = F.col
    some = lambda name: F.nullif(c(name), F.lit(""))
    has_text, has_retailer = text.has_text(c("ingredients_text")), c("retailer_kind") != ""
    identity = {
        "gtin": c("gtin"), "originalBarcode": c("original_barcode"), "market": c("market"), "sourceKey": c("identity_source_key"),
        "sourceRecordID": c("identity_source_record_id"), "name": c("product_name"), "retrievedAt": c("identity_retrieved_at"),
        "confidence": c("identity_confidence"), "brand": some("brand"), "quantity": some("quantity"),
        "categories": F.when(c("category") != "", F.array("category")),
    }
    none = F.lit(None).cast("string")
    ingredient = {
        "gtin": c("gtin"), "market": c("market"), "sourceKey": c("ingredients_source_key"), "sourceRecordID": c("ingredients_source_record_id"),
        "ingredientsText": c("ingredients_text"), "languageCode": c("ingredients_language"), "retrievedAt": c("ingredients_retrieved_at"),
        "captureMethod": F.lit("source-text"), "verificationState": F.lit("unverified"), "observedAt": some("ingredients_observed_at"),
        "allergensText": some("allergens_text"), "contentHash": ids.formulation_hash(c("ingredients_text"), some("allergens_text"), none),
    }
    retailer = {
        "kind": c("retailer_kind"), "retailerKey": c("retailer_key"), "gtin": c("gtin"), "market": c("market"), "sourceKey": c("retailer_source_key"),
        "sourceRecordID": c("retailer_source_record_id"), "retrievedAt": c("retailer_retrieved_at"), "confidence": c("retailer_confidence"),
        "limitations": c("retailer_limitations"), "observedAt": some("retailer_observed_at"), "snapshotAt": some("retailer_snapshot_at"),
        "locationID": some("retailer_location_id"), "scope": some("retailer_scope"),
    }
    keyed = rows.select(
        "*", ids.evidence_id("identity", identity).alias("identity_id"),
        F.when(has_text, ids.evidence_id("ingredient", ingredient)).alias("ingredient_id"),
        F.when(has_text, ingredient["contentHash"]).alias("content_hash"),
        F.when(has_retailer, ids.evidence_id("retailer", retailer)).alias("retailer_id"),
    )
    selection = {"gtin": c("gtin"), "market": c("market"), "identityObservationID": c("identity_id"), "ingredientObservationID": c("ingredient_id"),
                 "retailerEvidenceIDs": F.array_compact(F.array("retailer_id"))}
    return {
        "identity": keyed.select(c("identity_id").alias("id"), "gtin", "market", c("product_name").alias("name"), some("brand").alias("brand")),
        "ingredient": keyed.filter("ingredient_id is not null").select(c("ingredient_id").alias("id"), "gtin", "market", "content_hash"),
        "retailer": keyed.filter("retailer_id is not null").select(c("retailer_id").alias("id"), "gtin", "market", "retailer_key"),
        "selection": keyed.select(ids.evidence_id("selection", selection).alias("id"), "gtin", "market", "identity_id", "ingredient_id", "retailer_id"),
    }


def unsorted_rows(rows: DataFrame, shard: str, line: str, key: str) -> DataFrame:
    """Rows whose key is not greater than that of the line before them in the same shard.

    Each row meets its predecessor by (shard, line), a unique key, so a large shard is not one task.
    """
    before = rows.select(F.col(shard).alias("_s"), (F.col(line) + 1).alias("_l"), F.col(key).alias("previous_key"))
    joined = rows.join(before, (F.col(shard) == F.col("_s")) & (F.col(line) == F.col("_l")))
    return joined.filter(F.col(key) <= F.col("previous_key")).drop("_s", "_l")


def _line_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: SHA-256 and record count of files whose lines come in order."""
    name, size, state, seen, lines = None, 0, None, 0, 0

    def done() -> pa.RecordBatch:
        nonlocal lines
        if seen == size - 1:  # the file ends with a line break
            state.update(b"\n")
        elif seen != size:
            raise ValueError(f"{name}: {seen} of {size} bytes were read")
        return pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "sha256": [state.hexdigest()], "records": [lines]}, _DIGEST)

    for batch in batches:
        for file, length, value in zip(*(batch.column(c) for c in ("file", "bytes", "value"))):
            if file.as_py() != name:
                if name is not None:
                    yield done()
                name, size, state, seen, lines = file.as_py(), length.as_py(), hashlib.sha256(), 0, 0
            if lines:
                state.update(b"\n")
                seen += 1
            piece = value.as_buffer()
            state.update(piece)
            seen, lines = seen + piece.size, lines + 1
    if name is not None:
        yield done()


def _base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_digests(spark: SparkSession, path: str, max_bytes: int | None = None, whole_bytes: int = WHOLE_BYTES, name: Callable[[Column], Column] = _base_name) -> DataFrame:
    """(file, bytes, sha256, records) of all files; records are lines, an unfinished last one included.

    ``name`` derives the name of a file from its path. Beyond a bound that the caller gives, files are
    listed without reading them.

    A file of up to ``whole_bytes`` is hashed as one cell where it is read. The lines of a larger one are
    read in blocks like any text, dealt by file and sorted there (on disk, if need be), and one task
    hashes them as a stream. So content never meets the driver, nor one task more than a line of it.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= (whole_bytes if max_bytes is None else min(max_bytes, whole_bytes)))
    body = F.col("content").cast("string")
    breaks = F.length("content") - F.octet_length(F.replace(body, F.lit("\n")))
    open_line = ((F.length("content") > 0) & (F.substring(F.hex(F.expr("substring(content, -1, 1)")), 1, 2) != "0A")).cast("long")
    small = small.select(name(F.col("path")).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), (breaks + open_line).alias("records"))
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).filter(meta["file_size"] > whole_bytes).select(
        name(F.url_decode(F.replace(meta["file_path"], F.lit("+"), F.lit("%2B")))).alias("file"), meta["file_size"].alias("bytes"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value")
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    large = lines.filter(F.lit(max_bytes is None) | (F.col("bytes") <= F.lit(max_bytes))).repartition(tasks, "file").sortWithinPartitions("file", "block", "at").mapInArrow(_line_digests, "file string, bytes long, sha256 string, records long")
    found = small.unionByName(large)
    if max_bytes is None:
        return found
    refused = files.filter(F.col("length") > max_bytes).select(name(F.col("path")).alias("file"), F.col("length").alias("bytes"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("long").alias("records"))
    return found.unionByName(refused)


def manifest_violations(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, problem) where files and manifest (file, bytes, sha256, records) disagree."""
    both = found.join(manifest.select("file", F.col("bytes").alias("_b"), F.col("sha256").alias("_s"), F.col("records").alias("_r")), "file", "full")
    problem = (
        F.when(F.col("_b").isNull(), "not-listed").when(F.col("bytes").isNull(), "missing")
        .when(F.col("sha256").isNull(), "too-large").when(F.col("bytes") != F.col("_b"), "size").when(F.col("sha256") != F.col("_s"), "digest").when(F.col("records") != F.col("_r"), "records")
    )
    return both.withColumn("problem", problem).filter("problem is not null").select("file", "problem")


def csv_safe(rows: DataFrame) -> DataFrame:
    """Every text column made safe for spreadsheets, ready for ``write.csv``."""
    return rows.select(*(text.csv_safe(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in rows.dtypes))
