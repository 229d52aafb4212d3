"""JSON-lines scans with bounds, and their audit."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import text
from larder.functions.ranking import ordinal_in_group
from larder.operators.normalize import canonical_tags, market
from larder.schemas import LOCALIZED_PREFIXES, RAW_PRODUCT

MAX_LINE_BYTES = 4 * 1024 * 1024
MAX_DEPTH, MAX_NODES = 32, 100_000
MAX_STRING, MAX_ITEMS = 1_000_000, 1_000_000
CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines numbered from 0 within their file.

    The block offset and the order inside a block give each line its place; blocks are counted and
    numbered apart, so a file of any size is read by many tasks.
    """
    meta = F.col("_metadata")
    raw = spark.read.text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("_start"), F.monotonically_increasing_id().alias("_at"), "value"
    )
    return ordinal_in_group(raw, ["file"], F.col("_start"), ["_at"], "line").select("file", "line", "value")


def line_outcome(value: Column, max_bytes: int = MAX_LINE_BYTES) -> Column:
    """blank, oversized, malformed or accepted: exactly one JSON object per line."""
    one = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<map<string,string>>", {"allowSingleQuotes": "false"})
    is_object = (F.size(one) == 1) & value.rlike(r"\A\s*\{") & one[0].isNotNull()
    return (
        F.when(F.octet_length(value) > max_bytes, "oversized").when(~text.has_text(value), "blank")
        .when(F.coalesce(is_object, F.lit(False)), "accepted").otherwise("malformed")
    )


def products(accepted: DataFrame) -> DataFrame:
    """Typed raw product columns plus the map of language-suffixed keys."""
    every = F.from_json("value", "map<string,string>")
    wanted = lambda k, _: F.lit(False) | k.rlike("^(?:" + "|".join(LOCALIZED_PREFIXES) + ")")
    parsed = accepted.select("line", F.from_json("value", RAW_PRODUCT).alias("r"), F.map_filter(every, wanted).alias("localized"))
    rows = parsed.select("line", "r.*", "localized")
    return rows.withColumn("source_record_id", F.coalesce(F.nullif("_id", F.lit("")), F.nullif("code", F.lit("")))).drop("_id")


def scan_metrics(outcomes: DataFrame, typed: DataFrame, target: str, schema_version: str) -> DataFrame:
    """(metric, key, n): line outcomes, schema versions, and why accepted records were not emitted."""
    c = F.col
    countries = canonical_tags("countries", c("countries_tags"), c("tags_sources"))
    off_market = market(countries) != target
    unsupported = ~F.coalesce(c("schema_version") == schema_version, F.lit(False))
    fate = F.when(off_market, "wrong-market").when(unsupported, "unsupported-schema").otherwise("emitted")
    cell = lambda metric, key: F.struct(F.lit(metric).alias("metric"), key.alias("key"))
    rows = outcomes.select(cell("line", c("outcome")).alias("m")).unionByName(
        typed.select(F.explode(F.array(cell("schema", F.coalesce("schema_version", F.lit("missing"))), cell("record", fate))).alias("m"))
    )
    return rows.groupBy("m.metric", "m.key").agg(F.count("*").alias("n"))


def malformed_rate(metrics: DataFrame, limit: float) -> DataFrame:
    """Malformed lines (oversized ones included) over all lines judged, and whether the scan may be used."""
    pick = lambda *keys: F.sum(F.when((F.col("metric") == "line") & F.col("key").isin(*keys), F.col("n")).otherwise(0))
    sums = metrics.agg(pick("accepted").alias("examined"), pick("malformed", "oversized").alias("malformed"))
    rate = F.coalesce(F.try_divide("malformed", F.col("examined") + F.col("malformed")), F.lit(0.0))
    return sums.withColumn("rate", F.bround(rate, 6)).withColumn("usable", rate <= limit)


def project(typed: DataFrame, target: str, schema_version: str) -> DataFrame:
    """Records of the target market on the supported schema; column pruning is Catalyst's."""
    countries = canonical_tags("countries", F.col("countries_tags"), F.col("tags_sources"))
    return typed.filter((F.col("schema_version") == schema_version) & (market(countries) == target))


def sample(rows: DataFrame, n: int) -> DataFrame:
    """First ``n`` accepted rows in file order, marked incomplete: a sample may add but never delete."""
    return rows.orderBy("line").limit(n).withColumn("complete", F.lit(False))


def _problem(raw: bytes, max_bytes: int, max_string: int, max_items: int, max_nodes: int) -> str:
    """Why a line is not strict JSON within bounds; empty when it is."""
    if len(raw) > max_bytes:
        return "oversized"
    try:
        line = raw.decode("utf-8")
    except UnicodeDecodeError:
        return "encoding"

    def unique(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("duplicate-key")
        return dict(pairs)

    def constant(_: str) -> None:
        raise ValueError("non-finite")

    try:
        value = json.loads(line, object_pairs_hook=unique, parse_constant=constant)
    except RecursionError:
        return "depth"
    except json.JSONDecodeError:
        return "syntax"
    except ValueError as error:
        return str(error)
    if not isinstance(value, dict):
        return "not-object"
    layer, nodes = [value], 0
    for depth in range(MAX_DEPTH + 2):
        nodes += len(layer)
        if nodes > max_nodes:
            return "nodes"
        if layer and depth > MAX_DEPTH:
            return "depth"
        below: list = []
        for item in layer:
            if isinstance(item, str) and len(item) > max_string:
                return "string-length"
            if isinstance(item, str) and CONTROL.search(item):
                return "control-character"
            if isinstance(item, dict | list) and len(item) > max_items:
                return "collection-size"
            if isinstance(item, float) and not math.isfinite(item):
                return "non-finite"
            if isinstance(item, dict):
                below += [*item.keys(), *item.values()]
            elif isinstance(item, list):
                below += item
        layer = below
    return ""


def lint(lines: DataFrame, max_bytes: int = MAX_LINE_BYTES, max_string: int = MAX_STRING, max_items: int = MAX_ITEMS, max_nodes: int = MAX_NODES) -> DataFrame:
    """The columns of ``lines`` but for ``value``, and ``reason``, per non-blank line; the reason is empty for strict JSON objects.

    Values may be text or bytes: bytes that are no UTF-8 are found, too. A line past ``max_bytes`` is
    named without being parsed.
    """
    kept = [c for c in lines.columns if c != "value"]
    body = F.col("value").cast("string")

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = [_problem(v.as_buffer().to_pybytes(), max_bytes, max_string, max_items, max_nodes) for v in batch.column("value")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(reasons, pa.string())], [*kept, "reason"])

    types = dict(lines.dtypes)
    rows = lines.filter(text.has_text(body)).select(*kept, F.when(F.octet_length("value") > max_bytes, F.substring(F.col("value").cast("binary"), 1, F.lit(max_bytes + 1))).otherwise(F.col("value").cast("binary")).alias("value"))
    return rows.mapInArrow(audit, ", ".join([*(f"`{c}` {types[c]}" for c in kept), "reason string"]))


def lint_rates(audited: DataFrame, export: str, limit: float) -> DataFrame:
    """(export, lines, malformed, usable): whether each export's share of malformed lines stays within ``limit``."""
    counts = audited.groupBy(F.col(export).alias("export")).agg(F.count("*").alias("lines"), F.count_if(F.col("reason") != "").alias("malformed"))
    return counts.withColumn("usable", F.col("malformed") <= F.lit(limit) * F.col("lines"))
