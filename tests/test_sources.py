import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from larder.operators import catalog
from larder.plans import evidence, evidence_views  # noqa: F401
from larder.plans.inputs import AS_OF, Inputs
from larder.schemas import SHARD_COLUMNS
from larder.sources import jsonl, shards
from larder.streaming.ingest import ingest

SF = "/root/testdata/sf0.001"


def test_lines_are_numbered_per_file(spark, tmp_path):
    for name, n in (("a", 50), ("b", 3)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(f"{name}{i}" for i in range(n)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        got = jsonl.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 53 and all(r.value == r.file[-7] + str(r.line) for r in got)


def test_line_outcomes(spark):
    lines = ['{"a":1}', '{"a":1} x', "{} {}", "[1]", '"x"', "{'a':1}", "  ", '{"a":NaN}', "x" * 99, '{"a":'] 
    df = spark.createDataFrame([(v,) for v in lines], "value string").select(jsonl.line_outcome(F.col("value"), 60).alias("o"))
    assert [r.o for r in df.collect()] == ["accepted"] + ["malformed"] * 5 + ["blank", "accepted", "oversized", "malformed"]


def test_lines_past_the_contract_are_oversized(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n' + "x" * (4 * 1024 * 1024 + 1) + '\n{"a":"' + "y" * (4 * 1024 * 1024 - 8) + '"}\n')
    lines = jsonl.read_lines(spark, str(tmp_path))
    assert {r.line: r.o for r in lines.select("line", jsonl.line_outcome(F.col("value")).alias("o")).collect()} == {0: "accepted", 1: "oversized", 2: "accepted"}
    assert [r.reason for r in jsonl.lint(lines.select("line", "value")).orderBy("line").collect()] == ["", "oversized", "string-length"]


def test_lint_names_the_reason(spark):
    deep = "[" * 40 + "]" * 40
    cases = {'{"a":1}': "", '{"a":1,"a":2}': "duplicate-key", '{"a":NaN}': "non-finite", "[1]": "not-object", "{": "syntax",
             '{"a":"\\u0007"}': "control-character", f'{{"a":{deep}}}': "depth", '{"a":1e999}': "non-finite"}
    df = spark.createDataFrame(list(enumerate(cases)), "line bigint, value string")
    assert {r.line: r.reason for r in jsonl.lint(df).collect()} == dict(enumerate(cases.values()))


def test_gzip_shard_reads_like_plain(spark, tmp_path):
    row = ",".join(f'"{c}, x"' if c == "product_name" else c for c in SHARD_COLUMNS)
    body = ",".join(SHARD_COLUMNS) + "\n" + row + "\n"
    (tmp_path / "a.csv").write_text(body)
    with gzip.open(tmp_path / "b.csv.gz", "wt") as out:
        out.write(body)
    got = shards.read_shards(spark, str(tmp_path)).drop("file").collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].product_name == "product_name, x"


def test_manifest_digest_and_size(spark, tmp_path):
    (tmp_path / "a").write_text("one")
    (tmp_path / "b").write_text("two" * 50)
    found = shards.file_digests(spark, str(tmp_path), max_bytes=100)
    manifest = spark.createDataFrame([("a", 3, hashlib.sha256(b"one").hexdigest(), 1), ("b", 150, "x", 1), ("c", 1, "x", 1)], "file string, bytes bigint, sha256 string, records bigint")
    assert {(r.file, r.problem) for r in shards.manifest_violations(found, manifest).collect()} == {("b", "too-large"), ("c", "missing")}


def test_digests_of_large_files_are_streamed_in_tasks(spark, tmp_path):
    bodies = {"lines": b"ab\n" * 5000, "open": b"x\n" * 3000 + b"end", "binary": bytes(range(256)) * 40, "breaks": b"\n" * 9, "one": b"\xff\xfe\x00" * 3000, "end": b"\n" + b"y" * 4000 + b"\r\n"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    want = {n: (len(b), hashlib.sha256(b).hexdigest(), b.count(b"\n") + (b != b"" and not b.endswith(b"\n"))) for n, b in bodies.items()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for bound in (4, 3000, 1 << 20):
            assert {r.file: tuple(r)[1:] for r in shards.file_digests(spark, str(tmp_path), whole_bytes=bound).collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quoted_line_breaks_across_blocks(spark, tmp_path):
    import csv
    import io
    import random

    rng = random.Random(8)
    for name in "abc":
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator="\r\n" if name == "b" else "\n", quoting=csv.QUOTE_MINIMAL)
        writer.writerow(SHARD_COLUMNS)
        for r in range(40):
            writer.writerow([rng.choice(["", "plain", 'say "hi"', "two\nlines", "a,b", '"\n\n"', "long " * 60 + "\nend", '""', "x\r\ny"]) for _ in SHARD_COLUMNS])
        (tmp_path / f"{name}.csv").write_text(out.getvalue(), newline="")
    want = sorted((f, i, *row) for f in "abc" for i, row in enumerate(csv.reader(open(tmp_path / f"{f}.csv", newline=""))) if i)
    for size in ("97", "5000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = sorted((r.file[-5], r.record, *tuple(r)[2:]) for r in shards.read_shards(spark, str(tmp_path)).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == want


@pytest.mark.parametrize("body", ["wrong,header\n1,2\n", ",".join(SHARD_COLUMNS) + "\nonly,three,cells\n"])
def test_files_that_are_no_shards_end_the_read(spark, tmp_path, body):
    (tmp_path / "x.csv").write_text(body)
    with pytest.raises(Exception, match="x.csv"):
        shards.read_shards(spark, str(tmp_path)).collect()


def test_csv_bounds_hold_for_fields_of_any_length(spark):
    long = "y" * 1_000_001
    cases = [f'a,"{long}",b', f"a,{long},b", f'a,"{long[:-1]}",b', 'a,"' + 'q""' * 200_000 + '",c', f'a,"{long}', "a,b\x07"]
    lines = spark.createDataFrame(list(enumerate(cases)), "line bigint, value string")
    got = {(r.line, r.rule) for r in shards.csv_violations(lines).collect()}
    assert got == {(0, "field-length"), (1, "field-length"), (4, "field-length"), (4, "quotes"), (5, "control-character")}
    records = spark.createDataFrame([("f", "ab")] * 5 + [("g", "abcdefghij")], "file string, value string")
    assert {(r.file, r.rule) for r in shards.file_violations(records, 14, 4).collect()} == {("f", "file-bytes"), ("f", "file-rows")}


def test_stream_is_idempotent_on_redelivery(spark, tmp_path):
    landing, table, progress = (str(tmp_path / n) for n in ("landing", "table", "progress"))
    (tmp_path / "landing").mkdir()
    record = lambda n, name: json.dumps({"code": n, "_id": n, "schema_version": "1004", "countries_tags": ["en:germany"], "product_name": name})
    (tmp_path / "landing" / "1.jsonl").write_text(record("4006381333931", "a") + "\nnot json\n")
    ingest(spark, landing, table, progress)
    (tmp_path / "landing" / "2.jsonl").write_text(record("4006381333931", "a") + "\n")
    ingest(spark, landing, table, progress)
    (tmp_path / "landing" / "3.jsonl").write_text(record("4006381333931", "renamed") + "\n")
    ingest(spark, landing, table, progress)
    assert sorted(r.name for r in spark.read.parquet(table).collect()) == ["a", "renamed"]


def test_a_batch_reads_no_earlier_one(spark, tmp_path):
    import shutil

    landing, table, progress = (str(tmp_path / n) for n in ("landing", "table", "progress"))
    (tmp_path / "landing").mkdir()
    record = lambda n, name: json.dumps({"code": n, "_id": n, "schema_version": "1004", "countries_tags": ["en:germany"], "product_name": name})
    for delivery in range(3):
        (tmp_path / "landing" / f"{delivery}.jsonl").write_text(record("4006381333931", "a") + "\n" + record("4006381333931", f"new {delivery}") + "\n")
        ingest(spark, landing, table, progress)
        got = sorted(r.name for r in spark.read.parquet(f"{table}/batch={delivery}").collect())
        assert got == (["a"] if not delivery else []) + [f"new {delivery}"]
        shutil.rmtree(table)  # what was written is not needed any more


def test_positions_in_one_large_parent_spread_over_tasks(spark):
    from larder.functions.ranking import dealt_by_ranges
    from larder.operators.evidence import child_positions

    rows = spark.range(4000).select(F.concat(F.lit("ev:retailer:sha256:"), F.sha2(F.col("id").cast("string"), 256)).alias("id"), F.lit("0001").alias("gtin"), F.lit("DE").alias("market"))
    rows = rows.union(spark.createDataFrame([("a", "0002", "DE"), ("b", "0002", "DE")], "id string, gtin string, market string"))
    parts = dealt_by_ranges(rows, ["gtin", "market"], ["id"]).groupBy("_part").count().collect()
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 2000
    got = {(r.gtin, r.id): r.position for r in child_positions(rows, ["gtin", "market"]).collect()}
    ordered = sorted(got)
    assert [got[k] for k in ordered] == [*range(4000), 0, 1]


def test_catalog_tables_write_partitioned_by_market(spark, tmp_path):
    i = Inputs(spark, SF)
    from larder.plans import catalog_queries  # noqa: F401

    tables = catalog.catalog_tables(evidence.Envelope(i), i.view("exclusion"), AS_OF)
    subset = {n: tables[n] for n in ("sources", "products", "basic_exclusions")}
    catalog.write_catalog(subset, str(tmp_path))
    for name, df in subset.items():
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == df.count()
    assert sorted(p.name for p in (tmp_path / "products").iterdir() if p.is_dir()) == ["market=AT", "market=DE"]
