"""What a job stores and computes follows what is read of it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larder.operators import prices
from larder.plans.registry import QUERIES
from larder.session import durable


def test_stored_rows_are_compressed_columns(spark):
    rows = durable(spark.range(1000).select("id", F.lit("x" * 500).alias("text")))
    assert all(f.endswith(".zstd.parquet") for f in rows.inputFiles())
    assert rows.count() == 1000


def test_prices_store_only_what_is_read(spark):
    joined = spark.sql(
        """select id, line, reject, named_struct('high', high, 'low', low) as price_payload, 'wide' as alias from values
        (1L, 1L, null, 5L, 5L), (1L, 4L, null, 5L, 6L), (1L, 2L, null, 5L, 7L), (1L, 9L, 'non-product', 5L, 5L),
        (2L, 3L, null, 5L, 5L), (2L, 2L, null, 5L, 5L), (2L, 1L, 'non-product', 6L, 5L), (3L, 1L, null, 5L, 5L) as t(id, line, reject, high, low)"""
    )
    found = prices.resolve_price_ids(joined, [])
    assert "alias" not in found.columns
    assert {(r.id, r.line): r.fate for r in found.collect()} == {
        (1, 1): "dropped-by-conflict", (1, 2): "conflict", (1, 4): "conflict-repeat", (1, 9): "conflict-repeat",
        (2, 1): "non-product", (2, 2): "included", (2, 3): "duplicate", (3, 1): "included",
    }
    assert prices.resolve_price_ids(joined).filter("fate = 'included'").select("alias").distinct().count() == 1


def test_catalog_tables_are_built_when_read(spark, monkeypatch):
    from larder.operators import catalog
    from larder.plans.catalog_queries import tables
    from larder.plans.inputs import Inputs

    numbered = []
    by_ranges = catalog.ordinal_by_ranges
    monkeypatch.setattr(catalog, "ordinal_by_ranges", lambda *a: numbered.append(a[1]) or by_ranges(*a))
    t = tables(Inputs(spark, "/root/testdata/sf0.001"))
    counts = {r.key: int(r.value) for r in catalog.manifest(t).filter("metric = 'count'").collect()}
    catalog.integrity(t)
    assert not numbered and len(counts) == len(t) == 9
    assert t["retailer_evidence"].count() == counts["retailer_evidence"] > 0 and "position" in t["retailer_evidence"].columns
    assert len(numbered) == 1


def test_candidates_are_built_once(spark, monkeypatch):
    """Several outputs of one run, two policies and three rankings read stored rows, not the raw products again."""
    from larder.plans import selections

    calls, build = [], selections.candidates
    monkeypatch.setattr(selections, "candidates", lambda i: calls.append(i) or build(i))
    for name in ("decision_changes", "top_values", "selection_outputs"):
        calls.clear()
        out = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(calls) == 1 and not any(f.endswith("part.parquet") for f in out.inputFiles()), name


def test_serving_projection_stores_what_it_reads_twice(spark, monkeypatch):
    """Counts, products and sources read stored rows: the children's join, the largest, is made once."""
    from larder.operators import evidence
    from larder.plans.evidence import Envelope
    from larder.plans.inputs import Inputs

    stored, store = [], evidence.durable
    monkeypatch.setattr(evidence, "durable", lambda df: stored.append(df.columns) or store(df))
    products, _, used = evidence.serving_projection(Envelope(Inputs(spark, "/root/testdata/sf0.001")))
    assert stored[0] == ["selection_id", "kind", "source_key"] and "certifications" in stored[1] and len(stored) == 2
    assert not any(f.endswith("lineitem.parquet") for df in (products, used) for f in df.inputFiles())


def test_sizes_of_files_do_not_decide_on_copies(spark, tmp_path):
    """A column of few values is small as a file and large as rows: it is not the copied side of a join until AQE has measured it."""
    from larder.session import COPIED_MEASURED, COPIED_UNREAD, tune

    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in keys]
    try:
        spark.conf.set(keys[0], "10MB")
        spark.conf.unset(keys[1])
        wide = ", ".join(f"'{'x' * 60}' as c{n}" for n in range(40))
        spark.sql(f"select id, {wide} from range(400000)").write.parquet(f"{tmp_path}/few")
        rows = tune(spark).read.parquet(f"{tmp_path}/few")
        joined = spark.range(10_000_000).join(rows, "id")
        size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        assert COPIED_UNREAD < size < 10 << 20
        assert "Broadcast" not in joined._jdf.queryExecution().sparkPlan().toString()
        assert [int(spark.conf.get(k)) for k in keys] == [COPIED_UNREAD, COPIED_MEASURED]
        for own in ("65536", "-1"):  # a session that asks for less keeps it
            spark.conf.set(keys[0], own)
            assert tune(spark).conf.get(keys[0]) == own
    finally:
        for k, v in zip(keys, before):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_observations_store_accepted_prices_alone(spark, monkeypatch):
    """Each check drops its rows before the next join; what is left equals the accepted rows of the whole join."""
    from larder.plans.inputs import Inputs
    from larder.plans.price_queries import joined

    i, read = Inputs(spark, "/root/testdata/sf0.001"), ["gtin", "retailer_key", "osm_address_city", "country", "proof_type", "location_id", "proof_id", "price"]
    columns = ["id", "line", "price_payload", "reject", *read]
    every = joined(i).filter("reject is null").select(*columns)
    assert sorted(map(str, joined(i, read).select(*columns).collect())) == sorted(map(str, every.collect()))
    stored, store = [], prices.durable
    monkeypatch.setattr(prices, "durable", lambda df: stored.append(store(df)) or stored[-1])
    QUERIES["retailer_observations"](spark, "/root/testdata/sf0.001")
    assert [df.count() for df in stored if "price_payload" in df.columns] == [every.count()]


@pytest.mark.parametrize("name, hinted", [("submission_to_evidence", 0), ("logical_projection", 0), ("product_detail_children", 0), ("methodology_totals", 1), ("stale_analysis", 2)])
def test_unread_sizes_make_no_copies(spark, monkeypatch, name, hinted):
    """With the bound for sizes of files at nothing, no join of the query is planned with a copied side but those of the rules; before, 10 MB of file were copied."""
    import __spark_entry__  # noqa: F401  (registers the queries)
    from larder import session
    from larder.plans import review_queries

    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in keys]
    try:
        spark.conf.set(keys[0], "10MB")
        monkeypatch.setattr(session, "COPIED_UNREAD", 0)
        monkeypatch.setattr(review_queries, "durable", lambda df: df)  # so that the plan shows the report, on both sides of the comparison
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
        assert "Join" in plan and plan.count("BroadcastHashJoin") == hinted
    finally:
        for k, v in zip(keys, before):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
