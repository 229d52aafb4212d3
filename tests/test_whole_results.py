"""Results that caps, prefixes and hash heads once cut or misplaced."""

import hashlib

import pytest
from pyspark.sql import functions as F

from larder.functions import ids
from larder.operators import evidence, matching, prices, producers, refresh, search
from larder.sources import shards

QUEUE = "key string, reason string, priority string, market string, gtin string, evidence_id string"


def test_queue_of_more_than_five_thousand_entries_stays_whole(spark):
    n = 5_700
    reason = refresh.TARGET_REASONS[0]
    queue = spark.range(n).select(
        F.concat(F.lit("k"), "id").alias("key"), F.lit(reason).alias("reason"), F.lit("high").alias("priority"), F.lit("DE").alias("market"),
        F.lpad(F.col("id").cast("string"), 14, "0").alias("gtin"), F.lit(None).cast("string").alias("evidence_id"),
    )
    later = spark.createDataFrame([("k1", reason, "low", "DE", "00000000000001", "new")], QUEUE)
    merged = refresh.merge_queues(queue, later)
    assert merged.count() == n and merged.filter("evidence_id = 'new'").count() == 1
    batches = refresh.target_batches(queue).collect()
    assert sorted(g for b in batches for g in b.gtins) == [f"{i:014d}" for i in range(n)]
    assert {b.batch: len(b.gtins) for b in batches} == {i: min(refresh.BATCH, n - i * refresh.BATCH) for i in range(-(-n // refresh.BATCH))}
    assert sum(len(b.gtins) for b in refresh.target_batches(queue, limit=50).collect()) == 50


def test_positions_follow_ids_of_any_form(spark):
    names = ["a:zz1", "b:aa1", "img-10", "img-2", "crt-x", "", "a:zz"]
    children = spark.createDataFrame([("p", n) for n in names], "parent string, id string")
    got = {r.id: r.position for r in evidence.child_positions(children, ["parent"]).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}


def test_an_excuse_counts_inside_a_word_and_over_itself(spark):
    texts = spark.createDataFrame([("1", "nonalcohol free drink", "en"), ("2", "alcohol drink", "en"), ("3", "aaab", "en")], "doc_id string, text string, language string")
    aliases = spark.createDataFrame(
        [("a", "r", "o", "q", "c", "en", "free", "token"), ("b", "r2", "o", "q", "c", "en", "alcohol", "token"), ("d", "r3", "o", "q", "c", "en", "aaab", "token")],
        "alias_id string, rule_id string, outcome string, queue string, reason_code string, language string, alias string, match string",
    )
    contexts = spark.createDataFrame([("x", "r", "en", "alcohol free"), ("y", "r3", "en", "aab")], "alias_id string, rule_id string, language string, alias string")
    found = matching.rule_findings(texts, aliases, contexts)
    assert [(r.doc_id, r.rule_id) for r in found.collect()] == [("2", "r2")]


def test_a_quoted_field_is_measured_whole(spark):
    long_field = '"' + "ab,c" * 30 + '"'
    lines = spark.createDataFrame([(1, f"x,{long_field},y"), (2, 'x,"a""b",y'), (3, ",,")], "line long, value string")
    got = shards.csv_violations(lines, max_columns=3, max_field=100).collect()
    assert [(r.line, r.rule) for r in got] == [(1, "field-length")]


def test_long_queries_and_long_words_are_searched_whole(spark):
    word = "w" * 70
    products = spark.createDataFrame([("1", f"one two three four five six seven eight nine {word}a", "b"), ("2", f"one two three four five six seven eight ten {word}b", "b")], "gtin string, name string, brand string")
    queries = spark.createDataFrame([("q", f"one two three four five six seven eight nine {word}a", 9, 0)], "query_id string, query string, limit int, offset int")
    page = search.text_search(queries, products, search.postings(products))
    assert [r.gtin for r in page.collect()] == ["1"]


def test_all_manufacturer_sources_are_kept(spark):
    source = "struct(cast(id as string) as id, 'n' as name, '1' as manufacturer, array('ingredients_text') as fields, cast(null as bigint) as import_t, 'l' as source_licence, 'https://h/x' as source_licence_url)"
    raw = spark.sql(f"select 'r' as source_record_id, 'o' as owner, map('ingredients_text', 't') as owner_fields, (select collect_list({source}) from range(40)) as sources, transform(sequence(1, 50), i -> concat('tag', i)) as data_sources_tags")
    row = producers.sanitize(raw).first()
    assert len(row.manufacturer_sources) == 40 and len(row.data_source_tags) == 50


def test_control_characters_of_canonical_json(spark):
    text = "".join(map(chr, (0x01, 0x0B, 0x0E, 0x0F, 0x1A, 0x1F))) + "\\u001F \\\\\x1c"
    got = spark.createDataFrame([(text,)], "t string").select(ids.canonical_json({"t": F.col("t")})).first()[0]
    import json

    assert got == json.dumps({"t": text}, separators=(",", ":"), ensure_ascii=False)


@pytest.mark.parametrize("discounts, fates", [((False, True), ["dropped-by-conflict", "conflict"]), ((True, True), ["included", "duplicate"])])
def test_prices_of_one_id_that_differ_in_any_field_are_a_conflict(spark, discounts, fates):
    locations = spark.sql("select 3L as id, 1L as line, 'Shop' as osm_name, 'Brand' as osm_brand, 'tag' as osm_tag_value, 'Bonn' as osm_address_city, '53111' as osm_address_postcode, 'DE' as osm_address_country_code")
    proofs = spark.sql("select 5L as id, 1L as line, 3L as location_id, 'RECEIPT' as type, '2001-02-03' as date, 'EUR' as currency")
    aliases = spark.sql("select 'shop' as retailer_key, 'stable' as class, 'brand' as alias")
    price = "'4006381333931' as product_code, 3L as location_id, 5L as proof_id, '2001-02-03' as date, 'EUR' as currency, 1.5D as price, cast(null as string) as price_per, cast(null as double) as receipt_quantity, 'PRODUCT' as type"
    rows = " union all ".join(f"select 7L as id, {line}L as line, {price}, {str(d).lower()} as price_is_discounted" for line, d in enumerate(discounts, 1))
    joined = prices.join_prices(spark.sql(rows), prices.drop_conflicting_ids(locations), prices.drop_conflicting_ids(proofs), aliases, "2001-11-05T00:00:00Z")
    got = prices.resolve_price_ids(joined).orderBy("line").collect()
    assert [r.fate for r in got] == fates


def test_files_over_64_mib_have_a_digest(spark, tmp_path):
    content = bytes(range(256)) * (1 << 18) + b"end"
    (tmp_path / "large file").write_bytes(content)
    (tmp_path / "small").write_bytes(b"abc")
    found = {r.file: (r.bytes, r.sha256) for r in shards.file_digests(spark, str(tmp_path)).collect()}
    assert found == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in (("large file", content), ("small", b"abc"))}


def test_review_list_ends_where_its_sql_does(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["mandatory_review"](spark, "/root/testdata/sf0.1").collect()
    keys = [(r.gtin, r.market) for r in rows]
    assert len(rows) == 1000 and keys == sorted(keys) and {r.truncated for r in rows} == {True}
    assert {r.total for r in rows}.pop() > 1000


@pytest.mark.parametrize("name", ["project_products", "sample_snapshot"])
def test_plans_hold_one_copy_of_a_large_literal(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert sum(line.count("x" * 4_000_000) for line in plan.toString().splitlines()) <= 1


def test_requests_for_the_same_digits_are_ranked_once(spark, monkeypatch):
    ranked, cut = [], search.cut_pages
    monkeypatch.setattr(search, "cut_pages", lambda rows, *a: ranked.append(rows.count()) or cut(rows, *a))
    gtin = F.lpad(F.col("id").cast("string"), 14, "0")
    products = spark.range(100).select(gtin.alias("gtin"), F.lit("p").alias("name"))
    requests = spark.range(50).select(F.concat(F.lit("q"), "id").alias("query_id"), F.lit("0000").alias("prefix"), F.lit(3).alias("limit"), (F.col("id") % 2).cast("int").alias("offset"))
    got = search.barcode_search(requests, products.select("gtin", F.col("gtin").alias("alias")), products).collect()
    assert ranked == [100]
    assert sorted((r.query_id, r.gtin, r.rank) for r in got) == sorted((f"q{q}", f"{q % 2 + n:014d}", q % 2 + n + 1) for q in range(50) for n in range(3))
    assert {r.has_more for r in got} == {True}
