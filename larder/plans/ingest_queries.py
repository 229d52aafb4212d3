"""Demo queries: scans, audits, shards, streaming, reference data."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import barcodes
from larder.functions.stage import once
from larder.operators import matching as M
from larder.operators import reference as R
from larder.operators.evidence import union_all
from larder.plans import duck
from larder.plans.evidence import ALL, Envelope
from larder.plans.inputs import AS_OF, Inputs, array_of, view
from larder.plans.quality_queries import AT, ts
from larder.plans.registry import query
from larder.policy import SelectionPolicy, SourcePolicy
from larder.schemas import SHARD_COLUMNS
from larder.sources import jsonl, shards
from larder.session import shared_folder
from larder.streaming.ingest import ingest

SOURCE = SourcePolicy()

view("json_line")(
    """
select p_partkey as line, case when p_partkey % 67 = 0 then 'not json' when p_partkey % 71 = 0 then '[1,2]' when p_partkey % 73 = 0 then '   '
  when p_partkey % 79 = 0 then '{{"code":"x"}} tail' when p_partkey = 83 then repeat('x', 4194305) when p_partkey % 83 = 0 then repeat('x', 300) when p_partkey % 89 = 0 then '{{"code":"open"'
  when p_partkey % 97 = 0 then '{{"code":"a","code":"b"}}' when p_partkey % 101 = 0 then '{{"n":NaN}}'
  else concat('{{"code":"', lpad(cast(p_partkey as string), 14, '0'), '","product_name":"', p_name, '","product_name_de":"', p_brand, '"',
    case when p_partkey % 41 = 7 then ',"schema_version":"1003"' when p_partkey % 43 = 9 then '' else ',"schema_version":"1004"' end,
    ',"countries_tags":["', case when p_partkey % 5 = 0 then 'fr:france' else 'en:germany' end, '"],"deep":{{"x":[1,"y"]}}}}') end as value
from {part}
"""
)
_OUTCOME = """
o as (select line, value, case when octet_length(encode(value)) > 4194304 then 'oversized' when trim(value) = '' then 'blank'
   when value like '{"n":NaN}' or value like '{"code":"a","code":"b"}' or (json_valid(value) and json_type(case when json_valid(value) then value end) = 'OBJECT') then 'accepted' else 'malformed' end as outcome from json_line),
j as (select line, value, json_extract_string(v, '$.code') as code, json_extract_string(v, '$.product_name') as product_name, json_extract_string(v, '$.schema_version') as schema_version,
   coalesce(json_extract_string(v, '$.countries_tags[0]'), '') as country from (select line, value, case when json_valid(value) then value else '{}' end as v from o where outcome = 'accepted') x)"""


def scanned(i: Inputs):
    # the view holds a line of 4 MB as a literal: made once, filters on it would each carry a copy
    lines = once(i.view("json_line").withColumnRenamed("value", "_line"), value=F.col("_line")).drop("_line")
    return lines.withColumn("outcome", jsonl.line_outcome(F.col("value")))


def typed(i: Inputs):
    return jsonl.products(scanned(i).filter("outcome = 'accepted'"))


@query("scan_jsonl_bounded", "json_line", f"{_OUTCOME} select line, outcome from o")
def scan_jsonl_bounded(i: Inputs):
    return scanned(i).select("line", "outcome")


_METRICS = f"""{_OUTCOME},
m as (select 'line' as metric, outcome as key, count(*) as n from o group by outcome union all select 'schema', coalesce(schema_version, 'missing'), count(*) from j group by 2
  union all select 'record', case when country <> 'en:germany' then 'wrong-market' when coalesce(schema_version, '') <> '1004' then 'unsupported-schema' else 'emitted' end, count(*) from j group by 2)"""


@query(
    "scan_metrics", "json_line",
    f"""{_METRICS} select metric, key, cast(n as varchar) as value from m
union all select 'malformed-rate', case when r > 0.001 then 'unusable' else 'usable' end, cast(round(r, 6) as varchar) from (
  select sum(case when key in ('malformed', 'oversized') then n else 0 end) / sum(case when key in ('accepted', 'malformed', 'oversized') then n else 0 end) as r from m where metric = 'line') x""",
)
def scan_metrics(i: Inputs):
    m = jsonl.scan_metrics(scanned(i), typed(i), "DE", SOURCE.schema_version)
    rate = jsonl.malformed_rate(m, SOURCE.max_malformed_rate).select(
        F.lit("malformed-rate").alias("metric"), F.when(F.col("usable"), "usable").otherwise("unusable").alias("key"), F.col("rate").cast("string").alias("value")
    )
    return m.select("metric", "key", F.col("n").cast("string").alias("value")).unionByName(rate)


@query("project_products", "json_line", f"{_OUTCOME} select line, code, product_name from j where country = 'en:germany' and schema_version = '1004'")
def project_products(i: Inputs):
    return jsonl.project(typed(i), "DE", SOURCE.schema_version).select("line", "code", "product_name")


@query("sample_snapshot", "json_line", f"{_OUTCOME} select line, code, false as complete from j where country = 'en:germany' and schema_version = '1004' order by line limit 50")
def sample_snapshot(i: Inputs):
    rows = jsonl.project(typed(i), "DE", SOURCE.schema_version).select("line", "code")
    return jsonl.sample(rows, 50)


view("export_json")(
    """
select o_orderkey as line, concat('export-', cast(o_custkey % 4 as string)) as export, o_orderkey % (case when o_custkey % 4 = 0 then 5000 else 40 end) as kind from {orders}
"""
)
# Lines of known kinds: (kind, value, reason). The bounds of the query are 4,000 bytes, 1,000 characters, 300 items and 900 nodes.
_LINT_KINDS = (
    (1, """concat('[', cast(line as string), ']')""", "not-object"), (2, """'{"a":1,"b":{"c":2,"c":3}}'""", "duplicate-key"), (3, """'{"a":NaN}'""", "non-finite"),
    (4, """'{"a":1e999}'""", "non-finite"), (5, """concat('{"a":', repeat('[', 40), repeat(']', 40), '}')""", "depth"), (6, """concat('{"a":"', repeat('x', 1001), '"}')""", "string-length"),
    (7, """concat('{"a":[', repeat('1,', 300), '1]}')""", "collection-size"), (8, """concat('{"a":[', repeat('[1,1],', 298), '1]}')""", "nodes"), (9, """concat('{"a":"', repeat('y', 4000), '"}')""", "oversized"),
    (10, """concat('{"a":', cast(line as string))""", "syntax"), (11, """concat('{"a":"', chr(92), 'u0007"}')""", "control-character"), (12, """'{"a":01}'""", "syntax"), (13, """'{} {}'""", "syntax"),
)
_LINT_BOUNDS = {"max_bytes": 4000, "max_string": 1000, "max_items": 300, "max_nodes": 890}


def lint_lines(i: Inputs):
    value = F.expr("case kind " + " ".join(f"when {kind} then {value}" for kind, value, _ in _LINT_KINDS) + """ else concat('{"a":', cast(line as string), ',"b":[true,null,"', chr(228), '"]}') end""")
    rows = i.view("export_json").withColumn("value", value.cast("binary"))
    # a line that is not UTF-8 has no SQL text
    return rows.withColumn("value", F.when(F.col("kind") == 14, F.concat(F.lit(b'{"a":"'), F.lit(b"\xff"), F.lit(b'"}'))).otherwise(F.col("value")))


_LINT_REASON = "case kind " + " ".join(f"when {kind} then '{reason}'" for kind, _, reason in _LINT_KINDS) + " when 14 then 'encoding' else '' end"


@query("json_lint", "export_json", f"select reason, count(*) as n, min(line) as first_line from (select line, {_LINT_REASON} as reason from export_json) x group by reason")
def json_lint(i: Inputs):
    return jsonl.lint(lint_lines(i), **_LINT_BOUNDS).groupBy("reason").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


@query(
    "json_lint_rates", "export_json",
    f"""select export, count(*) as lines, count(*) filter (where reason <> '') as malformed, count(*) filter (where reason <> '') <= 0.01 * count(*) as usable
from (select export, {_LINT_REASON} as reason from export_json) x group by export""",
)
def json_lint_rates(i: Inputs):
    return jsonl.lint_rates(jsonl.lint(lint_lines(i), **_LINT_BOUNDS), "export", 0.01)


view("csv_line")(
    """
select o_orderkey as line, concat(cast(o_orderkey as string), ',', case when o_orderkey % 11 = 0 then '"a, b"' when o_orderkey % 13 = 0 then repeat('y', 120) else o_orderstatus end, ',',
  case when o_orderkey % 17 = 0 then concat('c', chr(7)) when o_orderkey % 19 = 0 then 'p,q,r' when o_orderkey % 23 = 0 then 'open " quote' else o_orderpriority end) as value
from {orders}
"""
)


@query(
    "csv_lint", "csv_line",
    r"""
q as (select *, regexp_replace(value, '"([^"]|"")*"', 'q', 'g') as quoted from csv_line)
select line, 'control-character' as rule from q where contains(value, chr(7)) union all select line, 'columns' from q where len(string_split(quoted, ',')) > 4
union all select line, 'field-length' from q where list_max(list_transform(string_split(value, ','), lambda f: length(f))) > 100
union all select line, 'quotes' from q where contains(quoted, '"') union all select line, 'line-bytes' from q where octet_length(encode(value)) > 130""",
)
def csv_lint(i: Inputs):
    return shards.csv_violations(i.view("csv_line"), max_columns=4, max_field=100, max_line=130)


_SHARD = {
    "gtin": "case when k % 97 > 4 then lpad(code, 14, '0') else code end", "original_barcode": "case when k % 51 = 0 then ' ' else code end",
    "market": "case when k % 53 = 0 then 'FR' else 'DE' end", "brand": "case when k % 17 = 0 then '' else p_brand end", "product_name": "case when k % 29 = 0 then concat(p_name, chr(10), 'zweite Zeile') else p_name end", "variant": "''",
    "quantity": "case when k % 4 = 0 then '' else concat(cast(p_size as string), ' g') end", "category": "case when k % 3 = 0 then lower(p_type) else '' end",
    "identity_confidence": "case when k % 59 = 0 then 'sure' else 'medium' end", "identity_source_key": "concat('source-', cast(k % 9 as string))",
    "identity_source_record_id": "concat('rec-', cast(k as string))", "identity_retrieved_at": "case when k % 61 = 0 then '2001-01-01' else '2001-02-03T04:05:06Z' end",
    "ingredients_text": "case when k % 2 = 0 then concat(p_type, ', Zucker') else '' end", "ingredients_language": "case when k % 2 = 0 then case when k % 62 = 0 then 'deutsch!' else 'de' end else '' end",
    "allergens_text": "case when k % 62 = 1 then 'milk' when k % 8 = 0 then 'nuts' else '' end", "ingredients_source_key": "case when k % 2 = 0 then concat('source-', cast(k % 8 as string)) else '' end",
    "ingredients_source_record_id": "case when k % 2 = 0 and k % 66 <> 0 then concat('rec-', cast(k as string)) else '' end", "ingredients_retrieved_at": "case when k % 2 = 0 then '2001-02-03T04:05:06Z' else '' end",
    "ingredients_observed_at": "case when k % 10 = 0 then '2001-01-02T00:00:00Z' when k % 74 = 0 then 'bad' else '' end",
    "ingredients_source_url": "case when k % 14 = 0 then concat('https://host', cast(k % 3 as string), '.example.org/p/', cast(k as string)) when k % 82 = 0 then 'http://host0.example.org/' else '' end",
    "retailer_kind": "case k % 5 when 0 then 'retailer-observation' when 1 then 'community-store-report' when 2 then case when k % 35 = 2 then 'rumour' else '' end else '' end",
    "retailer_key": "case when k % 5 < 2 then 'lidl' when k % 45 = 3 then 'ghost' else '' end", "retailer_confidence": "case when k % 5 < 2 then 'low' else '' end",
    "retailer_source_key": "case when k % 5 < 2 then concat('source-', cast(k % 7 as string)) else '' end", "retailer_source_record_id": "case when k % 5 < 2 then 'r' else '' end",
    "retailer_retrieved_at": "case when k % 5 < 2 then '2001-03-03T00:00:00Z' else '' end", "retailer_observed_at": "case when k % 5 = 0 and k % 25 <> 0 then '2001-03-02T00:00:00Z' else '' end",
    "retailer_snapshot_at": "''", "retailer_location_id": "''", "retailer_source_url": "''", "retailer_scope": "''", "retailer_limitations": "case when k % 5 < 2 then 'dated, local only' else '' end",
}
view("shard_cell", "code")(
    "select k as line, " + ", ".join(f"{_SHARD[c]} as {c}" for c in SHARD_COLUMNS) + " from code c join {part} on p_partkey = k"
)
view("shard_csv", "shard_cell")(
    "select line, concat_ws(',', " + ", ".join(f"concat('\"', {c}, '\"')" for c in SHARD_COLUMNS) + ") as value from shard_cell"
)
view("source_host")(
    f"""
select concat('source-', cast(n_nationkey as string)) as source_key, {array_of("case when n_nationkey % 4 <> 3 then concat('host', cast(n_nationkey % 3 as string), '.example.org') end", "'shop.example.org'")} as hosts
from {{nation}}
"""
)


def shard_rows(i: Inputs):
    return shards.parse_lines(i.view("shard_csv"))


@query("read_csv_shards", "shard_cell", f"select line, sha256(concat_ws('|', {', '.join(SHARD_COLUMNS)})) as row_hash from shard_cell")
def read_csv_shards(i: Inputs):
    """The shards are written as files, quoted line breaks and all, and read back."""
    folder = shared_folder(i.spark, "shards")
    i.view("shard_cell").select(*SHARD_COLUMNS).write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    rows = shards.read_shards(i.spark, folder)
    return rows.select(F.substring_index("identity_source_record_id", "-", -1).cast("long").alias("line"), F.sha2(F.concat_ws("|", *SHARD_COLUMNS), 256).alias("row_hash"))


def _jsonobj(pairs: dict[str, str]) -> str:
    items = ", ".join(f"""'"{k}":' || to_json({v})""" for k, v in sorted(pairs.items()))
    return f"'{{' || array_to_string(list_filter([{items}], lambda x: x is not null), ',') || '}}'"


_I = {"gtin": "gtin", "originalBarcode": "original_barcode", "market": "market", "sourceKey": "identity_source_key", "sourceRecordID": "identity_source_record_id", "name": "product_name",
      "retrievedAt": "identity_retrieved_at", "confidence": "identity_confidence", "brand": "nullif(brand, '')", "quantity": "nullif(quantity, '')", "categories": "case when category <> '' then [category] end"}
_G = {"gtin": "gtin", "market": "market", "sourceKey": "ingredients_source_key", "sourceRecordID": "ingredients_source_record_id", "ingredientsText": "ingredients_text", "languageCode": "ingredients_language",
      "retrievedAt": "ingredients_retrieved_at", "captureMethod": "'source-text'", "verificationState": "'unverified'", "observedAt": "nullif(ingredients_observed_at, '')", "allergensText": "nullif(allergens_text, '')", "contentHash": "content_hash"}
_R = {"kind": "retailer_kind", "retailerKey": "retailer_key", "gtin": "gtin", "market": "market", "sourceKey": "retailer_source_key", "sourceRecordID": "retailer_source_record_id", "retrievedAt": "retailer_retrieved_at",
      "confidence": "retailer_confidence", "limitations": "retailer_limitations", "observedAt": "nullif(retailer_observed_at, '')"}


@query(
    "shards_to_evidence", "shard_cell",
    f"""
h as (select *, case when trim(ingredients_text) <> '' then sha256('{{"allergensText":' || coalesce(to_json(nullif(allergens_text, '')), 'null') || ',"ingredientsText":' || to_json(ingredients_text) || ',"tracesText":null}}') end as content_hash from shard_cell),
x as (select *, 'ev:identity:sha256:' || sha256({_jsonobj(_I)}) as iid, case when trim(ingredients_text) <> '' then 'ev:ingredient:sha256:' || sha256({_jsonobj(_G)}) end as gid,
   case when retailer_kind <> '' then 'ev:retailer:sha256:' || sha256({_jsonobj(_R)}) end as rid from h)
select 'identity' as part, iid as id, gtin, product_name as detail from x union all select 'ingredient', gid, gtin, content_hash from x where gid is not null
union all select 'retailer', rid, gtin, retailer_key from x where rid is not null
union all select 'selection', 'ev:selection:sha256:' || sha256({_jsonobj({"gtin": "gtin", "market": "market", "identityObservationID": "iid", "ingredientObservationID": "gid", "retailerEvidenceIDs": "case when rid is null then cast([] as varchar[]) else [rid] end"})}), gtin, gid from x""",
)
def shards_to_evidence(i: Inputs):
    t = shards.to_evidence(shard_rows(i))
    detail = {"identity": "name", "ingredient": "content_hash", "retailer": "retailer_key", "selection": "ingredient_id"}
    return union_all(*(df.select(F.lit(n).alias("part"), "id", "gtin", F.col(detail[n]).alias("detail")) for n, df in t.items()))


_URL = """ingredients_source_url <> '' and (not regexp_matches(ingredients_source_url, '^https://[^/?#@]+') or not coalesce(list_contains(gh.hosts, regexp_extract(ingredients_source_url, '^https://([^/?#:]+)', 1)), false))"""
_META_I = "concat(ingredients_language, allergens_text, ingredients_source_key, ingredients_source_record_id, ingredients_retrieved_at, ingredients_observed_at, ingredients_source_url) <> ''"
_META_R = "concat(retailer_key, retailer_confidence, retailer_source_key, retailer_source_record_id, retailer_retrieved_at, retailer_observed_at, retailer_limitations) <> ''"
_TIME = "(not regexp_matches({c}, 'Z$') or try_cast(replace({c}, 'Z', '') as timestamp) is null)"
_ROW_RULES = {
    "gtin": f"{duck.gtin('gtin')} is null or length(gtin) <> 14", "market": "market <> 'DE'", "blank:original_barcode": "trim(original_barcode) = ''",
    "identity-confidence": "identity_confidence not in ('low', 'medium', 'high')", "identity-source": "ih.source_key is null", "identity-time": _TIME.format(c="identity_retrieved_at"),
    "ingredients-source": "ht and gh.source_key is null", "ingredients-record": "ht and trim(ingredients_source_record_id) = ''", "ingredients-time": f"ht and {_TIME.format(c='ingredients_retrieved_at')}",
    "ingredients-language": "ht and not regexp_full_match(ingredients_language, '[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*|und')", "ingredients-observed": f"ht and ingredients_observed_at <> '' and {_TIME.format(c='ingredients_observed_at')}",
    "ingredients-url": f"ht and {_URL}", "ingredient-metadata-without-text": f"not ht and {_META_I}", "retailer-kind": "hr and retailer_kind not in ('community-store-report', 'retailer-observation')",
    "blank:retailer_key": "hr and trim(retailer_key) = ''", "retailer-confidence": "hr and retailer_confidence not in ('low', 'medium', 'high')", "retailer-source": "hr and rh.source_key is null",
    "retailer-time": f"hr and {_TIME.format(c='retailer_retrieved_at')}", "retailer-observed-missing": "retailer_kind = 'retailer-observation' and retailer_observed_at = ''",
    "blank:retailer_limitations": "hr and trim(retailer_limitations) = ''", "retailer-metadata-without-kind": f"not hr and {_META_R}",
}


@query(
    "shard_row_violations", "shard_cell source_host",
    """
x as (select c.*, trim(ingredients_text) <> '' as ht, retailer_kind <> '' as hr from shard_cell c)
"""
    + "\nunion all ".join(
        f"select line, '{rule}' as rule from x left join source_host ih on ih.source_key = x.identity_source_key left join source_host gh on gh.source_key = x.ingredients_source_key "
        f"left join source_host rh on rh.source_key = x.retailer_source_key where {cond}"
        for rule, cond in _ROW_RULES.items()
    ),
)
def shard_row_violations(i: Inputs):
    return shards.row_violations(shard_rows(i), i.view("source_host"), "DE")


@query("shard_assign", "identity", "select gtin, cast(cast('0x' || substr(sha256(gtin), 1, 16) as ubigint) % 32 as int) as bucket from identity")
def shard_assign(i: Inputs):
    return i.view("identity").select("gtin", barcodes.hash_bucket(F.col("gtin"), 32).alias("bucket"))


view("shard_line")(
    """
select cast(p_partkey % 8 as int) as shard, cast(floor(p_partkey / 8) as bigint) as line, lpad(cast(case when p_partkey % 30 = 16 then p_partkey - 16 when p_partkey % 70 = 9 then p_partkey - 8 else p_partkey end as string), 14, '0') as gtin from {part}
"""
)


@query(
    "shard_sort_check", "shard_line",
    "select shard, line, gtin, previous_key from (select *, lag(gtin) over (partition by shard order by line) as previous_key from shard_line) x where gtin <= previous_key",
)
def shard_sort_check(i: Inputs):
    return shards.unsorted_rows(i.view("shard_line"), "shard", "line", "gtin")


view("cell")(
    """
select c_custkey as k, case c_custkey % 7 when 0 then concat('=SUM(', c_name, ')') when 1 then concat('  +', c_name) when 2 then concat(chr(9), c_name) when 3 then '@cmd' when 4 then '-1' else c_name end as a,
  case when c_custkey % 3 = 0 then concat('x=', c_mktsegment) end as b from {customer}
"""
)


@query(
    "csv_safe_sink", "cell",
    r"""select k, case when regexp_matches(a, '^[\t\r\n]') or regexp_matches(a, '^\s*[=+\-@]') then '''' || a else a end as a, b from cell""",
)
def csv_safe_sink(i: Inputs):
    return shards.csv_safe(i.view("cell"))


view("export_line")(
    """
select c_nationkey as k, c_custkey as n, concat(cast(c_custkey as string), ';', c_name, ';', c_mktsegment) as value from {customer}
"""
)


def export_manifest(lines):
    """What the exports should be, from the table and not from the files; some entries are wrong on purpose."""
    body = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "\n"), F.lit("\n"))
    whole = lines.groupBy("k").agg(body.alias("body"), F.count("*").alias("records"))
    k = F.col("k")
    return whole.filter(k % 8 != 7).select(
        F.concat(F.lit("export="), F.when(k % 8 == 6, k + 100).otherwise(k).cast("string")).alias("file"),
        (F.octet_length("body") + F.when(k % 8 == 1, 1).otherwise(0)).cast("long").alias("bytes"),
        F.when(k % 8 == 2, F.sha2(k.cast("string"), 256)).otherwise(F.sha2("body", 256)).alias("sha256"),
        (F.col("records") + F.when(k % 8 == 3, 1).otherwise(0)).alias("records"),
    )


@query(
    "snapshot_digest_manifest", "export_line",
    """
w as (select k, string_agg(value, chr(10) order by n) || chr(10) as body, count(*) as records from export_line group by k),
m as (select 'export=' || case when k % 8 = 6 then k + 100 else k end as file, octet_length(encode(body)) + case when k % 8 = 1 then 1 else 0 end as bytes,
  case when k % 8 = 2 then sha256(k::varchar) else sha256(body) end as sha256, records + case when k % 8 = 3 then 1 else 0 end as records from w where k % 8 <> 7),
f as (select 'export=' || k as file, octet_length(encode(body)) as bytes, sha256(body) as sha256, records from w)
select * from (select coalesce(f.file, m.file) as file, case when m.file is null then 'not-listed' when f.file is null then 'missing' when f.bytes <> m.bytes then 'size'
  when f.sha256 <> m.sha256 then 'digest' when f.records <> m.records then 'records' end as problem from f full join m on m.file = f.file) x where problem is not null""",
)
def snapshot_digest_manifest(i: Inputs):
    """One export a nation is written, one file each, and judged by a manifest made from the table."""
    folder = shared_folder(i.spark, "exports")
    lines = i.view("export_line")
    lines.repartition("k").sortWithinPartitions("k", "n").select("k", "value").write.partitionBy("k").text(folder)
    found = shards.file_digests(i.spark, f"{folder}/*/*.txt", whole_bytes=4096, name=lambda path: F.concat(F.lit("export="), F.regexp_extract(path, "/k=([0-9]+)/", 1)))
    return shards.manifest_violations(found, export_manifest(lines))


_ID = {"gtin": "gtin", "market": "market", "sourceRecordID": "source_record_id", "name": "name", "brand": "brand", "reason": "reason"}


@query(
    "stream_snapshot_ingest", "raw_product",
    f"""{duck.CANDIDATE}, {duck.decided(SelectionPolicy())}
select 'ev:identity:sha256:' || sha256({_jsonobj(_ID)}) as id, gtin, market, source_record_id, name, reason as reason_code, 0 as batch
from decided join (select line as l, schema_version from raw_product) v on v.l = decided.line
where decision = 'include-detailed' and schema_version = '{SOURCE.schema_version}'""",
)
def stream_snapshot_ingest(i: Inputs):
    """The raw products land as JSON lines, twice; the second delivery adds nothing."""
    raw = i.view("raw_product").withColumnRenamed("source_record_id", "_id").drop("line", "owner", "allergens_de")
    landing, table, state = (shared_folder(i.spark, n) for n in ("landing", "identities", "progress"))
    lines = raw.select(F.to_json(F.struct("*")).alias("value"))
    for delivery in (1, 2):
        lines.write.mode("append").text(landing)
        ingest(i.spark, landing, table, state)
    return i.spark.read.parquet(table).select("id", "gtin", "market", "source_record_id", "name", "reason_code", "batch")


# --- reference data and statistics --------------------------------------------------------------
view("additive_entry")(
    """
select n_nationkey as k, concat('{{"id":"E', cast(300 + n_nationkey as string), '","status":"', case when n_nationkey % 9 = 8 then 'removed' else 'active' end, '","reviewedAt":"2001-01-01T00:00:00Z","officialNames":{{"en":["Acid ', n_name,
  '"],"de":["Saeure ', n_name, '","Saeure-', cast(n_nationkey as string), '"]}},"aliases":{{"en":["alias ', cast(n_nationkey as string), '"]}},"technologicalFunctions":["acid"', case when n_nationkey % 2 = 0 then ',"antioxidant"' else '' end,
  '],"originPossibilities":[{{"kind":"plant","statement":"from ', n_name, '","reference":"ref"}}],"legalReferences":[{{"kind":"union-list","reference":"reg-', cast(n_nationkey as string), '","revision":"1"}}]}}') as entry, n_name from {nation}
"""
)


@query(
    "additive_dims", "additive_entry",
    r"""
n as (select k, 'E' || (300 + k) as id, n_name from additive_entry),
nm as (select id, 'en' as language, 'official' as kind, 'Acid ' || n_name as name from n union all select id, 'de', 'official', 'Saeure ' || n_name from n union all select id, 'de', 'official', 'Saeure-' || k from n
  union all select id, 'en', 'alias', 'alias ' || k from n)
select 'names' as dim, id, language || '/' || kind as a, name as b, regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g') as c from nm
union all select 'additives', id, case when k % 9 = 8 then 'removed' else 'active' end, '2001-01-01T00:00:00Z', null from n
union all select 'functions', id, 'acid', null, null from n union all select 'functions', id, 'antioxidant', null, null from n where k % 2 = 0
union all select 'origins', id, 'plant', 'from ' || n_name, 'ref' from n union all select 'legal_references', id, 'union-list', 'reg-' || k, '1' from n""",
)
def additive_dims(i: Inputs):
    d = R.additive_dims(i.view("additive_entry"))
    none = F.lit(None).cast("string")
    shape = lambda name, a, b=none, c=none: d[name].select(F.lit(name).alias("dim"), "id", a.alias("a"), b.alias("b"), c.alias("c"))
    col = F.col
    return union_all(
        shape("names", F.concat_ws("/", "language", "kind"), col("name"), col("normalized_name")),
        shape("additives", col("status"), col("reviewedAt")), shape("functions", col("function")),
        shape("origins", col("kind"), col("statement"), col("reference")), shape("legal_references", col("kind"), col("reference"), col("revision")),
    )


view("free_code")(
    """
select event_id as id, case event_id % 8 when 0 then concat('E', cast(100 + event_id % 900 as string)) when 1 then concat(' e ', cast(100 + event_id % 900 as string), ' A ') when 2 then concat('E', cast(1000 + event_id % 500 as string), '(II)')
  when 3 then concat('e', cast(event_id % 99 as string)) when 4 then concat('E', cast(100 + event_id % 900 as string), 'b ( iv )') when 5 then concat('X', cast(event_id as string)) when 6 then concat('E', cast(100 + event_id % 900 as string), chr(10)) else '' end as code
from {events}
"""
)


@query(
    "e_number_canonicalize", "free_code",
    r"""
p as (select id, code, regexp_extract(code, '^\s*[Ee]\s*([0-9]{3,4})\s*([A-Za-z])?\s*(\(\s*([IVXivx]+)\s*\))?\s*$', ['d', 'l', 'p', 'r']) as g from free_code)
select id, case when g.d <> '' then 'E' || g.d || lower(g.l) || case when g.r <> '' then '(' || lower(g.r) || ')' else '' end end as additive from p""",
)
def e_number_canonicalize(i: Inputs):
    return i.view("free_code").select("id", M.additive_id(F.col("code")).alias("additive"))


view("module_version")(
    """
select concat('module-', cast(o_custkey % 50 as string)) as module_id, cast(o_orderkey % 3 as int) as major, cast(o_orderkey % 12 as int) as minor, cast(o_orderkey % 2 as int) as patch,
  cast(case when o_orderkey % 4 = 0 then 1 else 0 end as int) as release, cast(o_orderkey % 11 as int) as pre_number, case when o_orderkey % 4 = 1 then 'rc' when o_orderkey % 4 = 2 then 'beta' end as pre_word,
  case when o_orderkey % 97 = 0 then '01.2.3' when o_orderkey % 4 = 0 then concat_ws('.', cast(o_orderkey % 3 as string), cast(o_orderkey % 12 as string), cast(o_orderkey % 2 as string))
   when o_orderkey % 4 = 3 then concat(concat_ws('.', cast(o_orderkey % 3 as string), cast(o_orderkey % 12 as string), cast(o_orderkey % 2 as string)), '-', cast(o_orderkey % 11 as string))
   else concat(concat_ws('.', cast(o_orderkey % 3 as string), cast(o_orderkey % 12 as string), cast(o_orderkey % 2 as string)), '-', case when o_orderkey % 4 = 1 then 'rc' else 'beta' end, '.', cast(o_orderkey % 11 as string)) end as version
from {orders}
"""
)


@query(
    "semver_order", "module_version",
    """
v as (select * from module_version where version <> '01.2.3'),
r as (select *, row_number() over (partition by module_id order by major desc, minor desc, patch desc, release desc, case when pre_word is null then 0 else 1 end desc, coalesce(pre_word, '') desc, pre_number desc, version) as rn, count(*) over (partition by module_id) as versions from v)
select module_id, version as latest, versions from r where rn = 1""",
)
def semver_order(i: Inputs):
    return R.latest_version(i.view("module_version").select("module_id", "version"))


view("additive_version")(
    """
select concat('E', cast(100 + p_partkey as string)) as additive_id, p_name as name, p_brand as status, p_type as origin,
  case when p_partkey % 20 = 0 then concat(p_name, ' (new)') else p_name end as new_name, case when p_partkey % 30 = 0 then cast(null as string) else p_brand end as new_status, p_partkey as k from {part}
"""
)


@query(
    "reference_diff", "additive_version rule_alias",
    """
d as (select additive_id, 'removed' as change, '' as field from additive_version where k % 50 = 7 union all select additive_id, 'added', '' from additive_version where k % 50 = 8
  union all select additive_id, 'changed', 'name' from additive_version where k % 50 not in (7, 8) and name <> new_name union all select additive_id, 'changed', 'status' from additive_version where k % 50 not in (7, 8) and status is distinct from new_status),
ra as (select distinct rule_id from rule_alias where match = 'e-number' and regexp_full_match(alias, 'E [0-9]{3,4}') and replace(alias, ' ', '') in (select additive_id from d))
select additive_id, change, field from d union all select rule_id, 'affected-rule', '' from ra""",
)
def reference_diff(i: Inputs):
    v = i.view("additive_version")
    before = v.filter("k % 50 <> 8").select("additive_id", "name", "status", "origin")
    after = v.filter("k % 50 <> 7").select("additive_id", F.col("new_name").alias("name"), F.col("new_status").alias("status"), "origin")
    diff = R.reference_diff(before, after, ["name", "status", "origin"])
    rules = R.affected_rules(diff, i.view("rule_alias"))
    return diff.unionByName(rules.select(F.col("rule_id").alias("additive_id"), F.lit("affected-rule").alias("change"), F.lit("").alias("field")))


@query(
    "nearest_rank_percentile", "",
    """select l_returnflag, quantile_disc(l_extendedprice, 0.95) as percentile from lineitem group by l_returnflag""",
)
def nearest_rank_percentile(i: Inputs):
    return R.nearest_rank(i.table("lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", 0.95, 100.0)


@query(
    "coverage_stats", ALL,
    """
r as (select s.id, g.ingredients_text as t, g.language_code from selection s left join ingredient g on g.id = s.ingredient_id)
select 'with-text' as metric, '' as key, cast(count(*) filter (where length(t) > 0) as varchar) as value from r union all select 'without-text', '', cast(count(*) filter (where not coalesce(length(t) > 0, false)) as varchar) from r
union all select 'coverage-percent', '', cast(round(100 * count(*) filter (where length(t) > 0) / count(*), 3) as varchar) from r
union all select 'average-bytes', '', cast(round(avg(octet_length(encode(t))) filter (where length(t) > 0), 2) as varchar) from r union all select 'largest-bytes', '', cast(max(octet_length(encode(t))) as varchar) from r
union all select 'language', language_code, cast(count(*) as varchar) from r where length(t) > 0 group by language_code""",
)
def coverage_stats(i: Inputs):
    e = Envelope(i)
    ing = e["ingredient"].select(F.col("id").alias("ingredient_id"), "ingredients_text", "language_code")
    return R.coverage_stats(e["selection"].select("ingredient_id").join(ing, "ingredient_id", "left"))


@query(
    "churn_window", "identity retailer",
    f"""select 'products' as kind, count(*) as n from identity where {ts('source_modified_at')} >= {AT} - interval 7 day
union all select 'retailer', count(*) from retailer where {ts('coalesce(observed_at, retrieved_at)')} >= {AT} - interval 7 day""",
)
def churn_window(i: Inputs):
    return R.churn(i.view("identity"), i.view("retailer"), AS_OF)
