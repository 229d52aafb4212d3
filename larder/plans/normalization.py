"""Demo queries: normalization of raw product rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import barcodes, clock, text
from larder.functions.stage import once
from larder.operators import normalize as N
from larder.plans import duck
from larder.plans.inputs import Inputs, view
from larder.plans.registry import query
from larder.policy import SourcePolicy

SOURCE = SourcePolicy()


def raw(inputs: Inputs) -> DataFrame:
    """Raw products with their language-suffixed keys as one map, as the JSON scan yields them."""
    keys = ("ingredients_text_de", "ingredients_text_en", "product_name_de", "allergens_de")
    pairs = [x for k in keys for x in (F.lit(k), F.col(k))]
    return inputs.view("raw_product").withColumn(
        "localized", F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    )


def joined(column, sep: str = "|"):
    return F.array_join(column, sep)


@query("gtin_normalize", "code", f"select k, code, {duck.gtin('code')} as gtin from code")
def gtin_normalize(i: Inputs):
    return i.view("code").select("k", "code", barcodes.gtin14(F.col("code")).alias("gtin"))


_TRIMMED = r"regexp_replace(code, '^\s+|\s+$', '', 'g')"


@query(
    "gtin_normalize_trimmed", "code",
    f"select case when g is null then 'rejected' else 'accepted' end as outcome, count(*) as n, min(g) as low, max(g) as high "
    f"from (select {duck.gtin(_TRIMMED)} as g from code) t group by 1",
)
def gtin_normalize_trimmed(i: Inputs):
    g = i.view("code").select(barcodes.gtin14_trimmed(F.col("code")).alias("g"))
    return g.groupBy(F.when(F.col("g").isNull(), "rejected").otherwise("accepted").alias("outcome")).agg(
        F.count("*").alias("n"), F.min("g").alias("low"), F.max("g").alias("high")
    )


_SCAN = """
select l_orderkey * 8 + l_linenumber as scan_id, l_partkey as k, n % 5 as shape,
  case n % 5 when 0 then concat(' ', substr(c, 1, 4), '-', substr(c, 5, 14))
             when 1 then concat('0', substr(lpad(cast(l_partkey * 7 + l_linenumber as string), 6, '0'), 1, 6), cast(l_suppkey % 10 as string))
             when 2 then concat(c, '0') when 3 then concat(c, 'X') else '  ' end as typed,
  case when n % 3 = 0 then 'upce' else 'unknown' end as symbology, c
from (select *, l_partkey + l_linenumber as n, code as c from {lineitem} join code on k = l_partkey) j
"""
view("scan", "code")(_SCAN)

_UPCA = """case when left(d, 1) in ('0', '1') then concat(case
  when substr(d, 7, 1) in ('0', '1', '2') then concat(substr(d, 1, 3), substr(d, 7, 1), '0000', substr(d, 4, 3))
  when substr(d, 7, 1) = '3' then concat(substr(d, 1, 4), '00000', substr(d, 5, 2))
  when substr(d, 7, 1) = '4' then concat(substr(d, 1, 5), '00000', substr(d, 6, 1))
  else concat(substr(d, 1, 6), '0000', substr(d, 7, 1)) end, right(d, 1)) end"""


@query(
    "retail_barcode_normalize", "scan",
    f"""
digits as (select scan_id, typed, symbology, regexp_replace(typed, '[\\s-]', '', 'g') as d from scan),
parts as (select *, {duck.gtin('d')} as plain, case when regexp_full_match(d, '[0-9]{{8}}') then {duck.gtin(_UPCA)} end as expanded from digits)
select scan_id, typed, symbology,
  case when length(d) = 8 and symbology = 'upce' then expanded when length(d) = 8 then coalesce(plain, expanded) else plain end as gtin,
  case when d = '' then 'empty' when not regexp_full_match(d, '[0-9]+') then 'unsupported-characters'
       when length(d) not in (8, 12, 13, 14) then 'unsupported-length'
       when (case when length(d) = 8 and symbology = 'upce' then expanded when length(d) = 8 then coalesce(plain, expanded) else plain end) is null
       then 'invalid-check-digit' end as error
from parts""",
)
def retail_barcode_normalize(i: Inputs):
    scans = barcodes.with_retail_barcode(i.view("scan"), F.col("typed"), F.col("symbology"))
    return scans.select("scan_id", "typed", "symbology", "gtin", "error")


view("payload", "code")(
    """
select l_orderkey * 8 + l_linenumber as scan_id, case (l_partkey + l_linenumber) % 6
   when 0 then concat('https://id.example.org/01/', c14, '/10/A1')
   when 1 then concat('https://shop.example.org/p?x=1&01=', c14)
   when 2 then concat('(01)', c14, '10LOT') when 3 then concat(']C101', c14)
   when 4 then c14 else concat('https://id.example.org/01/', substr(c14, 1, 9)) end as payload
from {lineitem} join (select k, lpad(code, 14, '0') as c14 from code) c on k = l_partkey
"""
)


@query(
    "gs1_payload_extract", "payload",
    f"""
found as (select *, case
    when length(regexp_extract(payload, '[?&]01=([^&#]*)', 1)) = 14 then regexp_extract(payload, '[?&]01=([^&#]*)', 1)
    when contains(payload, '/01/') then nullif(regexp_extract(payload, '/01/(.{{14}})', 1), '')
    when starts_with(payload, '(01)') then substr(payload, 5, 14) when starts_with(payload, ']C101') then substr(payload, 6, 14) end as inner_code
  from payload)
select scan_id, payload, coalesce({duck.gtin('bare')}, {duck.gtin('inner_bare')}) as gtin
from (select *, regexp_replace(payload, '[\\s\\p{{Z}}-]', '', 'g') as bare, regexp_replace(inner_code, '[\\s\\p{{Z}}-]', '', 'g') as inner_bare from found) x""",
)
def gs1_payload_extract(i: Inputs):
    direct = barcodes.with_retail_barcode(i.view("payload"), F.col("payload"), F.lit("qr"), "direct", "direct_error")
    inner = barcodes.with_retail_barcode(direct, barcodes.gs1_candidate(F.col("payload")), F.lit("qr"), "inner", "inner_error")
    return inner.select("scan_id", "payload", F.coalesce("direct", "inner").alias("gtin"))


@query(
    "barcode_aliases", "code",
    f"""
g as (select distinct {duck.gtin('code')} as gtin from code)
select gtin, alias from (
  select gtin, unnest([gtin, case when starts_with(gtin, '0') then substr(gtin, 2) end,
    case when starts_with(gtin, '00') then substr(gtin, 3) end, case when starts_with(gtin, '000000') then substr(gtin, 7) end]) as alias
  from g where gtin is not null) a where alias is not null""",
)
def barcode_aliases(i: Inputs):
    g = once(i.view("code"), gtin=barcodes.gtin14(F.col("code"))).select("gtin").filter("gtin is not null").distinct()
    return g.select("gtin", F.explode(barcodes.aliases(F.col("gtin"))).alias("alias"))


@query("canonical_tags", "raw_product",
       f"select line, {duck.joined(duck.tags('categories'))} as categories, {duck.joined(duck.tags('countries'))} as countries from raw_product")
def canonical_tags(i: Inputs):
    return raw(i).select(
        "line",
        joined(N.canonical_tags("categories", F.col("categories_tags"), F.col("tags_sources"))).alias("categories"),
        joined(N.canonical_tags("countries", F.col("countries_tags"), F.col("tags_sources"))).alias("countries"),
    )


@query("derive_market", "raw_product", f"select line, {duck.market(duck.tags('countries'))} as market from raw_product")
def derive_market(i: Inputs):
    countries = N.canonical_tags("countries", F.col("countries_tags"), F.col("tags_sources"))
    return raw(i).select("line", N.market(countries).alias("market"))


@query(
    "barcode_provenance_flags", "raw_product",
    """a as (select line, code, list_contains(coalesce(codes_tags, []), 'en:source-assigned-no-barcode') as assigned from raw_product)
select line, assigned, starts_with(code, '200') and not assigned as ambiguous_prefix from a""",
)
def barcode_provenance_flags(i: Inputs):
    assigned = N.no_barcode(F.col("codes_tags"), F.lit(None), F.lit(None).cast("boolean"))
    return raw(i).select(
        "line", assigned.alias("assigned"), N.ambiguous_prefix(F.col("code"), assigned).alias("ambiguous_prefix")
    )


@query("ingredient_text_by_language", "raw_product",
       f"{duck.INGREDIENT_TEXTS} select line, position, language, sha256(text) as text_hash from ingredient_text")
def ingredient_text_by_language(i: Inputs):
    texts = N.ingredient_texts(F.col("localized"), F.col("ingredients_text"), F.col("lang"))
    return raw(i).select("line", F.posexplode(texts).alias("position", "t")).select(
        "line", F.col("position").cast("long").alias("position"), "t.language", F.sha2("t.text", 256).alias("text_hash")
    )


@query(
    "language_conflicts", "raw_product",
    f"""select line, lang as language, sha256(ingredients_text) as base_hash, sha256(other) as localized_hash
from (select *, case lang when 'de' then ingredients_text_de when 'en' then ingredients_text_en end as other from raw_product) r
where {duck.LANG_OK} and trim(ingredients_text) <> '' and trim(other) <> '' and other <> ingredients_text""",
)
def language_conflicts(i: Inputs):
    other = N.language_conflict(F.col("localized"), F.col("ingredients_text"), F.col("lang"))
    return raw(i).withColumn("other", other).filter("other is not null").select(
        "line", F.col("lang").alias("language"), F.sha2("ingredients_text", 256).alias("base_hash"),
        F.sha2("other", 256).alias("localized_hash"),
    )


@query(
    "product_signals", "raw_product",
    f"""{duck.INGREDIENT_TEXTS},
tagged as (select r.*, i.text as best, {duck.tags('categories')} as tags from raw_product r
           left join ingredient_text i on i.line = r.line and i.position = 0)
select line, cast({duck.COUNT} as varchar) as ingredient_count, {duck.joined(duck.category_signals('tags'))} as category_signals,
  {duck.joined(duck.formulation_signals('best', duck.COUNT))} as formulation_signals from tagged""",
)
def product_signals(i: Inputs):
    c = N.candidates(raw(i), SOURCE)
    return c.select("line", F.col("ingredient_count").cast("string").alias("ingredient_count"), joined("category_signals").alias("category_signals"),
                    joined("formulation_signals").alias("formulation_signals"))


@query("retailer_keys", "raw_product", f"select line, {duck.joined(duck.RETAILER_KEYS)} as retailer_keys from raw_product")
def retailer_keys(i: Inputs):
    return raw(i).select(
        "line", joined(N.retailer_keys(F.col("stores_tags"), F.col("purchase_places_tags"))).alias("retailer_keys")
    )


@query("image_refs", "raw_product", f"{duck.IMAGES} select line, purpose, url, image_id, revision from image")
def image_refs(i: Inputs):
    images = N.candidates(raw(i), SOURCE).select("line", F.inline("remote_images"))
    return images.select("line", "purpose", "url", "image_id", "revision")


@query(
    "normalize_alias", "",
    r"""select s_suppkey, nullif(trim(regexp_replace(replace(lower(trim(label)), 'ß', 'ss'), '[^a-z0-9äöüß]+', ' ', 'g')), '') as alias
from (select s_suppkey, case s_suppkey % 4 when 0 then concat('  ALDI -- Süd ', s_name) when 1 then concat('Groß.Markt', s_name)
                                          when 2 then s_name else ' -- ' end as label from supplier) l""",
)
def normalize_alias(i: Inputs):
    k = F.col("s_suppkey") % 4
    label = (
        F.when(k == 0, F.concat(F.lit("  ALDI -- Süd "), "s_name")).when(k == 1, F.concat(F.lit("Groß.Markt"), "s_name"))
        .when(k == 2, F.col("s_name")).otherwise(" -- ")
    )
    return i.table("supplier").select("s_suppkey", text.alias_key(label).alias("alias"))


@query(
    "coalesce_labels", "raw_product",
    f"""select line, {duck.NAME} as name,
  coalesce(case when trim(allergens_de) <> '' then allergens_de end, case when trim(allergens) <> '' then allergens end,
           nullif({duck.joined(duck.texts('allergens_tags'), ', ')}, '')) as allergens,
  coalesce(case when trim(traces) <> '' then traces end, nullif({duck.joined(duck.texts('traces_tags'), ', ')}, '')) as traces
from raw_product""",
)
def coalesce_labels(i: Inputs):
    c = F.col
    return raw(i).select(
        "line",
        N.product_name(c("localized"), c("product_name"), c("generic_name"), c("code")).alias("name"),
        N.text_or_tags([F.try_element_at("localized", F.lit("allergens_de")), c("allergens")], c("allergens_tags")).alias("allergens"),
        N.text_or_tags([F.try_element_at("localized", F.lit("traces_de")), c("traces")], c("traces_tags")).alias("traces"),
    )


@query(
    "epoch_to_rfc3339", "raw_product",
    """select line, case when last_modified_t > 0 then strftime(make_timestamp(last_modified_t * 1000000), '%Y-%m-%dT%H:%M:%SZ') end as modified_at
from raw_product""",
)
def epoch_to_rfc3339(i: Inputs):
    return raw(i).select("line", clock.epoch_rfc3339(F.col("last_modified_t")).alias("modified_at"))


CANDIDATE_ARRAYS = ("category_tags", "category_signals", "formulation_signals", "evidence_signals", "retailer_keys", "package_signals")


@query(
    "to_candidates", "raw_product",
    f"""{duck.CANDIDATE} select line, source_record_id, barcode, market, product_type, barcode_kind, name, brand,
  sha256(ingredients_text) as text_hash, cast(ingredient_count as varchar) as ingredient_count, {', '.join(f"{duck.joined(a)} as {a}" for a in CANDIDATE_ARRAYS)},
  coalesce(images, '') as images from candidate""",
)
def to_candidates(i: Inputs):
    images = F.array_join(
        F.transform("remote_images", lambda m: F.concat(m["purpose"], F.lit("="), m["url"], F.lit("#"), m["image_id"])), " "
    )
    return N.candidates(raw(i), SOURCE).select(
        "line", "source_record_id", "barcode", "market", "product_type", "barcode_kind", "name", "brand",
        F.sha2("ingredients_text", 256).alias("text_hash"), F.col("ingredient_count").cast("string").alias("ingredient_count"),
        *(joined(a).alias(a) for a in CANDIDATE_ARRAYS), images.alias("images"),
    )
