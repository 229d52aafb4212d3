"""Operator inputs derived from the driver tables.

Each view is one SQL text that Spark and DuckDB both run, so a query and its oracle start from the
same rows and differ only in how the operator itself is written. Table names stand in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

AS_OF = "2001-11-05T12:00:00Z"
RETRIEVED = "2001-11-05T08:00:00Z"


def _check(body: str, bump: str) -> str:
    """Check digit of a body of up to 13 digits as portable arithmetic; ``bump`` makes some digits wrong."""
    terms = " + ".join(f"{1 if k % 2 else 3} * floor({body} / 1e{k})" for k in range(12))
    return f"cast((10 + {bump} - cast({terms} as bigint) % 10) % 10 as string)"


def day(base: str, key: str, spread: int) -> str:
    """Deterministic RFC3339 text: a year-month-day spread over ``spread`` months from a base year."""
    y = f"cast({base} + cast(floor(({key} % {spread}) / 12) as int) as string)"
    m = f"lpad(cast(1 + {key} % 12 as string), 2, '0')"
    d = f"lpad(cast(1 + {key} % 28 as string), 2, '0')"
    return f"concat({y}, '-', {m}, '-', {d}, 'T12:00:00Z')"


def array_of(*items: str) -> str:
    """Array of the non-null items (one null item when all are null)."""
    return f"split(nullif(concat_ws(',', {', '.join(items)}), ''), ',')"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, *needs: str):
    def keep(sql: str) -> None:
        VIEWS[name] = (needs, sql.strip())

    return keep


# --- raw product export -------------------------------------------------------------------------
view("code_parts")(
    f"""
select k, lpad(cast(b as string), 13, '0') as body, {_check('b', "(case when k % 7 = 3 then 1 else 0 end)")} as digit
from (select p_partkey as k, case when p_partkey % 11 = 5 then 200000000000 + p_partkey when p_partkey % 50 = 49 then p_partkey - 1 else p_partkey end as b
      from {{part}}) n
"""
)
view("code", "code_parts")(
    """
select k, case when k % 97 = 1 then concat(full_code, chr(10))
               when k % 97 = 2 then concat(' ', full_code)
               when k % 97 = 3 then 'abc'
               when k % 97 = 4 then substr(full_code, 4, 11)
               when full_code like '0200%' then substr(full_code, 2, 13)
               when k % 4 = 0 then substr(full_code, 7, 8)
               when k % 4 = 1 then substr(full_code, 3, 12)
               when k % 4 = 2 then substr(full_code, 2, 13)
               else full_code end as code
from (select k, concat(body, digit) as full_code from code_parts) c
"""
)
view("raw_product", "code")(
    f"""
select p.p_partkey as line, c.code as code, concat('rec-', cast(p.p_partkey as string)) as source_record_id,
  case when p.p_partkey % 41 = 7 then '1003' when p.p_partkey % 83 = 9 then cast(null as string) else '1004' end as schema_version,
  case when p.p_partkey % 29 = 4 then 'beauty' else 'food' end as product_type,
  case when p.p_partkey % 13 = 0 then 'Deutsch!' else coalesce(d.lang, 'de') end as lang,
  case when p.p_partkey % 9 = 0 then ' ' else p.p_name end as product_name,
  case when p.p_partkey % 8 = 0 then concat(p.p_name, ' DE') end as product_name_de,
  case when p.p_partkey % 27 = 0 then cast(null as string) else concat('generic ', p.p_type) end as generic_name,
  case when p.p_partkey % 17 = 0 then '  ' else p.p_brand end as brands,
  concat(cast(p.p_size as string), ' g') as quantity,
  {array_of("case when p.p_partkey % 10 = 0 then 'en:france' when p.p_partkey % 10 = 1 then 'de:osterreich' when p.p_partkey % 10 = 2 then 'de:schweiz' when p.p_partkey % 10 = 3 then 'en:italy' else 'en:germany' end", "case when p.p_partkey % 30 = 0 then 'en:germany' end")} as countries_tags,
  {array_of("case p.p_type when 'ECONOMY' then 'en:fresh-fruits' when 'SMALL' then 'en:plain-waters' when 'PROMO' then 'en:plain-cow-milks' when 'LARGE' then 'en:biscuits' when 'MEDIUM' then 'en:sauces' else 'en:nuts' end", "case when p.p_size > 45 then 'en:snacks' end", "case when p.p_partkey % 12 = 0 then 'en:biscuits' end")} as categories_tags,
  {array_of("case when p.p_partkey % 31 = 0 then 'en:Halal-certified' end", "case when p.p_partkey % 3 = 0 then 'en:organic' end")} as labels_tags,
  case when p.p_partkey % 37 = 2 then '{{{{"countries":["de:deutschland"]}}}}'
       when p.p_partkey % 37 = 3 then '{{{{"import":{{{{"countries":["fr:france"],"categories":["en:cakes"]}}}}}}}}' end as tags_sources,
  {array_of("case when p.p_partkey % 53 = 0 then 'en:source-assigned-no-barcode' end")} as codes_tags,
  case when p.p_size % 4 = 3 then cast(null as int) else cast(p.p_size % 4 as int) end as ingredients_n,
  case when p.p_partkey % 3 = 0 then '[{{{{"id":"en:salt","percent":1}}}},"water",{{{{"id":"en:nut","ingredients":[{{{{"id":"x"}}}}]}}}}]'
       when p.p_partkey % 7 = 0 then '[]' when p.p_partkey % 11 = 0 then '"none"' end as ingredients,
  case when p.p_partkey % 6 <> 1 then d.text end as ingredients_text,
  case when d.lang = 'de' or p.p_partkey % 19 = 0 then d.text || case when p.p_partkey % 5 = 0 then ' (Zucker)' else '' end end as ingredients_text_de,
  case when d.lang = 'en' and p.p_partkey % 2 = 0 then d.text end as ingredients_text_en,
  case when p.p_partkey % 23 = 0 then 1 when p.p_partkey % 23 = 1 then 0 end as additives_n,
  {array_of("case when p.p_partkey % 46 = 5 then 'en:e330' end")} as additives_tags,
  {array_of("case when p.p_partkey % 3 = 0 then concat('de:Markt ', p.p_brand) end", "case when p.p_partkey % 5 = 0 then 'Lidl' end")} as stores_tags,
  {array_of("case when p.p_partkey % 5 = 0 then 'lidl' end", "case when p.p_partkey % 45 = 0 then 'Straße 1' end")} as purchase_places_tags,
  {array_of("case when p.p_size > 25 then 'en:Glass Jar' else 'de:Karton' end")} as packaging_tags,
  case when p.p_partkey % 4 <> 0 then concat('https://images.openfoodfacts.org/p/', cast(p.p_partkey as string), '/front.jpg') end as image_front_url,
  case when p.p_partkey % 4 = 1 then g.url end as image_ingredients_url,
  case when p.p_partkey % 6 = 2 then concat('https://world.openfoodfacts.org/n/', cast(p.p_partkey as string)) end as image_nutrition_url,
  case when p.p_partkey % 15 = 0 then 'Milch' end as allergens_de,
  case when p.p_partkey % 10 = 0 then ' ' when p.p_partkey % 10 = 5 then 'en:milk' end as allergens,
  {array_of("case when p.p_partkey % 4 = 1 then 'en:nuts' end", "case when p.p_partkey % 8 = 1 then 'en:soy' end")} as allergens_tags,
  case when p.p_partkey % 14 = 3 then 'nuts' end as traces,
  {array_of("case when p.p_partkey % 6 = 0 then 'en:egg' end")} as traces_tags,
  cast(p.p_partkey % 7 as bigint) as rev,
  case when p.p_partkey % 20 = 0 then cast(0 as bigint) else cast(1700000000 + p.p_partkey * 3600 % 40000000 as bigint) end as last_modified_t,
  case when p.p_partkey % 6 = 0 then concat('org-', p.p_brand) end as owner
from {{part}} p
join code c on c.k = p.p_partkey
left join {{documents}} d on d.doc_id = p.p_partkey
left join {{pages}} g on g.page_id = p.p_partkey
"""
)


class Inputs:
    """Driver tables and derived views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = f"with {ctes([name])} select * from {name}"
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)


def closure(names) -> list[str]:
    """The named views and all they need, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in VIEWS[name][0]:
                visit(need)
            order.append(name)

    for name in names:
        visit(name)
    return order


def ctes(names, materialized: bool = False) -> str:
    once = "materialized " if materialized else ""
    return ",\n".join(f"{name} as {once}({VIEWS[name][1]})" for name in closure(names))


def oracle_ctes(names, materialized: bool = False) -> str:
    return ctes(names, materialized).format(**{t: t for t in TABLES})
