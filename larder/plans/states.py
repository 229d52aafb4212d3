"""Demo queries: evolution against the previous snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import state as S
from larder.plans.evidence_views import key
from larder.plans.inputs import RETRIEVED, Inputs, day, view
from larder.plans.registry import query

OWN = "open-food-facts"

view("selected_now")(
    f"""
select p_partkey as k, {key('p_partkey')}, case when p_partkey % 33 = 5 then concat('rec-', cast(p_partkey - 1 as string))
    else concat('rec-', cast(p_partkey as string)) end as source_record_id,
  case when p_partkey % 11 <> 0 then md5(text) end as content_hash, p_partkey % 6 = 0 as language_conflict, p_partkey % 14 = 0 as ambiguous_prefix
from {{part}} left join {{documents}} on doc_id = p_partkey where p_partkey % 10 <> 7
union all
select p_partkey, {key('p_partkey')}, concat('alt-', cast(p_partkey as string)), md5(concat(p_name, p_brand)), false, false from {{part}} where p_partkey % 48 = 2
"""
)
view("previous_selection")(
    f"""
select concat('ps-', cast(p_partkey as string)) as id, {key('p_partkey')}, concat('pi-', cast(p_partkey as string)) as identity_id,
  case when p_partkey % 8 <> 7 and doc_id is not null then concat('pg-', cast(p_partkey as string)) end as ingredient_id,
  case when p_partkey % 3 = 0 then concat('asm-', cast(p_partkey as string)) end as assessment_id
from {{part}} left join {{documents}} on doc_id = p_partkey where p_partkey % 9 <> 0
"""
)
view("previous_identity")(
    f"""
select concat('pi-', cast(p_partkey as string)) as id, case when p_partkey % 12 = 5 then 'other-source' else '{OWN}' end as source_key,
  case when p_partkey % 21 = 1 then concat('old-', cast(p_partkey as string)) else concat('rec-', cast(p_partkey as string)) end as source_record_id
from {{part}}
"""
)
view("previous_ingredient")(
    f"""
select concat('pg-', cast(p_partkey as string)) as id, case when p_partkey % 12 = 5 then 'other-source' else '{OWN}' end as source_key,
  case when p_partkey % 5 = 0 then md5(concat(text, 'x')) else md5(text) end as content_hash
from {{part}} join {{documents}} on doc_id = p_partkey
"""
)
view("identity_history")(
    f"""
select concat('rec-', cast(l_partkey as string)) as source_record_id, case when l_linestatus = 'O' then '{OWN}' else 'other-source' end as source_key,
  lpad(cast(case when l_suppkey % 10 = 0 then l_partkey + 1 else l_partkey end as string), 14, '0') as gtin,
  {day('1998', 'l_suppkey', 40)} as retrieved_at, l_orderkey * 10 + l_linenumber as ordinal
from {{lineitem}} group by l_partkey, l_linestatus, l_suppkey, l_orderkey, l_linenumber
"""
)
PREVIOUS = "selected_now previous_selection previous_identity previous_ingredient"
STATE = """
state as (select c.*, s.id as prev_selection_id, s.identity_id as prev_identity_id, s.ingredient_id as prev_ingredient_id,
    s.assessment_id as prev_assessment_id, d.source_key as prev_identity_source, d.source_record_id as prev_source_record_id,
    g.content_hash as prev_hash, g.source_key as prev_ingredient_source
  from selected_now c left join previous_selection s on s.gtin = c.gtin and s.market = c.market
  left join previous_identity d on d.id = s.identity_id left join previous_ingredient g on g.id = s.ingredient_id)"""
LATEST = f"""
latest as (select source_record_id, gtin, retrieved_at, ordinal from (
  select *, row_number() over (partition by source_record_id order by retrieved_at desc, ordinal) as rn
  from identity_history where source_key = '{OWN}') x where rn = 1)"""
NEW_INGREDIENT = f"""
ing as (select gtin, market, source_record_id, content_hash, coalesce(content_hash = prev_hash, false) as kept, prev_assessment_id,
    case when content_hash <> prev_hash then prev_ingredient_id end as supersedes_id,
    case when content_hash = prev_hash then prev_ingredient_id else 'ev:ingredient:sha256:' || sha256('{{"contentHash":"' || content_hash || '","gtin":"' || gtin
      || '","market":"' || market || '","retrievedAt":"{RETRIEVED}","sourceRecordID":"' || source_record_id || '"'
      || case when content_hash <> prev_hash then ',"supersedesID":"' || prev_ingredient_id || '"' else '' end || '}}') end as id
  from state where content_hash is not null)"""


def state(i: Inputs):
    return S.previous_state(*(i.view(v) for v in PREVIOUS.split()))


@query("previous_state_join", PREVIOUS,
       f"""{STATE} select source_record_id, gtin, market, content_hash, prev_selection_id, prev_source_record_id, prev_hash from state""")
def previous_state_join(i: Inputs):
    return state(i).select(
        "source_record_id", "gtin", "market", "content_hash", "prev_selection_id", "prev_source_record_id", "prev_hash"
    )


@query(
    "formulation_changes", PREVIOUS,
    f"""{STATE}, {NEW_INGREDIENT}
select 'ingredient' as part, gtin, source_record_id, id, supersedes_id, cast(kept as varchar) as kept from ing
union all select 'event', prev_assessment_id, '{RETRIEVED}', id, null, null from ing where supersedes_id is not null and prev_assessment_id is not null""",
)
def formulation_changes(i: Inputs):
    ingredients, events = S.formulation_changes(state(i), RETRIEVED)
    a = ingredients.select(F.lit("ingredient").alias("part"), "gtin", "source_record_id", "id", "supersedes_id", F.col("kept").cast("string").alias("kept"))
    b = events.select(
        F.lit("event").alias("part"), F.col("assessment_id").alias("gtin"), F.col("occurred_at").alias("source_record_id"),
        F.col("triggered_by").alias("id"), F.lit(None).cast("string").alias("supersedes_id"), F.lit(None).cast("string").alias("kept"),
    )
    return a.unionByName(b)


@query("latest_identity_by_source", "identity_history", f"{LATEST} select * from latest")
def latest_identity_by_source(i: Inputs):
    return S.latest_identity_by_source(i.view("identity_history"), OWN)


@query(
    "upstream_change_signals", f"{PREVIOUS} identity_history",
    f"""{STATE}, {LATEST}
select 'source-record-id-changed-same-gtin' as signal, gtin, market, prev_source_record_id as previous, source_record_id as current
from state where prev_identity_source = '{OWN}' and prev_source_record_id <> source_record_id
union all
select 'barcode-changed', s.gtin, s.market, l.gtin, s.gtin from state s join latest l on l.source_record_id = s.source_record_id where l.gtin <> s.gtin
union all
select 'ingredient-field-deleted', gtin, market, prev_ingredient_id, null from state
where content_hash is null and prev_ingredient_source = '{OWN}'""",
)
def upstream_change_signals(i: Inputs):
    latest = S.latest_identity_by_source(i.view("identity_history"), OWN)
    return S.upstream_signals(state(i), latest, OWN)


@query(
    "current_selections", PREVIOUS,
    f"""{STATE}, {NEW_INGREDIENT},
r as (select s.gtin, s.market, s.source_record_id, i.id as ingredient_id, array_to_string(list_sort(list_filter([
      case when language_conflict then 'ingredient-language-conflict' end, case when ambiguous_prefix then 'restricted-prefix-provenance-ambiguous' end,
      case when s.content_hash is null then 'ingredients-missing' end,
      case when s.content_hash is null and prev_hash is not null then 'ingredient-field-deleted' end], lambda x: x is not null)), '|') as flags,
    count(*) over (partition by s.gtin, s.market) as records,
    row_number() over (partition by s.gtin, s.market order by s.source_record_id desc) as rn
  from state s left join ing i on i.gtin = s.gtin and i.market = s.market and i.source_record_id = s.source_record_id)
select gtin, market, source_record_id, ingredient_id, flags, records from r where rn = 1""",
)
def current_selections(i: Inputs):
    st = state(i)
    ingredients, _ = S.formulation_changes(st, RETRIEVED)
    return S.current_selections(st, ingredients).select(
        "gtin", "market", "source_record_id", "ingredient_id", F.array_join("conflict_flags", "|").alias("flags"), "records"
    )


_SUMMARY = """
select change, count(*) as n, min(gtin) as first_gtin from (
  select gtin, case when content_hash <> prev_hash then 'formulation-changed' when prev_selection_id is not null then 'unchanged' else 'added' end as change from state
  union all
  select gtin, '{gone}' from previous_selection p where not exists (select 1 from selected_now c where c.gtin = p.gtin and c.market = p.market)) x group by change"""


@query("change_summary", PREVIOUS, f"{STATE} {_SUMMARY.format(gone='removed')}")
def change_summary(i: Inputs):
    return S.change_summary(state(i), i.view("previous_selection"), complete=True)


@query("change_summary_incomplete", PREVIOUS, f"{STATE} {_SUMMARY.format(gone='not-observed-in-incomplete-snapshot')}")
def change_summary_incomplete(i: Inputs):
    return S.change_summary(state(i), i.view("previous_selection"), complete=False)
