"""Evidence collections derived from the driver tables, one view per collection."""

from __future__ import annotations

from larder.plans.inputs import array_of, day, view

GTIN = "lpad(cast({k} as string), 14, '0')"
MARKET = "case when {k} % 10 = 1 then 'AT' else 'DE' end"


def key(k: str) -> str:
    return f"{GTIN.format(k=k)} as gtin, {MARKET.format(k=k)} as market"


view("source")(
    f"""
select concat('source-', cast(n_nationkey as string)) as source_key, n_name as operator,
  case n_regionkey when 0 then 'synthetic' when 1 then 'open-database' when 2 then 'manufacturer'
                   when 3 then 'certifier' else 'retailer-official' end as source_class,
  {array_of("'DE'", "case when n_nationkey % 3 <> 0 then 'AT' end")} as markets,
  {day('2001', 'n_nationkey', 12)} as retrieved_at, concat('snap-', cast(n_nationkey % 3 as string)) as snapshot_id,
  case when n_nationkey % 7 <> 6 then 'ODbL' end as license_identifier,
  case when n_nationkey % 5 <> 4 then concat('data of ', n_name) end as attribution
from {{nation}}
"""
)
view("identity")(
    f"""
select concat('idn-', cast(p_partkey as string)) as id, p_partkey as k, {key('p_partkey')},
  case when p_partkey % 131 = 0 then 'source-99' else concat('source-', cast(p_partkey % 25 as string)) end as source_key,
  concat('rec-', cast(p_partkey as string)) as source_record_id, p_name as name,
  case when p_partkey % 17 = 0 then cast(null as string) else p_brand end as brand,
  concat(cast(p_size as string), ' g') as quantity,
  {array_of("lower(p_type)", "case when p_size % 3 = 0 then 'small-pack' end")} as categories,
  case p_partkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as confidence,
  {day('2000', 'p_partkey', 22)} as retrieved_at,
  case when p_partkey % 4 = 0 then {day('2001', 'p_partkey + 3', 11)} end as source_modified_at
from {{part}}
"""
)
_ING = f"""
  {key('p_partkey')}, concat('source-', cast(p_partkey % 25 as string)) as source_key,
  concat('rec-', cast(p_partkey as string)) as source_record_id, lang as language_code, {day('2000', 'p_partkey', 22)} as retrieved_at,
  case when p_partkey % 6 = 0 then 'ocr' else 'source-text' end as capture_method,
  case when p_partkey % 4 = 0 then 'human-verified' when p_partkey % 4 = 1 then 'machine-assisted' else 'unverified' end as verification_state,
  case when p_partkey % 9 = 0 then cast(p_partkey % 100 as int) end as transformation_percent,
  case when p_partkey % 3 = 0 then concat('rev-', cast(p_partkey as string)) end as source_revision
from {{part}} join {{documents}} on doc_id = p_partkey"""
view("ingredient")(
    f"""
select concat('ing-', cast(p_partkey as string), '-1') as id, p_partkey as k, text as ingredients_text, md5(text) as content_hash,
  case when p_partkey % 7 = 0 then cast(null as string) else {day('2000', 'p_partkey + 5', 22)} end as observed_at,
  cast(null as string) as supersedes_id, {_ING}
union all
select concat('ing-', cast(p_partkey as string), '-2'), p_partkey, concat(text, ' neu'), md5(concat(text, ' neu')),
  {day('2001', 'p_partkey + 1', 9)},
  case when p_partkey % 35 = 0 then 'ing-missing' when p_partkey % 25 = 10 then cast(null as string)
       when p_partkey % 65 = 0 then concat('ing-', cast(p_partkey - 1 as string), '-1')
       else concat('ing-', cast(p_partkey as string), '-1') end, {_ING} where p_partkey % 5 = 0
"""
)
STATUS = """case cast(floor({k} / 3) as int) % 6 when 0 then 'halal-certified' when 1 then 'halal-reviewed' when 2 then 'questionable'
  when 3 then 'not-halal' when 4 then 'unknown' else 'halal-certified' end"""
view("assessment")(
    f"""
select concat('asm-', cast(p_partkey as string)) as id, p_partkey as k, {key('p_partkey')}, {STATUS.format(k='p_partkey')} as status,
  case when p_partkey % 12 = 9 then cast(null as string)
       else concat('ing-', cast(p_partkey as string), case when p_partkey % 30 = 0 then '-2' else '-1' end) end as ingredient_id,
  case when p_partkey % 4 = 1 then '0.9.0' else '1.0.0' end as methodology_version,
  {day('2000', 'p_partkey', 18)} as assessed_at,
  case when p_partkey % 2 = 0 then {day('2001', 'p_partkey + 8', 15)} end as recheck_at
from {{part}} where p_partkey % 3 = 0
"""
)
view("reason")(
    """
select concat('asm-', cast(p_partkey as string)) as assessment_id, cast(n_regionkey as int) as position,
  concat('code-', cast((p_partkey + n_regionkey) % 7 as string)) as code,
  case (p_partkey + n_regionkey * 2) % 4 when 0 then 'positive' when 1 then 'informational' when 2 then 'caution' else 'prohibitive' end as severity,
  case when p_partkey % 77 = 0 then 'idn-missing' else concat('idn-', cast(p_partkey as string)) end as evidence_id
from {part} join {nation} on n_nationkey = p_partkey % 25 where p_partkey % 3 = 0
union all
select concat('asm-', cast(p_partkey as string)), cast(n_regionkey + 1 + p_partkey % 2 as int), 'code-extra',
  case p_partkey % 3 when 0 then 'caution' else 'positive' end, concat('idn-', cast(p_partkey as string))
from {part} join {nation} on n_nationkey = p_partkey % 25 where p_partkey % 6 = 0
"""
)
view("certification")(
    f"""
select concat('crt-', cast(p_partkey as string)) as id, p_partkey as k,
  lpad(cast(case when p_partkey % 63 = 0 then p_partkey + 1 else p_partkey end as string), 14, '0') as gtin, {MARKET.format(k='p_partkey')} as market,
  concat('Certifier ', cast(p_partkey % 5 as string)) as certifier, concat('Scheme ', cast(p_partkey % 2 as string)) as scheme,
  case when p_partkey % 29 = 0 then ' ' else concat('ref-', cast(p_partkey as string)) end as certificate_reference,
  case when p_partkey % 8 = 1 then 'brand' else 'exact-gtin' end as match_basis, 'product' as scope,
  concat('source-', cast(p_partkey % 25 as string)) as source_key, concat('rec-', cast(p_partkey as string)) as source_record_id,
  case when p_partkey % 33 = 0 then cast(null as string) else concat(md5(p_name), md5(p_brand)) end as evidence_hash,
  {day('2001', 'p_partkey', 10)} as last_checked_at, {day('2000', 'p_partkey', 26)} as effective_at,
  case when p_partkey % 11 = 0 then cast(null as string) else {day('2001', 'p_partkey + 4', 24)} end as expiry_at,
  case when p_partkey % 27 = 0 then {day('2001', 'p_partkey', 14)} end as revoked_at,
  case when p_partkey % 24 = 0 then {day('2001', 'p_partkey', 14)} end as suspended_at
from {{part}} where p_partkey % 3 = 0 or p_partkey % 7 = 0
"""
)
view("review")(
    """
select concat('rev-', cast(o_orderkey as string)) as id, 'assessment' as target_type, concat('asm-', cast(o_custkey as string)) as target_id,
  case when o_orderstatus = 'P' and o_orderkey % 11 = 0 then 'rejected' when o_orderkey % 5 = 4 or o_custkey % 4 = 3 then 'pending' else 'approved' end as state,
  concat('reviewer-', cast(o_orderkey % 3 as string)) as reviewer_id,
  concat(substr(cast(o_orderdate as string), 1, 10), 'T09:00:00Z') as reviewed_at
from {orders}
"""
)
view("validity_event")(
    """
select event_id as ordinal, concat('asm-', cast(user_id * 3 as string)) as assessment_id,
  case event_type when 'purchase' then 'restored' when 'view' then 'restored' when 'error' then 'superseded' else 'invalidated' end as kind,
  concat(substr(cast(ts as string), 1, 10), 'T00:00:00Z') as occurred_at
from {events}
"""
)
view("retailer")(
    f"""
select concat('ret:', md5(concat(cast(l_orderkey as string), '/', cast(l_linenumber as string), '/', cast(l_partkey as string), '/', cast(l_suppkey as string), '/', l_returnflag, l_linestatus, substr(cast(l_shipdate as string), 1, 10)))) as id,
  {key('l_partkey')}, concat('retailer-', cast(l_suppkey % 8 as string)) as retailer_key,
  case when l_returnflag = 'R' then 'community-store-report' when l_linenumber = 1 then 'official-listing'
       when l_linestatus = 'F' then 'retailer-feed-listing' else 'retailer-observation' end as kind,
  concat('source-', cast(l_suppkey % 25 as string)) as source_key,
  concat('price:', cast(l_orderkey as string), ';', cast(l_linenumber as string)) as source_record_id,
  case when l_linenumber % 4 = 3 then cast(null as string) else concat(substr(cast(l_shipdate as string), 1, 10), 'T00:00:00Z') end as observed_at,
  case when l_linenumber = 3 then concat(substr(cast(l_shipdate as string), 1, 10), 'T06:00:00Z') end as snapshot_at,
  concat(substr(cast(l_shipdate as string), 1, 10), 'T10:00:00Z') as retrieved_at, l_linenumber as line_number
from {{lineitem}}
group by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate
"""
)
view("image")(
    f"""
select concat('img-', cast(p_partkey as string), '-', purpose) as id, {key('p_partkey')}, purpose,
  concat(case when p_partkey % 50 = 7 then 'http' else 'https' end, '://images.openfoodfacts.org/', cast(p_partkey as string), '/', purpose) as url,
  concat('source-', cast(p_partkey % 25 as string)) as source_key
from {{part}} join (select r_regionkey, case r_regionkey when 0 then 'front' when 1 then 'ingredients' else 'nutrition' end as purpose
                    from {{region}} where r_regionkey < 3) r on r_regionkey <= p_partkey % 3
"""
)
view("selection", "ingredient")(
    f"""
select concat('sel-', cast(p_partkey as string)) as id, p_partkey as k, {key('p_partkey')},
  case when p_partkey % 119 = 0 then concat('idn-', cast(p_partkey + 1 as string)) else concat('idn-', cast(p_partkey as string)) end as identity_id,
  case when p_partkey % 45 = 0 then i.first_id else coalesce(i.last_id, i.first_id) end as ingredient_id,
  case when p_partkey % 3 = 0 then concat('asm-', cast(case when p_partkey % 93 = 0 then p_partkey + 1 else p_partkey end as string)) end as assessment_id,
  {array_of("case when p_partkey % 16 = 0 then 'ingredient-language-conflict' end", "case when p_partkey % 32 = 0 then 'ingredients-missing' end")} as conflict_flags
from {{part}} left join (select k, min(id) as first_id, max(id) as last_id from ingredient group by k) i on i.k = p_partkey
where p_partkey % 13 <> 4
"""
)
view("selection_link", "retailer", "image")(
    """
select concat('sel-', cast(p_partkey as string)) as selection_id, 'certification' as kind, concat('crt-', cast(p_partkey as string)) as ref_id
from {part} where p_partkey % 13 <> 4 and (p_partkey % 18 in (0, 15) or p_partkey % 21 = 0)
union all
select concat('sel-', cast(cast(gtin as bigint) as string)), 'retailer', id from retailer where cast(gtin as bigint) % 13 <> 4 and line_number <> 7
union all
select concat('sel-', cast(cast(gtin as bigint) as string)), 'image', id from image where cast(gtin as bigint) % 13 <> 4
union all
select concat('sel-', cast(p_partkey as string)), 'retailer', 'ret:missing' from {part} where p_partkey % 200 = 1 and p_partkey % 13 <> 4
"""
)
view("assessment_cert")(
    """
select concat('asm-', cast(p_partkey as string)) as assessment_id, concat('crt-', cast(p_partkey as string)) as certification_id
from {part} where p_partkey % 18 in (0, 15)
union all
select concat('asm-', cast(p_partkey as string)), concat('crt-', cast(p_partkey + 4 as string)) from {part} where p_partkey % 36 = 0
"""
)
view("chain")(
    f"""
select concat('n', cast(o_orderkey as string)) as id,
  lpad(cast(cast(floor((o_orderkey + case when o_orderkey % 501 = 3 then 800 else 0 end) / 8) as bigint) as string), 14, '0') as gtin, 'DE' as market,
  case when o_orderkey % 1000 = 0 then concat('n', cast(o_orderkey + 7 as string)) when o_orderkey % 777 = 0 then 'nowhere'
       when o_orderkey % 8 <> 0 then concat('n', cast(o_orderkey - 1 as string)) end as supersedes_id
from {{orders}}
"""
)
