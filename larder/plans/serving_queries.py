"""Demo queries: search, user library, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import barcodes
from larder.functions.stage import once
from larder.operators import health as H
from larder.operators import library as L
from larder.operators import quality as Q
from larder.operators import search as S
from larder.plans import duck
from larder.plans.evidence import ALL, Envelope
from larder.plans.inputs import AS_OF, Inputs, view
from larder.plans.quality_queries import CERT_HEALTH, FACTS, FINDINGS, METRICS, RETAIL_STATE
from larder.plans.registry import query
from larder.plans.states import PREVIOUS, STATE
from larder.plans.states import state as evolution
from larder.operators import state as ST

view("shop_product", "code")(
    f"""
select distinct k, gtin, name, brand from (
  select p_partkey as k, lpad(cast(p_partkey as string), 14, '0') as gtin, case when p_partkey % 5 = 0 then upper(p_name) else p_name end as name,
    case when p_partkey % 17 <> 0 then p_brand end as brand from {{part}}) p
"""
)
view("text_query")(
    """
select concat('q', cast(c_custkey as string)) as query_id,
  case c_custkey % 4 when 0 then concat(substr(p_name, 1, 3), ' brand') when 1 then concat(split_part(p_name, ' ', 2), '  ', substr(p_brand, 7, 1)) when 2 then p_name else substr(split_part(p_name, ' ', 2), 1, 2) end as query,
  cast(5 + c_custkey % 3 as int) as limit, cast(c_custkey % 3 * 4 as int) as offset
from {customer} join {part} on p_partkey = c_custkey
"""
)
_POSTS = """
posts as (select gtin, field, token, count(*) as tf from (
  select gtin, 'name' as field, unnest(string_split_regex(lower(name), '[^a-z0-9]+')) as token from shop_product
  union all select gtin, 'brand', unnest(string_split_regex(lower(brand), '[^a-z0-9]+')) from shop_product where brand is not null) t where token <> '' group by all),
dl as (select gtin, sum(tf) as doc_len from posts group by gtin)"""


@query(
    "search_index", "shop_product",
    f"""{_POSTS} select 'posting' as part, gtin, field, token, tf as n from posts union all select 'length', gtin, '', '', cast(doc_len as bigint) from dl
union all select 'vocabulary', '', cast(length(token) as varchar), token, count(*) from posts group by token""",
)
def search_index(i: Inputs):
    posts = S.postings(i.view("shop_product"))
    none = F.lit("")
    a = posts.select(F.lit("posting").alias("part"), "gtin", "field", "token", F.col("tf").alias("n"))
    b = S.doc_lengths(posts).select(F.lit("length").alias("part"), "gtin", none.alias("field"), none.alias("token"), F.col("doc_len").alias("n"))
    d = posts.groupBy("token").agg(F.count("*").alias("n")).select(
        F.lit("vocabulary").alias("part"), none.alias("gtin"), F.length("token").cast("string").alias("field"), "token", "n"
    )
    return a.unionByName(b).unionByName(d)


@query(
    "text_search", "shop_product text_query",
    f"""{_POSTS},
qt0 as (select query_id, unnest(list_filter(string_split_regex(lower(query), '[^a-z0-9]+'), lambda t: t <> '')) as qtoken from text_query),
qt as (select query_id, qtoken, count(*) as times, count(*) over (partition by query_id) as terms from qt0 group by query_id, qtoken),
hits as (select n.qtoken, p.gtin, sum(p.tf * case p.field when 'name' then 4.0 else 2.0 end) as freq from (select distinct qtoken from qt) n join posts p on starts_with(p.token, n.qtoken) group by n.qtoken, p.gtin),
df as (select qtoken, count(*) as df from hits group by qtoken), st as (select count(*) as n, avg(doc_len) as al from dl),
sc as (select h.qtoken, h.gtin, greatest(ln((st.n - df.df + 0.5) / (df.df + 0.5)), 1e-6) * h.freq * 2.2 / (h.freq + 1.2 * (0.25 + 0.75 * dl.doc_len / st.al)) as score
  from hits h join df on df.qtoken = h.qtoken join dl on dl.gtin = h.gtin, st),
r as (select q.query_id, s.gtin, sum(s.score * q.times) as score from qt q join sc s on s.qtoken = q.qtoken group by q.query_id, s.gtin, q.terms having count(*) = q.terms),
k as (select r.*, p.name, row_number() over (partition by r.query_id order by round(r.score, 9) desc, lower(p.name), r.gtin) as rank, count(*) over (partition by r.query_id) as total from r join shop_product p on p.gtin = r.gtin)
select k.query_id, k.gtin, k.name, k.rank, k.total > q."offset" + q."limit" as has_more from k join text_query q on q.query_id = k.query_id where k.rank > q."offset" and k.rank <= q."offset" + q."limit" """,
)
def text_search(i: Inputs):
    products = i.view("shop_product")
    page = S.text_search(i.view("text_query"), products, S.postings(products))
    return page.select("query_id", "gtin", "name", F.col("rank").cast("long").alias("rank"), "has_more")


view("barcode_query", "code")(
    """
select concat('b', cast(k as string)) as query_id, case k % 3 when 0 then substr(code, 1, 6) when 1 then code else substr(code, 1, 9) end as prefix, cast(3 + k % 4 as int) as limit, cast(k % 2 * 2 as int) as offset
from code where length(code) between 1 and 14
"""
)


@query(
    "barcode_prefix_search", "code barcode_query",
    f"""
p as (select k, code, {duck.gtin('code')} as gtin, 'Product ' || (k % 10) as name from code), g as (select gtin, min(name) as name from p where gtin is not null group by gtin),
al as (select gtin, name, unnest(list_filter([gtin, case when starts_with(gtin, '0') then substr(gtin, 2) end, case when starts_with(gtin, '00') then substr(gtin, 3) end,
   case when starts_with(gtin, '000000') then substr(gtin, 7) end], lambda x: x is not null)) as alias from g),
m as (select q.query_id, q."limit" as lim, q."offset" as off, a.gtin, min(a.name) as name, min(case when a.alias = q.prefix then 0 else 1 end) as exact_rank, min(length(a.alias)) as alias_length, min(a.alias) as best_alias
  from barcode_query q join al a on a.alias >= q.prefix and a.alias < q.prefix || ':' group by q.query_id, q."limit", q."offset", a.gtin),
r as (select *, row_number() over (partition by query_id order by exact_rank, alias_length, best_alias, lower(name), gtin) as rank, count(*) over (partition by query_id) as total from m)
select query_id, gtin, exact_rank, best_alias, rank, total > off + lim as has_more from r where rank > off and rank <= off + lim""",
)
def barcode_prefix_search(i: Inputs):
    coded = once(i.view("code"), gtin=barcodes.gtin14(F.col("code"))).filter("gtin is not null")
    products = coded.groupBy("gtin").agg(F.min(F.concat(F.lit("Product "), (F.col("k") % 10).cast("string"))).alias("name"))
    aliases = products.select("gtin", F.explode(barcodes.aliases(F.col("gtin"))).alias("alias"))
    page = S.barcode_search(i.view("barcode_query"), aliases, products)
    return page.select("query_id", "gtin", "exact_rank", "best_alias", F.col("rank").cast("long").alias("rank"), "has_more")


view("search_request", "code")(
    """
select l_orderkey * 8 + l_linenumber as request_id, case (l_orderkey + l_linenumber) % 7 when 0 then concat('  ', code, ' ') when 1 then p_name when 2 then substr(code, 1, 5) when 3 then '   '
    when 4 then concat(repeat(p_name, 30), 'x') when 5 then '?? --' else concat(p_name, chr(9), p_brand) end as query,
  cast(case when l_linenumber = 7 then 60 else 20 end as int) as limit, cast(case when l_suppkey % 20 = 9 then -1 else 0 end as int) as offset
from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey from {lineitem}) l join {part} on p_partkey = l_partkey join code on k = l_partkey
"""
)


@query(
    "search_request_route", "search_request",
    f"""
t as (select *, trim(regexp_replace(query, '\\s+', ' ', 'g')) as q from search_request),
d as (select *, regexp_replace(q, '[\\s-]', '', 'g') as digits from t),
g as (select *, {duck.gtin('digits')} as plain from d),
u as (select *, case when length(digits) = 8 and plain is null and regexp_full_match(digits, '[01][0-9]{{7}}') then {duck.gtin('''(case
   when substr(digits, 7, 1) in ('0', '1', '2') then concat(substr(digits, 1, 3), substr(digits, 7, 1), '0000', substr(digits, 4, 3))
   when substr(digits, 7, 1) = '3' then concat(substr(digits, 1, 4), '00000', substr(digits, 5, 2))
   when substr(digits, 7, 1) = '4' then concat(substr(digits, 1, 5), '00000', substr(digits, 6, 1))
   else concat(substr(digits, 1, 6), '0000', substr(digits, 7, 1)) end || right(digits, 1))''')} end as upc from g),
r as (select *, coalesce(plain, upc, digits) as code from u),
o as (select *, case when length(q) > 160 then 'error:query-too-long' when "limit" not between 1 and 50 then 'error:invalid-page-size' when "offset" < 0 then 'error:invalid-offset'
   when q = '' then 'empty' when regexp_full_match(code, '[0-9]{{1,14}}') then 'barcode' when not regexp_matches(q, '[A-Za-z0-9]') then 'empty' else 'text' end as route from r)
select request_id, route, case route when 'barcode' then code when 'text' then q end as target from o""",
)
def search_request_route(i: Inputs):
    return S.route(i.view("search_request"), 160, 50).select("request_id", "route", "target")


@query(
    "paginate", "",
    """
o as (select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) as rank from orders)
select o_orderkey, rank, (select count(*) from orders) > 75 as has_more from o where rank > 50 and rank <= 75""",
)
def paginate(i: Inputs):
    orders = i.table("orders").select("o_orderkey", "o_totalprice")
    page = S.paginate(orders, [F.desc("o_totalprice"), F.col("o_orderkey")], 25, 50)
    return page.select("o_orderkey", F.col("rank").cast("long").alias("rank"), "has_more")


view("scan_event")(
    """
select event_id as id, case when event_id % 3 = 0 then cast(1 as bigint) else user_id end as user_id, 'DE' as market, lpad(cast(event_id % 177 as string), 14, '0') as gtin,
  concat(substr(cast(ts as string), 1, 10), 'T00:00:00Z') as scanned_at, event_type in ('purchase', 'view') as is_favorite, concat('v', cast(event_id % 3 as string)) as catalog_version from {events}
"""
)
view("user_setting")("select user_id, user_id % 4 <> 3 as history_enabled from {events} group by user_id")


@query(
    "history_retention", "scan_event user_setting",
    """select user_id, id, gtin, scanned_at, position from (select s.*, row_number() over (partition by s.user_id order by scanned_at desc, id desc) as position
  from scan_event s where user_id in (select user_id from user_setting where history_enabled)) x where position <= 200""",
)
def history_retention(i: Inputs):
    rows = L.retained_history(i.view("scan_event"), i.view("user_setting"))
    return rows.select("user_id", "id", "gtin", "scanned_at", F.col("position").cast("long").alias("position"))


@query(
    "favorites_list", "scan_event",
    """select user_id, market, gtin, scanned_at as saved_at, catalog_version from (
  select *, row_number() over (partition by user_id, market, gtin order by scanned_at desc, id desc) as rn from scan_event) x where rn = 1 and is_favorite""",
)
def favorites_list(i: Inputs):
    return L.favorites(i.view("scan_event").withColumnRenamed("scanned_at", "saved_at"))


_FINGERPRINT = """
ch as (select gtin, market, count(*) as n, sum(cast(cast('0x' || left(sha256('{"id":' || to_json(id) || ',"purpose":' || to_json(purpose) || ',"url":' || to_json(url) || '}'), 15) as ubigint) as hugeint)) as s from image group by gtin, market),
fp as (select d.gtin, d.market, sha256(concat_ws('|', '{"brand":' || coalesce(to_json(brand), 'null') || ',"name":' || to_json(name) || ',"quantity":' || to_json(quantity) || '}', cast(coalesce(ch.n, 0) as varchar), cast(coalesce(ch.s, 0) as varchar))) as fingerprint
  from identity d left join ch on ch.gtin = d.gtin and ch.market = d.market)"""


def fingerprints(i: Inputs):
    return L.fingerprints(i.view("identity"), ["name", "brand", "quantity"], i.view("image"), ["id", "purpose", "url"])


@query("record_fingerprint", "identity image", f"{_FINGERPRINT} select * from fp")
def record_fingerprint(i: Inputs):
    return fingerprints(i)


view("saved_item")(
    """
select c_custkey as id, lpad(cast(case when c_custkey % 6 = 5 then c_custkey + 1000000 else c_custkey end as string), 14, '0') as gtin,
  case when c_custkey % 10 = 1 then 'AT' else 'DE' end as market, c_custkey % 4 <> 1 as was_present, case when c_custkey % 3 = 0 then md5(c_name) end as override from {customer}
"""
)


@query(
    "saved_item_status", "identity image saved_item",
    f"""{_FINGERPRINT},
s as (select v.*, case when was_present then coalesce(override, f.fingerprint, md5('gone')) end as fingerprint, f.fingerprint as now from saved_item v left join fp f on f.gtin = v.gtin and f.market = v.market)
select id, gtin, market, case when was_present and now is null then 'no-longer-present' when not was_present and now is not null then 'now-available'
  when fingerprint is not distinct from now then 'unchanged' else 'changed' end as state from s""",
)
def saved_item_status(i: Inputs):
    current = fingerprints(i)
    saved = i.view("saved_item").join(current.withColumnRenamed("fingerprint", "_now"), ["gtin", "market"], "left")
    stored = F.when(F.col("was_present"), F.coalesce("override", "_now", F.md5(F.lit("gone"))))
    rows = L.saved_status(saved.withColumn("fingerprint", stored).drop("_now"), current)
    return rows.select("id", "gtin", "market", "state")


view("module")(
    """
select n_name as market, concat('module-', cast(n_nationkey as string)) as module_id, n_nationkey % 3 = 0 as downloaded, n_nationkey % 2 = 0 as bundled from {nation}
"""
)


@query(
    "market_routing", "module",
    """
m as (select market, module_id, 'downloaded' as origin from module where downloaded union all select market, 'bundle', 'bundled' from module b where bundled and not downloaded)
select n.market, m.module_id, coalesce(m.origin, 'unavailable') as origin from module n left join m on m.market = n.market""",
)
def market_routing(i: Inputs):
    modules = i.view("module")
    downloaded = modules.filter("downloaded").select("market", "module_id")
    bundled = modules.filter("bundled").select("market", F.lit("bundle").alias("module_id"))
    return L.market_sources(modules.select("market"), downloaded, bundled)


# --- health -------------------------------------------------------------------------------------
_CLASS = """case when kind in ('official-feed', 'official-listing', 'official-product-listing') then 'official' when contains(kind, 'community') then 'community'
  when contains(kind, 'observation') then 'observational' else 'other' end"""


@query("retailer_evidence_class", "retailer", f"select kind, {_CLASS} as class, count(*) as n from retailer group by all")
def retailer_evidence_class(i: Inputs):
    return i.view("retailer").groupBy("kind", H.evidence_class(F.col("kind")).alias("class")).agg(F.count("*").alias("n"))


@query(
    "health_breakdown", ALL,
    f"""{FACTS}, c as (select 'market' as dimension, market as key from facts union all select 'status', coalesce(status, 'unassessed') from facts
  union all select 'brand', brand from facts where coalesce(brand, '') <> '' union all select 'language', language_code from facts where has_text
  union all select 'conflicted', '' from facts where flagged union all select 'category', unnest(categories) from facts)
select dimension, key, count(*) as n from c group by all
union all select 'source', coalesce(ingredient_source, identity_source), count(distinct gtin || '/' || market) from facts where coalesce(ingredient_source, identity_source) is not null group by 2""",
)
def health_breakdown(i: Inputs):
    return H.breakdown(Q.selection_facts(Envelope(i), AS_OF))


view("coverage_gate")(
    """
select concat('retailer-', cast(n_nationkey as string)) as retailer_key, case when n_nationkey % 5 = 4 then 'fail' else 'pass' end as gate_state,
  case when n_nationkey % 3 = 2 then 'partial' else 'official-complete-snapshot' end as claim_state, n_nationkey <> 3 as reconciled, cast(100 + n_nationkey as bigint) as denominator,
  concat('snap-', cast(n_nationkey as string)) as snapshot_id from {nation}
"""
)


@query(
    "retailer_claims", f"{ALL} coverage_gate",
    f"""
lk as (select r.*, {_CLASS} as class from retailer r where id in (select ref_id from selection_link where kind = 'retailer') and cast(gtin as bigint) % 3 = 0),
per as (select retailer_key, count(*) filter (where class = 'official') as official, count(*) filter (where class = 'observational') as observational,
   count(*) filter (where class = 'community') as community, count(*) filter (where class = 'other') as other, max(greatest(observed_at, retrieved_at)) as latest_evidence_at from lk group by retailer_key),
ag as (select retailer_key, count(*) filter (where {RETAIL_STATE} in ('stale', 'date-unknown')) as aged from retailer where retailer_key not in ('retailer-0', 'retailer-1') group by retailer_key),
gt as (select * from coverage_gate where gate_state = 'pass' and claim_state = 'official-complete-snapshot' and reconciled),
nm as (select retailer_key from per union select unnest(['rewe', 'lidl'])),
j as (select nm.retailer_key, coalesce(official, 0) as official, coalesce(observational, 0) as observational, coalesce(community, 0) as community, coalesce(other, 0) as other, latest_evidence_at,
   coalesce(aged, 0) as aged, gt.denominator, gt.snapshot_id from nm left join per using (retailer_key) left join ag using (retailer_key) left join gt using (retailer_key)),
c as (select *, case when aged > 0 and official > 0 then 'degraded' when official > 0 and snapshot_id is not null then 'official-complete-snapshot' when official > 0 then 'official-partial'
   when observational > 0 then 'observational-partial' when community > 0 then 'community-only' else 'no-evidence' end as claim from j)
select retailer_key, claim, cast(case when claim = 'official-complete-snapshot' then denominator end as varchar) as denominator, case when claim = 'official-complete-snapshot' then snapshot_id end as snapshot_id,
  official, observational, community, other, latest_evidence_at from c""",
)
def retailer_claims(i: Inputs):
    rows = i.view("retailer")
    links = i.view("selection_link").filter("kind = 'retailer'").select(F.col("ref_id").alias("id"))
    linked = rows.join(links, "id", "left_semi").filter("cast(gtin as bigint) % 3 = 0")
    audited = rows.filter("retailer_key not in ('retailer-0', 'retailer-1')")
    claims = H.retailer_claims(linked, audited, i.view("coverage_gate"), AS_OF)
    return claims.withColumn("denominator", F.col("denominator").cast("string"))


@query(
    "certificate_rollup", ALL,
    f"""
l as (select distinct ref_id from selection_link where kind = 'certification')
select {CERT_HEALTH} as state, count(*) as n from certification where id in (select ref_id from l) group by 1
union all select '<unmatched>', count(*) from certification where id not in (select ref_id from l)""",
)
def certificate_rollup(i: Inputs):
    return H.certificate_rollup(i.view("certification"), i.view("selection_link"), AS_OF)


view("component")(
    """
select concat('source-', cast(n_nationkey as string)) as source_key, n_nationkey * 3 as warning_count, case when n_nationkey % 8 = 7 then 1 else 0 end as blocker_count,
  case when n_nationkey % 6 <> 5 then 'ODbL' end as license_identifier, case when n_nationkey % 9 <> 8 then n_name end as attribution,
  case when n_nationkey % 7 = 6 then 'pending' else 'approved' end as terms_state, concat('terms-', cast(n_nationkey % 2 as string)) as terms_version from {nation}
"""
)


@query(
    "merge_component_quality", f"{ALL} component",
    """
att as (select ref_id as id from selection_link where kind = 'retailer'), av as (select id from retailer where line_number <> 4)
select 'warnings' as metric, source_key as key, cast(warning_count as varchar) as value from component union all select 'blockers', source_key, cast(blocker_count as varchar) from component
union all select 'license', source_key, coalesce(license_identifier, '<missing>') from component union all select 'attribution', source_key, cast(attribution is not null as varchar) from component
union all select 'passing', source_key, cast(blocker_count = 0 and attribution is not null and terms_state = 'approved' as varchar) from component
union all select 'retailer', 'available', cast(count(distinct id) as varchar) from av union all select 'retailer', 'matched', cast(count(distinct id) as varchar) from av where id in (select id from att)
union all select 'retailer', 'unmatched', cast(count(distinct id) as varchar) from av where id not in (select id from att)
union all select 'aggregate', 'warnings', cast(cast(sum(warning_count) as bigint) as varchar) from component union all select 'aggregate', 'attributed', cast(bool_and(attribution is not null) as varchar) from component
union all select 'aggregate', 'terms-version', case when count(distinct terms_version) = 1 then max(terms_version) else 'multiple' end from component""",
)
def merge_component_quality(i: Inputs):
    attached = i.view("selection_link").filter("kind = 'retailer'").select(F.col("ref_id").alias("id"))
    return H.merge_component_quality(i.view("component"), i.view("retailer").filter("line_number <> 4").select("id"), attached)


@query(
    "incident_rollup", ALL,
    f"""{FINDINGS},
b as (select distinct f.identity_source as source_key, d.code from found d join facts f on f.gtin = d.gtin and f.market = d.market where d.severity = 'blocker' and f.identity_source is not null),
a as (select source_key, case when bool_or(code in {tuple(Q.ROLLBACK)}) then 'rollback-and-quarantine' when bool_or(code in {tuple(Q.QUARANTINE)}) then 'quarantine' else 'block-release' end as action from b group by source_key)
select b.source_key, b.code, a.action, 'catalog-health-' || b.code || '-' || b.source_key || '-' || left(sha256('{{"condition":"' || b.code || '","sourceKey":"' || b.source_key || '"}}'), 12) as incident_key, 'P0' as priority
from b join a on a.source_key = b.source_key""",
)
def incident_rollup(i: Inputs):
    e = Envelope(i)
    facts = Q.selection_facts(e, AS_OF).select("gtin", "market", F.col("identity_source").alias("source_key")).filter("source_key is not null")
    blockers = Q.findings(e, AS_OF).filter("severity = 'blocker'").join(facts, ["gtin", "market"])
    return H.incidents(blockers).select("source_key", "code", "action", "incident_key", "priority")


_CHANGES = f"""
chg as (select case when content_hash <> prev_hash then 'formulation-changed' when prev_selection_id is not null then 'unchanged' else 'added' end as change from state
  union all select 'removed' from previous_selection p where not exists (select 1 from selected_now c where c.gtin = p.gtin and c.market = p.market))"""


@query(
    "release_review_summary", f"{ALL} {PREVIOUS}",
    f"""{METRICS}, {STATE}, {_CHANGES}
select 'distribution:' || metric as section, key, cast(n as varchar) as value from metrics
union all select 'comparison', change, cast(count(*) as varchar) from chg group by change""",
)
def release_review_summary(i: Inputs):
    changes = ST.change_summary(evolution(i), i.view("previous_selection"), complete=True)
    return H.release_review(Q.metrics(Envelope(i), AS_OF), changes, baseline=True)
