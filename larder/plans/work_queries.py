"""Demo queries: refresh work, producers, submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import text
from larder.operators import health as H
from larder.operators import producers as P
from larder.operators import quality as Q
from larder.operators import refresh as R
from larder.operators import submissions as U
from larder.plans import duck
from larder.plans.evidence import ALL, Envelope
from larder.plans.inputs import AS_OF, Inputs, array_of, view
from larder.plans.quality_queries import AT, FINDINGS, fresh, ts
from larder.plans.registry import query
from larder.policy import PRODUCER_FIELDS

view("pending_change")(
    """
select lpad(cast(p_partkey as string), 14, '0') as gtin, case when p_partkey % 10 = 1 then 'AT' else 'DE' end as market,
  case when p_partkey % 2 = 0 then 'formulation-changed' else 'ingredient-field-deleted' end as reason, concat('chg-', cast(p_partkey as string)) as evidence_id
from {part} where p_partkey % 14 = 3
union all
select lpad(cast(p_partkey as string), 14, '0'), 'CH', 'formulation-changed', concat('dup-', cast(p_partkey as string)) from {part} where p_partkey % 70 = 3
"""
)
SOON = f"{AT} + interval 30 day"
_AGE = fresh("ing_observed_at", 9, 12)
QUEUE = f"""{FINDINGS},
cl as (select f.gtin, f.market, c.id, coalesce({ts('c.revoked_at')} <= {AT}, false) or coalesce({ts('c.suspended_at')} <= {AT}, false) or coalesce({ts('c.expiry_at')} < {AT}, false) as ended, c.expiry_at, c.last_checked_at
  from selection_link l join facts f on f.selection_id = l.selection_id join certification c on c.id = l.ref_id where l.kind = 'certification'),
ent as (select 'missing-current-ingredients' as reason, 'high' as priority, gtin, market, null as evidence_id from facts where not has_text
  union select 'date-unknown-ingredients', 'high', gtin, market, ingredient_id from facts where has_text and {_AGE} = 'date-unknown'
  union select 'stale-ingredients', 'high', gtin, market, ingredient_id from facts where has_text and {_AGE} = 'stale'
  union select 'refresh-recommended-ingredients', 'medium', gtin, market, ingredient_id from facts where has_text and {_AGE} = 'refresh-recommended'
  union select 'identity-or-formulation-conflict', 'high', gtin, market, selection_id from facts where flagged
  union select 'assessment-recheck', 'high', f.gtin, f.market, f.assessment_id from facts f join assessment a on a.id = f.assessment_id where {ts('a.recheck_at')} <= {SOON}
  union select 'ambiguous-review', 'medium', gtin, market, assessment_id from facts where status in ('questionable', 'unknown')
  union select 'certification-invalidated', 'high', gtin, market, id from cl where ended
  union select 'certification-expiry', 'high', gtin, market, id from cl where not ended and {ts('expiry_at')} <= {SOON}
  union select 'certification-recheck', 'medium', gtin, market, id from cl where {ts('last_checked_at')} + interval 30 day <= {AT}
  union select 'changed-unreviewed', 'high', gtin, market, evidence_id from pending_change
  union select 'source-or-quality-blocker', 'high', null, null, code from found where severity = 'blocker'),
keyed as (select concat_ws(':', reason, coalesce(market, '-'), coalesce(gtin, '-'), coalesce(evidence_id, '-')) as key, * from ent),
ranked as (select *, row_number() over (order by case priority when 'high' then 0 when 'medium' then 1 else 2 end, reason, coalesce(market, ''), coalesce(gtin, ''), key) as rn from keyed),
queue as (select key, reason, priority, market, gtin, evidence_id from ranked)"""
VIEWS = f"{ALL} pending_change"


def due(i: Inputs):
    e = Envelope(i)
    blockers = Q.findings(e, AS_OF).filter("severity = 'blocker'").select("code").distinct()
    return R.due_work(e, i.view("pending_change").select("gtin", "market", "evidence_id"), blockers, AS_OF)


@query("refresh_queue", VIEWS, f"{QUEUE} select * from queue")
def refresh_queue(i: Inputs):
    return due(i)


@query(
    "queue_summary", VIEWS,
    f"""{QUEUE} select 'reason' as metric, reason as key, count(*) as n from queue group by reason union all select 'priority', priority, count(*) from queue group by priority
union all select 'entries', '', count(*) from queue
union all select 'incident-reason', reason, count(*) from queue where reason in {tuple(H.INCIDENT_REASONS)} group by reason""",
)
def queue_summary(i: Inputs):
    return H.queue_summary(due(i))


@query(
    "target_batches", VIEWS,
    f"""{QUEUE}, g as (select gtin, row_number() over (order by gtin) as rn from (select distinct gtin from queue where reason in {tuple(R.TARGET_REASONS)} and regexp_full_match(gtin, '[0-9]{{14}}')) d)
select cast((rn - 1) // 40 as bigint) as batch, string_agg(gtin, ',' order by gtin) as gtins, cast((rn - 1) // 40 * 7 as bigint) as starts_after_seconds from g group by (rn - 1) // 40""",
)
def target_batches(i: Inputs):
    return R.target_batches(due(i)).withColumn("gtins", F.array_join("gtins", ","))


_TARGETS = """
tg as (select distinct market, gtin from (select market, gtin from identity where k % 9 = 2 union all select market, gtin from ingredient where k % 8 = 1 union all select market, gtin from certification where k % 5 = 1) u),
te as (select concat_ws(':', 'admitted-submission', market, gtin, '-') as key, 'admitted-submission' as reason, 'high' as priority, market, gtin, cast(null as varchar) as evidence_id from tg)"""


def targets(i: Inputs):
    return R.submission_targets(
        i.view("identity").filter("k % 9 = 2"), i.view("ingredient").filter("k % 8 = 1"), i.view("certification").filter("k % 5 = 1")
    )


@query("submission_targets", "identity ingredient certification", f"{_TARGETS} select * from te")
def submission_targets(i: Inputs):
    return targets(i)


@query(
    "merge_queues", VIEWS,
    f"""{QUEUE}, {_TARGETS}, later as (select * from te union all select key, reason, 'low', market, gtin, 'replaced' from queue where reason = 'ambiguous-review'),
u as (select * from later union all select * from queue q where not exists (select 1 from later l where l.key = q.key))
select key, reason, priority, market, gtin, evidence_id from (select *, row_number() over (order by case priority when 'high' then 0 when 'medium' then 1 else 2 end, reason, coalesce(market, ''), coalesce(gtin, ''), key) as rn from u) x""",
)
def merge_queues(i: Inputs):
    queue = due(i)
    again = queue.filter("reason = 'ambiguous-review'").withColumn("priority", F.lit("low")).withColumn("evidence_id", F.lit("replaced"))
    return R.merge_queues(queue, targets(i).unionByName(again))


view("attempt")(
    """
select event_id as ordinal, concat('source-', cast(case when event_id % 3 = 0 then 0 else user_id % 20 end as string)) as source_key, concat('snap-', cast(event_id as string)) as snapshot_id,
  case when event_type = 'click' then 'sample' else 'full' end as mode, value < 80 as download_complete, case when event_type = 'error' then 'blocked' else 'pass' end as quality_status, value > 60 and value < 65 as has_blockers,
  concat(substr(cast(ts as string), 1, 10), 'T00:00:00Z') as retrieved_at, md5(cast(floor(value / 20) as string)) as content_sha256,
  cast(floor(value / 40) as bigint) as record_count, '1.0.0' as adapter_version, md5(event_type) as policy_sha256 from {events}
"""
)
LEDGER = """
a as (select *, download_complete and mode = 'full' as complete, download_complete and mode = 'full' and quality_status = 'pass' and not has_blockers as eligible,
   concat_ws('|', content_sha256, record_count, adapter_version, policy_sha256) as content from attempt),
b as (select *, last_value(case when eligible then content end ignore nulls) over (partition by source_key order by retrieved_at, ordinal rows between unbounded preceding and 1 preceding) as acc from a),
c as (select *, eligible and acc is distinct from content as candidate from b),
d as (select *, last_value(case when candidate then snapshot_id end ignore nulls) over w as accepted_snapshot_id,
   coalesce(case when complete and quality_status = 'pass' then retrieved_at end, last_value(case when complete and quality_status = 'pass' then retrieved_at end ignore nulls) over w) as last_success_at from c
  window w as (partition by source_key order by retrieved_at, ordinal rows between unbounded preceding and 1 preceding)),
ledger as (select source_key, ordinal, snapshot_id, case when complete then 'complete' else 'partial' end as status, eligible, candidate, accepted_snapshot_id, last_success_at,
   coalesce(strftime(try_cast(replace(last_success_at, 'Z', '') as timestamp) + interval 7 day, '%Y-%m-%dT%H:%M:%SZ'), retrieved_at) as next_full_due_at, eligible as deletions_allowed from d)"""


@query("refresh_ledger", "attempt", f"{LEDGER} select * from ledger")
def refresh_ledger(i: Inputs):
    return R.ledger(i.view("attempt"))


view("source_plan")(
    f"""
select concat('source-', cast(n_nationkey as string)) as source_key, case n_nationkey % 3 when 0 then 'auto' when 1 then 'full' else 'targeted' end as lane,
  {array_of("'full'", "case when n_nationkey % 2 = 0 then 'delta' end")} as modes, case when n_nationkey % 12 <> 0 then concat('c', n_name) end as cursor,
  case when n_nationkey % 18 = 0 then '2024-01-01T00:00:00Z' when n_nationkey % 6 = 0 then '2025-01-01T00:00:00Z' end as cursor_expires_at from {{nation}}
"""
)
PLAN_AT = "2024-02-02T00:00:00Z"


@query(
    "refresh_plan", "attempt source_plan",
    f"""{LEDGER}, ls as (select * from ledger qualify row_number() over (partition by source_key order by ordinal desc) = 1),
j as (select p.*, l.* exclude (source_key), case when lane = 'auto' then case when not list_contains(modes, 'delta') then 'delta-not-admitted' when accepted_snapshot_id is null then 'delta-missing-accepted-predecessor'
    when coalesce(trim("cursor"), '') = '' then 'delta-missing-cursor' when {ts('cursor_expires_at')} <= timestamp '2024-02-02 00:00:00' then 'delta-cursor-expired' end end as fallback_reason
  from source_plan p left join ls l on l.source_key = p.source_key)
select source_key, lane, case when lane = 'targeted' then 'targeted' when lane = 'auto' and fallback_reason is null then 'delta' else 'full' end as mode, fallback_reason,
  case when last_success_at is null then 'no-successful-full-acquisition' when timestamp '2024-02-02 00:00:00' >= {ts('next_full_due_at')} then 'full-cadence-due' else 'full-cadence-not-due' end as due_reason,
  coalesce(next_full_due_at, '{PLAN_AT}') as full_due_at, accepted_snapshot_id from j""",
)
def refresh_plan(i: Inputs):
    return R.plan(i.view("source_plan"), R.latest_state(R.ledger(i.view("attempt"))), PLAN_AT)


# --- producers ----------------------------------------------------------------------------------
view("producer_raw")(
    f"""
select p_partkey as k, concat('rec-', cast(p_partkey as string)) as source_record_id, case when p_partkey % 6 = 0 then cast(null as string) when p_partkey % 7 = 0 then '  ' else concat(' org-', p_brand) end as owner,
  case when p_partkey % 5 <> 0 then p_name else ' ' end as of_name, case when p_partkey % 4 = 0 then text when p_partkey % 4 = 1 then text || '!' end as of_text,
  cast(p_partkey % 21 as int) as n_sources, {array_of("case when p_partkey % 3 = 0 then 'producers' end", "case when p_partkey % 9 = 0 then 'app' end")} as data_sources_tags, text, lang
from {{part}} left join {{documents}} on doc_id = p_partkey
"""
)


def producer_records(i: Inputs):
    """Raw producer metadata with its nested columns, as the JSON scan yields them."""
    k, c = F.col("k"), F.col
    fields = F.map_filter(
        F.create_map(F.lit("product_name"), c("of_name"), F.lit("ingredients_text"), c("of_text"), F.lit("secret_field"), c("of_name")),
        lambda _, v: v.isNotNull(),
    )
    steps = F.when(c("n_sources") > 0, F.sequence(F.lit(0), c("n_sources") - 1)).otherwise(F.array().cast("array<int>"))
    source = lambda j: F.struct(
        F.when((k + j) % 11 == 0, " ").otherwise(F.concat(F.lit("src-"), ((k + j) % 9).cast("string"))).alias("id"),
        F.concat(F.lit("name "), j.cast("string")).alias("name"),
        F.when((k + j) % 3 != 0, "Yes").otherwise("0").alias("manufacturer"),
        F.when((k + j) % 4 != 0, F.array(F.lit("ingredients_text"), F.lit("unknown"))).otherwise(F.array(F.lit("nope"))).alias("fields"),
        F.when(j % 5 == 0, F.lit(0)).otherwise(1600000000 + j * 86400).cast("long").alias("import_t"),
        F.lit("CC0").alias("source_licence"),
        F.when(j % 2 == 0, "https://example.org/l").otherwise("http://example.org/l").alias("source_licence_url"),
    )
    return i.view("producer_raw").withColumn("owner_fields", fields).withColumn("sources", F.transform(steps, source))


_PROVENANCE = """
src0 as (select source_record_id, k, unnest(range(n_sources)) as j from producer_raw),
src1 as (select source_record_id, j, case when (k + j) % 11 = 0 then '' else 'src-' || ((k + j) % 9) end as sid, 'name ' || j as sname,
   case when j % 5 <> 0 then strftime(make_timestamp((1600000000 + j * 86400) * 1000000), '%Y-%m-%dT%H:%M:%SZ') end as imported_at, case when j % 2 = 0 then 'https://example.org/l' end as url,
   (k + j) % 3 <> 0 and (k + j) % 4 <> 0 and (k + j) % 11 <> 0 as ok from src0),
src2 as (select *, row_number() over (partition by source_record_id order by j) as rn from src1 where ok),
src as (select * from src2),
prov as (select r.*, case when trim(r.owner) <> '' then trim(r.owner) end as own, case when trim(of_text) <> '' then sha256(of_text) end as text_hash, case when trim(of_name) <> '' then sha256(of_name) end as name_hash,
   s.sources, coalesce(s.ids, []) as sids from producer_raw r left join (select source_record_id, string_agg(sid || '/' || sname || '@' || coalesce(imported_at, '-') || coalesce(url, '-'), '|' order by sid, sname) as sources, list(distinct sid) as ids
   from src group by source_record_id) s on s.source_record_id = r.source_record_id)"""


@query(
    "producer_provenance", "producer_raw",
    f"""{_PROVENANCE} select source_record_id, own as owner, concat_ws('|', 'ingredients_text=' || text_hash, 'product_name=' || name_hash) as owner_hashes, coalesce(sources, '') as sources,
  coalesce(array_to_string(list_sort(data_sources_tags), '|'), '') as tags from prov""",
)
def producer_provenance(i: Inputs):
    rows = P.sanitize(producer_records(i))
    hashes = F.array_sort(F.transform(F.map_entries("owner_hashes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    dash = lambda v: F.coalesce(v, F.lit("-"))
    sources = F.transform(
        "manufacturer_sources", lambda s: F.concat(s["source_id"], F.lit("/"), s["source_name"], F.lit("@"), dash(s["imported_at"]), dash(s["licence_url"]))
    )
    return rows.select(
        "source_record_id", "owner", F.array_join(hashes, "|").alias("owner_hashes"), F.array_join(sources, "|").alias("sources"),
        F.coalesce(F.array_join("data_source_tags", "|"), F.lit("")).alias("tags"),
    )


PRODUCER_VIEWS = "selection ingredient producer_raw pending_change"
_VERDICT = f"""{_PROVENANCE},
ps as (select s.gtin, s.market, 'rec-' || s.k as source_record_id, s.ingredient_id, s.conflict_flags, g.ingredients_text, g.id as gid from selection s left join ingredient g on g.id = s.ingredient_id),
vd as (select ps.gtin, ps.market, ps.source_record_id, ps.ingredient_id, p.own as owner,
   case when ps.gid is not null and p.text = ps.ingredients_text then case when p.own is not null and p.text_hash = sha256(ps.ingredients_text) then 'confirmed'
     when coalesce(p.text_hash <> sha256(ps.ingredients_text), false) or len(p.sids) > 1 then 'ambiguous'
     when len(p.sids) > 0 or len(coalesce(p.data_sources_tags, [])) > 0 or p.own is not null then 'candidate' end end as verdict
  from ps join prov p on p.source_record_id = ps.source_record_id where ps.gid is not null)"""


def _producer_inputs(i: Inputs):
    ing = i.view("ingredient").select(F.col("id").alias("ingredient_id"), "ingredients_text", "language_code")
    sel = i.view("selection").withColumn("source_record_id", F.concat(F.lit("rec-"), F.col("k").cast("string")))
    sel = sel.select("gtin", "market", "source_record_id", "ingredient_id", "conflict_flags")
    raw = producer_records(i)
    records = raw.select("source_record_id", F.create_map(F.lit("ingredients_text"), F.col("text")).alias("record_fields"))
    verdicts = P.confirm(sel.join(ing, "ingredient_id"), records, P.sanitize(raw))
    return sel, verdicts


@query("producer_confirmation", PRODUCER_VIEWS, f"{_VERDICT} select gtin, market, source_record_id, ingredient_id, owner, verdict, case when verdict = 'confirmed' then 'ingredients_text' end as field from vd")
def producer_confirmation(i: Inputs):
    return _producer_inputs(i)[1].drop("source_ids")


_MATCHED = """
one as (select gtin, min(market) as market, min('rec-' || k) as source_record_id from selection group by gtin having count(*) = 1),
mc as (select c.gtin, o.market, o.source_record_id, c.reason, c.evidence_id from pending_change c join one o on o.gtin = c.gtin)"""


@query("unique_match_join", PRODUCER_VIEWS, f"{_MATCHED} select * from mc")
def unique_match_join(i: Inputs):
    sel, _ = _producer_inputs(i)
    changes = i.view("pending_change").select("gtin", "reason", "evidence_id")
    return P.unique_matches(changes, sel).select("gtin", "market", "source_record_id", "reason", "evidence_id")


_QUEUE = f"""{_VERDICT}, {_MATCHED},
pq as (select gtin, market, source_record_id, 'high' as priority, 'ingredients-missing' as reason, '' as detail from ps where ingredient_id is null
  union select gtin, market, source_record_id, case verdict when 'ambiguous' then 'high' else 'medium' end, case verdict when 'confirmed' then 'producer-formulation-confirmed' when 'ambiguous' then 'producer-provenance-ambiguous'
     else 'producer-provenance-candidate' end, '' from vd where verdict is not null
  union select gtin, market, source_record_id, 'high', 'evidence-conflict', flag from (select *, unnest(conflict_flags) as flag from ps) x where flag <> 'ingredients-missing'
  union select gtin, market, source_record_id, 'high', reason, '' from mc)"""


def producer_queue(i: Inputs):
    sel, verdicts = _producer_inputs(i)
    changes = P.unique_matches(i.view("pending_change").select("gtin", "reason"), sel)
    return verdicts, P.queue(sel, verdicts, changes)


@query("manufacturer_queue", PRODUCER_VIEWS, f"{_QUEUE} select * from pq")
def manufacturer_queue(i: Inputs):
    return producer_queue(i)[1]


@query(
    "manufacturer_metrics", PRODUCER_VIEWS,
    f"""{_QUEUE} select 'confirmed' as metric, count(*) filter (where verdict = 'confirmed') as n from vd
union all select 'candidates', count(distinct case when verdict in ('ambiguous', 'candidate') then gtin || '/' || market end) from vd
union all select 'producers', count(distinct case when verdict = 'confirmed' then owner end) from vd union all select 'reason:' || reason, count(*) from pq group by reason""",
)
def manufacturer_metrics(i: Inputs):
    return P.metrics(*producer_queue(i))


# --- submissions --------------------------------------------------------------------------------
_PII = r"'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|[hH][tT][tT][pP][sS]?://|(^|[^\p{Nd}])(\+?\p{Nd}[ .()-]?){8,}\p{Nd}([^\p{Nd}]|$)'"


@query(
    "pii_scan", "",
    f"""select 'document' as origin, cast(doc_id as varchar) as id from documents where regexp_matches(text, {_PII})
union all select 'conversation', conv_id || '/' || turn from conversations where regexp_matches(text, {_PII})""",
)
def pii_scan(i: Inputs):
    docs = U.pii_rows(i.table("documents"), ["text"]).select(F.lit("document").alias("origin"), F.col("doc_id").cast("string").alias("id"))
    talk = U.pii_rows(i.table("conversations"), ["text"]).select(F.lit("conversation").alias("origin"), F.concat_ws("/", "conv_id", "turn").alias("id"))
    return docs.unionByName(talk)


view("submission", "code")(
    """
select concat('sub-', cast(c_custkey as string)) as submission_id, c_custkey as k, lpad(code, 14, '0') as gtin,
  case c_custkey % 5 when 0 then 'missing-product' when 1 then 'ingredients-correction' when 2 then 'identity-correction' when 3 then 'status-certification-correction' else 'complaint' end as issue_type,
  case when c_custkey % 19 = 0 then 'de' else 'DE' end as market, case when c_custkey % 23 = 0 then '2031-01-01T00:00:00Z' when c_custkey % 29 = 0 then 'soon' else '2001-05-05T10:00:00Z' end as observed_at,
  c_custkey % 31 <> 4 as consent, case when c_custkey % 37 = 0 then repeat(c_name, 20) else c_name end as product_name, case when c_custkey % 41 = 0 then 'mail me: a@b.example' end as brand, cast(null as string) as quantity,
  case when c_custkey % 43 = 0 then 'see https://x.example' when c_custkey % 47 = 0 then 'call +49 170 1234567' end as notes
from {customer} join code on k = c_custkey
"""
)
view("attachment", "submission")(
    """
select s.submission_id, concat(purpose, case when o_orderkey % 13 = 0 then '' else '-1' end, '.jpg') as file_name, case when o_orderkey % 17 = 0 then 'front' else purpose end as purpose,
  cast(case when o_orderkey % 19 = 0 then 3000 else 1000 + o_orderkey % 900 end as int) as width, cast(800 + o_orderkey % 1500 as int) as height, cast(case when o_orderkey % 23 = 0 then 5000000 else 1000000 + o_orderkey * 7 % 2900000 end as bigint) as byte_size,
  case when o_orderkey % 29 = 0 then 'ABC' else concat(md5(cast(cast(floor(o_orderkey / 3) as bigint) as string)), md5(o_orderpriority)) end as sha256
from (select *, case o_orderkey % 5 when 0 then 'barcode' when 1 then 'front' when 2 then 'ingredients' when 3 then 'certification' else 'barcode' end as purpose from {orders}) o
join submission s on s.k = o.o_custkey
"""
)


@query(
    "submission_violations", "submission attachment",
    f"""
s as (select *, {duck.gtin('gtin')} as good from submission),
req as (select unnest(['missing-product', 'missing-product', 'missing-product', 'ingredients-correction', 'ingredients-correction', 'identity-correction', 'identity-correction', 'status-certification-correction', 'status-certification-correction']) as issue_type,
   unnest(['barcode', 'front', 'ingredients', 'barcode', 'ingredients', 'barcode', 'front', 'barcode', 'front']) as purpose),
per as (select submission_id, count(*) as n, sum(byte_size) as bytes from attachment group by submission_id),
a as (select *, regexp_extract(file_name, '^(barcode|front|ingredients|certification|nutrition)-[1-9][0-9]*\\.jpg$', 1) as expected from attachment)
select submission_id, 'gtin' as rule from s where good is null union all select submission_id, 'issue-type' from s where issue_type = 'complaint'
union all select submission_id, 'market' from s where not regexp_full_match(market, '[A-Z]{{2}}') union all select submission_id, 'observed-in-future' from s where {ts('observed_at')} > {AT}
union all select submission_id, 'observed-at' from s where {ts('observed_at')} is null union all select submission_id, 'consent' from s where not consent
union all select submission_id, 'length:product_name' from s where length(product_name) > 200
union all select submission_id, 'contact-data:product_name' from s where regexp_matches(product_name, {_PII}) union all select submission_id, 'contact-data:brand' from s where regexp_matches(brand, {_PII})
union all select submission_id, 'contact-data:notes' from s where regexp_matches(notes, {_PII})
union all select distinct submission_id, 'attachment-name' from a where expected = '' union all select distinct submission_id, 'attachment-purpose' from a where expected <> '' and purpose <> expected
union all select distinct submission_id, 'attachment-dimensions' from a where width > 2400 or height > 2400 union all select distinct submission_id, 'attachment-pixels' from a where width * height > 12000000
union all select distinct submission_id, 'attachment-size' from a where byte_size > 4000000 union all select distinct submission_id, 'attachment-digest' from a where not regexp_full_match(sha256, '[0-9a-f]{{64}}')
union all select s.submission_id, 'attachment-count' from s left join per p using (submission_id) where coalesce(p.n, 0) not between 1 and 8
union all select submission_id, 'attachment-total-size' from per where bytes > 18000000
union all select s.submission_id, 'missing-purpose' from s where exists (select 1 from req r where r.issue_type = s.issue_type and not exists (select 1 from attachment t where t.submission_id = s.submission_id and t.purpose = r.purpose))
union all select distinct submission_id, 'attachment-name-repeated' from (select submission_id from attachment group by submission_id, file_name having count(*) > 1) d""",
)
def submission_violations(i: Inputs):
    return U.violations(i.view("submission"), i.view("attachment"), AS_OF)


@query(
    "attachment_reuse", "submission attachment",
    """
reg as (select submission_id from submission union all select submission_id from submission where k % 50 = 7)
select 'submission-repeated' as rule, submission_id as key, count(*) as n from reg group by submission_id having count(*) > 1
union all select 'attachment-reused', sha256, count(distinct submission_id) from attachment group by sha256 having count(distinct submission_id) > 1""",
)
def attachment_reuse(i: Inputs):
    subs = i.view("submission").select("submission_id", "k")
    registry = subs.unionByName(subs.filter("k % 50 = 7"))
    return U.attachment_reuse(registry, i.view("attachment"))


view("human_review", "submission")(
    """
select submission_id, case when k % 6 = 5 then 'reject' else 'propose-observation' end as decision, concat('reviewer-', cast(k % 4 as string)) as reviewer_id, '2001-10-10T10:00:00Z' as reviewed_at,
  product_name as verified_name, text as transcription from submission left join {documents} on doc_id = k and k % 3 = 0
"""
)
view("photo_scan", "attachment")(
    "select submission_id, file_name, concat(md5(file_name), md5(submission_id)) as sanitized_sha256 from attachment where byte_size < 3500000 group by submission_id, file_name"
)


@query(
    "submission_to_evidence", "submission attachment human_review photo_scan",
    """
ad as (select s.*, h.decision, h.reviewer_id, h.reviewed_at, h.verified_name, h.transcription from submission s join human_review h using (submission_id) where h.decision = 'propose-observation'),
ev as (select submission_id, gtin, market, 'identity' as kind, verified_name as content from ad
  union all select submission_id, gtin, market, 'ingredient', sha256('{"allergensText":null,"ingredientsText":' || to_json(transcription) || ',"tracesText":null}') from ad where trim(transcription) <> ''
  union all select a.submission_id, a.gtin, a.market, 'package-evidence', p.sanitized_sha256 from ad a join attachment t using (submission_id) join photo_scan p on p.submission_id = t.submission_id and p.file_name = t.file_name)
select kind as part, submission_id, gtin, content, 'ev:submitted:sha256:' || sha256('{"content":' || to_json(content) || ',"gtin":"' || gtin || '","kind":"' || kind || '","market":"' || market || '","submission_id":"' || submission_id || '"}') as id from ev
union all select 'impact', submission_id, gtin, concat_ws('/', issue_type <> 'missing-product', issue_type <> 'missing-product' or coalesce(trim(transcription) <> '', false)), case when issue_type <> 'missing-product' then 'correction' else 'new-product' end from ad""",
)
def submission_to_evidence(i: Inputs):
    records, impacts = U.to_evidence(i.view("submission"), i.view("attachment"), i.view("photo_scan"), i.view("human_review"))
    a = records.select(F.col("kind").alias("part"), "submission_id", "gtin", "content", "id")
    b = impacts.select(
        F.lit("impact").alias("part"), "submission_id", "gtin",
        F.concat_ws("/", F.col("invalidates_assessment").cast("string"), F.col("needs_methodology_review").cast("string")).alias("content"),
        F.col("impact").alias("id"),
    )
    return a.unionByName(b)
