"""Demo queries: quality of the current selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import clock
from larder.operators import quality as Q
from larder.plans.evidence import ALL, Envelope
from larder.plans.inputs import AS_OF, Inputs, array_of, day, view
from larder.plans.registry import query

AT = "timestamp '2001-11-05 12:00:00'"


def ts(x: str) -> str:
    return f"try_cast(replace({x}, 'Z', '') as timestamp)"


def fresh(x: str, refresh: int, stale: int) -> str:
    return f"""case when {ts(x)} is null then 'date-unknown' when {AT} >= {ts(x)} + interval {stale} month then 'stale'
  when {AT} >= {ts(x)} + interval {refresh} month then 'refresh-recommended' else 'fresh' end"""


_CERT_HEAD = f"""case when {ts('revoked_at')} <= {AT} then 'revoked' when {ts('suspended_at')} <= {AT} then 'suspended'
  when {ts('effective_at')} > {AT} then 'not-effective' when {ts('expiry_at')} < {AT} then 'expired'"""
CERT_STATE = f"""{_CERT_HEAD} else case ({fresh('last_checked_at', 3, 6)}) when 'fresh' then 'current' when 'stale' then 'stale-check'
  when 'date-unknown' then 'date-unknown' else 'refresh-recommended' end end"""
CERT_HEALTH = f"{_CERT_HEAD} when {ts('last_checked_at')} is null then 'check-date-unknown' else 'active' end"
RETAIL_STATE = fresh("coalesce(observed_at, snapshot_at)", 1, 3)

FACTS = f"""
rc as (select target_id, count(distinct case when state = 'approved' then reviewer_id end) as reviewers,
    max(case when state = 'approved' then reviewed_at end) as last_approved_at, count(*) filter (where state in ('rejected', 'superseded')) as terminal_reviews
  from review group by target_id),
act as (select gtin, market, count(*) as active, count(distinct content_hash) as active_hashes from ingredient i
  where not exists (select 1 from ingredient n where n.supersedes_id = i.id and n.gtin = i.gtin and n.market = i.market) group by gtin, market),
facts0 as (select s.id as selection_id, s.gtin, s.market, s.ingredient_id, s.assessment_id, s.conflict_flags, d.confidence, d.brand, d.categories,
    d.source_key as identity_source, c.source_class as identity_class, g.id is not null as has_text, g.observed_at as ing_observed_at, g.supersedes_id as ing_supersedes,
    g.capture_method, g.verification_state, g.language_code, g.transformation_percent, g.source_revision, g.source_key as ingredient_source,
    a.status, a.methodology_version, a.ingredient_id as asm_ingredient, a.id is not null as has_assessment,
    coalesce(ra.reviewers, 0) as asm_reviewers, coalesce(ri.reviewers, 0) as ing_reviewers, coalesce(act.active_hashes, 0) as active_hashes,
    coalesce(len(s.conflict_flags) > 0, false) as flagged, coalesce(a.status in ('halal-certified', 'halal-reviewed'), false) as positive,
    a.ingredient_id is not distinct from s.ingredient_id as bound
  from selection s left join identity d on d.id = s.identity_id left join source c on c.source_key = d.source_key
  left join ingredient g on g.id = s.ingredient_id left join assessment a on a.id = s.assessment_id
  left join rc ra on ra.target_id = s.assessment_id left join rc ri on ri.target_id = s.ingredient_id
  left join act on act.gtin = s.gtin and act.market = s.market),
facts as (select *, case when not has_text then 'date-unknown'
      when ing_supersedes is not null and ing_reviewers + case when bound then asm_reviewers else 0 end = 0 then 'changed-unreviewed'
      else {fresh('ing_observed_at', 9, 12)} end as formulation_state,
    has_text and (active_hashes > 1 or flagged) as conflict,
    positive and asm_reviewers < case when identity_class = 'synthetic' then 1 else 2 end as reviewer_deficit from facts0),
cf as (select l.selection_id, l.ref_id, f.gtin, f.market, f.status, t.id is not null as found, t.gtin as cert_gtin, t.market as cert_market, {CERT_STATE} as cert_state0
  from selection_link l join facts f on f.selection_id = l.selection_id left join certification t on t.id = l.ref_id where l.kind = 'certification'),
cfs as (select *, case when found then cert_state0 end as cert_state from cf)"""

BAD = "('expired', 'revoked', 'suspended', 'not-effective', 'date-unknown', 'stale-check')"
FINDINGS = f"""{FACTS},
found as (
  select 'warning' as severity, 'ingredients-missing' as code, gtin, market, null as evidence_id from facts where not has_text
  union select 'warning', 'formulation-' || formulation_state, gtin, market, ingredient_id from facts where has_text and formulation_state <> 'fresh'
  union select 'warning', 'formulation-conflict', gtin, market, null from facts where conflict
  union select 'blocker', 'positive-with-formulation-conflict', gtin, market, assessment_id from facts where conflict and positive
  union select 'blocker', 'unsafe-positive-inheritance', gtin, market, assessment_id from facts where has_text and positive and not bound
  union select 'blocker', 'positive-second-review-missing', gtin, market, assessment_id from facts where reviewer_deficit
  union select 'blocker', 'certification-invalid', gtin, market, ref_id from cfs where not found or (cert_state in {BAD} and status = 'halal-certified')
  union select 'blocker', 'certification-scope-mismatch', gtin, market, ref_id from cfs where cert_gtin <> gtin or cert_market <> market
  union select 'warning', 'certification-' || cert_state, gtin, market, ref_id from cfs where cert_state in {BAD})"""


@query(
    "freshness_state", "ingredient retailer",
    f"""select 'formulation' as clock_name, id, {fresh('observed_at', 9, 12)} as state from ingredient
union all select 'retailer', id, {RETAIL_STATE} from retailer""",
)
def freshness_state(i: Inputs):
    at = F.lit(AS_OF).cast("timestamp")
    a = i.view("ingredient").select(
        F.lit("formulation").alias("clock_name"), "id", clock.freshness(F.col("observed_at"), at, Q.POLICY.formulation).alias("state")
    )
    b = i.view("retailer").select(F.lit("retailer").alias("clock_name"), "id", Q.retailer_state(at).alias("state"))
    return a.unionByName(b)


@query("certificate_state", "certification", f"select id, {CERT_STATE} as state, {CERT_HEALTH} as health_state from certification")
def certificate_state(i: Inputs):
    at = F.lit(AS_OF).cast("timestamp")
    return i.view("certification").select("id", Q.cert_state(at).alias("state"), Q.cert_state(at, None).alias("health_state"))


@query("active_formulations", ALL,
       f"{FACTS} select a.gtin, a.market, a.active, a.active_hashes, coalesce(f.conflict, false) as conflict from act a left join facts f on f.gtin = a.gtin and f.market = a.market")
def active_formulations(i: Inputs):
    e = Envelope(i)
    facts = Q.selection_facts(e, AS_OF).select("gtin", "market", "conflict")
    return Q.active_formulations(e["ingredient"]).join(facts, ["gtin", "market"], "left").fillna(False, ["conflict"])


@query("quality_findings", ALL, f"{FINDINGS} select * from found")
def quality_findings(i: Inputs):
    return Q.findings(Envelope(i), AS_OF).select("severity", "code", "gtin", "market", "evidence_id")


def _hist(metric: str, table: str, column: str, values: list[str]) -> str:
    return f"""select '{metric}' as metric, v as key, count({column}) as n from (select unnest({values}) as v) e left join {table} on {column} = v group by v"""


METRICS = f"""{FACTS}, rs as (select {RETAIL_STATE} as retail_state from retailer),
metrics as ({_hist('formulation', 'facts', 'formulation_state', Q.FRESHNESS)} union all {_hist('assessment', 'facts', 'status', Q.STATUSES)}
union all {_hist('certificate', 'cfs', 'cert_state', Q.CERT_STATES)} union all {_hist('retailer', 'rs', 'retail_state', [s for s in Q.FRESHNESS if s != 'changed-unreviewed'])}
union all select 'products', '', count(*) from facts union all select 'missing-ingredients', '', count(*) from facts where not has_text
union all select 'formulation-conflicts', '', count(*) from facts where conflict union all select 'second-review-deficits', '', count(*) from facts where reviewer_deficit
union all select 'machine-assisted', '', count(*) from facts where has_text and (capture_method = 'ocr' or verification_state in ('unverified', 'machine-assisted'))
union all select 'review', state, count(*) from review group by state union all select 'source-class', source_class, count(*) from source group by source_class)"""


@query("quality_metrics", ALL, f"{METRICS} select * from metrics")
def quality_metrics(i: Inputs):
    return Q.metrics(Envelope(i), AS_OF)


view("source_policy")(
    """
select concat('source-', cast(n_nationkey as string)) as source_key, n_nationkey % 6 <> 5 as enabled,
  case when n_nationkey % 7 <> 6 then 'ODbL' when n_nationkey % 2 = 0 then ' ' end as license_identifier,
  case when n_nationkey % 5 <> 4 then concat('data of ', n_name) end as attribution
from {nation} where n_nationkey % 8 <> 7
"""
)


@query(
    "rights_join", "source source_policy",
    """
j as (select s.source_key, p.source_key is null as missing, p.enabled, coalesce(trim(p.license_identifier), '') = '' as no_license, coalesce(trim(p.attribution), '') = '' as no_attribution
      from source s left join source_policy p on p.source_key = s.source_key)
select source_key, 'source-unapproved' as code from j where missing or not enabled union all select source_key, 'source-policy-missing' from j where missing
union all select source_key, 'source-license-missing' from j where not missing and no_license
union all select source_key, 'source-attribution-missing' from j where not missing and no_attribution""",
)
def rights_join(i: Inputs):
    return Q.source_rights(i.view("source"), i.view("source_policy"))


view("terms")(
    f"""
select concat('source-', cast(n_nationkey as string)) as source_key, case when n_nationkey % 9 = 8 then 'pending' else 'approved' end as review_state,
  {day('2001', 'n_nationkey * 5', 15)} as reviewed_at, {day('2001', 'n_nationkey * 7 + 6', 18)} as expires_at,
  {array_of("case when n_nationkey % 4 <> 1 then 'ODbL' else 'CC0' end")} as covered
from {{nation}} where n_nationkey % 10 <> 9
"""
)


@query(
    "source_terms_asof", "source terms",
    f"""
j as (select s.source_key, case when review_state is null then 'no-review' when review_state <> 'approved' then 'review-' || review_state
  when {ts('reviewed_at')} > {AT} then 'not-yet-effective' when {AT} >= {ts('expires_at')} then 'expired'
  when license_identifier is not null and not list_contains(covered, license_identifier) then 'license-not-covered' end as reason
  from source s left join terms t on t.source_key = s.source_key)
select source_key, case when reason is null then 'approved' else 'invalid' end as state, reason from j""",
)
def source_terms_asof(i: Inputs):
    return Q.terms_review(i.view("source"), i.view("terms"), AS_OF)


COVERAGE = f"""{FACTS}, cells as (
select 'identity-confidence' as dimension, coalesce(confidence, 'missing') as key from facts union all select 'language', language_code from facts where has_text
union all select 'verification', verification_state from facts where has_text union all select 'capture', capture_method from facts where has_text
union all select 'transformation', case when transformation_percent is null then 'none' when transformation_percent >= 80 then 'verified-confidence' else 'low-confidence' end from facts where has_text
union all select 'methodology', methodology_version from facts where has_assessment union all select 'ingredients', case when has_text then 'present' else 'missing' end from facts
union all select 'observed-at', 'present' from facts where has_text and ing_observed_at is not null
union all select 'source-revision', 'present' from facts where has_text and source_revision is not null
union all select 'retailer-kind-state', concat_ws('|', retailer_key, kind, {RETAIL_STATE}) from retailer)"""


@query(
    "coverage_dimensions", ALL,
    f"""{COVERAGE} select dimension, key, cast(count(*) as varchar) as value from cells group by dimension, key
union all select 'coverage-fraction', '', cast(round(count(*) filter (where key = 'present') / count(*), 6) as varchar) from cells where dimension = 'ingredients'""",
)
def coverage_dimensions(i: Inputs):
    cells = Q.coverage(Envelope(i), AS_OF)
    fraction = Q.coverage_fraction(cells).select(
        F.lit("coverage-fraction").alias("dimension"), F.lit("").alias("key"), F.col("fraction").cast("string").alias("value")
    )
    return cells.select("dimension", "key", F.col("n").cast("string").alias("value")).unionByName(fraction)


view("source_volume")(
    """
select concat('source-', cast(l_suppkey as string)) as source_key, count(case when l_discount < 0.04 then 1 end) as previous_n,
  count(case when l_tax * 100 < 1 + l_suppkey % 8 and l_discount >= 0.02 then 1 end) as current_n,
  count(case when l_quantity = 50 and l_suppkey % 3 = 0 then 1 end) as malformed
from {lineitem} group by l_suppkey
"""
)


@query(
    "volume_drift_gate", "source_volume",
    """
v as (select *, current_n - previous_n as delta from source_volume)
select source_key, previous_n, current_n, 'unexpected-count-decrease' as code from v where previous_n >= 100 and delta < 0 and -delta / previous_n > 0.25
union all select source_key, previous_n, current_n, 'unexpected-count-increase' from v where previous_n >= 100 and delta > 0 and delta / previous_n > 1
union all select source_key, previous_n, current_n, 'parser-error-rate-exceeded' from v where malformed / nullif(current_n + malformed, 0) > 0.001""",
)
def volume_drift_gate(i: Inputs):
    return Q.volume_drift(i.view("source_volume"))


view("changed_key")(
    """
select lpad(cast(p_partkey as string), 14, '0') as gtin, case when p_partkey % 10 = 1 then 'AT' else 'DE' end as market,
  case when p_partkey % 22 = 0 then 'new' else 'changed' end as change_kind from {part} where p_partkey % 11 = 0
"""
)
SEED = "catalog-quality-v1"


@query(
    "stratified_sample", f"{ALL} changed_key",
    f"""{FACTS},
strata as (select gtin, market, 'source:' || coalesce(ingredient_source, identity_source) as stratum from facts where coalesce(ingredient_source, identity_source) is not null
  union all select gtin, market, 'status:' || coalesce(status, 'unassessed') from facts
  union all select gtin, market, 'category:' || unnest(categories) from facts
  union all select f.gtin, f.market, 'change:' || c.change_kind from facts f join changed_key c on c.gtin = f.gtin and c.market = f.market),
r as (select *, sha256(concat_ws(chr(0), '{SEED}', stratum, gtin, market)) as rank_hash from strata)
select stratum, gtin, market, rank_hash, position from (
  select *, row_number() over (partition by stratum order by rank_hash, gtin, market) as position from r) x where position <= 3""",
)
def stratified_sample(i: Inputs):
    return Q.stratified_sample(Q.selection_facts(Envelope(i), AS_OF), i.view("changed_key")).select(
        "stratum", "gtin", "market", "rank_hash", F.col("position").cast("long").alias("position")
    )


@query(
    "hash_sample_widening", ALL,
    f"""{FINDINGS},
r as (select gtin, market, sha256(concat_ws(chr(0), '{SEED}', gtin, market)) as rank_hash, exists (select 1 from found d where d.gtin = s.gtin and d.market = s.market) as defect from selection s),
p as (select *, row_number() over (order by rank_hash, gtin, market) as position from r),
t as (select count(*) filter (where defect) / count(*) as rate from p where position <= 25)
select gtin, market, rank_hash, round(rate, 6) as defect_rate, rate > 0.05 as escalated from p, t where position <= case when rate > 0.05 then 100 else 25 end""",
)
def hash_sample_widening(i: Inputs):
    e = Envelope(i)
    return Q.widening_sample(e["selection"], Q.findings(e, AS_OF))


@query(
    "mandatory_review", f"{ALL} changed_key",
    f"""{FACTS},
r as (select gtin, market, coalesce(status, 'unassessed') as status from facts f where positive or flagged
   or exists (select 1 from cfs where cfs.selection_id = f.selection_id) or exists (select 1 from changed_key c where c.gtin = f.gtin and c.market = f.market and c.change_kind = 'changed'))
select gtin, market, status, (select count(*) from r) as total, (select count(*) from r) > 1000 as truncated from r order by gtin, market limit 1000""",
)
def mandatory_review(i: Inputs):
    e = Envelope(i)
    links = e["selection_link"].filter("kind = 'certification'")
    return Q.mandatory_review(Q.selection_facts(e, AS_OF), links, i.view("changed_key"), limit=1000)


@query(
    "reviewer_counts", ALL,
    f"""{FACTS}
select a.id as assessment_id, coalesce(rc.reviewers, 0) as reviewers, rc.last_approved_at, coalesce(rc.terminal_reviews, 0) as terminal_reviews,
  case when s.source_class = 'synthetic' then 1 else 2 end as required,
  not (a.status in ('halal-certified', 'halal-reviewed') and coalesce(rc.reviewers, 0) < case when s.source_class = 'synthetic' then 1 else 2 end) as requirement_met
from assessment a left join rc on rc.target_id = a.id left join identity d on d.gtin = a.gtin and d.market = a.market left join source s on s.source_key = d.source_key""",
)
def reviewer_counts(i: Inputs):
    e, c = Envelope(i), F.col
    source = e["identity"].join(e["source"].select("source_key", "source_class"), "source_key", "left").select("gtin", "market", "source_class")
    rows = (
        e["assessment"].join(Q.reviewer_counts(e["review"]).withColumnRenamed("target_id", "id"), "id", "left")
        .join(source, ["gtin", "market"], "left").fillna(0, ["reviewers", "terminal_reviews"])
    )
    required = F.when(c("source_class") == "synthetic", 1).otherwise(Q.POLICY.min_reviewers)
    met = ~(c("status").isin(*Q.POLICY.positive_statuses) & (c("reviewers") < required))
    return rows.select(
        c("id").alias("assessment_id"), "reviewers", "last_approved_at", "terminal_reviews", required.alias("required"), met.alias("requirement_met")
    )


view("stored_metric", *ALL.split())(
    """
select 'assessment' as metric, a.status as key, count(*) + case when a.status = 'questionable' then 1 else 0 end as n
from selection s join assessment a on a.id = s.assessment_id group by a.status
union all select 'products', '', count(*) from selection
union all select 'missing-ingredients', '', count(*) from selection where ingredient_id is null
union all select 'review', state, count(*) from review where state <> 'pending' group by state
"""
)


@query(
    "release_gate", f"{ALL} stored_metric",
    f"""{METRICS}
select coalesce(m.metric, s.metric) as metric, coalesce(m.key, s.key) as key, coalesce(m.n, 0) as computed_n, coalesce(s.n, 0) as stored_n
from (select * from metrics where metric in ('assessment', 'products', 'missing-ingredients', 'review')) m
full join stored_metric s on s.metric = m.metric and s.key = m.key where coalesce(m.n, 0) <> coalesce(s.n, 0)""",
)
def release_gate(i: Inputs):
    wanted = ["assessment", "products", "missing-ingredients", "review"]
    return Q.compare_metrics(Q.metrics(Envelope(i), AS_OF).filter(F.col("metric").isin(*wanted)), i.view("stored_metric"))


@query(
    "worst_freshness", ALL,
    f"""{FINDINGS},
r as (select gtin, market, substr(code, 13) as state, case substr(code, 13) when 'fresh' then 0 when 'refresh-recommended' then 1 when 'date-unknown' then 2 when 'stale' then 3
   when 'changed-unreviewed' then 4 end as rnk from found where starts_with(code, 'formulation-'))
select s.gtin, s.market, coalesce(w.state, 'fresh') as state from selection s left join (
  select gtin, market, arg_max(state, rnk) as state from r where rnk is not null group by gtin, market) w on w.gtin = s.gtin and w.market = s.market""",
)
def worst_freshness(i: Inputs):
    e = Envelope(i)
    worst = Q.worst_freshness(Q.findings(e, AS_OF))
    return e["selection"].select("gtin", "market").join(worst, ["gtin", "market"], "left").fillna("fresh", ["state"])
