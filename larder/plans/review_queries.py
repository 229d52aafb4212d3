"""Demo queries: text matching, methodology, certificates and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import certification as K
from larder.operators import matching as M
from larder.operators import quality as Q
from larder.plans import duck  # noqa: F401
from larder.plans.evidence import ALL, Envelope
from larder.plans.inputs import AS_OF, Inputs, array_of, day, view
from larder.plans.quality_queries import AT, ts
from larder.plans.registry import query
from larder.session import durable

VERSION = "1.0.0"

view("rule_alias")(
    """
select concat('alias-', cast(item_id as string)) as alias_id, concat('rule-', cast(item_id % 12 as string)) as rule_id,
  case item_id % 3 when 0 then 'en' when 1 then 'de' else 'und' end as language,
  case item_id % 4 when 0 then split_part(text, ' ', 2) when 1 then concat(split_part(text, ' ', 2), ' ', split_part(text, ' ', 3))
                   when 2 then substr(split_part(text, ' ', 3), 1, 4) else concat('E ', cast(300 + item_id as string)) end as alias,
  case item_id % 4 when 0 then 'token' when 1 then 'phrase' when 2 then 'token-prefix' else 'e-number' end as match,
  case item_id % 5 when 0 then 'prohibited-candidate' when 1 then 'ambiguous-review-required' when 2 then 'informational' else 'acceptable-with-evidence' end as outcome,
  case item_id % 5 when 0 then 'clear-prohibited-confirmation' else 'ambiguous-origin' end as queue, concat('reason-', cast(item_id % 6 as string)) as reason_code
from {benchmark} where length(split_part(text, ' ', 3)) > 1
"""
)
view("rule_context")(
    """
select concat('ctx-', cast(item_id as string)) as alias_id, concat('rule-', cast(item_id % 12 as string)) as rule_id, 'und' as language,
  concat(split_part(text, ' ', 2), ' ', split_part(text, ' ', 3)) as alias, 'phrase' as match
from {benchmark} where item_id % 2 = 0 and length(split_part(text, ' ', 3)) > 1
"""
)
view("additive")(
    """
select concat('E', cast(300 + n_nationkey as string), case when n_nationkey % 6 = 0 then 'a' else '' end) as additive_id,
  case when n_nationkey % 9 = 8 then 'removed' else 'active' end as status, n_nationkey as k from {nation}
"""
)
view("additive_name", "additive")(
    """
select concat('name-', cast(item_id as string)) as alias_id, a.additive_id, case item_id % 2 when 0 then 'en' else 'de' end as language,
  split_part(text, ' ', 4) as alias from {benchmark} join additive a on a.k = item_id % 25 where length(split_part(text, ' ', 4)) > 2
"""
)
view("note")(
    """
select cast(doc_id as string) as doc_id, lang as language, case when doc_id % 10 = 0 then concat(text, ' E 3', cast(doc_id % 30 as string), ', e301 (ii); ähnliche Zutaten: Käse')
  else text end as text from {documents}
"""
)


@query(
    "fold_text_with_offsets", "note",
    r"""
f as (select doc_id, text, trim(regexp_replace(lower(strip_accents(nfc_normalize(replace(lower(text), 'ß', 'ss')))), '[^\p{L}\p{N}]+', ' ', 'g')) as norm from note)
select doc_id, length(norm) as length, sha256(norm) as norm_hash, length(regexp_replace(text, '[^\p{L}\p{N}]+$', '')) - 1 as last_offset from f""",
)
def fold_text_with_offsets(i: Inputs):
    folded = M.folded_texts(i.view("note"))
    last = F.coalesce(F.try_element_at("offsets", F.lit(-1)), F.when(F.col("norm").isNotNull(), -1))  # a text without letters has none
    return folded.select("doc_id", F.length("norm").alias("length"), F.sha2("norm", 256).alias("norm_hash"), last.alias("last_offset"))


_FOLD = r"lower(strip_accents(nfc_normalize(replace(lower({x}), 'ß', 'ss'))))"
_FOLD_ALIAS = f"trim(regexp_replace({_FOLD.format(x='alias')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
# Texts letter by letter: each folded letter with its source position, runs of others as one space, then whole words.
_WORDS = rf"""
letter as materialized (select doc_id, unnest(range(len(text))) as i, unnest(string_split(text, '')) as c from note where text is not null),
folded as materialized (
  select c, unnest(range(1, len(f) + 1)) as j, unnest([case when regexp_matches(x, '[\p{{L}}\p{{N}}]') then x else ' ' end for x in string_split(f, '')]) as ch
  from (select c, {_FOLD.format(x="c")} as f from (select distinct c from letter) x) y where f <> ''),
plain as (select doc_id, i, j, ch from letter join folded using (c)),
kept as materialized (
  select doc_id, i, ch, row_number() over (partition by doc_id order by i, j) as p
  from (select *, lag(ch, 1, ' ') over (partition by doc_id order by i, j) as prior from plain) x where not (ch = ' ' and prior = ' ')),
word as materialized (
  select doc_id, w, string_agg(ch, '' order by p) as tok, min(i) as first, max(i) as last, row_number() over (partition by doc_id order by w) as n
  from (select *, count(*) filter (where ch = ' ') over (partition by doc_id order by p rows unbounded preceding) as w from kept) x where ch <> ' ' group by doc_id, w),
spelled as materialized (select doc_id, list(tok order by n) as toks, list(last order by n) as lasts from word group by doc_id),
found as (
  select n.doc_id, a.alias_id, x.first as start, lasts[x.n + len(aw) - 1] + 1 as "end", a.match as match_kind
  from (select *, string_split(folded, ' ') as aw from (select *, {_FOLD_ALIAS} as folded from rule_alias) f where folded <> '' and match in ('token', 'phrase')) a
  join word x on x.tok = aw[1] join spelled s on s.doc_id = x.doc_id and toks[x.n:x.n + len(aw) - 1] = aw join note n on n.doc_id = x.doc_id and a.language in ('und', lower(split_part(n.language, '-', 1)))
  union all
  select n.doc_id, a.alias_id, x.first, x.last + 1, a.match from (select *, {_FOLD_ALIAS} as folded from rule_alias) a
  join word x on starts_with(x.tok, folded) join note n on n.doc_id = x.doc_id and a.language in ('und', lower(split_part(n.language, '-', 1))) where a.match = 'token-prefix' and folded <> ''
  union all
  select n.doc_id, a.alias_id, x.first, case when x.tok = 'e' then lasts[x.n + 1] else x.last end + 1, a.match from (select *, regexp_replace(alias, '\D', '', 'g') as digits from rule_alias) a
  join word x on x.tok in ('e', 'e' || digits) join spelled s on s.doc_id = x.doc_id and (x.tok <> 'e' or toks[x.n + 1] = digits)
  join note n on n.doc_id = x.doc_id and a.language in ('und', lower(split_part(n.language, '-', 1))) where a.match = 'e-number')"""


@query("rule_match", "note rule_alias", f"""{_WORDS}
select f.doc_id, alias_id, start::int as start, "end"::int as "end", n.text[start + 1:"end"] as span, match_kind from found f join note n on n.doc_id = f.doc_id""")
def rule_match(i: Inputs):
    return M.match_rules(i.view("note"), i.view("rule_alias"))


_FINDINGS = f"""{_WORDS},
norm as materialized (select doc_id, string_agg(ch, '' order by p) as norm, list(i order by p) as ix from kept group by doc_id),
excuse as (
  select doc_id, rule_id, ix[q + 1] as start, ix[q + len(folded)] + 1 as "end"
  from (select n.*, c.rule_id, c.folded, unnest(list_filter(range(len(norm)), lambda q: norm[q + 1:q + len(c.folded)] = c.folded)) as q
        from norm n join (select *, {_FOLD_ALIAS} as folded from rule_context) c on c.folded <> '' and contains(n.norm, c.folded)) x),
finding as (
  select distinct f.doc_id, a.rule_id, a.outcome, a.queue, a.reason_code, start::int as start, "end"::int as "end", f.match_kind
  from found f join rule_alias a using (alias_id)
  where not exists (select 1 from excuse x where x.doc_id = f.doc_id and x.rule_id = a.rule_id and f.start < x."end" and x.start < f."end"))"""


@query("rule_findings", "note rule_alias rule_context", f"""{_FINDINGS}
select f.*, n.text[start + 1:"end"] as span from finding f join note n on n.doc_id = f.doc_id""")
def rule_findings(i: Inputs):
    return M.rule_findings(i.view("note"), i.view("rule_alias"), i.view("rule_context"))


@query("additive_match")
def additive_match(i: Inputs):
    return M.match_additives(i.view("note"), i.view("additive"), i.view("additive_name"))


@query("additive_first_match")
def additive_first_match(i: Inputs):
    return M.first_additives(M.match_additives(i.view("note"), i.view("additive"), i.view("additive_name"), named=True))


view("span")(
    """
select concat('doc-', cast(l_orderkey % 3000 as string)) as doc_id, concat('rule-', cast(l_linenumber % 3 as string)) as rule_id,
  cast(l_partkey % 900 as int) as start, cast(l_partkey % 900 + 1 + l_quantity as int) as end, l_returnflag as flag
from {lineitem}
"""
)
view("span_doc")(
    """
select concat('doc-', cast(l_orderkey % 3000 as string)) as doc_id, concat('rule-', cast(l_linenumber % 3 as string)) as rule_id,
  cast(l_suppkey * 7 % 900 as int) as start, cast(l_suppkey * 7 % 900 + 3 + l_quantity % 5 as int) as end from {lineitem} where l_returnflag = 'R'
"""
)


@query(
    "exclusion_overlap", "span span_doc",
    """select doc_id, rule_id, start, "end", count(*) as n from span m where flag <> 'R' and not exists (
  select 1 from span_doc x where x.doc_id = m.doc_id and x.rule_id = m.rule_id and m.start < x."end" and x.start < m."end") group by all""",
)
def exclusion_overlap(i: Inputs):
    kept = M.drop_overlapping(i.view("span").filter("flag <> 'R'"), i.view("span_doc"))
    return kept.groupBy("doc_id", "rule_id", "start", "end").agg(F.count("*").alias("n"))


def report(i: Inputs):
    e = Envelope(i)
    facts = Q.selection_facts(e, AS_OF)
    texts = e["ingredient"].select(F.col("id").alias("doc_id"), F.col("ingredients_text").alias("text"), F.col("language_code").alias("language"))
    return M.methodology_report(facts, M.rule_findings(texts, i.view("rule_alias"), i.view("rule_context")))


@query("methodology_report")
def methodology_report(i: Inputs):
    r = report(i)
    return r.select(
        "selection_id", "gtin", "market", "parser_status", "findings", F.array_join("safety_flags", "|").alias("safety_flags"),
        F.array_join(F.transform("queues", lambda q: F.concat(q["queue"], F.lit(":"), q["reason"])), "|").alias("queues"), "digest",
    )


@query("methodology_totals")
def methodology_totals(i: Inputs):
    return M.report_totals(report(i))


@query("stale_analysis")
def stale_analysis(i: Inputs):
    current = durable(report(i).select("selection_id", "digest"))
    k = F.substring("selection_id", 5, 20).cast("bigint")
    stored = current.filter(k % 10 != 9).select(
        "selection_id", F.when(k % 4 == 0, F.sha2("selection_id", 256)).otherwise(F.col("digest")).alias("digest")
    ).withColumn("own_digest", F.when(k % 7 == 0, F.lit("broken")).otherwise(F.col("digest")))
    return M.stale_analysis(current, stored)


view("registry_entry")(
    f"""
select concat('Certifier ', cast(n_nationkey % 5 as string)) as certifier, concat('Scheme ', cast(cast(floor(n_nationkey / 5) as int) as string)) as scheme,
  case when n_nationkey = 3 then 'suspended' else 'accepted' end as state, {array_of("'DE'", "case when n_nationkey % 2 = 0 then 'AT' end")} as markets,
  {array_of("'exact-gtin'", "case when n_nationkey % 2 = 0 then 'exact-batch' end")} as match_kinds, cast(100 + n_nationkey * 10 as int) as max_recheck_days,
  {array_of(*(f"case when ({n} + n_nationkey) % 4 <> 0 then 'source-{n}' end" for n in range(25)))} as sources,
  case when n_nationkey = 6 then '2001-12-01T12:00:00Z' else '2000-01-01T12:00:00Z' end as reviewed_at,
  case when n_nationkey = 7 then '2001-06-01T12:00:00Z' else '2003-01-01T12:00:00Z' end as next_review_at
from {{nation}}
"""
)


def _eligible(claims: str) -> str:
    """CTE ``judged`` over a claim CTE."""
    on = lambda cond, reason: f"case when coalesce({cond}, false) then {reason} end"
    reasons = ", ".join(
        [
            on("g.state <> 'accepted'", "'certifier-state-' || g.state"),
            on(f"moment < {ts('g.reviewed_at')}", "'certifier-review-not-yet-effective'"),
            on(f"moment >= {ts('g.next_review_at')}", "'certifier-review-expired'"),
            on("l.gtin <> claim_gtin", "'certificate-gtin-mismatch'"),
            on("l.market <> claim_market or not list_contains(g.markets, claim_market)", "'certificate-market-mismatch'"),
            on("not list_contains(g.sources, l.source_key)", "'certificate-source-not-approved'"),
            on("match_basis not in ('exact-gtin', 'explicit-product-list', 'exact-batch') or not list_contains(match_kinds, match_basis)", "'certificate-match-not-exact'"),
            on("claim_ingredient is null or bound_ingredient is null or claim_ingredient <> bound_ingredient", "'certificate-formulation-mismatch'"),
            *(on(f"coalesce(trim({c}), '') = ''", f"'certificate-{n}-missing'") for n, c in (
                ("certificateReference", "certificate_reference"), ("scope", "l.scope"), ("sourceRecordID", "source_record_id"), ("lastCheckedAt", "last_checked_at"))),
            on("evidence_hash is null or not regexp_full_match(evidence_hash, '[0-9a-f]{64}')", "'certificate-evidence-hash-missing'"),
            on(f"{ts('effective_at')} > moment", "'certificate-not-yet-effective'"), on(f"moment >= {ts('expiry_at')}", "'certificate-expired'"),
            on(f"{ts('revoked_at')} <= moment", "'certificate-revoked'"), on(f"{ts('suspended_at')} <= moment", "'certificate-suspended'"),
            on(f"{ts('last_checked_at')} > moment", "'certificate-last-check-future'"),
            on(f"{ts('last_checked_at')} <= moment and moment > {ts('last_checked_at')} + to_days(max_recheck_days)", "'certificate-recheck-stale'"),
        ]
    )
    return f"""
judged as (select *, len(reasons) = 0 as eligible from (
  select l.*, case when not l.found then ['certificate-record-missing'] when g.state is null then ['certifier-scheme-not-registered']
      else list_sort(list_distinct(list_filter([{reasons}], lambda x: x is not null))) end as reasons,
    case when g.state is null then 'unknown' when {ts('suspended_at')} <= moment then 'suspended' when {ts('revoked_at')} <= moment then 'revoked' when moment >= {ts('expiry_at')} then 'expired'
      when {ts('effective_at')} > moment then 'not-yet-effective' else 'active' end as derived_status
  from {claims} l left join registry_entry g on g.certifier = l.certifier and g.scheme = l.scheme) j)"""


CLAIMS = f"""
claims as (select s.id as selection_id, s.gtin as claim_gtin, s.market as claim_market, s.ingredient_id as claim_ingredient, s.assessment_id, a.ingredient_id as bound_ingredient,
    l.certification_id, c.* exclude (id, k), c.id is not null as found, {AT} as moment
  from selection s join assessment a on a.id = s.assessment_id and a.status = 'halal-certified' join assessment_cert l on l.assessment_id = a.id
  left join certification c on c.id = l.certification_id), {_eligible('claims')}"""


@query("certificate_eligibility", f"{ALL} registry_entry",
       f"{CLAIMS} select selection_id, certification_id, eligible, array_to_string(reasons, '|') as reasons, derived_status from judged")
def certificate_eligibility(i: Inputs):
    judged = K.eligibility(K.certified_claims(Envelope(i), AS_OF), i.view("registry_entry"))
    return judged.select("selection_id", "certification_id", "eligible", F.array_join("reasons", "|").alias("reasons"), "derived_status")


STATUS = f"""{CLAIMS},
ac as (select s.id as selection_id, l.certification_id as ref from selection s join assessment a on a.id = s.assessment_id join assessment_cert l on l.assessment_id = a.id),
sc as (select selection_id, ref_id as ref from selection_link where kind = 'certification'),
odd as (select distinct s.id as selection_id from selection s join assessment a on a.id = s.assessment_id where exists (select ref from ac where ac.selection_id = s.id except select ref from sc where sc.selection_id = s.id)
   or exists (select ref from sc where sc.selection_id = s.id except select ref from ac where ac.selection_id = s.id)),
per as (select selection_id, count(*) filter (where eligible) as n, list_distinct(flatten(list(reasons))) as rs from judged group by selection_id),
st0 as (select s.id as selection_id, s.gtin, s.market, s.assessment_id, coalesce(p.n, 0) as n, coalesce(p.rs, []) as rs,
    list_filter([case when o.selection_id is not null then 'certification-selection-changed' end, case when coalesce(len(s.conflict_flags) > 0, false) then 'current-formulation-conflict' end,
      case when coalesce(p.n, 0) = 0 and len(coalesce(p.rs, [])) = 0 then 'no-eligible-certification' end], lambda x: x is not null) as bl
  from selection s join assessment a on a.id = s.assessment_id and a.status = 'halal-certified' left join per p on p.selection_id = s.id left join odd o on o.selection_id = s.id),
st as (select selection_id, gtin, market, assessment_id, n as eligible_certificates, case when n > 0 and len(bl) = 0 then 'carry-forward' else 'invalidate' end as action,
    list_sort(list_distinct(list_concat(rs, bl))) as reasons from st0)"""


@query("certification_status", f"{ALL} registry_entry",
       f"{STATUS} select selection_id, gtin, market, assessment_id, eligible_certificates, action, array_to_string(reasons, '|') as reasons from st")
def certification_status(i: Inputs):
    rows = K.certification_status(Envelope(i), i.view("registry_entry"), AS_OF)
    return rows.withColumn("reasons", F.array_join("reasons", "|"))


@query(
    "migration_decisions", f"{ALL} registry_entry",
    f"""{STATUS},
mg as (select s.gtin, s.market, s.assessment_id, t.reasons as cr, list_filter([
    case when s.ingredient_id is distinct from a.ingredient_id or coalesce(g.supersedes_id = a.ingredient_id, false) then 'selected-formulation-changed' end,
    case when a.methodology_version <> '1.0.0' then 'methodology-version-changed' end,
    case when a.status = 'halal-certified' and o.selection_id is not null then 'certification-selection-changed' end,
    case when coalesce(len(s.conflict_flags) > 0, false) and a.status in ('halal-certified', 'halal-reviewed') then 'current-formulation-conflict' end], lambda x: x is not null) as own
  from selection s join assessment a on a.id = s.assessment_id left join ingredient g on g.id = s.ingredient_id left join odd o on o.selection_id = s.id
  left join st t on t.selection_id = s.id and t.action = 'invalidate'),
dec as (select gtin, market, assessment_id, case when len(own) > 0 or cr is not null then 'invalidate' else 'carry-forward' end as action,
    array_to_string(list_sort(list_distinct(list_concat(own, coalesce(cr, [])))), '|') as reasons from mg)
select 'decision' as part, gtin, market, assessment_id, action, reasons from dec
union all select 'event', null, null, assessment_id, '{AS_OF}', replace(reasons, '|', '; ') from dec where action = 'invalidate'""",
)
def migration_decisions(i: Inputs):
    e = Envelope(i)
    rows = K.migration(e, VERSION, K.certification_status(e, i.view("registry_entry"), AS_OF))
    events = K.invalidation_events(rows, AS_OF)
    none = F.lit(None).cast("string")
    return rows.withColumn("reasons", F.array_join("reasons", "|")).select(F.lit("decision").alias("part"), "gtin", "market", "assessment_id", "action", "reasons").unionByName(
        events.select(F.lit("event").alias("part"), none.alias("gtin"), none.alias("market"), "assessment_id", F.col("occurred_at").alias("action"), F.col("reason").alias("reasons"))
    )


view("analysis")(
    f"""
select lpad(cast(p_partkey as string), 14, '0') as gtin, case when p_partkey % 10 = 1 then 'AT' else 'DE' end as market,
  case when p_partkey % 9 = 8 then cast(null as string) else concat('ing-', cast(p_partkey as string), '-1') end as ingredient_id,
  case when p_partkey % 19 = 3 then '0.9.0' else '1.0.0' end as analysis_version, case when p_partkey % 7 = 2 then 'stale' else 'fresh' end as freshness_state,
  p_partkey % 16 = 5 as conflicted, p_partkey % 4 = 1 as prohibited,
  {array_of("'package-text-verification'", "case when p_partkey % 4 = 1 then 'clear-prohibited-confirmation' end", "case when p_partkey % 6 = 0 then 'ambiguous-origin' end")} as open_queues
from {{part}}
"""
)
view("review_input")(
    f"""
select concat('input-', cast(c_custkey as string)) as review_id, lpad(cast(c_custkey as string), 14, '0') as gtin, case when c_custkey % 10 = 1 then 'AT' else 'DE' end as market,
  case c_custkey % 7 when 0 then 'halal-certified' when 1 then 'halal-reviewed' when 2 then 'not-halal' when 3 then 'questionable' when 4 then 'unknown' when 5 then 'halal-certified' else 'maybe' end as decision,
  case when c_custkey % 31 = 0 then ' ' else concat('reviewer-', cast(c_custkey % 5 as string)) end as reviewer_id, '2001-10-01T12:00:00Z' as reviewed_at,
  case when c_custkey % 37 = 1 then '2001-09-01T12:00:00Z' else '2002-10-01T12:00:00Z' end as next_review_at, case when c_custkey % 41 = 2 then '' else c_mktsegment end as reason,
  {array_of("case when c_custkey % 8 <> 7 then 'package-text-verification' end", "case when c_custkey % 4 = 1 then 'clear-prohibited-confirmation' end", "case when c_custkey % 6 = 0 then 'ambiguous-origin' end", "case when c_custkey % 47 = 3 then 'unheard-of' end")} as resolved_queues
from {{customer}}
"""
)


@query(
    "review_adjudication", f"{ALL} registry_entry analysis review_input",
    f"""
rclaims as (select r.review_id, r.gtin as claim_gtin, r.market as claim_market, n.ingredient_id as claim_ingredient, n.ingredient_id as bound_ingredient, c.* exclude (id, k), c.id as certification_id,
    true as found, {ts('r.reviewed_at')} as moment
  from review_input r join analysis n on n.gtin = r.gtin and n.market = r.market join certification c on c.gtin = r.gtin where r.decision = 'halal-certified'), {_eligible('rclaims')},
ok as (select review_id, list_sort(list(distinct certification_id)) as certificates from judged where eligible group by review_id),
j as (select r.*, n.* exclude (gtin, market), k.certificates, r.decision in ('halal-certified', 'halal-reviewed') as positive, r.decision = 'not-halal' as negative,
    coalesce(r.resolved_queues, []) as res, coalesce(n.open_queues, []) as opn
  from review_input r left join analysis n on n.gtin = r.gtin and n.market = r.market left join ok k on k.review_id = r.review_id),
v as (select *, case when analysis_version is null then 'no-analysis' when analysis_version <> '1.0.0' then 'methodology-mismatch'
    when ingredient_id is null and (positive or negative) then 'ingredient-evidence-missing'
    when decision not in ('halal-certified', 'halal-reviewed', 'not-halal', 'questionable', 'unknown') then 'unsupported-decision'
    when trim(reviewer_id) = '' then 'reviewer-blank' when next_review_at <= reviewed_at then 'next-review-not-later' when trim(reason) = '' then 'reason-blank'
    when len(list_filter(res, lambda x: not list_contains(opn, x))) > 0 then 'queue-not-open' when positive and prohibited then 'prohibited-candidate-unresolved'
    when positive and len(list_filter(opn, lambda x: not list_contains(res, x))) > 0 then 'queues-unresolved' when positive and freshness_state <> 'fresh' then 'formulation-not-fresh'
    when positive and conflicted then 'formulation-conflict' when negative and not list_contains(res, 'clear-prohibited-confirmation') then 'prohibition-not-confirmed'
    when negative and not prohibited then 'no-prohibited-candidate' when decision = 'halal-certified' and certificates is null then 'no-eligible-certificate' end as rejection from j)
select review_id, decision, rejection, case when rejection is null then case decision when 'halal-reviewed' then 'completed-methodology-review' when 'halal-certified' then 'current-exact-certification'
    when 'not-halal' then 'confirmed-prohibited-evidence' when 'questionable' then 'reviewed-unresolved-ambiguity' else 'reviewed-insufficient-evidence' end end as reason_code,
  case when rejection is null then array_to_string(list_sort(list_distinct(list_filter(list_concat([ingredient_id], case when decision = 'halal-certified' then coalesce(certificates, []) else [] end), lambda x: x is not null))), '|') end as evidence_ids
from v""",
)
def review_adjudication(i: Inputs):
    inputs, analyses = i.view("review_input"), i.view("analysis")
    none = F.array().cast("array<string>")
    inputs = inputs.withColumn("resolved_queues", F.coalesce("resolved_queues", none))
    asked = inputs.filter("decision = 'halal-certified'").join(analyses.select("gtin", "market", "ingredient_id"), ["gtin", "market"]).select(
        "review_id", F.col("gtin").alias("claim_gtin"), F.col("market").alias("claim_market"), F.col("ingredient_id").alias("claim_ingredient"),
        F.col("ingredient_id").alias("bound_ingredient"), F.to_timestamp("reviewed_at").alias("at"),
    )
    certs = i.view("certification").withColumnRenamed("id", "certification_id").drop("k")
    claims = asked.join(certs, asked.claim_gtin == certs.gtin)
    rows = K.adjudicate(inputs, analyses, claims, i.view("registry_entry"), VERSION)
    return rows.select("review_id", "decision", "rejection", "reason_code", "evidence_ids")
