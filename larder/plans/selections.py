"""Demo queries: selection of candidates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from larder.operators import normalize as N
from larder.operators import selection as S
from larder.plans import duck
from larder.plans.inputs import Inputs
from larder.plans.normalization import CANDIDATE_ARRAYS, SOURCE, joined, raw
from larder.plans.registry import query
from larder.policy import BasicRule, SelectionPolicy
from larder.session import durable, shared_folder

POLICY = SelectionPolicy()
# The previous policy of the comparison: no bakery or snack category, nuts not known, unknown milk counts allowed.
PREVIOUS = replace(
    POLICY,
    version="0.9.0",
    category_signals=tuple(s for s in POLICY.category_signals if s not in ("bakery", "snack")),
    formulation_signals=tuple(s for s in POLICY.formulation_signals if s != "rennet"),
    basic_rules=(*POLICY.basic_rules[:1], BasicRule("basic-plain-milk", ("plain-cow-milk",), 1, True)),
)
DECIDED = f"{duck.CANDIDATE}, {duck.decided(POLICY)}"


def candidates(i: Inputs):
    return N.candidates(raw(i), SOURCE)


def decisions(i: Inputs):
    return S.classify(candidates(i), POLICY)


@query("classify_candidates", "raw_product", f"{DECIDED} select source_record_id, gtin, decision, reason from decided")
def classify_candidates(i: Inputs):
    return decisions(i).select("source_record_id", "gtin", "decision", "reason")


@query(
    "selection_outputs", "raw_product",
    f"""{DECIDED}
select decision as target, source_record_id, gtin, market, '1.0.0' as policy_version, reason as reason_code, name,
  array_to_string(list_concat({', '.join(f'list_sort(list_distinct({a}))' for a in CANDIDATE_ARRAYS)}), '|') as arrays
from decided where decision = 'include-detailed'
union all select decision, null, gtin, market, '1.0.0', reason, null, null from decided where decision = 'exclude-basic'
union all select decision, source_record_id, gtin, market, '1.0.0', reason, null, null from decided where decision = 'exclude-invalid'""",
)
def selection_outputs(i: Inputs):
    d = durable(decisions(i))  # three outputs of one run
    kept = S.selected(d, POLICY).select(
        F.lit(S.INCLUDE).alias("target"), "source_record_id", "gtin", "market", "policy_version", "reason_code", "name",
        joined(F.concat(*CANDIDATE_ARRAYS)).alias("arrays"),
    )
    basic = S.basic_exclusions(d, POLICY).withColumn("target", F.lit(S.BASIC))
    invalid = S.invalid_exclusions(d, POLICY).withColumn("target", F.lit(S.INVALID)).drop("barcode")
    return kept.unionByName(basic, allowMissingColumns=True).unionByName(invalid, allowMissingColumns=True)


def _dirty(c):
    """Candidates with breaches: blanks, repeated values, odd signals, repeated records."""
    k = F.col("line")
    return c.select(
        *(x for x in c.columns if x not in ("name", "market", "category_tags", "package_signals", "source_record_id", "ingredient_count")),
        F.when(k % 40 == 0, " ").otherwise(F.col("name")).alias("name"),
        F.when(k % 43 == 0, "de").otherwise(F.col("market")).alias("market"),
        F.when(k % 33 == 0, F.concat("category_tags", "category_tags")).otherwise(F.col("category_tags")).alias("category_tags"),
        F.when(k % 21 == 0, F.array(F.lit("Glass"))).otherwise(F.col("package_signals")).alias("package_signals"),
        F.when(k % 25 == 24, F.concat(F.lit("rec-"), (k - 1).cast("string"))).otherwise(F.col("source_record_id")).alias("source_record_id"),
        F.when(k % 61 == 0, -1).otherwise(F.col("ingredient_count")).alias("ingredient_count"),
    )


@query(
    "candidate_violations", "raw_product",
    f"""{duck.CANDIDATE},
dirty as (select line, case when line % 25 = 24 then concat('rec-', line - 1) else source_record_id end as source_record_id,
  case when line % 40 = 0 then ' ' else name end as name, case when line % 43 = 0 then 'de' else market end as market,
  case when line % 33 = 0 then list_concat(category_tags, category_tags) else category_tags end as category_tags,
  case when line % 21 = 0 then ['Glass'] else package_signals end as package_signals,
  case when line % 61 = 0 then -1 else ingredient_count end as ingredient_count, barcode from candidate)
select source_record_id, 'blank' as rule, 'name' as field from dirty where trim(name) = ''
union all select source_record_id, 'blank', 'barcode' from dirty where trim(barcode) = ''
union all select source_record_id, 'market', 'market' from dirty where not regexp_full_match(market, '[A-Z]{{2}}')
union all select source_record_id, 'negative', 'ingredient_count' from dirty where ingredient_count < 0
union all select source_record_id, 'duplicate-value', 'category_tags' from dirty where len(list_distinct(category_tags)) < len(category_tags)
union all select source_record_id, 'signal', 'package_signals' from dirty where list_contains(package_signals, 'Glass')
union all select source_record_id, 'duplicate-record', 'source_record_id' from dirty group by 1 having count(*) > 1""",
)
def candidate_violations(i: Inputs):
    return S.candidate_violations(_dirty(candidates(i)))


@query(
    "selection_report", "raw_product",
    f"""{DECIDED}, w as (select *, coalesce(trim(ingredients_text) <> '', false) as has from decided)
select 'examined' as metric, '' as key, count(*) as n from w
union all select 'target_market', '', count(*) filter (where market = 'DE') from w
union all select 'eligible', '', count(*) filter (where decision <> 'exclude-invalid') from w
union all select 'included', '', count(*) filter (where decision = 'include-detailed') from w
union all select 'excluded_basic', '', count(*) filter (where decision = 'exclude-basic') from w
union all select 'excluded_invalid', '', count(*) filter (where decision = 'exclude-invalid') from w
union all select 'included_with_ingredients', '', count(*) filter (where decision = 'include-detailed' and has) from w
union all select 'included_missing_ingredients', '', count(*) filter (where decision = 'include-detailed' and not has) from w
union all select decision, reason, count(*) from w group by decision, reason""",
)
def selection_report(i: Inputs):
    return S.report(decisions(i), POLICY)


@query(
    "top_values", "raw_product",
    f"""{DECIDED},
v as (select 'category' as kind, unnest(category_tags) as value from decided where decision <> 'exclude-invalid'
      union all select 'brand', brand from decided where decision <> 'exclude-invalid' and trim(brand) <> ''
      union all select 'retailer', unnest(retailer_keys) from decided where decision <> 'exclude-invalid')
select kind, value, n from (select kind, value, count(*) as n, row_number() over (partition by kind order by count(*) desc, value) as rn
  from v group by kind, value) r where rn <= 10""",
)
def top_values(i: Inputs):
    return S.top_values(decisions(i))


@query(
    "audit_sample", "raw_product",
    f"""{DECIDED}
select source_record_id, gtin, market, name, reason, sha256(concat_ws('|', '1.0.0', source_record_id, coalesce(gtin, ''), market, reason)) as rank_hash
from decided where decision = 'exclude-basic' order by rank_hash limit 20""",
)
def audit_sample(i: Inputs):
    return S.audit_sample(decisions(i), POLICY)


@query(
    "policy_comparison", "raw_product",
    f"""{DECIDED}, {duck.decided(PREVIOUS, 'earlier')}
select c.source_record_id, c.gtin, p.decision as previous_decision, p.reason as previous_reason,
  c.decision as current_decision, c.reason as current_reason
from decided c join earlier p on p.line = c.line where c.decision <> p.decision or c.reason <> p.reason""",
)
def policy_comparison(i: Inputs):
    return S.compare_policies(candidates(i), POLICY, PREVIOUS)


@query(
    "decision_changes", "raw_product",
    f"""{DECIDED}, {duck.decided(PREVIOUS, 'earlier')},
now as (select source_record_id, gtin, decision, reason from decided where line % 50 <> 1), was as (select source_record_id, gtin, decision, reason from earlier where line % 50 <> 2)
select coalesce(n.source_record_id, w.source_record_id) as source_record_id, coalesce(n.gtin, w.gtin) as gtin, w.decision as previous_decision, w.reason as previous_reason,
  n.decision as current_decision, n.reason as current_reason
from now n full join was w on w.source_record_id = n.source_record_id where n.decision is distinct from w.decision or n.reason is distinct from w.reason""",
)
def decision_changes(i: Inputs):
    """Two stored runs, each with records that the other lacks, read back and compared."""
    folder, line = shared_folder(i.spark, "decisions"), F.col("line")
    earlier = S.classify(candidates(i), PREVIOUS).withColumnsRenamed({"decision": "was_decision", "reason": "was_reason"}).drop("gtin")
    both = durable(S.classify(earlier, POLICY).select("line", "source_record_id", "gtin", "decision", "reason", "was_decision", "was_reason"))  # the candidates are built once
    both.filter(line % 50 != 1).select("source_record_id", "gtin", "decision", "reason").write.parquet(f"{folder}/now")
    both.filter(line % 50 != 2).select("source_record_id", "gtin", F.col("was_decision").alias("decision"), F.col("was_reason").alias("reason")).write.parquet(f"{folder}/was")
    return S.compare_versions(i.spark.read.parquet(f"{folder}/now"), i.spark.read.parquet(f"{folder}/was"))
