"""Policy-driven selection of candidates and its reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import barcodes, text
from larder.functions.stage import once
from larder.policy import SelectionPolicy
from larder.session import durable

INCLUDE, BASIC, INVALID = "include-detailed", "exclude-basic", "exclude-invalid"


def _meets(column: str, values: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*map(F.lit, values)))


def _outcome(decision: str, reason: str) -> Column:
    return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))


def classify(candidates: DataFrame, policy: SelectionPolicy) -> DataFrame:
    """Add gtin, decision and reason: the first rule of the policy that applies."""
    count = F.col("ingredient_count")
    rules: list[tuple[Column, str, str]] = [
        (~F.col("product_type").isin(*policy.product_types), INVALID, "non-food"),
        (F.col("market") != policy.market, INVALID, "wrong-market"),
        (F.col("barcode_kind") == "source-assigned-no-barcode", INVALID, "source-assigned-no-barcode"),
        (~F.col("barcode_kind").isin(*policy.barcode_kinds), INVALID, "unsupported-barcode-kind"),
        (F.col("gtin").isNull(), INVALID, "invalid-or-unsupported-barcode"),
        (_meets("evidence_signals", policy.evidence_signals), INCLUDE, "existing-evidence"),
        (_meets("formulation_signals", policy.formulation_signals), INCLUDE, "formulation-signal"),
        (_meets("category_signals", policy.category_signals), INCLUDE, "included-category"),
        (count > 1, INCLUDE, "multi-ingredient"),
        (text.has_text(F.col("ingredients_text")) & count.isNull(), INCLUDE, "ingredients-present-unquantified"),
    ]
    for rule in policy.basic_rules:
        known = count <= rule.max_ingredients
        fits = F.when(count.isNull(), F.lit(rule.unknown_count_ok and rule.max_ingredients >= 0)).otherwise(known)
        rules.append((_meets("category_signals", rule.signals) & fits, BASIC, rule.code))
    outcome = reduce(
        lambda chain, r: chain.when(r[0], _outcome(r[1], r[2])),
        rules[1:],
        F.when(rules[0][0], _outcome(rules[0][1], rules[0][2])),
    ).otherwise(_outcome(INCLUDE, "conservative-unknown"))
    coded = once(candidates, gtin=barcodes.gtin14(F.col("barcode")))
    return coded.select("*", F.inline(F.array(outcome)))


def selected(decisions: DataFrame, policy: SelectionPolicy) -> DataFrame:
    """Included rows in their evidence form: arrays as sorted sets, images ordered."""
    arrays = ("category_tags", "category_signals", "formulation_signals", "evidence_signals", "retailer_keys", "package_signals")
    return decisions.filter(F.col("decision") == INCLUDE).select(
        "line", "source_record_id", "barcode", "gtin", "market", "name", "brand", "ingredients_text", "ingredient_count",
        F.lit(policy.version).alias("policy_version"), F.col("reason").alias("reason_code"),
        *(text.sorted_set(F.col(a)).alias(a) for a in arrays),
        F.array_sort("remote_images").alias("remote_images"),
    )


def basic_exclusions(decisions: DataFrame, policy: SelectionPolicy) -> DataFrame:
    return decisions.filter(F.col("decision") == BASIC).select(
        "gtin", "market", F.lit(policy.version).alias("policy_version"), F.col("reason").alias("reason_code")
    )


def invalid_exclusions(decisions: DataFrame, policy: SelectionPolicy) -> DataFrame:
    return decisions.filter(F.col("decision") == INVALID).select(
        "source_record_id", "barcode", "market", "gtin",
        F.lit(policy.version).alias("policy_version"), F.col("reason").alias("reason_code"),
    )


def report(decisions: DataFrame, policy: SelectionPolicy) -> DataFrame:
    """(metric, key, n) rows; one partial aggregation over decisions and reasons."""
    cells = decisions.groupBy("decision", "reason").agg(
        F.count("*").alias("n"),
        F.count_if(text.has_text(F.col("ingredients_text"))).alias("with_text"),
        F.count_if(F.col("market") == policy.market).alias("in_market"),
    )
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    d = F.col("decision")
    overall = cells.agg(
        total(F.lit(True)).alias("examined"),
        F.coalesce(F.sum("in_market"), F.lit(0)).alias("target_market"),
        total(d != INVALID).alias("eligible"),
        total(d == INCLUDE).alias("included"),
        total(d == BASIC).alias("excluded_basic"),
        total(d == INVALID).alias("excluded_invalid"),
        F.coalesce(F.sum(F.when(d == INCLUDE, F.col("with_text"))), F.lit(0)).alias("included_with_ingredients"),
        F.coalesce(F.sum(F.when(d == INCLUDE, F.col("n") - F.col("with_text"))), F.lit(0)).alias("included_missing_ingredients"),
    )
    names = overall.columns
    totals = overall.unpivot([], names, "metric", "n").select("metric", F.lit("").alias("key"), "n")
    return totals.unionByName(cells.select(d.alias("metric"), F.col("reason").alias("key"), "n"))


def top_values(decisions: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent categories, brands and retailers of the rows that are not invalid."""
    values = (
        decisions.filter(F.col("decision") != INVALID)
        .select(
            F.explode(
                F.concat(
                    F.transform("category_tags", lambda v: F.struct(F.lit("category").alias("kind"), v.alias("value"))),
                    F.when(
                        text.has_text(F.col("brand")),
                        F.array(F.struct(F.lit("brand").alias("kind"), F.col("brand").alias("value"))),
                    ).otherwise(F.array().cast("array<struct<kind:string,value:string>>")),
                    F.transform("retailer_keys", lambda v: F.struct(F.lit("retailer").alias("kind"), v.alias("value"))),
                )
            ).alias("v")
        )
        .groupBy("v.kind", "v.value")
        .agg(F.count("*").alias("n"))
    )
    values = durable(values)  # read once for each kind
    parts = [
        values.filter(F.col("kind") == kind).orderBy(F.desc("n"), "value").limit(limit)
        for kind in ("category", "brand", "retailer")
    ]
    return reduce(DataFrame.unionByName, parts)


def audit_sample(decisions: DataFrame, policy: SelectionPolicy) -> DataFrame:
    """The basic exclusions with the smallest hash of policy, record, gtin, market and reason."""
    rank = F.sha2(
        F.concat_ws("|", F.lit(policy.version), "source_record_id", F.coalesce("gtin", F.lit("")), "market", "reason"), 256
    )
    return (
        decisions.filter(F.col("decision") == BASIC)
        .select("source_record_id", "gtin", "market", "name", "reason", rank.alias("rank_hash"))
        .orderBy("rank_hash", "source_record_id")
        .limit(policy.audit_sample)
    )


def compare_policies(candidates: DataFrame, current: SelectionPolicy, previous: SelectionPolicy) -> DataFrame:
    """Rows whose decision differs between two policies.

    Both policies read the same candidates, so both cascades run in one pass over one row: no join.
    """
    both = classify(candidates, current).withColumnsRenamed({"decision": "current_decision", "reason": "current_reason"})
    both = classify(both.drop("gtin"), previous).withColumnsRenamed(
        {"decision": "previous_decision", "reason": "previous_reason"}
    )
    changed = (F.col("current_decision") != F.col("previous_decision")) | (F.col("current_reason") != F.col("previous_reason"))
    return both.filter(changed).select(
        "source_record_id", "gtin", "previous_decision", "previous_reason", "current_decision", "current_reason"
    )


def compare_versions(current: DataFrame, previous: DataFrame) -> DataFrame:
    """The same comparison for two stored decision tables, joined by record."""
    left = current.select("source_record_id", "gtin", F.col("decision").alias("current_decision"), F.col("reason").alias("current_reason"))
    right = previous.select(
        "source_record_id", F.col("gtin").alias("previous_gtin"),
        F.col("decision").alias("previous_decision"), F.col("reason").alias("previous_reason"),
    )
    same = F.col("current_decision").eqNullSafe(F.col("previous_decision")) & F.col("current_reason").eqNullSafe(
        F.col("previous_reason")
    )
    return (
        left.join(right, "source_record_id", "full")
        .filter(~same)
        .select(
            "source_record_id", F.coalesce("gtin", "previous_gtin").alias("gtin"),
            "previous_decision", "previous_reason", "current_decision", "current_reason",
        )
    )


def candidate_violations(candidates: DataFrame) -> DataFrame:
    """(source_record_id, rule, field) for every contract breach, including repeated record ids."""
    c = F.col
    signal = r"\A[a-z0-9][a-z0-9-]*\z"
    empty = F.array().cast("array<struct<rule:string,field:string>>")

    def flag(cond: Column, rule: str, name: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("field")))

    checks = [
        flag(~text.has_text(c(f)), "blank", f)
        for f in ("source_record_id", "barcode", "market", "product_type", "barcode_kind", "name")
    ]
    checks += [flag(c(f).isNotNull() & ~text.has_text(c(f)), "blank", f) for f in ("brand", "ingredients_text")]
    checks.append(flag(~c("market").rlike(r"\A[A-Z]{2}\z"), "market", "market"))
    checks.append(flag(c("ingredient_count") < 0, "negative", "ingredient_count"))
    for f in ("category_tags", "category_signals", "formulation_signals", "evidence_signals", "package_signals", "retailer_keys"):
        checks.append(flag(F.size(F.array_distinct(f)) < F.size(f), "duplicate-value", f))
        checks.append(flag(F.exists(f, lambda v: ~text.has_text(v)), "blank", f))
    for f in ("category_signals", "formulation_signals", "evidence_signals", "package_signals"):
        checks.append(flag(F.exists(f, lambda v: text.has_text(v) & ~v.rlike(signal)), "signal", f))
    checks.append(
        flag(F.exists("remote_images", lambda i: ~F.coalesce(i["url"].rlike(r"\Ahttps://[^/?#]+"), F.lit(False))), "https", "remote_images")
    )
    checks.append(
        flag(
            F.exists("remote_images", lambda i: ~i["purpose"].isin("front", "ingredients", "barcode", "nutrition", "certification")),
            "enum", "remote_images",
        )
    )
    rows = candidates.select("source_record_id", F.inline(F.coalesce(F.array_compact(F.array(*checks)), empty)))
    repeated = (
        candidates.groupBy("source_record_id").agg(F.count("*").alias("n")).filter("n > 1")
        .select("source_record_id", F.lit("duplicate-record").alias("rule"), F.lit("source_record_id").alias("field"))
    )
    return rows.unionByName(repeated)
