"""Certificates against the certifier registry, migration of assessments, review adjudication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import clock, ids, text

# Match bases that bind a certificate to exactly one product.
EXACT_MATCH = ["exact-gtin", "explicit-product-list", "exact-batch"]
POSITIVE = ["halal-certified", "halal-reviewed"]
FINAL = [*POSITIVE, "not-halal", "questionable", "unknown"]
# Reason code and severity of each final decision.
DECISION_REASON = {
    "halal-reviewed": ("completed-methodology-review", "positive"),
    "halal-certified": ("current-exact-certification", "positive"),
    "not-halal": ("confirmed-prohibited-evidence", "prohibitive"),
    "questionable": ("reviewed-unresolved-ambiguity", "caution"),
    "unknown": ("reviewed-insufficient-evidence", "caution"),
}


def eligibility(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """Add eligible, reasons and derived status to certificate claims.

    A claim is a certificate next to the product it is used for: the certificate's columns, plus
    claim_gtin, claim_market, claim_ingredient, bound_ingredient and the instant ``at``.
    Unregistered certifiers fail closed.
    """
    c, at = F.col, F.col("at")
    entry = registry.select(
        "certifier", "scheme", c("state").alias("reg_state"), c("markets").alias("reg_markets"), "match_kinds", "max_recheck_days",
        c("sources").alias("reg_sources"), c("reviewed_at").alias("reg_reviewed_at"), c("next_review_at").alias("reg_next_review_at"),
    )
    joined = claims.join(entry, ["certifier", "scheme"], "left")
    on = lambda cond, reason: F.when(F.coalesce(cond, F.lit(False)), reason)
    checked = clock.instant(c("last_checked_at"))
    effective, expiry = clock.instant(c("effective_at")), clock.instant(c("expiry_at"))
    revoked, suspended = clock.instant(c("revoked_at")), clock.instant(c("suspended_at"))
    required = {"certificateReference": "certificate_reference", "scope": "scope", "sourceRecordID": "source_record_id", "lastCheckedAt": "last_checked_at"}
    same_formulation = F.coalesce(c("claim_ingredient") == c("bound_ingredient"), F.lit(False))
    reasons = F.array_compact(
        F.array(
            on(c("reg_state") != "accepted", F.concat(F.lit("certifier-state-"), "reg_state")),
            on(at < clock.instant(c("reg_reviewed_at")), "certifier-review-not-yet-effective"),
            on(at >= clock.instant(c("reg_next_review_at")), "certifier-review-expired"),
            on(c("gtin") != c("claim_gtin"), "certificate-gtin-mismatch"),
            on((c("market") != c("claim_market")) | ~F.array_contains("reg_markets", c("claim_market")), "certificate-market-mismatch"),
            on(~F.array_contains("reg_sources", c("source_key")), "certificate-source-not-approved"),
            on(~c("match_basis").isin(*EXACT_MATCH) | ~F.array_contains("match_kinds", c("match_basis")), "certificate-match-not-exact"),
            on(~same_formulation, "certificate-formulation-mismatch"),
            *(on(~text.has_text(c(col)), f"certificate-{name}-missing") for name, col in required.items()),
            on(~F.coalesce(c("evidence_hash").rlike(r"\A[0-9a-f]{64}\z"), F.lit(False)), "certificate-evidence-hash-missing"),
            on(effective > at, "certificate-not-yet-effective"), on(at >= expiry, "certificate-expired"),
            on(revoked <= at, "certificate-revoked"), on(suspended <= at, "certificate-suspended"),
            on(checked > at, "certificate-last-check-future"),
            on((checked <= at) & (at > clock.plus_days(checked, c("max_recheck_days"))), "certificate-recheck-stale"),
        )
    )
    known = c("reg_state").isNotNull()
    found = F.coalesce(c("found"), F.lit(True)) if "found" in claims.columns else F.lit(True)
    final = (
        F.when(~found, F.array(F.lit("certificate-record-missing")))
        .when(~known, F.array(F.lit("certifier-scheme-not-registered")))
        .otherwise(F.array_sort(F.array_distinct(reasons)))
    )
    derived = (
        F.when(~known, "unknown").when(suspended <= at, "suspended").when(revoked <= at, "revoked")
        .when(at >= expiry, "expired").when(effective > at, "not-yet-effective").otherwise("active")
    )
    return joined.withColumn("reasons", final).withColumn("eligible", F.size("reasons") == 0).withColumn("derived_status", derived)


def certified_claims(e: dict[str, DataFrame], as_of: str) -> DataFrame:
    """Claims of the currently selected certified assessments, one per linked certificate."""
    c = F.col
    sel = e["selection"].select(c("id").alias("selection_id"), c("gtin").alias("claim_gtin"), c("market").alias("claim_market"),
                                c("ingredient_id").alias("claim_ingredient"), "assessment_id")
    asm = e["assessment"].filter("status = 'halal-certified'").select(c("id").alias("assessment_id"), c("ingredient_id").alias("bound_ingredient"))
    links = sel.join(asm, "assessment_id").join(e["assessment_cert"], "assessment_id")
    certs = e["certification"].withColumnRenamed("id", "certification_id").drop("k").withColumn("found", F.lit(True))
    return links.join(certs, "certification_id", "left").fillna(False, ["found"]).withColumn("at", F.lit(as_of).cast("timestamp"))


def certification_status(e: dict[str, DataFrame], registry: DataFrame, as_of: str) -> DataFrame:
    """Per certified selection: carry forward or invalidate, with the reasons."""
    c = F.col
    judged = eligibility(certified_claims(e, as_of), registry)
    per = judged.groupBy("selection_id").agg(
        F.count_if("eligible").alias("eligible_certificates"), F.array_distinct(F.flatten(F.collect_set("reasons"))).alias("cert_reasons")
    )
    sel = e["selection"].select(c("id").alias("selection_id"), "gtin", "market", "assessment_id", "conflict_flags")
    certified = sel.join(e["assessment"].filter("status = 'halal-certified'").select(c("id").alias("assessment_id")), "assessment_id")
    changed = changed_certificates(e, certified)
    rows = certified.join(per, "selection_id", "left").join(changed, "selection_id", "left")
    none = F.array().cast("array<string>")
    eligible = F.coalesce("eligible_certificates", F.lit(0)) > 0
    cert_reasons = F.coalesce("cert_reasons", none)
    blocking = F.array_compact(
        F.array(
            F.when(c("certificates_changed"), "certification-selection-changed"),
            F.when(F.coalesce(F.size("conflict_flags") > 0, F.lit(False)), "current-formulation-conflict"),
            F.when(~eligible & (F.size(cert_reasons) == 0), "no-eligible-certification"),
        )
    )
    reasons = F.array_sort(F.array_distinct(F.concat(cert_reasons, blocking)))
    return rows.select(
        "selection_id", "gtin", "market", "assessment_id", F.coalesce("eligible_certificates", F.lit(0)).alias("eligible_certificates"),
        F.when(eligible & (F.size(blocking) == 0), "carry-forward").otherwise("invalidate").alias("action"), reasons.alias("reasons"),
    )


def changed_certificates(e: dict[str, DataFrame], selections: DataFrame) -> DataFrame:
    """Selections whose linked certificates are not exactly those of their assessment."""
    keys = selections.select("selection_id", "assessment_id")
    own = keys.join(e["assessment_cert"], "assessment_id").select("selection_id", F.col("certification_id").alias("ref"), F.lit(1).alias("_a"))
    linked = e["selection_link"].filter("kind = 'certification'").select("selection_id", F.col("ref_id").alias("ref"), F.lit(1).alias("_s"))
    linked = linked.join(keys.select("selection_id"), "selection_id", "left_semi")
    odd = own.join(linked, ["selection_id", "ref"], "full").filter("_a is null or _s is null")
    return odd.select("selection_id").distinct().withColumn("certificates_changed", F.lit(True))


def migration(e: dict[str, DataFrame], methodology_version: str, status: DataFrame) -> DataFrame:
    """Per assessed selection: can the assessment stay? Certificate invalidations are merged in."""
    c = F.col
    asm = e["assessment"].select(c("id").alias("assessment_id"), "status", "methodology_version", c("ingredient_id").alias("asm_ingredient"))
    sel = e["selection"].withColumnRenamed("id", "selection_id").join(asm, "assessment_id")
    ing = e["ingredient"].select(c("id").alias("ingredient_id"), c("supersedes_id").alias("ing_supersedes"))
    rows = (
        sel.join(ing, "ingredient_id", "left").join(changed_certificates(e, sel), "selection_id", "left")
        .join(status.filter("action = 'invalidate'").select("selection_id", c("reasons").alias("cert_reasons")), "selection_id", "left")
    )
    moved = ~c("ingredient_id").eqNullSafe(c("asm_ingredient")) | F.coalesce(c("ing_supersedes") == c("asm_ingredient"), F.lit(False))
    flagged = F.coalesce(F.size("conflict_flags") > 0, F.lit(False))
    own = F.array_compact(
        F.array(
            F.when(moved, "selected-formulation-changed"),
            F.when(c("methodology_version") != methodology_version, "methodology-version-changed"),
            F.when((c("status") == "halal-certified") & c("certificates_changed"), "certification-selection-changed"),
            F.when(flagged & c("status").isin(*POSITIVE), "current-formulation-conflict"),
        )
    )
    reasons = F.array_sort(F.array_union(own, F.coalesce("cert_reasons", F.array().cast("array<string>"))))
    invalid = (F.size(own) > 0) | c("cert_reasons").isNotNull()
    return rows.select(
        "gtin", "market", "assessment_id", F.when(invalid, "invalidate").otherwise("carry-forward").alias("action"), reasons.alias("reasons")
    )


def invalidation_events(decisions: DataFrame, occurred_at: str) -> DataFrame:
    """Validity events of the invalidated assessments."""
    reason = F.coalesce(F.nullif(F.array_join("reasons", "; "), F.lit("")), F.lit("methodology compatibility invalidated"))
    rows = decisions.filter("action = 'invalidate'").select(
        "assessment_id", F.lit("invalidated").alias("kind"), F.lit(occurred_at).alias("occurred_at"), reason.alias("reason")
    )
    fields = {"assessmentID": F.col("assessment_id"), "kind": F.col("kind"), "occurredAt": F.col("occurred_at"), "reason": F.col("reason")}
    return rows.withColumn("id", ids.evidence_id("validity-event", fields))


def adjudicate(inputs: DataFrame, analyses: DataFrame, claims: DataFrame, registry: DataFrame, methodology_version: str) -> DataFrame:
    """Human decisions joined to their analysis: accepted, or the first rule they break.

    ``claims`` are the certificates of the analysed products (see ``eligibility``), judged at the
    time of the review they support.
    """
    c = F.col
    judged = eligibility(claims, registry).filter("eligible").groupBy("review_id").agg(
        F.array_sort(F.collect_set("certification_id")).alias("certificates")
    )
    rows = inputs.join(analyses, ["gtin", "market"], "left").join(judged, "review_id", "left")
    decision = c("decision")
    positive, negative = decision.isin(*POSITIVE), decision == "not-halal"
    resolved, opened = c("resolved_queues"), c("open_queues")
    rejected = (
        F.when(c("analysis_version").isNull(), "no-analysis")
        .when(c("analysis_version") != methodology_version, "methodology-mismatch")
        .when(c("ingredient_id").isNull() & (positive | negative), "ingredient-evidence-missing")
        .when(~decision.isin(*FINAL), "unsupported-decision")
        .when(~text.has_text(c("reviewer_id")), "reviewer-blank")
        .when(clock.instant(c("next_review_at")) <= clock.instant(c("reviewed_at")), "next-review-not-later")
        .when(~text.has_text(c("reason")), "reason-blank")
        .when(F.size(F.array_except(resolved, opened)) > 0, "queue-not-open")
        .when(positive & c("prohibited"), "prohibited-candidate-unresolved")
        .when(positive & (F.size(F.array_except(opened, resolved)) > 0), "queues-unresolved")
        .when(positive & (c("freshness_state") != "fresh"), "formulation-not-fresh")
        .when(positive & c("conflicted"), "formulation-conflict")
        .when(negative & ~F.array_contains(resolved, "clear-prohibited-confirmation"), "prohibition-not-confirmed")
        .when(negative & ~c("prohibited"), "no-prohibited-candidate")
        .when((decision == "halal-certified") & c("certificates").isNull(), "no-eligible-certificate")
    )
    by_decision = lambda n: F.coalesce(*(F.when(decision == d, F.lit(v[n])) for d, v in DECISION_REASON.items()))
    out = rows.withColumn("rejection", rejected)
    ok = c("rejection").isNull()
    certificates = F.when(decision == "halal-certified", c("certificates"))
    evidence = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(c("ingredient_id")), F.coalesce(certificates, F.array().cast("array<string>"))))))
    fields = {
        "gtin": c("gtin"), "market": c("market"), "status": decision, "methodologyVersion": F.lit(methodology_version),
        "assessedAt": c("reviewed_at"), "certificationIDs": F.coalesce(certificates, F.array().cast("array<string>")),
        "evidenceIDs": evidence, "recheckAt": c("next_review_at"), "ingredientObservationID": c("ingredient_id"),
    }
    return out.select(
        "review_id", "gtin", "market", "decision", "rejection",
        F.when(ok, ids.evidence_id("assessment", fields)).alias("assessment_id"),
        F.when(ok, by_decision(0)).alias("reason_code"), F.when(ok, by_decision(1)).alias("severity"),
        F.when(ok, F.array_join(evidence, "|")).alias("evidence_ids"), "reviewer_id", "reviewed_at", "next_review_at",
    )
