"""Quality of the current selections: findings, metrics, samples and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import clock
from larder.functions.stage import once
from larder.operators.evidence import union_all
from larder.policy import QualityPolicy

# Enumerations whose counts are reported even when zero.
STATUSES = ["halal-certified", "halal-reviewed", "not-halal", "questionable", "unknown"]
FRESHNESS = ["changed-unreviewed", "date-unknown", "fresh", "refresh-recommended", "stale"]
CERT_STATES = [
    "current", "date-unknown", "expired", "not-effective", "refresh-recommended", "revoked", "stale-check", "suspended",
]
BAD_CERT_STATES = ["expired", "revoked", "suspended", "not-effective", "date-unknown", "stale-check"]
# Codes that block a release, quarantine it, or roll it back.
BLOCKERS = [
    "source-unapproved", "source-policy-missing", "source-license-missing", "source-attribution-missing",
    "source-snapshot-mismatch", "unsafe-positive-inheritance", "positive-with-formulation-conflict",
    "positive-second-review-missing", "certification-invalid", "certification-scope-mismatch",
    "unexpected-count-decrease", "unexpected-count-increase", "parser-error-rate-exceeded", "adapter-contract-invalid",
]
QUARANTINE = [
    "unsafe-positive-inheritance", "positive-with-formulation-conflict", "certification-invalid",
    "certification-scope-mismatch", "parser-error-rate-exceeded", "adapter-contract-invalid",
]
ROLLBACK = [
    "unsafe-positive-inheritance", "positive-with-formulation-conflict", "certification-invalid", "certification-scope-mismatch",
]

POLICY = QualityPolicy()


def retailer_state(as_of: Column, policy: QualityPolicy = POLICY) -> Column:
    """Freshness of a retailer row by the first anchor present."""
    return clock.freshness(F.coalesce("observed_at", "snapshot_at"), as_of, policy.retailer)


def cert_state(as_of: Column, policy: QualityPolicy | None = POLICY) -> Column:
    names = ("revoked_at", "suspended_at", "effective_at", "expiry_at", "last_checked_at")
    return clock.certificate_state({n: F.col(n) for n in names}, as_of, policy.certification if policy else None)


def reviewer_counts(reviews: DataFrame) -> DataFrame:
    """Per target: distinct approving reviewers, last approval, rejections."""
    approved = F.col("state") == "approved"
    return reviews.groupBy("target_id").agg(
        F.count_distinct(F.when(approved, F.col("reviewer_id"))).alias("reviewers"),
        F.max(F.when(approved, F.col("reviewed_at"))).alias("last_approved_at"),
        F.count_if(F.col("state").isin("rejected", "superseded")).alias("terminal_reviews"),
    )


def active_formulations(ingredients: DataFrame) -> DataFrame:
    """Per (gtin, market): ingredient rows no other row of the key supersedes, and their distinct hashes."""
    replaced = ingredients.filter("supersedes_id is not null").select(F.col("supersedes_id").alias("id"), "gtin", "market")
    active = ingredients.join(replaced, ["id", "gtin", "market"], "left_anti")
    return active.groupBy("gtin", "market").agg(
        F.count("*").alias("active"), F.count_distinct("content_hash").alias("active_hashes")
    )


def selection_facts(e: dict[str, DataFrame], as_of: str, policy: QualityPolicy = POLICY) -> DataFrame:
    """One wide row per current selection; every join is on a unique id or a pre-aggregated key."""
    c, at = F.col, F.lit(as_of).cast("timestamp")
    idn = e["identity"].select(
        c("id").alias("identity_id"), c("source_key").alias("identity_source"), "confidence", "brand", "categories",
        c("source_record_id").alias("identity_record"), "source_modified_at", "name", "quantity",
    )
    src = e["source"].select(c("source_key").alias("identity_source"), c("source_class").alias("identity_class"))
    ing = e["ingredient"].select(
        c("id").alias("ingredient_id"), c("observed_at").alias("ing_observed_at"), c("supersedes_id").alias("ing_supersedes"),
        "capture_method", "verification_state", "language_code", "transformation_percent", "source_revision",
        c("source_key").alias("ingredient_source"), c("ingredients_text"), c("content_hash"), F.lit(True).alias("has_ingredient"),
    )
    asm = e["assessment"].select(
        c("id").alias("assessment_id"), "status", "methodology_version", c("ingredient_id").alias("asm_ingredient"),
        c("assessed_at"), c("recheck_at"), F.lit(True).alias("has_assessment"),
    )
    rev = reviewer_counts(e["review"])
    by_asm = rev.select(
        c("target_id").alias("assessment_id"), c("reviewers").alias("asm_reviewers"), "terminal_reviews", "last_approved_at"
    )
    by_ing = rev.select(c("target_id").alias("ingredient_id"), c("reviewers").alias("ing_reviewers"))
    joined = (
        e["selection"].withColumnRenamed("id", "selection_id")
        .join(idn, "identity_id", "left").join(src, "identity_source", "left")
        .join(ing, "ingredient_id", "left").join(by_ing, "ingredient_id", "left")
        .join(asm, "assessment_id", "left").join(by_asm, "assessment_id", "left")
        .join(active_formulations(e["ingredient"]), ["gtin", "market"], "left")
    )
    zero = F.lit(0)
    has_ing = F.coalesce(c("has_ingredient"), F.lit(False))
    bound = c("asm_ingredient").eqNullSafe(c("ingredient_id"))
    approvals = F.coalesce(c("ing_reviewers"), zero) + F.when(bound, F.coalesce(c("asm_reviewers"), zero)).otherwise(zero)
    state = (
        F.when(~has_ing, "date-unknown")
        .when(c("ing_supersedes").isNotNull() & (approvals == 0), "changed-unreviewed")
        .otherwise(clock.freshness(c("ing_observed_at"), at, policy.formulation))
    )
    flagged = F.coalesce(F.size("conflict_flags") > 0, F.lit(False))
    return once(
        joined,
        has_text=has_ing,
        formulation_state=state,
        flagged=flagged,
        conflict=has_ing & ((F.coalesce(c("active_hashes"), zero) > 1) | flagged),
        positive=F.coalesce(c("status").isin(*policy.positive_statuses), F.lit(False)),
        bound=bound,
        reviewer_deficit=F.coalesce(c("status").isin(*policy.positive_statuses), F.lit(False))
        & (F.coalesce(c("asm_reviewers"), zero) < F.when(c("identity_class") == "synthetic", 1).otherwise(policy.min_reviewers)),
    )


def certificate_facts(e: dict[str, DataFrame], facts: DataFrame, as_of: str, policy: QualityPolicy = POLICY) -> DataFrame:
    """Selected certificate links with the certificate's state and key."""
    at = F.lit(as_of).cast("timestamp")
    certs = e["certification"].select(
        F.col("id").alias("ref_id"), F.col("gtin").alias("cert_gtin"), F.col("market").alias("cert_market"),
        F.lit(True).alias("found"), cert_state(at, policy).alias("cert_state"),
    )
    links = e["selection_link"].filter("kind = 'certification'").select("selection_id", "ref_id")
    return links.join(facts.select("selection_id", "gtin", "market", "status"), "selection_id").join(certs, "ref_id", "left")


def findings(e: dict[str, DataFrame], as_of: str, policy: QualityPolicy = POLICY) -> DataFrame:
    """Distinct (severity, code, gtin, market, evidence_id) of the current selections."""
    c = F.col
    facts = selection_facts(e, as_of, policy)

    def finding(severity: str, code: Column | str, evidence: Column, when: Column) -> Column:
        code = F.lit(code) if isinstance(code, str) else code
        return F.when(when, F.struct(F.lit(severity).alias("severity"), code.alias("code"), evidence.alias("evidence_id")))

    none = F.lit(None).cast("string")
    checks = [
        finding("warning", "ingredients-missing", none, ~c("has_text")),
        finding(
            "warning", F.concat(F.lit("formulation-"), "formulation_state"), c("ingredient_id"),
            c("has_text") & (c("formulation_state") != "fresh"),
        ),
        finding("warning", "formulation-conflict", none, c("conflict")),
        finding("blocker", "positive-with-formulation-conflict", c("assessment_id"), c("conflict") & c("positive")),
        finding("blocker", "unsafe-positive-inheritance", c("assessment_id"), c("has_text") & c("positive") & ~c("bound")),
        finding("blocker", "positive-second-review-missing", c("assessment_id"), c("reviewer_deficit")),
    ]
    product = facts.select("gtin", "market", F.inline(F.array_compact(F.array(*checks))))
    certs = certificate_facts(e, facts, as_of, policy)
    bad = c("cert_state").isin(*BAD_CERT_STATES)
    missing = c("found").isNull()
    cert_checks = [
        finding("blocker", "certification-invalid", c("ref_id"), missing),
        finding(
            "blocker", "certification-scope-mismatch", c("ref_id"), (c("cert_gtin") != c("gtin")) | (c("cert_market") != c("market"))
        ),
        finding("warning", F.concat(F.lit("certification-"), "cert_state"), c("ref_id"), bad),
        finding("blocker", "certification-invalid", c("ref_id"), bad & (c("status") == "halal-certified")),
    ]
    cert = certs.select("gtin", "market", F.inline(F.array_compact(F.array(*cert_checks))))
    return product.unionByName(cert).distinct()


def _histogram(df: DataFrame, groups: dict[str, tuple[Column, list[str] | None]]) -> DataFrame:
    """(metric, key, n): enumerated groups are counted in place and thus zero-filled; one pass, one row per task shuffled."""
    aggs, labels = [], []
    for metric, (column, values) in groups.items():
        for value in values or [""]:
            name = f"a{len(aggs)}"
            aggs.append(F.count_if(column == value if values else column).alias(name))
            labels.append(F.struct(F.lit(metric).alias("metric"), F.lit(value).alias("key"), F.col(name).alias("n")))
    return df.agg(*aggs).select(F.inline(F.array(*labels)))


def metrics(e: dict[str, DataFrame], as_of: str, policy: QualityPolicy = POLICY) -> DataFrame:
    """Zero-filled histograms and counts of the report, as (metric, key, n)."""
    c, at = F.col, F.lit(as_of).cast("timestamp")
    facts = selection_facts(e, as_of, policy)
    machine = c("has_text") & ((c("capture_method") == "ocr") | c("verification_state").isin("unverified", "machine-assisted"))
    selection = _histogram(
        facts,
        {
            "formulation": (c("formulation_state"), FRESHNESS),
            "assessment": (c("status"), STATUSES),
            "products": (F.lit(True), None),
            "missing-ingredients": (~c("has_text"), None),
            "formulation-conflicts": (c("conflict"), None),
            "second-review-deficits": (c("reviewer_deficit"), None),
            "machine-assisted": (machine, None),
        },
    )
    certs = _histogram(certificate_facts(e, facts, as_of, policy), {"certificate": (c("cert_state"), CERT_STATES)})
    retail = _histogram(
        e["retailer"], {"retailer": (retailer_state(at, policy), [s for s in FRESHNESS if s != "changed-unreviewed"])}
    )
    reviews = e["review"].groupBy(F.lit("review").alias("metric"), c("state").alias("key")).agg(F.count("*").alias("n"))
    classes = e["source"].groupBy(F.lit("source-class").alias("metric"), c("source_class").alias("key")).agg(F.count("*").alias("n"))
    return union_all(selection, certs, retail, reviews, classes)


def source_rights(sources: DataFrame, policies: DataFrame) -> DataFrame:
    """(source_key, code) for used sources without policy, licence or attribution."""
    c = F.col
    joined = sources.select("source_key").join(policies, "source_key", "left")
    blank = lambda name: F.coalesce(F.trim(name), F.lit("")) == ""
    missing = c("enabled").isNull()
    codes = F.array_compact(
        F.array(
            F.when(missing | ~c("enabled"), "source-unapproved"),
            F.when(missing, "source-policy-missing"),
            F.when(~missing & blank("license_identifier"), "source-license-missing"),
            F.when(~missing & blank("attribution"), "source-attribution-missing"),
        )
    )
    return joined.select("source_key", F.explode(codes).alias("code"))


def terms_review(sources: DataFrame, reviews: DataFrame, as_of: str) -> DataFrame:
    """Per source: is its terms review approved, in force at the evaluation time, and does it cover the licence?"""
    c, at = F.col, F.lit(as_of).cast("timestamp")
    joined = sources.join(reviews, "source_key", "left")
    reason = (
        F.when(c("review_state").isNull(), "no-review")
        .when(c("review_state") != "approved", F.concat(F.lit("review-"), "review_state"))
        .when(clock.instant(c("reviewed_at")) > at, "not-yet-effective")
        .when(at >= clock.instant(c("expires_at")), "expired")
        .when(c("license_identifier").isNotNull() & ~F.array_contains("covered", c("license_identifier")), "license-not-covered")
    )
    return joined.select("source_key", F.when(reason.isNull(), "approved").otherwise("invalid").alias("state"), reason.alias("reason"))


def coverage(e: dict[str, DataFrame], as_of: str, policy: QualityPolicy = POLICY) -> DataFrame:
    """(dimension, key, n) coverage buckets of selections and retailer rows."""
    c, at = F.col, F.lit(as_of).cast("timestamp")
    facts = selection_facts(e, as_of, policy)

    def cell(dimension: str, key: Column, when: Column | None = None) -> Column:
        pair = F.struct(F.lit(dimension).alias("dimension"), key.alias("key"))
        return pair if when is None else F.when(when, pair)

    has = c("has_text")
    transformed = (
        F.when(c("transformation_percent").isNull(), "none")
        .when(c("transformation_percent") >= 80, "verified-confidence").otherwise("low-confidence")
    )
    pairs = F.array_compact(
        F.array(
            cell("identity-confidence", F.coalesce("confidence", F.lit("missing"))),
            cell("language", c("language_code"), has),
            cell("verification", c("verification_state"), has),
            cell("capture", c("capture_method"), has),
            cell("transformation", transformed, has),
            cell("methodology", c("methodology_version"), F.coalesce("has_assessment", F.lit(False))),
            cell("ingredients", F.when(has, "present").otherwise("missing")),
            cell("observed-at", F.lit("present"), has & c("ing_observed_at").isNotNull()),
            cell("source-revision", F.lit("present"), has & c("source_revision").isNotNull()),
        )
    )
    rows = facts.select(F.inline(pairs))
    key = F.concat_ws("|", "retailer_key", "kind", retailer_state(at, policy))
    retail = e["retailer"].select(F.lit("retailer-kind-state").alias("dimension"), key.alias("key"))
    return rows.unionByName(retail).groupBy("dimension", "key").agg(F.count("*").alias("n"))


def coverage_fraction(cells: DataFrame) -> DataFrame:
    """Share of selections with current ingredient text, rounded half-even to six digits."""
    present = F.sum(F.when((F.col("dimension") == "ingredients") & (F.col("key") == "present"), F.col("n")).otherwise(0))
    total = F.sum(F.when(F.col("dimension") == "ingredients", F.col("n")).otherwise(0))
    return cells.agg(F.bround(present / total, 6).alias("fraction"))


def volume_drift(volumes: DataFrame, policy: QualityPolicy = POLICY) -> DataFrame:
    """(source_key, code) where record counts moved too far or too many lines failed to parse."""
    c = F.col
    delta = c("current_n") - c("previous_n")
    base = c("previous_n") >= policy.min_baseline
    rate = F.try_divide("malformed", c("current_n") + c("malformed"))
    codes = F.array_compact(
        F.array(
            F.when(base & (delta < 0) & (-delta / c("previous_n") > policy.max_decrease), "unexpected-count-decrease"),
            F.when(base & (delta > 0) & (delta / c("previous_n") > policy.max_increase), "unexpected-count-increase"),
            F.when(rate > policy.max_parser_errors, "parser-error-rate-exceeded"),
        )
    )
    return volumes.select("source_key", "previous_n", "current_n", F.explode(codes).alias("code"))


def _sample_hash(seed: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", F.lit(seed), *parts), 256)


def widening_sample(selections: DataFrame, found: DataFrame, policy: QualityPolicy = POLICY) -> DataFrame:
    """Base sample by hash; the wider one when too many base rows have a finding.

    Only the ``wide_sample`` smallest hashes leave the tasks; the rest runs on that many rows.
    """
    defects = found.select("gtin", "market").distinct().withColumn("_defect", F.lit(1))
    top = (
        selections.select("gtin", "market", _sample_hash(policy.seed, F.col("gtin"), F.col("market")).alias("rank_hash"))
        .orderBy("rank_hash", "gtin", "market").limit(policy.wide_sample)
        .join(defects, ["gtin", "market"], "left")
    )
    ranked = top.withColumn("position", F.row_number().over(Window.orderBy("rank_hash", "gtin", "market")))
    in_base = F.col("position") <= policy.base_sample
    everything = Window.partitionBy(F.lit(1))
    rate = F.sum(F.when(in_base, F.coalesce("_defect", F.lit(0)))).over(everything) / F.count_if(in_base).over(everything)
    sized = ranked.withColumn("defect_rate", F.bround(rate, 6)).withColumn("_wide", rate > policy.defect_rate)
    return sized.filter(F.col("_wide") | in_base).select("gtin", "market", "rank_hash", "defect_rate", F.col("_wide").alias("escalated"))


def stratified_sample(facts: DataFrame, changed: DataFrame, per_stratum: int = 3, policy: QualityPolicy = POLICY) -> DataFrame:
    """First rows of every source, status, category and change stratum by hash.

    The rank limit is applied inside each task before the shuffle, so a stratum with a third of all
    rows still sends only ``per_stratum`` rows per task.
    """
    c = F.col
    marked = facts.join(changed.select("gtin", "market", "change_kind").distinct(), ["gtin", "market"], "left")
    labels = F.concat(
        F.array_compact(
            F.array(
                F.concat(F.lit("source:"), F.coalesce("ingredient_source", "identity_source")),
                F.concat(F.lit("status:"), F.coalesce("status", F.lit("unassessed"))),
                F.concat(F.lit("change:"), c("change_kind")),
            )
        ),
        F.coalesce(F.transform("categories", lambda v: F.concat(F.lit("category:"), v)), F.array().cast("array<string>")),
    )
    rows = marked.select("gtin", "market", F.explode(labels).alias("stratum")).withColumn(
        "rank_hash", _sample_hash(policy.seed, c("stratum"), c("gtin"), c("market"))
    )
    order = Window.partitionBy("stratum").orderBy("rank_hash", "gtin", "market")
    return rows.withColumn("position", F.row_number().over(order)).filter(c("position") <= per_stratum)


def mandatory_review(facts: DataFrame, cert_links: DataFrame, changed: DataFrame, limit: int | None = None) -> DataFrame:
    """High-risk selections with their total; the first ``limit`` in key order where a caller asks for a bound, marked as cut."""
    certified = cert_links.select("selection_id").distinct().withColumn("_cert", F.lit(True))
    moved = changed.filter("change_kind = 'changed'").select("gtin", "market").distinct().withColumn("_moved", F.lit(True))
    risky = (
        facts.join(certified, "selection_id", "left").join(moved, ["gtin", "market"], "left")
        .filter(F.col("positive") | F.col("_cert") | F.col("flagged") | F.col("_moved"))
        .select("gtin", "market", F.coalesce("status", F.lit("unassessed")).alias("status"))
    )
    total = risky.agg(F.count("*")).scalar()
    listed = risky if limit is None else risky.orderBy("gtin", "market").limit(limit)
    return listed.withColumn("total", total).withColumn("truncated", F.lit(False) if limit is None else F.col("total") > limit)


def compare_metrics(computed: DataFrame, stored: DataFrame) -> DataFrame:
    """Metrics of a stored report that differ from the recomputed ones; absent counts are zero."""
    both = computed.withColumnRenamed("n", "computed_n").join(stored.withColumnRenamed("n", "stored_n"), ["metric", "key"], "full")
    both = both.fillna(0, ["computed_n", "stored_n"])
    return both.filter(F.col("computed_n") != F.col("stored_n"))


def worst_freshness(found: DataFrame) -> DataFrame:
    """Worst formulation state per key named by the warnings, fresh when none is."""
    # Precedence of the states.
    precedence = {"fresh": 0, "refresh-recommended": 1, "date-unknown": 2, "stale": 3, "changed-unreviewed": 4}
    state = F.substring("code", 13, 64)
    rank = F.coalesce(*(F.when(state == s, F.lit(n)) for s, n in precedence.items()))
    named = found.filter(F.col("code").startswith("formulation-")).withColumn("_rank", rank).filter("_rank is not null")
    worst = named.groupBy("gtin", "market").agg(F.max_by(state, "_rank").alias("state"))
    return worst
