"""Health, incident and release summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import ids
from larder.operators import quality
from larder.operators.evidence import union_all

DEFAULT_RETAILERS = ["rewe", "lidl"]
OFFICIAL_KINDS = ["official-feed", "official-listing", "official-product-listing"]


def evidence_class(kind: Column, declared: Column | None = None) -> Column:
    """official, community, observational or other."""
    kind = F.lower(F.trim(kind))
    declared = F.lit("") if declared is None else F.lower(F.trim(F.coalesce(declared, F.lit(""))))
    return (
        F.when((declared == "official") | kind.isin(*OFFICIAL_KINDS), "official")
        .when(kind.contains("community") | (declared == "community"), "community")
        .when(kind.contains("observation") | declared.isin("observational", "observation"), "observational")
        .otherwise("other")
    )


def breakdown(facts: DataFrame) -> DataFrame:
    """(dimension, key, n) of the current selections; sources count distinct (gtin, market)."""
    c = F.col
    cell = lambda dim, key: F.struct(F.lit(dim).alias("dimension"), key.alias("key"))
    status = F.coalesce("status", F.lit("unassessed"))
    cells = F.concat(
        F.array_compact(
            F.array(
                cell("market", c("market")), cell("status", status),
                F.when(F.coalesce("brand", F.lit("")) != "", cell("brand", c("brand"))),
                F.when(c("has_text"), cell("language", c("language_code"))),
                F.when(c("flagged"), cell("conflicted", F.lit(""))),
            )
        ),
        F.coalesce(F.transform("categories", lambda v: cell("category", v)), F.array().cast("array<struct<dimension:string,key:string>>")),
    )
    counted = facts.select(F.inline(cells)).groupBy("dimension", "key").agg(F.count("*").alias("n"))
    source = F.coalesce("ingredient_source", "identity_source")
    by_source = (
        facts.select(source.alias("key"), "gtin", "market").filter("key is not null").distinct()
        .groupBy("key").agg(F.count("*").alias("n")).select(F.lit("source").alias("dimension"), "key", "n")
    )
    return counted.unionByName(by_source)


def retailer_claims(linked: DataFrame, all_rows: DataFrame, gates: DataFrame, as_of: str) -> DataFrame:
    """What may be claimed per retailer, by precedence; retailers without evidence are kept."""
    c, at = F.col, F.lit(as_of).cast("timestamp")
    classed = linked.withColumn("_class", evidence_class(c("kind")))
    per = classed.groupBy("retailer_key").agg(
        *(F.count_if(c("_class") == k).alias(k) for k in ("official", "observational", "community", "other")),
        F.max(F.greatest("observed_at", "retrieved_at")).alias("latest_evidence_at"),
    )
    aged = all_rows.groupBy("retailer_key").agg(
        F.count_if(quality.retailer_state(at).isin("stale", "date-unknown")).alias("_aged")
    )
    passed = gates.filter(
        "gate_state = 'pass' and claim_state = 'official-complete-snapshot' and reconciled and denominator >= 0 and trim(snapshot_id) <> ''"
    ).select("retailer_key", "denominator", "snapshot_id")
    defaults = linked.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, DEFAULT_RETAILERS))).alias("retailer_key"))
    names = per.select("retailer_key").union(defaults).distinct()
    rows = names.join(per, "retailer_key", "left").join(aged, "retailer_key", "left").join(passed, "retailer_key", "left")
    rows = rows.fillna(0, ["official", "observational", "community", "other", "_aged"])
    claim = (
        F.when((c("_aged") > 0) & (c("official") > 0), "degraded")
        .when((c("official") > 0) & c("snapshot_id").isNotNull(), "official-complete-snapshot")
        .when(c("official") > 0, "official-partial").when(c("observational") > 0, "observational-partial")
        .when(c("community") > 0, "community-only").otherwise("no-evidence")
    )
    complete = claim == "official-complete-snapshot"
    return rows.select(
        "retailer_key", claim.alias("claim"), F.when(complete, c("denominator")).alias("denominator"),
        F.when(complete, c("snapshot_id")).alias("snapshot_id"), "official", "observational", "community", "other", "latest_evidence_at",
    )


def certificate_rollup(certifications: DataFrame, links: DataFrame, as_of: str) -> DataFrame:
    """(state, n) of linked certificates, and the stored ones no selection links to."""
    linked = links.filter("kind = 'certification'").select(F.col("ref_id").alias("id")).distinct()
    state = quality.cert_state(F.lit(as_of).cast("timestamp"), None)
    by_state = certifications.join(linked, "id", "left_semi").groupBy(state.alias("state")).agg(F.count("*").alias("n"))
    loose = certifications.join(linked, "id", "left_anti").agg(F.lit("<unmatched>").alias("state"), F.count("*").alias("n"))
    return by_state.unionByName(loose)


def merge_component_quality(components: DataFrame, available: DataFrame, attached: DataFrame) -> DataFrame:
    """(metric, key, value) of two merged quality reports, with the retailer evidence reconciled."""
    c = F.col
    row = lambda metric, key, value: F.struct(F.lit(metric).alias("metric"), key.alias("key"), value.cast("string").alias("value"))
    per = components.select(
        F.inline(
            F.array(
                row("warnings", c("source_key"), c("warning_count")), row("blockers", c("source_key"), c("blocker_count")),
                row("license", c("source_key"), F.coalesce("license_identifier", F.lit("<missing>"))),
                row("attribution", c("source_key"), c("attribution").isNotNull()),
                row("passing", c("source_key"), (c("blocker_count") == 0) & c("attribution").isNotNull() & (c("terms_state") == "approved")),
            )
        )
    )
    matched = available.join(attached.select("id").distinct(), "id", "left_semi")
    counts = union_all(
        available.agg(F.count_distinct("id").cast("string").alias("value")).select(F.lit("retailer").alias("metric"), F.lit("available").alias("key"), "value"),
        matched.agg(F.count_distinct("id").cast("string").alias("value")).select(F.lit("retailer").alias("metric"), F.lit("matched").alias("key"), "value"),
        available.join(attached.select("id"), "id", "left_anti").agg(F.count_distinct("id").cast("string").alias("value")).select(
            F.lit("retailer").alias("metric"), F.lit("unmatched").alias("key"), "value"
        ),
    )
    overall = components.agg(
        F.sum("warning_count").alias("warnings"), F.bool_and(c("attribution").isNotNull()).alias("attributed"),
        F.when(F.count_distinct("terms_version") == 1, F.max("terms_version")).otherwise("multiple").alias("terms_version"),
    ).select(F.inline(F.array(
        row("aggregate", F.lit("warnings"), c("warnings")), row("aggregate", F.lit("attributed"), c("attributed")),
        row("aggregate", F.lit("terms-version"), c("terms_version")),
    )))
    return union_all(per, counts, overall)


# Queue reasons that open an incident.
INCIDENT_REASONS = [
    "stale-ingredients", "changed-unreviewed", "certification-expiry", "certification-invalidated", "source-or-quality-blocker",
]


def queue_summary(queue: DataFrame) -> DataFrame:
    """(metric, key, n): entries by reason, by priority, and reasons that open an incident."""
    cell = lambda metric, key: F.struct(F.lit(metric).alias("metric"), key.alias("key"))
    reason = F.col("reason")
    cells = F.array_compact(
        F.array(
            cell("reason", reason), cell("priority", F.col("priority")), cell("entries", F.lit("")),
            F.when(reason.isin(*INCIDENT_REASONS), cell("incident-reason", reason)),
        )
    )
    return queue.select(F.inline(cells)).groupBy("metric", "key").agg(F.count("*").alias("n"))


def health_key(code: Column, source_key: Column) -> Column:
    """Stable incident key of a condition and source."""
    digest = F.sha2(ids.canonical_json({"condition": code, "sourceKey": source_key}), 256)
    return F.concat_ws("-", F.lit("catalog-health"), code, source_key, F.substring(digest, 1, 12))


def incidents(blockers: DataFrame) -> DataFrame:
    """Per source and code one incident, with the source's strongest action."""
    c = F.col
    codes = blockers.select("source_key", "code").distinct()
    action = codes.groupBy("source_key").agg(
        F.when(F.bool_or(c("code").isin(*quality.ROLLBACK)), "rollback-and-quarantine")
        .when(F.bool_or(c("code").isin(*quality.QUARANTINE)), "quarantine")
        .otherwise("block-release").alias("action")
    )
    return codes.join(action, "source_key").withColumn("incident_key", health_key(c("code"), c("source_key"))).withColumn(
        "priority", F.lit("P0")
    )


def release_review(metrics: DataFrame, changes: DataFrame, baseline: bool) -> DataFrame:
    """(section, key, value): flattened metrics and changes; changes are null without a baseline."""
    a = metrics.select(F.concat(F.lit("distribution:"), "metric").alias("section"), "key", F.col("n").cast("string").alias("value"))
    value = F.col("n").cast("string") if baseline else F.lit(None).cast("string")
    b = changes.select(F.lit("comparison").alias("section"), F.col("change").alias("key"), value.alias("value"))
    return a.unionByName(b)
