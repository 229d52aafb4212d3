"""Refresh work: due queue, batches, attempt ledger, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import clock
from larder.functions.ranking import ordinal_in_group, previous_in_group
from larder.operators import quality
from larder.operators.evidence import union_all

DUE_DAYS = 30
BATCH, INTERVAL_SECONDS = 40, 7
PLACE_DIGITS = 10  # leading digits of a product code that split the numbering
# Reasons a targeted run may act on.
TARGET_REASONS = [
    "missing-current-ingredients", "date-unknown-ingredients", "stale-ingredients", "refresh-recommended-ingredients",
    "identity-or-formulation-conflict", "ambiguous-review", "assessment-recheck", "changed-unreviewed",
    "admitted-submission", "privacy-safe-demand",
]
COLUMNS = ["key", "reason", "priority", "market", "gtin", "evidence_id"]


def queue_order() -> list[Column]:
    rank = F.coalesce(*(F.when(F.col("priority") == p, F.lit(n)) for n, p in enumerate(("high", "medium", "low"))), F.lit(3))
    return [rank, F.col("reason"), F.coalesce("market", F.lit("")), F.coalesce("gtin", F.lit("")), F.col("key")]


def _keyed(rows: DataFrame) -> DataFrame:
    dash = lambda name: F.coalesce(name, F.lit("-"))
    return rows.withColumn("key", F.concat_ws(":", "reason", dash("market"), dash("gtin"), dash("evidence_id"))).select(*COLUMNS)


def due_work(e: dict[str, DataFrame], changes: DataFrame, blockers: DataFrame, as_of: str) -> DataFrame:
    """Every reason to look at a product or source again, one row per key."""
    c, now = F.col, F.lit(as_of).cast("timestamp")
    facts = quality.selection_facts(e, as_of)
    soon = clock.plus_days(now, DUE_DAYS)

    def entry(reason: str, priority: str, evidence: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(reason).alias("reason"), F.lit(priority).alias("priority"), evidence.alias("evidence_id")))

    none = F.lit(None).cast("string")
    age = clock.freshness(c("ing_observed_at"), now, quality.POLICY.formulation)
    has = c("has_text")
    product = [
        entry("missing-current-ingredients", "high", none, ~has),
        entry("date-unknown-ingredients", "high", c("ingredient_id"), has & (age == "date-unknown")),
        entry("stale-ingredients", "high", c("ingredient_id"), has & (age == "stale")),
        entry("refresh-recommended-ingredients", "medium", c("ingredient_id"), has & (age == "refresh-recommended")),
        entry("identity-or-formulation-conflict", "high", c("selection_id"), c("flagged")),
        entry("assessment-recheck", "high", c("assessment_id"), clock.instant(c("recheck_at")) <= soon),
        entry("ambiguous-review", "medium", c("assessment_id"), c("status").isin("questionable", "unknown")),
    ]
    keys = facts.select("selection_id", "gtin", "market")
    certs = e["certification"].select(c("id").alias("ref_id"), "revoked_at", "suspended_at", "expiry_at", "last_checked_at")
    linked = e["selection_link"].filter("kind = 'certification'").join(keys, "selection_id").join(certs, "ref_id")
    ended = F.coalesce(clock.instant(c("revoked_at")) <= now, F.lit(False)) | F.coalesce(
        clock.instant(c("suspended_at")) <= now, F.lit(False)
    ) | F.coalesce(clock.instant(c("expiry_at")) < now, F.lit(False))
    cert = [
        entry("certification-invalidated", "high", c("ref_id"), ended),
        entry("certification-expiry", "high", c("ref_id"), ~ended & (clock.instant(c("expiry_at")) <= soon)),
        entry("certification-recheck", "medium", c("ref_id"), clock.plus_days(clock.instant(c("last_checked_at")), DUE_DAYS) <= now),
    ]
    rows = union_all(
        facts.select("gtin", "market", F.inline(F.array_compact(F.array(*product)))),
        linked.select("gtin", "market", F.inline(F.array_compact(F.array(*cert)))),
        changes.select("gtin", "market", F.lit("changed-unreviewed").alias("reason"), F.lit("high").alias("priority"), "evidence_id"),
        blockers.select(
            none.alias("gtin"), none.alias("market"), F.lit("source-or-quality-blocker").alias("reason"),
            F.lit("high").alias("priority"), c("code").alias("evidence_id"),
        ),
    )
    return _keyed(rows).distinct()


def head(queue: DataFrame, limit: int | None = None) -> DataFrame:
    """The queue, or its first ``limit`` entries in work order where a caller asks for a bound."""
    return queue if limit is None else queue.orderBy(*queue_order()).limit(limit)


def merge_queues(first: DataFrame, later: DataFrame, limit: int | None = None) -> DataFrame:
    """Union by key; an entry of the later queue replaces one of the first."""
    kept = first.join(later.select("key"), "key", "left_anti").select(*later.columns)
    return head(later.unionByName(kept), limit)


def submission_targets(*evidence: DataFrame) -> DataFrame:
    """Distinct products named by admitted evidence, as queue entries."""
    rows = union_all(*(df.select("market", "gtin") for df in evidence))
    good = rows.filter(F.col("gtin").rlike(r"\A[0-9]{14}\z") & F.col("market").rlike(r"\A[A-Z]{2}\z")).distinct()
    none = F.lit(None).cast("string")
    return _keyed(good.select("gtin", "market", F.lit("admitted-submission").alias("reason"), F.lit("high").alias("priority"), none.alias("evidence_id")))


def target_batches(queue: DataFrame, limit: int | None = None, size: int = BATCH) -> DataFrame:
    """(batch, gtins, starts_after_seconds): the eligible products in chunks, all or the first ``limit``.

    Products are numbered through counts of their leading digits, so no task holds the whole queue.
    """
    eligible = queue.filter(F.col("reason").isin(*TARGET_REASONS) & F.col("gtin").rlike(r"\A[0-9]{14}\z")).select("gtin").distinct()
    whole = eligible.withColumn("all", F.lit(0))
    numbered = ordinal_in_group(whole, ["all"], F.substring("gtin", 1, PLACE_DIGITS), ["gtin"], "place").drop("all")
    if limit is not None:
        numbered = numbered.filter(F.col("place") < limit)
    numbered = numbered.withColumn("batch", F.floor(F.col("place") / size))
    batches = numbered.groupBy("batch").agg(F.array_sort(F.collect_list("gtin")).alias("gtins"))
    return batches.withColumn("starts_after_seconds", F.col("batch") * INTERVAL_SECONDS)


def ledger(attempts: DataFrame, cadence_days: int = 7) -> DataFrame:
    """Attempts with what was accepted before them and what they change.

    An attempt is a candidate when it is complete, passed quality and differs from the accepted
    content. Content accepted before an attempt equals that of the last eligible attempt, so one
    look back per question is enough and attempts need no step-by-step replay.
    """
    c = F.col
    complete = c("download_complete") & c("mode").isin("full")
    eligible = complete & (c("quality_status") == "pass") & ~c("has_blockers")
    content = F.struct("content_sha256", "record_count", "adapter_version", "policy_sha256")
    order, day = ["retrieved_at", "ordinal"], F.substring("retrieved_at", 1, 10)
    rows = attempts.withColumn("status", F.when(complete, "complete").otherwise("partial")).withColumn("eligible", eligible)
    rows = previous_in_group(rows, ["source_key"], day, order, F.when(c("eligible"), content), "_accepted")
    advanced = c("eligible") & ~F.coalesce(c("_accepted") == content, F.lit(False))
    rows = rows.withColumn("candidate", advanced)
    rows = previous_in_group(rows, ["source_key"], day, order, F.when(c("candidate"), c("snapshot_id")), "accepted_snapshot_id")
    full_ok = (c("status") == "complete") & (c("mode") == "full") & (c("quality_status") == "pass")
    rows = previous_in_group(rows, ["source_key"], day, order, F.when(full_ok, c("retrieved_at")), "_before")
    success = F.when(full_ok, c("retrieved_at")).otherwise(c("_before"))
    due = F.coalesce(clock.rfc3339(clock.plus_days(clock.instant(success), cadence_days)), c("retrieved_at"))
    return rows.select(
        "source_key", "ordinal", "snapshot_id", "status", "eligible", "candidate", "accepted_snapshot_id",
        success.alias("last_success_at"), due.alias("next_full_due_at"),
        (c("eligible") & (c("mode") == "full")).alias("deletions_allowed"),
    )


def latest_state(states: DataFrame) -> DataFrame:
    """The last ledger row of every source."""
    rest = [c for c in states.columns if c != "source_key"]
    best = states.groupBy("source_key").agg(F.max_by(F.struct(*rest), "ordinal").alias("r"))
    return best.select("source_key", "r.*")


def plan(sources: DataFrame, state: DataFrame, as_of: str) -> DataFrame:
    """Next run per source and lane: mode, why not delta, and why a full run is due."""
    c, now = F.col, F.lit(as_of).cast("timestamp")
    joined = sources.join(state, "source_key", "left")
    accepted = c("accepted_snapshot_id").isNotNull()
    fallback = F.when(
        c("lane") == "auto",
        F.when(~F.array_contains("modes", "delta"), "delta-not-admitted")
        .when(~accepted, "delta-missing-accepted-predecessor")
        .when(F.coalesce(F.trim("cursor"), F.lit("")) == "", "delta-missing-cursor")
        .when(clock.instant(c("cursor_expires_at")) <= now, "delta-cursor-expired"),
    )
    mode = F.when(c("lane") == "targeted", "targeted").when((c("lane") == "auto") & fallback.isNull(), "delta").otherwise("full")
    due = (
        F.when(c("last_success_at").isNull(), "no-successful-full-acquisition")
        .when(now >= clock.instant(c("next_full_due_at")), "full-cadence-due").otherwise("full-cadence-not-due")
    )
    return joined.select(
        "source_key", "lane", mode.alias("mode"), fallback.alias("fallback_reason"), due.alias("due_reason"),
        F.coalesce("next_full_due_at", F.lit(as_of)).alias("full_due_at"), "accepted_snapshot_id",
    )
