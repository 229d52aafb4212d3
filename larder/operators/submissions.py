"""User submissions: contract checks, reuse of photos, and the evidence they become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import barcodes, clock, ids, text
from larder.operators.evidence import union_all

# Photo purposes each kind of submission must show, and attachment bounds.
REQUIRED_PURPOSES = {
    "missing-product": ["barcode", "front", "ingredients"],
    "ingredients-correction": ["barcode", "ingredients"],
    "identity-correction": ["barcode", "front"],
    "status-certification-correction": ["barcode", "front"],
}
PURPOSES = ["barcode", "front", "ingredients", "certification", "nutrition"]
MAX_ATTACHMENTS, MAX_BYTES, MAX_TOTAL_BYTES = 8, 4_000_000, 18_000_000
MAX_DIMENSION, MAX_PIXELS = 2_400, 12_000_000
LENGTHS = {"product_name": 200, "brand": 160, "quantity": 80, "notes": 2000}


def pii_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where any of the text columns looks like it holds contact data."""
    hit = text.pii_like(F.col(columns[0]))
    for name in columns[1:]:
        hit = hit | F.coalesce(text.pii_like(F.col(name)), F.lit(False))
    return rows.filter(F.coalesce(hit, F.lit(False)))


def _rules(checks: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in checks)))


def violations(submissions: DataFrame, attachments: DataFrame, as_of: str) -> DataFrame:
    """(submission_id, rule) of every broken rule; attachments are aggregated before they are joined."""
    c, now = F.col, F.lit(as_of).cast("timestamp")
    own = [
        ("gtin", barcodes.gtin14(c("gtin")).isNull() | (F.length("gtin") != 14)),
        ("issue-type", ~c("issue_type").isin(*REQUIRED_PURPOSES)),
        ("market", ~c("market").rlike(r"\A[A-Z]{2}\z")),
        ("observed-in-future", clock.instant(c("observed_at")) > now),
        ("observed-at", clock.instant(c("observed_at")).isNull()),
        ("consent", ~F.coalesce(c("consent"), F.lit(False))),
        *((f"length:{n}", F.length(n) > limit) for n, limit in LENGTHS.items()),
        *((f"contact-data:{n}", text.pii_like(c(n))) for n in LENGTHS),
    ]
    expected = F.regexp_extract("file_name", r"\A(barcode|front|ingredients|certification|nutrition)-[1-9][0-9]*\.jpg\z", 1)
    item = [
        ("attachment-name", expected == ""),
        ("attachment-purpose", (expected != "") & (c("purpose") != expected)),
        ("attachment-dimensions", (c("width") < 1) | (c("height") < 1) | (c("width") > MAX_DIMENSION) | (c("height") > MAX_DIMENSION)),
        ("attachment-pixels", c("width") * c("height") > MAX_PIXELS),
        ("attachment-size", (c("byte_size") < 1) | (c("byte_size") > MAX_BYTES)),
        ("attachment-digest", ~c("sha256").rlike(r"\A[0-9a-f]{64}\z")),
    ]
    a = submissions.select("submission_id", F.explode(_rules(own)).alias("rule"))
    b = attachments.select("submission_id", F.explode(_rules(item)).alias("rule")).distinct()
    names = attachments.groupBy("submission_id", "file_name").agg(F.count("*").alias("n")).filter("n > 1")
    per = attachments.groupBy("submission_id").agg(
        F.count("*").alias("n"), F.sum("byte_size").alias("bytes"),
        F.collect_set(F.when(c("purpose").isin(*PURPOSES), c("purpose"))).alias("purposes"),
    )
    required = F.create_map(*(x for k, v in REQUIRED_PURPOSES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    joined = submissions.join(per, "submission_id", "left")
    seen = F.coalesce("purposes", F.array().cast("array<string>"))
    whole = [
        ("attachment-count", ~F.coalesce("n", F.lit(0)).between(1, MAX_ATTACHMENTS)),
        ("attachment-total-size", c("bytes") > MAX_TOTAL_BYTES),
        ("missing-purpose", F.size(F.array_except(F.try_element_at(required, c("issue_type")), seen)) > 0),
    ]
    d = joined.select("submission_id", F.explode(_rules(whole)).alias("rule"))
    twice = names.select("submission_id", F.lit("attachment-name-repeated").alias("rule")).distinct()
    return union_all(a, b, d, twice)


def attachment_reuse(registry: DataFrame, attachments: DataFrame) -> DataFrame:
    """(rule, key, n): submission ids registered twice, and photo hashes used by several submissions."""
    repeated = registry.groupBy(F.col("submission_id").alias("key")).agg(F.count("*").alias("n")).filter("n > 1")
    shared = attachments.groupBy(F.col("sha256").alias("key")).agg(F.count_distinct("submission_id").alias("n")).filter("n > 1")
    return repeated.select(F.lit("submission-repeated").alias("rule"), "key", "n").unionByName(
        shared.select(F.lit("attachment-reused").alias("rule"), "key", "n")
    )


def to_evidence(submissions: DataFrame, attachments: DataFrame, scans: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence rows, impacts) of submissions a human admitted.

    Evidence: one identity, one package row per scanned photo, an ingredient when text was
    transcribed, and an approving review for each of them.
    """
    c = F.col
    admitted = submissions.join(reviews.filter("decision = 'propose-observation'"), "submission_id")
    identity = admitted.select(
        "submission_id", "gtin", "market", "reviewer_id", "reviewed_at", F.lit("identity").alias("kind"), c("verified_name").alias("content"),
        F.lit("human-verified-package-identity").alias("decision_code"),
    )
    ingredient = admitted.filter(text.has_text(c("transcription"))).select(
        "submission_id", "gtin", "market", "reviewer_id", "reviewed_at", F.lit("ingredient").alias("kind"),
        ids.formulation_hash(c("transcription"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("content"),
        F.lit("human-verified-package-transcription").alias("decision_code"),
    )
    package = (
        admitted.join(attachments.select("submission_id", "file_name"), "submission_id").join(scans, ["submission_id", "file_name"])
        .select(
            "submission_id", "gtin", "market", "reviewer_id", "reviewed_at", F.lit("package-evidence").alias("kind"),
            c("sanitized_sha256").alias("content"), F.lit("owner-admitted-sanitized-package-evidence").alias("decision_code"),
        )
    )
    fields = {n: c(n) for n in ("submission_id", "gtin", "market", "kind", "content")}
    rows = union_all(identity, ingredient, package)
    records = rows.withColumn("id", ids.evidence_id("submitted", fields))
    review = {"targetID": c("id"), "targetType": c("kind"), "reviewerID": c("reviewer_id"), "reviewedAt": c("reviewed_at"), "decisionCode": c("decision_code")}
    records = records.withColumn("review_id", ids.evidence_id("review", review))
    correction = c("issue_type") != "missing-product"
    impacts = admitted.select(
        "submission_id", "gtin", "market", correction.alias("invalidates_assessment"),
        (correction | text.has_text(c("transcription"))).alias("needs_methodology_review"),
        F.when(correction, "correction").otherwise("new-product").alias("impact"),
    )
    return records, impacts
