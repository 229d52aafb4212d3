"""Evolution of the product evidence from one snapshot to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import ids

CHANGED_REASON = "Source formulation text changed; assessment requires re-review."


def previous_state(selected: DataFrame, selections: DataFrame, identities: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Selected rows with the previous selection, identity and ingredient of their (gtin, market)."""
    prior = selections.select(
        "gtin", "market", F.col("id").alias("prev_selection_id"), F.col("identity_id").alias("prev_identity_id"),
        F.col("ingredient_id").alias("prev_ingredient_id"), F.col("assessment_id").alias("prev_assessment_id"),
    )
    idn = identities.select(
        F.col("id").alias("prev_identity_id"), F.col("source_key").alias("prev_identity_source"),
        F.col("source_record_id").alias("prev_source_record_id"),
    )
    ing = ingredients.select(
        F.col("id").alias("prev_ingredient_id"), F.col("content_hash").alias("prev_hash"),
        F.col("source_key").alias("prev_ingredient_source"), F.lit(True).alias("prev_ingredient_found"),
    )
    return (
        selected.join(prior, ["gtin", "market"], "left")
        .join(idn, "prev_identity_id", "left")
        .join(ing, "prev_ingredient_id", "left")
    )


def change_kind(row_hash: Column, prev_hash: Column, prev_selection: Column) -> Column:
    """formulation-changed, unchanged or added: how a selected row relates to its predecessor."""
    changed = row_hash.isNotNull() & prev_hash.isNotNull() & (row_hash != prev_hash)
    return F.when(changed, "formulation-changed").when(prev_selection.isNotNull(), "unchanged").otherwise("added")


def formulation_changes(state: DataFrame, retrieved_at: str) -> tuple[DataFrame, DataFrame]:
    """(ingredients, events): kept or new ingredient per row, and invalidations of assessed changes."""
    same = F.col("content_hash") == F.col("prev_hash")
    fresh_id = ids.evidence_id(
        "ingredient",
        {
            "gtin": F.col("gtin"), "market": F.col("market"), "sourceRecordID": F.col("source_record_id"),
            "contentHash": F.col("content_hash"), "retrievedAt": F.lit(retrieved_at),
            "supersedesID": F.when(~same, F.col("prev_ingredient_id")),
        },
    )
    ingredients = state.filter("content_hash is not null").select(
        "gtin", "market", "source_record_id", "content_hash", "prev_assessment_id",
        F.coalesce(same, F.lit(False)).alias("kept"),
        F.when(same, F.col("prev_ingredient_id")).otherwise(fresh_id).alias("id"),
        F.when(~same, F.col("prev_ingredient_id")).alias("supersedes_id"),
    )
    events = ingredients.filter("supersedes_id is not null and prev_assessment_id is not null").select(
        F.col("prev_assessment_id").alias("assessment_id"), F.lit("invalidated").alias("kind"),
        F.lit(retrieved_at).alias("occurred_at"), F.lit(CHANGED_REASON).alias("reason"),
        F.col("id").alias("triggered_by"),
    )
    return ingredients.drop("prev_assessment_id"), events


def latest_identity_by_source(identities: DataFrame, source_key: str) -> DataFrame:
    """Per source record its last retrieved identity of one source; the first of equal times wins.

    ``max_by`` combines on the map side, so a record seen a billion times costs one row per task.
    """
    rank = F.struct("retrieved_at", (-F.col("ordinal")).alias("neg"))
    return (
        identities.filter(F.col("source_key") == source_key)
        .groupBy("source_record_id")
        .agg(F.max_by(F.struct("gtin", "retrieved_at", "ordinal"), rank).alias("r"))
        .select("source_record_id", "r.*")
    )


def upstream_signals(state: DataFrame, latest: DataFrame, source_key: str) -> DataFrame:
    """(signal, gtin, market, previous, current): moved record ids, changed barcodes, vanished text."""
    moved = state.filter(
        (F.col("prev_identity_source") == source_key) & (F.col("prev_source_record_id") != F.col("source_record_id"))
    ).select(
        F.lit("source-record-id-changed-same-gtin").alias("signal"), "gtin", "market",
        F.col("prev_source_record_id").alias("previous"), F.col("source_record_id").alias("current"),
    )
    by_record = latest.select("source_record_id", F.col("gtin").alias("prev_gtin"))
    recoded = state.join(by_record, "source_record_id").filter(F.col("prev_gtin") != F.col("gtin")).select(
        F.lit("barcode-changed").alias("signal"), "gtin", "market", F.col("prev_gtin").alias("previous"), F.col("gtin").alias("current")
    )
    vanished = state.filter(
        F.col("content_hash").isNull() & (F.col("prev_ingredient_source") == source_key) & F.col("prev_ingredient_found")
    ).select(
        F.lit("ingredient-field-deleted").alias("signal"), "gtin", "market",
        F.col("prev_ingredient_id").alias("previous"), F.lit(None).cast("string").alias("current"),
    )
    return moved.unionByName(recoded).unionByName(vanished)


def current_selections(state: DataFrame, ingredients: DataFrame) -> DataFrame:
    """New selection row per (gtin, market); of two source records sharing a key the later one wins.

    The winner is the record with the greatest source record id, as decisions are processed in that
    order; ``max_by`` picks it without sorting a group.
    """
    rows = state.join(
        ingredients.select("gtin", "market", "source_record_id", F.col("id").alias("ingredient_id")),
        ["gtin", "market", "source_record_id"], "left",
    )
    flags = F.array_sort(
        F.array_compact(
            F.array(
                F.when(F.col("language_conflict"), "ingredient-language-conflict"),
                F.when(F.col("ambiguous_prefix"), "restricted-prefix-provenance-ambiguous"),
                F.when(F.col("content_hash").isNull(), "ingredients-missing"),
                F.when(F.col("content_hash").isNull() & F.coalesce("prev_ingredient_found", F.lit(False)), "ingredient-field-deleted"),
            )
        )
    )
    picked = rows.withColumn("conflict_flags", flags).groupBy("gtin", "market").agg(
        F.max_by(F.struct("source_record_id", "ingredient_id", "conflict_flags"), "source_record_id").alias("r"),
        F.count("*").alias("records"),
    )
    chosen = picked.select("gtin", "market", "r.*", "records")
    fields = {
        "gtin": F.col("gtin"), "market": F.col("market"), "sourceRecordID": F.col("source_record_id"),
        "ingredientObservationID": F.col("ingredient_id"), "conflictFlags": F.col("conflict_flags"),
    }
    return chosen.withColumn("id", ids.evidence_id("selection", fields))


def change_summary(state: DataFrame, selections: DataFrame, complete: bool) -> DataFrame:
    """(change, n, first_gtin): additions, unchanged, changed; removals only for a complete snapshot."""
    seen = state.select(
        "gtin", "market", change_kind(F.col("content_hash"), F.col("prev_hash"), F.col("prev_selection_id")).alias("change")
    )
    gone = selections.select("gtin", "market").join(state.select("gtin", "market"), ["gtin", "market"], "left_anti")
    gone = gone.withColumn("change", F.lit("removed" if complete else "not-observed-in-incomplete-snapshot"))
    return seen.unionByName(gone).groupBy("change").agg(F.count("*").alias("n"), F.min("gtin").alias("first_gtin"))
