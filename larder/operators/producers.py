"""Producer provenance of ingredient texts and the work queue it yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import text
from larder.functions.clock import epoch_rfc3339
from larder.operators.evidence import union_all
from larder.policy import PRODUCER_FIELDS

# Fields that hold an ingredient text.
INGREDIENT_FIELDS = ["ingredients_text", "ingredients_text_de", "ingredients_text_en"]


def _filled(value: Column) -> Column:
    return F.when(text.has_text(value), text.trim_space(value))


def sanitize(raw: DataFrame) -> DataFrame:
    """Producer metadata: owner, hashes of owner fields, all manufacturer sources, all source tags."""
    c = F.col
    hashes = F.map_filter(
        F.transform_values("owner_fields", lambda _, v: F.when(text.has_text(v), F.sha2(v, 256))),
        lambda k, v: k.isin(*PRODUCER_FIELDS) & v.isNotNull(),
    )

    def is_manufacturer(flag: Column) -> Column:
        return F.lower(F.trim(flag)).isin("1", "true", "yes")

    def fields_of(s: Column) -> Column:
        return F.array_sort(F.array_distinct(F.filter(s["fields"], lambda f: f.isin(*PRODUCER_FIELDS))))

    admitted = F.filter(
        "sources",
        lambda s: F.coalesce(is_manufacturer(s["manufacturer"]), F.lit(False))
        & _filled(s["id"]).isNotNull() & (F.size(fields_of(s)) > 0),
    )
    safe_url = lambda u: F.when(
        u.rlike(r"\Ahttps://[^/?#@]+(?:[/?#]|\z)"), u
    )
    shaped = F.transform(
        admitted,
        lambda s: F.struct(
            _filled(s["id"]).alias("source_id"), F.coalesce(_filled(s["name"]), F.lit("")).alias("source_name"),
            fields_of(s).alias("fields"), epoch_rfc3339(s["import_t"]).alias("imported_at"),
            _filled(s["source_licence"]).alias("licence"), safe_url(s["source_licence_url"]).alias("licence_url"),
        ),
    )
    tags = F.filter("data_sources_tags", text.has_text)
    return raw.select(
        "source_record_id", _filled(c("owner")).alias("owner"), hashes.alias("owner_hashes"),
        F.array_sort(shaped).alias("manufacturer_sources"), F.array_sort(F.array_distinct(tags)).alias("data_source_tags"),
    )


def confirm(selections: DataFrame, records: DataFrame, provenance: DataFrame) -> DataFrame:
    """Per selection with a text: is it provably the producer's?

    ``records`` hold the fields of the snapshot's record as a map; a field counts when its value is
    exactly the selected text, and is proven when the owner's hash of that field matches too.
    """
    c = F.col
    joined = selections.join(records, "source_record_id").join(provenance, "source_record_id", "left")
    order = F.array(F.concat(F.lit("ingredients_text_"), F.lower(F.substring_index("language_code", "-", 1))), F.lit("ingredients_text"))
    ranked = F.array_sort(
        F.array_compact(
            F.array(
                *(
                    F.when(
                        F.try_element_at("record_fields", F.lit(f)) == c("ingredients_text"),
                        F.struct(
                            F.when(F.array_position(order, f) > 0, F.array_position(order, f)).otherwise(99).alias("rank"), F.lit(f).alias("field")
                        ),
                    )
                    for f in INGREDIENT_FIELDS
                )
            )
        )
    )
    staged = joined.withColumn("_fields", F.transform(ranked, lambda r: r["field"])).withColumn("_hash", F.sha2("ingredients_text", 256))
    exact = F.filter("_fields", lambda f: F.try_element_at("owner_hashes", f) == c("_hash"))
    clash = F.exists("_fields", lambda f: F.try_element_at("owner_hashes", f) != c("_hash"))
    none = F.array().cast("array<string>")
    sources = F.array_distinct(
        F.transform(
            F.filter("manufacturer_sources", lambda s: F.arrays_overlap(s["fields"], c("_fields"))), lambda s: s["source_id"]
        )
    )
    staged = staged.withColumn("_exact", F.coalesce(exact, none)).withColumn("_sources", F.coalesce(sources, none))
    known = c("owner").isNotNull() | (F.size(F.coalesce("owner_hashes", F.create_map().cast("map<string,string>"))) > 0) | (
        F.size(F.coalesce("data_source_tags", none)) > 0
    ) | (F.size("manufacturer_sources") > 0)
    verdict = F.when(
        (F.size("_fields") > 0) & F.coalesce(known, F.lit(False)),
        F.when(c("owner").isNotNull() & (F.size("_exact") > 0), "confirmed")
        .when(F.coalesce(clash, F.lit(False)) | (F.size("_sources") > 1), "ambiguous")
        .when((F.size("_sources") > 0) | (F.size(F.coalesce("data_source_tags", none)) > 0) | c("owner").isNotNull(), "candidate"),
    )
    return staged.select(
        "gtin", "market", "source_record_id", "ingredient_id", "owner", verdict.alias("verdict"),
        F.when(verdict == "confirmed", F.try_element_at("_exact", F.lit(1))).alias("field"), "_sources",
    ).withColumnRenamed("_sources", "source_ids")


def unique_matches(changes: DataFrame, selections: DataFrame) -> DataFrame:
    """Change rows joined to selections by gtin alone, only where exactly one selection has it."""
    single = selections.groupBy("gtin").agg(F.count("*").alias("_n"), F.min("market").alias("market"), F.min("source_record_id").alias("source_record_id"))
    return changes.join(single.filter("_n = 1").drop("_n"), "gtin")


def queue(selections: DataFrame, verdicts: DataFrame, matched_changes: DataFrame) -> DataFrame:
    """Deduplicated review targets: (gtin, market, source_record_id, priority, reason, detail)."""
    c = F.col
    keys = ["gtin", "market", "source_record_id"]
    none = F.lit("").alias("detail")
    # Verdict to queue reason and priority.
    kinds = {"confirmed": ("producer-formulation-confirmed", "medium"), "ambiguous": ("producer-provenance-ambiguous", "high"),
             "candidate": ("producer-provenance-candidate", "medium")}
    pick = lambda n: F.coalesce(*(F.when(c("verdict") == v, F.lit(k[n])) for v, k in kinds.items()))
    missing = selections.filter("ingredient_id is null").select(*keys, F.lit("high").alias("priority"), F.lit("ingredients-missing").alias("reason"), none)
    judged = verdicts.filter("verdict is not null").select(*keys, pick(1).alias("priority"), pick(0).alias("reason"), none)
    conflicts = selections.select(*keys, F.explode("conflict_flags").alias("detail")).filter("detail <> 'ingredients-missing'").select(
        *keys, F.lit("high").alias("priority"), F.lit("evidence-conflict").alias("reason"), "detail"
    )
    changed = matched_changes.select(*keys, F.lit("high").alias("priority"), "reason", none)
    return union_all(missing, judged, conflicts, changed).distinct()


def metrics(verdicts: DataFrame, work: DataFrame) -> DataFrame:
    """(metric, n): confirmations, candidates, producers, and queue rows by reason."""
    c = F.col
    totals = verdicts.agg(
        F.count_if(c("verdict") == "confirmed").alias("confirmed"),
        F.count_distinct(F.when(c("verdict").isin("ambiguous", "candidate"), F.struct("gtin", "market"))).alias("candidates"),
        F.count_distinct(F.when(c("verdict") == "confirmed", c("owner"))).alias("producers"),
    )
    by_reason = work.groupBy(F.concat(F.lit("reason:"), "reason").alias("metric")).agg(F.count("*").alias("n"))
    return totals.unpivot([], totals.columns, "metric", "n").unionByName(by_reason)
