"""Evidence tables: integrity, history and projections.

Array-valued references of a selection (certificates, retailer rows, images) are kept as a link
table (selection_id, kind, ref_id): one product may own any number of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.ranking import ordinal_by_ranges
from larder.session import durable


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _reference(child: DataFrame, label: str, ref: str, parent: DataFrame, keyed: bool = True) -> DataFrame:
    """Child rows (record_id, ref[, gtin, market]) whose parent is missing or belongs to another key."""
    p = parent.select(
        F.col("id").alias("_pid"), *((F.col("gtin").alias("_pg"), F.col("market").alias("_pm")) if keyed else ())
    )
    joined = child.filter(F.col(ref).isNotNull()).join(p, F.col(ref) == F.col("_pid"), "left")
    rule = F.when(F.col("_pid").isNull(), f"{label}-unknown")
    if keyed:
        rule = rule.when((F.col("_pg") != F.col("gtin")) | (F.col("_pm") != F.col("market")), f"{label}-wrong-key")
    return joined.withColumn("rule", rule).filter("rule is not null").select("rule", "record_id", F.col(ref).alias("ref_id"))


def referential_violations(e: dict[str, DataFrame]) -> DataFrame:
    """(rule, record_id, ref_id) for every dangling or wrongly keyed reference of the envelope."""
    sel = e["selection"].withColumnRenamed("id", "record_id")
    links = e["selection_link"].join(sel.select(F.col("record_id").alias("selection_id"), "gtin", "market"), "selection_id")
    links = links.withColumnRenamed("selection_id", "record_id")
    asm = e["assessment"].withColumnRenamed("id", "record_id")
    asm_certs = e["assessment_cert"].join(
        asm.select(F.col("record_id").alias("assessment_id"), "gtin", "market"), "assessment_id"
    ).withColumnRenamed("assessment_id", "record_id")
    ing = e["ingredient"].withColumnRenamed("id", "record_id")
    superseded = e["ingredient"].select(F.col("supersedes_id").alias("ingredient_id")).filter("ingredient_id is not null").distinct()
    reasons = e["reason"].select(F.col("assessment_id").alias("record_id"), "evidence_id").distinct()
    checks = [
        _reference(sel, "selection-identity", "identity_id", e["identity"]),
        _reference(sel, "selection-ingredient", "ingredient_id", e["ingredient"]),
        _reference(sel, "selection-assessment", "assessment_id", e["assessment"]),
        sel.join(superseded, "ingredient_id", "left_semi").select(
            F.lit("selection-superseded-ingredient").alias("rule"), "record_id", F.col("ingredient_id").alias("ref_id")
        ),
        _reference(asm, "assessment-ingredient", "ingredient_id", e["ingredient"]),
        _reference(asm_certs, "assessment-certification", "certification_id", e["certification"]),
        _reference(ing, "ingredient-supersedes", "supersedes_id", e["ingredient"]),
        _reference(
            e["review"].filter("target_type = 'assessment'").withColumnRenamed("id", "record_id"),
            "review-target", "target_id", e["assessment"], keyed=False,
        ),
        _reference(reasons, "reason-evidence", "evidence_id", e["identity"], keyed=False),
    ]
    for kind in ("certification", "retailer", "image"):
        checks.append(_reference(links.filter(F.col("kind") == kind), f"selection-{kind}", "ref_id", e[kind]))
    return union_all(*checks)


def source_market_violations(collections: dict[str, DataFrame], sources: DataFrame) -> DataFrame:
    """Per collection, source and market: rows whose source is unknown or does not declare the market.

    Rows are counted per (source, market) before the join, so a source with a third of all rows
    costs one row in it.
    """
    counts = union_all(
        *(
            df.groupBy("source_key", "market").agg(F.count("*").alias("n")).withColumn("collection", F.lit(name))
            for name, df in collections.items()
        )
    )
    declared = sources.select("source_key", "markets")
    rule = F.when(F.col("markets").isNull(), "unknown-source").when(
        ~F.array_contains("markets", F.col("market")), "undeclared-market"
    )
    return (
        counts.join(declared, "source_key", "left").withColumn("rule", rule).filter("rule is not null")
        .select("collection", "source_key", "market", "rule", "n")
    )


def key_uniqueness(frames: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(rule, key, n) for keys that occur more than once."""
    return union_all(
        *(
            df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
            .select(F.lit(rule).alias("rule"), F.concat_ws("/", *keys).alias("key"), "n")
            for rule, (df, keys) in frames.items()
        )
    )


def validity(events: DataFrame) -> DataFrame:
    """Per assessment its last event (by time, then order) and whether it is still valid."""
    last = events.groupBy("assessment_id").agg(
        F.max_by("kind", F.struct("occurred_at", "ordinal")).alias("last_kind"), F.count("*").alias("events")
    )
    return last.withColumn("valid", F.col("last_kind") == "restored")


def evidence_delta(previous: DataFrame, current: DataFrame, complete: bool) -> DataFrame:
    """(change, id): added, unchanged and, for a complete snapshot only, removed ids."""
    both = previous.select("id", F.lit(True).alias("_p")).join(current.select("id", F.lit(True).alias("_c")), "id", "full")
    change = F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNotNull(), "unchanged")
    if complete:
        change = change.otherwise("removed")
    return both.withColumn("change", change).filter("change is not null").select("change", "id")


def merge_history(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Previous and current rows by id; a current row replaces the previous one."""
    return current.unionByName(previous.join(current.select("id"), "id", "left_anti").select(*current.columns))


def supersession(records: DataFrame) -> DataFrame:
    """(id, depth, problem): chain depth, or why the chain is broken.

    Pointer jumping: every round doubles the distance a record has looked back, so a chain of depth
    d ends after log2(d) joins. Depths have no gaps, hence a round in which nothing more resolves
    leaves only records that run into a cycle. Each round is checkpointed.
    """
    parents = records.select(F.col("id").alias("_pid"), F.col("gtin").alias("_pg"), F.col("market").alias("_pm"))
    edges = records.join(parents, F.col("supersedes_id") == F.col("_pid"), "left")
    linked = F.col("_pid").isNotNull()
    state = durable(
        edges.select(
            "id", F.col("_pid").alias("target"), F.when(linked, 1).otherwise(0).cast("long").alias("depth"),
            F.when(F.col("supersedes_id").isNotNull() & ~linked, "missing-parent")
            .when(linked & ((F.col("gtin") != F.col("_pg")) | (F.col("market") != F.col("_pm"))), "cross-key-parent")
            .alias("problem"),
        )
    )
    pending, before = state.filter("target is not null").count(), None
    while pending and pending != before:
        jump = state.select(
            F.col("id").alias("target"), F.col("target").alias("_next"), F.col("depth").alias("_more")
        )
        state = durable(
            state.join(jump, "target", "left").select(
                "id", F.col("_next").alias("target"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), "problem"
            )
        )
        pending, before = state.filter("target is not null").count(), pending
    cyclic = F.col("target").isNotNull()
    return state.select(
        "id", F.when(~cyclic, F.col("depth")).alias("depth"), F.when(cyclic, "cycle").otherwise(F.col("problem")).alias("problem")
    )


def child_positions(children: DataFrame, parent: list[str]) -> DataFrame:
    """0-based position of each child inside its parent, in id order, whatever form the ids have."""
    return ordinal_by_ranges(children, parent, ["id"], "position")


def position_gaps(children: DataFrame, parent: str) -> DataFrame:
    """Parents whose positions are not exactly 0..n-1."""
    stats = children.groupBy(parent).agg(
        F.count("*").alias("n"), F.count_distinct("position").alias("distinct_positions"),
        F.min("position").alias("low"), F.max("position").alias("high"),
    )
    return stats.filter((F.col("low") != 0) | (F.col("high") + 1 != F.col("n")) | (F.col("distinct_positions") != F.col("n")))


def dataset_digest(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n, digest): order-independent digest of each table.

    Rows are hashed and the hash words summed, so partial sums combine in any order and no group is
    ever collected; equal rows count, unlike in a set digest.
    """

    def words(row: Column) -> list[Column]:
        return [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]

    parts = []
    for name, df in tables.items():
        row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        sums = df.select(row.alias("row")).select(*(w.alias(f"w{i}") for i, w in enumerate(words(F.col("row")))))
        total = sums.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"w{i}") for i in range(4)))
        text = F.concat_ws("/", F.col("n").cast("string"), *(F.col(f"w{i}").cast("string") for i in range(4)))
        parts.append(total.select(F.lit(name).alias("table_name"), "n", F.sha2(text, 256).alias("digest")))
    return union_all(*parts)


def serving_projection(e: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(products, children, used source keys) of the current selections.

    Children stay one row each, with their kind; the product row carries their counts. Products, and what counts and
    sources read of the children, are stored once: their joins are the work, and both results need them.
    """
    idn = e["identity"].select(
        F.col("id").alias("identity_id"), "name", "brand", "quantity", "source_record_id",
        F.array_sort("categories").alias("categories"), F.col("source_key").alias("identity_source"),
    )
    ing = e["ingredient"].select(
        F.col("id").alias("ingredient_id"), "content_hash", "language_code", "verification_state",
        F.col("source_key").alias("ingredient_source"),
    )
    asm = e["assessment"].select(F.col("id").alias("assessment_id"), "status", "methodology_version")
    source_of = union_all(
        *(e[k].select(F.lit(k).alias("kind"), F.col("id").alias("ref_id"), "source_key") for k in ("certification", "retailer", "image"))
    )
    children = e["selection_link"].join(source_of, ["kind", "ref_id"])
    read = durable(children.select("selection_id", "kind", "source_key"))
    counts = read.groupBy("selection_id").agg(
        *(F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("certification", "retailer", "image"))
    )
    products = durable(
        e["selection"].withColumnRenamed("id", "selection_id")
        .join(idn, "identity_id").join(ing, "ingredient_id", "left").join(asm, "assessment_id", "left")
        .join(counts, "selection_id", "left")
        .fillna(0, ["certifications", "retailers", "images"])
    )
    used = union_all(
        products.select(F.col("identity_source").alias("source_key")),
        products.select(F.col("ingredient_source").alias("source_key")).filter("source_key is not null"),
        read.select("source_key"),
    ).distinct()
    return products, children, used


def attach_retailer_evidence(selections: DataFrame, incoming: DataFrame, existing_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, unmatched): incoming rows linked to the selection of their key, and those without one."""
    keys = selections.select("gtin", "market", F.col("id").alias("selection_id"))
    linked = incoming.join(keys, ["gtin", "market"]).select("selection_id", F.lit("retailer").alias("kind"), F.col("id").alias("ref_id"))
    added = linked.join(existing_links, ["selection_id", "kind", "ref_id"], "left_anti")
    unmatched = incoming.join(keys, ["gtin", "market"], "left_anti")
    return existing_links.unionByName(added), unmatched
