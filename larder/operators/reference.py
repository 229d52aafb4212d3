"""Reference dimensions, versions and catalog statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import clock
from larder.functions.udfs import fold_text
from larder.operators.matching import additive_id

ADDITIVE = (
    "id string, status string, reviewedAt string, officialNames map<string,array<string>>, aliases map<string,array<string>>, "
    "technologicalFunctions array<string>, originPossibilities array<struct<kind:string,statement:string,reference:string>>, "
    "legalReferences array<struct<kind:string,reference:string,revision:string>>"
)


def additive_dims(entries: DataFrame) -> dict[str, DataFrame]:
    """Additives, names, functions, origins and legal references of JSON reference entries."""
    e = entries.select(F.from_json("entry", ADDITIVE).alias("e")).select("e.*")

    def names(column: str, kind: str) -> DataFrame:
        by_language = e.select("id", F.explode(column).alias("language", "names"))
        return by_language.select("id", "language", F.lit(kind).alias("kind"), F.explode("names").alias("name"))

    every = names("officialNames", "official").unionByName(names("aliases", "alias"))
    return {
        "additives": e.select("id", "status", "reviewedAt"),
        "names": every.withColumn("normalized_name", fold_text("name")["norm"]),
        "functions": e.select("id", F.explode("technologicalFunctions").alias("function")),
        "origins": e.select("id", F.inline("originPossibilities")),
        "legal_references": e.select("id", F.inline("legalReferences")),
    }


def reference_diff(previous: DataFrame, current: DataFrame, fields: list[str]) -> DataFrame:
    """(additive_id, change, field): added, removed and changed entries of two reference versions."""
    left = previous.select("additive_id", F.lit(True).alias("_p"), *(F.col(f).alias(f"_p_{f}") for f in fields))
    right = current.select("additive_id", F.lit(True).alias("_c"), *(F.col(f).alias(f"_c_{f}") for f in fields))
    both = left.join(right, "additive_id", "full")
    line = lambda change, field: F.struct(F.lit(change).alias("change"), F.lit(field).alias("field"))
    checks = [F.when(F.col("_p").isNull(), line("added", "")), F.when(F.col("_c").isNull(), line("removed", ""))]
    paired = F.col("_p") & F.col("_c")
    checks += [F.when(paired & ~F.col(f"_p_{f}").eqNullSafe(F.col(f"_c_{f}")), line("changed", f)) for f in fields]
    return both.select("additive_id", F.inline(F.array_compact(F.array(*checks))))


def affected_rules(diff: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rules whose E-number aliases name an additive the diff touches."""
    named = aliases.filter("match = 'e-number'").select("rule_id", additive_id(F.col("alias")).alias("additive_id"))
    return named.join(diff.select("additive_id").distinct(), "additive_id", "left_semi").select("rule_id").distinct()


def version_key(value: Column) -> Column:
    """Sortable key of a semantic version: releases follow their pre-releases, numbers precede words."""
    shape = r"\A(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\z"
    major, minor, patch, pre = (F.regexp_extract(value, shape, g) for g in (1, 2, 3, 4))
    numeric = lambda p: p.rlike(r"\A[0-9]+\z")
    parts = F.transform(
        F.split(pre, r"\."),
        lambda p: F.struct(
            F.when(numeric(p), 0).otherwise(1).alias("kind"), F.coalesce(F.when(numeric(p), p.try_cast("decimal(38,0)")), F.lit(0)).alias("number"),
            F.when(numeric(p), "").otherwise(p).alias("word"),
        ),
    )
    empty = F.array().cast("array<struct<kind:int,number:decimal(38,0),word:string>>")
    key = F.struct(
        major.try_cast("bigint").alias("major"), minor.try_cast("bigint").alias("minor"), patch.try_cast("bigint").alias("patch"),
        F.when(pre == "", 1).otherwise(0).alias("release"), F.when(pre == "", empty).otherwise(parts).alias("pre"),
    )
    return F.when(major != "", key)


def latest_version(modules: DataFrame) -> DataFrame:
    """Greatest version per module; malformed versions are ignored."""
    keyed = modules.withColumn("_key", version_key(F.col("version"))).filter("_key is not null")
    return keyed.groupBy("module_id").agg(F.max_by("version", "_key").alias("latest"), F.count("*").alias("versions"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, quantile: float, width: float) -> DataFrame:
    """Nearest-rank percentile (rank ceil(q*n)) per group, exact for groups of any size.

    Values are counted in bins of ``width``; the running counts show which bin holds the rank, and
    only that bin's distinct values are ranked.
    """
    c = F.col
    binned = df.filter(c(value).isNotNull()).withColumn("_bin", F.floor(c(value) / width))
    counts = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    run = Window.partitionBy(*keys).orderBy("_bin")
    total = F.sum("_n").over(Window.partitionBy(*keys))
    placed = counts.select(*keys, "_bin", (F.sum("_n").over(run) - c("_n")).alias("_before"), "_n", F.greatest(F.ceil(total * quantile), F.lit(1)).alias("_rank"))
    chosen = placed.filter((c("_rank") > c("_before")) & (c("_rank") <= c("_before") + c("_n"))).drop("_n")
    inside = binned.join(chosen, [*keys, "_bin"]).groupBy(*keys, "_before", "_rank", value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value)) + c("_before")
    return inside.withColumn("_upto", upto).filter(c("_upto") >= c("_rank")).groupBy(*keys).agg(F.min(value).alias("percentile"))


def coverage_stats(rows: DataFrame) -> DataFrame:
    """(metric, key, value): rows with and without text, coverage in percent, languages, text bytes."""
    c = F.col
    has = F.coalesce(F.length("ingredients_text") > 0, F.lit(False))
    size = F.when(has, F.octet_length("ingredients_text"))
    totals = rows.agg(
        F.count_if(has).cast("string").alias("with-text"), F.count_if(~has).cast("string").alias("without-text"),
        F.bround(100 * F.count_if(has) / F.count("*"), 3).cast("string").alias("coverage-percent"),
        F.bround(F.avg(size), 2).cast("string").alias("average-bytes"), F.max(size).cast("string").alias("largest-bytes"),
    )
    flat = totals.unpivot([], totals.columns, "metric", "value").select("metric", F.lit("").alias("key"), "value")
    languages = rows.filter(has).groupBy(F.lit("language").alias("metric"), c("language_code").alias("key")).agg(F.count("*").cast("string").alias("value"))
    return flat.unionByName(languages)


def churn(products: DataFrame, retailer: DataFrame, anchor: str, days: int = 7) -> DataFrame:
    """(kind, n): product rows changed and retailer rows observed in the window before the anchor."""
    start = F.lit(anchor).cast("timestamp") - F.make_dt_interval(F.lit(days))
    recent = lambda df, stamp, kind: df.filter(clock.instant(stamp) >= start).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return recent(products, F.col("source_modified_at"), "products").unionByName(
        recent(retailer, F.coalesce("observed_at", "retrieved_at"), "retailer")
    )
