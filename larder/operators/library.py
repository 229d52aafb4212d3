"""Users' scan history, favourites and saved products, for any number of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY_LIMIT = 200


def retained_history(scans: DataFrame, settings: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Newest scans per user with history enabled.

    The limit is the feature. Spark also applies it inside each task before the shuffle, so a user
    with a third of all scans costs ``limit`` rows per task.
    """
    allowed = scans.join(settings.filter("history_enabled").select("user_id"), "user_id", "left_semi")
    newest = Window.partitionBy("user_id").orderBy(F.desc("scanned_at"), F.desc("id"))
    return allowed.withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= limit)


def favorites(events: DataFrame) -> DataFrame:
    """Current favourites: the last event per (user, market, gtin), unless it removed the product."""
    last = events.groupBy("user_id", "market", "gtin").agg(
        F.max_by(F.struct("is_favorite", "saved_at", "catalog_version"), F.struct("saved_at", "id")).alias("e")
    )
    return last.filter("e.is_favorite").select("user_id", "market", "gtin", "e.saved_at", "e.catalog_version")


def fingerprints(products: DataFrame, fields: list[str], children: DataFrame, child_fields: list[str]) -> DataFrame:
    """Fingerprint per (gtin, market) over its fields and all its children, in any order.

    Children enter as their count and the sum of their hashes, so a product with any number of
    children is combined on the map side and never collected.
    """
    keys = ["gtin", "market"]
    word = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(child_fields))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    summed = children.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(word).alias("_sum"))
    body = F.concat_ws(
        "|", F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}),
        F.coalesce("_n", F.lit(0)).cast("string"), F.coalesce(F.col("_sum"), F.lit(0).cast("decimal(38,0)")).cast("string"),
    )
    return products.join(summed, keys, "left").select(*keys, F.sha2(body, 256).alias("fingerprint"))


def saved_status(saved: DataFrame, current: DataFrame) -> DataFrame:
    """How a saved product relates to the current catalog."""
    now = current.select("market", "gtin", F.col("fingerprint").alias("current_fingerprint"))
    present = F.col("current_fingerprint").isNotNull()
    state = (
        F.when(F.col("was_present") & ~present, "no-longer-present").when(~F.col("was_present") & present, "now-available")
        .when(F.col("fingerprint").eqNullSafe(F.col("current_fingerprint")), "unchanged").otherwise("changed")
    )
    return saved.join(now, ["market", "gtin"], "left").withColumn("state", state)


def market_sources(requested: DataFrame, downloaded: DataFrame, bundled: DataFrame) -> DataFrame:
    """Catalog module per market: the downloaded one, else the bundled one, else unavailable."""
    fallback = bundled.join(downloaded, "market", "left_anti")
    modules = downloaded.withColumn("origin", F.lit("downloaded")).unionByName(fallback.withColumn("origin", F.lit("bundled")))
    return requested.join(modules, "market", "left").fillna("unavailable", ["origin"])
