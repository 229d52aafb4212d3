"""Price observations: conflict elimination, joins with rejection reasons, retailer matching."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import barcodes, ids, text
from larder.functions.stage import once
from larder.functions.udfs import format_g
from larder.session import durable

# Columns kept of each export; contributor, coordinate and file columns are not.
PROJECTED = {
    "location": [
        "id", "type", "osm_id", "osm_type", "osm_name", "osm_tag_key", "osm_tag_value", "osm_brand", "osm_address_postcode",
        "osm_address_city", "osm_address_country", "osm_address_country_code", "osm_version", "source", "created", "updated",
    ],
    "proof": ["id", "location_id", "type", "date", "currency", "created", "updated"],
    "price": [
        "id", "product_code", "product_id", "location_id", "proof_id", "date", "currency", "price", "price_is_discounted",
        "price_without_discount", "price_per", "receipt_quantity", "type", "created", "updated",
    ],
}
# The sentence that goes with every observation, and the market.
LIMITATIONS = (
    "Dated price observation only; not current stock, nationwide availability, normal assortment, or retailer completeness."
)
MARKET = "DE"


def multiplex(exports: dict[str, DataFrame]) -> DataFrame:
    """One frame of all exports: a kind column and the allowed columns of each."""
    out = None
    for kind, df in exports.items():
        kept = [c for c in df.columns if c in PROJECTED[kind] or c == "line"]
        part = df.select(F.lit(kind).alias("kind"), *kept)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def split_multiplex(lines: DataFrame, schemas: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """({kind: rows}, counters) of multiplexed JSON lines ``{"kind": …, "record": {…}}``."""
    parsed = lines.filter(text.has_text(F.col("value"))).select(
        "line", F.from_json("value", "map<string,string>").alias("m")
    )
    envelope = parsed.select(
        "line",
        F.when(F.array_sort(F.map_keys("m")) == F.array(F.lit("kind"), F.lit("record")), F.col("m")).alias("m"),
    ).select("line", F.col("m")["kind"].alias("kind"), F.col("m")["record"].alias("record"))
    good = envelope.filter(F.col("record").startswith("{") & F.col("kind").isNotNull())
    state = (
        F.when(F.col("kind").isNull() | ~F.coalesce(F.col("record").startswith("{"), F.lit(False)), "malformed")
        .when(F.col("kind").isin(*schemas), F.col("kind"))
        .otherwise("unknown-kind")
    )
    counters = envelope.groupBy(state.alias("outcome")).agg(F.count("*").alias("n"))
    frames = {
        kind: good.filter(F.col("kind") == kind).select("line", F.from_json("record", schema).alias("r")).select("line", "r.*")
        for kind, schema in schemas.items()
    }
    return frames, counters


@dataclass
class Deduplicated:
    """Rows whose id never changed payload, ids that did, and the counters of the rest."""

    kept: DataFrame
    conflicts: DataFrame
    counters: DataFrame


def conflict_lines(rows: DataFrame, payload: Column) -> DataFrame:
    """Per id its first line and the first line whose payload differs (null when none does).

    One id may hold any number of rows: they are first combined to one row per payload, and of those
    only the two earliest are kept. Spark applies that rank limit before the shuffle too, so a hot
    id sends two rows per task.
    """
    first_seen = rows.groupBy("id", payload.alias("_payload")).agg(F.min("line").alias("_seen"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("_seen"))
    earliest = first_seen.withColumn("_rank", rank).filter("_rank <= 2")
    return earliest.groupBy("id").agg(
        F.min("_seen").alias("first_line"), F.max(F.when(F.col("_rank") == 2, F.col("_seen"))).alias("conflict_line")
    )


def drop_conflicting_ids(rows: DataFrame) -> Deduplicated:
    """Keep one row per id unless its payload ever differs; such ids are dropped entirely."""
    payload = F.sha2(F.to_json(F.struct(*sorted(c for c in rows.columns if c != "line"))), 256)
    tagged = rows.join(conflict_lines(rows, payload), "id")
    fate = (
        F.when(F.col("line") > F.col("conflict_line"), "conflict-repeat")
        .when(F.col("line") == F.col("conflict_line"), "conflict")
        .when(F.col("line") > F.col("first_line"), "duplicate")
        .otherwise("first")
    )
    counters = tagged.groupBy(fate.alias("outcome")).agg(F.count("*").alias("n"))
    # one fold by id gives what stays and what conflicts; the lines matter to the counters alone
    folded = rows.filter("id is not null").groupBy("id").agg(
        F.min_by(F.struct(*rows.columns), "line").alias("_first"), F.min(F.unhex(payload)).alias("_low"), F.max(F.unhex(payload)).alias("_high")
    )
    kept = folded.filter("_low = _high").select("_first.*")
    return Deduplicated(kept, folded.filter("_low <> _high").select("id"), counters)


def alias_rows(registry: DataFrame, column: str = "entry") -> DataFrame:
    """(retailer_key, class, alias) of a registry with one JSON entry per row."""
    entry = F.from_json(F.col(column), "key string, osmBrands array<string>, osmTagValues array<string>, names array<string>")
    parsed = registry.select(entry.alias("e"))

    def part(values: Column, kind: str) -> DataFrame:
        exploded = parsed.select(F.col("e.key").alias("retailer_key"), F.explode(values).alias("v"))
        return exploded.select("retailer_key", F.lit(kind).alias("class"), text.alias_key(F.col("v")).alias("alias"))

    stable = part(F.concat("e.osmBrands", "e.osmTagValues"), "stable")
    return stable.unionByName(part(F.col("e.names"), "name")).filter("alias is not null").distinct()


def match_retailers(locations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per location id: retailer key, how it matched, and the alias that decided.

    Computed once per location, before prices are joined. The alias table is aggregated to one row
    per alias, so the three lookups stay equi joins whose strategy Spark chooses by size.
    """
    per = aliases.groupBy("class", "alias").agg(F.array_sort(F.collect_set("retailer_key")).alias("keys"))

    def lookup(kind: str, name: str) -> DataFrame:
        return per.filter(F.col("class") == kind).select(F.col("alias").alias(name), F.col("keys").alias(f"{name}_keys"))

    none = F.array().cast("array<string>")
    keyed = locations.select(
        "id", text.alias_key(F.col("osm_brand")).alias("brand"), text.alias_key(F.col("osm_tag_value")).alias("tag"),
        text.alias_key(F.col("osm_name")).alias("name"),
    )
    looked = (
        keyed.join(lookup("stable", "brand"), "brand", "left").join(lookup("stable", "tag"), "tag", "left")
        .join(lookup("name", "name"), "name", "left")
    )
    stable = F.array_union(F.coalesce("brand_keys", none), F.coalesce("tag_keys", none))
    staged = looked.withColumn("stable", stable).withColumn(
        "stable_alias", F.when(F.col("tag_keys").isNotNull(), F.col("tag")).when(F.col("brand_keys").isNotNull(), F.col("brand"))
    )
    n, m = F.size("stable"), F.size(F.coalesce("name_keys", none))
    kind = F.when(n == 1, "stable").when(n > 1, "ambiguous").when(m == 1, "name").when(m > 1, "ambiguous").otherwise("unmatched")
    return staged.select(
        "id", kind.alias("match_kind"),
        F.when(n == 1, F.col("stable")[0]).when((n == 0) & (m == 1), F.col("name_keys")[0]).alias("retailer_key"),
        F.when(n > 0, F.col("stable_alias")).otherwise(F.coalesce("name", "brand", "tag")).alias("alias"),
    )


def observation_time(date: Column, retrieved_at: Column) -> Column:
    """Midnight UTC text of a calendar date that is not after the retrieval day, else null."""
    day = F.when(date.rlike(r"\A\d{4}-\d\d-\d\d\z"), F.try_to_date(date, "yyyy-MM-dd"))
    return F.when(day <= F.to_date(F.substring(retrieved_at, 1, 10)), F.concat(date, F.lit("T00:00:00Z")))


def price_context(price: Column, currency: Column, price_per: Column, quantity: Column) -> Column:
    """Scope text of a price, or null when price, currency or quantity break the contract."""
    code = text.clean(currency, 8)
    finite = price.isNotNull() & ~F.isnan(price) & (price >= 0) & (price < float("inf"))
    quantity_ok = quantity.isNull() | ((quantity > 0) & (quantity < float("inf")) & ~F.isnan(quantity))
    parts = F.concat_ws(
        " ", F.lit("source price"), format_g(price), F.upper(code),
        F.concat(F.lit("per "), text.clean(price_per, 32)), F.concat(F.lit("receipt quantity "), format_g(quantity)),
    )
    return F.when(finite & code.rlike(r"\A[A-Za-z]{3}\z") & quantity_ok, parts)


def context_ok(price: Column, currency: Column, quantity: Column) -> Column:
    """The checks of ``price_context`` without its text, for jobs that only count."""
    code = text.clean(currency, 8)
    finite = price.isNotNull() & ~F.isnan(price) & (price >= 0) & (price < float("inf"))
    quantity_ok = quantity.isNull() | ((quantity > 0) & (quantity < float("inf")) & ~F.isnan(quantity))
    return F.coalesce(finite & code.rlike(r"\A[A-Za-z]{3}\z") & quantity_ok, F.lit(False))


def join_prices(
    prices: DataFrame, locations: Deduplicated, proofs: Deduplicated, aliases: DataFrame, retrieved_at: str, accepted: list[str] | None = None
) -> DataFrame:
    """Prices with their location, proof and retailer, the first failing check as ``reject``, and a digest of the whole record.

    Ids that cannot match (null or negative) meet no other row: each gets a key of its own in the joins,
    so missing locations and proofs, however many, are spread over all tasks. ``accepted`` (the columns to be read) gives only
    the rows that pass every check, stored: each check then drops its rows before the next join shuffles them.
    """
    matches = match_retailers(locations.kept, aliases)
    loc = locations.kept.join(matches, "id").select(
        F.col("id").alias("location_id"), F.lit(True).alias("has_location"), F.lit(False).alias("bad_location"),
        F.upper(text.clean(F.col("osm_address_country_code"), 8)).alias("country"), "osm_address_city", "osm_address_postcode",
        "retailer_key", "match_kind", "alias",
    )
    loc = loc.unionByName(
        locations.conflicts.select(F.col("id").alias("location_id"), F.lit(True).alias("bad_location")), allowMissingColumns=True
    )
    prf = proofs.kept.select(
        F.col("id").alias("proof_id"), F.lit(True).alias("has_proof"), F.lit(False).alias("bad_proof"),
        F.col("location_id").alias("proof_location"), F.col("date").alias("proof_date"), F.col("type").alias("proof_type"),
    )
    prf = prf.unionByName(proofs.conflicts.select(F.col("id").alias("proof_id"), F.lit(True).alias("bad_proof")), allowMissingColumns=True)
    c = F.col
    valid_id = lambda name: F.coalesce(c(name) >= 0, F.lit(False))
    # (reason, condition, what it needs) in the order in which they reject
    checks = [
        ("invalid-price-id", ~valid_id("id"), "record"),
        ("non-product", c("type").isNotNull() & (c("type") != "PRODUCT"), "record"),
        ("invalid-gtin", c("gtin").isNull(), "derived"),
        ("invalid-or-future-date", c("observed_at").isNull(), "derived"),
        ("invalid-join-id", ~(valid_id("location_id") & valid_id("proof_id")), "record"),
        ("conflicting-location", c("bad_location"), "location"),
        ("conflicting-proof", c("bad_proof"), "proof"),
        ("missing-location", c("has_location").isNull(), "location"),
        ("missing-proof", c("has_proof").isNull(), "proof"),
        ("invalid-proof-location", ~valid_id("proof_location"), "proof"),
        ("proof-location-mismatch", c("proof_location") != c("location_id"), "proof"),
        ("proof-date-mismatch", c("proof_date") != c("date"), "proof"),
        ("outside-market", c("country").isNull() | (c("country") != MARKET), "location"),
        ("ambiguous-retailer", c("match_kind") == "ambiguous", "location"),
        ("unmatched-retailer", c("retailer_key").isNull(), "location"),
        ("invalid-price-context", ~c("_context_ok"), "derived"),
    ]

    def passed(df: DataFrame, *needs: str) -> DataFrame:
        if accepted is None:
            return df
        return df.filter(reduce(Column.__and__, (~F.coalesce(failed, F.lit(False)) for _, failed, need in checks if need in needs)))

    date = observation_time(c("date"), F.lit(retrieved_at))
    # stored, so that its size is known: prices name few locations, and a shuffle by location would bring each to one task
    loc = durable(loc.filter("location_id >= 0").withColumnRenamed("location_id", "_location"))
    if accepted is not None:  # on the record alone these conditions reach the scan, past the view's own joins
        good = durable(passed(loc, "location").select(c("_location").alias("location_id")))
        prices = passed(prices, "record").filter(date.isNotNull()).join(good, "location_id", "left_semi").select(*prices.columns)
    # the whole record, so that repeats of an id which differ in any field are seen as a conflict; 120 bits in two numbers
    payload = F.sha2(F.to_json(F.struct(*(F.col(f"`{n}`") for n in sorted(prices.columns) if n not in ("id", "line")))), 256)
    word = lambda start: F.conv(F.substring("price_payload", start, 15), 16, 10).cast("long")
    fingerprinted = once(prices, price_payload=payload).withColumn("price_payload", F.struct(word(1).alias("high"), word(16).alias("low")))
    # each once per row: the check digit alone reads the trimmed code fourteen times
    fingerprinted = once(fingerprinted, _digits=barcodes.trimmed(c("product_code")))
    fingerprinted = once(
        fingerprinted, gtin=barcodes.gtin14(c("_digits")), observed_at=date,
        _context_ok=context_ok(c("price"), c("currency"), c("receipt_quantity")),
    ).drop("_digits")
    fingerprinted = passed(fingerprinted, "derived")
    apart = -1 - F.pmod(F.xxhash64("line"), F.lit(1 << 40))
    key = lambda name: F.when(c(name) >= 0, c(name)).otherwise(apart)
    prf = prf.filter("proof_id >= 0").withColumnRenamed("proof_id", "_proof")
    if accepted is not None:
        # the rows that are left meet the texts of their locations
        found = fingerprinted.join(prf.filter("has_proof and not bad_proof"), c("proof_id") == c("_proof"))
        named = loc.select("_location", *(x for x in loc.columns if x in accepted))
        own = ["id", "line", "price_payload", "location_id", *(x for x in accepted if x not in (*named.columns, "id", "line", "price_payload", "location_id"))]
        found = durable(passed(found, "proof").select(*own))
        named = durable(named.join(found.select(c("location_id").alias("_location")).distinct(), "_location", "left_semi"))
        return found.join(named, c("location_id") == c("_location")).drop("_location").withColumn("reject", F.lit(None).cast("string"))
    fingerprinted = fingerprinted.withColumn("_location", key("location_id")).withColumn("_proof", key("proof_id"))
    joined = fingerprinted.join(loc, "_location", "left").join(prf, "_proof", "left").drop("_location", "_proof")
    (first, failed, _), *others = checks
    reject = reduce(lambda so_far, check: so_far.when(check[1], check[0]), others, F.when(failed, first))
    return joined.withColumn("reject", reject).drop("_context_ok")


def resolve_price_ids(joined: DataFrame, columns: list[str] | None = None, stored: bool = False) -> DataFrame:
    """Add ``fate``: included, duplicate, conflict, conflict-repeat or the rejection.

    Only accepted rows can start a conflict, and after one every row with that id is a repeat,
    whatever its own checks would say. The joined rows are read twice (once to find the conflicts,
    once to label rows), so they are stored rather than joined again, unless they are ``stored``; ``columns`` names those that the
    caller reads beside id, line and fate (all by default). One fold by id finds the ids that repeat and those whose
    payload changes; only of the latter the lines are ranked.
    """
    own = ["id", "line", "reject", "price_payload"]
    if columns is not None:
        joined = joined.select(*own, *(x for x in columns if x not in own))
    joined = joined if stored else durable(joined)
    accepted, c = joined.filter("reject is null"), F.col
    by_id = accepted.groupBy("id").agg(
        F.count("*").alias("n"), F.min("line").alias("first_line"),
        *(f(c(f"price_payload.{w}")).alias(f"{name}_{w}") for w in ("high", "low") for name, f in (("least", F.min), ("most", F.max))),
    )
    changes = (c("least_high") != c("most_high")) | (c("least_low") != c("most_low"))
    repeated = durable(by_id.filter("n > 1").select("id", "first_line", changes.alias("changes")))
    changed = durable(repeated.filter("changes").select("id"))
    conflicts = conflict_lines(accepted.join(changed, "id", "left_semi"), F.col("price_payload")).select("id", "conflict_line")
    tagged = joined.join(repeated.drop("changes").join(durable(conflicts), "id", "left"), "id", "left")
    fate = (
        F.when(F.col("line") > F.col("conflict_line"), "conflict-repeat")
        .when(F.col("reject").isNotNull(), F.col("reject"))
        .when(F.col("line") == F.col("conflict_line"), "conflict")
        .when(F.col("line") > F.col("first_line"), "duplicate")
        .when(F.col("conflict_line").isNotNull(), "dropped-by-conflict")
        .otherwise("included")
    )
    return tagged.withColumn("fate", fate)


def retailer_observations(resolved: DataFrame, retrieved_at: str, source_key: str) -> DataFrame:
    """Evidence rows of the included prices."""
    c = F.col
    place = F.coalesce(
        F.nullif(F.concat_ws(" ", text.clean(c("osm_address_city"), 80), text.clean(c("osm_address_postcode"), 24), c("country")), F.lit("")),
        F.lit("Germany"),
    )
    proof_type = F.coalesce(text.clean(c("proof_type"), 32), F.lit("UNKNOWN"))
    rows = resolved.filter("fate = 'included'").select(
        "gtin", F.lit(MARKET).alias("market"), "retailer_key", "observed_at", "match_kind", proof_type.alias("proof_type"),
        F.concat(
            F.lit("single dated Open Prices observation at "), place, F.lit("; proof type "), proof_type, F.lit("; "),
            price_context(c("price"), c("currency"), c("price_per"), c("receipt_quantity")),
        ).alias("scope"),
        F.concat(F.lit("open-prices:location:"), c("location_id")).alias("location_id"),
        F.concat(F.lit("price:"), c("id"), F.lit(";proof:"), c("proof_id")).alias("source_record_id"),
    )
    fields = {
        "confidence": F.lit("dated-source-observation"), "gtin": c("gtin"), "kind": F.lit("retailer-observation"),
        "limitations": F.lit(LIMITATIONS), "locationID": c("location_id"), "market": c("market"), "observedAt": c("observed_at"),
        "retailerKey": c("retailer_key"), "retrievedAt": F.lit(retrieved_at), "scope": c("scope"), "sourceKey": F.lit(source_key),
        "sourceRecordID": c("source_record_id"),
    }
    return rows.withColumn("id", ids.evidence_id("retailer", fields))


def quality_report(resolved: DataFrame, alias_limit: int | None = None) -> DataFrame:
    """(metric, key, value) rows: fates, retailers, proof types, match kinds, time range, alias queue.

    The alias queue is whole unless ``alias_limit`` asks for its head; the report then says so.
    """
    c = F.col
    kept = c("fate") == "included"

    def cell(metric: str, key: Column, when: Column | None = None) -> Column:
        pair = F.struct(F.lit(metric).alias("metric"), key.alias("key"))
        return pair if when is None else F.when(when, pair)

    pairs = [
        cell("fate", c("fate")),
        cell("retailer", c("retailer_key"), kept),
        cell("match-kind", c("match_kind"), kept),
        cell("proof-type", F.coalesce(text.clean(c("proof_type"), 32), F.lit("UNKNOWN")), kept),
    ]
    for state in ("ambiguous", "unmatched"):
        pairs.append(cell(f"{state}-alias", F.coalesce("alias", F.lit("<missing>")), c("fate") == f"{state}-retailer"))
    cells = (
        resolved.select("observed_at", kept.alias("kept"), F.inline(F.array_compact(F.array(*pairs))))
        .groupBy("metric", "key")
        .agg(
            F.count("*").alias("n"), F.min(F.when(c("kept"), c("observed_at"))).alias("oldest"),
            F.max(F.when(c("kept"), c("observed_at"))).alias("newest"),
        )
    )
    is_alias = c("metric").endswith("-alias")
    listed = cells
    if alias_limit is not None:
        rank = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("n"), "key"))
        ranked = cells.filter(is_alias).withColumn("rank", rank).filter(c("rank") <= alias_limit)
        listed = cells.filter(~is_alias).unionByName(ranked.drop("rank"))
    listed = listed.select("metric", "key", c("n").cast("string").alias("value"))
    totals = cells.agg(
        F.min("oldest").alias("oldest"), F.max("newest").alias("newest"),
        *(
            (F.lit(False) if alias_limit is None else F.count_if(c("metric") == f"{s}-alias") > alias_limit).cast("string").alias(s)
            for s in ("ambiguous", "unmatched")
        ),
    )
    extra = totals.select(
        F.inline(
            F.array(
                *(F.struct(F.lit("observed-at").alias("metric"), F.lit(k).alias("key"), c(k).alias("value")) for k in ("oldest", "newest")),
                *(F.struct(F.lit(f"{s}-truncated").alias("metric"), F.lit("").alias("key"), c(s).alias("value")) for s in ("ambiguous", "unmatched")),
            )
        )
    )
    return listed.unionByName(extra)


def latest_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Latest row per key by (observed or retrieved time, id); combines on the map side."""
    stamp = F.coalesce("observed_at", "retrieved_at")
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(stamp, F.col("id"))).alias("r"))
    return best.select(*keys, "r.*")
