"""Declared input schemas; nothing is inferred."""

from __future__ import annotations

# Columns of a raw product record, as ``from_json`` reads it. Language-suffixed keys are gathered in ``localized``.
RAW_PRODUCT = (
    "code string, _id string, schema_version string, product_type string, lang string, product_name string, "
    "generic_name string, brands string, quantity string, countries_tags array<string>, categories_tags array<string>, "
    "labels_tags array<string>, tags_sources string, codes_tags array<string>, ingredients_n int, ingredients string, ingredients_text string, "
    "additives_n int, additives_tags array<string>, stores_tags array<string>, purchase_places_tags array<string>, "
    "packaging_tags array<string>, image_front_url string, image_ingredients_url string, image_nutrition_url string, "
    "allergens string, allergens_tags array<string>, traces string, traces_tags array<string>, rev bigint, last_modified_t bigint"
)
LOCALIZED_PREFIXES = ("product_name_", "generic_name_", "ingredients_text_", "allergens_", "traces_")

# The columns of a catalog source shard, in file order.
SHARD_COLUMNS = [
    "gtin", "original_barcode", "market", "brand", "product_name", "variant", "quantity", "category",
    "identity_confidence", "identity_source_key", "identity_source_record_id", "identity_retrieved_at",
    "ingredients_text", "ingredients_language", "allergens_text", "ingredients_source_key",
    "ingredients_source_record_id", "ingredients_retrieved_at", "ingredients_observed_at", "ingredients_source_url",
    "retailer_kind", "retailer_key", "retailer_confidence", "retailer_source_key", "retailer_source_record_id",
    "retailer_retrieved_at", "retailer_observed_at", "retailer_snapshot_at", "retailer_location_id",
    "retailer_source_url", "retailer_scope", "retailer_limitations",
]
SHARD_SCHEMA = ", ".join(f"{c} string" for c in SHARD_COLUMNS)
