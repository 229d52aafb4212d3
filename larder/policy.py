"""Policies and word lists. Values that results depend on are stated here, together and plainly."""

from __future__ import annotations

from dataclasses import dataclass, field

from larder.functions.clock import Clock

# Category tags that raise a category signal.
CATEGORY_SIGNALS = {
    "fresh-fruit": ["en:fresh-fruits"],
    "fresh-vegetable": ["en:fresh-vegetables"],
    "basic-herb": ["en:fresh-herbs", "en:culinary-herbs"],
    "plain-cow-milk": ["en:plain-cow-milks", "en:plain-cow-milk"],
    "plain-water": ["en:plain-waters", "en:plain-water"],
    "bakery": ["en:biscuits", "en:breads", "en:cakes", "en:pastries"],
    "prepared-food": ["en:prepared-meals", "en:ready-meals", "en:prepared-foods"],
    "processed-dairy": ["en:yogurts", "en:cheeses", "en:dairy-desserts"],
    "meat-or-substitute": ["en:meats", "en:meat-alternatives", "en:plant-based-meat-alternatives"],
    "confectionery": ["en:confectioneries", "en:candies", "en:chocolates"],
    "snack": ["en:snacks", "en:chips-and-fries", "en:biscuits"],
    "dessert": ["en:desserts", "en:dairy-desserts", "en:frozen-desserts"],
    "sauce-condiment-seasoning": ["en:sauces", "en:condiments", "en:seasonings"],
    "processed-spread": ["en:spreads", "en:sweet-spreads", "en:savoury-spreads"],
    "formulated-beverage": ["en:soft-drinks", "en:energy-drinks", "en:flavoured-drinks"],
}

# Substrings of folded ingredient text that raise a formulation signal.
FORMULATION_WORDS = {
    "flavoured": ["flavour", "flavor", "aroma", "arôme"],
    "enzyme": ["enzyme", "enzym"],
    "culture": ["culture", "kultur"],
    "rennet": ["rennet", "lab"],
    "gelatine": ["gelatin", "gelatine", "gelatina"],
    "alcohol-related": ["ethanol", "alcohol", "alkohol", "rum", "wine", "wein"],
    "fortified": ["vitamin", "mineral", "fortified", "angereichert"],
}

# Country tags that name a market, first match wins.
MARKET_TAGS = {
    "DE": ["en:germany", "de:deutschland"],
    "FR": ["en:france", "fr:france"],
    "AT": ["en:austria", "de:osterreich", "de:österreich"],
    "CH": ["en:switzerland", "de:schweiz"],
}
OTHER_MARKET = "ZZ"

# Provenance markers of codes a source made up.
NO_BARCODE_MARKERS = [
    "source-assigned-no-barcode",
    "open-food-facts:source-assigned-no-barcode",
    "en:source-assigned-no-barcode",
]

# Product fields whose owner-supplied text may be hashed.
PRODUCER_FIELDS = [
    "allergens", "allergens_de", "allergens_en", "brands", "generic_name", "generic_name_de", "generic_name_en",
    "ingredients_text", "ingredients_text_de", "ingredients_text_en", "product_name", "product_name_de",
    "product_name_en", "quantity", "traces", "traces_de", "traces_en",
]


@dataclass(frozen=True)
class BasicRule:
    code: str
    signals: tuple[str, ...]
    max_ingredients: int
    unknown_count_ok: bool


@dataclass(frozen=True)
class SelectionPolicy:
    # Version, names of signals, kinds and rules.
    version: str = "1.0.0"
    market: str = "DE"
    product_types: tuple[str, ...] = ("food",)
    barcode_kinds: tuple[str, ...] = ("retail-gtin",)
    evidence_signals: tuple[str, ...] = ("certification", "review", "correction")
    formulation_signals: tuple[str, ...] = (
        "multi-ingredient", "additive", "compound", "flavoured", "fortified", "enzyme", "culture", "rennet",
        "gelatine", "alcohol-related",
    )
    category_signals: tuple[str, ...] = (
        "bakery", "prepared-food", "processed-dairy", "meat-or-substitute", "confectionery", "snack", "dessert",
        "sauce-condiment-seasoning", "processed-spread", "formulated-beverage", "methodology-high-interest",
    )
    basic_rules: tuple[BasicRule, ...] = (
        BasicRule("basic-fresh-produce", ("fresh-fruit", "fresh-vegetable", "basic-herb"), 1, True),
        BasicRule("basic-plain-milk", ("plain-cow-milk",), 1, False),
        BasicRule("basic-plain-water", ("plain-water",), 1, False),
    )
    audit_sample: int = 20


@dataclass(frozen=True)
class SourcePolicy:
    # Schema version, hosts and the bound on malformed lines.
    schema_version: str = "1004"
    image_hosts: tuple[str, ...] = ("images.openfoodfacts.org", "world.openfoodfacts.org")
    source_key: str = "open-food-facts"
    max_malformed_rate: float = 0.001


@dataclass(frozen=True)
class QualityPolicy:
    # Months of the clocks, trust of sources, bounds of the gates.
    formulation: Clock = Clock(9, 12)
    retailer: Clock = Clock(1, 3)
    certification: Clock = Clock(3, 6)
    source_trust: dict[str, int] = field(
        default_factory=lambda: {
            "package-photo": 600, "manufacturer": 500, "certifier": 450, "identity-registry": 400,
            "retailer-official": 300, "open-database": 200, "community-observation": 100, "synthetic": 1000,
        }
    )
    min_baseline: int = 100
    max_decrease: float = 0.25
    max_increase: float = 1.0
    max_parser_errors: float = 0.001
    positive_statuses: tuple[str, ...] = ("halal-certified", "halal-reviewed")
    min_reviewers: int = 2
    seed: str = "catalog-quality-v1"
    base_sample: int = 25
    wide_sample: int = 100
    defect_rate: float = 0.05
