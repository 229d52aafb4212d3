"""Raw product rows to normalized columns and selection candidates.

Everything here is row-local: one projection over the scan, no shuffle.
Raw columns are those of ``larder.schemas.RAW_PRODUCT``; language-suffixed keys live in ``localized``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import policy as P
from larder.functions import text
from larder.functions.stage import once

_JSON_STRING = r'"(?:[^"\\]|\\.)*+"(?:\s*+:)?'


def _texts(tags: Column) -> Column:
    return F.filter(F.coalesce(tags, F.array().cast("array<string>")), text.has_text)


def _leaf_strings(node: Column) -> Column:
    """All string values (not keys) of a JSON fragment, at any depth."""
    tokens = F.filter(F.regexp_extract_all(node, F.lit(_JSON_STRING), F.lit(0)), lambda t: t.endswith('"'))
    nested = F.from_json(F.concat(F.lit("["), F.array_join(tokens, ","), F.lit("]")), "array<string>")
    return F.when(node.isNull(), F.array().cast("array<string>")).when(
        node.rlike(r"\A\s*[\[{]"), nested
    ).otherwise(F.array(node))


def canonical_tags(field: str, tags: Column, tags_sources: Column) -> Column:
    """Direct tags united with the nested per-source tags of the same field, distinct and sorted."""
    groups = F.from_json(tags_sources, "map<string,string>")
    own = F.try_element_at(groups, F.lit(field))
    inner = F.flatten(
        F.transform(
            F.map_values(groups),
            lambda v: _leaf_strings(F.try_element_at(F.from_json(v, "map<string,string>"), F.lit(field))),
        )
    )
    nested = F.when(own.isNotNull(), _leaf_strings(own)).otherwise(F.coalesce(inner, F.array().cast("array<string>")))
    return F.array_sort(F.array_union(_texts(tags), _texts(nested)))


def market(countries: Column) -> Column:
    """First market whose country tags meet the row's tags."""
    branch = F.when(F.lit(False), P.OTHER_MARKET)
    for code, tags in P.MARKET_TAGS.items():
        branch = branch.when(F.arrays_overlap(countries, F.array(*map(F.lit, tags))), code)
    return branch.otherwise(P.OTHER_MARKET)


def no_barcode(codes_tags: Column, provenance_tags: Column, flag: Column) -> Column:
    markers = F.array(*map(F.lit, P.NO_BARCODE_MARKERS))
    marked = F.arrays_overlap(F.array_union(_texts(codes_tags), _texts(provenance_tags)), markers)
    return F.coalesce(flag, F.lit(False)) | marked


def ambiguous_prefix(code: Column, assigned: Column) -> Column:
    return F.coalesce(code.startswith("200"), F.lit(False)) & ~assigned


def ingredient_texts(localized: Column, base: Column, lang: Column) -> Column:
    """Array of (other_than_de, other_than_en, language, text), sorted: de, en, then by code."""
    kept = F.map_filter(
        localized,
        lambda k, v: k.startswith("ingredients_text_")
        & (k != "ingredients_text_with_allergens")
        & F.substring(k, 18, 64).rlike(text.LANGUAGE_TAG)
        & text.has_text(v),
    )
    entries = F.transform(F.map_entries(kept), lambda e: F.struct(F.substring(e["key"], 18, 64).alias("l"), e["value"].alias("t")))
    entries = F.coalesce(entries, F.array().cast("array<struct<l:string,t:string>>"))
    own = F.when(F.coalesce(lang.rlike(text.LANGUAGE_TAG), F.lit(False)), lang).otherwise("und")
    add_base = text.has_text(base) & ~F.exists(entries, lambda e: e["l"] == own)
    entries = F.when(add_base, F.concat(entries, F.array(F.struct(own.alias("l"), base.alias("t"))))).otherwise(entries)
    ranked = F.transform(
        entries,
        lambda e: F.struct(
            (e["l"] != "de").alias("not_de"), (e["l"] != "en").alias("not_en"), e["l"].alias("language"), e["t"].alias("text")
        ),
    )
    return F.array_sort(ranked)


def language_conflict(localized: Column, base: Column, lang: Column) -> Column:
    """The localized text of the declared language, when it differs from the base text."""
    other = F.try_element_at(localized, F.concat(F.lit("ingredients_text_"), lang))
    differs = text.has_text(base) & text.has_text(other) & (other != base)
    return F.when(lang.rlike(text.LANGUAGE_TAG) & differs, other)


def ingredient_count(declared: Column, listed: Column | None = None) -> Column:
    """The declared count if it is not negative, else the number of objects in the ingredient list (JSON text)."""
    valid = F.when(declared >= 0, declared)
    if listed is None:
        return valid
    items = F.from_json(F.when(listed.rlike(r"\A\s*\["), listed), "array<string>")
    return F.coalesce(valid, F.when(items.isNotNull(), F.size(F.filter(items, lambda v: v.startswith("{")))))


def _signals(tests: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(tests[name], name) for name in sorted(tests))))


def category_signals(tags: Column) -> Column:
    return _signals({s: F.arrays_overlap(tags, F.array(*map(F.lit, t))) for s, t in P.CATEGORY_SIGNALS.items()})


def formulation_signals(ingredients: Column, count: Column, additives_n: Column, additives_tags: Column) -> Column:
    folded = F.coalesce(text.fold_case(ingredients), F.lit(""))
    tests = {
        "multi-ingredient": count > 1,
        "additive": (F.size(_texts(additives_tags)) > 0) | F.coalesce(additives_n > 0, F.lit(False)),
        "compound": folded.contains("(") & folded.contains(")"),
    }
    for signal, words in P.FORMULATION_WORDS.items():
        hit = folded.contains(words[0])
        for word in words[1:]:
            hit = hit | folded.contains(word)
        tests[signal] = hit
    return _signals(tests)


def retailer_keys(stores: Column, places: Column) -> Column:
    """Store and place tags as slugs."""
    keys = F.transform(
        F.array_union(_texts(stores), _texts(places)),
        lambda v: text.slug(F.regexp_replace(text.fold_case(v), r"\A[^:]*:", "")),
    )
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k != "")))


def package_signals(packaging: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(packaging, text.slug), lambda k: k != "")))


def remote_images(urls: dict[str, Column], rev: Column, hosts: tuple[str, ...]) -> Column:
    """Admitted https image references, ordered by purpose then URL."""
    items = []
    for purpose in sorted(urls):
        url = urls[purpose]
        ok = text.has_text(url) & (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.lower(
            F.try_parse_url(url, F.lit("HOST"))
        ).isin(*hosts)
        item = F.struct(
            F.lit(purpose).alias("purpose"),
            url.alias("url"),
            F.substring(F.sha2(url, 256), 1, 24).alias("image_id"),
            rev.cast("string").alias("revision"),
        )
        items.append(F.when(ok, item))
    return F.array_compact(F.array(*items))


def first_text(*values: Column) -> Column:
    return F.coalesce(*map(text.nonblank, values))


def product_name(localized: Column, name: Column, generic: Column, code: Column) -> Column:
    fallback = F.concat_ws(" ", F.lit("Open Food Facts product"), F.nullif(code, F.lit("")))
    return F.coalesce(
        first_text(
            F.try_element_at(localized, F.lit("product_name_de")), name,
            F.try_element_at(localized, F.lit("generic_name_de")), generic,
        ),
        fallback,
    )


def text_or_tags(values: list[Column], tags: Column) -> Column:
    joined = F.array_join(_texts(tags), ", ")
    return F.coalesce(first_text(*values), F.nullif(joined, F.lit("")))


def candidates(raw: DataFrame, source: P.SourcePolicy) -> DataFrame:
    """One candidate per raw row; the whole normalization as a chain of projections."""
    c = F.col
    base = once(
        raw,
        category_tags=canonical_tags("categories", c("categories_tags"), c("tags_sources")),
        countries=canonical_tags("countries", c("countries_tags"), c("tags_sources")),
        best=F.try_element_at(ingredient_texts(c("localized"), c("ingredients_text"), c("lang")), F.lit(1))["text"],
        ingredient_count=ingredient_count(c("ingredients_n"), c("ingredients") if "ingredients" in raw.columns else None),
        assigned=no_barcode(c("codes_tags"), F.lit(None), F.lit(None).cast("boolean")),
    )
    labels = canonical_tags("labels", c("labels_tags"), c("tags_sources"))
    packaging = canonical_tags("packaging", c("packaging_tags"), c("tags_sources"))
    urls = {
        "front": c("image_front_url"), "ingredients": c("image_ingredients_url"), "nutrition": c("image_nutrition_url"),
    }
    return base.select(
        "line",
        F.coalesce(c("source_record_id"), F.nullif(c("code"), F.lit("")), F.lit("missing-code")).alias("source_record_id"),
        F.coalesce(c("code"), F.lit("")).alias("barcode"),
        market(c("countries")).alias("market"),
        F.coalesce(c("product_type"), F.lit("food")).alias("product_type"),
        F.when(c("assigned"), "source-assigned-no-barcode").otherwise("retail-gtin").alias("barcode_kind"),
        product_name(c("localized"), c("product_name"), c("generic_name"), c("code")).alias("name"),
        text.nonblank(c("brands")).alias("brand"),
        c("best").alias("ingredients_text"),
        "ingredient_count",
        "category_tags",
        category_signals(c("category_tags")).alias("category_signals"),
        formulation_signals(c("best"), c("ingredient_count"), c("additives_n"), c("additives_tags")).alias(
            "formulation_signals"
        ),
        F.when(F.exists(labels, lambda v: text.fold_case(v).contains("halal")), F.array(F.lit("review")))
        .otherwise(F.array().cast("array<string>"))
        .alias("evidence_signals"),
        retailer_keys(c("stores_tags"), c("purchase_places_tags")).alias("retailer_keys"),
        package_signals(packaging).alias("package_signals"),
        remote_images(urls, c("rev"), source.image_hosts).alias("remote_images"),
    )
