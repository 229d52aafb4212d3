"""SQL snippets the oracles share (DuckDB dialect)."""

from __future__ import annotations

from larder import policy as P


def gtin(x: str) -> str:
    """Strict GTIN-14 of a code expression, else null."""
    return f"""(case when regexp_full_match({x}, '[0-9]{{8}}|[0-9]{{12,14}}')
      and (10 - list_sum([try_cast(substr(lpad({x}, 14, '0'), i, 1) as int) * (case when i % 2 = 1 then 3 else 1 end)
                          for i in range(1, 14)]) % 10) % 10 = try_cast(right({x}, 1) as int)
      then lpad({x}, 14, '0') end)"""


def slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def texts(x: str) -> str:
    """Non-blank members of a possibly null list."""
    return f"list_filter(coalesce({x}, []), lambda v: v is not null and trim(v) <> '')"


def tags(field: str) -> str:
    """Direct tags united with the nested ones of the demo's two JSON shapes."""
    node = f"""coalesce(cast(json_extract(tags_sources, '$.{field}') as varchar[]),
                        cast(json_extract(tags_sources, '$.import.{field}') as varchar[]), [])"""
    return f"list_sort(list_distinct(list_concat({texts(field + '_tags')}, {node})))"


def market(x: str) -> str:
    arms = " ".join(
        f"when list_has_any({x}, {tags_}) then '{code}'" for code, tags_ in P.MARKET_TAGS.items()
    )
    return f"case {arms} else 'ZZ' end"


def _signal_list(tests: dict[str, str]) -> str:
    items = ", ".join(f"case when {tests[s]} then '{s}' end" for s in sorted(tests))
    return f"list_filter([{items}], lambda v: v is not null)"


def category_signals(x: str) -> str:
    return _signal_list({s: f"list_has_any({x}, {t})" for s, t in P.CATEGORY_SIGNALS.items()})


def formulation_signals(text: str, count: str) -> str:
    low = f"coalesce(replace(lower({text}), 'ß', 'ss'), '')"
    tests = {
        "multi-ingredient": f"coalesce({count} > 1, false)",
        "additive": f"(len({texts('additives_tags')}) > 0 or coalesce(additives_n > 0, false))",
        "compound": f"(contains({low}, '(') and contains({low}, ')'))",
    }
    for s, words in P.FORMULATION_WORDS.items():
        tests[s] = "(" + " or ".join(f"contains({low}, '{w}')" for w in words) + ")"
    return _signal_list(tests)


RETAILER_KEYS = f"""list_sort(list_distinct(list_filter(list_transform(
  list_concat({texts('stores_tags')}, {texts('purchase_places_tags')}),
  lambda v: {slug("regexp_replace(lower(v), '^[^:]*:', '')")}), lambda k: k <> '')))"""

LANG_OK = "regexp_full_match(lang, '[a-z]{2,3}(-[A-Za-z0-9]{2,8})*')"

# (line, language, text, position) of every ingredient text of a raw product.
INGREDIENT_TEXTS = f"""
localized_text as (
  select line, 'de' as language, ingredients_text_de as text from raw_product where trim(ingredients_text_de) <> ''
  union all
  select line, 'en', ingredients_text_en from raw_product where trim(ingredients_text_en) <> ''),
base_text as (
  select line, case when {LANG_OK} then lang else 'und' end as language, ingredients_text as text
  from raw_product where trim(ingredients_text) <> ''),
ingredient_text as (
  select line, language, text, row_number() over (
    partition by line order by (language <> 'de'), (language <> 'en'), language) - 1 as position
  from (select * from localized_text
        union all
        select * from base_text b where not exists (
          select 1 from localized_text l where l.line = b.line and l.language = b.language)) u)"""

IMAGES = """
image as (
  select line, purpose, url, left(sha256(url), 24) as image_id, cast(rev as varchar) as revision
  from (select line, rev, 'front' as purpose, image_front_url as url from raw_product
        union all select line, rev, 'ingredients', image_ingredients_url from raw_product
        union all select line, rev, 'nutrition', image_nutrition_url from raw_product) u
  where regexp_full_match(url, 'https://(images\\.openfoodfacts\\.org|world\\.openfoodfacts\\.org)(/.*)?'))"""

NAME = """coalesce(case when trim(product_name_de) <> '' then product_name_de end,
  case when trim(product_name) <> '' then product_name end,
  case when trim(generic_name) <> '' then generic_name end,
  concat('Open Food Facts product ', code))"""

# The declared count, else the objects of the ingredient list.
COUNT = """coalesce(case when ingredients_n >= 0 then ingredients_n end,
  case when json_type(ingredients) = 'ARRAY' then len(list_filter(json_extract(ingredients, '$[*]'), lambda v: json_type(v) = 'OBJECT'))::int end)"""

# The whole candidate projection; needs the raw_product view.
CANDIDATE = f"""{INGREDIENT_TEXTS}, {IMAGES},
tagged as (
  select *, {tags('categories')} as category_tags, {tags('countries')} as countries,
    {tags('labels')} as labels, {tags('packaging')} as packaging from raw_product),
candidate as (
  select t.line, source_record_id, code as barcode, {market('countries')} as market, product_type,
    case when list_contains(coalesce(codes_tags, []), 'en:source-assigned-no-barcode')
         then 'source-assigned-no-barcode' else 'retail-gtin' end as barcode_kind,
    {NAME} as name, case when trim(brands) <> '' then brands end as brand,
    i.text as ingredients_text, {COUNT} as ingredient_count, category_tags,
    {category_signals('category_tags')} as category_signals,
    {formulation_signals('i.text', COUNT)} as formulation_signals,
    case when len(list_filter(labels, lambda v: contains(lower(v), 'halal'))) > 0 then ['review'] else [] end as evidence_signals,
    {RETAILER_KEYS} as retailer_keys,
    list_sort(list_distinct(list_filter(list_transform(packaging, lambda v: {slug('v')}), lambda k: k <> ''))) as package_signals,
    m.images
  from tagged t
  left join ingredient_text i on i.line = t.line and i.position = 0
  left join (select line, string_agg(concat(purpose, '=', url, '#', image_id), ' ' order by purpose) as images
             from image group by line) m on m.line = t.line)"""


def decided(policy: P.SelectionPolicy, name: str = "decided") -> str:
    """The candidate CTE classified by a policy; needs CANDIDATE."""
    rules = "".join(
        f"\n when list_has_any(category_signals, {list(r.signals)}) and "
        f"{'coalesce(ingredient_count, 0)' if r.unknown_count_ok else 'ingredient_count'} <= {r.max_ingredients} "
        f"then 'exclude-basic/{r.code}'"
        for r in policy.basic_rules
    )
    return f"""
{name} as (
  select *, split_part(outcome, '/', 1) as decision, split_part(outcome, '/', 2) as reason from (
    select *, case when product_type not in ('food') then 'exclude-invalid/non-food'
      when market <> '{policy.market}' then 'exclude-invalid/wrong-market'
      when barcode_kind = 'source-assigned-no-barcode' then 'exclude-invalid/source-assigned-no-barcode'
      when gtin is null then 'exclude-invalid/invalid-or-unsupported-barcode'
      when list_has_any(evidence_signals, {list(policy.evidence_signals)}) then 'include-detailed/existing-evidence'
      when list_has_any(formulation_signals, {list(policy.formulation_signals)}) then 'include-detailed/formulation-signal'
      when list_has_any(category_signals, {list(policy.category_signals)}) then 'include-detailed/included-category'
      when ingredient_count > 1 then 'include-detailed/multi-ingredient'
      when trim(ingredients_text) <> '' and ingredient_count is null then 'include-detailed/ingredients-present-unquantified'{rules}
      else 'include-detailed/conservative-unknown' end as outcome
    from (select *, {gtin('barcode')} as gtin from candidate) g) o)"""


def joined(x: str, sep: str = "|") -> str:
    return f"array_to_string({x}, '{sep}')"
