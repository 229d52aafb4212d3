"""Demo queries: evidence tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import ids
from larder.operators import evidence as E
from larder.plans import evidence_views  # noqa: F401  (registers the views)
from larder.plans.inputs import Inputs
from larder.plans.registry import query

COLLECTIONS = (
    "source", "identity", "ingredient", "assessment", "reason", "certification", "review", "validity_event", "retailer",
    "image", "selection", "selection_link", "assessment_cert",
)
ALL = " ".join(COLLECTIONS)


class Envelope(dict):
    """The collections of one snapshot, read on first use."""

    def __init__(self, inputs: Inputs):
        super().__init__()
        self.inputs = inputs

    def __missing__(self, name: str):
        self[name] = self.inputs.view(name)
        return self[name]


def _json(pairs: dict[str, str]) -> str:
    """Canonical JSON of non-null SQL expressions, keys sorted."""
    items = ", ".join(f"""'"{k}":' || to_json({v})""" for k, v in sorted(pairs.items()))
    return f"'{{' || array_to_string(list_filter([{items}], lambda x: x is not null), ',') || '}}'"


@query(
    "evidence_ids", "identity ingredient",
    f"""
select 'identity' as collection, k, 'ev:identity:sha256:' || sha256({_json({'gtin': 'gtin', 'market': 'market', 'sourceKey': 'source_key', 'sourceRecordID': 'source_record_id', 'name': 'name', 'brand': 'brand', 'quantity': 'quantity', 'categories': 'list_sort(categories)', 'retrievedAt': 'retrieved_at'})}) as id,
  null as formulation_hash, id as stored_id from identity
union all
select 'ingredient', k, 'ev:ingredient:sha256:' || sha256({_json({'gtin': 'gtin', 'market': 'market', 'ingredientsText': 'ingredients_text', 'languageCode': 'language_code', 'retrievedAt': 'retrieved_at', 'supersedesID': 'supersedes_id'})}),
  sha256('{{"allergensText":null,"ingredientsText":' || to_json(ingredients_text) || ',"tracesText":null}}'), id from ingredient""",
)
def evidence_ids(i: Inputs):
    c = F.col
    identity = {
        "gtin": c("gtin"), "market": c("market"), "sourceKey": c("source_key"), "sourceRecordID": c("source_record_id"),
        "name": c("name"), "brand": c("brand"), "quantity": c("quantity"), "categories": F.array_sort("categories"),
        "retrievedAt": c("retrieved_at"),
    }
    ingredient = {
        "gtin": c("gtin"), "market": c("market"), "ingredientsText": c("ingredients_text"), "languageCode": c("language_code"),
        "retrievedAt": c("retrieved_at"), "supersedesID": c("supersedes_id"),
    }
    none = F.lit(None).cast("string")
    first = i.view("identity").select(
        F.lit("identity").alias("collection"), "k", ids.evidence_id("identity", identity).alias("id"),
        none.alias("formulation_hash"), c("id").alias("stored_id"),
    )
    second = i.view("ingredient").select(
        F.lit("ingredient").alias("collection"), "k", ids.evidence_id("ingredient", ingredient).alias("id"),
        ids.formulation_hash(c("ingredients_text"), none, none).alias("formulation_hash"), c("id").alias("stored_id"),
    )
    return first.unionByName(second)


def _ref(label: str, child: str, ref: str, parent: str, keyed: bool = True) -> str:
    wrong = f" when p.gtin <> c.gtin or p.market <> c.market then '{label}-wrong-key'" if keyed else ""
    return f"""select rule, record_id, ref_id from (
  select case when p.id is null then '{label}-unknown'{wrong} end as rule, c.record_id, c.{ref} as ref_id
  from {child} c left join {parent} p on p.id = c.{ref} where c.{ref} is not null) x where rule is not null"""


@query(
    "referential_violations", ALL,
    f"""
sel as (select *, id as record_id from selection), asm as (select *, id as record_id from assessment), ing as (select *, id as record_id from ingredient),
lnk as (select l.*, s.gtin, s.market, s.id as record_id from selection_link l join selection s on s.id = l.selection_id),
crt as (select l.certification_id, a.gtin, a.market, a.id as record_id from assessment_cert l join assessment a on a.id = l.assessment_id),
rev as (select *, id as record_id from review), rsn as (select distinct assessment_id as record_id, evidence_id from reason)
{' union all '.join([
    _ref('selection-identity', 'sel', 'identity_id', 'identity'), _ref('selection-ingredient', 'sel', 'ingredient_id', 'ingredient'),
    _ref('selection-assessment', 'sel', 'assessment_id', 'assessment'), _ref('assessment-ingredient', 'asm', 'ingredient_id', 'ingredient'),
    _ref('assessment-certification', 'crt', 'certification_id', 'certification'), _ref('ingredient-supersedes', 'ing', 'supersedes_id', 'ingredient'),
    _ref('review-target', 'rev', 'target_id', 'assessment', False), _ref('reason-evidence', 'rsn', 'evidence_id', 'identity', False),
    *(_ref(f'selection-{k}', f"(select * from lnk where kind = '{k}')", 'ref_id', k) for k in ('certification', 'retailer', 'image')),
])}
union all select 'selection-superseded-ingredient', id, ingredient_id from selection
where ingredient_id in (select supersedes_id from ingredient where supersedes_id is not null)""",
    materialized=True,
)
def referential_violations(i: Inputs):
    return E.referential_violations(Envelope(i))


SCOPED = ("identity", "ingredient", "retailer", "image", "certification")


@query(
    "source_market_violations", ALL,
    f"""
r as ({' union all '.join(f"select '{k}' as collection, source_key, market from {k}" for k in SCOPED)}),
v as (select r.*, case when s.source_key is null then 'unknown-source' when not list_contains(s.markets, r.market) then 'undeclared-market' end as rule
      from r left join source s on s.source_key = r.source_key)
select collection, source_key, market, rule, count(*) as n from v where rule is not null group by all""",
)
def source_market_violations(i: Inputs):
    e = Envelope(i)
    return E.source_market_violations({k: e[k] for k in SCOPED}, e["source"])


@query(
    "key_uniqueness", ALL,
    """select 'selection-key' as rule, concat_ws('/', gtin, market) as key, count(*) as n from selection group by 2 having count(*) > 1
union all select 'retailer-key', concat_ws('/', gtin, market, retailer_key, observed_at), count(*) from retailer group by gtin, market, retailer_key, observed_at having count(*) > 1
union all select 'certification-gtin', concat_ws('/', gtin, market), count(*) from certification group by gtin, market having count(*) > 1
union all select 'source-key', source_key, count(*) from source group by source_key having count(*) > 1""",
)
def key_uniqueness(i: Inputs):
    e = Envelope(i)
    return E.key_uniqueness(
        {
            "selection-key": (e["selection"], ["gtin", "market"]),
            "retailer-key": (e["retailer"], ["gtin", "market", "retailer_key", "observed_at"]),
            "certification-gtin": (e["certification"], ["gtin", "market"]),
            "source-key": (e["source"], ["source_key"]),
        }
    )


@query(
    "validity_fold", "validity_event",
    """select assessment_id, kind as last_kind, events, kind = 'restored' as valid from (
  select *, row_number() over (partition by assessment_id order by occurred_at desc, ordinal desc) as rn,
    count(*) over (partition by assessment_id) as events from validity_event) x where rn = 1""",
)
def validity_fold(i: Inputs):
    return E.validity(i.view("validity_event"))


@query(
    "evidence_delta", "retailer",
    """
p as (select id from retailer where line_number <> 2), c as (select id from retailer where line_number <> 5)
select change, count(*) as n, min(id) as first_id from (
  select coalesce(p.id, c.id) as id, case when p.id is null then 'added' when c.id is null then 'removed' else 'unchanged' end as change
  from p full join c on c.id = p.id) x group by change""",
)
def evidence_delta(i: Inputs):
    r = i.view("retailer")
    delta = E.evidence_delta(r.filter("line_number <> 2"), r.filter("line_number <> 5"), complete=True)
    return delta.groupBy("change").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(
    "merge_history", "ingredient",
    """
c as (select id, gtin, 'current' as origin from ingredient where k % 4 = 1), p as (select id, gtin, 'previous' as origin from ingredient where k % 2 = 1)
select * from c union all select * from p where id not in (select id from c)""",
)
def merge_history(i: Inputs):
    rows = i.view("ingredient").select("id", "gtin", "k")
    current = rows.filter("k % 4 = 1").select("id", "gtin", F.lit("current").alias("origin"))
    previous = rows.filter("k % 2 = 1").select("id", "gtin", F.lit("previous").alias("origin"))
    return E.merge_history(previous, current)


@query(
    "supersession_cycles", "chain",
    """
walk as (
  select id as start, id as at, 0 as hops from chain
  union all
  select w.start, c.supersedes_id, w.hops + 1 from walk w join chain c on c.id = w.at join chain p on p.id = c.supersedes_id where w.hops < 20),
reach as (select start, max(hops) as depth from walk group by start)
select c.id, case when r.depth < 20 then cast(r.depth as bigint) else -1 end as depth,
  case when r.depth >= 20 then 'cycle' when c.supersedes_id is not null and p.id is null then 'missing-parent'
       when p.gtin <> c.gtin or p.market <> c.market then 'cross-key-parent' end as problem
from chain c join reach r on r.start = c.id left join chain p on p.id = c.supersedes_id""",
)
def supersession_cycles(i: Inputs):
    return E.supersession(i.view("chain")).fillna(-1, ["depth"])


@query(
    "child_positions", "retailer",
    "select id, gtin, cast(row_number() over (partition by gtin, market order by id) - 1 as bigint) as position from retailer",
)
def child_positions(i: Inputs):
    return E.child_positions(i.view("retailer").select("id", "gtin", "market"), ["gtin", "market"]).select("id", "gtin", "position")


@query(
    "child_position_gaps", "reason",
    """select assessment_id, count(*) as n, count(distinct position) as distinct_positions, min(position) as low, max(position) as high
from reason group by assessment_id having min(position) <> 0 or max(position) + 1 <> count(*) or count(distinct position) <> count(*)""",
)
def child_position_gaps(i: Inputs):
    return E.position_gaps(i.view("reason"), "assessment_id")


def _digest_sql(table: str, columns: str) -> str:
    sums = "\n".join(
        f", cast(coalesce(sum(cast(cast('0x' || substr(h, {1 + 15 * n}, 15) as ubigint) as hugeint)), 0) as varchar) as w{n}" for n in range(4)
    )
    fields = " || ',' || ".join(f"""'"{c}":' || coalesce(to_json({c}), 'null')""" for c in sorted(columns.split()))
    return f"""select '{table}' as table_name, n, sha256(concat_ws('/', n, w0, w1, w2, w3)) as digest from (
  select count(*) as n{sums} from (select sha256('{{' || {fields} || '}}') as h from {table}) r) s"""


DIGESTED = {"retailer": "id gtin market kind observed_at", "certification": "id gtin certifier expiry_at", "selection": "id gtin identity_id ingredient_id"}


@query("dataset_digest", "retailer certification selection", " union all ".join(_digest_sql(t, c) for t, c in DIGESTED.items()))
def dataset_digest(i: Inputs):
    return E.dataset_digest({t: i.view(t).select(*c.split()) for t, c in DIGESTED.items()})


@query(
    "serving_projection", ALL,
    """
src as (select 'certification' as kind, id as ref_id, source_key from certification union all select 'retailer', id, source_key from retailer
        union all select 'image', id, source_key from image),
ch as (select l.*, s.source_key from selection_link l join src s on s.kind = l.kind and s.ref_id = l.ref_id),
n as (select selection_id, count(*) filter (where kind = 'certification') as certifications, count(*) filter (where kind = 'retailer') as retailers,
        count(*) filter (where kind = 'image') as images from ch group by selection_id),
pr as (select s.id, s.gtin, s.market, i.name, i.brand, array_to_string(list_sort(i.categories), '|') as categories, g.content_hash, a.status,
    i.source_key as identity_source, g.source_key as ingredient_source,
    coalesce(n.certifications, 0) as certifications, coalesce(n.retailers, 0) as retailers, coalesce(n.images, 0) as images
  from selection s join identity i on i.id = s.identity_id left join ingredient g on g.id = s.ingredient_id
  left join assessment a on a.id = s.assessment_id left join n on n.selection_id = s.id)
select 'product' as part, id, gtin, market, name, brand, categories, content_hash, status, certifications, retailers, images from pr
union all
select 'source', source_key, null, null, null, null, null, null, null, 0, 0, 0 from (
  select identity_source as source_key from pr union select ingredient_source from pr where ingredient_source is not null union select source_key from ch) u""",
)
def serving_projection(i: Inputs):
    products, _, used = E.serving_projection(Envelope(i))
    rows = products.select(
        F.lit("product").alias("part"), F.col("selection_id").alias("id"), "gtin", "market", "name", "brand",
        F.array_join("categories", "|").alias("categories"), "content_hash", "status", "certifications", "retailers", "images",
    )
    sources = used.select(F.lit("source").alias("part"), F.col("source_key").alias("id"))
    return rows.unionByName(sources, allowMissingColumns=True).fillna(0, ["certifications", "retailers", "images"])


@query(
    "attach_retailer_evidence", "selection retailer selection_link",
    """
inc as (select id, gtin, market from retailer),
k as (select gtin, market, id as selection_id from selection),
lnk as (select selection_id, ref_id from selection_link where kind = 'retailer' union select k.selection_id, inc.id from inc join k on k.gtin = inc.gtin and k.market = inc.market)
select 'linked' as outcome, selection_id, count(*) as n, min(ref_id) as first_id from lnk group by selection_id
union all
select 'unmatched', gtin, count(*), min(id) from inc where not exists (select 1 from k where k.gtin = inc.gtin and k.market = inc.market) group by gtin""",
)
def attach_retailer_evidence(i: Inputs):
    links = i.view("selection_link").filter("kind = 'retailer'").select("selection_id", "kind", "ref_id").distinct()
    joined, unmatched = E.attach_retailer_evidence(i.view("selection"), i.view("retailer"), links)
    a = joined.groupBy("selection_id").agg(F.count("*").alias("n"), F.min("ref_id").alias("first_id")).select(
        F.lit("linked").alias("outcome"), "selection_id", "n", "first_id"
    )
    b = unmatched.groupBy(F.col("gtin").alias("selection_id")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).select(
        F.lit("unmatched").alias("outcome"), "selection_id", "n", "first_id"
    )
    return a.unionByName(b)
