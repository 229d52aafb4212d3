"""Registered queries of the training-data operators, with their oracle SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontaminate, exact_dedup, licenses, line_dedup, merkle, mixing, near_dedup, phrases, quality, secrets, sharding, substring_dedup, warc
from larder.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARD_WEIGHTS = [1.0] * 8


def query(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_exact_dedup", """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id is not distinct from max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op4_mix_sources", r"""
with sized as (
  select doc_id, coalesce(source, '') as source, (source is null)::int as no_source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as key
  from documents),
per as (select no_source, source, sum(size)::bigint as source_size from sized group by all),
weighed as (
  select *, [3, 1, 2][((row_number() over (order by no_source, source) - 1) % 3 + 1)::int] as weight, source_size * 2 as cap from per),
levels as (
  select *, ((sum(source_size) over ()) * 1.5::double - coalesce(sum(cap) over up, 0)) / ((sum(weight) over ()) - coalesce(sum(weight) over up, 0)) as level
  from weighed window up as (order by cap / weight, no_source, source rows between unbounded preceding and 1 preceding)),
goal as (
  select no_source, source, source_size,
         least(cap::double, (select max(level) from levels where cap / weight >= level) * weight) as target
  from levels),
placed as (
  select s.doc_id, s.size, g.source_size, g.target,
         coalesce(sum(s.size) over (partition by s.no_source, s.source order by s.key, s.doc_id rows between unbounded preceding and 1 preceding), 0) as before,
         case when g.source_size > 0 then floor(floor(g.target) / g.source_size) else 0 end as epochs
  from sized s join goal g using (no_source, source))
select doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::bigint as taken
from placed
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op5_rendezvous_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_WEIGHTS)


@query("op8_line_dedup", r"""
with docs as (select distinct doc_id, substr(sha256(text), 1, 32) as doc_key, string_split(text, chr(10)) as lines from documents where text is not null),
begun as (select *, list_filter(range(1, len(lines) + 1), lambda i: i = 1 or regexp_matches(lines[i], '[^\x20\x09-\x0D]')) as starts from docs),
units as (
  select coalesce(doc_id, 9223372036854775807) as doc_id, doc_key, unnest(range(len(starts))) as pos, unnest([lines[i] for i in starts]) as line,
         unnest(list_transform(range(1, len(starts) + 1), lambda u: array_to_string(lines[starts[u]:coalesce(starts[u + 1] - 1, len(lines))], chr(10)))) as unit,
         unnest(list_transform(range(1, len(starts) + 1), lambda u: coalesce(starts[u + 1], len(lines) + 1) - starts[u])) as height
  from begun),
firsts as (select *, min({'doc': doc_id, 'key': doc_key, 'pos': pos}) over (partition by line) as f, regexp_matches(line, '[^\x20\x09-\x0D]') and f <> {'doc': doc_id, 'key': doc_key, 'pos': pos} as gone from units),
cut as (
  select doc_id, doc_key, sum(height) filter (where gone)::bigint as n_removed, coalesce(string_agg(unit, chr(10) order by pos) filter (where not gone), '') as kept_text
  from firsts group by all),
runs as (
  select doc_id, doc_key, count(*) as n_runs
  from (select *, lag(pos) over (partition by doc_id, doc_key, f.doc, f.key, pos - f.pos order by pos) as prior from firsts where gone)
  where prior is null or prior <> pos - 1 group by all)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(n_runs, 0) as n_runs,
       case when n_removed is null then d.text else c.kept_text end as kept_text
from documents d
left join cut c on c.doc_id = coalesce(d.doc_id, 9223372036854775807) and c.doc_key = substr(sha256(d.text), 1, 32)
left join runs r on r.doc_id = coalesce(d.doc_id, 9223372036854775807) and r.doc_key = substr(sha256(d.text), 1, 32)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def _secret_sql() -> str:
    """Places from splits and running lengths; owners counted over the whole corpus."""
    branches = []
    for rank, kind in enumerate(secrets.BASE + secrets.MORE):
        # DuckDB's patterns can't look behind: a group takes the character before, and its length comes off again
        pattern = (f"(^|[^{kind.apart}]){kind.pattern}" if kind.apart else kind.pattern).replace("'", "''")
        before = f"regexp_extract_all(text, '{pattern}', 1)" if kind.apart else "[]::varchar[]"
        value = kind.value + 1 if kind.apart and kind.value else kind.value
        branches.append(f"""
  select doc_id, text, doc_key, owner, repository, {rank} as rank, '{kind.name}' as kind, {kind.base} as base, {kind.least} as least,
         unnest(range(1, len(m) + 1)) as i, unnest(list_transform(range(1, len(v) + 1), lambda i: {"v[i][coalesce(len(b[i]), 0) + 1:]" if not kind.value else "v[i]"})) as value,
         unnest(list_transform(range(1, len(m) + 1), lambda i: coalesce(len(b[i]), 0)::bigint)) as lead,
         unnest(list_transform(range(1, len(m) + 1), lambda i: len(p[i])::bigint)) as gap, unnest(list_transform(m, lambda s: len(s)::bigint)) as length
  from (select *, string_split_regex(text, '{pattern}') as p, {before} as b, regexp_extract_all(text, '{pattern}', 0) as m, regexp_extract_all(text, '{pattern}', {value}) as v from docs)""")
    counts = ", ".join(f"count(*) filter (where kind = '{k.name}') as n_{k.name}" for k in secrets.BASE)
    zero = ", ".join(f"coalesce(n_{k.name}, 0) as n_{k.name}" for k in secrets.BASE)
    return f"""
with docs as (
  select doc_id, coalesce(text, '') as text, substr(sha256(coalesce(text, '')), 1, 32) as doc_key, coalesce(source, chr(0)) as owner,
         coalesce(source, '') || '/' || coalesce(lang, '') as repository from documents),
listed as ({' union all '.join(branches)}),
found as (
  select *, sum(gap + length) over (partition by doc_id, doc_key, rank order by i) as "end" from listed qualify len(value) >= least),
by_text as (select value, doc_key, min({{'o': owner, 'r': repository}}) as held from found group by all),
owned as (select value, count(distinct held.o) as n_owners, count(distinct held) as n_repositories from by_text group by 1),
judged as (
  select distinct doc_id, doc_key, rank, kind, base, ("end" - length + lead)::bigint as start, "end"::bigint as "end", n_owners >= {secrets.OWNERS} or n_repositories >= {secrets.REPOSITORIES} as example
  from found join owned using (value)),
per as (
  select doc_id, doc_key, {counts},
         string_agg(kind || ':' || start || ':' || "end", ',' order by start, rank) filter (where base) as base_spans,
         string_agg(kind || ':' || start || ':' || "end", ',' order by start, rank) as spans,
         count(*) filter (where not example) as n_live, count(*) filter (where example) as n_example
  from judged group by all)
select d.doc_id, {zero}, sha256(coalesce(base_spans, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example
from docs d left join per p on p.doc_key = d.doc_key and p.doc_id is not distinct from d.doc_id
"""


@query("op10_secret_scan", _secret_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    repository = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")))
    return secrets.secret_report(table(spark, sf_dir, "documents"), F.col("source"), repository)


@query("op7_decontaminate")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


@query("op9_substring_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def _license_sql() -> str:
    lists = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    split = lambda text: re.findall("[0-9a-z]+", text.lower())
    catalog = ", ".join(f"('{label}', {lists(split(body))})" for label, body in licenses.TEMPLATES)
    phrases = ", ".join(f"('{label}', {lists(split(phrase))})" for phrase, label in licenses.PHRASES)
    return rf"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
catalog(label, t) as (values {catalog}),
phrases(label, p) as (values {phrases}),
places as (
  select r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(p)] = p)) as spot from docs, phrases where len(list_intersect(w, p)) = len(list_distinct(p))),
base as (select r, count(*) as n_base, min(spot) as first_word, max(spot) as last_word, list(distinct label) as labels from places group by r),
rarely as (select r, w, label, t, len(list_distinct(t)) as n from docs, catalog where len(list_intersect(w, t)) >= ceil({licenses.CONTAINED} * len(list_distinct(t)) - 1e-9)),
blocks as (
  select r, label, n, b, w, t, len(t) as stride, len(list_intersect(w[b * len(t) + 1:b * len(t) + 2 * len(t)], t)) as shared
  from (select *, unnest(range(((len(w) - 1) // len(t) + 1)::bigint)) as b from rarely)),
hits as (
  select *, shared / n as contained, list_filter(range(b * stride, least(b * stride + 2 * stride, len(w))), lambda i: list_contains(t, w[i + 1])) as spots
  from blocks where shared >= ceil({licenses.CONTAINED} * n - 1e-9)),
best as (
  select * from hits h where not exists (
    select 1 from hits o where o.r = h.r and o.spots[1] <= h.spots[-1] and h.spots[1] <= o.spots[-1] and (o.contained > h.contained or (o.contained = h.contained and o.n > h.n)))),
matched as (select r, max(contained) as contained, list(distinct label) as labels from best group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(matched.labels, [])))), ','), '') as labels,
       greatest(coalesce(contained, 0), case when n_base > 0 then 1 else 0 end)::double as score
from docs left join base using (r) left join matched using (r)
"""


@query("op6_license_scan", _license_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.expr("filter(split(base_labels, ','), x -> x <> '')")
    labels = F.array_sort(F.array_distinct(F.concat(base, F.col("matches.label"))))
    best = F.coalesce(F.array_max("matches.contained"), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join(labels, ",").alias("labels"),
        F.greatest(best, F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op11_merkle_manifest", r"""
with recursive given as (
  select doc_id, coalesce('=' || lang, '') as tree, source, lang, n_chars, text,
         (~list_reduce([4294967295::bigint] || list_transform(range(1, len(doc_id::varchar) + 1), lambda i: ascii((doc_id::varchar)[i])::bigint),
            lambda c, b: list_reduce([xor(c, b)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384::bigint)))) & 4294967295 as crc
  from documents),
hashed as (
  select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
            || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head from given),
leaves as (
  select doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
         case when crc % 3 = 0 then sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))
              else sha256(head || coalesce(strlen(text) || ':' || text, '-')) end as now
  from hashed),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as rank from leaves),
grown(tree, level, nodes) as (
  select tree, 0, list(leaf order by rank) from placed group by tree
  union all
  select tree, level + 1, list_transform(range((len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[i * 8 + 1:i * 8 + 8], ''))) from grown where len(nodes) > 1),
subroots as (select tree, nodes[1] as subroot, row_number() over (order by tree) - 1 as rank from grown where len(nodes) = 1),
above(level, nodes) as (
  select 0, list(subroot order by rank) from subroots
  union all
  select level + 1, list_transform(range((len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[i * 8 + 1:i * 8 + 8], ''))) from above where len(nodes) > 1),
top as (select nodes[1] as root from above where len(nodes) = 1),
heights as (select tree, max(level) as height from grown group by tree),
runs as (
  select p.doc_id, p.leaf, p.now, p.tree, g.level as step, nodes[(rank >> (3 * level)) // 8 * 8 + 1:(rank >> (3 * level)) // 8 * 8 + 8] as run, (rank >> (3 * level)) % 8 as spot
  from placed p join grown g using (tree) where len(nodes) > 1
  union all
  select p.doc_id, p.leaf, p.now, p.tree, height + a.level, nodes[(s.rank >> (3 * a.level)) // 8 * 8 + 1:(s.rank >> (3 * a.level)) // 8 * 8 + 8], (s.rank >> (3 * a.level)) % 8
  from placed p join subroots s using (tree) join heights using (tree), above a where len(nodes) > 1),
paths as (
  select doc_id, leaf, now, tree, list({'l': array_to_string(run[1:spot], ''), 'r': array_to_string(run[spot + 2:8], '')} order by step) as path from runs group by all)
select p.doc_id, p.leaf, subroot, root, sha256(array_to_string(list_transform(coalesce(path, []), lambda s: s.l || s.r), '')) as proof_sha256,
       list_reduce([p.now] || list_transform(coalesce(path, []), lambda s: s.l || '|' || s.r), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) as folded_root,
       list_reduce([p.now] || list_transform(coalesce(path, []), lambda s: s.l || '|' || s.r), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) = root as verified
from placed p join subroots using (tree), top left join paths x on x.doc_id is not distinct from p.doc_id and x.leaf = p.leaf and x.tree = p.tree
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_manifest(table(spark, sf_dir, "documents"))


@query("op12_warc_archive", """
select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
       case when strlen(coalesce(html, '')) >= 1000 and page_id < max(page_id) over same then 'revisit' else 'response' end as record_type,
       case when strlen(coalesce(html, '')) >= 1000 and page_id < max(page_id) over same then max(page_id) over same end as refers_to
from pages window same as (partition by coalesce(html, ''))
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_phrase_collocations", r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) as piece from documents),
worded as (select lang, regexp_extract_all(piece, '[^ 	]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from worded group by lang),
grams as (
  select lang, k, phrase, count(*) as f
  from (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from worded, range(1, 6) as lengths(k) where len(w) >= k)
  group by all having count(*) >= 100),
longer as (
  select lang, phrase, max(f) as f
  from (select lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:k - 1], ' '), array_to_string(string_split(phrase, ' ')[2:k], ' ')]) as phrase from grams where k > 2) group by all),
kept as (select g.* from grams g left join longer o using (lang, phrase) where k >= 2 and (o.f is null or o.f < g.f)),
cuts as (
  select c.lang, c.phrase, c.f as a, cut, l.f as l, r.f as r, n, (1000::hugeint * c.f * n // (l.f::hugeint * r.f))::bigint as score
  from (select *, unnest(range(1, k)) as cut from kept) c
  join grams l on l.lang = c.lang and l.phrase = array_to_string(string_split(c.phrase, ' ')[1:cut], ' ')
  join grams r on r.lang = c.lang and r.phrase = array_to_string(string_split(c.phrase, ' ')[cut + 1:], ' ')
  join totals t on t.lang = c.lang),
weakest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from weakest qualify rank <= 2000
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
