"""Secret scan with corpus-wide ownership of every candidate."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.store import stored, text_key


class Kind(NamedTuple):
    """Leftmost non-overlapping matches of ``pattern``; group ``value`` is the secret and must have ``least`` characters.

    With ``apart`` a match must not follow a character of that class: long runs then have one start to try,
    so the search is linear whatever the text.
    """

    name: str
    pattern: str
    value: int
    least: int
    base: bool
    apart: str = ""

    @property
    def search(self) -> str:
        return f"(?<![{self.apart}]){self.pattern}" if self.apart else self.pattern


# The base kinds in their order. A greedy run is as long as it can be, so for access and
# hex asking for the least length inside the pattern finds the same matches as dropping short ones.
_ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE = (Kind("assign", _ASSIGN, 2, 6, True), Kind("access", "AKIA[A-Z0-9]{16,}", 0, 20, True), Kind("hex", "[0-9a-f]{24,}", 0, 24, True))
# Spans of the method itself.
MORE = (
    Kind("hosted", r"(gh[pousr]_|glpat-|xox[abpr]-)[A-Za-z0-9_-]{16,}", 0, 20, False),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28, False, "A-Za-z0-9_-"),
    Kind("url", r"[a-z][a-z0-9+.-]*://[^\x20/:@\x09-\x0D]+:([^\x20/:@\x09-\x0D]{6,})@", 1, 6, False, "a-z0-9+.-"),
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x0A\x0D]+-----END", 0, 60, False),
)
OWNERS, REPOSITORIES = 2, 3  # so many that hold a value in different texts make it an example
# What a text must hold for a kind to match at all: a cheap search that spares most texts the splits.
_HINT = {"jwt": "eyJ", "url": "://", "pem": "PRIVATE KEY-----"}


def _matches(body: Column, rank: int, kind: Kind) -> Column:
    """Array of (rank, i, gap, length, value): each match with the length of the text since the one before."""
    pieces = F.split(body, kind.search, -1)
    matches = F.regexp_extract_all(body, F.lit(kind.search), F.lit(0))
    values = F.regexp_extract_all(body, F.lit(kind.search), F.lit(kind.value)) if kind.value else matches
    rows = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("gap"), matches.alias("match"), values.alias("value"))
    listed = F.transform(rows, lambda r, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.length(r["gap"]).alias("gap"), F.length(r["match"]).alias("length"), r["value"].alias("value")))
    return F.when(body.rlike(_HINT.get(kind.name, kind.search)), listed).otherwise(F.array().cast("array<struct<rank:int,i:int,gap:int,length:int,value:string>>"))


def candidates(docs: DataFrame, owner: Column, repository: Column, doc_id: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = BASE + MORE) -> DataFrame:
    """doc_id, doc_key, owner, repository, start, rank, kind, end, base, value_key: one row per match, the secret itself as a digest only."""
    body = F.col("body")
    rows = docs.select(F.col(doc_id).alias("doc_id"), owner.alias("owner"), repository.alias("repository"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    hint = F.lit(False)
    for kind in kinds:
        hint = hint | body.rlike(_HINT.get(kind.name, kind.search))
    numbered = rows.filter(hint).withColumn("row", F.monotonically_increasing_id())
    listed = numbered.select(
        "doc_id", text_key(body).alias("doc_key"), "owner", "repository", "row",
        F.explode(F.concat(*(_matches(body, i, k) for i, k in enumerate(kinds)))).alias("m"),
    ).select("doc_id", "doc_key", "owner", "repository", "row", "m.*")
    # a match ends after all gaps and matches up to it
    end = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("row", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    of = lambda pick: F.element_at(F.array(*(F.lit(pick(k)) for k in kinds)), F.col("rank") + 1)
    return listed.withColumn("end", end).filter(F.length("value") >= of(lambda k: k.least)).select(
        "doc_id", "doc_key", "owner", "repository", (F.col("end") - F.col("length")).alias("start"), "rank", of(lambda k: k.name).alias("kind"), "end",
        of(lambda k: k.base).alias("base"), F.sha2("value", 256).alias("value_key"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """value_key, n_places, n_texts, n_repositories, n_owners: how widely each candidate is copied.

    Owners and repositories are those of distinct texts: a document that was copied whole counts once,
    for the least of its owners and of their repositories. All steps aggregate inside the tasks first,
    so a value in a third of all documents shrinks to its texts, then to its repositories.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    by_text = found.groupBy("value_key", "doc_key").agg(F.count("*").alias("n"), F.min(F.struct(known("owner").alias("owner"), known("repository").alias("repository"))).alias("of"))
    by_repository = by_text.groupBy("value_key", "of.owner", "of.repository").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    by_owner = by_repository.groupBy("value_key", "owner").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"), F.count("*").alias("repositories"))
    return by_owner.groupBy("value_key").agg(
        F.sum("n").alias("n_places"), F.sum("texts").alias("n_texts"), F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners")
    )


def scan_secrets(
    docs: DataFrame, owner: Column, repository: Column, doc_id: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = BASE + MORE, owners: int = OWNERS, repositories: int = REPOSITORIES
) -> DataFrame:
    """Candidates with their ownership and ``verdict``: ``example`` where ``owners`` or more owners, or ``repositories`` or more repositories, have the value in texts that differ, else ``live``.

    Texts are scanned whole (null: empty, no candidate). A null owner or repository is one of its own.
    Repeated rows count as places, not as further texts. An empty table gives no rows.
    """
    found = stored(candidates(docs, owner, repository, doc_id, text, kinds))
    owned = stored(ownership(found))
    wide = (F.col("n_owners") >= owners) | (F.col("n_repositories") >= repositories)
    return found.join(owned, "value_key").withColumn("verdict", F.when(wide, "example").otherwise("live"))


def secret_report(docs: DataFrame, owner: Column, repository: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, digests, all spans, live and example counts.

    Documents that share a doc_id are told apart by their text; rows equal in both get the same result. A null text
    has no spans.
    """
    spans = scan_secrets(docs, owner, repository, doc_id, text)
    # rows equal in id and text repeat their spans: once is enough
    one = spans.dropDuplicates(["doc_id", "doc_key", "rank", "start"])
    listed = F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "base")))
    named = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    per_doc = one.groupBy("doc_id", "doc_key").agg(
        *(F.count(F.when(F.col("kind") == k.name, 1)).alias(f"n_{k.name}") for k in BASE),
        listed.alias("all"),
        F.count(F.when(F.col("verdict") == "live", 1)).alias("n_live"),
        F.count(F.when(F.col("verdict") == "example", 1)).alias("n_example"),
    )
    per_doc = per_doc.select(
        F.col("doc_id").alias("found_id"), "doc_key", *(f"n_{k.name}" for k in BASE), "n_live", "n_example",
        F.array_join(F.transform(F.filter("all", lambda s: s["base"]), named), ",").alias("base_spans"),
        F.array_join(F.transform("all", named), ",").alias("spans"),
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.coalesce(F.col(text), F.lit(""))).alias("doc_key"))
    none = F.lit(0)
    return rows.join(per_doc, (rows.doc_key == per_doc.doc_key) & F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select(
        "doc_id", *(F.coalesce(f"n_{k.name}", none).alias(f"n_{k.name}") for k in BASE),
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_live", none).alias("n_live"), F.coalesce("n_example", none).alias("n_example"),
    )
