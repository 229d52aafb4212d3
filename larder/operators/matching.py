"""Rule and additive matching over ingredient texts."""

from __future__ import annotations

import hashlib
import os
import pickle
import re
import tempfile
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import ids
from larder.functions.udfs import fold_text, fold_with_offsets

ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
MATCH_SCHEMA = "doc_id string, alias_id string, start int, end int, span string, match_kind string"
# Outcomes that make a finding material, and states that need a new look at the text.
MATERIAL = ["prohibited-candidate", "ambiguous-review-required", "acceptable-with-evidence"]
UNSAFE_STATES = ["stale", "date-unknown", "changed-unreviewed"]


def additive_id(value: Column) -> Column:
    """Canonical ``E###x(roman)`` of a free-form additive number, else null."""
    shape = r"\A\s*[Ee]\s*([0-9]{3,4})\s*([A-Za-z])?\s*(?:\(\s*([IVXivx]+)\s*\))?\s*\z"
    digits, letter, roman = (F.regexp_extract(value, shape, g) for g in (1, 2, 3))
    text = F.concat(F.lit("E"), digits, F.lower(letter), F.when(roman != "", F.concat(F.lit("("), F.lower(roman), F.lit(")"))).otherwise(""))
    return F.when(digits != "", text)


def folded_texts(texts: DataFrame) -> DataFrame:
    """Texts with their folded form and its offsets into the source."""
    return texts.withColumn("f", fold_text("text")).select("*", "f.norm", "f.offsets").drop("f")


class Matcher:
    """All aliases in one automaton, so a text is read once however many aliases there are.

    Both texts and aliases are folded, with single spaces, so an alias stands in a text letter by letter.
    But for kind ``anywhere`` a match must not touch an ASCII letter or digit on either side; a
    ``token-prefix`` takes the rest of its run of these along; an E-number may have a gap after its E.
    """

    def __init__(self, rows: Iterable[tuple[str, str, str, str]]) -> None:
        self.languages: set[str] = set()
        entries: dict[str, list[tuple[str, str, str]]] = {}
        for alias_id, language, alias, kind in rows:
            folded, _ = fold_with_offsets(alias or "")
            if not folded:
                continue
            language = (language or "").casefold()
            self.languages.add(language)
            if kind == "e-number":
                digits = "".join(c for c in folded if c.isdigit())
                forms = (f"e{digits}", f"e {digits}") if digits else ("e",)
            else:
                forms = (folded,)
            for form in forms:
                entries.setdefault(form, []).append((alias_id, language, kind))
        self.automaton = ahocorasick.Automaton()
        for form, those in entries.items():
            self.automaton.add_word(form, (len(form), those))
        if entries:
            self.automaton.make_automaton()
        self.empty = not entries

    def find(self, norm: str, language: str) -> Iterator[tuple[str, str, int, int]]:
        """(alias_id, kind, start, end) of the aliases of a language and of ``und``; but for ``anywhere`` those of one alias do not overlap."""
        if self.empty:
            return
        own = {"und", language} if language in self.languages else {"und"}
        found = []
        for last, (width, those) in self.automaton.iter(norm):
            start, end = last + 1 - width, last + 1
            free = start == 0 or norm[start - 1] not in ALNUM
            closed = end == len(norm) or norm[end] not in ALNUM
            run_end = end
            for alias_id, of, kind in those:
                if of not in own:
                    continue
                if kind == "anywhere":
                    yield alias_id, kind, start, end
                elif free and kind == "token-prefix":
                    while run_end < len(norm) and norm[run_end] in ALNUM:
                        run_end += 1
                    found.append((start, run_end, alias_id, kind))
                elif free and closed:
                    found.append((start, end, alias_id, kind))
        ends: dict[str, int] = {}
        for start, end, alias_id, kind in sorted(found):
            if start >= ends.get(alias_id, 0):
                ends[alias_id] = end
                yield alias_id, kind, start, end


class Shipped:
    """Rows that every task needs, as a file that Spark hands to each node once, not as part of each task."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        raw = pickle.dumps(value)
        self.name = f"larder-rules-{hashlib.sha256(raw).hexdigest()[:16]}.pickle"
        path = os.path.join(tempfile.mkdtemp(prefix="larder-rules-"), self.name)  # the driver's own; Spark copies it from here
        with open(path, "wb") as out:
            out.write(raw)
        spark.sparkContext.addFile(path)

    def load(self) -> object:
        with open(SparkFiles.get(self.name), "rb") as raw:
            return pickle.load(raw)


def _shipped(df: DataFrame, columns: list[str]) -> Shipped:
    """The distinct rows of a reviewed list of aliases or codes, read on the driver in Arrow form."""
    table = df.select(*columns).distinct().toArrow()
    return Shipped(df.sparkSession, sorted(zip(*(table.column(c).to_pylist() for c in columns)), key=repr))


def spread(texts: DataFrame) -> DataFrame:
    """Texts dealt evenly over as many tasks as a shuffle has: a file's blocks say nothing of the work in front of Python."""
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def match_rules(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every occurrence of every alias: texts (doc_id, text, language), aliases (alias_id, language, alias, match).

    An alias applies to its language or, as ``und``, to all. Spans point into the source text. One pass
    over the texts, whatever the number of aliases.
    """
    rules = _shipped(aliases, ["alias_id", "language", "alias", "match"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(rules.load())
        for batch in batches:
            out = []
            for doc, source, language in zip(batch.doc_id, batch.text, batch.language):
                norm, at = fold_with_offsets(source)
                base = (language or "").split("-")[0].casefold()
                for alias, kind, start, end in matcher.find(norm, base):
                    first, last = int(at[start]), int(at[end - 1]) + 1
                    out.append((doc, alias, first, last, source[first:last], kind))
            yield pd.DataFrame(out, columns=["doc_id", "alias_id", "start", "end", "span", "match_kind"])

    rows = spread(texts.select("doc_id", "text", "language").filter("text is not null"))
    return rows.mapInPandas(scan, MATCH_SCHEMA)


def drop_overlapping(matches: DataFrame, excluded: DataFrame, width: int = 64) -> DataFrame:
    """Matches that touch no excluded span of the same document and rule.

    Both sides are cut into bins of the text, so the join key stays small even when one document or
    rule holds most spans, and only spans of one bin meet. Empty spans are not expected.
    """
    bins = lambda df: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    spans = ["doc_id", "rule_id", "start", "end"]
    x = bins(excluded.select("doc_id", "rule_id", F.col("start").alias("start"), F.col("end").alias("end")).distinct())
    x = x.select("doc_id", "rule_id", "_bin", F.col("start").alias("_xs"), F.col("end").alias("_xe"))
    m = bins(matches.select(*spans).distinct())
    near = [m[k] == x[k] for k in ("doc_id", "rule_id", "_bin")]
    hit = m.join(x, [*near, (F.col("start") < F.col("_xe")) & (F.col("_xs") < F.col("end"))], "left_semi")
    return matches.join(hit.select(*spans).distinct(), spans, "left_anti")


def _joined_up(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the places that the spans cover, ascending and apart from each other."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def rule_findings(texts: DataFrame, aliases: DataFrame, contexts: DataFrame) -> DataFrame:
    """Distinct findings (doc_id, start, end, span, match_kind, rule_id, outcome, queue, reason_code).

    ``contexts`` (alias_id, rule_id, language, alias) are phrases that excuse a hit they overlap,
    wherever their letters stand, inside words too. Both are looked for in one pass over the texts, and
    a text's hits meet its excuses in that pass, so only findings are shuffled, once.
    """
    rules = aliases.select("alias_id", "rule_id", "outcome", "queue", "reason_code")
    tagged = aliases.select(F.concat(F.lit("hit:"), "alias_id").alias("alias_id"), "language", "alias", "match", "rule_id").unionByName(
        contexts.select(F.concat(F.lit("not:"), "alias_id").alias("alias_id"), "language", "alias", F.lit("anywhere").alias("match"), "rule_id")
    )
    listed = _shipped(tagged.filter("alias_id is not null"), ["alias_id", "language", "alias", "match", "rule_id"])
    columns = ["doc_id", "alias_id", "rule_id", "start", "end", "span", "match_kind"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries = listed.load()
        matcher = Matcher(sorted({e[:4] for e in entries}, key=repr))
        rule_ids: dict[str, set] = {}
        for alias, *_, rule in entries:
            rule_ids.setdefault(alias, set()).add(rule)
        for batch in batches:
            out = []
            for doc, source, language in zip(batch.doc_id, batch.text, batch.language):
                norm, at = fold_with_offsets(source)
                base = (language or "").split("-")[0].casefold()
                hits, excused = set(), {}
                for alias, kind, start, end in matcher.find(norm, base):
                    first, last = int(at[start]), int(at[end - 1]) + 1
                    for rule in rule_ids[alias]:
                        if alias.startswith("hit:"):
                            hits.add((alias[4:], rule, first, last, kind))
                        elif rule is not None:
                            excused.setdefault(rule, []).append((first, last))
                places = {rule: _joined_up(spans) for rule, spans in excused.items()}
                for alias, rule, first, last, kind in hits:
                    starts, ends = places.get(rule, ((), ()))
                    before = bisect_left(starts, last)
                    if not before or ends[before - 1] <= first:
                        out.append((doc, alias, rule, first, last, source[first:last], kind))
            yield pd.DataFrame(out, columns=columns)

    rows = spread(texts.select("doc_id", "text", "language").filter("text is not null"))
    found = rows.mapInPandas(scan, "doc_id string, alias_id string, rule_id string, start int, end int, span string, match_kind string")
    # The rules are the list that was read for the scan; found rows, whose number Spark can't guess, must not be the side that is copied.
    same = (found.alias_id == rules.alias_id) & found.rule_id.eqNullSafe(rules.rule_id)
    named = found.join(F.broadcast(rules), same).drop(rules.alias_id, rules.rule_id)
    return named.select("doc_id", "start", "end", "span", "match_kind", "rule_id", "outcome", "queue", "reason_code").distinct()


def match_additives(texts: DataFrame, additives: DataFrame, names: DataFrame, named: bool = False) -> DataFrame:
    """All additive mentions: E-numbers in the raw text, names in the folded text of the text's language.

    With ``named`` a column ``name_id`` tells which name was found, null for an E-number.
    """
    wanted = additives.filter("status <> 'removed'").select(F.col("additive_id").alias("alias_id"))
    listed = _shipped(wanted, ["alias_id"])
    numbers = [
        re.compile(
            rf"(?<![a-z0-9])e\s*((?:\d\s*){{{width - 1}}}\d)(?:\s*([a-z]))?(?:\s*\(\s*([ivx](?:\s*[ivx])*)\s*\))?",
            re.IGNORECASE | re.ASCII,
        )
        for width in (3, 4)
    ]
    token = re.compile(r"[A-Za-z0-9]")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = {code for (code,) in listed.load()}
        for batch in batches:
            out = []
            for doc, source in zip(batch.doc_id, batch.text):
                for m in (hit for number in numbers for hit in number.finditer(source)):
                    digits, letter, roman = ("".join((g or "").split()).lower() for g in m.groups())
                    # Longest form first; each optional part may be absent from the reference entry.
                    for end, code in (
                        (m.end(), f"E{digits}{letter}({roman})" if roman else f"E{digits}{letter}"),
                        (m.end(2) if letter else m.end(1), f"E{digits}{letter}"),
                        (m.end(1), f"E{digits}"),
                    ):
                        stop = m.start() + len(source[m.start() : end].rstrip())
                        if code in codes and not token.match(source[stop : stop + 1]):
                            out.append((doc, code, m.start(), stop, source[m.start() : stop], "e-number"))
            yield pd.DataFrame(out, columns=["doc_id", "alias_id", "start", "end", "span", "match_kind"]).drop_duplicates()

    by_number = spread(texts.select("doc_id", "text").filter("text is not null")).mapInPandas(scan, MATCH_SCHEMA)
    live = names.join(wanted.withColumnRenamed("alias_id", "additive_id"), "additive_id", "left_semi")
    by_name = match_rules(texts, live.withColumn("match", F.lit("phrase")))
    # The names are the list that was read for the scan; matches, whose number Spark can't guess, must not be the side that is copied.
    by_name = by_name.join(F.broadcast(live.select("alias_id", "additive_id")), "alias_id").withColumnRenamed("alias_id", "name_id").withColumn("match_kind", F.lit("name"))
    found = by_number.withColumnRenamed("alias_id", "additive_id").withColumn("name_id", F.lit(None).cast("string")).unionByName(by_name)
    return (found if named else found.drop("name_id")).distinct()


def first_additives(mentions: DataFrame) -> DataFrame:
    """One mention of each additive and text, as a device shows it: the first E-number, else the first place of the first of its names.

    ``mentions`` come from ``match_additives`` with ``named``; names are in order of their ids. An
    aggregate by text and additive, so a text with many mentions shrinks inside the tasks.
    """
    order = F.struct((F.col("match_kind") != "e-number").alias("by_name"), F.col("name_id").alias("name_id"), F.col("start").alias("start"), F.col("end").alias("end"), F.col("span").alias("span"), F.col("match_kind").alias("match_kind"))
    first = mentions.groupBy("doc_id", "additive_id").agg(F.min(order).alias("m"))
    return first.select("doc_id", "additive_id", "m.start", "m.end", "m.span", "m.match_kind")


def methodology_report(facts: DataFrame, found: DataFrame) -> DataFrame:
    """Per selection its parser status, safety flags and review queues with reasons.

    Findings are first reduced to one row per text, queue and reason, so a text with millions of hits
    does not grow the report; no verdict is given, only work for reviewers.
    """
    c = F.col
    per_text = found.groupBy("doc_id").agg(
        F.count("*").alias("findings"),
        F.count_if(c("outcome").isin(*MATERIAL)).alias("material"),
        F.count_if(c("outcome") == "prohibited-candidate").alias("prohibited"),
        F.collect_set(
            F.when(c("outcome") != "informational", F.struct(c("queue"), c("reason_code").alias("reason")))
        ).alias("rule_queues"),
    )
    joined = facts.join(per_text, facts.ingredient_id == per_text.doc_id, "left")
    has, state = c("has_text"), c("formulation_state")
    unverified = has & ((c("capture_method") == "ocr") | (c("verification_state") != "human-verified"))
    transformed = has & c("transformation_percent").isNotNull()
    changed = has & c("ing_supersedes").isNotNull()
    flagged = has & c("flagged")
    unsafe = has & state.isin(*UNSAFE_STATES)
    queue = lambda when, name, reason: F.when(when, F.struct(F.lit(name).alias("queue"), reason.alias("reason")))
    state_reason = F.concat(F.lit("formulation-"), state)
    own = F.array_compact(
        F.array(
            queue(changed, "new-changed-formulation", F.lit("formulation-changed")),
            queue(flagged, "conflicting-formulation", F.lit("formulation-conflict")),
            queue(unverified, "package-text-verification", F.lit("package-text-verification-required")),
            queue(transformed, "package-text-verification", F.lit("transformed-text-requires-verification")),
            queue(unsafe, "new-changed-formulation", state_reason),
        )
    )
    queues = F.concat(own, F.coalesce("rule_queues", F.array().cast("array<struct<queue:string,reason:string>>")))
    calm = has & (F.size(queues) == 0) & (F.coalesce("findings", F.lit(0)) == 0) & state.isin("fresh", "refresh-recommended")
    queues = F.when(calm, F.array(F.struct(F.lit("positive-ingredient-review").alias("queue"), F.lit("no-parser-candidate-human-review-required").alias("reason")))).otherwise(queues)
    flags = F.array_compact(
        F.array(
            F.when(~has, "ingredients-missing"), F.when(changed, "formulation-changed"), F.when(flagged, "formulation-conflict"),
            F.when(unverified, "package-text-verification-required"), F.when(transformed, "transformed-text-requires-verification"),
            F.when(has & (unsafe | (state == "refresh-recommended")), state_reason),
        )
    )
    questionable = has & ((F.coalesce("material", F.lit(0)) > 0) | flagged | unverified | transformed)
    report = joined.select(
        "selection_id", "gtin", "market", "ingredient_id", state.alias("freshness_state"),
        F.when(questionable, "questionable").otherwise("unknown").alias("parser_status"),
        F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("prohibited", F.lit(0)).alias("prohibited"),
        F.array_sort(flags).alias("safety_flags"),
        F.array_sort(F.array_distinct(queues)).alias("queues"),
    )
    fields = {
        "gtin": c("gtin"), "market": c("market"), "ingredientObservationID": c("ingredient_id"), "parserStatus": c("parser_status"),
        "freshnessState": c("freshness_state"), "findings": c("findings"), "safetyFlags": c("safety_flags"), "reviewQueues": c("queues"),
    }
    return report.withColumn("digest", F.sha2(ids.canonical_json(fields), 256))


def report_totals(report: DataFrame) -> DataFrame:
    """(metric, key, n): products by parser status, review queue and safety flag."""
    cell = lambda metric, key: F.struct(F.lit(metric).alias("metric"), key.alias("key"))
    cells = F.concat(
        F.array(cell("parser-status", F.col("parser_status"))),
        F.transform(F.array_distinct(F.transform("queues", lambda q: q["queue"])), lambda q: cell("queue", q)),
        F.transform("safety_flags", lambda f: cell("safety-flag", f)),
    )
    return report.select(F.inline(cells)).groupBy("metric", "key").agg(F.count("*").alias("n"))


def stale_analysis(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored analyses that no longer follow from the evidence: (selection_id, problem)."""
    both = stored.select("selection_id", F.col("digest").alias("stored_digest"), F.col("own_digest")).join(
        current.select("selection_id", "digest"), "selection_id", "full"
    )
    problem = (
        F.when(F.col("stored_digest").isNull(), "not-analyzed")
        .when(F.col("digest").isNull(), "no-current-evidence")
        .when(F.col("own_digest") != F.col("stored_digest"), "digest-broken")
        .when(F.col("digest") != F.col("stored_digest"), "evidence-changed")
    )
    return both.withColumn("problem", problem).filter("problem is not null").select("selection_id", "problem")
