import random
import re

from pyspark.sql import functions as F

from larder.functions.udfs import fold_with_offsets
from larder.operators import matching as M

ALIASES = [
    ("a1", "r1", "en", "pork", "token"), ("a2", "r1", "en", "pork fat", "phrase"), ("a3", "r2", "de", "schwein", "token-prefix"),
    ("a4", "r3", "und", "E 120", "e-number"), ("a5", "r2", "de", "käse", "token"), ("a6", "r4", "und", "a a", "phrase"),
]
WORDS = ["pork", "fat", "Pork", "schweinefett", "Schwein", "E120", "e 120", "E1200", "Käse", "kase", "a", "xpork", "und,", "(Salz)", "ß"]


def texts(seed, n=60):
    rng = random.Random(seed)
    return [(f"d{i}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))), rng.choice(["en", "de", "de-AT", "fr"])) for i in range(n)]


def brute(rows, aliases):
    out = set()
    for doc, source, language in rows:
        norm, at = fold_with_offsets(source)
        for alias, _, lang, word, kind in aliases:
            if lang not in ("und", language.split("-")[0]):
                continue
            folded = fold_with_offsets(word)[0]
            body = r"e\s*" + re.sub(r"\D", "", folded) if kind == "e-number" else r"\s+".join(map(re.escape, folded.split()))
            body += "[a-z0-9]*" if kind == "token-prefix" else ""
            for m in re.finditer(rf"(?<![a-z0-9]){body}(?![a-z0-9])", norm):
                out.add((doc, alias, int(at[m.start()]), int(at[m.end() - 1]) + 1))
    return out


def test_rule_matches_equal_a_scan_with_every_pattern(spark):
    rows = texts(1)
    df = spark.createDataFrame(rows, "doc_id string, text string, language string").repartition(5)
    aliases = spark.createDataFrame(ALIASES, "alias_id string, rule_id string, language string, alias string, match string")
    got = {(r.doc_id, r.alias_id, r.start, r.end) for r in M.match_rules(df, aliases).collect()}
    assert got == brute(rows, ALIASES) and got


def test_any_number_of_rules_is_one_pass(spark):
    rows = texts(2)
    many = ALIASES + [(f"m{i}", "r1", "und", f"word{i} e{i}", "phrase") for i in range(5000)] + [("none", "r1", "en", " - ", "token")]
    df = spark.createDataFrame(rows + [("hit", "x word77 E77. word4999-e4999", "fr"), ("nothing", "", "en"), ("null", None, None)], "doc_id string, text string, language string")
    aliases = spark.createDataFrame(many, "alias_id string, rule_id string, language string, alias string, match string")
    found = M.match_rules(df, aliases)
    got = {(r.doc_id, r.alias_id, r.start, r.end) for r in found.collect()}
    assert got == brute(rows, ALIASES) | {("hit", "m77", 2, 12), ("hit", "m4999", 14, 28)}


def test_matches_beside_other_scripts_and_inside_words(spark):
    rows = [("1", "жpork pork東 sporkp", "en"), ("2", "porkpork a a a", "de"), ("3", "Schweinefleisch schweine-fett", "de")]
    df = spark.createDataFrame(rows, "doc_id string, text string, language string")
    aliases = ALIASES + [("any", "r9", "und", "pork", "anywhere"), ("zz", "r9", "en", "東", "token")]
    frame = spark.createDataFrame(aliases, "alias_id string, rule_id string, language string, alias string, match string")
    got = {(r.doc_id, r.alias_id, r.start, r.end) for r in M.match_rules(df, frame).collect()}
    anywhere = {("1", "any", 1, 5), ("1", "any", 6, 10), ("1", "any", 13, 17), ("2", "any", 0, 4), ("2", "any", 4, 8)}
    assert {g for g in got if g[1] == "any"} == anywhere
    assert {g for g in got if g[1] != "any"} == brute(rows, [a for a in aliases if a[4] != "anywhere"])


def test_first_mention_of_an_additive(spark):
    docs = [("1", "acid, E 330 and E330", "en"), ("2", "sour acid acid", "en"), ("3", "nothing", "en")]
    df = spark.createDataFrame(docs, "doc_id string, text string, language string")
    additives = spark.createDataFrame([("E330", "active")], "additive_id string, status string")
    names = spark.createDataFrame([("n2", "E330", "en", "sour"), ("n1", "E330", "en", "acid")], "alias_id string, additive_id string, language string, alias string")
    got = sorted((r.doc_id, r.additive_id, r.start, r.span, r.match_kind) for r in M.first_additives(M.match_additives(df, additives, names, named=True)).collect())
    assert got == [("1", "E330", 6, "E 330", "e-number"), ("2", "E330", 5, "acid", "name")]


def test_overlap_exclusion_equals_pairwise_check(spark):
    rng = random.Random(3)
    span = lambda: ("d", f"r{rng.randint(0, 1)}", (s := rng.randint(0, 300)), s + rng.randint(1, 90))
    matches, excluded = [span() for _ in range(80)], [span() for _ in range(15)]
    ddl = "doc_id string, rule_id string, start int, end int"
    got = M.drop_overlapping(spark.createDataFrame(matches, ddl), spark.createDataFrame(excluded, ddl))
    want = sorted(m for m in matches if not any(m[1] == x[1] and m[2] < x[3] and x[2] < m[3] for x in excluded))
    assert sorted(tuple(r[c] for c in ("doc_id", "rule_id", "start", "end")) for r in got.collect()) == want


def test_additive_forms(spark):
    docs = [("1", "E330, e 3 3 0 and E330a; E1422 E500 (ii) Acid", "en"), ("2", "XE330 E3301", "en")]
    df = spark.createDataFrame(docs, "doc_id string, text string, language string")
    additives = spark.createDataFrame([("E330", "active"), ("E500(ii)", "active"), ("E1422", "removed")], "additive_id string, status string")
    names = spark.createDataFrame([("n1", "E330", "en", "acid")], "alias_id string, additive_id string, language string, alias string")
    got = sorted((r.doc_id, r.additive_id, r.span, r.match_kind) for r in M.match_additives(df, additives, names).collect())
    assert got == [("1", "E330", "Acid", "name"), ("1", "E330", "E330", "e-number"), ("1", "E330", "e 3 3 0", "e-number"), ("1", "E500(ii)", "E500 (ii)", "e-number")]


def test_excused_hits_are_dropped_in_the_scan_and_findings_shuffled_once(spark):
    df = spark.createDataFrame(texts(7, 80), "doc_id string, text string, language string")
    aliases = spark.createDataFrame([(*a, "o", "q", "c") for a in ALIASES], "alias_id string, rule_id string, language string, alias string, match string, outcome string, queue string, reason_code string")
    contexts = spark.createDataFrame([("c1", "r1", "und", "pork fat"), ("c2", "r3", "en", "xpork e")], "alias_id string, rule_id string, language string, alias string")
    found = M.rule_findings(df, aliases, contexts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "checkpoint" not in plan
    every = lambda a, kind=None: a.select("alias_id", "language", "alias", *([F.lit(kind).alias("match")] if kind else ["match"]))
    hits = M.match_rules(df, every(aliases)).join(aliases.select("alias_id", "rule_id", "outcome", "queue", "reason_code"), "alias_id")
    excused = M.match_rules(df, every(contexts, "anywhere")).join(contexts.select("alias_id", "rule_id"), "alias_id")
    want = M.drop_overlapping(hits, excused).select(*found.columns).distinct()
    assert 0 < want.count() < hits.select(*found.columns).distinct().count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_additive_matches_are_not_the_copied_side_of_a_join(spark):
    df = spark.createDataFrame([("1", "acid", "en")], "doc_id string, text string, language string")
    additives = spark.createDataFrame([("E330", "active")], "additive_id string, status string")
    names = spark.createDataFrame([("n1", "E330", "en", "acid")], "alias_id string, additive_id string, language string, alias string")
    plan = M.match_additives(df, additives, names)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin .*Inner, BuildRight", plan) and not re.search(r"SortMergeJoin .*Inner", plan)
