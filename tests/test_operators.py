import math
import random

from pyspark.sql import functions as F

from larder.functions.ranking import ordinal_in_group, previous_in_group
from larder.operators import catalog, evidence, library, prices, reference, refresh, search, state


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_ordinals_do_not_depend_on_row_order(spark):
    data = [(f"g{n % 2}", n) for n in range(200)]
    random.Random(0).shuffle(data)
    df = spark.createDataFrame(data, "g string, n int").repartition(7)
    got = rows(ordinal_in_group(df, ["g"], F.floor(F.col("n") / 16), ["n"], "at"), "g", "n", "at")
    assert got == sorted((g, n, n // 2) for g, n in data)


def test_previous_value_crosses_buckets(spark):
    data = [("s", n, n if n % 5 == 0 else None) for n in range(40)]
    df = spark.createDataFrame(data, "s string, n int, v int").repartition(5)
    out = previous_in_group(df, ["s"], F.floor(F.col("n") / 8), ["n"], F.col("v"), "prev")
    got = {r.n: r.prev for r in out.collect()}
    assert got[0] is None
    assert all(got[n] == (n - 1) // 5 * 5 for n in range(1, 40))


def test_conflicting_ids_by_replay(spark):
    rng = random.Random(4)
    data = [(rng.randint(0, 6), line, rng.choice("aab")) for line in range(60)]
    df = spark.createDataFrame(data, "id int, line int, payload string").repartition(6)
    kept, conflict, counts = {}, set(), {"first": 0, "duplicate": 0, "conflict": 0, "conflict-repeat": 0}
    for i, _, p in data:
        if i in conflict:
            counts["conflict-repeat"] += 1
        elif i not in kept:
            kept[i] = p
            counts["first"] += 1
        elif kept[i] == p:
            counts["duplicate"] += 1
        else:
            counts["conflict"] += 1
            conflict.add(i)
            del kept[i]
    d = prices.drop_conflicting_ids(df)
    assert dict(rows(d.counters, "outcome", "n")) == {k: v for k, v in counts.items() if v}
    assert dict(rows(d.kept, "id", "payload")) == kept and {r.id for r in d.conflicts.collect()} == conflict


def test_supersession_chain_cycle_and_breaks(spark):
    data = [("a", "1", None), ("b", "1", "a"), ("c", "1", "b"), ("x", "2", "y"), ("y", "2", "x"), ("z", "2", "y"), ("m", "1", "gone"), ("k", "9", "a")]
    df = spark.createDataFrame([(i, g, "DE", s) for i, g, s in data], "id string, gtin string, market string, supersedes_id string")
    got = {r.id: (r.depth, r.problem) for r in evidence.supersession(df).collect()}
    assert got == {"a": (0, None), "b": (1, None), "c": (2, None), "x": (None, "cycle"), "y": (None, "cycle"), "z": (None, "cycle"),
                   "m": (0, "missing-parent"), "k": (1, "cross-key-parent")}


def test_dataset_digest_ignores_order_but_not_content(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    digest = lambda d: evidence.dataset_digest({"t": d}).first().digest
    assert digest(df) == digest(df.repartition(9).orderBy(F.desc("v"))) != digest(df.filter("id <> 5"))
    assert digest(df.unionByName(df.filter("id = 5"))) != digest(df)


def test_incomplete_snapshot_never_removes(spark):
    cur = spark.createDataFrame([("1", "DE", "h", "h", "s1")], "gtin string, market string, content_hash string, prev_hash string, prev_selection_id string")
    prior = spark.createDataFrame([("1", "DE"), ("2", "DE")], "gtin string, market string")
    assert dict(rows(state.change_summary(cur, prior, False), "change", "n")) == {"unchanged": 1, "not-observed-in-incomplete-snapshot": 1}
    assert dict(rows(state.change_summary(cur, prior, True), "change", "n")) == {"unchanged": 1, "removed": 1}
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    assert rows(evidence.evidence_delta(ids("a", "b"), ids("b", "c"), False), "change", "id") == [("added", "c"), ("unchanged", "b")]


def test_nearest_rank_against_sorting(spark):
    rng = random.Random(5)
    data = [(rng.choice("xy"), round(rng.uniform(0, 50), 2)) for _ in range(300)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    for q in (0.01, 0.5, 0.95, 1.0):
        got = dict(rows(reference.nearest_rank(df, ["g"], "v", q, 3.0), "g", "percentile"))
        for g in "xy":
            values = sorted(v for k, v in data if k == g)
            assert got[g] == values[max(0, math.ceil(q * len(values)) - 1)]


def test_semver_order(spark):
    order = ["1.0.0-1", "1.0.0-2", "1.0.0-11", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0", "1.0.10", "1.2.0"]
    df = spark.createDataFrame([(v,) for v in order[::-1] + ["01.0.0", "x"]], "v string").withColumn("k", reference.version_key(F.col("v")))
    assert [r.v for r in df.filter("k is not null").orderBy("k").collect()] == order


def test_history_keeps_the_newest_only_with_consent(spark):
    scans = spark.createDataFrame([(n, n % 2, f"2024-01-01T00:00:{n:02d}Z") for n in range(20)], "id int, user_id int, scanned_at string")
    settings = spark.createDataFrame([(0, True), (1, False)], "user_id int, history_enabled boolean")
    assert rows(library.retained_history(scans, settings, 3), "id") == [(14,), (16,), (18,)]


def test_fingerprint_ignores_child_order_and_sees_changes(spark):
    p = spark.createDataFrame([("1", "DE", "n")], "gtin string, market string, name string")
    c = spark.createDataFrame([("1", "DE", f"i{n}") for n in range(9)], "gtin string, market string, id string")
    one = lambda kids: library.fingerprints(p, ["name"], kids, ["id"]).first().fingerprint
    assert one(c) == one(c.orderBy(F.desc("id")).repartition(3)) != one(c.filter("id <> 'i3'"))


def test_text_search_needs_every_token_and_pages(spark):
    products = spark.createDataFrame([(f"{n}", f"red bolt {n}" if n % 2 else f"blue bolt {n}", "Acme") for n in range(9)], "gtin string, name string, brand string")
    queries = spark.createDataFrame([("q1", "RED bo", 3, 0), ("q2", "red  bo", 3, 3), ("q3", "green", 3, 0), ("q4", "acme blue", 9, 0)], "query_id string, query string, limit int, offset int")
    page = search.text_search(queries, products, search.postings(products)).collect()
    got = {q: [(r.gtin, r.has_more) for r in sorted(page, key=lambda r: r["rank"]) if r.query_id == q] for q in ("q1", "q2", "q3", "q4")}
    assert got == {"q1": [("1", True), ("3", True), ("5", True)], "q2": [("7", False)], "q3": [], "q4": [(str(n), False) for n in (0, 2, 4, 6, 8)]}


def test_frequent_tokens_cost_a_search_no_row_per_product(spark, monkeypatch):
    """The rare token of a query leads, so only its products are scored for the query, and what the query keeps is unchanged."""
    products = spark.range(3000).select(F.lpad(F.col("id").cast("string"), 14, "0").alias("gtin"), F.when(F.col("id") < 3, "rare bolt").otherwise("bolt").alias("name"), F.lit("acme").alias("brand"))
    queries = spark.createDataFrame([("q1", "acme rare bolt", 9, 0), ("q2", "rare", 2, 0), ("q3", "acme absent", 9, 0)], "query_id string, query string, limit int, offset int")
    sizes = []

    def cut(df):
        if set(df.columns) == {"ask", "gtin", "n_terms", "score"}:
            sizes.append(df.count())
        return df

    monkeypatch.setattr(search, "durable", cut)
    page = search.text_search(queries, products, search.postings(products)).collect()
    assert sizes == [6]
    got = {q: [(int(r.gtin), r.has_more) for r in sorted(page, key=lambda r: r["rank"]) if r.query_id == q] for q in ("q1", "q2", "q3")}
    assert got == {"q1": [(0, False), (1, False), (2, False)], "q2": [(0, True), (1, True)], "q3": []}


def test_later_queue_entry_wins_and_order_holds(spark):
    ddl = "key string, reason string, priority string, market string, gtin string, evidence_id string"
    a = spark.createDataFrame([("k1", "r", "high", "DE", "1", None), ("k2", "r", "low", "DE", "2", None)], ddl)
    b = spark.createDataFrame([("k1", "r", "medium", "DE", "1", "new")], ddl)
    assert [(r.key, r.priority) for r in refresh.merge_queues(a, b, 2).collect()] == [("k1", "medium"), ("k2", "low")]


def test_reconcile_reports_each_field_once(spark):
    ddl = "gtin string, name string"
    out = catalog.reconcile(spark.createDataFrame([("1", "a"), ("2", "b")], ddl), spark.createDataFrame([("1", "A"), ("3", "c")], ddl), ["gtin"], ["name"])
    assert rows(out, "gtin", "field") == [("1", "name"), ("2", "<row>"), ("3", "<row>")]
