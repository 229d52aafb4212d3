import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from conftest_llm import LOWER
from larder.llm import quality

SF = "/root/testdata/sf0.01"


def test_em_finds_accuracies_without_labels():
    rng = np.random.default_rng(1)
    truth = rng.random(40_000) < 0.7
    right = [(0.9, 0.95), (0.7, 0.8), (0.85, 0.6), (0.8, 0.9)]
    votes = np.stack([np.where(rng.random(len(truth)) < np.where(truth, b, a), truth, ~truth) for a, b in right], 1).astype(int)
    votes[rng.random(votes.shape) < 0.3] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    found = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(found.share - 0.7) < 0.03
    assert np.abs(found.accuracy - np.array(right)).max() < 0.05


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.classify(docs, labels.filter("doc_id % 2 = 0")).withColumnsRenamed({"quality": "p", "toxic": "t"})
    held = judged.join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    junk = held.quality == 0
    assert ((held.p < 0.5) == junk).mean() > 0.97
    clean = held[(held.quality == 1) & (held.toxic == 0)]
    assert clean.accepted.mean() > 0.95


def plain_votes(text, given):
    """The votes of one document, counted word by word."""
    spaced = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    plain = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    is_mark = lambda c: "!" <= c <= "~" and not c.isalnum()
    marks = [sum(map(is_mark, w)) for w in spaced]
    size = [len(w.encode()) for w in spaced]
    letters = sum(c.isascii() and c.isalpha() for w in spaced for c in w)
    n = max(len(spaced), 1)
    shares = {
        "symbols": sum(marks) / max(sum(size), 1), "capitals": sum(c.isascii() and c.isupper() for w in spaced for c in w) / max(letters, 1),
        "echo": sum(a == b for a, b in zip(spaced, spaced[1:])) / n, "bare": sum(m == s for m, s in zip(marks, size)) / n, "marks": sum(m >= 2 for m in marks) / n,
    }
    votes = {f"quality_{h.name}": 0 if shares[h.name] >= h.bad else -1 for h in quality.HEURISTICS}
    votes["quality_prose"] = 1 if spaced and all(shares[h.name] < h.good for h in quality.HEURISTICS) else -1
    votes["quality_given"], votes["toxic_given"] = given
    insult, address, threat = ([w in words for w in plain] for words in (quality.INSULTS, quality.ADDRESSES, quality.THREATS))
    beside = lambda i: any(address[max(0, i - quality.NEAR) : i]) or any(address[i + 1 : i + 1 + quality.NEAR])
    insults, threats = sum(insult), sum(threat)
    judged = lambda there, wrong: (1 if wrong else 0) if there else -1
    votes["toxic_insults"] = 1 if insults >= 2 else 0 if not insults and spaced else -1
    votes["toxic_different"] = judged(insults, len({w for w, i in zip(plain, insult) if i}) >= 2)
    votes["toxic_dense"] = judged(insults, insults >= 0.005 * max(len(spaced), 100))
    votes["toxic_addressed"] = judged(insults, any(i and beside(at) for at, i in enumerate(insult)))
    votes["toxic_threats"] = judged(threats, any(t and beside(at) for at, t in enumerate(threat)))
    return votes


def plain_em(votes, counts, given):
    """Expectation-maximisation with loops, silence left out."""
    posterior = [(sum(v == 1 for v in row) + 0.5) / (sum(v >= 0 for v in row) + 1) for row in votes]
    for _ in range(quality.EM_ROUNDS):
        share = (sum(p * c for p, c in zip(posterior, counts)) + 1) / (sum(counts) + 2)
        table = []
        for j in range(len(votes[0])):
            says = [[0.1 + sum(c * (p if label else 1 - p) for row, p, c in zip(votes, posterior, counts) if row[j] == vote) for vote in (0, 1)] + [0.1] for label in (0, 1)]
            says = [[x / sum(row) for x in row] for row in says]
            table.append([[quality.GIVEN_RIGHT, 1 - quality.GIVEN_RIGHT], [1 - quality.GIVEN_RIGHT, quality.GIVEN_RIGHT]] if j == given else says)
        odds = [math.log(share / (1 - share)) + sum(math.log(table[j][1][v] / table[j][0][v]) for j, v in enumerate(row) if v >= 0) for row in votes]
        posterior = [1 / (1 + math.exp(-x)) for x in odds]
    return share, posterior


def test_votes_and_their_posteriors_equal_plain_python(make, labels):
    rng = random.Random(9)
    words = ["the", "House", "stands!!", "near", "##", "Idiot", "you", "stupid", "kill", "du", "dumm", "é", "a.b", "THE", "the"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(120)] + [(500, None), (501, ""), (502, "you " * 5000 + "loser")]
    given = [(i, rng.choice([0, 1]), rng.choice([0, 1])) for i in range(0, 120, 3)]
    by_id = {i: (q, t) for i, q, t in given}
    votes, found, names = quality.weak_labels(make(*docs), labels(*given))
    got = {r.doc_id: r.asDict() for r in votes.collect()}
    want = {d: plain_votes(t, by_id.get(d, (-1, -1))) for d, t in docs}
    assert all({c: got[d][c] for c in want[d]} == want[d] for d in want)
    patterns = Counter(tuple(want[d][c] for c in names["toxic"]) for d in want)
    share, posterior = plain_em(list(patterns), list(patterns.values()), names["toxic"].index("toxic_given"))
    state = found["toxic"].all
    assert abs(state.share - share) < 1e-6 and np.abs(state.posterior(np.array(list(patterns))) - posterior).max() < 1e-6


def prose(rng, n):
    return " ".join(rng.choice(["the", "house", "stands", "near", "a", "river", "and", "people", "walk", "there"]) for _ in range(n)) + "."


def test_edge_rows_and_missing_labels(make, labels):
    rng = random.Random(2)
    docs = [(i, prose(rng, 40)) for i in range(150)] + [(200 + i, "BUY!! NOW!! " * 20) for i in range(40)] + [(300, None), (301, ""), (None, prose(rng, 30)), (5, prose(rng, 20)), (302, "word " * 60_000)]
    for given in ([], [(1, 1, 0), (1, None, None), (200, 0, 0), (999, 0, 1), (None, 1, 1), (3, 7, 9)]):
        got = quality.classify(make(*docs), labels(*given)).collect()
        assert len(got) == len(docs)
        accepted = {r.doc_id: r.accepted for r in got}
        assert all(accepted[i] for i in range(6, 150)) and not any(accepted[200 + i] for i in range(40))


@pytest.mark.parametrize("given", [[], [(i, 1, 0) for i in range(0, 1000, 100)] + [(2000, 1, 1)]], ids=["no labels", "1 % labels"])
def test_clean_texts_pass_with_few_labels_and_many_insults(make, labels, given):
    rng = random.Random(2)
    docs = [(i, prose(rng, 40)[:-1] + f" n{i}.") for i in range(1000)] + [(2000 + i, prose(rng, 30)[:-1] + f" you stupid idiot n{i}.") for i in range(60)]
    got = quality.classify(make(*docs), labels(*given)).toPandas()
    insulting = got.doc_id >= 2000
    assert got.accepted[~insulting].mean() > 0.9 and (got.toxic[insulting] >= 0.5).all()


def test_labelled_texts_come_first_into_the_sample(make, labels):
    rng = random.Random(4)
    docs = [(i, prose(rng, 30)) for i in range(1000)] + [(1000 + i, prose(rng, 30) + " grubnik") for i in range(15)]
    given = [(i, 1, 0) for i in range(60)] + [(1000 + i, 1, 1) for i in range(15)]
    scorer, _ = quality.fit_scorer(make(*docs), labels(*given), texts=75)
    names, weights, _ = scorer.models[1]
    assert (names < quality.SPACE).any() and weights[names < quality.SPACE].max() > 0.5


def test_nothing_to_classify(make, labels):
    assert quality.classify(make(), labels()).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with one document of each kind that a stage drops, and columns whose names operators use."""
    rng = random.Random(3)
    item = " ".join(f"bench{i}" for i in range(30))
    passages = [(i, " ".join(f"t{i}w{rng.randrange(50)}" for _ in range(60)), f"s{i % 3}") for i in range(60)]
    near = passages[7][1].replace(passages[7][1].split()[30], "changed", 1)
    rows = passages + [(100, "BUY!! NOW!! " * 30, "s0"), (101, near, "s1"), (102, passages[8][1], "s1"), (103, item + " tail", "s2"), (104, None, None), (105, "", "s0"), (106, passages[9][1], "s1"), (9, passages[9][1], "s0")]
    path = str(tmp_path_factory.mktemp("tables"))
    full = [(d, t, "en", s, len(t or ""), 1, "k", 2) for d, t, s in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, shard int, key string, taken long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(100, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_drop_what_they_should_and_keep_the_rest(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns if name != "shard" else set(columns) <= set(docs.columns)
        ids.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    after = dict(zip([n for n, _ in corpus_pipeline.STAGES], ids))
    assert 100 not in after["quality"] and set(range(60)) <= set(after["quality"])
    assert not {101, 102, 106} & set(after["near_dedup"]) and after["near_dedup"].count(9) == 1 and set(range(60)) <= set(after["near_dedup"])
    assert 103 in after["near_dedup"] and 103 not in after["decontaminate"] and set(range(60)) <= set(after["decontaminate"])
    before = spark.read.parquet(f"{tmp_path}/decontaminate").collect()
    words = sum(len((r.text or "").split()) for r in before)
    mixed = spark.read.parquet(f"{tmp_path}/mix").collect()
    assert abs(sum(len((r.text or "").split()) for r in mixed) - 1.5 * words) <= 4
    assert all(r.n_chars == len(r.text or "") for r in mixed)
    assert after["shard"] == after["mix"]


def test_run_equals_its_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 60 and {"shard", "slot", "grown_shard"} <= set(got.columns)


def test_empty_tables(spark, folder, tmp_path):
    for table in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_its_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14)) and "pipeline" in names
    assert Path(corpus_pipeline.__file__).parent == Path(entry.__file__).parent
