import random

import numpy as np
import pytest
from conftest_llm import rows, sha, spaced_words
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import near_dedup
from larder.llm.components import components
from larder.llm.substring_dedup import dedup_substrings
from larder.llm.words import SPACED, WORD_BASE, Powers, mix, slices, window_minima

POWERS = Powers(WORD_BASE)


def brute_substrings(docs, length):
    first = {}
    for d, t in docs:
        w = spaced_words(t)
        for k in range(len(w) - length + 1 if d is not None else 0):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in docs:
        w, gone = spaced_words(t), set()
        for k in range(len(w) - length + 1 if d is not None else 0):
            if first[tuple(w[k : k + length])] < d:
                gone |= set(range(k, k + length))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=repr)


def shuffled_passages(seed):
    rng = random.Random(seed)
    parts = [[f"p{i}x{j}" for j in range(rng.randrange(3, 30))] for i in range(12)]
    return [(d, "  ".join(w for p in rng.sample(parts, rng.randrange(0, 6)) for w in p)) for d in range(60)]


SUBSTRINGS = {
    "passages": (shuffled_passages(3), 8),
    "odd length": (shuffled_passages(4), 7),
    "periodic": ([(1, "a " * 40), (2, "a " * 30), (3, "b a " * 20), (4, "a b " * 20 + "a")], 10),
    "copies, null, repeated": ([(1, None), (2, ""), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (3, "x a b c d e f"), (4, "a  b\tc d e f"), (5, "a b c"), (6, "a b c"), (7, "é é é é é é")], 5),
    "hot": ([(i, f"u{i} " + "h i j k l m n o " + f"v{i} w{i}") for i in range(150)], 6),
    "fifty": ([(1, " ".join(f"w{i}" for i in range(120))), (2, " ".join(f"w{i}" for i in range(60, 130))), (3, " ".join(f"w{i}" for i in range(30, 79))), (4, "z " + " ".join(f"w{i}" for i in range(30, 80)))], 50),
    "none": ([], 50),
}


@pytest.mark.parametrize("case", SUBSTRINGS)
def test_substrings_equal_brute_force(make, case):
    docs, length = SUBSTRINGS[case]
    assert rows(dedup_substrings(make(*docs), length), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(docs, length)


def test_words_that_a_polynomial_cannot_tell_apart_differ(make):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    shared = " ".join(f"w{i}" for i in range(49))
    got = rows(dedup_substrings(make((1, f"{shared} {word}"), (2, f"{shared} {other}"), (3, f"x {shared} {other}"), (4, "long " * 200_000))), "doc_id", "n_removed")
    assert got == [(1, 0), (2, 0), (3, 50), (4, 0)]


def test_kept_text_is_the_words_left(make):
    got = {r.doc_id: r.kept_text for r in dedup_substrings(make((1, "a b c d"), (2, "x a b c d y"), (3, "q")), 4).collect()}
    assert got == {1: None, 2: "x y", 3: None}


@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25), st.integers(0, 12))
@settings(max_examples=300, deadline=None)
def test_banded_alignment_is_edit_distance(a, b, limit):
    previous = list(range(len(b) + 1))
    for i, x in enumerate(a):
        current = [i + 1]
        for j, y in enumerate(b):
            current.append(min(previous[j] + (x != y), previous[j + 1] + 1, current[j] + 1))
        previous = current
    got = near_dedup.edit_distance(mix(np.array(a, np.uint64)), mix(np.array(b, np.uint64)), limit, POWERS)
    assert got == (previous[-1] if previous[-1] <= limit else None)


@given(st.lists(st.lists(st.integers(0, 5), max_size=12), min_size=1, max_size=5), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_window_minima(groups, width):
    values = np.array([v for g in groups for v in g], np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(g) for g in groups])])
    want = [b + max(range(i, i + width), key=lambda j: (-g[j], j)) for b, g in zip(bounds, groups) for i in range(len(g) - width + 1)]
    assert window_minima(values, bounds, width).tolist() == want


def test_words_of_slices_equal_a_plain_split():
    import pyarrow as pa

    texts = [None, "", "a", " b  c", "ééé\x0bx\x1cy", "long " * 900_000, "z", "tail "]
    got = []
    for t in slices(pa.array(["skipped", *texts]).slice(1), SPACED, lower=False):
        got += [[t.data[s:e].tobytes().decode() for s, e in zip(t.starts[a:b], t.ends[a:b])] for a, b in zip(t.first[:-1], t.first[1:])]
    assert got == [spaced_words(t) for t in texts]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (200, 300)]
    got = rows(components(spark.createDataFrame(edges, "a long, b long")), "node", "component")
    assert got == sorted([(i, 0) for i in range(41)] + [(i, 100) for i in (100, 101, 102)] + [(200, 200), (300, 200)], key=repr)


def test_further_links_join_components_and_cost_an_edge_each(spark, monkeypatch):
    from larder.llm import components as module

    first = [(i, i + 1) for i in range(0, 20)] + [(100, 101), (200, 201)]
    more = [(i, j) for i in range(21) for j in range(i)] + [(i, 100 + i % 2) for i in range(21)] + [(300, 301), (101, 300)]
    table = lambda edges: spark.createDataFrame(edges, "a long, b long")
    edges, plain = [], module.components
    before = plain(table(first))
    monkeypatch.setattr(module, "components", lambda e: edges.append(e.count()) or plain(e))
    got = rows(module.merged(before, table(more)), "node", "component")
    assert got == rows(plain(table(first + more)), "node", "component")
    assert edges == [3]  # of 233 links


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        words[i : i + 1] = rng.choice([[], [f"n{rng.random()}"], [words[i], f"m{rng.random()}"]])
    return words


def test_near_duplicates_equal_brute_force(make):
    rng = random.Random(5)
    docs, n = [], 0
    common = [f"c{i}" for i in range(30)]
    for family in range(12):
        base = [f"f{family}x{rng.randrange(200)}" for _ in range(rng.choice([30, 80, 200]))]
        for member in range(rng.choice([1, 2, 4, 25])):
            docs.append((n, " ".join(edited(base, rng, rng.randrange(0, max(1, len(base) // 20))) + (common if member % 7 == 6 else []))))
            n += 1
    docs += [(n + i, " ".join(common + [f"o{i}x{j}" for j in range(40)])) for i in range(20)]
    docs += [(2000, None), (2001, ""), (2002, " "), (2003, "tiny text"), (2004, "Tiny  text"), (2005, "tiny text"), (None, "tiny text"), (2006, "other text"), (2003, "tiny text"), (2007, "wide " * 30_000), (2008, "wide " * 29_990)]
    texts = {}
    for d, t in docs:
        texts.setdefault(t or "", []).append(d)
    words = {t: mix(np.array([hash(w) & 0xFFFFFFFFFFFF for w in spaced_words(t.lower())], np.uint64)) for t in texts}
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    names = list(texts)
    for i, a in enumerate(names):
        for b in names[:i]:
            longer = max(len(words[a]), len(words[b]))
            if min(len(words[a]), len(words[b])) and near_dedup.edit_distance(words[a], words[b], int((1 - near_dedup.SIMILAR) * longer + 1e-9), POWERS) is not None:
                parent[find(a)] = find(b)
    members = {}
    for t, ids in texts.items():
        members.setdefault(find(t), []).extend(ids)
    want = sorted(((d, min(i for i in m if i is not None), len(m)) for m in members.values() for d in m), key=repr)
    got = near_dedup.near_duplicates(make(*docs))
    assert rows(got, "doc_id", "class_id", "class_size") == want
    assert rows(got.filter("kept"), "doc_id") == sorted(((c,) for c in {w[1] for w in want}), key=repr)


def test_pairs_at_every_similarity_are_found(make):
    """Recall by band over pairs of 100 words that differ in up to a tenth of them."""
    rng = random.Random(11)
    docs = []
    for pair in range(240):
        words = [f"p{pair}w{i}" for i in range(100)]
        other = list(words)
        for i in rng.sample(range(100), 1 + pair % 10):
            other[i] = f"q{pair}x{i}"
        docs += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    classes = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(make(*docs)).collect()}
    found = np.array([classes[2 * p] == classes[2 * p + 1] for p in range(240)])
    bands = [found[b::10].mean() for b in range(10)]
    assert min(bands[:8]) >= 0.95 and min(bands) >= 0.85 and found.mean() >= 0.97, bands


def test_texts_that_share_half_a_passage_part(make):
    rng = random.Random(12)
    passage = [f"c{i}" for i in range(60)]
    docs = [(i, " ".join(passage + [f"own{i}x{j}" if rng.random() < 0.3 else f"w{rng.randrange(300)}" for j in range(50)])) for i in range(300)]
    docs += [(1000 + i, docs[i][1] + " tail") for i in range(0, 300, 10)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(make(*docs)).collect()}
    assert all(got[i] == i for i in range(300)) and all(got[1000 + i] == i for i in range(0, 300, 10))


def test_near_duplicates_of_nothing(make):
    assert near_dedup.near_duplicates(make()).count() == 0
