from collections import Counter, defaultdict
from fractions import Fraction
from zlib import crc32

import pytest
from conftest_llm import rows, spaced_words

from larder.llm.mixing import first_words, mix_sources
from larder.llm.sharding import shard


def fair_targets(sizes):
    """Shares by weight, with the excess over twice a source's size shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    cap = {s: Fraction(2 * sizes[s]) for s in order}
    target, free, left = {}, set(order), Fraction(3 * sum(sizes.values()), 2)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > cap[s]}
        if not over:
            target |= {s: unit * weight[s] for s in free}
            break
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
        free -= over
    return target


MIXES = {
    "sources": [(i, "w " * (i % 9), f"s{i % 5}") for i in range(120)],
    "hot and null source": [(i, "a b c", "big" if i % 3 else None) for i in range(90)] + [(500, "x", "tiny")],
    "no words": [(1, None, "a"), (2, "", "b"), (3, " \n", None)],
    "repeated rows": [(1, "a b", "s"), (1, "a b", "s"), (None, "c d e", "s"), (2, "f", "t")],
    "long": [(1, "w " * 200_000, "a"), (2, "v " * 7, "b"), (3, "u", "c")],
    "none": [],
}


@pytest.mark.parametrize("case", MIXES)
def test_mix_uses_targets_up_to_the_word(make, case):
    docs = MIXES[case]
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(spaced_words(text))
    got = mix_sources(make(*docs)).collect()
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((d, len(spaced_words(t))) for d, t, _ in docs if d is not None)
    if case == "repeated rows":
        assert all(0 <= r.taken <= 2 * r.size for r in got)
        return
    by_id = {d: s for d, _, s in docs}
    target, taken = fair_targets(sizes), defaultdict(int)
    for r in got:
        source = by_id[r.doc_id]
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(float(target[source]))
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    for source, words in taken.items():
        assert abs(words - float(target[source])) < 1.001


def test_mix_reruns_agree(make):
    docs = MIXES["sources"]
    assert rows(mix_sources(make(*docs)), "doc_id", "taken") == rows(mix_sources(make(*reversed(docs))), "doc_id", "taken")


def test_first_words(make):
    from pyspark.sql import functions as F

    got = make((1, " a  b\nc "), (2, "x")).select("doc_id", first_words(F.col("text"), F.lit(2)).alias("t"))
    assert rows(got, "doc_id", "t") == [(1, " a  b"), (2, "x")]


SHARDS = {
    "many": [(i, f"t{i % 40}" * (i % 4)) for i in range(400)],
    "null and repeated": [(None, None), (None, "é"), (1, "a"), (1, "a"), (1, "b"), (2, "")],
    "none": [],
}


@pytest.mark.parametrize("case", SHARDS)
def test_shards(make, case):
    docs = SHARDS[case]
    got = shard(make(*docs), [1.0] * 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, crc32((t or "").encode())) for d, t in docs)
    place, slots = {}, defaultdict(list)
    for r in got:
        assert place.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_growth(make):
    docs = make(*((i, "x") for i in range(4000)))
    before = {r.doc_id: r.shard for r in shard(docs, [1, 1, 2]).collect()}
    counts = Counter(before.values())
    assert 0.43 < counts[2] / 4000 < 0.57
    after = {r.doc_id: r.shard for r in shard(docs, [1, 1, 3]).collect()}
    assert all(after[d] == 2 for d in before if after[d] != before[d])
