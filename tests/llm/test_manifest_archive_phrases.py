import gzip
import hashlib
import io
import re
import zlib
from collections import Counter

import pyarrow.fs as fs
import pytest
from conftest_llm import LOWER, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import merkle, phrases, warc


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(docs):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, text, lang, source, n_chars)."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t: h(*(part(v) for v in (d[0], d[3], d[2], d[4], t)))
    trees = {}
    for d in docs:
        trees.setdefault(d[2], []).append((d, leaf(d, d[1])))

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, at):
        out = []
        for nodes in levels[:-1]:
            run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
            out.append((run[: at % 8], run[at % 8 + 1 :]))
            at //= 8
        return out

    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    grown = {k: grow([x for _, x in sorted(trees[k], key=lambda r: (r[0][0] is not None, r[0][0] or 0, r[1]))]) for k in order}
    above = grow([grown[k][-1][0] for k in order]) if order else []
    out = []
    for k in order:
        for at, (d, own) in enumerate(sorted(trees[k], key=lambda r: (r[0][0] is not None, r[0][0] or 0, r[1]))):
            steps = path(grown[k], at) + path(above, order.index(k))
            now = leaf(d, d[1].translate(LOWER) if d[1] is not None else None) if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 else own
            for left, right in steps:
                now = h(*left, now, *right)
            root = above[-1][0]
            out.append((d[0], own, grown[k][-1][0], root, h(*(x for left, right in steps for x in left + right)), now, now == root))
    return sorted(out, key=repr)


FIELDS = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree string"
MANIFESTS = {
    "levels": [(i, f"Text {i}", "en", "s", 5) for i in range(700)] + [(i, f"Text {i}", "de", None, None) for i in range(9)] + [(5, "X", "fr", "s", 1)],
    "nulls, ties, repeated": [(1, None, None, None, None), (None, "A", "en", "s", 1), (2, "", "en", "", 0), (2, "", "en", "", 0), (2, "B", "en", "", 0), (3, "É A", None, "s", 3), (6, "Z", "", "s", 1), (4, "w" * 300_000, "é", "s", 1)],
    "many languages": [(i, "Text", f"l{i % 70}", "s", 4) for i in range(150)],
    "one": [(7, "A", "en", "s", 1)],
    "none": [],
}


@pytest.mark.parametrize("case", MANIFESTS)
def test_manifest_equals_brute_force(spark, case):
    docs = spark.createDataFrame([(*d, "d", "t") for d in MANIFESTS[case]], FIELDS).repartition(3)
    got = merkle.verify_manifest(docs)
    assert rows(got, "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified") == brute_manifest(MANIFESTS[case])


@given(st.integers(1, 600))
@settings(max_examples=60, deadline=None)
def test_positions_are_those_of_a_postorder_walk(leaves):
    height = merkle.levels(leaves)
    walk = []

    def visit(level, index):
        if level:
            for child in range(index * 8, min(index * 8 + 8, -(-leaves // 8 ** (level - 1)))):
                visit(level - 1, child)
        walk.append((level, index))

    visit(height, 0)
    assert [merkle.position(level, index, leaves, height) for level, index in walk] == list(range(len(walk)))
    names = [f"{i:064x}" for i in range(leaves)]
    segment = merkle.Segment.build(names, height)
    assert len(segment.nodes) == len(walk) and segment.level(0) == names
    assert all(merkle.fold(leaf, path) == segment.nodes[-1] for leaf, path in zip(names, segment.paths()))


def test_log_of_all_nodes_has_no_gaps(spark):
    docs = spark.createDataFrame([(i, "x", "en", "s", 1, "d", "t") for i in range(1100)], FIELDS)
    log, _ = merkle.manifest(docs)
    lowest = sorted(r.position for r in merkle.entries(log).filter("tier = 0").collect())
    assert len(log.tiers) == 2 and len(set(lowest)) == len(lowest) == 1100 + 138 + 18 + 3 and max(lowest) < 1100 + 138 + 18 + 3 + 1


PAGES = "page_id long, url string, html string, payload string, sound string, n long"


def brute_archive(pages):
    last = {}
    for p, _, t in pages:
        last[t or ""] = max((x for x in (last.get(t or ""), p) if x is not None), default=None)
    out = []
    for p, _, t in pages:
        body = (t or "").encode()
        again = len(body) >= 1000 and p != last[t or ""]
        out.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last[t or ""] if again else None))
    return sorted(out, key=repr)


WARC_CASES = {
    "kinds": [(1, "http://a/1", "x" * 1200), (2, "http://a/2", "x" * 1200), (3, "http://a/3\r\nEvil: 1", "é" * 500), (4, None, "é" * 500), (5, "u", "y" * 999), (6, "u", "y" * 999), (7, "", None), (8, "u", ""), (None, "u", "x" * 1200), (2, "http://a/2", "x" * 1200)],
    "records inside": [(1, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 40), (2, "u", "\n\n\r\n\r\n"), (3, "u", "\r\n\r\n"), (4, "u", "long <p>" * 400_000)],
    "hot": [(i, f"u{i}", "same page " * 200) for i in range(300)] + [(1000 + i, "u", f"own {i} " * 200) for i in range(50)],
    "none": [],
}


@pytest.mark.parametrize("case", WARC_CASES)
def test_archived_pages_equal_brute_force(spark, case):
    pages = spark.createDataFrame([(*p, "p", "s", 1) for p in WARC_CASES[case]], PAGES).repartition(3)
    got = warc.archive_pages(pages)
    assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute_archive(WARC_CASES[case])
    assert got.filter("not sound").count() == 0


def test_archives_are_plain_gzip_with_a_member_a_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * (10 if i % 3 else 300), "p", "s", 1) for i in range(60)], PAGES).repartition(2)
    warc.write_monolithic(warc.revisits(pages), f"file://{tmp_path}/whole", records_per_file=20)
    whole = sorted((tmp_path / "whole").glob("*.gz"))
    assert len(whole) >= 3
    one = zlib.decompressobj(31)
    assert one.decompress(whole[0].read_bytes()) and one.eof and not one.unused_data  # a single stream
    index = warc.normalise(spark, f"file://{tmp_path}/whole", f"file://{tmp_path}")
    found = index.collect()
    assert len(found) == 60 and {r.page_id for r in found} == set(range(60))
    for r in found:
        raw = fs.FileSystem.from_uri(r.archive)[0].open_input_file(fs.FileSystem.from_uri(r.archive)[1]).read_at(r.length, r.start)
        text = gzip.GzipFile(fileobj=io.BytesIO(raw)).read().decode()
        assert text.startswith("WARC/1.1\r\n") and text.endswith("\r\n\r\n") and f"WARC-Record-ID: {r.record_id}\r\n" in text
    # members lie end to end, so a whole file is a valid gzip file too
    for archive in {r.archive for r in found}:
        mine = sorted((r.start, r.length) for r in found if r.archive == archive)
        data = gzip.decompress(open(archive.removeprefix("file://"), "rb").read())
        assert mine[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:])) and data.count(b"WARC-Type: ") == len(mine)


def test_damaged_archives_are_reported(spark, tmp_path):
    for broken in (b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcX\r\n\r\n", b"WARC/1.1\r\nContent"):
        with pytest.raises(ValueError):
            for _, _, block in warc.split_stream(io.BytesIO(gzip.compress(broken))):
                b"".join(block)


def brute_phrases(docs, least, top, longest=5):
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = {}
    for (lang, p), a in candidates.items():
        if any(x == lang and len(q) > len(p) and 100 * b >= 100 * a and inside(p, q) for (x, q), b in candidates.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])), key=repr)


def phrase_docs():
    import random

    rng = random.Random(6)
    docs = []
    for i in range(200):
        words = [rng.choice(["the", "a", "of", "Red", "house", "New", "york", "é", "city"]) for _ in range(rng.randrange(0, 40))]
        for at in range(0, len(words), 7):
            words[at : at + 1] = rng.choice([["the", "big", "apple", "pie", "shop"], ["New", "York"], ["x,", "y."], ["a\tb\x0bc"]])
        docs.append((" ".join(words), rng.choice(["en", "en", "de", None])))
    return docs


PHRASES = {
    "mixed": (phrase_docs(), 5, 2000, 400_000, 4096), "small tries": (phrase_docs(), 3, 7, 60, 4), "repeats": ([("a a a a a a", "en")] * 30 + [("b " * 5000, None)], 10, 100, 50, 2),
    "edges": ([(None, "en"), ("", "de"), (" \t. , ", None), ("one", "en")], 1, 10, 100, 10), "none": ([], 1, 10, 100, 10),
}


@pytest.mark.parametrize("case", PHRASES)
def test_phrases_equal_brute_force(spark, case):
    docs, least, top, entries, burst = PHRASES[case]
    frame = spark.createDataFrame([(i, t, lang, "p", 1) for i, (t, lang) in enumerate(docs)], "doc_id long, text string, lang string, phrase string, f long").repartition(4)
    got = phrases.collocations(frame, least=least, top=top, entries=entries, burst=burst)
    assert rows(got, "lang", "rank", "phrase", "a", "l", "r", "n", "score") == brute_phrases(docs, least, top)


@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=5), max_size=300), st.integers(1, 6), st.integers(0, 30))
@settings(max_examples=150, deadline=None)
def test_tries_count_like_a_dictionary(keys, burst, left):
    trie, merged = phrases.HatTrie(burst), Counter()
    packed = [b"".join(i.to_bytes(8, "big") for i in key) for key in keys]
    for at in range(0, len(packed), 20):
        for key in packed[at : at + 20]:
            trie.add(key[:8], [key[8:]])
        run = list(trie.spill(left))
        for first in {k[:8] for k, _ in run}:
            mine = [k for k, _ in run if k[:8] == first]
            assert mine == sorted(mine)
        merged.update(dict(run))
        assert len(trie) <= left or not trie.root
    for key, n in trie.spill(-1):
        merged[key] += n
    assert merged == Counter(packed) and not trie.root


def test_scores_beyond_64_bits(spark):
    # as the query computes them
    row = spark.sql("select cast(1000 as decimal(4, 0)) * cast(90000000000000001 as decimal(17, 0)) * cast(99999999999999999 as decimal(17, 0)) div (cast(90000000000000001 as decimal(19, 0)) * cast(90000000000000003 as decimal(19, 0))) as s").first()
    assert row.s == 1000 * 90000000000000001 * 99999999999999999 // (90000000000000001 * 90000000000000003)
