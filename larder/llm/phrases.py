"""Phrase collocations counted in HAT-tries: a shallow trie over word ids with burstable hash containers."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.store import key_filter, may_hold, stored
from larder.llm.words import Texts, mix, ramp, slices

LONGEST = 5  # words of a phrase
LEAST = 100  # occurrences of a candidate
TOP = 2000  # phrases reported for each language
BURST = 4096  # entries of a container before it becomes a node
ENTRIES = 400_000  # entries of a trie before it spills
PLACE_BITS = 40  # pairs of words are first counted at so many places, so that few pairs share one at any size
PAIRS = 4_000_000  # places that a task holds before it hands them on
ROWS = 20_000  # rows of a run that are handed on at once

_BYTES = np.arange(256)
_BREAK = np.isin(_BYTES, [*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D])  # ends a piece
IN_PIECE = ~(_BREAK | (_BYTES == 0x20) | (_BYTES == 0x09))
_RUN = "lang string, part int, keys binary, counts binary"


class HatTrie:
    """Counts of word-id sequences of any length.

    Keys are ids of eight bytes one after the other. A node branches on the next id; below it stand
    nodes, or hash containers that map the rest of a key to its count. A container of more than
    ``burst`` entries with further ids to branch on becomes a node with a container for each next id, so
    only paths that are busy grow deep.
    """

    def __init__(self, burst: int = BURST):
        self.burst, self.root, self.sizes = burst, {}, Counter()  # entries below each first id

    def __len__(self) -> int:
        return self.sizes.total()

    def add(self, first: bytes, rests: list[bytes]) -> None:
        """Count one more of each key ``first`` + rest."""
        node = self.root.get(first)
        if node is None:
            node = self.root[first] = Counter()
        self.sizes[first] += self._into(node, rests, self.root, first)

    def _into(self, node, rests: list[bytes], parent: dict, name: bytes) -> int:
        """Count the rests below a node; returns the number of new entries."""
        if isinstance(node, Counter):
            before = len(node)
            node.update(rests)
            if len(node) > self.burst and max(map(len, node)) > 8:
                parent[name] = self._burst(node)
            return len(node) - before
        by_next: dict[bytes, list[bytes]] = {}
        for rest in rests:
            by_next.setdefault(rest[:8], []).append(rest[8:])
        grown = 0
        for following, below in by_next.items():
            child = node.get(following)
            if child is None:
                child = node[following] = Counter()
            grown += self._into(child, below, node, following)
        return grown

    def _burst(self, container: Counter) -> dict:
        node: dict = {}
        for rest, n in container.items():
            node.setdefault(rest[:8], Counter())[rest[8:]] = n
        return node

    def spill(self, down_to: int) -> Iterator[tuple[bytes, int]]:
        """Take out whole subtrees, the largest first, until ``down_to`` entries are left: a sorted run of (key, count) for each."""
        left = len(self)
        for first, size in self.sizes.most_common():
            if left <= down_to:
                break
            yield from self._sorted(self.root.pop(first), first)
            del self.sizes[first]
            left -= size

    def _sorted(self, node, key: bytes) -> Iterator[tuple[bytes, int]]:
        for following in sorted(node):
            if isinstance(node, Counter):
                yield key + following, node[following]
            else:
                yield from self._sorted(node[following], key + following)


class Pieces(NamedTuple):
    """Words of some texts: their ids and languages, and the bounds of pieces."""

    ids: np.ndarray
    lang: np.ndarray  # code of each word's language
    piece: np.ndarray  # number of each word's piece

    @classmethod
    def of(cls, t: Texts, codes: np.ndarray, seed: int) -> Pieces:
        breaks = np.concatenate([[0], np.cumsum(_BREAK[t.data])])[t.starts]
        text = np.repeat(np.arange(t.rows), np.diff(t.first))
        fresh = np.ones(len(breaks), bool)
        fresh[1:] = (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])
        return cls(t.hashes(seed), codes[t.row : t.row + t.rows][text], np.cumsum(fresh))

    def grams(self, salts: np.ndarray, n: int) -> np.ndarray:
        """A hash of the n words from each place on, salted by language; what follows the last of them is of no use."""
        key = salts[self.lang] ^ mix(self.ids)
        for k in range(1, n):
            key[:-k] = mix(key[:-k] * np.uint64(0x9E3779B97F4A7C15) + self.ids[k:])
        return key[: len(key) - n + 1] if len(key) >= n else key[:0]

    def places(self, salts: np.ndarray) -> np.ndarray:
        """The place of the pair of words from each place on."""
        return self.grams(salts, 2) >> np.uint64(64 - PLACE_BITS)


class Languages:
    """Codes of the languages of a task, in order of appearance."""

    def __init__(self):
        self.names: list[str] = []
        self.code: dict[str, int] = {}

    def codes(self, column: pa.Array) -> np.ndarray:
        out = []
        for name in column.to_pylist():
            if name not in self.code:
                self.code[name] = len(self.names)
                self.names.append(name)
            out.append(self.code[name])
        return np.array(out, np.int64)

    def salts(self) -> np.ndarray:
        return np.array([salt(x) for x in self.names], np.uint64)


def salt(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


class _Words:
    """Counts of the words of a task: arrays of each slice, merged when they have grown."""

    def __init__(self):
        self.parts: list[pa.Table] = []
        self.rows = 0

    def add(self, t: Texts, lang: np.ndarray, ids: np.ndarray, checks: np.ndarray) -> None:
        """Count the words of a slice. Two hashes stand for a word here; Spark then groups by the word itself."""
        order = np.argsort(ids ^ mix(lang.astype(np.uint64)), kind="stable")
        one, two, of = ids[order], checks[order], lang[order]
        edge = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (of[1:] != of[:-1])))
        sample = order[edge]
        sizes = t.ends[sample] - t.starts[sample]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        spelled = pa.StringArray.from_buffers(len(sample), pa.py_buffer(offsets), pa.py_buffer(t.data[ramp(t.starts[sample], sizes)]))
        self.parts.append(pa.table({"lang": lang[sample], "word": spelled, "id": ids[sample].view(np.int64), "f": np.diff(np.append(edge, len(order)))}))
        self.rows += len(sample)

    def merged(self) -> pa.Table:
        """One row for each word; starts anew."""
        table = pa.concat_tables(self.parts).group_by(["lang", "word", "id"]).aggregate([("f", "sum")]).rename_columns(["lang", "word", "id", "f"])
        self.parts, self.rows = [table], len(table)
        return table


class _Places:
    """Hits of places: sorted arrays of each slice, merged when they have grown."""

    def __init__(self, kind: type):
        self.kind, self.most = kind, np.iinfo(kind).max
        self.places: list[np.ndarray] = []
        self.hits: list[np.ndarray] = []
        self.rows = 0

    def add(self, places: np.ndarray) -> None:
        at, n = np.unique(places, return_counts=True)
        self.places.append(at)
        self.hits.append(np.minimum(n, self.most).astype(self.kind))
        self.rows += len(at)

    def merge(self) -> None:
        places, hits = np.concatenate(self.places), np.concatenate(self.hits)
        order = np.argsort(places, kind="stable")
        places, hits = places[order], hits[order]
        edge = np.flatnonzero(np.append(True, places[1:] != places[:-1])[: len(places)])
        self.places = [places[edge]]
        self.hits = [np.minimum(np.add.reduceat(hits.astype(np.int64), edge) if len(edge) else hits, self.most).astype(self.kind)]
        self.rows = len(edge)

    def parts(self, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(part, steps, hits): the places of a part as steps from one to the next, all lowest bytes first, so that they compress."""
        self.merge()
        places, hits = self.places[0], self.hits[0]
        number = (places >> np.uint64(PLACE_BITS - bits)).astype(np.int64)
        edge = np.flatnonzero(np.append(True, number[1:] != number[:-1])[: len(number)])
        inside = places & np.uint64((1 << (PLACE_BITS - bits)) - 1)
        step = inside.copy()
        step[1:] -= inside[:-1]
        step[edge] = inside[edge]
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(places)]):
            yield int(number[a]), np.ascontiguousarray(step[a:b, None].view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes(), hits[a:b].tobytes()


def _unpacked(steps: bytes) -> np.ndarray:
    """Places inside a part from their packed steps."""
    planes = np.frombuffer(steps, np.uint8).reshape(5, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :5] = planes.T
    return np.cumsum(out.view(np.uint64).ravel())


def _first_pass(seed: int, least: int, entries: int, bits: int):
    """Arrow task: occurrences of each word, and how often each place is hit by pairs of words.

    A place is hit by all pairs whose hashes lead there; one hit less than ``least`` times over all tasks
    holds no frequent pair. Hits stop at the limit of their type, which is ``least`` or more.
    """
    kind = np.uint8 if least <= 255 else np.uint32
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("id", pa.int64()), ("f", pa.int64()), ("part", pa.int32()), ("steps", pa.binary()), ("hits", pa.binary())])

    def words_of(table: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
        lang = pa.array(names, pa.string()).take(table.column("lang").combine_chunks())
        none = [pa.nulls(len(table), field.type) for field in list(schema)[4:]]
        yield from pa.table([lang, table.column("word"), table.column("id"), table.column("f"), *none], schema=schema).to_batches(max_chunksize=ROWS)

    def places_of(places: _Places) -> Iterator[pa.RecordBatch]:
        rows = list(places.parts(bits)) if places.rows else []
        for at in range(0, len(rows), ROWS):
            columns = [pa.array(column, field.type) for column, field in zip(zip(*rows[at : at + ROWS]), list(schema)[4:])]
            none = [pa.nulls(len(columns[0]), field.type) for field in list(schema)[:4]]
            yield pa.RecordBatch.from_arrays([*none, *columns], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, words, places = Languages(), _Words(), _Places(kind)
        for batch in batches:
            codes = languages.codes(batch.column("lang"))
            salts = languages.salts()
            for t in slices(batch.column("text"), IN_PIECE, lower=True):
                if not len(t.starts):
                    continue
                p = Pieces.of(t, codes, seed)
                words.add(t, p.lang, p.ids, t.hashes(seed + 1))
                if words.rows > entries and len(words.merged()) > entries // 2:
                    yield from words_of(words.merged(), languages.names)
                    words = _Words()
                places.add(p.places(salts)[p.piece[:-1] == p.piece[1:]])
                if places.rows > PAIRS:
                    places.merge()
                    if places.rows > PAIRS // 2:
                        yield from places_of(places)
                        places = _Places(kind)
        if words.rows:
            yield from words_of(words.merged(), languages.names)
        yield from places_of(places)

    return run


def _busy(least: int, bits: int):
    """Group function: the places of a part that all tasks together hit ``least`` times or more."""
    kind = np.uint8 if least <= 255 else np.uint32

    def run(table: pa.Table) -> pa.Table:
        places = np.concatenate([_unpacked(x.as_buffer()) for x in table.column("steps")])
        hits = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column("hits")])
        order = np.argsort(places, kind="stable")
        places, hits = places[order], hits[order].astype(np.int64)
        edge = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        found = places[edge][np.add.reduceat(hits, edge) >= least]
        return pa.table({"place": pa.array((found + np.uint64(table.column("part")[0].as_py() << (PLACE_BITS - bits))).astype(np.int64))})

    return run


def _gram_counts(n: int, seed: int, bits: np.ndarray, busy: np.ndarray, entries: int, burst: int, part_bits: int):
    """Arrow task: occurrences of runs of n words both of whose parts of n - 1 words ``bits`` may hold, pairs only at ``busy`` places, as sorted runs."""

    def spilled(lang: str, trie: HatTrie, down_to: int) -> Iterator[pa.RecordBatch]:
        """The subtrees that go, as one sorted run for each prefix partition."""
        keys, counts = zip(*trie.spill(down_to))
        ids = np.frombuffer(b"".join(keys), np.uint64).reshape(len(keys), n)
        part = (mix(ids[:, 0] * np.uint64(3) ^ ids[:, 1]) >> np.uint64(64 - part_bits)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        edge = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])).tolist()
        ids, many = ids[order], np.array(counts, np.int64)[order]
        spans = list(zip(edge, [*edge[1:], len(order)]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(edge)), pa.array(part[order][edge]), pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([many[a:b].tobytes() for a, b in spans], pa.binary())],
            ["lang", "part", "keys", "counts"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, tries = Languages(), {}
        for batch in batches:
            codes = languages.codes(batch.column("lang"))
            salts = languages.salts()
            for t in slices(batch.column("text"), IN_PIECE, lower=True):
                if len(t.starts) < n:
                    continue
                p = Pieces.of(t, codes, seed)
                known = may_hold(bits, p.grams(salts, n - 1).view(np.int64))
                at = np.flatnonzero(known[:-1] & known[1:] & (p.piece[: len(p.piece) - n + 1] == p.piece[n - 1 :]))
                if n == 2:
                    at = at[may_hold(busy, p.places(salts)[at].view(np.int64))]
                for code in np.unique(p.lang[at]).tolist():
                    mine = at[p.lang[at] == code] if len(languages.names) > 1 else at
                    mine = mine[np.argsort(p.ids[mine], kind="stable")]
                    keys = np.stack([p.ids[mine + k] for k in range(n)], 1)
                    edge = np.flatnonzero(np.append(True, keys[1:, 0] != keys[:-1, 0])).tolist()
                    firsts = keys[edge, 0].view("V8").tolist()
                    rests = np.ascontiguousarray(keys[:, 1:]).view(f"V{8 * (n - 1)}").ravel().tolist()
                    trie = tries.get(code)
                    if trie is None:
                        trie = tries[code] = HatTrie(burst)
                    for first, a, b in zip(firsts, edge, [*edge[1:], len(rests)]):
                        trie.add(first, rests[a:b])
                while sum(map(len, tries.values())) > entries:
                    code = max(tries, key=lambda c: len(tries[c]))
                    yield from spilled(languages.names[code], tries[code], len(tries[code]) // 2)
        for code, trie in tries.items():
            if len(trie):
                yield from spilled(languages.names[code], trie, -1)

    return run


def _merge(n: int, least: int):
    """Group function: the runs of a prefix partition merged, phrases that occur ``least`` times or more."""

    def run(table: pa.Table) -> pa.Table:
        ids = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, n) for x in table.column("keys")])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts")])
        order = np.lexsort(ids.T[::-1])
        ids, counts = ids[order], counts[order]
        edge = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(1)))
        total = np.add.reduceat(counts, edge)
        found = total >= least
        phrases = [row.tobytes() for row in ids[edge[found]]]
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.binary()), "f": pa.array(total[found])})

    return run


def _gram_keys(n: int):
    """Arrow task: the hashes that ``Pieces.grams`` gives these phrases of n words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids = np.frombuffer(b"".join(batch.column("phrase").to_pylist()), np.uint64).reshape(len(batch), n)
            salts = np.array([salt(x) for x in batch.column("lang").to_pylist()], np.uint64)
            key = salts ^ mix(ids[:, 0].copy())
            for k in range(1, n):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + ids[:, k])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    return run


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: an id as the eight bytes that phrases hold."""
    for batch in batches:
        ids = np.ascontiguousarray(batch.column("id").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("word"), pa.array(ids.view("V8").tolist(), pa.binary()), batch.column("f")], ["lang", "word", "phrase", "f"])


def _part_bits(rows: DataFrame) -> int:
    """Parts (as a power of two) that are small on the cluster at hand: some for each of its shuffle partitions."""
    return min(24, (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length())


def count_words(rows: DataFrame, least: int, entries: int = ENTRIES, seed: int = 0) -> tuple[DataFrame, np.ndarray, int]:
    """(lang, word, id, f over all texts; a filter of the places that many pairs hit; the seed of the ids).

    Two words never share an id if one of them is frequent: another seed is tried until that holds.
    """
    bits = _part_bits(rows)
    while True:
        runs = stored(rows.mapInArrow(_first_pass(seed, least, entries, bits), "lang string, word string, id long, f long, part int, steps binary, hits binary"))
        words = stored(runs.filter("part is null").groupBy("lang", "word").agg(F.sum("f").alias("f"), F.min("id").alias("id")))
        shared = words.groupBy("id").agg(F.min("word").alias("a"), F.max("word").alias("z"), F.max("f").alias("f"))
        if shared.filter((F.col("a") < F.col("z")) & (F.col("f") >= least)).isEmpty():
            break
        seed += 2
    busy = runs.filter("part is not null").select("part", "steps", "hits").groupBy("part").applyInArrow(_busy(least, bits), "place long")
    return words, key_filter(busy, "place"), seed


def frequent_phrases(rows: DataFrame, longest: int = LONGEST, least: int = LEAST, entries: int = ENTRIES, burst: int = BURST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases of one to ``longest`` words that occur ``least`` times or more: lang, n, phrase (word ids), f; frequent words: lang, phrase, word; words of each language: lang, n_words).

    A phrase is frequent only if both its parts of one word less are. So each length is counted in a pass
    of its own over all texts, in which a task leaves out what the frequent parts of the pass before rule
    out, and pairs at places that pairs hit too seldom. Both are bitmaps of fixed size that let some
    through wrongly, the more the more frequent phrases there are; these are counted like the rest.
    Counts are exact.
    Tries that grow too large spill whole subtrees as sorted runs, one for each partition of prefixes of two
    words, where all runs are merged; a busy word is so dealt over the words that follow it.
    """
    words, busy, seed = count_words(rows, least, entries)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n_words"))
    vocabulary = stored(words.filter(F.col("f") >= least).select("lang", "word", "id", "f").mapInArrow(_packed, "lang string, word string, phrase binary, f long"))
    levels = [vocabulary.select("lang", F.lit(1).alias("n"), "phrase", "f")]
    for n in range(2, longest + 1):
        keys = levels[-1].select("lang", "phrase").mapInArrow(_gram_keys(n - 1), "key long")
        runs = rows.mapInArrow(_gram_counts(n, seed, key_filter(keys, "key"), busy, entries, burst, _part_bits(rows)), _RUN)
        merged = runs.groupBy("lang", "part").applyInArrow(_merge(n, least), "lang string, phrase binary, f long")
        levels.append(stored(merged.select("lang", F.lit(n).alias("n"), "phrase", "f")))
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.union(level)
    return phrases, vocabulary.select("lang", "phrase", "word"), totals


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, entries: int = ENTRIES, burst: int = BURST) -> DataFrame:
    """The best phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    A phrase of two to ``longest`` words is a candidate if it occurs ``least`` times or more within
    pieces (between marks and line breaks). Its score is that of its weakest cut in two,
    floor(1000 * a * n / (l * r)), in exact decimals. A candidate is dropped if a longer one around it
    occurs as often: it then always stands inside that one, and so inside one that is a single word longer.

    A null language is ``und``, a null or empty text has no words, repeated rows count again. No rows
    give no rows. Memory of a task follows its longest text and ``entries``; only bitmaps of fixed size
    meet the driver.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    phrases, vocabulary, totals = frequent_phrases(rows, longest, least, entries, burst)
    candidates = phrases.filter("n >= 2")
    part = lambda start, words: F.expr(f"substring(phrase, {start}, {words})")
    around = candidates.filter("n > 2").select("lang", F.explode(F.array(part("1", "8 * (n - 1)"), part("9", "8 * (n - 1)"))).alias("phrase"), "f")
    around = around.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = candidates.join(around, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer") < F.col("f"), F.lit(True))).drop("longer")
    kept = stored(kept)

    cuts = kept.select("lang", "phrase", "f", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.withColumn("left", part("1", "8 * k")).withColumn("right", part("8 * k + 1", "length(phrase) - 8 * k"))
    count_of = lambda name, alias: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(alias))
    cuts = cuts.join(count_of("left", "l"), ["lang", "left"]).join(count_of("right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("cast(1000 as decimal(4, 0)) * cast(f as decimal(17, 0)) * cast(n_words as decimal(17, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    cuts = cuts.withColumn("score", score)
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("f").alias("a"), F.first("n_words").alias("n"))

    spelled = kept.select("lang", F.col("phrase").alias("whole"), F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring("phrase", i * 8 + 1, F.lit(8)))).alias("at", "phrase"))
    spelled = spelled.join(vocabulary, ["lang", "phrase"]).groupBy("lang", "whole").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    spelled = spelled.select("lang", F.col("whole").alias("phrase"), F.array_join("words.word", " ").alias("text"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    listed = weakest.join(spelled, ["lang", "phrase"]).select("lang", F.col("text").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    ranked = listed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
