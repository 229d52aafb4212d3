"""Near duplicates by order MinHash and banded alignment."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.components import components, merged
from larder.llm.store import key_filter, may_hold, stored, text_key
from larder.llm.words import SPACED, WORD_BASE, Powers, Texts, mix, ramp, slices

WORDS = 5  # in a k-mer
MINIMA = 3  # k-mers of a sketch entry
ENTRIES = 40
SIMILAR = 0.9  # at this edit similarity two texts share an entry with a chance of 0.95, above it with more
PAIRS, CELLS = 512, 1_000_000  # pairs, and cells of their bands, that a task aligns at once
TURNS = 3  # times that crowded nodes are aligned with one other each, before all that are still apart
SIGNATURE, NEIGHBOURS = 1024, 2048  # bits that tell which words a text has, and which pairs of neighbouring words
_SPARE = 8  # looks at about so many times MINIMA k-mers for each entry, and at all where these don't do


def _labelled(t: Texts, hashes: np.ndarray, k: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(occurrence-labelled k-mer hashes in text order, bounds of the texts). A text of fewer than k words is one k-mer."""
    n = np.diff(t.first)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at, owner = ramp(t.first[:-1], counts), np.repeat(np.arange(t.rows), counts)
    grams = powers.spans(hashes, at, np.minimum(at + k, t.first[owner + 1]))
    key = grams ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    fresh = np.append(True, key[order][1:] != key[order][:-1])[: len(order)]
    starts = np.flatnonzero(fresh)
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return mix(grams + occurrence * np.uint64(0x9E3779B97F4A7C15)), np.concatenate([[0], np.cumsum(counts)])


def order_minhash(labelled: np.ndarray, bounds: np.ndarray, minima: int, entries: int, powers: Powers) -> np.ndarray:
    """(texts, entries): for each entry a hash of the text's ``minima`` least labelled k-mers, under the entry's own order of hashes, taken in text order."""
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    share = np.minimum(_SPARE * minima / np.maximum(counts, 1), 1.0)
    limit = np.where(share < 1, share * 2.0**64, 0).astype(np.uint64) - np.uint64(1)  # all ones where every k-mer is looked at
    limits = limit[owner]
    out = np.zeros((len(counts), entries), np.uint64)
    for j in range(entries):
        factor = int(mix(np.full(1, j + 1, np.uint64))[0]) | 1
        x = labelled * np.uint64(factor)
        seen = np.flatnonzero(x <= limits)
        short = np.bincount(owner[seen], minlength=len(counts)) < np.minimum(counts, minima)
        if short.any():
            seen = np.flatnonzero((x <= limits) | short[owner])
        by_value = np.lexsort((x[seen], owner[seen]))
        mine = owner[seen][by_value]
        first = np.searchsorted(mine, np.arange(len(counts)))
        chosen = np.sort(seen[by_value][np.arange(len(mine)) - first[mine] < minima])
        edges = np.searchsorted(owner[chosen], np.arange(len(counts) + 1))
        out[:, j] = powers.spans(labelled[chosen], edges[:-1], edges[1:]) ^ mix(np.full(1, 1000 + j, np.uint64))
    return out


def _sketch(k: int, minima: int, entries: int):
    """Arrow task: number of words and sketch of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word, by_entry = Powers(WORD_BASE), Powers(WORD_BASE)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            counts, sketches, signatures = [], [], []
            for t in slices(batch.column("text"), SPACED, lower=True):
                counts.append(np.diff(t.first))
                hashes = t.hashes()
                owner = np.repeat(np.arange(t.rows), counts[-1])
                has = np.zeros((t.rows, SIGNATURE + NEIGHBOURS), bool)
                has[owner, (hashes & np.uint64(SIGNATURE - 1)).astype(np.int64)] = True
                both = owner[1:] == owner[:-1]
                pair = mix(hashes[:-1] * np.uint64(3) ^ hashes[1:])[both] & np.uint64(NEIGHBOURS - 1)
                has[owner[1:][both], SIGNATURE + pair.astype(np.int64)] = True
                signatures.append(np.packbits(has, axis=1, bitorder="little").view(np.int64))
                labelled, bounds = _labelled(t, hashes, k, by_word)
                sketches.append(order_minhash(labelled, bounds, minima, entries, by_entry))
            if not counts:
                continue
            counts, sketches = np.concatenate(counts), np.concatenate(sketches)
            some = counts > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * entries)]).astype(np.int32)), pa.array(sketches[some].ravel().view(np.int64)))
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * ((SIGNATURE + NEIGHBOURS) // 64)), pa.array(np.concatenate(signatures).ravel()))
            rows = np.arange(row, row + len(batch))
            row += len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("ident"), batch.column("text_key"), pa.array(counts), lists, words], ["row", "ident", "text_key", "n_words", "sketch", "words"])

    return run


class Sequences(NamedTuple):
    """Word hashes of many texts one after the other, with prefix sums to compare runs in constant time."""

    words: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, first: np.ndarray, powers: Powers) -> Sequences:
        powers.upto(len(words) + 1)
        return cls(words, first, np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers.up[: len(words)])]))

    def pick(self, rows: np.ndarray, powers: Powers) -> Sequences:
        counts = np.diff(self.first)[rows]
        return Sequences.of(self.words[ramp(self.first[rows], counts)], np.concatenate([[0], np.cumsum(counts)]), powers)

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of each pair of neighbouring words, the text mixed into the hash."""
        counts = np.maximum(np.diff(self.first) - 1, 0)
        at, owner = ramp(self.first[:-1], counts), np.repeat(np.arange(len(counts)), counts)
        return owner, mix(mix(self.words[at] * np.uint64(3) ^ self.words[at + 1]) ^ mix(owner.astype(np.uint64)))


def _common_neighbours(a: Sequences, b: Sequences) -> np.ndarray:
    """Size of the common multiset of neighbouring words, for each pair of texts."""
    (owner, x), (_, y) = a.neighbours(), b.neighbours()
    x, at, n = np.unique(x, return_index=True, return_counts=True)
    y, m = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return np.bincount(owner[at[i]], np.minimum(n[i], m[j]), minlength=len(a.first) - 1).astype(np.int64)


def _align_some(a: Sequences, b: Sequences, limits: np.ndarray, powers: Powers) -> np.ndarray:
    """Edits of each pair, or -1 if more than its limit. All pairs advance together, edit by edit."""
    out = np.full(len(limits), -1, np.int64)
    n, m = np.diff(a.first), np.diff(b.first)
    alive = np.arange(len(limits))

    def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """x moved on along its diagonal while the words agree."""
        begin_a, begin_b = a.first[alive][:, None], b.first[alive][:, None]
        most = np.minimum(n[alive][:, None] - x, m[alive][:, None] - y)
        i, j = begin_a + x, begin_b + y
        low, step = np.zeros_like(x), 1 << max(int(most.max(initial=0)).bit_length() - 1, 0)
        while step:
            tried = np.where(low + step <= most, low + step, 0)
            same = (a.sums[i + tried] - a.sums[i]) * powers.down[i] == (b.sums[j + tried] - b.sums[j]) * powers.down[j]
            low = np.where(same & (tried > 0), tried, low)
            step //= 2
        return x + low

    zero = np.zeros((len(alive), 1), np.int64)
    far, edits = run(zero, zero), 0
    while len(alive):
        shift = m[alive] - n[alive]
        column = np.clip(shift + edits, 0, 2 * edits)
        done = (np.abs(shift) <= edits) & (far[np.arange(len(alive)), column] >= n[alive])
        out[alive[done]] = edits
        going = ~done & (limits[alive] > edits)
        alive, far = alive[going], far[going]
        edits += 1
        k = np.arange(-edits, edits + 1)[None, :]
        wide = np.full((len(alive), far.shape[1] + 4), -(1 << 40), np.int64)
        wide[:, 2:-2] = far
        x = np.maximum(np.maximum(wide[:, 1:-1] + 1, wide[:, 2:] + 1), wide[:, :-2])  # replace, delete from a, insert into a
        x = np.minimum(np.minimum(x, n[alive][:, None]), m[alive][:, None] - k)
        valid = (x >= 0) & (x + k >= 0)
        at, to = np.where(valid, x, n[alive][:, None]), np.where(valid, x + k, m[alive][:, None])
        far = np.where(valid, run(at, to), -(1 << 40))
    return out


def edit_distances(a: Sequences, b: Sequences, limits: np.ndarray, powers: Powers) -> np.ndarray:
    """Edits (insert, delete, replace a word) that turn each text of a into that of b, or -1 if more than its limit.

    Only the band of diagonals that ``limit`` edits can reach is aligned: for each number of edits the
    furthest place on each diagonal is kept, and matching runs are crossed at once.
    """
    longer = np.maximum(np.diff(a.first), np.diff(b.first))
    # each edit breaks two pairs of neighbours at most
    maybe = (np.abs(np.diff(a.first) - np.diff(b.first)) <= limits) & (_common_neighbours(a, b) >= longer - 1 - 2 * limits)
    rows = np.flatnonzero(maybe)
    rows = rows[np.argsort(limits[rows], kind="stable")]
    out, start = np.full(len(limits), -1, np.int64), 0
    while start < len(rows):  # pairs of like limits, a bounded number of cells at once
        size = np.arange(1, len(rows) - start + 1) * (2 * limits[rows[start:]] + 3)
        stop = start + max(1, int(np.searchsorted(size, CELLS, "right")))
        some = rows[start:stop]
        out[some] = _align_some(a.pick(some, powers), b.pick(some, powers), limits[some], powers)
        start = stop
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int, powers: Powers) -> int | None:
    """Edits that turn one text into another, or None if more than ``limit``."""
    one, two = (Sequences.of(x, np.array([0, len(x)]), powers) for x in (a, b))
    edits = int(edit_distances(one, two, np.array([limit]), powers)[0])
    return edits if edits >= 0 else None


def _align(similar: float):
    """Arrow task: pairs whose texts have ``1 - edits / longer`` of ``similar`` or more, in words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word = Powers(WORD_BASE)
        for whole in batches:
            for at in range(0, len(whole), PAIRS):
                batch = whole.slice(at, PAIRS)
                sides = []
                for column in ("text_a", "text_b"):
                    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                    for t in slices(batch.column(column), SPACED, lower=True):
                        hashes.append(t.hashes())
                        counts.append(np.diff(t.first))
                    sides.append(Sequences.of(np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))]), by_word))
                longer = np.maximum(*(np.diff(s.first) for s in sides))
                edits = edit_distances(*sides, np.floor((1 - similar) * longer + 1e-9).astype(np.int64), by_word)
                yield batch.select(["a", "b"]).filter(pa.array(edits >= 0))

    return run


def _in_reach(similar: float, a: str, b: str) -> Column:
    """Whether two nodes (n_words and words as ``n_a``, ``words_a``, ...) can be linked at all.

    Each edit removes one word of a text at most and breaks two pairs of neighbours, so a link bears no
    more words that one text alone has than the edits it allows, and twice as many pairs. Bits that
    one signature alone has stand for one such word or pair at least.
    """
    n_a, n_b, bits_a, bits_b = F.col(f"n_{a}"), F.col(f"n_{b}"), F.col(f"words_{a}"), F.col(f"words_{b}")
    longer = F.greatest(n_a, n_b)
    edits = F.floor((1 - similar) * longer + 1e-9)
    reach = F.least(n_a, n_b) >= similar * longer - 1e-9
    words, pairs = range(SIGNATURE // 64), range(SIGNATURE // 64, (SIGNATURE + NEIGHBOURS) // 64)
    for part, each in ((words, 1), (pairs, 2)):
        for x, y in ((bits_a, bits_b), (bits_b, bits_a)):
            reach = reach & (sum(F.bit_count(x[i].bitwiseAND(F.bitwise_not(y[i]))) for i in part) <= edits * each)
    return reach


def _tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: the words of each text as hashes, told apart by occurrence."""
    by_word = Powers(WORD_BASE)
    for batch in batches:
        nodes = batch.column("node")
        for t in slices(batch.column("text"), SPACED, lower=True):
            labelled, bounds = _labelled(t, t.hashes(), 1, by_word)
            tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(labelled.view(np.int64)))
            yield pa.RecordBatch.from_arrays([nodes.slice(t.row, t.rows), tokens], ["node", "tokens"])


def rare_words(texts: DataFrame, similar: float) -> DataFrame:
    """(token, node): of each text its rarest words, one more than a link may leave unshared.

    Words are ordered by the texts that have them. Of two linked texts neither has more than
    ``1 - similar`` of its words alone, so their lists share a word (the prefix filter of set-similarity
    joins). Words of one text alone fill its list but are not returned.
    """
    words = stored(texts.mapInArrow(_tokens, "node long, tokens array<long>").select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("token")))
    spread = words.groupBy("token").agg(F.count("*").alias("texts"))
    order = F.sort_array(F.collect_list(F.struct("texts", "token")))
    rarest = words.join(spread, "token").groupBy("node").agg(F.slice(order, F.lit(1), F.floor((1 - similar) * F.first("n") + 1e-9).cast("int") + 1).alias("rarest"))
    return rarest.select("node", F.explode("rarest").alias("r")).filter("r.texts > 1").select("r.token", "node")


def _present(bits: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(bits, batch.column("probe").to_numpy(zero_copy_only=False))))

    return run


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, minima: int = MINIMA, entries: int = ENTRIES, similar: float = SIMILAR, keep: Column | None = None
) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), class_size, n_words, kept.

    Texts that differ are the nodes, so copies cost a row each and nothing more. A node's sketch has
    ``entries`` hashes, each of the ``minima`` least of its k-mers of ``k`` words (A-Z lowered), told
    apart by occurrence and taken in text order. Nodes that agree in an entry share a bucket and are
    candidates. Two candidates are linked if their edit similarity in words is ``similar`` or more;
    classes are the connected components of the links.

    No bucket makes all its pairs. First each node is aligned with one of the least nodes of its buckets,
    that which shares most entries with it, then with the others that are still in another component:
    pairs inside one component could add no class. Buckets that then still hold several
    components are refined: their nodes meet again by their rarest words (``rare_words``), of which any
    two that can be linked share one, so texts that only have a common passage part. There each node is aligned
    a few times with the one lead that shares most of its rare words, which joins most of a large group with a row a
    node, and then the nodes outside the largest component of a bucket with all those of other components. Before any
    alignment a pair is dropped if the lengths, or the words that one of the texts alone has, need more
    edits than a link allows. So every candidate pair that could change a class is decided.

    A null or empty text has no words and no near duplicate, only equal texts (null: empty). A text of
    one to ``k`` - 1 words is one k-mer. Of a class the row with the smallest doc_id stays (null last),
    of rows that repeat it one. No rows give no rows. ``keep`` adds a struct column that is carried along.
    """
    body = F.col(text)
    ident = F.struct(F.col(doc_id).cast("long").alias("doc_id"), *([keep.alias("carried")] if keep is not None else []))
    rows = docs.select(ident.alias("ident"), body.alias("text"), text_key(F.coalesce(body, F.lit(""))).alias("text_key"))
    scan = stored(rows.mapInArrow(_sketch(k, minima, entries), f"row long, ident {dict(rows.dtypes)['ident']}, text_key string, n_words long, sketch array<long>, words array<long>"))
    place = F.struct(F.col("ident.doc_id").isNull().alias("last"), F.col("ident.doc_id").alias("doc_id"), F.col("row").alias("row"))
    nodes = scan.groupBy("text_key").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.any_value("n_words").alias("n_words"), F.any_value("sketch").alias("sketch"), F.any_value("words").alias("words"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))

    buckets = nodes.select("node", "n_words", F.explode("sketch").alias("bucket"))
    leads = stored(buckets.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("z")).filter("lead < z").select("bucket", "lead"))
    members = stored(buckets.join(leads, "bucket"))  # bucket, node, n_words, lead
    in_question = members.select("node").distinct().join(nodes.select("node", "text_key", "first"), "node")
    in_question = stored(in_question.withColumn("probe", F.xxhash64("text_key")))
    probed = rows.select(F.col("ident.doc_id").alias("doc_id"), "text", "text_key", F.xxhash64("text_key").alias("probe"))
    probed = probed.mapInArrow(_present(key_filter(in_question, "probe")), "doc_id long, text string, text_key string, probe long")
    texts = stored(probed.join(in_question.select("node", "text_key", "first"), "text_key").filter(F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).select("node", "text"))

    def linked(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return stored(both.select("a", "b", "text_a", "text_b").mapInArrow(_align(similar), "a long, b long"))

    def labelled(table: DataFrame, component: DataFrame) -> DataFrame:
        return table.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))

    of = nodes.join(in_question.select("node"), "node", "left_semi").select("node", "n_words", "words")
    side = lambda table, s, *more: table.select(F.col("node").alias(s), F.col("n_words").alias(f"n_{s}"), F.col("words").alias(f"words_{s}"), *more)

    def in_reach(pairs: DataFrame, *more: str) -> DataFrame:
        """The pairs (lead, b, n) that can be linked, as (a, b). Lengths first: the signatures of most pairs that share a passage alone need not be joined."""
        alike = F.least("n", "n_a") >= similar * F.greatest("n", "n_a") - 1e-9
        near = pairs.join(side(of, "a"), (F.col("lead") == F.col("a")) & alike).drop("lead", "n")
        near = near.join(side(of, "b").withColumnRenamed("b", "other"), (F.col("b") == F.col("other")) & _in_reach(similar, "a", "b"))
        return stored(near.select("a", "b", *more))

    to_lead = members.filter("node <> lead").groupBy("lead", F.col("node").alias("b"), F.col("n_words").alias("n")).agg(F.count("*").alias("shared"))
    to_lead = stored(to_lead)
    # first with the lead that shares most entries: most members of a class are then done
    nearest = to_lead.groupBy("b", "n").agg(F.max(F.struct(F.col("shared"), (-F.col("lead")).alias("lead"))).alias("m")).select((-F.col("m.lead")).alias("lead"), "b", "n")
    tried = in_reach(nearest)
    links = linked(tried)
    component = components(links)

    of_b = labelled(to_lead.select("lead", "n", F.col("b").alias("node")), component).withColumnsRenamed({"node": "b", "component": "of_b"})
    apart = labelled(of_b.withColumnRenamed("lead", "node"), component).filter("component <> of_b").select(F.col("node").alias("lead"), "b", "n")
    more = stored(in_reach(apart).join(tried, ["a", "b"], "left_anti"))
    component = merged(component, linked(more))
    tried = tried.union(more)

    def crowded(component: DataFrame) -> DataFrame:
        """(node, component, outside): nodes of buckets that hold several components, and whether one of these has a larger one."""
        placed = stored(labelled(members.select("bucket", "node"), component))
        # a bucket of two has no further pair
        split = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("z"), F.count("*").alias("n")).filter("x < z and n > 2").select("bucket")
        mixed = stored(placed.join(split, "bucket"))
        main = mixed.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("main")).select("bucket", F.col("main.component").alias("main"))
        return stored(mixed.join(main, "bucket").groupBy("node", "component").agg(F.max(F.col("component") != F.col("main")).alias("outside")))

    rare = stored(rare_words(texts.join(crowded(component).select("node"), "node", "left_semi"), similar))
    for turn in range(TURNS):
        at = labelled(rare, component)
        chosen = at.groupBy("token").agg(F.max_by(F.struct(F.col("node").alias("lead"), F.col("component").alias("of_lead")), F.xxhash64("node", F.lit(turn))).alias("c")).select("token", "c.*")
        met = at.join(chosen, "token").filter("component <> of_lead").groupBy("lead", F.col("node").alias("b")).agg(F.count("*").alias("shared"))
        met = met.join(of.select(F.col("node").alias("b"), F.col("n_words").alias("n")), "b")
        near = in_reach(met, "shared").join(tried, ["a", "b"], "left_anti")
        turned = stored(near.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("m")).select("m.a", "b"))
        component = merged(component, linked(turned))
        tried = tried.union(turned)

    rare = rare.join(crowded(component), "node").join(of, "node")
    outside = side(rare.filter("outside"), "a", "token", F.col("component").alias("of_a"))
    others = side(rare, "b", F.col("token").alias("in"), F.col("component").alias("of_b"), F.col("outside").alias("twice"))
    once = ~F.col("twice") | (F.col("a") < F.col("b"))
    across = outside.join(others, (F.col("token") == F.col("in")) & (F.col("of_a") != F.col("of_b")) & once & _in_reach(similar, "a", "b"))
    across = stored(across.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("shared")))
    across = stored(across.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    # the pair that shares most of each node, then what is still apart
    first = across.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("m")).select("a", "m.b")
    component = merged(component, linked(first))
    left = labelled(across.join(first, ["a", "b"], "left_anti").withColumnRenamed("a", "node"), component).withColumnsRenamed({"node": "a", "component": "of_a"})
    left = labelled(left.withColumnRenamed("b", "node"), component).filter("component <> of_a").select("a", F.col("node").alias("b"))
    component = merged(component, linked(left))

    of_node = labelled(nodes.select("text_key", "node", "first", "copies"), component)
    classes = of_node.groupBy("component").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size"))
    by_text = stored(of_node.select("text_key", "component").join(classes, "component").select("text_key", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("keep_row"), "class_size"))
    return scan.select("row", "ident.*", "text_key", "n_words").join(by_text, "text_key").select(
        "doc_id", "class_id", "class_size", "n_words", (F.col("row") == F.col("keep_row")).alias("kept"), *(["carried"] if keep is not None else [])
    )
