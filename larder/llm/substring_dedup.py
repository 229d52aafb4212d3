"""Repeated substrings by level-wise doubling of windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.store import key_filter, may_hold, stored, text_key
from larder.llm.words import SPACED, WORD_BASE, Powers, Texts, slices, window_minima

LENGTH = 50
_EMPTY = hashlib.sha256(b"").hexdigest()


def _joined(t: Texts, keep: np.ndarray) -> list[memoryview]:
    """The kept words of each text, joined by one space."""
    bytes_of = np.zeros(len(t.data) + 1, np.int32)
    bytes_of[t.starts[keep]] += 1
    bytes_of[t.ends[keep]] -= 1
    inside = np.cumsum(bytes_of)[:-1] > 0
    text_of = np.repeat(np.arange(t.rows), np.diff(t.first))[keep]
    kept_ends = t.ends[keep]
    inner = np.append(text_of[1:] == text_of[:-1], False)[: len(kept_ends)]  # not the last of its text
    data = t.data.copy()
    data[kept_ends[inner]] = 0x20  # what follows a word that is not the last is never part of a word
    inside[kept_ends[inner]] = True
    out = data[inside]
    before = np.concatenate([[0], np.cumsum(inside)])
    # bounds in bytes: words of a text begin at its first word
    cut = before[np.append(t.starts, len(t.data))[t.first]]
    cut[-1] = len(out)
    view = memoryview(out)
    return [view[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _anchors(t: Texts, hashes: np.ndarray, length: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of half the length, and for each whole window the index of the half it selects:
    (word positions of the halves, their hashes, selected index per whole window, bounds of the halves)."""
    half = (length + 1) // 2
    at, grams = t.grams(hashes, half, powers)
    bounds = np.concatenate([[0], np.cumsum(np.maximum(np.diff(t.first) - half + 1, 0))])
    return at, grams, window_minima(grams, bounds, length - half + 1), bounds


def _digests(t: Texts, starts: np.ndarray, owner: np.ndarray, length: int) -> list[bytes]:
    """SHA-256, cut to 128 bits, of the words of each window: equal for equal words alone, whatever a text is made of."""
    joined = _joined(t, np.ones(len(t.starts), bool))
    place = np.concatenate([[0], np.cumsum(t.ends - t.starts + 1)])  # where a word begins if each is followed by one space
    begin = place[starts] - place[t.first[owner]]
    end = place[starts + length] - 1 - place[t.first[owner]]
    return [hashlib.sha256(joined[text][a:b]).digest()[:16] for text, a, b in zip(owner.tolist(), begin.tolist(), end.tolist())]


def _first_level(length: int):
    """Arrow task: words, digest and selected half-length windows of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word = Powers(WORD_BASE)
        for batch in batches:
            counts, shas, halves, ats, sizes = [], [], [], [], []
            for t in slices(batch.column("text"), SPACED, lower=False):
                counts.append(np.diff(t.first))
                shas += [hashlib.sha256(x).hexdigest() for x in _joined(t, np.ones(len(t.starts), bool))]
                at, grams, least, _ = _anchors(t, t.hashes(), length, by_word)
                least = np.unique(least)
                owner = np.searchsorted(t.first, at[least], "right") - 1
                halves.append(grams[least].view(np.int64))
                ats.append((at[least] - t.first[owner]).astype(np.int32))
                sizes.append(np.bincount(owner, minlength=t.rows))
            if not len(batch):
                continue
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x))) for x in (halves, ats)]
            names = ["doc_id", "text_key", "n_words", "sha", "halves", "at"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(np.concatenate(counts)), pa.array(shas), *lists], names)

    return run


def _present(bits: np.ndarray):
    """Arrow task: rows whose probe the fixed-size filter may hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(bits, batch.column("probe").to_numpy(zero_copy_only=False))))

    return run


def _second_level(length: int):
    """Arrow task: all windows of the whole length whose selected half is repeated, as digests of their words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word = Powers(WORD_BASE)
        for batch in batches:
            repeated = batch.column("repeated")
            marks, ends = repeated.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(repeated.value_lengths().to_numpy(zero_copy_only=False))])
            for t in slices(batch.column("text"), SPACED, lower=False):
                hashes = t.hashes()
                at, _, least, bounds = _anchors(t, hashes, length, by_word)
                mine = slice(ends[t.row], ends[t.row + t.rows])
                row_of = np.repeat(np.arange(t.rows), np.diff(ends)[t.row : t.row + t.rows])
                alive = np.zeros(len(at) + 1, bool)
                alive[bounds[row_of] + marks[mine]] = True  # a half at word p of a text is the p-th half of it
                starts = t.grams(hashes, length, by_word)[0][alive[least]]
                owner = np.searchsorted(t.first, starts, "right") - 1
                keys = pa.array(_digests(t, starts, owner, length), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [keys, batch.column("doc_id").take(pa.array(owner + t.row)), batch.column("head").take(pa.array(owner + t.row)), pa.array((starts - t.first[owner]).astype(np.int32))],
                    ["window", "doc_id", "head", "at"],
                )

    return run


def _remove(length: int):
    """Arrow task: the words left when all words of the windows ``gone`` are removed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column("gone")
            marks, ends = gone.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(gone.value_lengths().to_numpy(zero_copy_only=False))])
            removed, kept = [], []
            for t in slices(batch.column("text"), SPACED, lower=False):
                row_of = np.repeat(np.arange(t.rows), np.diff(ends)[t.row : t.row + t.rows])
                begin = t.first[row_of] + marks[ends[t.row] : ends[t.row + t.rows]]
                depth = np.zeros(len(t.starts) + 1, np.int64)
                np.add.at(depth, begin, 1)
                np.add.at(depth, begin + length, -1)
                out = np.cumsum(depth)[:-1] > 0
                removed += np.diff(np.concatenate([[0], np.cumsum(out)])[t.first]).tolist()
                kept += [bytes(x).decode("utf-8", "replace") for x in _joined(t, ~out)]
            yield pa.RecordBatch.from_arrays([batch.column("head"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["head", "n_removed", "kept_text"])

    return run


def dedup_substrings(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (only where some words stay and some go), kept_sha256.

    A word is removed if a window of ``length`` consecutive words covers it whose words also start in
    a document with a smaller doc_id. Level by level: windows of half the length are compared first.
    Of all halves in a window only the least hash is looked at, which equal windows select alike, so
    the first level has one row per some thirteen words. A half that stands in one text alone drops
    out with all windows that select it; only around repeated halves are windows of twice that length
    formed, keyed by a digest of their words, and those found in two documents survive. A longer window covers no
    further words, so doubling ends at ``length``.

    Documents of equal words are handled once, by the smallest doc_id: the others lose all words if
    they have ``length`` or more. Groups are aggregates and joins on them have one row per place, so a
    passage in every document makes no pairs.

    A null or empty text has no words. A row with a null doc_id has no order: it keeps its words and
    takes none from others. Rows that repeat a doc_id don't repeat each other. No rows give no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("text_key", text_key(F.coalesce("text", F.lit(""))))
    scan = stored(rows.mapInArrow(_first_level(length), "doc_id long, text_key string, n_words long, sha string, halves array<long>, at array<int>"))
    heads = scan.filter("doc_id is not null").groupBy("sha").agg(F.min(F.struct("doc_id", "text_key")).alias("head"))
    heads = stored(heads.select("sha", "head.*", F.monotonically_increasing_id().alias("head")))
    level = stored(scan.filter(F.size("halves") > 0).join(heads, ["sha", "doc_id", "text_key"]).select("head", "halves", "at"))
    places = level.select("head", F.explode(F.arrays_zip("halves", "at")).alias("p")).select("head", F.col("p.halves").alias("half"), F.col("p.at").alias("at"))
    repeated = stored(places.groupBy("half").agg(F.min("head").alias("a"), F.max("head").alias("z")).filter("a <> z").select("half"))
    alive = places.join(repeated, "half").groupBy("head").agg(F.collect_list("at").alias("repeated"))
    alive = stored(alive.join(heads.drop("sha"), "head").withColumn("probe", F.xxhash64("text_key")))
    probed = rows.withColumn("probe", F.xxhash64("text_key")).mapInArrow(_present(key_filter(alive, "probe")), "doc_id long, text string, text_key string, probe long")
    texts = stored(probed.drop("probe").join(alive.drop("probe"), ["doc_id", "text_key"]))
    windows = texts.select("doc_id", "head", "text", "repeated").mapInArrow(_second_level(length), "window binary, doc_id long, head long, at int")
    first = windows.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    first = stored(first.select("window", "first"))
    gone = windows.join(first, "window").filter("doc_id > first").groupBy("head").agg(F.collect_list("at").alias("gone"))
    cut = texts.select("head", "text").join(gone, "head").mapInArrow(_remove(length), "head long, n_removed long, kept_text string").dropDuplicates(["head"])
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= length)
    head_rows = heads.select("sha", "head", F.col("doc_id").alias("first_id")).join(cut, "head", "left")
    own = (F.col("doc_id") == F.col("first_id")) & F.col("n_removed").isNotNull()
    return (
        scan.select("doc_id", "n_words", "sha")
        .join(head_rows, "sha", "left")
        .select(
            "doc_id", "n_words",
            F.when(copy, F.col("n_words")).when(own, F.col("n_removed")).otherwise(0).alias("n_removed"),
            F.when(own & ~copy, F.col("kept_text")).alias("kept_text"),
            F.when(copy, F.lit(_EMPTY)).when(own, F.sha2("kept_text", 256)).otherwise(F.col("sha")).alias("kept_sha256"),
        )
    )
