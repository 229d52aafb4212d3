"""License scan: base phrases, and notices found by an exact set-similarity join."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.words import PLAIN, Texts, slices

CONTAINED = 0.8  # share of a template's distinct words that a block must hold
MAX_TEMPLATES = 5000  # the catalog goes to every task, so its size is checked

# Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Wording of common notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

_MATCH = "array<struct<label:string,template:int,start:int,end:int,contained:double>>"
_MATCH_ARROW = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("contained", pa.float64())]))


def _words(text: str) -> list[bytes]:
    return next(([t.data[s:e].tobytes() for s, e in zip(t.starts, t.ends)] for t in slices(pa.array([text]), PLAIN, lower=True)), [])


class Vocabulary:
    """Ids of a fixed set of words, looked up by 64-bit hash and length."""

    def __init__(self, words: Iterable[bytes]):
        self.words = sorted(set(words))
        one = pa.array([w.decode() for w in self.words], pa.string())
        hashes = np.concatenate([t.hashes() for t in slices(one, PLAIN, lower=True)] or [np.zeros(0, np.uint64)])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.lengths = np.array([len(w) for w in self.words])[self.order]
        self.low = np.zeros(1 << 16, bool)  # the low bits that occur: spares most words the search
        self.low[hashes & np.uint64(0xFFFF)] = True

    def places(self, t: Texts, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word positions, ids) of the words that belong to the vocabulary."""
        at = np.flatnonzero(self.low[hashes & np.uint64(0xFFFF)])
        slot = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = (self.hashes[slot] == hashes[at]) & (self.lengths[slot] == t.ends[at] - t.starts[at])
        return at[same], self.order[slot[same]]


def _frequency(vocabulary: Vocabulary):
    """Arrow task: for each vocabulary word, the texts of a batch that hold it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(vocabulary.words)
        for batch in batches:
            total = np.zeros(n, np.int64)
            for t in slices(batch.column("text"), PLAIN, lower=True):
                at, ids = vocabulary.places(t, t.hashes())
                owner = np.searchsorted(t.first, at, "right") - 1
                total += np.bincount(np.unique(owner * n + ids) % n, minlength=n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total)], ["word", "texts"])

    return run


class _Template:
    def __init__(self, number: int, label: str, words: list[bytes], ids: dict[bytes, int], rank: np.ndarray, contained: float):
        self.number, self.label = number, label
        self.ids = sorted({ids[w] for w in words}, key=lambda i: rank[i])  # rarest first
        self.need = ceil(contained * len(self.ids) - 1e-9)
        self.prefix = self.ids[: len(self.ids) - self.need + 1]
        # words that a block may have at most: the notice in full, and as much again
        self.stride = len(words)


def _scan(phrases: tuple[tuple[str, str], ...], templates: list[tuple[int, str, str]], vocabulary: Vocabulary, rank: np.ndarray, contained: float):
    """Arrow task: base phrases and template blocks of each text."""
    ids = {w: i for i, w in enumerate(vocabulary.words)}
    catalog = [_Template(n, label, _words(text), ids, rank, contained) for n, label, text in templates]
    sizes = {template.number: len(template.ids) for template in catalog}
    by_prefix: dict[int, list[_Template]] = {}
    for template in catalog:
        for word in template.prefix:
            by_prefix.setdefault(word, []).append(template)
    rare = np.zeros(len(vocabulary.words), bool)
    rare[list(by_prefix)] = True
    wanted = [(label, [ids[w] for w in _words(phrase)]) for phrase, label in phrases]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_base = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            first, last = np.full(len(batch), np.iinfo(np.int64).max), np.full(len(batch), -1)
            base, found = [set() for _ in range(len(batch))], [[] for _ in range(len(batch))]
            for t in slices(batch.column("text"), PLAIN, lower=True):
                n_words[t.row : t.row + t.rows] = np.diff(t.first)
                at, word = vocabulary.places(t, t.hashes())
                for label, phrase in wanted:
                    begin = np.flatnonzero(word == phrase[0])
                    for i, follow in enumerate(phrase[1:], 1):
                        begin = begin[begin + i < len(at)]
                        begin = begin[(word[begin + i] == follow) & (at[begin + i] == at[begin] + i)]
                    owner = np.searchsorted(t.first, at[begin], "right") - 1
                    inside = at[begin] + len(phrase) <= t.first[owner + 1]
                    rows, starts = owner[inside] + t.row, at[begin][inside] - t.first[owner[inside]]
                    np.add.at(n_base, rows, 1)
                    np.minimum.at(first, rows, starts)
                    np.maximum.at(last, rows, starts)
                    for row in np.unique(rows):
                        base[row].add(label)
                hits = np.flatnonzero(rare[word])
                owners = np.searchsorted(t.first, at[hits], "right") - 1
                tried = set()
                for hit, doc in zip(hits.tolist(), owners.tolist()):
                    place = at[hit] - t.first[doc]
                    for template in by_prefix[word[hit]]:
                        for block in {place // template.stride, max(place // template.stride - 1, 0)}:
                            if (doc, template.number, block) in tried:
                                continue
                            tried.add((doc, template.number, block))
                            lo = t.first[doc] + block * template.stride
                            hi = min(lo + 2 * template.stride, t.first[doc + 1])
                            if hi - lo < template.need:  # length filter
                                continue
                            a, b = np.searchsorted(at, (lo, hi))
                            own = sorted(set(word[a:b].tolist()), key=lambda w: rank[w])
                            # positional filter: the rarest common word is no earlier than the first of the prefix that the block holds
                            mine = set(own)
                            lead = next(j for j, w in enumerate(template.ids) if w in mine)
                            if min(len(template.ids) - lead, len(own) - own.index(template.ids[lead])) < template.need:
                                continue
                            common = mine.intersection(template.ids)
                            if len(common) >= template.need:
                                spots = at[a:b][np.isin(word[a:b], list(common))] - t.first[doc]
                                found[t.row + doc].append({"label": template.label, "template": template.number, "start": int(spots[0]), "end": int(spots[-1]) + 1, "contained": len(common) / len(template.ids)})
            found = [_best(x, sizes) if len(x) > 1 else x for x in found]
            none = last < 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n_words), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                    pa.array([",".join(sorted(x)) for x in base]), pa.array(found, _MATCH_ARROW),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "matches"],
            )

    return run


def _best(matches: list[dict], sizes: dict[int, int]) -> list[dict]:
    """The matches that no overlapping one beats: by the share of the template's words, then by how many these are.

    Notices of a family differ in a word or two, so a block that holds one whole holds most of the others.
    """
    strength = lambda m: (m["contained"], sizes[m["template"]])
    active: list[int] = []
    order = sorted(range(len(matches)), key=lambda i: matches[i]["start"])
    beaten = set()
    for i in order:
        active = [j for j in active if matches[j]["end"] > matches[i]["start"]]
        for j in active:
            if strength(matches[j]) != strength(matches[i]):
                beaten.add(min((i, j), key=lambda k: strength(matches[k])))
        active.append(i)
    return [m for i, m in enumerate(matches) if i not in beaten]


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, contained: float = CONTAINED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, matches.

    ``matches`` lists the blocks that hold at least ``contained`` of the distinct words of a template,
    of overlapping ones the best (``_best``). Blocks are runs of twice a template's length in words at every multiple of its length, so
    a notice of that length lies whole in one of them, however its lines are wrapped. The join is
    exact: words are ordered by the number of texts that hold them, counted over all documents; a
    block is compared with a template only where it holds a word of the template's prefix, its rarest
    words of which a match must have one; blocks too short, or whose place in both orders leaves too
    few common words, are skipped; the rest is counted in full.

    Templates are a catalog of ``MAX_TEMPLATES`` at most, shipped to every task; a larger one is scanned
    in several calls. Null and empty texts
    have no words, so nothing is found; null first_word and last_word then. Rows are judged each for
    itself, so repeated rows repeat their result. Templates without words are ignored. No rows give no rows.
    """
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; scan them in calls of {MAX_TEMPLATES} at most")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    numbered = [(i, label, body) for i, (label, body) in enumerate(templates) if _words(body)]
    vocabulary = Vocabulary(w for _, body in [*((label, body) for _, label, body in numbered), *((label, phrase) for phrase, label in phrases)] for w in _words(body))
    counted = rows.select("text").mapInArrow(_frequency(vocabulary), "word long, texts long").groupBy("word").agg(F.sum("texts").alias("texts"))
    texts = np.zeros(len(vocabulary.words), np.int64)
    for r in counted.collect():  # one row per vocabulary word at most
        texts[r.word] = r.texts
    rank = np.empty(len(texts), np.int64)
    rank[np.lexsort((np.arange(len(texts)), texts))] = np.arange(len(texts))
    schema = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, matches {_MATCH}"
    return rows.mapInArrow(_scan(phrases, numbered, vocabulary, rank, contained), schema)
