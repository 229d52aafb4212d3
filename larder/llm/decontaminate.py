"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.store import key_filter, may_hold, stored
from larder.llm.words import PLAIN, WORD_BASE, Powers, mix, slices, window_minima

SPAN = 13  # every shared run of this many words is found
GRAM = 7  # words in a fingerprint; each window of SPAN - GRAM + 1 grams keeps its least

_HIT = pa.struct([("gram", pa.int64()), ("need", pa.int32()), ("lead", pa.int32()), ("words", pa.list_(pa.string())), ("at", pa.list_(pa.int32()))])
_SCHEMA = "row long, id {id}, n_words long, hits array<struct<gram:long,need:int,lead:int,words:array<string>,at:array<int>>>"


def _scanner(span: int, gram: int, short: frozenset[int], bits: np.ndarray | None):
    """Arrow task: per text its number of words and fingerprints in context.

    A fingerprint comes with the words around it, as far as a run of ``span`` words over it can
    reach. ``short`` lengths are taken at every place too: items of fewer than ``span`` words match
    as a whole only. Without ``bits`` (the benchmark side) a text gives its own windows: winnowed
    grams, or the whole text if it is short. With ``bits`` only what the other side may hold is kept.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word = Powers(WORD_BASE)
        row = (TaskContext.get().partitionId() << 33) - 1
        for batch in batches:
            counts, found = np.zeros(len(batch), np.int64), [None] * len(batch)
            for t in slices(batch.column("text"), PLAIN, lower=True):
                n_words = np.diff(t.first)
                counts[t.row : t.row + t.rows] = n_words
                hashes = t.hashes()
                owner = np.repeat(np.arange(t.rows), n_words)
                spots = []  # (gram, need, position, words before, words from there)
                at, grams = t.grams(hashes, gram, by_word)
                bounds = np.concatenate([[0], np.cumsum(np.maximum(n_words - gram + 1, 0))])
                least = np.unique(window_minima(grams, bounds, span - gram + 1))
                spots.append((grams[least], span, at[least], span - gram, span))
                own = {int(n) for n in np.unique(n_words) if 0 < n < span} if bits is None else short
                for n in sorted(own):
                    at, grams = t.grams(hashes, n, by_word)
                    if bits is None:
                        whole = n_words[owner[at]] == n
                        at, grams = at[whole], grams[whole]
                    spots.append((grams ^ mix(np.full(1, n, np.uint64)), n, at, 0, n))
                for grams, need, at, before, after in spots:
                    keys = grams.view(np.int64)
                    if bits is not None:
                        hit = may_hold(bits, keys)
                        keys, at = keys[hit], at[hit]
                    for key, place in zip(keys.tolist(), at.tolist()):
                        doc = owner[place]
                        lo, hi = max(t.first[doc], place - before), min(t.first[doc + 1], place + after)
                        context = tuple(t.data[s:e].tobytes() for s, e in zip(t.starts[lo:hi], t.ends[lo:hi]))
                        places = found[t.row + doc] = found[t.row + doc] or {}
                        places.setdefault((key, need, place - lo, context), []).append(place - t.first[doc])
            hits = pa.array(
                [[{"gram": g, "need": n, "lead": x, "words": [w.decode("utf-8", "replace") for w in c], "at": p} for (g, n, x, c), p in (d or {}).items()] for d in found],
                pa.list_(_HIT),
            )
            rows = np.arange(row + 1, row + 1 + len(batch))
            row += len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("id"), pa.array(counts), hits], ["row", "id", "n_words", "hits"])

    return run


def _matched(left: Column, right: Column) -> Column:
    """Length of the common beginning of two arrays of words."""
    same = F.zip_with(left, right, lambda a, b: a.eqNullSafe(b))
    differs = F.array_position(same, F.lit(False)).cast("int")
    return F.when(differs == 0, F.size(same)).otherwise(differs - 1)


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM, keep: Column | None = None) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted distinct ids as strings), spans of hit words.

    A word is hit if it lies in a run of ``span`` words that stands in an item too, or in an occurrence
    of a whole item of fewer words. Winnowing: of every ``span - gram + 1`` consecutive grams the least
    hash is a fingerprint, on both sides, so any common run of ``span`` words has a common one.
    Fingerprints carry the words around them; they are joined with those of the items, and a join is
    kept if its words, compared as text, agree over ``span`` words. A fixed-size bitmap of the item
    fingerprints drops the others before the shuffle. A fingerprint that many documents hold is one
    row per document and context, against one row per item that has it.

    Null and empty texts have no words; items without words match nothing. Repeated items count once
    by id, a null item_id is not counted. Rows that repeat a doc_id are judged each for itself. Either
    table may be empty. ``keep`` adds a struct column that is carried along.
    """
    schema = _SCHEMA.format(id=dict(items.dtypes)[item_id])
    theirs = stored(items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).mapInArrow(_scanner(span, gram, frozenset(), None), schema))
    prints = stored(theirs.select("id", F.explode("hits").alias("h")).select(F.col("id").alias("item_id"), "h.gram", "h.need", "h.lead", "h.words").distinct())
    short = frozenset(r.need for r in prints.filter(F.col("need") < span).select("need").distinct().collect())  # at most span - 1 lengths
    bits = key_filter(prints, "gram")
    ident = F.struct(F.col(doc_id).alias("doc_id"), *([keep.alias("carried")] if keep is not None else []))
    asked = docs.select(ident.alias("id"), F.col(text).alias("text"))
    ours = stored(asked.mapInArrow(_scanner(span, gram, short, bits), _SCHEMA.format(id=dict(asked.dtypes)["id"])))
    hits = ours.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    left = lambda words, lead: F.reverse(F.slice(words, 1, lead))
    right = lambda words, lead: F.slice(words, lead + 1, span)
    mine, other = hits.withColumnsRenamed({"words": "my_words", "lead": "my_lead"}), prints
    joined = mine.join(other, ["gram", "need"]).select(
        "row", "item_id", "need", "at",
        _matched(left(F.col("my_words"), F.col("my_lead")), left(F.col("words"), F.col("lead"))).alias("before"),
        _matched(right(F.col("my_words"), F.col("my_lead")), right(F.col("words"), F.col("lead"))).alias("after"),
    )
    real = joined.filter((F.col("before") + F.col("after") >= F.col("need")) & (F.col("after") >= F.least(F.col("need"), F.lit(gram))))
    real = stored(real)
    spans = real.select("row", F.explode("at").alias("at"), "before", "after").select("row", (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("end")).distinct()
    in_doc = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = spans.withColumn("reached", F.coalesce(F.max("end").over(in_doc), F.lit(0)))
    words = covered.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = real.select("row", F.col("item_id").cast("string").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return (
        ours.select("row", "id.*", "n_words")
        .join(words, "row", "left")
        .join(named, "row", "left")
        .select("doc_id", *(["carried"] if keep is not None else []), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")
    )


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """The rule: at least a twentieth of the words are hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)
