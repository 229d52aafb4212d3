"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.prefix import with_prefix
from larder.llm.store import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all words
MOST_EPOCHS = 2


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, n.cast("int")), "")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """Add ``target`` to one row per source (no_source, source, source_size).

    Sources in code-point order, null last, take the weights in turn. Each gets ``share`` of all words
    by weight, but at most ``most`` times its own; what is above is shared again among the others
    until none is above. That ends where every target is the lesser of its cap and one level times
    its weight, so the level follows from one pass over the sources in order of cap per weight.
    The rows here are sources, not documents.
    """
    place = F.row_number().over(Window.orderBy("no_source", "source")) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    capped = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    rank = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source")
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("no_source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weighing = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # the level if the sources before are capped and this one and all after it are not
    levels = capped.withColumn("level", left / weighing).withColumn("free", F.col("cap") / F.col("weight") >= F.col("level"))
    level = F.max(F.when(F.col("free"), F.col("level"))).over(whole)  # levels rise up to the first free source, then fall
    return levels.select("no_source", "source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: Column | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted).

    Documents of a source are put in the order of a hash of id and text, and taken until the source's
    target is used up to the word: whole epochs first, then one more pass that ends inside the
    document where the budget ends. A document's place comes from prefix sums over ranges of that
    hash, so no task holds a source. ``keep`` adds a struct column that is carried along.

    Null texts have no words; a null source is a source of its own, last in order; a null doc_id
    hashes as empty. Rows equal in id and text stand next to each other in any order. Sources
    without words get 0. An empty table gives no rows.
    """
    rows = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.coalesce(F.col(source), F.lit("")).alias("source"),
            F.col(source).isNull().cast("int").alias("no_source"),
            F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))).alias("key"),
            *([keep.alias("carried")] if keep is not None else []),
        )
    )
    sized = rows.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    goal = targets(sized)
    placed = with_prefix(rows, ["no_source", "source"], "key", ["doc_id"], "size", goal)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - F.col("epochs") * F.col("source_size")
    return (
        placed.withColumn("epochs", epochs)
        .withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))))
        .select("doc_id", "size", "source_size", "target", "taken", *(["carried"] if keep is not None else []))
    )
