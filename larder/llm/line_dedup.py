"""Repeated runs of lines by winnowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.stage import once
from larder.llm.store import stored, text_key

MIN_RUN = 1  # lines that a repeated run has at least
_WORD = r"[^\x20\x09-\x0D]"
_UNIT = rf"\n(?=[\x20\x09\x0B-\x0D]*{_WORD})"  # the line break before a line that is not blank
LAST = (1 << 63) - 1


def _window_minima(hashes: Column, width: int) -> Column:
    """For each window of ``width`` lines (from 0), the index of its rightmost least hash."""
    def least(i: Column) -> Column:
        part = F.slice(hashes, i + 1, width)
        return i + width - F.array_position(F.reverse(part), F.array_min(part)).cast("int")

    return F.transform(F.sequence(F.lit(0), F.size(hashes) - width), least)


def _line(unit: Column) -> Column:
    return F.substring_index(unit, "\n", 1)


def line_windows(docs: DataFrame, min_run: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, doc_key, at, fingerprint, window: one row per window of ``min_run`` lines, blank ones left out.

    Blank lines belong to the line before them; only a text that begins with one has a blank first line,
    and windows on that are no rows.
    """
    lined = docs.filter(F.col(text).isNotNull()).select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc_id"), text_key(F.col(text)).alias("doc_key"), F.transform(F.split(text, _UNIT, -1), _line).alias("lines")
    )
    lined = lined.filter(F.size("lines") >= min_run).withColumn("hashes", F.transform("lines", lambda line: F.xxhash64(line)))
    windows = F.transform(
        _window_minima(F.col("hashes"), min_run),
        lambda least, i: F.struct(
            i.alias("at"),
            F.element_at(F.col("hashes"), least + 1).alias("fingerprint"),
            text_key(F.array_join(F.slice("lines", i + 1, min_run), "\n")).alias("window"),
        ),
    )
    from_line = F.when(F.element_at("lines", 1).rlike(_WORD), 0).otherwise(1)
    return lined.select("doc_id", "doc_key", F.explode(F.filter(windows, lambda w: w["at"] >= from_line)).alias("w")).select("doc_id", "doc_key", "w.*")


def repeated_runs(docs: DataFrame, min_run: int = MIN_RUN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal repeated runs: doc_id, doc_key, first_line, n_lines, source_doc, source_line.

    Lines are hashed, and each window of ``min_run`` lines selects its rightmost least hash, so equal
    runs of that length select the same fingerprint whatever surrounds them. Fingerprints counted once
    drop out. Around the others, the positions of a window are joined with its first place in order of
    (doc_id, text, line); matches of neighbouring windows on one diagonal are then extended both ways
    into runs. A fingerprint that stands in every document costs one aggregate row and one join row
    per place, never a pair of places.
    """
    windows = stored(line_windows(docs, min_run, doc_id, text))
    if min_run > 1:
        # a fingerprint of one window position in one document alone cannot repeat
        shared = stored(windows.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint"))
        windows = windows.join(shared, "fingerprint")
    placed = windows.select("window", F.struct("doc_id", "doc_key", "at").alias("place"))
    first = stored(placed.groupBy("window").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first < last").select("window", "first"))
    later = placed.join(first, "window").filter("place > first").select("place.*", F.col("first.doc_id").alias("source_doc"), F.col("first.doc_key").alias("source_key"), F.col("first.at").alias("source_at"))
    by_diagonal = ["doc_id", "doc_key", "source_doc", "source_key", "diagonal"]
    order = Window.partitionBy(*by_diagonal).orderBy("at")
    return (
        later.withColumn("diagonal", F.col("at") - F.col("source_at"))
        .withColumn("island", F.col("at") - F.row_number().over(order))
        .groupBy(*by_diagonal, "island")
        .agg(F.min("at").alias("first_line"), (F.max("at") - F.min("at") + min_run).alias("n_lines"), F.min("source_at").alias("source_line"))
        .select("doc_id", "doc_key", "first_line", "n_lines", "source_doc", "source_line")
    )


def dedup_lines(docs: DataFrame, min_run: int = MIN_RUN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_runs, kept_text (null where the text is null).

    A line is removed if it lies in a run of ``min_run`` or more lines whose sequence stands at an
    earlier place, in order of (doc_id, line); the first place always stays. Blank lines are no lines of
    a run: they are passed over in comparing, and go with the line before them. So a break between
    paragraphs stays while a paragraph before it does. Runs are judged on the input, not on what is left,
    and may overlap their own source inside one document. With a least run of one line each line is the
    minimum of its own window; longer ones select fewer fingerprints than lines.

    A null text has 0 lines; an empty one has one blank line, which stays. A null doc_id comes last in
    order. Documents that share a doc_id are ordered by the digest of their text; rows equal in both are
    one document, so they don't repeat each other. An empty table gives no rows.
    """
    runs = repeated_runs(docs, min_run, doc_id, text)
    gone = runs.groupBy("doc_id", "doc_key").agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence("first_line", F.col("first_line") + F.col("n_lines") - 1)))).alias("gone"),
        F.count("*").alias("n_runs"),
    )
    rows = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc_id"), text_key(F.coalesce(F.col(text), F.lit(""))).alias("doc_key"), F.col(text).alias("body")
    )
    joined = once(rows.join(gone, ["doc_id", "doc_key"], "left"), units=F.split("body", _UNIT, -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("units") - 1), F.col("gone").cast("array<int>"))
    cut = once(joined, left=F.transform(stay, lambda i: F.element_at("units", i + 1)))
    breaks = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\n")))
    whole = F.col("body").isNull() | F.col("gone").isNull()
    lines_left = F.aggregate("left", F.lit(0), lambda n, unit: n + breaks(unit) + 1)
    n_lines = F.when(F.col("body").isNull(), 0).otherwise(breaks(F.col("body")) + 1)
    return cut.select(
        F.col("id").alias("doc_id"),
        n_lines.cast("long").alias("n_lines"),
        F.when(whole, 0).otherwise(n_lines - lines_left).cast("long").alias("n_removed"),
        F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
        F.when(whole, F.col("body")).otherwise(F.array_join("left", "\n")).alias("kept_text"),
    )
