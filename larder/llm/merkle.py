"""Merkle manifest of a dataset as postorder append logs.

The leaves of a tree are dealt into aligned blocks of ``SPAN`` consecutive ones. One builder handles a
block: it appends each node to its segment the moment the node is complete, so a segment lists a subtree
in postorder. Where a node stands follows from its level, its index and the number of leaves alone, so
builders need no coordination and proofs find their siblings by arithmetic, without an index. The roots
of the blocks are the leaves of the next tier, until a tree is a single block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.store import stored

WIDTH = 8  # children of a node
DEPTH = 3  # levels that a builder adds
SPAN = WIDTH**DEPTH  # leaves of a block
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: str) -> str:
    """H: lower-case hex SHA-256 of the parts, one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(leaves: int, width: int = WIDTH) -> int:
    """Levels above the leaves of a whole tree: a lone leaf is its own root."""
    height, nodes = 0, leaves
    while nodes > 1:
        height, nodes = height + 1, -(-nodes // width)
    return height


def position(level: int, index: int, leaves: int, height: int, width: int = WIDTH) -> int:
    """Place in the postorder log of a subtree of ``leaves`` leaves that is raised ``height`` levels.

    A node completes with its last leaf. Before that leaf stand all leaves before it and, of each level,
    one node per full subtree among them; then its own ancestors follow from the bottom.
    """
    last = min((index + 1) * width**level, leaves) - 1
    return last + sum(last // width**h for h in range(1, height + 1)) + level


class Segment(NamedTuple):
    """Part of a log: the subtree over some leaves in postorder, as hex digests."""

    leaves: int
    height: int
    nodes: list[str]

    @classmethod
    def build(cls, leaves: list[str], height: int) -> Segment:
        """Append each leaf, then every node that it completes."""
        log: list[str] = []
        open_runs: list[list[str]] = [[] for _ in range(height + 1)]
        for i, leaf in enumerate(leaves, 1):
            log.append(leaf)
            open_runs[0].append(leaf)
            for level in range(height):
                if len(open_runs[level]) < WIDTH and i < len(leaves):
                    break
                node = digest(*open_runs[level])
                open_runs[level] = []
                open_runs[level + 1].append(node)
                log.append(node)
        return cls(len(leaves), height, log)

    @classmethod
    def of(cls, leaves: int, height: int, packed: bytes) -> Segment:
        return cls(leaves, height, [packed[i : i + 32].hex() for i in range(0, len(packed), 32)])

    def packed(self) -> bytes:
        return bytes.fromhex("".join(self.nodes))

    def level(self, level: int) -> list[str]:
        """The nodes of a level in order, found by their positions."""
        count = -(-self.leaves // WIDTH**level)
        return [self.nodes[position(level, i, self.leaves, self.height)] for i in range(count)]

    def paths(self) -> list[list[dict[str, str]]]:
        """For each leaf, level by level, the digests left and right of its ancestor in the ancestor's run."""
        runs = []
        for level in range(self.height):
            nodes = self.level(level)
            runs.append(["".join(nodes[i : i + WIDTH]) for i in range(0, len(nodes), WIDTH)])
        out = []
        for leaf in range(self.leaves):
            path, at = [], leaf
            for level in range(self.height):
                run, place = runs[level][at // WIDTH], at % WIDTH * 64
                path.append({"left": run[:place], "right": run[place + 64 :]})
                at //= WIDTH
            out.append(path)
        return out


def fold(leaf: str, path: Iterable[dict[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for step in path:
        leaf = digest(step["left"], leaf, step["right"])
    return leaf


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` (from 0, by ``order`` within ``tree``) and ``size`` (leaves of the tree).

    Rows are dealt into sampled ranges of (tree, order), numbered inside a range and shifted by the
    counts of the ranges before, so no task holds a tree. The ranges are stored: a rerun of the sampling
    would draw other bounds.
    """
    ranged = stored(leaves.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("tree", "part").agg(F.count("*").alias("n"))
    of_tree = Window.partitionBy("tree")
    counts = counts.select(
        "tree", "part",
        F.coalesce(F.sum("n").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"),
        F.sum("n").over(of_tree).alias("size"),
    )
    inside = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)) - 1
    return ranged.withColumn("inside", inside).join(counts, ["tree", "part"]).withColumn("rank", F.col("shift") + F.col("inside")).drop("part", "shift", "inside")


def _builder(table: pa.Table) -> pa.Table:
    """One aligned block: its segment, and what belongs to its leaves as lists."""
    table = table.sort_by("rank")
    size = table.column("size")[0].as_py()
    leaves = [x.hex() for x in table.column("digest").to_pylist()]
    segment = Segment.build(leaves, DEPTH if size > SPAN else levels(size))
    row = {
        "tree": [table.column("tree")[0].as_py()], "block": [table.column("block")[0].as_py()], "size": [size], "leaves": [len(leaves)], "height": [segment.height],
        "nodes": [segment.packed()], "top": [bytes.fromhex(segment.nodes[-1])], "ids": [table.column("id").to_pylist()], "altered": [table.column("altered").to_pylist()],
    }
    return pa.table(row, pa.schema([("tree", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("leaves", pa.int32()), ("height", pa.int32()), ("nodes", pa.binary()), ("top", pa.binary()), ("ids", pa.list_(pa.int64())), ("altered", pa.list_(pa.binary()))]))


_SEGMENT = "tree string, block long, size long, leaves int, height int, nodes binary, top binary, ids array<long>, altered array<binary>"


class Log(NamedTuple):
    """Stored tiers of segments, lowest first, and the root of each tree (tree, root, size)."""

    tiers: list[DataFrame]
    roots: DataFrame


def append_log(leaves: DataFrame) -> Log:
    """Build the trees over ``leaves``: tree, rank, size, digest (binary), id, altered (null, or another digest of the leaf)."""
    largest = leaves.agg(F.max("size")).first()[0] or 0
    tiers: list[DataFrame] = []
    finished: list[DataFrame] = []
    while True:
        block = leaves.withColumn("block", F.floor(F.col("rank") / SPAN))
        segments = stored(block.groupBy("tree", "block").applyInArrow(_builder, _SEGMENT))
        tiers.append(segments)
        finished.append(segments.filter(F.col("size") <= SPAN).select("tree", F.hex("top").alias("root")))
        if largest <= SPAN:
            break
        largest = -(-largest // SPAN)
        leaves = segments.filter(F.col("size") > SPAN).select(
            "tree", F.col("block").alias("rank"), F.ceil(F.col("size") / SPAN).alias("size"), F.col("top").alias("digest"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("altered")
        )
    roots = finished[0]
    for more in finished[1:]:
        roots = roots.union(more)
    return Log(tiers, roots.select("tree", F.lower("root").alias("root")))


def _steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: the path of each leaf of a segment, from the leaf to the root of all."""
    for batch in batches:
        for row in batch.to_pylist():
            segment = Segment.of(row["leaves"], row["height"], row["nodes"])
            first = row["block"] * SPAN
            path = [own + row["path"] for own in segment.paths()]
            n = len(path)
            yield pa.RecordBatch.from_pydict(
                {"tree": [row["tree"]] * n, "block": list(range(first, first + n)), "path": path},
                pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))]),
            )


def upper_paths(log: Log, above: DataFrame) -> DataFrame:
    """tree, block, path: for each block of the lowest tier the siblings on the way to the root, then those of ``above`` (tree, path)."""
    ends = F.lit(0).cast("long").alias("block")
    upper = None
    for tier in reversed(log.tiers):
        tops = tier.filter(F.col("size") <= SPAN).select("tree").join(above, "tree").select("tree", ends, "path")
        upper = tops if upper is None else tops.union(upper)
        if tier is not log.tiers[0]:
            with_path = tier.select("tree", "block", "leaves", "height", "nodes").join(upper, ["tree", "block"])
            upper = stored(with_path.mapInArrow(_steps, f"tree string, block long, path {_PATH}"))
    return upper


def entries(log: Log) -> DataFrame:
    """tree, tier, position, level, index, digest: every node of every tier with its place in the tier's log."""
    out = None
    for number, tier in enumerate(log.tiers):
        rows = tier.select("tree", F.lit(number).alias("tier"), "block", "size", "leaves", "height", "nodes").mapInArrow(_entries, "tree string, tier int, position long, level int, index long, digest string")
        out = rows if out is None else out.union(rows)
    return out


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            segment, first, size = Segment.of(row["leaves"], row["height"], row["nodes"]), row["block"] * SPAN, row["size"]
            of = [(h, first // WIDTH**h + i, d) for h in range(segment.height + 1) for i, d in enumerate(segment.level(h))]
            height = levels(size)
            yield pa.RecordBatch.from_pydict(
                {
                    "tree": [row["tree"]] * len(of), "tier": [row["tier"]] * len(of), "position": [position(h, i, size, height) for h, i, _ in of],
                    "level": [h for h, _, _ in of], "index": [i for _, i, _ in of], "digest": [d for _, _, d in of],
                },
                pa.schema([("tree", pa.string()), ("tier", pa.int32()), ("position", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())]),
            )


def _proofs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: leaf, digest of its proof, and the root folded from the leaf as it is now."""
    for batch in batches:
        for row in batch.to_pylist():
            segment = Segment.of(row["leaves"], row["height"], row["nodes"])
            leaves, proofs, folded = segment.level(0), [], []
            for leaf, altered, own in zip(leaves, row["altered"], segment.paths()):
                path = own + row["path"]
                proofs.append(digest(*(step[side] for step in path for side in ("left", "right"))))
                folded.append(fold(altered.hex() if altered is not None else leaf, path))
            n = len(leaves)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": row["ids"], "leaf": leaves, "subroot": [row["subroot"]] * n, "root": [row["root"]] * n, "proof_sha256": proofs, "folded_root": folded},
                pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))]),
            )


def field(column: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def ascii_lower(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def manifest(docs: DataFrame) -> tuple[Log, Log]:
    """The log of a tree per language over the documents, and the log of the tree over their roots.

    A leaf digests doc_id, source, lang, n_chars and text; its altered form is that of the tampered
    text. A null language is a tree of its own, before all others.
    """
    doc_id = F.col("doc_id").cast("long")
    leaf = lambda text: F.unhex(F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)), 256))
    tampered = F.crc32(doc_id.cast("string")) % 3 == 0
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang")))
    leaves = stored(docs.select(tree.alias("tree"), doc_id.alias("id"), leaf(F.col("text")).alias("digest"), F.when(tampered, leaf(ascii_lower(F.col("text")))).alias("altered")))
    by_lang = append_log(stored(ranked(leaves, ["id", "digest"])))
    none = [F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("altered")]
    subroots = by_lang.roots.select(F.lit("root").alias("tree"), F.col("tree").alias("lang_tree"), F.unhex("root").alias("digest"))
    return by_lang, append_log(stored(ranked(subroots, ["lang_tree"]).select("tree", "rank", "size", "digest", *none)))


def verify_manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Trees follow languages (ties of doc_id: by leaf; a null doc_id first, and never tampered with).
    The proof of a document are the siblings on its way to the root of its language and on to the root
    of all. ``folded_root`` is what the document as it is now (tampered with or not) and that proof give.

    Nulls count as ``-`` in the leaf, an empty text as ``0:``. Repeated rows are leaves of their own. No
    rows give no rows. Further columns are ignored. A task holds one block of leaves, never a tree.
    """
    by_lang, of_roots = manifest(docs)
    order = ranked(by_lang.roots.select(F.lit("root").alias("tree"), F.col("tree").alias("lang_tree"), F.col("root").alias("subroot")), ["lang_tree"])
    base = upper_paths(of_roots, of_roots.roots.select("tree", F.array().cast(_PATH).alias("path")))
    lowest = of_roots.tiers[0].select("tree", "block", "leaves", "height", "nodes").join(base, ["tree", "block"])
    root_paths = lowest.mapInArrow(_steps, f"tree string, block long, path {_PATH}").select(F.col("block").alias("rank"), "path")
    above = order.join(root_paths, "rank").join(of_roots.roots, "tree")
    above = stored(above.select(F.col("lang_tree").alias("tree"), "subroot", "root", "path"))
    blocks = by_lang.tiers[0].join(upper_paths(by_lang, above.select("tree", "path")), ["tree", "block"]).join(above.select("tree", "subroot", "root"), "tree")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks.repartition(tasks, "tree", "block").mapInArrow(_proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
