"""Operator 13, Merkle manifest of a dataset with a witness for every row.

A tree stands over each source: its leaves in the order of their ids, runs of FANOUT nodes hashed to the next level
until one is left; the sources' roots, in the order of their names, are the leaves of one more tree.

1. Leaves are cut into aligned blocks of FANOUT ** LEVELS consecutive ones. A block is appended to leaf by leaf: a new
   leaf's witness is attached to the subtrees that are still open, and grows by the run of its siblings whenever
   one of them is completed. The runs are shared, so a witness is a list of (run, own place).
2. The blocks' roots are appended to the next tree in the same way, in blocks again, until one block holds all. A round
   divides the rows by FANOUT ** LEVELS (4,096), so no task and no driver holds more than a block.
3. Each block then gets its root's witness of the rounds above, and every leaf's witness is extended by it.

A block's table row keeps the leaves and their ids; runs below its root are made again from these when the
witnesses of the rounds above are known, so that no witness is ever stored for each leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import ascii_lower, give_back, materialize, require
from emberlog.operators.ranking import with_rank

FANOUT = 16
# Levels of a block: FANOUT ** LEVELS nodes.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


class Witness:
    """What leads from a leaf to the root: at each level the run of siblings, itself included, and its place there."""

    __slots__ = ("steps",)

    def __init__(self, steps=()):
        self.steps: list[tuple[tuple[str, ...], int]] = list(steps)

    def extend(self, run: tuple[str, ...], place: int) -> None:
        self.steps.append((run, place))

    def proof(self) -> str:
        """Digest of all siblings, level by level, left to right."""
        h = hashlib.sha256()
        for run, place in self.steps:
            h.update("".join(run[:place]).encode("ascii"))
            h.update("".join(run[place + 1:]).encode("ascii"))
        return h.hexdigest()

    def fold(self, leaf: str) -> str:
        """The root that ``leaf`` leads to with these siblings."""
        for run, place in self.steps:
            leaf = digest([*run[:place], leaf, *run[place + 1:]])
        return leaf


class Tree:
    """A tree that is appended to. ``open`` holds, level by level, the nodes of the run that is not complete yet, each with
    the witnesses below it."""

    def __init__(self, levels: int | None = None):
        # Of a tree that is a block of a larger one the height is given; alone it ends at a single node.
        self.levels = levels
        self.open: list[list[tuple[str, list[Witness]]]] = [[]]

    def append(self, node: str, below: list[Witness] | None = None) -> list[Witness]:
        witnesses = [Witness()] if below is None else below
        self._add(0, node, witnesses)
        return witnesses

    def _add(self, level: int, node: str, witnesses: list[Witness]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((node, witnesses))
        if len(self.open[level]) == FANOUT and level != self.levels:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run = tuple(n for n, _ in self.open[level])
        every = []
        for place, (_, witnesses) in enumerate(self.open[level]):
            for w in witnesses:
                w.extend(run, place)
            every.extend(witnesses)
        self.open[level] = []
        self._add(level + 1, digest(list(run)), every)

    def root(self) -> str:
        """Complete what is open, from below, and give the root."""
        level = 0
        while True:
            above = any(self.open[level + 1:])
            if level == self.levels or (self.levels is None and not above and len(self.open[level]) == 1):
                return self.open[level][0][0]
            if self.open[level]:
                self._complete(level)
            level += 1


def grown(leaves: bytes, levels: int | None, witnessed: bool = True) -> tuple[str, list[Witness]]:
    """Root and witnesses of a block of leaves (32 bytes each); ``levels`` as in Tree."""
    tree = Tree(levels)
    found = []
    for at in range(0, len(leaves), 32):
        found += tree.append(leaves[at:at + 32].hex(), None if witnessed else [])
    return tree.root(), found


def field(value: Column) -> Column:
    """``-`` if null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(fields: tuple[str, ...], **changed: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(changed.get(c, F.col(f"`{c}`"))) for c in fields]), 256))


def blocks_of(nodes: DataFrame, levels: int) -> DataFrame:
    """One row for each block of FANOUT ** ``levels`` consecutive nodes: grp, block, alone (it is the whole group), root, ids, leaves and
    folds (32 bytes for each node).

    ``nodes``: grp, place (from 0 in the group), of (nodes in the group), id, leaf, fold.
    """
    types = {c: nodes.schema[c].dataType.simpleString() for c in ("grp", "id")}
    size = FANOUT ** levels
    dealt = nodes.withColumn("block", F.expr(f"place div {size}"))
    dealt = dealt.repartition("grp", "block").sortWithinPartitions("grp", "block", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = key = None
        alone, ids, leaves, folds = False, [], [], []

        def closed() -> pa.RecordBatch:
            data, other = b"".join(leaves), b"".join(folds)
            root, _ = grown(data, None if alone else levels, witnessed=False)
            values = (*key, alone, bytes.fromhex(root), ids, data, other)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, kinds)], schema=kinds)

        for batch in batches:
            if kinds is None:
                t = {f.name: f.type for f in batch.schema}
                kinds = pa.schema([("grp", t["grp"]), ("block", pa.int64()), ("alone", pa.bool_()), ("root", pa.binary()),
                                   ("ids", pa.list_(t["id"])), ("leaves", pa.binary()), ("folds", pa.binary())])
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("grp", "block", "of", "id", "leaf", "fold"))
            for g, b, of, i, leaf, fold in zip(*columns):
                if (g, b) != key:
                    if key is not None:
                        yield closed()
                    key, alone, ids, leaves, folds = (g, b), of <= size, [], [], []
                ids.append(i)
                leaves.append(leaf)
                folds.append(fold)
        if key is not None:
            yield closed()
        give_back()

    return dealt.select("grp", "block", "of", "id", "leaf", "fold").mapInArrow(
        run, f"grp {types['grp']}, block bigint, alone boolean, root binary, ids array<{types['id']}>, leaves binary, folds binary")


_STEPS = pa.list_(pa.struct([("run", pa.list_(pa.string())), ("place", pa.int32())]))
_STEPS_DDL = "array<struct<run:array<string>,place:int>>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.RecordBatch]]:
    """Blocks one by one; a batch holds many."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0], batch


def with_above(blocks: DataFrame, levels: int) -> DataFrame:
    """``blocks`` with steps (the witness of the block's root in the tree of its group, or null) and top (that tree's root)."""
    if blocks.where("NOT alone").isEmpty():
        return blocks.withColumn("steps", F.lit(None).cast(_STEPS_DDL)).withColumn("top", F.col("root"))
    many = blocks.where("NOT alone").select("grp", "block", "root")
    sizes = many.groupBy(F.struct("grp").alias("g")).agg((F.max("block") + 1).alias("of"))
    roots = many.withColumn("g", F.struct("grp")).join(sizes, "g").select(
        "grp", F.col("block").alias("place"), "of", F.col("block").alias("id"), F.col("root").alias("leaf"), F.col("root").alias("fold"))
    above = witnesses(roots, levels).select(F.struct("grp", F.col("id").alias("block")).alias("at"), "steps", "top")
    joined = blocks.withColumn("at", F.struct("grp", "block")).join(above, "at", "left").drop("at")
    return joined.withColumn("top", F.coalesce("top", "root"))


def witnesses(nodes: DataFrame, levels: int) -> DataFrame:
    """(grp, id, steps, top) of every node: its witness as runs and places, and the root of its group, as written table."""
    grp, node = nodes.schema["grp"].dataType.simpleString(), nodes.schema["id"].dataType.simpleString()
    blocks = with_above(materialize(blocks_of(nodes, levels), "merkle-blocks"), levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, batch in _rows(batches):
            _, found = grown(row["leaves"], None if row["alone"] else levels)
            steps = [[{"run": r, "place": p} for r, p in w.steps] + (row["steps"] or []) for w in found]
            n, kinds = len(row["ids"]), {f.name: f.type for f in batch.schema}
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["grp"]] * n, kinds["grp"]), pa.array(row["ids"], kinds["ids"].value_type), pa.array(steps, _STEPS),
                 pa.array([row["top"]] * n, pa.binary())], names=["grp", "id", "steps", "top"])
        give_back()

    return materialize(blocks.select("grp", "alone", "ids", "leaves", "steps", "top").mapInArrow(
        run, f"grp {grp}, id {node}, steps {_STEPS_DDL}, top binary"), "merkle-witnesses")


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS,
             fold_text: Column | None = None, text_col: str = "text", levels: int = LEVELS) -> DataFrame:
    """One row for each row of ``docs``: id, leaf, subroot (of its source), root (of all), proof_sha256 (digest of the
    siblings of its witness), folded_root and verified (the leaf folded with its witness gives the root).

    ``fold_text``, when given, is the text that the fold starts from instead of ``text_col``: a check of rows that may have changed.

    A null field is ``-`` in its leaf, an empty text ``0:``; texts of any length are hashed whole. Null sources are one source,
    the first; null ids come first in theirs, and rows that repeat an id stand in the order of their leaves (equal leaves are equal
    rows). A source of one row has its leaf as subroot, and a table of one source the subroot as root. Columns other than
    ``fields`` are not read, whatever their names. An empty table gives no rows.
    """
    require(docs, id_col, source_col, *fields)
    leaf = row_digest(fields)
    fold = leaf if fold_text is None else row_digest(fields, **{text_col: fold_text})
    rows = docs.select(F.col(f"`{source_col}`").alias("grp"), F.col(f"`{id_col}`").alias("id"), leaf.alias("leaf"), fold.alias("fold"))
    placed = with_rank(rows, ["id", "leaf"], ["grp"], rank_col="place", total_col="of")
    blocks = with_above(materialize(blocks_of(placed, levels), "merkle-leaves"), levels)
    # The sources' roots are appended to a tree of their own.
    sources = blocks.where("block = 0").select("grp", "top")
    sources = with_rank(sources.select(F.lit(0).alias("all"), "grp", "top"), ["grp"], ["all"], rank_col="place", total_col="of")
    over = witnesses(sources.select(F.col("all").alias("grp"), "place", "of", F.col("grp").alias("id"), F.col("top").alias("leaf"), F.col("top").alias("fold")), levels)
    over = over.select(F.struct(F.col("id").alias("grp")).alias("at"), F.col("steps").alias("last_steps"), F.col("top").alias("all_root"))
    blocks = blocks.withColumn("at", F.struct("grp")).join(over, "at").drop("at")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, batch in _rows(batches):
            _, found = grown(row["leaves"], None if row["alone"] else levels)
            above = [(s["run"], s["place"]) for s in (row["steps"] or []) + (row["last_steps"] or [])]
            leaves, proofs, folded = [], [], []
            for k, w in enumerate(found):
                for step in above:
                    w.extend(*step)
                leaves.append(row["leaves"][32 * k:32 * k + 32].hex())
                proofs.append(w.proof())
                folded.append(w.fold(row["folds"][32 * k:32 * k + 32].hex()))
            n, root = len(leaves), row["all_root"].hex()
            ids = pa.array(row["ids"], batch.schema.field("ids").type.value_type)
            texts = [pa.array(v, pa.string()) for v in (leaves, [row["top"].hex()] * n, [root] * n, proofs, folded)]
            yield pa.RecordBatch.from_arrays([ids, *texts, pa.array([f == root for f in folded], pa.bool_())],
                                             names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
        give_back()

    out = blocks.select("alone", "ids", "leaves", "folds", "steps", "top", "last_steps", "all_root").mapInArrow(
        run, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def tampered(id_col: str = "doc_id", text_col: str = "text", share: int = 5) -> Column:
    """The text with A-Z lower-cased where ``share`` divides the unsigned CRC-32 of the decimal id."""
    hit = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % share == 0
    return F.when(hit, ascii_lower(F.col(f"`{text_col}`"))).otherwise(F.col(f"`{text_col}`"))
