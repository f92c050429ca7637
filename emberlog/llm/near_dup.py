"""Operator 9, near-duplicate groups by SetSketch registers.

1. Each text becomes its set of word shingles and a sketch (one narrow pass). Equal sets are one
   class, so copies cost a row each and nothing more.
2. Bands of registers give buckets. In a bucket every member is paired with the bucket's smallest id
   only, so a bucket of n members gives n - 1 pairs and a third of all rows may share one.
3. Pairs are tested on set sizes and on the joint likelihood of their sketches, then confirmed on the
   full sets: the texts of a pair meet in a task that holds one hub's set and streams the members.
4. Links become components. Members whose hub's component does not hold them are then compared with all
   members of the same hub: pair by pair after the same sketch test where a hub has few of them, else in
   blocks, a task holding an index over one block's sets and streaming the members past it. Only links that
   join something new leave a task. So no pair of a bucket that could still join two components goes untested,
   and no list of all pairs is made.

Only texts of buckets with several members can be compared. They are fetched once, into a table that both steps read; the
other texts do not move.

Links, components and sketches stay in tables of the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.sizing import maybe_broadcast
from emberlog.llm.common import give_back, materialize, require
from emberlog.llm.setsketch import REGISTERS, ROWS, band_keys, may_reach, registers, set_digest, shingle_set

PERCENT = 85
SHINGLE = 5
# Members left over that a hub may have to be compared pair by pair; more go in blocks.
FEW = 8
# Members that are compared with one copy of the texts held for them.
MEMBERS_PER_TASK = 500
# Ids that are broadcast to fetch their texts; more of them are joined by shuffle.
BROADCAST_IDS = 2_000_000
# Shingles of one block's index.
BLOCK_SHINGLES = 500_000


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """id, n (set size), s1, s2 (the set's 128-bit name), regs (uint16, binary), bands (array of keys)."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            texts = batch.column(batch.schema.get_field_index("text"))
            n, s1, s2, regs, bands = [], [], [], [], []
            for value in texts:
                shingles = shingle_set(value.as_py(), size)
                r = registers(shingles)
                a, b = set_digest(shingles)
                n.append(len(shingles))
                s1.append(a)
                s2.append(b)
                regs.append(r.tobytes())
                bands.append(band_keys(r))
            flat = np.concatenate(bands) if bands else np.zeros(0, dtype=np.int64)
            offsets = np.arange(len(n) + 1, dtype=np.int32) * (REGISTERS // ROWS)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(regs, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["id", "n", "s1", "s2", "regs", "bands"])
        give_back()

    return docs.mapInArrow(run, f"id {id_type}, n bigint, s1 bigint, s2 bigint, regs binary, bands array<bigint>")


def likely_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(hub, node) pairs that the sketches do not rule out."""
    id_type = nodes.schema["id"].dataType.simpleString()
    side = nodes.select("id", "n", "regs")
    pairs = pairs.join(side.toDF("node", "n2", "r2"), "node").join(side.toDF("hub", "n1", "r1"), "hub")
    pairs = pairs.where(100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            r1, r2 = (np.frombuffer(b"".join(col[c].to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("r1", "r2"))
            keep = may_reach(percent / 100, col["n1"].to_numpy(), col["n2"].to_numpy(), r1, r2)
            yield pa.RecordBatch.from_arrays([col["hub"], col["node"]], names=["hub", "node"]).filter(pa.array(keep))
        give_back()

    return pairs.select("hub", "node", "n1", "r1", "n2", "r2").mapInArrow(run, f"hub {id_type}, node {id_type}")


def wanted_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``docs`` that any comparison can need, as written table."""
    ids = materialize(members.select("id").distinct(), "wanted-ids")
    return materialize(docs.join(maybe_broadcast(ids, BROADCAST_IDS), "id", "left_semi"), "wanted-texts")


def pair_routes(pairs: DataFrame) -> DataFrame:
    """Where to send the texts of (hub, node) pairs; a hub of many members is copied to as many parts as needed."""
    pairs = materialize(pairs, "likely-pairs")
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / MEMBERS_PER_TASK).cast("int").alias("parts"))
    members = pairs.join(parts, "hub").select(
        F.col("node").alias("id"), "hub", F.lit(-1).alias("block"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    hubs = members.select(F.col("hub").alias("id"), "hub", "block", "part").distinct()
    return hubs.withColumn("held", F.lit(0)).unionByName(members.withColumn("held", F.lit(1)))


def linked_texts(routes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(hub, node) links between the texts held by a group (held = 0) and those that stream past (held = 1).

    ``routes`` (id, hub, block, part, held) says to which groups (hub, block, part) a text is sent. A task keeps an
    index over the shingles of the texts held; of the links found it gives those that join something new.
    """
    id_type = docs.schema["id"].dataType.simpleString()
    # One row per document to send, however many groups it goes to; the join carries each text once.
    routes = routes.groupBy("id").agg(F.collect_list(F.struct("hub", "block", "part", "held")).alias("to"))
    sent = docs.join(routes, "id").select("id", "text", F.explode("to").alias("r")).select("id", "text", "r.*")
    sent = sent.repartition("hub", "block", "part").sortWithinPartitions("hub", "block", "part", "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = group = None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if (row["hub"], row["block"], row["part"]) != key:
                    key, group = (row["hub"], row["block"], row["part"]), Held(percent)
                mine = shingle_set(row["text"], size)
                if row["held"] == 0:
                    group.add(row["id"], mine)
                else:
                    found.extend((other, row["id"]) for other in group.new_links(row["id"], mine))
            kind = batch.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], kind), pa.array([y for _, y in found], kind)],
                                             names=["hub", "node"])
        give_back()

    return sent.mapInArrow(run, f"hub {id_type}, node {id_type}").distinct()


class Held:
    """Shingle sets held by a task, and what they are known to be joined with."""

    def __init__(self, percent: int):
        self.percent = percent
        self.ids: list = []
        self.sets: list[np.ndarray] = []
        self.index: tuple[np.ndarray, np.ndarray] | None = None
        self.root: dict = {}

    def add(self, doc_id, shingles: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.sets.append(shingles)
        self.index = None

    def _find(self, x):
        while self.root.setdefault(x, x) != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def new_links(self, doc_id, shingles: np.ndarray) -> list:
        """Held ids linked with this text and not joined with it so far."""
        if not self.ids or not len(shingles):
            return []
        if self.index is None:
            owner = np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])
            flat = np.concatenate(self.sets)
            order = np.argsort(flat, kind="stable")
            self.index = flat[order], owner[order]
            self.sizes = np.array([len(x) for x in self.sets])
        flat, owner = self.index
        lo, hi = np.searchsorted(flat, shingles, "left"), np.searchsorted(flat, shingles, "right")
        n = hi - lo
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(lo - (ends - n), n)
        common = np.bincount(owner[at], minlength=len(self.ids))
        out = []
        for k in np.flatnonzero((common > 0) & (100 * common >= self.percent * (self.sizes + len(shingles) - common))).tolist():
            a, b = self._find(self.ids[k]), self._find(doc_id)
            if a != b:
                self.root[a] = b
                out.append(self.ids[k])
        return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the smallest node reachable.

    Alternating star contraction: every node hands its neighbours to its smallest one until nothing
    changes, a logarithmic number of rounds. Minima combine before the shuffle; the tables of minima
    are written, so adaptive execution may split the edges of a hot node.
    """
    stars = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
        # Larger neighbours move to the smallest; then smaller ones do.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large = materialize(large.unionByName(least.where("a != m").select("a", F.col("m").alias("b"))).distinct(), "large-star")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        stars = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        # Done when nobody has two smaller neighbours and no smallest neighbour has a smaller one itself.
        once = stars.groupBy("a").count().where("count > 1").select("a")
        chained = stars.select(F.col("b").alias("a")).distinct().join(stars.select("a"), "a", "left_semi")
        if once.unionByName(chained).isEmpty():
            return stars.select(F.col("a").alias("node"), F.col("b").alias("label"))


def relabel(labels: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """Labels after more edges; labels hold only nodes that have a smaller one in their component."""
    if labels is not None:
        a, b = labels.toDF("a", "la"), labels.toDF("b", "lb")
        edges = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    found = components(edges)
    if labels is None:
        return found
    moved = labels.join(found.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = found.join(moved.select("node"), "node", "left_anti")
    return materialize(moved.unionByName(fresh), "labels")


def groups_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
              percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable over links of
    100 * intersection >= percent * union; itself included) and kept (id = component_id).

    Null or empty texts and texts without words have an empty set and are linked with nothing. Texts of
    fewer than ``size`` words have one shingle, all their words. A row with a null id takes no part: its
    component is null and it is kept. Rows that repeat an id are one document: linked if any of its texts
    is, and all its rows get the same component. Other columns are not read. An empty table gives an empty result.
    """
    require(docs, id_col, text_col)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(sketches(docs, size), "sketches")
    classes = materialize(
        rows.where("n > 0 AND id IS NOT NULL").groupBy("s1", "s2")
        .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands")), "classes")
    bands = classes.select(F.explode("bands").alias("band"), "id", "n")
    hubs = materialize(bands.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1").select("band", "hub"), "hubs")
    # From here on only buckets of several members matter.
    members = materialize(bands.join(hubs, "band").select("hub", "id", "n").distinct(), "members")
    nodes = classes.select("id", "n", "regs")
    texts = wanted_texts(docs, members)
    pairs = members.where("id != hub").select("hub", F.col("id").alias("node"))
    links = materialize(linked_texts(pair_routes(likely_pairs(pairs, nodes, percent)), texts, size, percent), "links")
    labels = relabel(None, links.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    few, blocks = left_over(members, labels)
    routes = pair_routes(likely_pairs(few, nodes, percent)).unionByName(blocks)
    links = materialize(linked_texts(routes, texts, size, percent), "links")
    if not links.isEmpty():
        labels = relabel(labels, links.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    out = rows.select("id", "n", "s1", "s2").join(classes.select("s1", "s2", F.col("id").alias("node")), ["s1", "s2"], "left")
    # A document of several texts is in the component of its smallest class.
    out = out.join(labels, "node", "left").withColumn("c", F.coalesce("label", "node", "id"))
    out = out.withColumn("c", F.when(F.col("id").isNull(), F.col("id")).otherwise(F.col("c")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"),
                      F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))


def left_over(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is still to be compared after the hubs: members outside their hub's component with all members of the
    hub, as (pairs of hubs with few of them, routes of blocks for the others)."""
    who = members.join(labels.toDF("id", "l"), "id", "left").join(labels.toDF("hub", "hl"), "hub", "left")
    who = who.select("hub", "id", "n", F.coalesce("l", "id").alias("comp"), (F.coalesce("l", "id") != F.coalesce("hl", "hub")).alias("apart"))
    who = materialize(who, "who")
    # A hub with one member was fully compared already.
    busy = materialize(who.groupBy("hub").agg(F.count("*").alias("m"), F.count_if("apart").alias("s"), F.sum(F.when(F.col("apart"), F.col("n"))).alias("size"))
                       .where("s > 0 AND m > 2"), "busy")
    apart = who.where("apart")
    small = busy.where(F.col("s") <= FEW).select("hub")
    pairs = (
        who.join(apart.join(small, "hub").select("hub", F.col("id").alias("s"), F.col("comp").alias("comp1"), F.col("n").alias("n1")), "hub")
        # Between two that are left over once; the hub itself was compared in the first round.
        .where("comp != comp1 AND id != hub AND (NOT apart OR id > s)")
        .select(F.col("s").alias("hub"), F.col("id").alias("node")).distinct()
    )
    large = busy.where(F.col("s") > FEW).select("hub", F.ceil(F.col("size") / BLOCK_SHINGLES).cast("int").alias("blocks"),
                                                F.ceil(F.col("m") / MEMBERS_PER_TASK).cast("int").alias("parts"))
    key = F.xxhash64("id")
    past = who.join(large, "hub").select("id", "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                                         F.pmod(key, "parts").cast("int").alias("part"), F.lit(1).alias("held"))
    held = apart.join(large, "hub").select("id", "hub", F.pmod(key, "blocks").cast("int").alias("block"),
                                           F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("held"))
    return pairs, past.unionByName(held)


def near_duplicates_dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, with all their columns."""
    gone = groups_of(docs, id_col, text_col, **options).where(~F.col("kept")).select(F.col(id_col).alias("__id")).distinct()
    gone = materialize(gone, "near-copies")
    return docs.join(gone, docs[id_col] == gone["__id"], "left_anti")
