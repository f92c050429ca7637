"""Operator 11, vector codes: each part of a vector as the index of its nearest codebook entry.

The codebooks come from rounds of assigning and averaging, done exactly on whole numbers over metric trees:

1. The vectors are cut into blocks. For each block and part position a tree of balls is built from the middle: about
   sqrt(n) anchors, each new one at the farthest point of the widest ball and taking over the points nearer to it
   (those within half the distance of the two anchors cannot be and are not looked at); anchors are joined upwards, the closest
   pair first, and divided downwards in the same way. A ball caches the number and the sum of its points. Blocks are written once.
2. In a round every block passes its trees from the top with the list of candidate entries. An entry leaves the list where
   another one is nearer to every point of the ball; the shorter list is handed down. A ball with one candidate left
   adds its cached sum and count to that entry; points of undivided balls are compared with the candidates that are left.
3. Only counts and sums per entry are shuffled, and only entries (parts x entries) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import give_back, materialize, require

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
# Vectors of a block, and points of a ball that is not divided further.
BLOCK = 2048
LEAF = 48
# Squared distances of a part stay below this, so that whole numbers of 64 bits hold them.
DISTANCE_LIMIT = 2**62

_FAR = np.iinfo(np.int64).max


@dataclass
class Balls:
    """A tree over points. A ball holds the points ``first`` to ``last`` of the order; undivided ones have ``left`` = -1."""

    points: np.ndarray  # in tree order
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    right: np.ndarray
    center: np.ndarray
    reach2: np.ndarray  # squared radius around the center, exact
    sums: np.ndarray
    placed: np.ndarray  # which point stands where in the tree order


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("...i,...i->...", d, d)


def anchors(points: np.ndarray, count: int) -> list[np.ndarray]:
    """Cut points into at most ``count`` groups around anchors; fewer when points coincide."""
    owner = np.zeros(len(points), dtype=np.int64)
    pivots = [points[0]]
    dist2 = squared(points, points[0])
    while len(pivots) < count:
        # The farthest point of the widest ball.
        far = int(np.argmax(dist2))
        if dist2[far] == 0:
            break
        new = points[far]
        apart2 = squared(np.array(pivots), new)
        # A point within half the distance between its anchor and the new one is not nearer to the new one.
        maybe = np.flatnonzero(4.0 * dist2 >= apart2[owner] * (1 - 1e-9))
        d = squared(points[maybe], new)
        taken = d < dist2[maybe]
        owner[maybe[taken]] = len(pivots)
        dist2[maybe[taken]] = d[taken]
        pivots.append(new)
    return [np.flatnonzero(owner == k) for k in range(len(pivots))]


def grow(points: np.ndarray) -> Balls:
    """The tree of a block's points of one part position."""
    nodes: list[tuple[int, int]] = []  # (left, right), children before parents
    held: list[np.ndarray | None] = []  # the points of undivided balls

    def leaf(idx: np.ndarray) -> int:
        nodes.append((-1, -1))
        held.append(idx)
        return len(nodes) - 1

    def build(idx: np.ndarray) -> int:
        if len(idx) <= LEAF:
            return leaf(idx)
        groups = anchors(points[idx], int(np.ceil(np.sqrt(len(idx)))))
        if len(groups) == 1:
            return leaf(idx)
        tops = [build(idx[g]) for g in groups]
        middle = np.array([points[idx[g]].mean(axis=0) for g in groups])
        wide = np.array([np.sqrt(squared(points[idx[g]], m).max()) for g, m in zip(groups, middle)])
        weight = np.array([len(g) for g in groups], dtype=np.float64)
        # Join the pair that makes the smallest ball, again and again.
        size = np.sqrt(squared(middle[:, None], middle[None])) + wide[:, None] + wide[None]
        np.fill_diagonal(size, np.inf)
        for _ in range(len(groups) - 1):
            a, b = np.unravel_index(np.argmin(size), size.shape)
            nodes.append((tops[a], tops[b]))
            held.append(None)
            tops[a] = len(nodes) - 1
            wide[a] = max(size[a, b] / 2, wide[a], wide[b])
            middle[a] = (weight[a] * middle[a] + weight[b] * middle[b]) / (weight[a] + weight[b])
            weight[a] += weight[b]
            size[b, :] = size[:, b] = np.inf
            row = np.sqrt(squared(middle, middle[a])) + wide + wide[a]
            row[a] = np.inf
            row[np.isinf(size[a])] = np.inf
            size[a, :] = size[:, a] = row
        return tops[int(np.argmax(weight))]

    top = build(np.arange(len(points)))
    # Number the balls from the top and lay their points side by side.
    n, d = len(nodes), points.shape[1]
    first, last = np.zeros(n, np.int32), np.zeros(n, np.int32)
    left, right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    order: list[np.ndarray] = []
    number = {top: 0}
    used, at, stack = 1, 0, [(top, False)]
    while stack:
        node, done = stack.pop()
        k = number[node]
        if done:
            last[k] = at
            continue
        first[k] = at
        a, b = nodes[node]
        if a < 0:
            order.append(held[node])
            at += len(held[node])
            last[k] = at
            continue
        number[a], number[b] = used, used + 1
        left[k], right[k] = used, used + 1
        used += 2
        stack += [(node, True), (b, False), (a, False)]
    placed = np.concatenate(order)
    mine = points[placed]
    total = np.zeros((len(mine) + 1, d), np.int64)
    np.cumsum(mine, axis=0, out=total[1:])
    sums = total[last] - total[first]
    center = sums // (last - first)[:, None]
    reach2 = np.array([squared(mine[f:l], c).max() for f, l, c in zip(first, last, center)], dtype=np.int64)
    return Balls(mine, first, last, left, right, center, reach2, sums, placed)


def settle(balls: Balls, entries: np.ndarray, sums: np.ndarray, counts: np.ndarray, owners: np.ndarray | None = None) -> None:
    """Add the points of a tree to the entries that own them (``sums``, ``counts``), and note the owners in tree order."""
    among2 = squared(entries[:, None], entries[None])
    nodes, lists = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    index = np.arange(len(entries))
    open_nodes, open_lists = [], []
    while len(nodes):
        d2 = squared(balls.center[nodes][:, None], entries[None])
        masked = np.where(lists, d2, _FAR)
        best = masked.argmin(axis=1)
        ahead = masked - masked[np.arange(len(nodes)), best][:, None]
        # |x-e|^2 - |x-b|^2 over the ball is at least what it is at the center less twice radius times distance of e and b.
        room = 2 * np.sqrt(balls.reach2[nodes].astype(np.float64))[:, None] * np.sqrt(among2[best].astype(np.float64))
        farther = ahead > room * (1 + 1e-9)
        level = (room == 0) & (ahead >= 0) & (index[None] > best[:, None])
        lists = lists & ~farther & ~level
        lists[np.arange(len(nodes)), best] = True
        alone = lists.sum(axis=1) == 1
        if alone.any():
            own, who = nodes[alone], best[alone]
            np.add.at(sums, who, balls.sums[own])
            np.add.at(counts, who, balls.last[own] - balls.first[own])
            if owners is not None:
                for k, e in zip(own, who):
                    owners[balls.first[k]:balls.last[k]] = e
        rest, kept = nodes[~alone], lists[~alone]
        whole = balls.left[rest] < 0
        open_nodes.append(rest[whole])
        open_lists.append(kept[whole])
        inner, kept = rest[~whole], kept[~whole]
        nodes, lists = np.concatenate([balls.left[inner], balls.right[inner]]).astype(np.int64), np.concatenate([kept, kept])
    nodes, lists = np.concatenate(open_nodes), np.concatenate(open_lists)
    if not len(nodes):
        return
    n = (balls.last[nodes] - balls.first[nodes]).astype(np.int64)
    ends = np.cumsum(n)
    at = np.arange(ends[-1]) + np.repeat(balls.first[nodes] - (ends - n), n)
    lists = np.repeat(lists, n, axis=0)
    points = balls.points[at]
    least, who = np.full(len(at), _FAR), np.zeros(len(at), np.int64)
    for e in range(len(entries)):
        rows = np.flatnonzero(lists[:, e])
        d2 = squared(points[rows], entries[e])
        nearer = d2 < least[rows]
        least[rows[nearer]] = d2[nearer]
        who[rows[nearer]] = e
    np.add.at(sums, who, points)
    np.add.at(counts, who, 1)
    if owners is not None:
        owners[at] = who


_TREE = [("placed", np.int32), ("points", np.int32), ("first", np.int32), ("last", np.int32), ("left", np.int32), ("right", np.int32),
         ("center", np.int32), ("reach2", np.int64), ("sums", np.int64)]
_TREE_DDL = "array<struct<" + ",".join(f"{n}:binary" for n, _ in _TREE) + ">>"


def packed(b: Balls) -> dict:
    return {n: np.ascontiguousarray(getattr(b, n), dtype=t).tobytes() for n, t in _TREE}


def unpacked(row: dict, dims: int) -> Balls:
    values = {n: np.frombuffer(row[n], dtype=t) for n, t in _TREE}
    for n in ("points", "center", "sums"):
        values[n] = values[n].reshape(-1, dims).astype(np.int64)
    return Balls(**values)


def whole_numbers(vectors: pa.Array, scale: int, parts: int) -> np.ndarray:
    """floor(scale * x) of every component, one row for each vector."""
    lengths = np.unique(pc.list_value_length(vectors).to_numpy(zero_copy_only=False))
    if len(lengths) != 1 or lengths[0] == 0 or lengths[0] % parts:
        raise ValueError(f"vectors must be of one length, a multiple of {parts}; found lengths {lengths[:5].tolist()}")
    x = np.floor(pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False) * scale).reshape(-1, int(lengths[0]))
    if 4.0 * (lengths[0] // parts) * np.abs(x).max() ** 2 >= DISTANCE_LIMIT or np.abs(x).max() >= 2**31:
        raise ValueError(f"components are too large for exact distances: {np.abs(x).max() / scale}")
    return x.astype(np.int64)


def least_ids(ids: pa.Array, count: int) -> list:
    return pc.unique(ids.drop_null()).sort()[:count].to_pylist()


def block_trees(rows: DataFrame, parts: int, entries: int, scale: int) -> DataFrame:
    """One row for each block of vectors: ids, labels, dims (of a part), trees, and seeds (its smallest ids with their vectors).

    ``rows``: id, label, vector; no vector holds null or non-finite components."""
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                ids, labels, vectors = (batch.column(batch.schema.get_field_index(c)).slice(at, BLOCK) for c in ("id", "label", "vector"))
                x = whole_numbers(vectors, scale, parts)
                dims = x.shape[1] // parts
                trees = [packed(grow(x[:, p * dims:(p + 1) * dims])) for p in range(parts)]
                seeds = []
                for i in least_ids(ids, entries):
                    mine = x[pc.fill_null(pc.equal(ids, pa.scalar(i, ids.type)), False).to_numpy(zero_copy_only=False)]
                    seeds.append({"id": i, "vector": mine[np.lexsort(mine.T[::-1])[0]].tolist()})
                values = {"ids": ids.to_pylist(), "labels": labels.to_pylist(), "dims": dims, "trees": trees, "seeds": seeds}
                kinds = {"ids": pa.list_(ids.type), "labels": pa.list_(labels.type), "dims": pa.int32(),
                         "trees": pa.list_(pa.struct([(n, pa.binary()) for n, _ in _TREE])),
                         "seeds": pa.list_(pa.struct([("id", ids.type), ("vector", pa.list_(pa.int64()))]))}
                yield pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for k, v in values.items()], names=list(values))
        give_back()

    return rows.select("id", "label", "vector").mapInArrow(
        run, f"ids array<{id_type}>, labels array<{label_type}>, dims int, trees {_TREE_DDL}, seeds array<struct<id:{id_type},vector:array<bigint>>>")


def first_codebooks(blocks: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Parts of the vectors of the smallest ids; of an id's several vectors the first in the order of their components."""
    seeds = blocks.select(F.explode("seeds").alias("s")).groupBy("s.id").agg(F.min("s.vector").alias("vector"))
    rows = seeds.orderBy("id").limit(entries).collect()
    if not rows:
        return None
    x = np.array([r["vector"] for r in rows], dtype=np.int64)
    return x.reshape(len(rows), parts, -1).transpose(1, 0, 2).copy()


def next_codebooks(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part to its nearest entry, every entry to the floor of the mean of its parts."""
    parts, entries, dims = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            trees = batch.column(0)
            for k in range(batch.num_rows):
                for p, tree in enumerate(trees[k].as_py()):
                    settle(unpacked(tree, dims), books[p], sums[p], counts[p])
        part, entry, place = (a.ravel() for a in np.indices((parts, entries, dims + 1)))
        totals = np.concatenate([sums, counts[:, :, None]], axis=2).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in (part, entry, place, totals)], names=["part", "entry", "place", "total"])
        give_back()

    found = blocks.select("trees").mapInArrow(run, "part bigint, entry bigint, place bigint, total bigint")
    totals = np.zeros((parts, entries, dims + 1), dtype=np.int64)
    for r in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect():
        totals[r["part"], r["entry"], r["place"]] = r["total"]
    counts = totals[:, :, -1:]
    return np.where(counts > 0, totals[:, :, :-1] // np.maximum(counts, 1), books)


def codes_of(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code and error of every vector."""
    parts, _, dims = books.shape
    id_type, label_type = (blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                n = len(row.column("ids")[0])
                codes, errors = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                for p, tree in enumerate(row.column("trees")[0].as_py()):
                    balls = unpacked(tree, dims)
                    owners = np.zeros(n, np.int64)
                    settle(balls, books[p], np.zeros(books.shape[1:], np.int64), np.zeros(books.shape[1], np.int64), owners)
                    codes[balls.placed, p] = owners
                    errors[balls.placed] += squared(balls.points, books[p][owners])
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [row.column("ids").flatten(), row.column("labels").flatten(),
                     pa.array([text[2 * parts * i:2 * parts * (i + 1)] for i in range(n)]), pa.array(errors)], names=["id", "label", "code", "error"])
        give_back()

    return blocks.select("ids", "labels", "trees").mapInArrow(run, f"id {id_type}, label {label_type}, code string, error bigint")


def codebooks_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def decoded(codes: DataFrame, books: np.ndarray, code_col: str = "code", out: str = "vector", scale: int = SCALE) -> DataFrame:
    """The vectors that the codes stand for."""
    parts, entries, dims = books.shape
    table = F.lit(books.reshape(-1).tolist())
    at = F.concat(*[F.slice(table, (F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int") + p * entries) * dims + 1, dims) for p in range(parts)])
    return codes.withColumn(out, F.transform(at, lambda x: x / scale))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(codes, codebooks): for each kept row id, code (two hex digits for each part), error (squared distances summed over the
    parts) and label_error (error summed over the rows of its label, null labels together); the codebooks as
    array of parts x entries x dims.

    Rows whose vector is null or holds null or non-finite components are dropped. The others must be of one length, a
    multiple of ``parts`` and not 0, and small enough for exact distances (about 10**5 at 8 dims a part): else an error says so. With
    fewer than ``entries`` ids there are fewer entries; ties go to the lower index. Rows that repeat an id are all coded; a null id is coded but
    starts no entry (without any id there is nothing to start from, an error). Other columns are not read, whatever their names. An empty
    table gives no rows and codebooks of no entry.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    require(vectors, id_col, vector_col, label_col)
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    blocks = materialize(block_trees(rows.where(F.col("vector").isNotNull() & finite), parts, entries, scale), "vector-trees")
    least, most = blocks.agg(F.min("dims"), F.max("dims")).first()
    if least != most:
        raise ValueError(f"vectors must be of one length; found {parts * least} and {parts * most}")
    books = first_codebooks(blocks, parts, entries)
    if books is None and least is not None:
        raise ValueError("no row has an id to start the codebooks from")
    if books is None:
        books = np.zeros((parts, 0, 0), np.int64)
        coded = rows.where(F.lit(False)).select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    else:
        for _ in range(rounds):
            books = next_codebooks(blocks, books)
        coded = materialize(codes_of(blocks, books), "vector-codes")
    key = F.struct("label")
    sums = coded.groupBy(key.alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.withColumn("of", key).join(sums, "of")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error"), books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(codebooks_text(books).encode("ascii")).hexdigest()
