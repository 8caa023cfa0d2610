"""Short codes for vectors: each part of a vector is named by the nearest entry of its codebook.

Components become integers, vectors are cut into consecutive parts, and every part position has a
codebook that Lloyd's rounds fit to all parts.  The rounds are dual-tree: blocks of vectors are
written once with a tree over each of their parts (boxes and sums of all nodes), every round builds
a tree over the entries, and both are walked down together.  A pair of nodes goes when the least
distance between its boxes exceeds the largest distance to some other node of entries; a node of
parts that is left with one entry hands that entry its cached sum as a whole; leaves that stay
uncertain compare integers with the entries left to them.  Bounds are integers too and pairs go only
where strictly worse, so ties go to the lower index and all results equal those of plain Lloyd.

A round reads the blocks, sums per entry inside each task, adds the sums up in Spark and takes a
codebook, whose size does not depend on the table, to the driver.

Defined results: a vector that is null, empty or holds a null or non-finite component has no code,
nor has one whose length differs from that of the smallest id (null ids last, ties by components).
Components beyond ``largest`` as integers count as that bound, so no distance overflows; it is 2**27
for 64 dimensions.  Lengths that the parts do not divide make the first parts longer by one.  Repeated
rows count as often as they stand there; an empty table has no codes; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placegauge.llm.common import keep, ship
from placegauge.operators.skew import split_join

LEAF = 32
# Bytes of the integers of a block.
BLOCK_BYTES = 1 << 20


def largest(dims: int) -> int:
    """Bound of the integers for which squared distances of ``dims`` components fit 64 bits."""
    return min(2**30, math.isqrt(2**62 // dims) // 2)


def bounds(total: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive ranges, the first ones longer by one where ``parts`` does not divide."""
    cuts = [0]
    for k in range(parts):
        cuts.append(cuts[-1] + total // parts + (k < total % parts))
    return list(zip(cuts[:-1], cuts[1:], strict=True))


@dataclass
class Tree:
    """A balanced tree over points; node ``k`` has the children ``2k + 1`` and ``2k + 2``.

    ``points`` stand in the order of the leaves and ``order`` says where they came from; a node
    holds those from ``begin`` to ``end``, in a box from ``low`` to ``high``, with their ``sums``.
    """

    order: np.ndarray
    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @property
    def leaves(self) -> int:
        """Number of the first leaf."""
        return len(self.begin) // 2


def tree(points: np.ndarray, leaf: int) -> Tree:
    """Halve the points at the median of their widest component while ``leaf`` or more stay each."""
    n, dims = points.shape
    depth = (max(1, n // leaf)).bit_length() - 1
    nodes = 2 ** (depth + 1) - 1
    begin, end = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    low, high, sums = (np.zeros((nodes, dims), np.int64) for _ in range(3))
    order = np.arange(n)
    end[0] = n
    for k in range(nodes):
        part = order[begin[k] : end[k]]
        here = points[part]
        low[k], high[k], sums[k] = here.min(0), here.max(0), here.sum(0)
        if k < nodes // 2:
            middle = len(part) // 2
            if dims:
                widest = int(np.argmax(high[k] - low[k]))
                part = part[np.argpartition(here[:, widest], middle)]
            order[begin[k] : end[k]] = part
            begin[2 * k + 1], end[2 * k + 1] = begin[k], begin[k] + middle
            begin[2 * k + 2], end[2 * k + 2] = begin[k] + middle, end[k]
    return Tree(order, points[order], begin, end, low, high, sums)


def nearest(parts: Tree, entries: Tree) -> tuple[list[tuple[int, int]], list[tuple[int, np.ndarray]]]:
    """Nodes of parts with their one nearest entry, and leaves with the entries left to them."""
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    single = entries.end - entries.begin == 1
    whole, uncertain = [], []
    while True:
        gap = np.maximum(parts.low[p] - entries.high[e], entries.low[e] - parts.high[p])
        least = (np.maximum(gap, 0) ** 2).sum(1)
        most = (np.maximum(parts.high[p] - entries.low[e], entries.high[e] - parts.low[p]) ** 2).sum(1)
        # Pairs of one node of parts stand together.
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        bound = np.minimum.reduceat(most, starts)
        left = least <= np.repeat(bound, np.diff(np.r_[starts, len(p)]))
        p, e = p[left], e[left]
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        sizes = np.diff(np.r_[starts, len(p)])
        final = e >= entries.leaves
        decided = (sizes == 1) & single[e[starts]]
        whole += zip(p[starts[decided]].tolist(), e[starts[decided]].tolist(), strict=True)
        ended = ~decided & (p[starts] >= parts.leaves) & np.logical_and.reduceat(final, starts)
        for at in np.flatnonzero(ended):
            uncertain.append((int(p[starts[at]]), e[starts[at] : starts[at] + sizes[at]]))
        open_ = np.repeat(~decided & ~ended, sizes)
        p, e = p[open_], e[open_]
        if not len(p):
            break
        # Children of both; a leaf stays itself.
        p_leaf, e_leaf = p >= parts.leaves, e >= entries.leaves
        p_next = np.stack([np.where(p_leaf, p, 2 * p + 1), np.where(p_leaf, p, 2 * p + 2)], 1)
        e_next = np.stack([np.where(e_leaf, e, 2 * e + 1), np.where(e_leaf, e, 2 * e + 2)], 1)
        p, e = np.repeat(p_next, 2, axis=1).ravel(), np.tile(e_next, 2).ravel()
        _, once = np.unique(p * len(entries.begin) + e, return_index=True)  # sorted by node of parts
        p, e = p[once], e[once]
    numbers = entries.order
    return (
        [(node, int(numbers[entries.begin[k]])) for node, k in whole],
        [
            (node, np.sort(np.concatenate([numbers[entries.begin[k] : entries.end[k]] for k in ks])))
            for node, ks in uncertain
        ],
    )


def assigned(parts: Tree, node: int, left: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """The nearest of the ``left`` entries for every point of a leaf, lower indexes first."""
    points, chosen = parts.points[parts.begin[node] : parts.end[node]], codebook[left]
    span = int(max(np.abs(points).max(initial=0), np.abs(chosen).max(initial=0)))
    # Doubles hold integers below 2**53, and their products run faster.
    kind = np.float64 if 4 * points.shape[1] * span * span < 2**53 else np.int64
    a, b = points.astype(kind), chosen.astype(kind)
    return left[np.argmin((b * b).sum(1) - 2 * (a @ b.T), axis=1)]


BLOCK = pa.struct([("order", pa.binary()), ("points", pa.binary()), ("nodes", pa.binary())])


def packed_tree(t: Tree) -> dict[str, bytes]:
    nodes = np.concatenate([t.begin[:, None], t.end[:, None], t.low, t.high, t.sums], axis=1)
    return {
        "order": t.order.astype(np.int32).tobytes(),
        "points": t.points.astype(np.int32).tobytes(),
        "nodes": nodes.tobytes(),
    }


def unpacked_tree(row: dict[str, bytes], dims: int) -> Tree:
    nodes = np.frombuffer(row["nodes"], np.int64).reshape(-1, 2 + 3 * dims)
    return Tree(
        np.frombuffer(row["order"], np.int32),
        np.frombuffer(row["points"], np.int32).astype(np.int64).reshape(-1, dims),
        nodes[:, 0],
        nodes[:, 1],
        *np.split(nodes[:, 2:], 3, axis=1),
    )


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """``(id, label, x)`` of the vectors that have finite components only, ``x`` as integers."""
    finite = F.forall(
        "vector", lambda z: z.isNotNull() & ~F.isnan(z) & (F.abs(z.cast("double")) < float("inf"))
    )
    size = F.size("vector")
    # The bound of the integers for the length of this very vector.
    clean = vectors.where(F.col("vector").isNotNull() & (size > 0)).where(finite)
    return clean.select(
        "id",
        "label",
        F.transform("vector", lambda z: F.floor(z.cast("double") * float(scale)).cast("double")).alias("x"),
    )


def bounded(rows: DataFrame, dims: int) -> DataFrame:
    """Rows of one length, as integers within the bound."""
    most = float(largest(dims))
    return rows.where(F.size("x") == dims).withColumn(
        "x", F.transform("x", lambda z: F.greatest(F.lit(-most), F.least(F.lit(most), z)).cast("int"))
    )


def blocks(rows: DataFrame, dims: int, parts: int) -> DataFrame:
    """Blocks of vectors, each row with the ids, the labels and a tree over each of the parts."""
    ship(rows.sparkSession)
    block = max(LEAF, BLOCK_BYTES // (4 * dims))
    ranges = bounds(dims, parts)
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)),
            T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)),
            T.StructField(
                "trees",
                T.ArrayType(T.StructType([T.StructField(f.name, T.BinaryType()) for f in BLOCK])),
            ),
        ]
    )

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            n = table.num_rows
            x = table.column("x").chunk(0).flatten().to_numpy().astype(np.int64).reshape(n, dims)
            trees = [packed_tree(tree(x[:, low:high], LEAF)) for low, high in ranges]
            one = pa.array([0, n], pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(one, table.column("id").chunk(0)),
                    pa.ListArray.from_arrays(one, table.column("label").chunk(0)),
                    pa.array([trees], pa.list_(BLOCK)),
                ],
                names=["ids", "labels", "trees"],
            )

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= block:
                table = pa.Table.from_batches(held)
                yield out(table.slice(0, block))
                held = table.slice(block).to_batches()
        if sum(b.num_rows for b in held):
            yield out(pa.Table.from_batches(held))

    return rows.select("id", "label", "x").mapInArrow(built, schema)


def _sums(trees: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """``(slot, total)``: sums and counts of all entries; a slot is an entry and a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [tree(c, 1) for c in codebooks]
        totals = [np.zeros((len(c), c.shape[1] + 1), np.int64) for c in codebooks]
        for batch in batches:
            for row in batch.column(0):
                for row_tree, book, of, total in zip(row.as_py(), codebooks, entries, totals, strict=True):
                    parts = unpacked_tree(row_tree, book.shape[1])
                    whole, uncertain = nearest(parts, of)
                    for node, entry in whole:
                        total[entry, :-1] += parts.sums[node]
                        total[entry, -1] += parts.end[node] - parts.begin[node]
                    for node, left in uncertain:
                        near = assigned(parts, node, left, book)
                        np.add.at(total[:, :-1], near, parts.points[parts.begin[node] : parts.end[node]])
                        np.add.at(total[:, -1], near, 1)
        flat = np.concatenate([t.ravel() for t in totals])
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(used, pa.int64()), "total": pa.array(flat[used])})

    found = trees.select("trees").mapInArrow(run, "slot long, total long")
    return found.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def fitted(trees: DataFrame, codebooks: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The codebooks after so many rounds of assigning all parts and replacing all entries."""
    for _ in range(rounds):
        sizes = [c.shape[0] * (c.shape[1] + 1) for c in codebooks]
        flat = [0] * sum(sizes)
        for slot, total in _sums(trees, codebooks).collect():  # as long as the codebooks at most
            flat[slot] = int(total)
        after, at = [], 0
        for book, size in zip(codebooks, sizes, strict=True):
            new, width = book.copy(), book.shape[1] + 1
            for k in range(len(book)):
                *sums, count = flat[at + k * width : at + (k + 1) * width]
                if count:
                    new[k] = [s // count for s in sums]
            after.append(new)
            at += size
        codebooks = after
    return codebooks


def coded(trees: DataFrame, codebooks: list[np.ndarray], schema: T.StructType) -> DataFrame:
    """``(id, label, code, error)`` of every vector in the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [tree(c, 1) for c in codebooks]
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels, rows = (batch.column(c)[k] for c in range(3))
                codes = np.zeros((len(ids), len(codebooks)), np.uint8)
                error = np.zeros(len(ids), np.int64)
                for at, (row, book, of) in enumerate(zip(rows.as_py(), codebooks, entries, strict=True)):
                    parts = unpacked_tree(row, book.shape[1])
                    near = np.zeros(len(ids), np.int64)
                    whole, uncertain = nearest(parts, of)
                    for node, entry in whole:
                        near[parts.begin[node] : parts.end[node]] = entry
                    for node, left in uncertain:
                        near[parts.begin[node] : parts.end[node]] = assigned(parts, node, left, book)
                    codes[parts.order, at] = near
                    error[parts.order] += ((parts.points - book[near]) ** 2).sum(1)
                text, width = codes.tobytes().hex(), 2 * len(codebooks)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values,
                        labels.values,
                        pa.array([text[i : i + width] for i in range(0, len(text), width)], pa.string()),
                        pa.array(error),
                    ],
                    names=["id", "label", "code", "error"],
                )

    return trees.select("ids", "labels", "trees").mapInArrow(run, schema)


def compressed(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> tuple[DataFrame, list[np.ndarray]]:
    """``(id, label, code, error)`` of ``vectors(id, label, vector)``, and the codebooks.

    ``code`` names an entry a part by two hex digits each; ``error`` is the squared distance, summed
    over the parts.  The codebooks start as the parts of the smallest ids.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry is named by two hex digits")
    rows = keep(integers(vectors, scale), "codes-integers")
    schema = T.StructType(
        [
            rows.schema["id"],
            rows.schema["label"],
            T.StructField("code", T.StringType()),
            T.StructField("error", T.LongType()),
        ]
    )
    by_id = [F.asc_nulls_last("id"), F.col("x")]
    first = rows.orderBy(*by_id).limit(1).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], schema), []
    dims = len(first[0]["x"])
    rows = bounded(rows, dims)
    start = np.array([r["x"] for r in rows.orderBy(*by_id).limit(entries).collect()], np.int64)
    trees = keep(blocks(rows, dims, parts), "codes-blocks")
    codebooks = fitted(trees, [start[:, low:high] for low, high in bounds(dims, parts)], rounds)
    return coded(trees, codebooks, schema), codebooks


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``label_error`` beside every row: the errors of its label summed, null labels together."""
    codes = keep(
        codes.select(
            "*",
            F.col("label").isNull().alias("unlabelled"),
            F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name"),
        ),
        "codes",
    )
    sums = codes.groupBy("unlabelled", "name").agg(
        F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error")
    )
    # A label may hold most of the rows.
    return split_join(codes, sums, ["unlabelled", "name"], F.col("id"), "left").drop("unlabelled", "name")
