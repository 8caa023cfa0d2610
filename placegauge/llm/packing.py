"""Best-fit packing of tokenised documents under several capacities at once.

Documents longer than a sequence are cut; the first piece takes the rest.  A piece asks for tokens,
one document slot and attention cost (its length squared).  Pieces of one length ask for the same,
so vector best-fit runs on the histogram of lengths: pieces from long to short go to the kind of
open bin that scores best among those with room under every capacity, many equal bins at a time.
The plan has at most a few thousand rows whatever the number of documents; every document finds
its place in it from its length and its rank among pieces of that length.

Defined results: a null text is an empty one (its end id alone); repeated rows are packed row by
row; rows with a null doc_id are packed too; an empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placegauge.llm.common import arrow_rows, keep
from placegauge.llm.tokens import END_ID, encoder, read_vocabulary

# Rows that one task ranks.
RANKED_ROWS = 5_000

PIECE = (
    "doc_id bigint, row_key bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
)


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds.  By default only tokens bind: any 1024 tokens are at most 1024
    documents and cost at most 1024 squared."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    score: str = "norm"  # or "dot"

    def limits(self) -> np.ndarray:
        return np.array(
            [self.tokens, self.documents or self.tokens, self.attention or self.tokens**2],
            dtype=np.float64,
        )


def pieces(docs: DataFrame, vocabulary_path: str, longest: int) -> DataFrame:
    """One row per piece with the checksum of its ids; ids themselves are not kept."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    end = END_ID.to_bytes(4, "little")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(shared.value).ids
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            raw = memoryview(ids_of(text.as_py()) + end)
            total = len(raw) // 4
            key = zlib.crc32(raw)
            stop = total % longest or longest
            start = number = 0
            while start < total:
                rows.append(
                    (doc_id.as_py(), key, number, start, stop - start,
                     zlib.crc32(raw[4 * start : 4 * stop]))
                )
                start, stop, number = stop, stop + longest, number + 1
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["doc_id", "row_key", "piece", "start", "length", "ids_crc32"],
        )

    return arrow_rows(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), cut, PIECE)


def plan(histogram: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, first rank, number, first sequence, offset)`` that place every piece.

    Bins that hold the same lengths are one kind with a multiplicity.
    """
    limits = capacity.limits()
    weights = np.array(capacity.weights)
    room = np.zeros((0, 3))  # residual of each kind
    many = np.zeros(0, dtype=np.int64)  # bins of each kind
    held: list[tuple] = []  # (length, first rank) from the bottom, of the kind's first bin
    for length in sorted(histogram, reverse=True):
        asks = np.array([length, 1, length * length], dtype=np.float64)
        if (asks > limits).any():
            raise ValueError(f"a piece of {length} tokens exceeds a sequence")
        rank, left = 0, histogram[length]
        while left:
            fits = np.flatnonzero((room >= asks).all(axis=1) & (many > 0))
            if len(fits):
                if capacity.score == "dot":
                    worth = (weights * room[fits] / limits * asks / limits).sum(axis=1)
                    kind = fits[np.argmax(worth)]
                else:
                    after = (room[fits] - asks) / limits
                    kind = fits[np.argmin((weights * after * after).sum(axis=1))]
                taken = min(left, int(many[kind]))
                content, base = held[kind], room[kind]
                if taken < many[kind]:  # the other bins of this kind stay as they are
                    held[kind] = tuple((n, r + taken) for n, r in content)
                    many[kind] -= taken
                    kind = None
            else:
                per_bin = int((limits // asks).min())
                # Equal bins filled with this length alone; the last one may hold fewer.
                taken, content, base, kind = -(-left // per_bin), (), limits, None
                if taken > 1 and left % per_bin:
                    taken -= 1
                full = min(per_bin, left)
                content = tuple((length, rank + k * taken) for k in range(full - 1))
                base = limits - asks * (full - 1)
                rank += taken * (full - 1)
                left -= taken * (full - 1)
            added = (*content, (length, rank))
            if kind is None:
                room = np.vstack([room, base - asks])
                many = np.append(many, taken)
                held.append(added)
            else:
                room[kind] = base - asks
                held[kind] = added
            rank += taken
            left -= taken
    rows, sequence = [], 0
    for count, content in zip(many.tolist(), held, strict=True):
        offset = 0
        for length, first in content:
            rows.append((length, first, count, sequence, offset))
            offset += length
        sequence += count
    return sorted(rows)


def packed(
    docs: DataFrame, vocabulary_path: str, capacity: Capacity = Capacity()
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    cut = keep(pieces(docs, vocabulary_path, capacity.tokens), "pieces")
    groups = 1 + cut.count() // RANKED_ROWS
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "row_key"), F.lit(groups)))
    # At most `tokens` lengths times the parts.
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = keep(counts, "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = plan(histogram, capacity)
    before = counts.select(
        "length", "part",
        (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"),
    )
    in_part = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "row_key")
    ranked = cut.withColumn("rank", F.row_number().over(in_part) - 1).join(before, ["length", "part"])
    ranked = ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("rank") + F.col("before")).alias("rank"),
    )
    table = np.array(places, dtype=np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = shared.value
        length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        # Ranks stay below 2**40, so length and rank make one sorted key.
        row = np.searchsorted((table[:, 0] << 40) + table[:, 1], (length << 40) + rank, "right") - 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(table[row, 3] + rank - table[row, 1]),
             pa.array(table[row, 4])],
            [*batch.schema.names[:5], "sequence_id", "offset"],
        )

    return arrow_rows(
        ranked, place,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
        "sequence_id bigint, offset bigint",
    )
