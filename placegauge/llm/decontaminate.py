"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are word sequences of one length.  A shift table over pairs of neighbouring words tells
how far the search may move without missing a pattern; where the shift is zero, the bucket of
that pair (the suffix of the window) holds the patterns to compare word by word.

Defined results: a null or empty text has no words and no hits; repeated rows are searched row by
row; items without words own no window; equal windows of several items count for each of them;
rows with a null item_id are no items.  No benchmark rows: nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegauge.llm.common import alnum_words, arrow_rows, lists

WINDOW = 10
# Bytes of benchmark text in one broadcast; more text is searched in further passes.
BLOCK_BYTES = 2_000_000

SCHEMA = "row_key binary, doc_id bigint, n_words bigint, hits array<bigint>, items array<bigint>"


@dataclass
class Search:
    """Tables of one pattern length: shifts, buckets by last pair, owners of each pattern."""

    length: int
    shifts: dict[int, int] = field(default_factory=dict)
    buckets: dict[int, list[tuple]] = field(default_factory=dict)
    owners: dict[tuple, set] = field(default_factory=dict)

    def add(self, pattern: tuple, item: int, base: int) -> None:
        if pattern in self.owners:
            self.owners[pattern].add(item)
            return
        self.owners[pattern] = {item}
        if self.length == 1:
            self.buckets.setdefault(pattern[0], []).append(pattern)
            return
        for end in range(1, self.length):
            pair = pattern[end - 1] * base + pattern[end]
            left = self.length - 1 - end
            self.shifts[pair] = min(left, self.shifts.get(pair, left))
        self.buckets.setdefault(pair, []).append(pattern)

    def find(self, ids: list[int], base: int) -> Iterator[tuple[int, tuple]]:
        """(start, pattern) of every occurrence."""
        m, n = self.length, len(ids)
        if m == 1:
            for i, word in enumerate(ids):
                if word in self.buckets:
                    yield i, (word,)
            return
        shift, buckets, far = self.shifts.get, self.buckets, m - 1
        end = m - 1
        while end < n:
            pair = ids[end - 1] * base + ids[end]
            move = shift(pair, far)
            if move:
                end += move
                continue
            window = tuple(ids[end - m + 1 : end + 1])
            for pattern in buckets.get(pair, ()):
                if pattern == window:
                    yield end - m + 1, pattern
            end += 1


class Patterns:
    """Windows of the items of one block, as tables for every pattern length."""

    def __init__(self, items: list[tuple[int, str]], window: int) -> None:
        self.words: dict[bytes, int] = {}
        split = [(item, alnum_words(text)) for item, text in items]
        for _, words in split:
            for word in words:
                # 0 stands for every word that no item has.
                self.words.setdefault(word, len(self.words) + 1)
        self.base = len(self.words) + 1
        self.searches: dict[int, Search] = {}
        for item, words in split:
            ids = [self.words[w] for w in words]
            length = min(window, len(ids))
            for start in range(len(ids) - length + 1 if length else 0):
                search = self.searches.setdefault(length, Search(length))
                search.add(tuple(ids[start : start + length]), item, self.base)

    def search(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of hit words and ids of the items found."""
        number = self.words.get
        ids = [number(w, 0) for w in words]
        hit, items = set(), set()
        if any(ids):
            for search in self.searches.values():
                for start, pattern in search.find(ids, self.base):
                    hit.update(range(start, start + search.length))
                    items.update(search.owners[pattern])
        return (
            np.fromiter(sorted(hit), dtype=np.int64, count=len(hit)),
            np.fromiter(sorted(items), dtype=np.int64, count=len(items)),
        )


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, streamed through the driver one after the other."""
    block, size = [], 0
    for row in (
        benchmark.select("item_id", "text").where("item_id is not null and text <> ''")
        .distinct().toLocalIterator()
    ):
        if block and size + len(row.text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    yield block


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``doc_id, n_words, hits (word positions), items (ids)`` of every row of ``docs``.

    The benchmark is the query set: each block of it is broadcast (bounded by ``block_bytes``)
    and searched in all documents.  Further blocks are further passes, merged per row.
    """
    context = docs.sparkSession.sparkContext
    passes = []
    for block in item_blocks(benchmark, block_bytes):
        shared = context.broadcast(Patterns(block, window))

        def scan(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            patterns = shared.value
            found, counts = [], []
            for text in batch["text"]:
                words = alnum_words(text.as_py())
                counts.append(len(words))
                found.append(patterns.search(words))
            yield pa.RecordBatch.from_arrays(
                [batch["row_key"], batch["doc_id"], pa.array(counts, pa.int64()),
                 lists([h for h, _ in found], pa.int64()), lists([i for _, i in found], pa.int64())],
                ["row_key", "doc_id", "n_words", "hits", "items"],
            )

        # The key only serves to merge passes.
        rows = docs.select(F.lit(b"").alias("row_key"), F.col("doc_id").cast("bigint"), "text")
        passes.append((rows, scan))
    if len(passes) == 1:
        rows, scan = passes[0]
        return arrow_rows(rows, scan, SCHEMA).drop("row_key")
    every = None
    for rows, scan in passes:
        rows = rows.withColumn("row_key", F.sha2(F.coalesce("text", F.lit("")), 256).cast("binary"))
        part = arrow_rows(rows, scan, SCHEMA)
        # Equal rows are equal results: one of them, with their number.
        part = part.groupBy("doc_id", "row_key", "n_words", "hits", "items").agg(
            F.count("*").alias("copies")
        )
        every = part if every is None else every.union(part)
    merged = every.groupBy("doc_id", "row_key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("copies").alias("copies"),
    )
    return merged.select(
        "doc_id", "n_words", "hits", "items", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")
    ).drop("copy")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark; all columns stay, no shuffle."""
    context, kept = docs.sparkSession.sparkContext, docs
    for block in item_blocks(benchmark, block_bytes):
        shared = context.broadcast(Patterns(block, window))

        def clean(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            patterns = shared.value
            keep = [
                not len(patterns.search(alnum_words(text.as_py()))[0]) for text in batch["text"]
            ]
            yield batch.filter(pa.array(keep, pa.bool_()))

        kept = arrow_rows(kept, clean, docs.schema)
    return kept
