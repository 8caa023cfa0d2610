"""Removal of repeated word sequences, found level by level with doubled lengths.

Level one looks at short windows (half the wanted length, halved again for longer ones).  Of these
only anchors take part: in every stretch that a window of the next length spans, the one with the
smallest hash, so that equal stretches choose equal anchors.  Windows that occur in several
documents are extended to twice the length; the rest never is.  At the wanted length all windows
around the surviving anchors are compared.  Levels without survivors leave the next ones nothing.

Documents with the same words are one class; only its smallest id is searched.

Defined results: a null or empty text has no words.  Windows repeated inside one document do not
count.  Rows with a null doc_id lose nothing and take nothing away.  Repeated rows have equal
results; rows with one doc_id and different texts count as one document with several texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegauge.llm.common import (
    WordHashes,
    Windows,
    arrow_rows,
    keep,
    lists,
    signed,
    space_words,
)
from placegauge.operators.skew import split_join

WINDOW = 50
# Rows of one window that a task joins.
PART_ROWS = 20_000
MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def lengths(window: int) -> list[int]:
    """Window lengths from the first level to the wanted one, each at most twice the one before."""
    levels = [window]
    while levels[0] > 32:
        levels.insert(0, -(-levels[0] // 2))
    return levels if len(levels) > 1 else [-(-window // 2), window]


def chosen(hashes: np.ndarray, spread: int) -> np.ndarray:
    """For each run of ``spread`` windows, where its smallest hash is (the first one on ties)."""
    if len(hashes) < spread:
        return np.zeros(0, dtype=np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(hashes, spread)
    return runs.argmin(axis=1) + np.arange(len(runs))


def words_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def level_hashes(words: list[bytes], known: WordHashes, windows: Windows, short: int, long: int):
    """Hashes of all ``short`` windows, and for each ``long`` window the anchor it chooses."""
    hashes = windows.of(known.of(words), short)
    return hashes, chosen(hashes, long - short + 1)


def summaries(docs: DataFrame, short: int, long: int) -> DataFrame:
    """Key, number of words, digest of all words and level-one anchors of every row."""

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known, windows = WordHashes(), Windows(MULTIPLIERS[0])
        keys, counts, digests, anchors = [], [], [], []
        for value in batch["text"]:
            words = space_words(value.as_py())
            keys.append(words_key(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            counts.append(len(words))
            hashes, picks = level_hashes(words, known, windows, short, long)
            anchors.append(signed(np.unique(hashes[np.unique(picks)])))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(keys, pa.binary()), pa.array(counts, pa.int64()),
             pa.array(digests, pa.string()), lists(anchors, pa.int64())],
            ["doc_id", "words_key", "n_words", "digest", "anchors"],
        )

    return arrow_rows(
        docs, read,
        "doc_id bigint, words_key binary, n_words bigint, digest string, anchors array<bigint>",
    )


def extended(rows: DataFrame, short: int, long: int, final: bool, next_long: int) -> DataFrame:
    """Windows of ``long`` words around surviving anchors: all of them, or the next anchors.

    ``rows`` has ``doc_id, words_key, text, survivors``.
    """

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        first, second = (Windows(m) for m in MULTIPLIERS)
        out, taken = [], []
        for row, (text, survivors) in enumerate(zip(batch["text"], batch["survivors"], strict=True)):
            words = space_words(text.as_py())
            if words_key(words) != batch["words_key"][row].as_py():
                continue  # another text of the same id
            taken.append(row)
            hashes, picks = level_hashes(words, known, first, short, long)
            alive = np.isin(signed(hashes), survivors.values.to_numpy())
            starts = np.flatnonzero(alive[picks]) if len(picks) else picks
            numbers = known.of(words)
            one = first.of(numbers, long)
            if not final:
                # Windows that cannot survive never win over one that can.
                able = np.full(len(one), np.iinfo(np.uint64).max)
                able[starts] = one[starts]
                picks = np.unique(chosen(able, next_long - long + 1))
                out.append((np.unique(signed(one[np.intersect1d(picks, starts)])),))
                continue
            two = second.of(numbers, long)
            out.append((signed(one[starts]), signed(two[starts]), starts.astype(np.int64)))
        if not taken:
            return
        columns = [lists(list(c), pa.int64()) for c in zip(*out, strict=True)]
        names = ["one", "two", "start"] if final else ["anchors"]
        ids = [batch[c].take(pa.array(taken)) for c in ("doc_id", "words_key")]
        yield pa.RecordBatch.from_arrays([*ids, *columns], ["doc_id", "words_key", *names])

    kinds = "one array<bigint>, two array<bigint>, start array<bigint>" if final else "anchors array<bigint>"
    return arrow_rows(rows, read, f"doc_id bigint, words_key binary, {kinds}")


def surviving(anchors: DataFrame) -> DataFrame:
    """``doc_id, words_key, survivors``: anchors that occur in several documents, per document."""
    rows = anchors.select("doc_id", "words_key", F.explode("anchors").alias("anchor"))
    shared = rows.groupBy("anchor").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
    ).where("low < high").select("anchor")
    return rows.join(shared, "anchor").groupBy("doc_id", "words_key").agg(
        F.collect_list("anchor").alias("survivors")
    )


def cut(rows: DataFrame, window: int) -> DataFrame:
    """Number of removed words and digest of the kept ones; ``rows`` has ``text, starts``."""

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        removed, digests, taken = [], [], []
        for row, (text, starts) in enumerate(zip(batch["text"], batch["starts"], strict=True)):
            words = space_words(text.as_py())
            if words_key(words) != batch["words_key"][row].as_py():
                continue
            taken.append(row)
            gone = covered(len(words), starts.values.to_numpy(), window)
            removed.append(int(gone.sum()))
            left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            digests.append(hashlib.sha256(left).hexdigest())
        ids = [batch[c].take(pa.array(taken, pa.int64())) for c in ("doc_id", "words_key")]
        yield pa.RecordBatch.from_arrays(
            [*ids, pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
            ["doc_id", "words_key", "removed", "kept"],
        )

    return arrow_rows(rows, read, "doc_id bigint, words_key binary, removed bigint, kept string")


def covered(size: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of ``size`` words lie in a window that begins at one of ``starts``."""
    edges = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + window, size), -1)
    return np.cumsum(edges)[:size] > 0


def repeated(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summaries of all rows, ids of the classes' first documents, and where the first documents
    hold windows that also start in a document with a smaller id."""
    levels = lengths(window)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    seen = keep(summaries(docs, levels[0], levels[1]), "substring-summaries")
    firsts = seen.where("n_words > 0").groupBy("words_key").agg(
        F.min("doc_id").alias("doc_id")
    ).where("doc_id is not null")
    firsts = keep(firsts, "substring-classes")
    # Both columns: the rows of one large class are dealt to all tasks.
    anchors = seen.join(firsts, ["doc_id", "words_key"], "left_semi").where("size(anchors) > 0")
    anchors = anchors.select("doc_id", "words_key", "anchors").dropDuplicates(["doc_id", "words_key"])
    texts = docs.select("doc_id", "text")
    for level, (short, long) in enumerate(zip(levels, levels[1:], strict=False), start=1):
        alive = keep(surviving(anchors), "substring-anchors")
        rows = texts.join(alive, "doc_id")
        final = level == len(levels) - 1
        after = levels[level + 1] if not final else long
        made = extended(rows, short, long, final, after)
        if final:
            break
        anchors = made
    windows = made.select(
        "doc_id", "words_key", F.explode(F.arrays_zip("one", "two", "start")).alias("w")
    ).select("doc_id", "words_key", "w.*")
    windows = keep(windows, "substring-windows")
    earliest = windows.groupBy("one", "two").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("__n")
    ).where("low < high").select("one", "two", "low", "__n")
    earliest = keep(earliest, "substring-earliest")
    # A passage that very many documents share is dealt to several tasks.
    later = split_join(
        windows, earliest.drop("__n"), ["one", "two"], F.col("doc_id"), "inner", PART_ROWS,
        earliest.drop("low"),
    ).where("low < doc_id")
    places = later.groupBy("doc_id", "words_key").agg(F.collect_list("start").alias("starts"))
    return seen, firsts, places


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""
    seen, firsts, places = repeated(docs, window)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    done = cut(texts.join(places, "doc_id"), window).dropDuplicates(["doc_id", "words_key"])
    marked = seen.drop("anchors").join(
        firsts.withColumn("first", F.lit(True)), ["doc_id", "words_key"], "left"
    ).join(done, ["doc_id", "words_key"], "left")
    # Later copies of a class lose every word that a window covers: all, or none if too short.
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull() & (F.col("n_words") >= window)
    return marked.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("bigint")
        .alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"),
    )
