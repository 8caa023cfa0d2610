"""Groups of spelling variants: words one edit apart, found by asymmetric q-chunks.

Words are runs of letters, counted over all documents; a few letters are lost on the way, chosen by
a checksum of document and word.  A word as the asking side contributes two disjoint chunks, its
first and its last code points; as the answering side it contributes its positional grams.
One edit leaves one of the two chunks whole and moves it by at most one place, so joining chunks and
grams on text and place, within a shift of one, finds every near word; the edit distance confirms.
A gram names the length and the chunk that it can answer from its place, so lengths and shifts are
part of the key; grams that could answer none, of no word whose length differs by at most one, are
not sent.

Chunks are halves of the word, of at most ``LONGEST_CHUNK`` code points, so keys are as selective as
the word allows and the work for a very long word stays linear.  Of two words the shorter asks, of
two as long the smaller.  A chunk shared by very many words is split by ``skew.split_join``.

Defined results: a null or empty text has no words; a null ``doc_id`` counts as the text ``null``;
repeated rows count as often as they stand there; an empty table has no words; other columns are not
read.  A run whose lost letter leaves fewer than ``least_length`` code points is no word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegauge.llm.common import keep, ship
from placegauge.operators.skew import split_join

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LONGEST_CHUNK = 12
# A task hands on its counts when it holds so many words or code points.
HELD_WORDS = 200_000
HELD_CHARS = 8_000_000


def text_runs(text: str | None) -> list[str]:
    """Runs of letters, A-Z lower-cased and all others unchanged."""
    if not text:
        return []
    # Lower-casing the bytes leaves everything but A-Z alone.
    return RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def spelt(run: str, start: int, every: int) -> str:
    """The run, or without one code point where its checksum says so.

    ``start`` is the checksum of what stands before the run.
    """
    h = zlib.crc32(run.encode("utf-8"), start)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(
    docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97
) -> DataFrame:
    """``(word, n)``: words of ``docs(doc_id, text)`` and how often they occur overall."""
    ship(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())}
            )

        for batch in batches:
            ids = batch.column(0).fill_null("null")
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                start = zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(text_runs(text.as_py())).items():
                    word = spelt(run, start, every)
                    if len(word) >= least_length:
                        size += len(word) if word not in held else 0
                        held[word] += n
                if len(held) >= HELD_WORDS or size >= HELD_CHARS:
                    yield out()
                    held.clear()
                    size = 0
        yield out()

    found = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _chunk_sizes(size: Column) -> tuple[Column, Column]:
    """Code points of the first and of the last chunk of a word."""
    first = F.floor(size / 2).cast("int")
    return tuple(F.least(F.lit(LONGEST_CHUNK), q.cast("int")) for q in (first, size - first))


def _letters(word: str) -> Column:
    """A bit for each letter of a word, 64 of them shared by all letters."""
    return F.expr(
        f"aggregate(transform(split({word}, ''), c -> shiftleft(1L, ascii(c) % 64)), 0L, (x, y) -> x | y)"
    )


def chunks(words: DataFrame) -> DataFrame:
    """``(gram, size, second, word, n, letters)``: the two chunks of a word of ``size`` code points."""
    size = F.char_length("word")
    first, last = _chunk_sizes(size)
    both = F.array(
        F.struct(F.substring("word", 1, first).alias("gram"), F.lit(False).alias("second")),
        F.struct(F.substring("word", size - last + 1, last).alias("gram"), F.lit(True).alias("second")),
    )
    return words.select("word", "n", size.alias("size"), _letters("word").alias("letters"), F.inline(both))


def grams(words: DataFrame) -> DataFrame:
    """``(gram, size, second, near, near_n, near_letters)``: positional grams and what they answer.

    A gram answers the first or last chunk of a word of ``size`` code points from that chunk's place
    or from where one edit moves it, which is by the difference of the lengths.  Only words as long
    or shorter by one ask, so that no pair is found from both of its words.
    """
    own = F.char_length("word")
    answers = []
    for grown in (0, 1):
        size = own - grown
        first, last = _chunk_sizes(size)
        for second, place, q in ((False, F.lit(0), first), (True, size - last, last)):
            for shift in sorted({0, grown}):
                answers.append(
                    F.struct(
                        size.alias("size"), F.lit(second).alias("second"),
                        (place + shift).alias("at"), q.alias("q"),
                    )
                )
    fitting = F.filter(F.array(*answers), lambda a: (a["q"] > 0) & (a["at"] + a["q"] <= F.col("own")))
    return (
        words.select("word", "n", own.alias("own"), _letters("word").alias("letters"))
        .select("*", F.inline(fitting))
        .select(
            F.substring("word", F.col("at") + 1, F.col("q")).alias("gram"),
            "size",
            "second",
            F.col("word").alias("near"),
            F.col("n").alias("near_n"),
            F.col("letters").alias("near_letters"),
        )
    )


def near_pairs(words: DataFrame, part_rows: int | None = None) -> DataFrame:
    """``(word, n, near, near_n)``: all pairs of words one edit apart, each in one order only."""
    # Both are counted before they are joined: written first.
    asked, answers = keep(chunks(words), "spelling-chunks"), keep(grams(words), "spelling-grams")
    met = split_join(
        answers, asked, ["gram", "size", "second"], F.col("near"), "inner", part_rows,
        other_spread=F.col("word"),
    )
    # One edit takes away one letter at most and brings one; cheaper to see than the distance.
    changed = F.bit_count(F.col("letters").bitwiseXOR(F.col("near_letters")))
    once = (F.col("size") < F.char_length("near")) | (F.col("word") < F.col("near"))
    confirmed = met.where((changed <= 2) & once & (F.levenshtein("word", "near", 1) == 1))
    return confirmed.select("word", "n", "near", "near_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the words of ``forms(word, form)``: the end of the chain of forms.

    Every round doubles the steps; a form occurs at least twice as often as its word, so chains are
    no longer than the logarithm of the largest count, and rounds are few.
    """
    steps = keep(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        # Many words may share a form; words are unique on the other side.
        longer = keep(split_join(steps, further, ["root"], F.col("word"), "left"), "spelling-roots")
        steps = longer.select("word", F.coalesce("further", "root").alias("root"))
        if longer.where(F.col("further").isNotNull()).isEmpty():
            return steps


def variants(
    docs: DataFrame,
    least_length: int = 5,
    least_count: int = 3,
    every: int = 97,
    factor: int = 2,
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``docs(doc_id, text)``.

    ``form`` is the near word of largest ``n`` (ties: the smallest in code-point order) if that
    occurs at least ``factor`` times as often, ``root`` the last of the chain of forms.
    """
    if least_length < 2:
        raise ValueError("a word of one letter has no two chunks")
    words = keep(word_counts(docs, least_length, least_count, every), "spelling-words")
    # Smallest struct: largest count first, then code-point order, as Spark compares UTF-8 bytes.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    pairs = near_pairs(words)
    both = F.array(
        F.struct("word", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    around = (
        pairs.select(F.inline(both))
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), best.alias("best"))
    )
    joined = words.join(around, "word", "left")
    enough = -F.col("best.less") >= factor * F.col("n")
    table = keep(
        joined.select(
            "word",
            F.when(enough, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(table.where(F.col("form").isNotNull()))
    return table.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
