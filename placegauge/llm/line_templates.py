"""Removal of recurring lines by a log-template tree.

A line is a list of tokens; tokens with digits are fields.  Fields prove nothing, so a line without
a word that is fixed recurs by its own text only, and no template is left without one.  The tree has a fixed depth: number of
tokens, then the leading tokens.  In a leaf, lines that agree in most places share a template, and
places where they differ become fields as well.  A template that occurs in many documents is
dropped everywhere but in the document with the smallest id that has it.

Leaves are read in chunks of bounded size, each giving its templates.  Those of a leaf with several
chunks are read again as lines, in chunks of lines that agree at some position, another one each
round, until the leaf has one chunk or no position finds anything more to join.

Defined results: null texts stay null and empty texts empty; blank lines are no lines and stay;
one document counts once for a template however often it has it; rows with one doc_id are one
document; rows with a null doc_id count for nothing and lose nothing; repeated rows are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placegauge.llm.common import arrow_rows, keep, lists, own_name, signed
from placegauge.operators.skew import split_join

DEPTH = 3
SIMILARITY = 0.75
MIN_DOCS = 10
# Lines of one leaf that one step compares.
CHUNK = 500
# Rows of one leaf, line or template that a task joins.
PART_ROWS = 2_000
FIELD = "<*>"


def word(token: str) -> bool:
    return token != FIELD and any(map(str.isalpha, token))


def tokens_of(line: str) -> list[str]:
    own = line.split()
    tokens = [FIELD if any(map(str.isdigit, t)) else t for t in own]
    # As one token the text is alone in its leaf; no other token has a space.
    return tokens if any(map(word, tokens)) else [" ".join(own)] if own else []


def leaf_of(tokens: list[str]) -> int:
    head = "\x1f".join([str(len(tokens)), *tokens[:DEPTH]])
    return xxhash.xxh3_64_intdigest(head.encode("utf-8", "surrogatepass"))


def key_of(tokens: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(tokens).encode("utf-8", "surrogatepass"))


def masked_lines(text: str | None) -> Iterator[tuple[str, list[str]]]:
    """Lines with their tokens; no tokens for a blank line."""
    for line in (text or "").split("\n"):
        yield line, tokens_of(line)


def line_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, leaves, keys`` of the distinct masked lines of every row, side by side."""

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        leaves, keys = [], []
        for value in batch["text"]:
            found = {key_of(t): leaf_of(t) for _, t in masked_lines(value.as_py()) if t}
            keys.append(signed(np.array(list(found), dtype=np.uint64)))
            leaves.append(signed(np.array(list(found.values()), dtype=np.uint64)))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], lists(leaves, pa.int64()), lists(keys, pa.int64())],
            ["doc_id", "leaves", "keys"],
        )

    return arrow_rows(docs, read, "doc_id bigint, leaves array<bigint>, keys array<bigint>")


def lines_of(docs: DataFrame) -> DataFrame:
    """``key, leaf, tokens`` of the wanted lines of rows ``text, wanted (keys)``."""

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = {}
        for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
            keys = set(wanted.as_py())
            for _, tokens in masked_lines(text.as_py()):
                if tokens and (key := _signed(key_of(tokens))) in keys:
                    rows[key] = (_signed(leaf_of(tokens)), tokens)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(rows), pa.int64()), pa.array([v[0] for v in rows.values()], pa.int64()),
             pa.array([v[1] for v in rows.values()], pa.list_(pa.string()))],
            ["key", "leaf", "tokens"],
        )

    return arrow_rows(docs, read, "key bigint, leaf bigint, tokens array<string>")


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def joined(lines: list[tuple[int, list[str]]], similarity: float) -> dict[int, list[str]]:
    """Template of each line: the first similar one in the given order, fields where they differ."""
    if len(lines) == 1:
        return dict(lines)
    templates: list[list[str]] = []
    arrays: list[np.ndarray] = []
    made: dict[int, int] = {}
    for key, tokens in lines:
        own = np.array(tokens, dtype=object)
        words = np.fromiter(map(word, tokens), dtype=bool, count=len(tokens))
        best, most = None, 0.0
        for number, template in enumerate(arrays):
            # A field agrees with anything but proves nothing.
            fields = template == FIELD
            equal = (template == own) & ~fields
            fixed = len(own) - fields.sum()
            share = equal.sum() / fixed if (equal & words).any() else 0.0
            if share >= similarity and share > most:
                best, most = number, share
                if share == 1:
                    break
        if best is None:
            best = len(templates)
            templates.append(tokens)
            arrays.append(own)
        else:
            arrays[best] = np.where(arrays[best] == own, own, FIELD)
        made[key] = best
    return {key: arrays[number].tolist() for key, number in made.items()}


def by_hash(lines: DataFrame) -> DataFrame:
    """``leaf, chunk, key, tokens``: chunks of any lines of a leaf."""
    sizes = lines.groupBy("leaf").agg(F.count("*").alias("n"))
    return lines.join(sizes, "leaf").select(
        "leaf", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / CHUNK)).alias("chunk"), "key", "tokens"
    )


def by_content(lines: DataFrame, turn: int, similarity: float) -> DataFrame:
    """``leaf, chunk, key, tokens``: a leaf as a whole, or chunks of lines with equal tokens.

    A leaf that is too large is cut by its tokens at the position whose turn it is.  What stays too
    large is cut by the position with the fewest tokens, as those of fields are many; lines that are
    alike whatever their other tokens are cut by hash, since every such chunk is one template.
    """
    columns, place = ["leaf", "chunk", "key", "tokens"], ["leaf", "chunk"]
    left, done = lines.withColumn("chunk", F.lit(0).cast("bigint")).select(*columns), []
    for step in count():
        groups = left.groupBy(*place).agg(F.count("*").alias("n"))
        sized = split_join(left, groups, place, F.col("key"), "inner", PART_ROWS)
        done.append(sized.where(F.col("n") <= CHUNK).select(*columns))
        wide = keep(sized.where(F.col("n") > CHUNK), "wide-lines")
        if wide.isEmpty():
            return reduce(DataFrame.union, done)
        length, values = F.col("length"), F.col("values")
        turns = F.lit(step > 0) | (F.col("pos") != DEPTH + F.lit(turn) % (length - DEPTH))
        places = wide.select(*place, "n", F.size("tokens").alias("length"), F.posexplode("tokens")).groupBy(
            *place, "n", "length", "pos"
        ).agg(F.count_distinct("col").alias("values"), F.min("col").alias("token"))
        fixed = F.count(F.when((values == 1) & (F.col("token") != FIELD), 1))
        fields = F.count(F.when((values == 1) & (F.col("token") == FIELD), 1))
        order = F.struct(turns.alias("late"), "values", F.pmod(F.col("pos") - turn, length).alias("after"), "pos")
        cuts = places.groupBy(*place, "length").agg(
            F.min(F.when(values > 1, order))["pos"].alias("at"), (fixed >= similarity * (length - fields)).alias("alike")
        )
        cut = keep(split_join(wide, cuts, place, F.col("key"), "inner", PART_ROWS), "cut-lines")
        part = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / CHUNK))
        done.append(cut.where("alike").withColumn("chunk", F.xxhash64("chunk", part)).select(*columns))
        token = F.element_at("tokens", F.col("at") + 1)
        left = cut.where("not alike").withColumn("chunk", F.xxhash64("chunk", "at", token)).select(*columns)


def one_round(chunks: DataFrame, similarity: float, fields_first: bool = False) -> DataFrame:
    """``key, leaf, template`` after joining the lines of each chunk of a leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("leaf", "chunk", "key", "tokens")), strict=True)
            for leaf, chunk, key, tokens in rows:
                if (leaf, chunk) != place:
                    yield from out(place, held)
                    place, held = (leaf, chunk), []
                held.append((key, tokens))
        yield from out(place, held)

    def out(place, held) -> Iterator[pa.RecordBatch]:
        if held:
            if fields_first:
                held.sort(key=lambda row: -row[1].count(FIELD))
            found = joined(held, similarity)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int64()), pa.array([place[0]] * len(found), pa.int64()),
                 pa.array(list(found.values()), pa.list_(pa.string()))],
                ["key", "leaf", "template"],
            )

    dealt = chunks.select("leaf", "chunk", "key", "tokens").repartition("leaf", "chunk")
    dealt = dealt.sortWithinPartitions("leaf", "chunk", "key")
    return dealt.mapInArrow(run, "key bigint, leaf bigint, template array<string>")


def joined_again(lines: DataFrame, similarity: float) -> DataFrame:
    """``leaf, first (key), later``: the templates of leaves of several chunks, joined to the end."""
    live = keep(lines.withColumn("quiet", F.lit(0)), "live-templates")
    moved = live.select("leaf", F.col("key").alias("first"), F.col("key").alias("later"))
    for turn in count():
        if live.isEmpty():
            return moved
        chunks = by_content(live.select("leaf", "key", "tokens"), turn, similarity)
        made = keep(one_round(chunks, similarity, fields_first=True), "templates")
        made = made.select("leaf", "key", F.xxhash64("template").alias("next"), "template")
        steps = made.select("leaf", F.col("key").alias("later"), "next")
        moved = split_join(moved, steps, ["leaf", "later"], F.col("first"), "left", PART_ROWS)
        moved = keep(moved.select("leaf", "first", F.coalesce("next", "later").alias("later")), "moved-templates")
        # A leaf goes on while it has several chunks, until each position had its turn for nothing.
        leaves = live.groupBy("leaf").agg(F.count("*").alias("n"), F.max("quiet").alias("quiet")).join(
            made.groupBy("leaf").agg(
                F.max(F.col("key") != F.col("next")).alias("changed"),
                F.max(F.size("template") - DEPTH).alias("places"),
            ), "leaf",
        ).withColumn("quiet", F.when(F.col("changed"), 0).otherwise(F.col("quiet") + 1))
        leaves = leaves.where((F.col("n") > CHUNK) & (F.col("quiet") < F.col("places"))).select("leaf", "quiet")
        found = made.select("leaf", F.col("next").alias("key"), F.col("template").alias("tokens"))
        found = found.dropDuplicates(["leaf", "key"])
        live = keep(split_join(found, leaves, ["leaf"], F.col("key"), "inner", PART_ROWS), "live-templates")


def templates(docs: DataFrame, min_docs: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key, leaf`` rows of leaves that many documents reach, and ``key, template_key``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(
        "doc_id is not null and text is not null"
    )
    rows = line_keys(docs).select("doc_id", F.explode(F.arrays_zip("leaves", "keys")).alias("x"))
    rows = keep(rows.select("doc_id", F.col("x.leaves").alias("leaf"), F.col("x.keys").alias("key")), "lines")
    # Rows of a leaf bound its documents from above, so no recurring template is lost here.
    busy = rows.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    rows = keep(split_join(rows, busy, ["leaf"], F.col("doc_id"), "inner", PART_ROWS), "busy-lines")
    # Each line is read in one of its documents.
    where = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    wanted = where.groupBy("doc_id").agg(F.collect_list("key").alias("wanted"))
    # Never by broadcast: the texts grow with the corpus whatever the marks do.
    lines = lines_of(docs.join(wanted.hint("merge"), "doc_id").select("text", "wanted")).dropDuplicates(["key"])
    named = keep(lines, "line-tokens").select("key", "leaf", "tokens")
    made = keep(one_round(by_hash(named), similarity), "templates")
    final = made.select("key", "leaf", F.xxhash64("template").alias("first"), "template")
    # Templates of a leaf with several chunks are read again as lines.
    many = named.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("leaf")
    again = final.join(many, "leaf", "left_semi").select(
        "leaf", F.col("first").alias("key"), F.col("template").alias("tokens")
    ).dropDuplicates(["leaf", "key"])
    second = joined_again(again, similarity)
    mapping = final.select("key", "leaf", "first").join(second, ["leaf", "first"], "left").select(
        "key", F.xxhash64("leaf", F.coalesce("later", "first")).alias("template_key")
    )
    return rows, mapping


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, dropped (keys)``: lines of recurring templates, outside their first document."""
    rows, mapping = templates(docs, min_docs, similarity)
    named = split_join(rows, keep(mapping, "line-templates"), ["key"], F.col("doc_id"), "inner", PART_ROWS)
    held = keep(named.select("doc_id", "key", "template_key"), "template-lines")
    counts = held.select("doc_id", "template_key").distinct().groupBy("template_key").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first")
    ).where(F.col("n") >= min_docs)
    marked = split_join(held, counts, ["template_key"], F.col("doc_id"), "inner", PART_ROWS)
    return marked.where("doc_id <> first").groupBy("doc_id").agg(
        F.collect_set("key").alias("dropped")
    )


def without(text: str, keys: set[int]) -> tuple[str, int]:
    """The text without the lines of these keys, and how many went."""
    left, gone = [], 0
    for line, tokens in masked_lines(text):
        if tokens and _signed(key_of(tokens)) in keys:
            gone += 1
        else:
            left.append(line)
    return "\n".join(left), gone


def deduplicated(
    docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, counts: str = "lines_dropped"
) -> DataFrame:
    """``docs`` with the lines dropped from ``text``, and their number as ``counts``.

    Other columns stay, whatever their names; one named ``counts`` gives way.
    """
    gone_id, gone_keys = own_name("id"), own_name("dropped")
    marks = recurring(docs.select("doc_id", "text"), min_docs, similarity).select(
        F.col("doc_id").alias(gone_id), F.col("dropped").alias(gone_keys)
    )
    rows = docs.join(marks.hint("merge"), F.col("doc_id").cast("bigint") == F.col(gone_id), "left")
    columns = [c for c in docs.columns if c != counts]
    at = columns.index("text")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, dropped = [], []
        for value, keys in zip(batch["text"], batch[gone_keys], strict=True):
            text, gone = value.as_py(), 0
            if text and keys.is_valid:
                text, gone = without(text, set(keys.as_py()))
            texts.append(text)
            dropped.append(gone)
        made = batch.select(columns).set_column(at, "text", pa.array(texts, pa.string()))
        yield pa.RecordBatch.from_arrays(
            [*made.columns, pa.array(dropped, pa.int64())], [*columns, counts]
        )

    schema = docs.select(*columns).schema.add(counts, "long")
    return arrow_rows(rows.select(*columns, gone_keys), cut, schema)
