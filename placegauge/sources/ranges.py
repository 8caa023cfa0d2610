"""Files of any size, each read by as many tasks as it has blocks.

A CSV record may span lines and a GeoJSON feature may span anything, so a block alone does not tell
what its first byte means.  Spark's text source cuts a file into lines, or at ``}``, and says which
block a piece begins in.  A first pass sums up each block for every state it may begin in: inside
quotes or not, and by how much brackets open.  Running these along the few blocks of a file gives
the state that each begins in.  A second pass reads the records that begin and end in a block; one
that crosses a block's end is put together from its parts.  Row numbers are positions in the block
plus the rows of the blocks before.

Nothing needs a file in one place, and results equal those of ``files.read_tables``.  Two kinds are
still put together whole, which limits such a file to 2 GB: those in UTF-16, whose bytes cannot be cut
at a line's end, and JSON that is not in UTF-8.  One record or feature is limited likewise.  A JSON
file is a feature collection if its brackets match, it has a list of features and all of them parse.
"""

from __future__ import annotations

import codecs
import csv
import io
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placegauge.operators.skew import split_join
from placegauge.session import cut
from placegauge.sources import files

CSV_FILES = "*.[cC][sS][vV]"
JSON_FILES = "*.{[jJ][sS][oO][nN],[gG][eE][oO][jJ][sS][oO][nN]}"
# Rows about blocks that are broadcast; beyond that the pieces are dealt by block instead.
BROADCAST_BLOCKS = 100_000
PIECES_AT_ONCE = 5_000

_BOM = codecs.BOM_UTF8
_FIELD_END = re.compile(rb"[,\r]")
_STRING = re.compile(rb'"(?:[^"\\]|\\.)*"', re.S)
_STRING_REST = re.compile(rb'(?:[^"\\]|\\.)*"', re.S)
_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"?|[{}\[\]]', re.S)
_LIST_FOLLOWS = re.compile(rb"\s*:\s*\[")


@dataclass(frozen=True)
class Scanned:
    """datasets: dataset_id, fields.  records: dataset_id, row_no, rec.  errors: dataset_id, error."""

    datasets: DataFrame
    records: DataFrame
    errors: DataFrame


def plain_path(path: str) -> str:
    """The pattern that stands for exactly this path."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def pieces(spark: SparkSession, folder: str | list[str], glob: str, end: str) -> DataFrame:
    """``(path, size, block, piece)``: what stands between two ``end`` bytes, as bytes, in file order."""
    text = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("lineSep", end)
        .text(folder)
    )
    return text.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("piece"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[bytes]]]:
    """Rows of one block that stand together: what they have in common, and their pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        path, block = batch.column("path"), batch.column("block").to_numpy()
        same = pc.equal(path.slice(1), path.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(~same | (block[1:] != block[:-1])) + 1
        for low, high in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            common = {n: batch.column(n)[low].as_py() for n in batch.schema.names if n != "piece"}
            yield common, batch.column("piece").slice(low, high - low).to_pylist()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """Blocks one after the other: what their rows have in common, and their pieces."""
    for _, group in itertools.groupby(_runs(batches), key=lambda run: (run[0]["path"], run[0]["block"])):
        common, first = next(group)
        yield common, itertools.chain(first, itertools.chain.from_iterable(p for _, p in group))


# --- states ---------------------------------------------------------------------------------


def inside_after(line: bytes, inside: bool) -> bool:
    """Whether a quoted CSV cell is open after a line that begins inside one or not."""
    if b'"' not in line:
        return inside
    at, size = 0, len(line)
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == b'"':
                at += 2
                continue
            inside, at = False, at + 1
        elif line[at : at + 1] == b'"':
            inside, at = True, at + 1
            continue
        end = _FIELD_END.search(line, at)
        if end is None or end.end() >= size:
            return False
        at = end.end()


def bracket_sum(piece: bytes, inside: bool) -> tuple[bool, int]:
    """(whether a JSON string is open after the piece and the ``}`` behind it, brackets opened less closed)."""
    if inside:
        rest = _STRING_REST.match(piece)
        if rest is None:
            return True, 0
        piece = piece[rest.end() :]
    if b'"' in piece:
        piece = _STRING.sub(b"", piece)
        opened = piece.find(b'"')
        if opened >= 0:
            return True, _opened(piece[:opened])
    return False, _opened(piece) - 1


def _opened(piece: bytes) -> int:
    return piece.count(b"{") + piece.count(b"[") - piece.count(b"]") - piece.count(b"}")


BLOCK_SUMS = (
    "path string, block bigint, size bigint, length bigint, utf16 boolean, utf8 boolean, cp932 boolean, "
    "after_outside boolean, after_inside boolean, sum_outside bigint, sum_inside bigint"
)


def _decodes(piece: bytes, encoding: str) -> bool:
    try:
        piece.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def block_sums(read: DataFrame, json: bool) -> DataFrame:
    """What a block does to either state that it may begin in, and the encodings it can be in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, own in _blocks(batches):
            length, ends, sums = 0, [False, True], [0, 0]
            utf8 = cp932 = True
            first = None
            for piece in own:
                first = piece[:2] if first is None else first
                length += len(piece) + 1
                if not piece.isascii():
                    utf8 = utf8 and _decodes(piece, "utf-8")
                    cp932 = cp932 and _decodes(piece, "cp932")
                    piece = piece.replace(_BOM, b"")
                for k in (0, 1):
                    if json:
                        ends[k], change = bracket_sum(piece, ends[k])
                        sums[k] += change
                    else:
                        ends[k] = inside_after(piece, ends[k])
            marked = at["block"] == 0 and first in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "path": at["path"], "block": at["block"], "size": at["size"], "length": length,
                        "utf16": marked, "utf8": utf8, "cp932": cp932,
                        "after_outside": ends[0], "after_inside": ends[1],
                        "sum_outside": sums[0], "sum_inside": sums[1],
                    }
                ],
                schema=pa.schema(
                    [("path", pa.string()), *[(c, pa.int64()) for c in ("block", "size", "length")]]
                    + [(c, pa.bool_()) for c in ("utf16", "utf8", "cp932", "after_outside", "after_inside")]
                    + [(c, pa.int64()) for c in ("sum_outside", "sum_inside")]
                ),
            )

    return read.select("path", "block", "size", "piece").mapInArrow(run, BLOCK_SUMS)


def states(sums: DataFrame) -> DataFrame:
    """Per block: the encoding of its file, whether it begins inside quotes, and its bracket depth.

    A block leaves one state whatever it began in, or keeps it, or turns it; so the state is that of
    the last block that leaves one, turned as often as blocks since then turn it.
    """
    whole = Window.partitionBy("path")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("after_outside") == F.col("after_inside")
    turns = (F.col("after_outside") & ~F.col("after_inside")).cast("int")
    rows = sums.withColumn("turned", F.coalesce(F.sum(turns).over(before), F.lit(0))).withColumn(
        "left", F.when(fixed, F.struct(F.col("after_outside").alias("value"), (F.col("turned") + turns).alias("turned")))
    )
    last = F.last("left", ignorenulls=True).over(before)
    rows = rows.withColumn("last", last).withColumn(
        "inside",
        F.when(F.col("last").isNull(), F.col("turned") % 2 == 1).otherwise(
            F.col("last.value") != ((F.col("turned") - F.col("last.turned")) % 2 == 1)
        ),
    )
    own = F.when(F.col("inside"), F.col("sum_inside")).otherwise(F.col("sum_outside"))
    after = F.when(F.col("inside"), F.col("after_inside")).otherwise(F.col("after_outside"))
    utf8, cp932 = F.min("utf8").over(whole), F.min("cp932").over(whole)
    encoding = (
        F.when(F.max("utf16").over(whole), F.lit("utf-16")).when(utf8, F.lit("utf-8")).when(cp932, F.lit("cp932"))
    )
    # The end byte behind the last piece was counted, but may be none.
    unended = (F.sum("length").over(whole) - F.col("size")).cast("int")
    final = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select(
        "path", "block", "inside",
        encoding.alias("encoding"),
        F.coalesce(F.sum(own).over(before), F.lit(0)).alias("depth"),
        (~F.last(after).over(final) & (F.sum(own).over(whole) + unended == 0)).alias("balanced"),
    )


def with_states(read: DataFrame, of: DataFrame) -> DataFrame:
    """Pieces with the state of their block before them, blocks together and in order."""
    if of.count() <= BROADCAST_BLOCKS:
        return read.join(F.broadcast(of), ["path", "block"])
    numbered = read.withColumn("at", F.monotonically_increasing_id())
    return numbered.join(of, ["path", "block"]).repartition("path", "block").sortWithinPartitions(
        "path", "block", "at"
    )


# --- records of a block -----------------------------------------------------------------------

# kind: 0 a record, 1 the rest of one from blocks before, 2 the beginning of one, 3 the block itself
# with the region it ends in, closed if a list of features begins there.  region: 1 within the list of features, 0 not, null as the block begins.
PARTS = "path string, block bigint, local bigint, kind int, closed boolean, region int, cells array<string>, text binary"
_PARTS = pa.schema(
    [
        ("path", pa.string()), ("block", pa.int64()), ("local", pa.int64()), ("kind", pa.int32()),
        ("closed", pa.bool_()), ("region", pa.int32()), ("cells", pa.list_(pa.string())), ("text", pa.binary()),
    ]
)


def csv_cells(text: str) -> list[list[str]]:
    """Records of a text as stripped cells, without those that have none."""
    csv.field_size_limit(2**31 - 1)
    stripped = ([cell.strip() for cell in row] for row in csv.reader(io.StringIO(text, newline="")))
    return [cells for cells in stripped if any(cells)]


def _csv_parts(at: dict, own: Iterator[bytes]) -> Iterator[dict]:
    inside, encoding, local = at["inside"], at["encoding"], 0
    rest: list[bytes] | None = [] if inside else None
    held: list[bytes] = []
    ready: list[bytes] = []

    def records() -> Iterator[dict]:
        nonlocal local
        text = (b"\n".join(ready) + b"\n").decode(encoding)
        for cells in csv_cells(text):
            yield {"kind": 0, "local": local, "cells": cells}
            local += 1
        ready.clear()

    for line in own:
        line = line.replace(_BOM, b"")
        inside = inside_after(line, inside)
        if rest is not None:
            rest.append(line)
            if not inside:
                yield {"kind": 1, "closed": True, "text": b"\n".join(rest).decode(encoding).encode()}
                rest = None
            continue
        held.append(line)
        if not inside:
            ready += held
            held = []
            if len(ready) >= PIECES_AT_ONCE:
                yield from records()
    if rest is not None:
        yield {"kind": 1, "closed": False, "text": b"\n".join(rest).decode(encoding).encode()}
    if ready:
        yield from records()
    if held:
        yield {"kind": 2, "local": local, "text": b"\n".join(held).decode(encoding).encode()}


def _json_parts(at: dict, own: Iterator[bytes]) -> Iterator[dict]:
    """Objects that begin at depth 2, with the region they begin in."""
    inside, depth, local = at["inside"], at["depth"], 0
    rest: list[bytes] | None = [] if depth > 2 or (inside and depth == 2) else None
    held: list[bytes] | None = None
    region: int | None = None
    listed = False
    for piece in own:
        begin = 0
        if rest is None and held is None:
            # Nothing is open below depth 2: look at every bracket until an object begins.
            scan = 0
            if inside:
                string_rest = _STRING_REST.match(piece)
                scan, inside = (len(piece), True) if string_rest is None else (string_rest.end(), False)
            for token in _TOKEN.finditer(piece, scan):
                what = token.group()
                if what[:1] == b'"':
                    inside = len(what) < 2 or what[-1:] != b'"' or not _STRING.fullmatch(what)
                    if depth == 1 and what == b'"features"' and _LIST_FOLLOWS.match(piece, token.end()):
                        region, listed = 1, True
                elif what in b"{[":
                    if what == b"{" and depth == 2:
                        held, begin = [], token.start()
                        break
                    depth += 1
                else:
                    depth -= 1
                    region = 0 if depth == 1 else region
            else:
                if not inside:  # the bracket behind the piece
                    depth -= 1
                    region = 0 if depth == 1 else region
                continue
            inside = False
        part = piece[begin:]
        inside, change = bracket_sum(part, inside)
        depth += change
        part += b"}"
        done = not inside and depth <= 2
        if rest is not None:
            rest.append(part)
            if done:
                yield {"kind": 1, "closed": True, "text": b"".join(rest)}
                rest = None
        else:
            held.append(part)
            if done:
                yield {"kind": 0, "local": local, "region": region, "text": b"".join(held)}
                local, held = local + 1, None
        if done and depth < 2:
            region = 0
    if rest is not None:
        yield {"kind": 1, "closed": False, "text": b"".join(rest)}
    if held is not None:
        yield {"kind": 2, "local": local, "region": region, "text": b"".join(held)}
    yield {"kind": 3, "region": region, "closed": listed}


def parts(read: DataFrame, of: Callable[[dict, Iterator[bytes]], Iterator[dict]]) -> DataFrame:
    """Records, parts of records and regions of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, own in _blocks(batches):
            rows: list[dict] = []
            for row in of(at, own):
                rows.append({"path": at["path"], "block": at["block"], **row})
                if len(rows) == PIECES_AT_ONCE:
                    yield pa.RecordBatch.from_pylist(rows, schema=_PARTS)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_PARTS)

    return read.select("path", "block", "inside", "encoding", "depth", "piece").mapInArrow(run, PARTS)


def crossing(found: DataFrame, between: bytes) -> DataFrame:
    """``(path, block, local, region, text)``: records that cross a block's end, put together."""
    order = Window.partitionBy("path").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.last(F.when(F.col("kind") == 2, F.col("block")), ignorenulls=True).over(order)
    grouped = (
        found.where("kind IN (1, 2)")
        .withColumn("begun", begun)
        .where("begun IS NOT NULL")
        .groupBy("path", F.col("begun").alias("block"))
        .agg(
            F.max("local").alias("local"),
            F.max(F.when(F.col("kind") == 2, F.col("region"))).alias("region"),
            # The beginning has the smallest block.
            F.array_sort(F.collect_list(F.struct("block", "kind", "closed", "text"))).alias("all"),
        )
    )
    # What follows the part that closes the record belongs to nothing that began here.
    closes = F.array_position(F.transform("all", lambda p: F.coalesce(p["closed"], F.lit(False))), True)
    used = F.when(closes > 0, F.slice("all", F.lit(1), closes.cast("int"))).otherwise(F.col("all"))
    text = F.array_join(F.transform(used, lambda p: p["text"].cast("string")), between.decode())
    return grouped.select("path", "block", "local", "region", text.alias("text"))


def numbered(rows: DataFrame) -> DataFrame:
    """``row_no`` from 1 in file order of the rows, by position in the block and blocks before."""
    own = Window.partitionBy("path", "block").orderBy("local", "sub")
    counts = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = rows.withColumn("row_no", F.row_number().over(own)).join(starts, ["path", "block"])
    return placed.withColumn("row_no", (F.col("row_no") + F.col("start")).cast("bigint")).drop("start")


def _whole(read: DataFrame, end: bytes) -> DataFrame:
    """``(path, content)`` of files that are put together in one place."""
    numbers = read.withColumn("at", F.monotonically_increasing_id())
    grouped = numbers.groupBy("path", "size").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", F.hex("piece").alias("piece")))).alias("all")
    )
    text = F.unhex(F.array_join(F.transform("all", lambda p: p["piece"]), end.hex()))
    ended = F.when(F.octet_length(text) < F.col("size"), F.concat(text, F.lit(bytearray(end)))).otherwise(text)
    return grouped.select("path", ended.alias("content"))


def _csv_rows(read: DataFrame, of: DataFrame) -> DataFrame:
    """``(path, row_no, fields, cells)``: the header of a file is row 0."""
    found = cut(parts(with_states(read, of), _csv_parts))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cells = csv_cells(batch.column(3)[k].as_py())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array([batch.column(c)[k].as_py()] * len(cells), kind)
                          for c, kind in enumerate((pa.string(), pa.int64(), pa.int64()))],
                        pa.array(range(len(cells)), pa.int64()),
                        pa.array(cells, pa.list_(pa.string())),
                    ],
                    names=["path", "block", "local", "sub", "cells"],
                )

    crossed = crossing(found, b"\n").select("path", "block", "local", "text").mapInArrow(
        parsed, "path string, block bigint, local bigint, sub bigint, cells array<string>"
    )
    rows = cut(
        found.where("kind = 0")
        .select("path", "block", "local", F.lit(0).cast("bigint").alias("sub"), "cells")
        .unionByName(crossed)
    )
    place = F.struct("block", "local", "sub")
    heads = cut(
        rows.groupBy("path").agg(F.min_by("cells", place).alias("fields"), F.min(place).alias("head"))
    )
    width = F.size("fields")
    body = (
        split_join(rows, heads, ["path"], place)
        .where(place != F.col("head"))
        .where(F.exists(F.slice("cells", F.lit(1), width), lambda c: c != ""))
    )
    missing = F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size("cells")))
    cells = F.slice(F.concat("cells", missing), F.lit(1), width)
    return numbered(body).select(
        "path", "row_no", F.lit(None).cast("array<string>").alias("fields"), cells.alias("cells")
    ).unionByName(
        heads.select("path", F.lit(0).cast("bigint").alias("row_no"), "fields",
                     F.lit(None).cast("array<string>").alias("cells"))
    )


def _json_rows(read: DataFrame, of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features with their entries, parts of all blocks)."""
    found = cut(parts(with_states(read, of), _json_parts))
    order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    regions = found.where("kind = 3").select(
        "path", "block", F.coalesce(F.last("region", ignorenulls=True).over(order), F.lit(0)).alias("begins")
    )
    objects = (
        found.where("kind = 0")
        .select("path", "block", "local", "region", F.col("text").cast("string").alias("text"))
        .unionByName(crossing(found, b""))
        .join(regions, ["path", "block"])
        .where(F.coalesce("region", "begins") == 1)
    )
    feature = F.from_json("text", f"{files.FEATURE}, broken string", {"columnNameOfCorruptRecord": "broken"})
    parsed = cut(
        objects.withColumn("f", feature).select(
            "path", "block", "local", F.lit(0).alias("sub"),
            F.col("f.broken").isNotNull().alias("broken"), files.feature_entries(F.col("f")).alias("entries"),
        )
    )
    return parsed, found


def _collections(found: DataFrame, of: DataFrame, parsed: DataFrame) -> DataFrame:
    """Paths of the files that are feature collections."""
    opened = found.where("kind = 3 AND closed").select("path").distinct()
    sound = of.where("balanced").select("path").distinct()
    broken = parsed.where("broken").select("path").distinct()
    return opened.join(sound, "path").join(broken, "path", "left_anti")


def _json_heads(parsed: DataFrame, collections: DataFrame) -> DataFrame:
    """``(path, fields)``: keys of all features in the order in which they first appear."""
    keys = parsed.select("path", "block", "local", F.posexplode("entries").alias("at", "entry"))
    first = keys.groupBy("path", F.col("entry.key").alias("key")).agg(
        F.min(F.struct("block", "local", "at")).alias("first")
    )
    fields = first.groupBy("path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", "key"))), lambda e: e["key"]).alias("fields")
    )
    none = F.array().cast("array<string>")
    return collections.join(fields, "path", "left").select("path", F.coalesce("fields", none).alias("fields"))


def scan(spark: SparkSession, folder: str | list[str]) -> Scanned:
    """All readable files below a folder, or of a list of files, large ones by many tasks; see
    ``files`` for their layout."""
    folder = folder if isinstance(folder, str) else [plain_path(path) for path in folder]
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .select(F.col("_metadata.file_path").alias("file"), "path")
    )
    named = cut(files.readable(listed.select(
        F.col("file").alias("path"), files.dataset_of("path").alias("dataset_id"), files.format_of("path").alias("format")
    )))
    read_csv, read_json = pieces(spark, folder, CSV_FILES, "\n"), pieces(spark, folder, JSON_FILES, "}")
    of_csv = cut(states(block_sums(read_csv, json=False)))
    of_json = cut(states(block_sums(read_json, json=True)))

    def paths(of: DataFrame, condition: Column) -> DataFrame:
        return of.where(condition).select("path").distinct()

    in_parts = F.col("encoding").isin("utf-8", "cp932")
    rows = _csv_rows(read_csv, of_csv.where(in_parts))
    lines = rows.join(named, "path").select(
        "dataset_id", "row_no", "fields", "cells", F.lit(None).cast("string").alias("error")
    )
    json_parts = of_json.where("encoding = 'utf-8'")
    parsed, found = _json_rows(read_json, json_parts)
    sound = cut(_collections(found, json_parts, parsed))
    heads = _json_heads(parsed, sound).join(named, "path").select("dataset_id", "fields")
    kept = parsed.where(F.exists("entries", lambda e: e["value"] != "")).join(sound, "path", "left_semi")
    features = numbered(kept).join(named, "path").select(
        "dataset_id", "row_no", files.last_wins(F.col("entries")).alias("rec")
    )

    # Files that cannot be cut: their bytes in one place, read like any small file.
    wide = _whole(read_csv.join(paths(of_csv, F.col("encoding") == "utf-16"), "path", "left_semi"), b"\n")
    other = _whole(
        read_json.join(paths(of_json, F.coalesce("encoding", F.lit("")) != "utf-8"), "path", "left_semi"), b"}"
    )
    whole = cut(wide.unionByName(other).join(named, "path").select("dataset_id", "format", "content"))
    whole_datasets, whole_records = files.read_tables(spark, whole)

    datasets = cut(
        lines.where("row_no = 0").select("dataset_id", "fields").unionByName(heads).unionByName(whole_datasets)
    )
    undecodable = paths(of_csv, F.col("encoding").isNull()).withColumn("error", F.lit(files.UNDECODABLE))
    lost = named.join(datasets, "dataset_id", "left_anti").join(undecodable, "path", "left")
    none = F.when(F.col("format") == "csv", F.lit(files.NO_HEADER)).otherwise(F.lit(files.NO_FEATURES))
    errors = lost.join(files.file_errors(whole).withColumnRenamed("error", "own"), "dataset_id", "left").select(
        "dataset_id", F.coalesce("own", "error", none).alias("error")
    )
    records = files.records(lines).unionByName(features).unionByName(whole_records)
    return Scanned(datasets, records, errors)
