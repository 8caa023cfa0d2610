"""Landed open-data files: what arrived, in which encoding, and their rows.

Files lie at ``<folder>/<feature>/<dataset_id>.<format>``.  One scan decodes and splits a file and
numbers its rows, with the header as row 0, so numbers and headers cannot disagree.  Headers differ
per dataset, hence records are string maps.  A file that cannot be read becomes one row with its
error; the others are not affected.  ``read_tables`` takes the bytes of a file whole, at most 2 GB;
``ranges.scan`` reads files of any size by their blocks, with the same rows.
"""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.functions.text import strip
from placegauge.operators.skew import split_join

UNDECODABLE = "undecodable bytes"
NO_HEADER = "no header"
NO_FEATURES = "no feature collection"
ROW_BATCH = 5_000


def dataset_of(path: str) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.url_decode(F.regexp_replace(name, "\\.[^.]*$", ""))


def format_of(path: str) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]*)$", 1))


def landed(spark: SparkSession, folder: str, glob: str = "*.*") -> DataFrame:
    """One row per file: dataset_id, format, path, bytes, retrieved_at, content.

    Column pruning keeps ``content`` unread where it is not asked for.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(folder)
    )
    return files.select(
        dataset_of("path").alias("dataset_id"),
        format_of("path").alias("format"),
        "path",
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("retrieved_at"),
        "content",
    )


def decode(content: bytes) -> tuple[str | None, str | None]:
    """(encoding, text): UTF-16 by its mark, else UTF-8 or CP932, whichever the whole file is."""
    marked = content[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)
    for encoding in ("utf-16",) if marked else ("utf-8", "cp932"):
        try:
            return encoding, content.decode(encoding).replace("\ufeff", "")
        except UnicodeDecodeError:
            continue
    return None, None


def decoded(files: DataFrame) -> DataFrame:
    """``encoding, text`` instead of ``content``; both null where the bytes are in no encoding."""
    others = [f for f in files.schema if f.name != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one file at a time
                content = batch["content"][k].as_py()
                encoding, text = decode(content) if content is not None else (None, None)
                yield pa.RecordBatch.from_arrays(
                    [*[batch[f.name].slice(k, 1) for f in others],
                     pa.array([encoding], pa.string()), pa.array([text], pa.string())],
                    [*[f.name for f in others], "encoding", "text"],
                )

    rows = files.select(*[f.name for f in others], "content")
    schema = rows.drop("content").schema.add("encoding", "string").add("text", "string")
    return rows.mapInArrow(run, schema)


def landing_log(files: DataFrame) -> DataFrame:
    """Provenance of each file: sha256 of its bytes, and the encoding that it is read in."""
    kept = decoded(files.withColumn("sha256", F.sha2("content", 256)))
    return kept.select("dataset_id", "path", "bytes", "retrieved_at", "sha256", "encoding")


def readable(files: DataFrame) -> DataFrame:
    """Files of a readable format; others fail their dataset, never the run."""
    return files.where(F.col("format").isin(*fv.READABLE_FORMATS))


LINES = (
    "dataset_id string, row_no bigint, fields array<string>, cells array<string>, error string"
)


def _csv_lines(files: DataFrame) -> DataFrame:
    """Rows of CSV files, blank ones left out; the first is the header and has the fields.

    A row has as many cells as the header, and no row of a file without a header is kept.
    """

    def lines(dataset: str, content: bytes) -> Iterator[tuple]:
        encoding, text = decode(content)
        if encoding is None:
            yield dataset, None, None, None, UNDECODABLE
            return
        csv.field_size_limit(2**31 - 1)
        width, number = None, 0
        for row in csv.reader(io.StringIO(text, newline="")):
            cells = [cell.strip() for cell in row]
            if not any(cells[:width]):
                continue
            if width is None:
                width = len(cells)
                yield dataset, 0, cells, None, None
            else:
                yield dataset, number, None, (cells + [""] * width)[:width], None
            number += 1
        if width is None:
            yield dataset, None, None, None, NO_HEADER

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            ["dataset_id", "row_no", "fields", "cells", "error"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dataset, content in zip(batch["dataset_id"], batch["content"], strict=True):
                held = []
                for row in lines(dataset.as_py(), content.as_py()):
                    held.append(row)
                    if len(held) == ROW_BATCH:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    csv_files = files.where((F.col("format") == "csv") & F.col("content").isNotNull())
    return csv_files.select("dataset_id", "content").mapInArrow(run, LINES)


def _last_of_each(fields: Column) -> Column:
    """Positions of the headers that are not repeated further right."""
    at = F.sequence(F.lit(0), F.size(fields) - 1)
    return F.filter(
        at,
        lambda i: ~F.array_contains(F.slice(fields, i + 2, F.size(fields)), F.get(fields, i)),
    )


def records(lines: DataFrame) -> DataFrame:
    """Cells of each row by the header of its file."""
    kept = _last_of_each(F.col("fields"))
    heads = lines.where("row_no = 0").select("dataset_id", kept.alias("kept"), "fields").select(
        "dataset_id", "kept", F.transform("kept", lambda i: F.get("fields", i)).alias("names")
    )
    rec = F.map_from_arrays("names", F.transform("kept", lambda i: F.get("cells", i)))
    rows = lines.where("row_no > 0").select("dataset_id", "row_no", "cells")
    return split_join(rows, heads, ["dataset_id"], F.col("row_no")).select(
        "dataset_id", "row_no", rec.alias("rec")
    )


FEATURE = "properties map<string,string>, geometry struct<type string, coordinates string>"


def feature_entries(feature: Column) -> Column:
    """Keys and values of a GeoJSON feature: its properties, then the place of a point."""
    point = F.from_json(feature["geometry"]["coordinates"], "array<string>")
    is_point = F.coalesce(
        (feature["geometry"]["type"] == "Point") & (F.size(point) >= 2), F.lit(False)
    )
    entry = "array<struct<key string, value string>>"
    props = F.transform(
        F.coalesce(F.map_entries(feature["properties"]), F.array().cast(entry)),
        lambda e: F.struct(
            strip(e["key"]).alias("key"),
            F.coalesce(strip(e["value"]), F.lit("")).alias("value"),
        ),
    )
    placed = F.array(
        F.struct(F.lit(fv.GEOJSON_LAT).alias("key"), F.get(point, 1).alias("value")),
        F.struct(F.lit(fv.GEOJSON_LNG).alias("key"), F.get(point, 0).alias("value")),
    )
    return F.concat(props, F.when(is_point, placed).otherwise(F.array().cast(entry)))


def last_wins(entries: Column) -> Column:
    """Of entries with one key the last counts, so a geometry overrides its properties."""
    return F.map_from_entries(
        F.filter(
            entries,
            lambda e, i: ~F.exists(
                F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]
            ),
        )
    )


def _geojson_rows(files: DataFrame) -> DataFrame:
    """(dataset_id, fields, rows, error) per JSON file; rows only of feature collections."""
    schema = f"features array<struct<{FEATURE}>>"
    docs = decoded(files.where(F.col("format").isin("geojson", "json"))).select(
        "dataset_id", "encoding", F.from_json("text", schema)["features"].alias("f")
    )

    rows = F.transform("f", feature_entries)
    error = F.when(F.col("encoding").isNull(), F.lit(UNDECODABLE)).when(F.col("f").isNull(), F.lit(NO_FEATURES))
    return docs.withColumn("rows", rows).select(
        "dataset_id",
        error.alias("error"),
        F.array_distinct(
            F.flatten(F.transform("rows", lambda r: F.transform(r, lambda e: e["key"])))
        ).alias("fields"),
        F.transform(
            F.filter("rows", lambda r: F.exists(r, lambda e: e["value"] != "")), last_wins
        ).alias("rows"),
    )


def read_tables(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(datasets, records) of all readable files.

    datasets: dataset_id, fields.  records: dataset_id, row_no (1-based, blank rows not counted),
    rec.  Files that cannot be read are in neither, but in ``file_errors``.
    """
    lines, collections = _csv_lines(files), _geojson_rows(files)
    heads = lines.where("row_no = 0").select("dataset_id", "fields")
    geo = collections.where("error IS NULL")
    rows = geo.select("dataset_id", F.posexplode("rows").alias("at", "rec")).select(
        "dataset_id", (F.col("at") + 1).cast("long").alias("row_no"), "rec"
    )
    return heads.unionByName(geo.select("dataset_id", "fields")), records(lines).unionByName(rows)


def file_errors(files: DataFrame) -> DataFrame:
    """(dataset_id, error) of the files of a readable format that cannot be read."""
    parts = _csv_lines(files), _geojson_rows(files)
    one, two = (p.where("error IS NOT NULL").select("dataset_id", "error") for p in parts)
    return one.unionByName(two)


def rail_stations(spark: SparkSession, path: str) -> DataFrame:
    """Rail stations of a GeoJSON file with line geometries, in file order (``pos``)."""
    schema = (
        "features array<struct<properties struct<N02_003 string, N02_004 string, N02_005 string, "
        "N02_005g string>, geometry struct<type string, coordinates array<array<double>>>>>"
    )
    docs = spark.read.text(path, wholetext=True)
    features = docs.select(
        F.posexplode(F.from_json("value", schema)["features"]).alias("pos", "f")
    )
    return features.select(
        "pos",
        F.col("f.properties.N02_005").alias("station"),
        F.col("f.properties.N02_004").alias("operator"),
        F.col("f.properties.N02_003").alias("line"),
        F.col("f.properties.N02_005g").alias("group_code"),
        F.col("f.geometry.coordinates").alias("vertices"),
    )
