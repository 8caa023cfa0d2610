"""Landed catalog metadata, labelled sets, and the result tables between jobs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placegauge.operators.quality import require_clean

PACKAGE_SCHEMA = """
    id string, name string, title string, notes string, license_id string, license_title string,
    metadata_modified string, organization struct<title string>, tags array<struct<name string>>,
    extras array<struct<key string, value string>>,
    resources array<struct<id string, name string, format string, url string,
        datastore_active boolean, last_modified string, metadata_modified string>>
"""
LABELLED_SCHEMA = (
    "name string, categories string, source string, organization string, columns array<string>, "
    "rule string, label string, ambiguous boolean, destination boolean"
)
UPDATE_FREQUENCY = "更新頻度"


def packages(spark: SparkSession, path: str, page_prefix: str) -> DataFrame:
    """Catalog packages from JSON lines, in the flat form the catalog operators take."""
    raw = spark.read.schema(PACKAGE_SCHEMA).json(path)
    frequency = F.get(F.filter("extras", lambda x: x["key"] == UPDATE_FREQUENCY), 0)["value"]
    return raw.select(
        "id",
        "name",
        "title",
        "notes",
        F.col("organization.title").alias("organization"),
        "license_id",
        "license_title",
        "metadata_modified",
        F.transform(
            F.coalesce("tags", F.array().cast("array<struct<name string>>")), lambda t: t["name"]
        ).alias("tags"),
        frequency.alias("update_frequency"),
        F.concat(F.lit(page_prefix), "name").alias("source_url"),
        F.coalesce(
            "resources",
            F.array().cast(
                "array<struct<id string, name string, format string, url string, "
                "datastore_active boolean, last_modified string, metadata_modified string>>"
            ),
        ).alias("resources"),
    )


def labelled_items(spark: SparkSession, path: str) -> DataFrame:
    """Labelled evaluation set from JSON lines."""
    return spark.read.schema(LABELLED_SCHEMA).json(path)


def write_feature_table(df: DataFrame, path: str) -> None:
    """Replaces the features present in ``df`` and leaves all other partitions as they are."""
    (
        df.write.mode("overwrite")
        .partitionBy("feature")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def read_feature_table(spark: SparkSession, path: str, features: list[str] | None = None):
    """A per-feature table; a feature list prunes partitions."""
    table = spark.read.parquet(path)
    return table.where(F.col("feature").isin(*features)) if features else table


LOG = "number bigint, name string, feature string, path string, format string, columns string"


@dataclass(frozen=True)
class Publication:
    """A table to publish.  ``gate`` gives (rule, key) of what is wrong with the rows as written.

    With ``features`` only those partitions are renewed, also the ones that have no row any more.
    """

    rows: DataFrame
    gate: Callable[[DataFrame], DataFrame] | None = None
    features: list[str] | None = None
    format: str = "parquet"


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LOG).json(f"{folder}/published_log")


def publish(spark: SparkSession, folder: str, tables: dict[str, Publication], what: str) -> None:
    """Renews several tables at once, or none of them.

    All tables are written into new folders first, where no reader looks, and their gates read what
    was written.  If all are clean, one file that is added to the log makes them current together;
    a run that fails before that leaves the published tables as they were.  One writer at a time.
    """
    entries, violations = [], None
    for name, table in tables.items():
        path = f"{name}/{uuid.uuid4().hex}"
        write = table.rows.write.partitionBy("feature") if table.features is not None else table.rows.write
        write.format(table.format).save(f"{folder}/{path}")
        columns = table.rows.schema.json()
        if table.gate is not None:
            staged = spark.read.schema(table.rows.schema).format(table.format).load(f"{folder}/{path}")
            found = table.gate(staged).select(F.concat(F.lit(f"{name}: "), "rule").alias("rule"), "key")
            violations = found if violations is None else violations.unionByName(found)
        for feature in [None] if table.features is None else table.features:
            entries.append((name, feature, path, table.format, columns))
    if violations is not None:
        require_clean(violations, what)
    # The log is there to be read, also before the first entry.
    spark.createDataFrame([], LOG).write.mode("append").json(f"{folder}/published_log")
    last = _log(spark, folder).agg(F.max("number")).first()[0] or 0
    rows = spark.createDataFrame([(last + 1, *entry) for entry in entries], LOG)
    rows.coalesce(1).write.mode("append").json(f"{folder}/published_log")


def current(spark: SparkSession, folder: str, name: str, features: list[str] | None = None) -> DataFrame:
    """The rows of a published table, of some features or all."""
    entry = F.struct("path", "format", "columns")
    latest = _log(spark, folder).where(F.col("name") == name).groupBy("feature").agg(
        F.max_by(entry, "number").alias("entry")
    )
    if features is not None:
        latest = latest.where(F.col("feature").isin(*features))
    folders: dict[tuple, list[str]] = {}
    for feature, at in latest.orderBy("feature").collect():  # a row a feature
        folders.setdefault(tuple(at), []).append(feature)
    if not folders:
        raise ValueError(f"{name} is not published below {folder}")
    parts = []
    for (path, kind, columns), own in folders.items():
        schema = T.StructType.fromJson(json.loads(columns))
        rows = spark.read.schema(schema).format(kind).load(f"{folder}/{path}").select(*schema.names)
        parts.append(rows if own == [None] else rows.where(F.col("feature").isin(*own)))
    return reduce(lambda one, more: one.unionByName(more, allowMissingColumns=True), parts)
