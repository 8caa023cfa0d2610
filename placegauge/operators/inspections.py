"""Inspections kept with the manifest, used again as long as the bytes of a dataset's files are the same.

A kept inspection has the digest of what was read, so a later run parses only datasets with another
digest.  Defined results: a dataset with several files has one digest of all of theirs; without a
digest nothing is reused; a dataset that cannot be read has no inspection and is tried again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegauge.operators import roles
from placegauge.session import cut

FOUND = {
    "sha256": "string", "sample_size": "bigint", "total": "bigint", "coord_fill": "double",
    "address_fill": "double", "has_address": "boolean", "fields": "array<string>",
}
SCHEMA = "dataset_id string, " + ", ".join(f"{c} {kind}" for c, kind in FOUND.items())


def digests(log: DataFrame) -> DataFrame:
    """(dataset_id, sha256) from a landing log; the digest of a single file is its own."""
    several = F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("sha256"))), 256)
    one = F.when(F.count(F.lit(1)) == 1, F.min("sha256")).otherwise(several)
    return log.groupBy("dataset_id").agg(one.alias("sha256")).where("sha256 IS NOT NULL")


def inspected(datasets: DataFrame, records: DataFrame) -> DataFrame:
    """What all rows of each dataset say: ``FOUND`` without the digest."""
    table = cut(roles.role_table(datasets))
    rates = roles.fill_rates(records, table, datasets)
    return rates.join(
        table.select("dataset_id", F.col("address_field").isNotNull().alias("has_address")), "dataset_id"
    ).join(datasets.select("dataset_id", "fields"), "dataset_id")


def known(current: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept inspections of datasets whose digest is still the same, one each."""
    found = F.struct(*[F.col(c).cast(kind).alias(c) for c, kind in FOUND.items() if c != "sha256"])
    first = kept.groupBy("dataset_id", "sha256").agg(F.min(found).alias("found"))
    return current.join(first, ["dataset_id", "sha256"]).select("dataset_id", "sha256", "found.*")


def changed(current: DataFrame, kept: DataFrame) -> DataFrame:
    """(dataset_id, sha256) of datasets that have to be read."""
    return current.join(kept.select("dataset_id", "sha256"), ["dataset_id", "sha256"], "left_anti")


def renewed(current: DataFrame, kept: DataFrame, datasets: DataFrame, records: DataFrame) -> DataFrame:
    """Inspections of all datasets, with ``reused``; only rows of changed ones are looked at."""
    todo = cut(changed(current, kept))
    ids = todo.select("dataset_id")
    fresh = inspected(
        datasets.join(ids, "dataset_id", "left_semi"), records.join(ids, "dataset_id", "left_semi")
    ).join(todo, "dataset_id")
    return (
        known(current, kept).withColumn("reused", F.lit(True))
        .unionByName(fresh.withColumn("reused", F.lit(False)))
    )


def attach(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Manifest entries with their ``inspection``; ``found`` is keyed (feature, dataset_id)."""
    values = [
        (F.col(c) if c in found.columns else F.lit(None)).cast(kind).alias(c) for c, kind in FOUND.items()
    ]
    narrow = found.select("feature", "dataset_id", F.struct(*values).alias("inspection"))
    return entries.drop("inspection").join(narrow, ["feature", "dataset_id"], "left")


def of_manifest(entries: DataFrame) -> DataFrame:
    """The kept inspections of a manifest, to be used again."""
    return entries.where("inspection.sha256 IS NOT NULL").select("dataset_id", "inspection.*").distinct()
