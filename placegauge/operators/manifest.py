"""The table of dataset decisions, keyed (feature, dataset_id)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.functions.text import title_key
from placegauge.operators.skew import split_join
from placegauge.session import cut


def mark_duplicates(entries: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Adds ``duplicate_of``; an accepted duplicate goes back to review, with a note.

    Going by confidence, then id, the first entry of an (organization, title) or of a resource URL
    is the original of the later ones; the title counts before the URL.  Rejected entries are
    originals but never duplicates.  The first of a key is a min, so a key with very many entries
    is one small aggregate per task.
    """
    own = F.col("dataset_id")
    # Narrow keys, read by several branches.  Titles are only compared, so a digest will do.
    keyed = cut(
        entries.select(
            "feature",
            "dataset_id",
            (-F.col("confidence")).alias("__rank"),
            F.coalesce("organization", F.lit("")).alias("__org"),
            F.sha2(title_key(F.col("name")), 256).alias("__title"),
            F.sha2(F.nullif("resource_url", F.lit("")), 256).alias("__url"),
        )
    )

    def firsts(keys: list[str], name: str) -> DataFrame:
        first = F.min(F.struct("__rank", "dataset_id"))["dataset_id"]
        return keyed.dropna(subset=keys).groupBy(*keys).agg(
            first.alias(name), F.count(F.lit(1)).alias("__n")
        )

    joined = keyed
    for keys, name in ((["feature", "__org", "__title"], "__t"), (["feature", "__url"], "__u")):
        table = firsts(keys, name)
        joined = split_join(
            joined, table.drop("__n"), keys, own, "left", hot_rows, table.drop(name)
        )
    original = F.coalesce(
        F.when(F.col("__t") != own, F.col("__t")), F.when(F.col("__u") != own, F.col("__u"))
    )
    originals = (
        joined.withColumn("__original", original)
        .where("__original IS NOT NULL")
        .groupBy("feature", "dataset_id")
        .agg(F.min("__original").alias("__original"))
    )
    before, after = fv.REASON_DUPLICATE.split("{original}")
    demoted = F.col("duplicate_of").isNotNull() & (F.col("status") == "accepted")
    note = F.concat(F.col("reason"), F.lit(before), F.col("duplicate_of"), F.lit(after))
    return (
        entries.join(originals, ["feature", "dataset_id"], "left")
        .withColumn("duplicate_of", F.when(F.col("status") != "rejected", F.col("__original")))
        .withColumns(
            {
                "reason": F.when(demoted, note).otherwise(F.col("reason")),
                "auto_status": F.when(demoted, F.lit("review")).otherwise(F.col("auto_status")),
                "status": F.when(demoted, F.lit("review")).otherwise(F.col("status")),
            }
        )
        .select(*entries.columns, *([] if "duplicate_of" in entries.columns else ["duplicate_of"]))
    )


def invalid_overrides(overrides: DataFrame) -> DataFrame:
    """Overrides whose status is not one of the known three."""
    return overrides.where(~F.coalesce(F.col("status").isin(*fv.STATUSES), F.lit(False)))


def apply_overrides(entries: DataFrame, overrides: DataFrame) -> DataFrame:
    """Human decisions over automatic ones; ``auto_status`` keeps the latter.

    ``overrides``: feature (null for all features), dataset_id, status, note.  One for the feature
    goes before one for all.
    """

    def renamed(rows: DataFrame, prefix: str, *keys: str) -> DataFrame:
        return rows.select(
            *keys,
            F.struct("status", F.coalesce("note", F.lit("")).alias("note")).alias(prefix),
        )

    narrow = renamed(overrides.where("feature IS NOT NULL"), "narrow", "feature", "dataset_id")
    wide = renamed(overrides.where("feature IS NULL"), "wide", "dataset_id")
    joined = entries.join(narrow, ["feature", "dataset_id"], "left").join(
        wide, "dataset_id", "left"
    )
    review = F.coalesce("narrow", "wide")
    kept = [c for c in entries.columns if c not in ("status", "review")]
    return joined.select(
        *kept, F.coalesce(review["status"], F.col("status")).alias("status"), review.alias("review")
    )


def _counts() -> list[Column]:
    by_status = [F.count_if(F.col("status") == s).alias(s) for s in fv.STATUSES]
    return [F.count(F.lit(1)).alias("candidates"), *by_status]


def status_counts(entries: DataFrame) -> DataFrame:
    """(feature, candidates, accepted, review, rejected)"""
    return entries.groupBy("feature").agg(*_counts())


def feature_totals(entries: DataFrame, searched: Iterable[str]) -> DataFrame:
    """``status_counts`` and the entries with an inspection, for every searched feature; 0 without a hit."""
    spark = entries.sparkSession
    features = spark.createDataFrame([(f,) for f in searched], "feature string")
    counted = entries.groupBy("feature").agg(*_counts(), F.count("inspection").alias("inspected"))
    return features.join(counted, "feature", "left").fillna(0)


def replace_features(
    existing: DataFrame, entries: DataFrame, searched: Iterable[str]
) -> DataFrame:
    """All entries of the searched features replaced, also of those now without a hit; every other
    feature untouched."""
    renewed = F.coalesce(F.col("feature").isin(*searched), F.lit(False))
    return existing.where(~renewed).unionByName(entries, allowMissingColumns=True)
