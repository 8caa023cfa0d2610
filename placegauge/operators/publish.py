"""From aggregates and manifest to the published tables. Long tables throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.operators.skew import split_join


def _feature_rows(df: DataFrame, features) -> DataFrame:
    return df.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))


def feature_sources(aggregates: DataFrame, features=fv.FEATURES) -> DataFrame:
    """(feature, real): whether any aggregate exists for the feature."""
    spark = aggregates.sparkSession
    wanted = _feature_rows(spark.range(1), features).select("feature")
    real = wanted.intersect(aggregates.select("feature"))
    base = wanted.subtract(aggregates.select("feature"))
    return real.withColumn("real", F.lit(True)).unionByName(base.withColumn("real", F.lit(False)))


def raw_matrix(
    sites: DataFrame, aggregates: DataFrame, base: DataFrame | None = None, features=fv.FEATURES
) -> DataFrame:
    """(site_id, feature, raw) for every site and feature.

    A real feature takes its aggregate's count; a site without one is missing, never 0.  Features
    without any aggregate take the base value.  ``base``: site_id, feature, raw.
    """
    wanted = _feature_rows(sites.select("site_id"), features)
    counted = aggregates.select("site_id", "feature", F.col("count").cast("double").alias("count"))
    out = wanted.join(counted, ["site_id", "feature"], "left")
    if base is None:
        return out.withColumnRenamed("count", "raw")
    real = feature_sources(aggregates, features).where("real")
    values = base.join(real, "feature", "left_anti").select(
        "site_id", "feature", F.col("raw").cast("double").alias("base")
    )
    return out.join(values, ["site_id", "feature"], "left").select(
        "site_id", "feature", F.coalesce("count", "base").alias("raw")
    )


def trim_base_sources(sources: DataFrame, aggregates: DataFrame, features=fv.FEATURES) -> DataFrame:
    """Base sources of kind ``fixture`` keep only features that are not real yet, and go when none
    is left; other sources stay. ``sources``: id, kind, features array<string>."""
    real = [F.collect_set(F.when(F.col("feature") == f, F.col("feature"))) for f in features]
    known = aggregates.agg(F.flatten(F.array(*real)).alias("real"))  # one row, at most six words
    joined = sources.withColumn("one", F.lit(1)).join(
        F.broadcast(known.withColumn("one", F.lit(1))), "one"
    )
    left = F.array_except(F.array_intersect("features", F.array(*[F.lit(f) for f in features])),
                          F.col("real"))
    trimmed = F.when(F.col("kind") == "fixture", left).otherwise(F.col("features"))
    return (
        joined.withColumn("features", trimmed)
        .where((F.col("kind") != "fixture") | (F.size("features") > 0))
        .drop("one", "real")
    )


def site_sources(evidence: DataFrame, manifest: DataFrame) -> DataFrame:
    """(site_id, feature, source_id, source_name, organization, url, license, kind).

    Evidence of unknown datasets is dropped.
    """
    organization = F.coalesce("organization", F.lit(""))
    described = manifest.select(
        "feature",
        "dataset_id",
        F.trim(F.concat_ws(" ", organization, "name")).alias("source_name"),
        F.nullif(organization, F.lit("")).alias("organization"),
        F.col("source_url").alias("url"),
        "license",
        F.lit("opendata").alias("kind"),
    )
    joined = split_join(evidence, described, ["feature", "dataset_id"], F.col("site_id"))
    return joined.withColumnRenamed("dataset_id", "source_id")


def all_sources(dataset_sources: DataFrame, others: DataFrame, real: list[str]) -> DataFrame:
    """Sources of datasets and others of the same columns (base data, yearbook); what only stood in
    for a feature that has real values now is left out."""
    stale = (F.col("kind") == "fixture") & F.col("feature").isin(*real)
    return dataset_sources.unionByName(others.where(~F.coalesce(stale, F.lit(False))))


def register(manifest: DataFrame, report: DataFrame) -> DataFrame:
    """Accepted datasets with what ingest made of them (null when not ingested), and with the time
    and digest of their file where the report has them."""
    landed = [c for c in ("retrieved_at", "sha256", "encoding") if c in report.columns]
    ingest = report.select(
        "feature",
        "dataset_id",
        *landed,
        F.struct(
            F.col("status"),
            F.col("rows"),
            (F.coalesce("with_source", F.lit(0)) + F.coalesce("geocoded", F.lit(0))).alias(
                "located"
            ),
            F.col("unlocated"),
            F.col("excluded"),
            F.col("outside"),
            F.col("error"),
        ).alias("ingest"),
    )
    return (
        manifest.where(F.col("status") == "accepted")
        .join(ingest, ["feature", "dataset_id"], "left")
        .select(
            "feature",
            "dataset_id",
            "name",
            "organization",
            "license",
            "source_url",
            "status",
            F.coalesce("auto_status", "status").alias("auto_status"),
            F.col("review.note").alias("review_note"),
            "reason",
            "ingest",
            *landed,
        )
    )


def register_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("feature", F.coalesce("organization", F.lit("")), "name")


def site_documents(
    sites: DataFrame, ranked: DataFrame, table: DataFrame, weights: DataFrame
) -> DataFrame:
    """One nested row per site: values of the fixed features as maps, score and ranking.

    Sources and facilities stay in their own tables: a site may have any number of them.
    """

    def by_feature(column: str) -> Column:
        entries = F.collect_list(F.struct("feature", column))  # one per feature
        return F.map_from_entries(F.array_sort(entries))

    values = ranked.groupBy("site_id").agg(
        by_feature("raw").alias("raw"),
        by_feature("percentile").alias("normalized"),
        by_feature("low").alias("lows"),
    )
    shares = weights.groupBy("site_id").agg(by_feature("effective_weight").alias("weights"))
    ranking = F.when(
        F.col("rank").isNotNull(),
        F.struct("rank", "of", F.array("rank_min", "rank_max").alias("range")),
    )
    return (
        sites.join(values, "site_id")
        .join(shares, "site_id")
        .join(table, "site_id")
        .select(
            *sites.columns, "raw", "normalized", "lows", "weights", "score", "coverage",
            ranking.alias("ranking"),
        )
    )
