"""When is a count a count?  Only where every touched municipality has complete data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.operators.skew import split_join


def municipality_coverage(report: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(feature, organization, coverage, rows, unlocated); absent means uncovered.

    Only fetched datasets count, and organizations that span municipalities prove nothing.
    """
    fetched = report.where(
        F.col("status").isin("ok", "degraded")
        & (F.coalesce(F.col("organization"), F.lit("")) != "")
        & ~F.col("organization").isin(*fv.CROSS_MUNICIPAL_ORGS)
    )
    sums = fetched.groupBy("feature", "organization").agg(
        F.sum(F.coalesce("rows", F.lit(0))).alias("rows"),
        F.sum(F.coalesce("unlocated", F.lit(0))).alias("unlocated"),
        F.bool_or(F.col("status") == "degraded").alias("degraded"),
    )
    share = F.try_divide(F.col("unlocated").cast("double"), F.col("rows").cast("double"))
    tolerated = F.coalesce((F.col("rows") > 0) & (share <= tolerance), F.lit(False))
    covered = ~F.col("degraded") & ((F.col("unlocated") == 0) | tolerated)
    return sums.select(
        "feature",
        "organization",
        F.when(covered, F.lit("covered")).otherwise(F.lit("partial")).alias("coverage"),
        "rows",
        "unlocated",
    )


def area_coverage(site_areas: DataFrame, coverage: DataFrame, features: list[str]) -> DataFrame:
    """(site_id, feature, code, name, coverage, unlocated): the municipalities behind a count."""
    wanted = site_areas.withColumn(
        "feature", F.explode(F.array(*[F.lit(f) for f in features]))
    )
    known = coverage.select(
        "feature",
        F.col("organization").alias("name"),
        F.col("coverage").alias("known"),
        F.col("unlocated").alias("missing"),
    )
    joined = split_join(wanted, known, ["feature", "name"], F.col("site_id"), "left")
    return joined.select(
        "site_id",
        "feature",
        "code",
        "name",
        F.coalesce("known", F.lit("uncovered")).alias("coverage"),
        F.coalesce("missing", F.lit(0)).cast("long").alias("unlocated"),
    )


def site_aggregates(counts: DataFrame, covered_areas: DataFrame) -> DataFrame:
    """(site_id, feature, status, count, lower_bound): count is null unless complete.

    Counts and area states meet in one grouping instead of a join.
    """
    n_rows = counts.select(
        "site_id", "feature", F.col("n").cast("long"), F.lit(None).cast("boolean").alias("covered")
    )
    area_rows = covered_areas.select(
        "site_id",
        "feature",
        F.lit(None).cast("long").alias("n"),
        (F.col("coverage") == "covered").alias("covered"),
    )
    grouped = (
        n_rows.unionByName(area_rows)
        .groupBy("site_id", "feature")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("lower_bound"),
            F.coalesce(F.bool_and("covered"), F.lit(False)).alias("complete"),
        )
    )
    return grouped.select(
        "site_id",
        "feature",
        F.when(F.col("complete"), F.lit("complete")).otherwise(F.lit("incomplete")).alias("status"),
        F.when(F.col("complete"), F.col("lower_bound")).alias("count"),
        "lower_bound",
    )


def evidence_datasets(pairs: DataFrame, site_areas: DataFrame, report: DataFrame) -> DataFrame:
    """(site_id, feature, dataset_id): datasets that found something near, and the fetched ones of
    the touched municipalities, which are evidence even when they found nothing.

    ``pairs`` may hold a site and dataset once or once a facility."""
    found = pairs.select("site_id", "feature", "dataset_id")
    fetched = report.where(F.col("status").isin("ok", "degraded")).select(
        "feature", F.col("organization").alias("name"), "dataset_id"
    )
    backing = split_join(site_areas, fetched, ["name"], F.col("site_id"))
    backing = backing.select("site_id", "feature", "dataset_id")
    return found.unionByName(backing).distinct()
