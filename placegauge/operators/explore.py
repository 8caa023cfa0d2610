"""Questions asked of the published table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.functions.text import strip


def search(sites: DataFrame, query: str) -> DataFrame:
    """Sites whose name, English name or id contains the query; all for a blank one."""
    q = F.lower(strip(F.lit(query)))
    if not query.strip():
        return sites
    found = (
        F.contains(F.col("name"), q)
        | F.coalesce(F.contains(F.lower("name_en"), q), F.lit(False))
        | F.contains(F.col("site_id"), q)
    )
    return sites.where(found)


def sort_key(by: str) -> Column:
    """Value a list is sorted by: score, name (as read, collated) or a feature's percentile."""
    if by == "score":
        return F.col("score")
    if by == "name":
        return F.collate(F.lower(F.coalesce("name_en", "name")), "ja")
    return F.col(f"percentile_{by}")


def sort_sites(table: DataFrame, by: str, descending: bool) -> DataFrame:
    """Stable order; missing values last either way. Needs ``pos``."""
    key = sort_key(by)
    ordered = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return table.orderBy(ordered, "pos")


def top_sites(table: DataFrame, limit: int) -> DataFrame:
    """The best scored sites; earlier position on ties."""
    return (
        table.where("score IS NOT NULL").orderBy(F.col("score").desc(), F.col("pos")).limit(limit)
    )


def missing_reasons(ranked: DataFrame, covered_areas: DataFrame) -> DataFrame:
    """(site_id, feature, municipality, coverage, not_comparable) for unranked features.

    One row per not covered municipality; municipality is null where none is to blame.
    """
    missing = ranked.where("percentile IS NULL").select(
        "site_id", "feature", F.col("raw").isNotNull().alias("not_comparable")
    )
    blamed = covered_areas.where(F.col("coverage") != "covered").select(
        "site_id", "feature", F.col("name").alias("municipality"), "coverage"
    )
    return missing.join(blamed, ["site_id", "feature"], "left").select(
        "site_id", "feature", "municipality", "coverage", "not_comparable"
    )


def observation_numbers(sites: DataFrame) -> DataFrame:
    """(site_id, observation): 1-based position the site list gives, never recomputed."""
    return sites.select("site_id", (F.col("pos") + 1).alias("observation"))


def headline_counts(table: DataFrame, sources: DataFrame) -> DataFrame:
    """(sites, scored, sources): one row, distinct sources by id."""
    from_table = table.agg(
        F.count(F.lit(1)).alias("sites"), F.count_if(F.col("score").isNotNull()).alias("scored")
    )
    from_sources = sources.agg(F.count_distinct("source_id").alias("sources"))
    return from_table.unionByName(from_sources, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("sites", "scored", "sources")]
    )


def register_stats(status_counts: DataFrame, features=fv.FEATURES) -> DataFrame:
    """Counts per feature in display order (``order``)."""
    position = F.create_map(*[F.lit(v) for i, f in enumerate(features) for v in (f, i)])
    return status_counts.where(F.col("feature").isin(*features)).withColumn(
        "order", F.element_at(position, F.col("feature"))
    )
