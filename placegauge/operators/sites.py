"""Sites from configured names, rail stations and the yearbook's English spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placegauge.functions.rounding import round_half_even
from placegauge.functions.text import line_label, slug


def _vertex_mean(axis: int) -> Column:
    total = F.aggregate("vertices", F.lit(0.0), lambda s, v: s + v[axis])
    return F.try_divide(total, F.size("vertices"))


def own_stations(names: DataFrame, rail: DataFrame, operator: str) -> DataFrame:
    """Rail stations of the configured names and operator.

    ``rail``: pos, station, operator, line, group_code, vertices array<array<double>> (lng, lat).
    """
    return rail.where(F.col("operator") == operator).join(
        names.select(F.col("name").alias("station")), "station"
    )


def site_positions(own: DataFrame) -> DataFrame:
    """(name, lat, lng): mean of the vertex means of a site's stations, 6 decimals."""
    means = own.select(
        F.col("station").alias("name"), _vertex_mean(1).alias("lat"), _vertex_mean(0).alias("lng")
    )
    averaged = means.groupBy("name").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    return averaged.select(
        "name", *[round_half_even(F.col(c), 6).alias(c) for c in ("lat", "lng")]
    )


def site_groups(own: DataFrame) -> DataFrame:
    """(name, group_code), distinct."""
    return own.select(F.col("station").alias("name"), "group_code").distinct()


def site_lines(own: DataFrame, rail: DataFrame) -> DataFrame:
    """(name, label, first_pos): lines of all operators in a site's groups, by first appearance.

    Labels are reduced per group before the groups meet the sites.
    """
    per_group = (
        rail.withColumn("label", line_label(F.col("operator"), F.col("line")))
        .groupBy("group_code", "label")
        .agg(F.min("pos").alias("first_pos"))
    )
    return (
        site_groups(own)
        .join(per_group, "group_code")
        .groupBy("name", "label")
        .agg(F.min("first_pos").alias("first_pos"))
    )


def site_master(names: DataFrame, rail: DataFrame, operator: str, english: DataFrame) -> DataFrame:
    """(pos, site_id, name, name_en, lat, lng) of every name that could be resolved.

    ``names``: pos, name.  Check ``unresolved`` and ``duplicates``: nothing is ever guessed.
    """
    own = own_stations(names, rail, operator)
    spelled = english.select(F.col("station").alias("name"), F.col("station_en").alias("name_en"))
    return (
        names.join(site_positions(own), "name")
        .join(spelled, "name")
        .select(
            "pos", slug(F.col("name_en")).alias("site_id"), "name", "name_en", "lat", "lng"
        )
    )


def site_children(
    master: DataFrame, own: DataFrame, rail: DataFrame, here: DataFrame, touched: DataFrame
) -> DataFrame:
    """(site_id, kind, place, value): what a site has several of, in order from 1.

    Lines by first appearance, station groups, and the municipalities that hold the site (``here``) or
    are touched by its radius (``touched``), both (site_id, code, name), by code.
    """
    ids = master.select("site_id", "name")
    lines = site_lines(own, rail).join(ids, "name").select(
        "site_id", F.lit("line").alias("kind"), F.struct(F.col("first_pos"), F.col("label").alias("by")).alias("at"),
        F.col("label").alias("value"),
    )

    def sorted_by(df: DataFrame, kind: str, by: str, value: str) -> DataFrame:
        at = F.struct(F.lit(0).cast("bigint").alias("first_pos"), F.col(by).alias("by"))
        return df.select("site_id", F.lit(kind).alias("kind"), at.alias("at"), F.col(value).alias("value"))

    known = master.select("site_id")
    rows = (
        lines.unionByName(sorted_by(site_groups(own).join(ids, "name"), "group", "group_code", "group_code"))
        .unionByName(sorted_by(here.join(known, "site_id"), "municipality", "code", "name"))
        .unionByName(sorted_by(touched.join(known, "site_id"), "area", "code", "name"))
    )
    order = Window.partitionBy("site_id", "kind").orderBy("at")
    return rows.select("site_id", "kind", F.row_number().over(order).alias("place"), "value")


def with_attributes(master: DataFrame, children: DataFrame) -> DataFrame:
    """The master with lines, groups, municipality and area_municipalities, all joined at once.

    A site's lists are as long as its lines and the municipalities around it.
    """

    def listed(kind: str) -> Column:
        own = F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "value")))
        return F.transform(F.array_sort(own), lambda e: e["value"])

    lists = children.groupBy("site_id").agg(
        listed("line").alias("lines"),
        listed("group").alias("groups"),
        F.max(F.when((F.col("kind") == "municipality") & (F.col("place") == 1), F.col("value"))).alias("municipality"),
        listed("area").alias("area_municipalities"),
    )
    none = F.array().cast("array<string>")
    lists_of = ("lines", "groups", "area_municipalities")
    joined = master.join(lists, "site_id", "left")
    return joined.withColumns({c: F.coalesce(c, none) for c in lists_of})


def unresolved(names: DataFrame, own: DataFrame, english: DataFrame) -> DataFrame:
    """(name, problem): no rail station of the operator, or no English name."""
    no_station = names.join(
        own.select(F.col("station").alias("name")), "name", "left_anti"
    ).select("name", F.lit("no station").alias("problem"))
    no_english = names.join(
        english.select(F.col("station").alias("name")), "name", "left_anti"
    ).select("name", F.lit("no english name").alias("problem"))
    return no_station.unionByName(no_english)


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    """(value, n) of values that occur more than once."""
    return (
        rows.groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
