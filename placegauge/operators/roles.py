"""Which column of a dataset is the name, the latitude, …, and how well is it filled?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.functions.rounding import round_half_even
from placegauge.functions.text import header_key, strip
from placegauge.operators.skew import split_join


def _candidates(roles: dict[str, tuple[str, ...]]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(role).alias("role"), F.lit(i).alias("cand_pos"), F.lit(c).alias("cand"))
            for role, names in roles.items()
            for i, c in enumerate(names)
        ]
    )


def column_roles(datasets: DataFrame, roles=fv.ROLE_CANDIDATES) -> DataFrame:
    """(dataset_id, role, field): best field per role.

    An exact header beats one that starts with a candidate, which beats one that ends with
    ``_candidate``; then earlier candidates win, then earlier columns.  Of headers that normalise
    alike the first place and the last spelling count.

    ``datasets``: dataset_id, fields array<string>.
    """
    headers = (
        datasets.select("dataset_id", F.posexplode("fields").alias("field_pos", "field"))
        .withColumn("header", header_key(F.col("field")))
        .groupBy("dataset_id", "header")
        .agg(F.min("field_pos").alias("field_pos"), F.max_by("field", "field_pos").alias("field"))
    )
    names = {role: tuple(n.strip().lower() for n in values) for role, values in roles.items()}
    tried = headers.withColumn("c", F.explode(_candidates(names))).select(
        "dataset_id", "field", "field_pos", "header", "c.role", "c.cand_pos", "c.cand"
    )
    matched = tried.withColumn(
        "pass",
        F.when(F.col("header") == F.col("cand"), 1)
        .when(F.startswith("header", "cand"), 2)
        .when(F.endswith(F.col("header"), F.concat(F.lit("_"), F.col("cand"))), 3),
    ).where("pass IS NOT NULL")
    return matched.groupBy("dataset_id", "role").agg(
        F.min_by("field", F.struct("pass", "cand_pos", "field_pos")).alias("field")
    )


def category_columns(datasets: DataFrame, candidates=None) -> DataFrame:
    """(dataset_id, fields) with all columns that look like a category, in column order."""
    names = [c.lower() for c in candidates or fv.ROLE_CANDIDATES["category"]]

    def looks_like(field: Column) -> Column:
        key = header_key(field)
        wanted = F.lit(False)
        for name in names:
            wanted = wanted | F.startswith(key, F.lit(name)) | F.endswith(key, F.lit("_" + name))
        return wanted

    return datasets.select("dataset_id", F.filter("fields", looks_like).alias("fields"))


def role_table(datasets: DataFrame) -> DataFrame:
    """One row per dataset: <role>_field columns (null when not found) and category_fields."""
    roles = [r for r in fv.ROLE_CANDIDATES if r != "category"]
    wide = (
        column_roles(datasets, {r: fv.ROLE_CANDIDATES[r] for r in roles})
        .groupBy("dataset_id")
        .agg(*[F.max(F.when(F.col("role") == r, F.col("field"))).alias(f"{r}_field") for r in roles])
    )
    categories = category_columns(datasets).withColumnRenamed("fields", "category_fields")
    return categories.join(wide, "dataset_id", "left")


def number(text: Column) -> Column:
    """Double of a text, null when it is none."""
    return strip(text).try_cast("double")


def valid_coordinates(lat: Column, lng: Column) -> Column:
    inside = lat.between(*fv.LAT_RANGE) & lng.between(*fv.LNG_RANGE)
    return F.coalesce(inside, F.lit(False))


def fill_rates(
    records: DataFrame,
    roles: DataFrame,
    datasets: DataFrame,
    hot_rows: int | None = None,
    head_rows: int | None = None,
) -> DataFrame:
    """(dataset_id, sample_size, total, coord_fill, address_fill) over all rows of each.

    ``head_rows`` asks for the first rows alone; their numbers come from the scan, so that is a
    plain filter inside one grouping.  A rate is null when its column is missing and 0.0 when there are no rows.
    """
    cell = {r: F.element_at("rec", F.col(f"{r}_field")) for r in ("lat", "lng", "address")}
    head = F.lit(True) if head_rows is None else F.col("row_no") <= head_rows
    has_coords = valid_coordinates(number(cell["lat"]), number(cell["lng"]))
    has_address = F.coalesce(strip(cell["address"]) != "", F.lit(False))
    counted = (
        split_join(records, roles, ["dataset_id"], F.col("row_no"), "inner", hot_rows)
        .groupBy("dataset_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(head).alias("sample_size"),
            F.count_if(head & has_coords).alias("located"),
            F.count_if(head & has_address).alias("addressed"),
        )
    )
    size = F.coalesce("sample_size", F.lit(0))

    def rate(part: str) -> Column:
        return F.coalesce(round_half_even(F.try_divide(part, "sample_size"), 3), F.lit(0.0))

    return (
        datasets.select("dataset_id")
        .join(roles, "dataset_id", "left")
        .join(counted, "dataset_id", "left")
        .select(
            "dataset_id",
            size.alias("sample_size"),
            F.coalesce("total", F.lit(0)).alias("total"),
            F.when(
                F.col("lat_field").isNotNull() & F.col("lng_field").isNotNull(), rate("located")
            ).alias("coord_fill"),
            F.when(F.col("address_field").isNotNull(), rate("addressed")).alias("address_fill"),
        )
    )


def public_fields(datasets: DataFrame) -> DataFrame:
    """Without the store's own columns, whose names start with an underscore."""
    kept = F.filter("fields", lambda f: ~F.startswith(f, F.lit("_")))
    return datasets.withColumn("fields", kept)
