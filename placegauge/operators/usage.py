"""Daily ridership of sites from yearbook tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.functions.rounding import round_half_even
from placegauge.functions.text import era_year, fiscal_days, number_text
from placegauge.operators.skew import split_join


def yearbook_packages(packages: DataFrame) -> DataFrame:
    """Transport yearbooks of the statistics office with their era year."""
    title = F.coalesce("title", F.lit(""))
    return packages.where(
        (F.col("organization") == fv.YEARBOOK_ORG) & F.contains(title, F.lit(fv.YEARBOOK_WORD))
    ).withColumn("year", era_year(title)).where("year IS NOT NULL")


def latest_package(candidates: DataFrame) -> DataFrame:
    """The package of the highest (year, modified); of equals the first in ``pos``."""
    row = F.struct(*candidates.columns)
    best = F.max_by(row, F.struct("year", "modified", -F.col("pos")))
    return candidates.agg(best.alias("best")).where("best IS NOT NULL").select("best.*")


def station_tables(resources: DataFrame) -> DataFrame:
    """CSV resources whose name marks a table per station."""
    marked = F.lit(False)
    for marker in fv.TABLE_MARKERS:
        marked = marked | F.contains(F.coalesce("name", F.lit("")), F.lit(marker))
    return resources.where(marked & (F.upper(F.coalesce("format", F.lit(""))) == "CSV"))


def table_columns(datasets: DataFrame) -> DataFrame:
    """The role columns of each yearbook table: first field that fits."""

    def first(condition) -> Column:
        return F.get(F.filter("fields", condition), 0)

    return datasets.select(
        "dataset_id",
        first(lambda f: F.contains(f, F.lit("Fiscal year"))).alias("year_field"),
        first(lambda f: f == "駅").alias("station_field"),
        first(lambda f: f == "Station").alias("english_field"),
        first(lambda f: F.startswith(f, F.lit("乗車人員")) & F.contains(f, F.lit("総数"))).alias(
            "boarding_field"
        ),
        first(lambda f: f == "系統").alias("line_field"),
        first(lambda f: f == "会社名").alias("company_field"),
    )


def table_problems(datasets: DataFrame) -> DataFrame:
    """(rule, key): yearbook tables without a column that every table must have.

    Their rows would be missing from sums that call themselves complete.
    """
    needed = {"year_field": "no year", "station_field": "no station", "boarding_field": "no passengers"}
    absent = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(r)) for c, r in needed.items()]))
    return table_columns(datasets).select(F.explode(absent).alias("rule"), F.col("dataset_id").alias("key"))


def yearbook_rows(records: DataFrame, datasets: DataFrame) -> DataFrame:
    """Typed rows of station tables: every row with a year, value null where it is no number.

    ``datasets`` may have a ``pos``, the place at which the yearbook lists a table; rows carry it as
    ``table_pos``.  Tables without a needed column have no rows; ``table_states`` names them.
    """
    columns = table_columns(datasets).where(
        "year_field IS NOT NULL AND station_field IS NOT NULL AND boarding_field IS NOT NULL"
    )
    pos = F.col("pos") if "pos" in datasets.columns else F.lit(None)
    places = datasets.select("dataset_id", pos.cast("bigint").alias("table_pos"))
    columns = columns.join(places, "dataset_id")
    joined = split_join(records, columns, ["dataset_id"], F.col("row_no"))
    value = {
        name: F.nullif(F.element_at("rec", F.col(f"{name}_field")), F.lit(""))
        for name in ("year", "station", "english", "boarding", "line", "company")
    }
    return joined.select(
        F.col("dataset_id").alias("table_name"),
        "table_pos",
        "row_no",
        F.when(value["year"].rlike("^[0-9]+$"), value["year"].try_cast("int")).alias("fiscal_year"),
        value["station"].alias("station"),
        value["english"].alias("station_en"),
        F.coalesce(value["company"], F.lit(fv.DEFAULT_OPERATOR)).alias("operator"),
        F.coalesce(value["line"], F.lit("")).alias("line"),
        number_text(value["boarding"]).alias("thousands"),
    ).where("fiscal_year IS NOT NULL")


def latest_rows(rows: DataFrame) -> DataFrame:
    """Rows of the overall latest fiscal year.

    A table that ends earlier has no row of that year, so this is also "tables that are up to
    date".  Years are taken before unreadable values are dropped.
    """
    latest = rows.agg(F.max("fiscal_year").alias("fiscal_year"))
    return rows.join(F.broadcast(latest), "fiscal_year").where(  # one row
        "station IS NOT NULL AND thousands IS NOT NULL"
    )


def daily_usage(sites: DataFrame, rows: DataFrame) -> DataFrame:
    """(site_id, status, count, lower_bound, fiscal_year) for every site.

    All operators and lines at a station name are summed; a site without rows is incomplete.
    """
    sums = latest_rows(rows).groupBy("station").agg(
        F.sum("thousands").alias("annual"), F.max("fiscal_year").alias("fiscal_year")
    )
    per_day = (
        F.col("annual").cast("double") * 1000 / fiscal_days(F.col("fiscal_year")).cast("double")
    )
    joined = sites.select("site_id", F.col("name").alias("station")).join(sums, "station", "left")
    count = round_half_even(per_day).cast("long")
    found = F.col("annual").isNotNull()
    return joined.select(
        "site_id",
        F.when(found, F.lit("complete")).otherwise(F.lit("incomplete")).alias("status"),
        count.alias("count"),
        F.coalesce(count, F.lit(0)).alias("lower_bound"),
        "fiscal_year",
    )


def usage_lines(sites: DataFrame, rows: DataFrame) -> DataFrame:
    """(site_id, operator, line, thousands): what a site's usage consists of."""
    lines = latest_rows(rows).select("station", "row_no", "operator", "line", "thousands")
    named = sites.select("site_id", F.col("name").alias("station"))
    joined = split_join(lines, named, ["station"], F.col("row_no"))
    return joined.select("site_id", "operator", "line", "thousands")


def table_states(datasets: DataFrame, rows: DataFrame) -> DataFrame:
    """(table_name, state, latest): ``read``, ``unreadable`` (a column is missing) or ``no year``."""
    bad = table_problems(datasets).select(F.col("key").alias("table_name")).distinct()
    latest = rows.groupBy("table_name").agg(F.max("fiscal_year").alias("latest"))
    named = datasets.select(F.col("dataset_id").alias("table_name")).distinct()
    state = (
        F.when(F.col("bad"), F.lit("unreadable")).when(F.col("latest").isNull(), F.lit("no year")).otherwise(F.lit("read"))
    )
    joined = named.join(bad.withColumn("bad", F.lit(True)), "table_name", "left").join(latest, "table_name", "left")
    return joined.select("table_name", state.alias("state"), "latest")


def table_members(rows: DataFrame) -> DataFrame:
    """(station, table_name): which tables list a station, in any year and with any value."""
    return rows.where("station IS NOT NULL").select("station", "table_name").distinct()


def usage_lineage(expected: DataFrame, states: DataFrame) -> DataFrame:
    """(station, n_expected, n_read, missing): tables that a station's sum needs and what became of them.

    ``expected``: (station, table_name), as ``table_members`` of this or an earlier edition gives it.
    """
    joined = split_join(
        expected.select("station", "table_name").distinct(), states.select("table_name", "state"),
        ["table_name"], F.col("station"), "left",
    )
    read = F.coalesce(F.col("state") == "read", F.lit(False))
    return joined.groupBy("station").agg(
        F.count(F.lit(1)).alias("n_expected"),
        F.count(F.when(read, 1)).alias("n_read"),
        # A yearbook's tables, of which a station is in a few.
        F.array_sort(F.collect_set(F.when(~read, F.col("table_name")))).alias("missing"),
    )


def checked_usage(sites: DataFrame, rows: DataFrame, expected: DataFrame, states: DataFrame) -> DataFrame:
    """``daily_usage`` with its lineage: complete only if every table that lists the station was read.

    Of an incomplete site the sum of the tables that were read is the lower bound.  An unread table
    that is expected of no station may list any, so with one every site is incomplete.
    """
    unread = states.where("state <> 'read'").join(expected, "table_name", "left_anti")
    stray = unread.agg((F.count(F.lit(1)) > 0).alias("stray"))
    lineage = usage_lineage(expected, states)
    named = sites.select("site_id", F.col("name").alias("station")).join(lineage, "station", "left")
    joined = daily_usage(sites, rows).join(named, "site_id").crossJoin(F.broadcast(stray))  # one row
    whole = (F.coalesce("n_expected", F.lit(0)) == F.coalesce("n_read", F.lit(0))) & ~F.col("stray")
    complete = whole & (F.col("status") == "complete")
    none = F.array().cast("array<string>")
    return joined.select(
        "site_id",
        F.when(complete, F.lit("complete")).otherwise(F.lit("incomplete")).alias("status"),
        F.when(complete, F.col("count")).alias("count"),
        "lower_bound",
        "fiscal_year",
        F.coalesce("n_expected", F.lit(0)).alias("n_expected"),
        F.coalesce("n_read", F.lit(0)).alias("n_read"),
        F.coalesce("missing", none).alias("missing"),
    )


def english_names(rows: DataFrame, table_order: str | None = None) -> DataFrame:
    """(station, station_en): first spelling of the default operator's tables.

    Tables come in the order in which the yearbook lists them, where rows know it, else by name.
    """
    order = [F.col(table_order or "table_name"), F.col("row_no")]
    if table_order is None and "table_pos" in rows.columns:
        order = [F.coalesce("table_pos", F.lit(2**62)), *order]
    named = latest_rows_per_table(rows).where(
        F.col("station_en").isNotNull() & (F.col("operator") == fv.DEFAULT_OPERATOR)
    )
    return named.groupBy("station").agg(F.min_by("station_en", F.struct(*order)).alias("station_en"))


def latest_rows_per_table(rows: DataFrame) -> DataFrame:
    """Rows of each table's own latest fiscal year."""
    latest = rows.groupBy("table_name").agg(F.max("fiscal_year").alias("fiscal_year"))
    return split_join(rows, latest, ["table_name", "fiscal_year"], F.col("row_no")).where(
        "station IS NOT NULL AND thousands IS NOT NULL"
    )


def yearbook_listing(tables: DataFrame) -> DataFrame:
    """(package, place, id, name, url): the tables of every package as it lists them, from 1."""
    order = Window.partitionBy("package").orderBy("pos", "id")
    return tables.select("package", F.row_number().over(order).alias("place"), "id", "name", "url")


def yearbook_entries(packages: DataFrame, tables: DataFrame) -> DataFrame:
    """Manifest entries of yearbooks, with their first table; those without tables have none.

    ``tables``: package, pos, id, name, url.  ``yearbook_listing`` has all tables, a row each.
    """
    place = F.struct("pos", "id")
    first = tables.groupBy("package").agg(
        F.min_by("url", place).alias("resource_url"),
        F.min_by("id", place).alias("resource_id"),
        F.count(F.lit(1)).alias("n_tables"),
    )
    accepted = F.lit("accepted")
    joined = packages.join(first.withColumnRenamed("package", "name"), "name", "left")
    return joined.select(
        F.lit("stationUsage").alias("feature"),
        F.col("name").alias("dataset_id"),
        F.col("title").alias("name"),
        "organization",
        "source_url",
        "resource_url",
        "resource_id",
        F.lit("csv").alias("format"),
        accepted.alias("status"),
        accepted.alias("auto_status"),
        F.lit(1.0).alias("confidence"),
        F.lit(fv.YEARBOOK_REASON).alias("reason"),
        F.col("license_id").alias("license"),
        F.col("metadata_modified").alias("last_modified"),
        F.coalesce("n_tables", F.lit(0)).alias("n_tables"),
    )


def yearbook_entry(package: DataFrame, tables: DataFrame) -> DataFrame:
    """The entry of the chosen yearbook, its reason naming its tables among those of all packages."""
    own = tables.join(package.select(F.col("name").alias("package")), "package", "left_semi")
    # As long as the reason that is published.
    names = own.groupBy(F.col("package").alias("dataset_id")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "name"))).alias("t")
    )
    text = F.array_join(F.transform("t", lambda x: x["name"]), fv.YEARBOOK_NAME_SEPARATOR)
    entries = yearbook_entries(package, own).join(names, "dataset_id", "left")
    return entries.withColumn("reason", F.concat("reason", F.coalesce(text, F.lit("")))).select(
        "feature", "dataset_id", "name", "organization", "source_url", "resource_url", "resource_id", "format",
        "status", "auto_status", "confidence", "reason", "license", "last_modified",
    )
