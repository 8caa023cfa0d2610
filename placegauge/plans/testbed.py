"""The given tables read as places: what stands for a site, a facility, a dataset, a package.

Coordinates and texts are derived from the keys by integer arithmetic, in Spark and in SQL alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.operators import areas, coverage, publish, radius, usage
from placegauge.operators import scoring as sc
from placegauge.plans.checks.base import (
    CTES,
    Tables,
    hashed_lat,
    hashed_lng,
    pick,
    sql_geodesic,
    sql_lat,
    sql_lng,
    sql_pick,
    sql_project,
    sql_round,
    sql_sum,
)
from placegauge.session import cut

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PLACE_FEATURES = list(fv.FEATURES[:5])
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
RADIUS_M = 1000.0
CUSTOMER_SHIFT = 500_003
ORDER_SHIFT = 900_001
PART_SHIFT = 300_007
UNLOCATED_BELOW = -700


def feature_of(column: Column, values: list[str]) -> Column:
    names = F.create_map(*[F.lit(v) for pair in zip(values, PLACE_FEATURES) for v in pair])
    return F.element_at(names, column)


def sql_feature(column: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN '{v}' THEN '{f}'" for v, f in zip(values, PLACE_FEATURES))
    return f"(CASE {column} {cases} END)"


# --- sites, facilities, reports ----------------------------------------------------------------

def sites(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t("supplier").select(
        F.concat(F.lit("site-"), k.cast("string")).alias("site_id"),
        F.col("s_name").alias("name"),
        F.when(k % 5 != 0, F.concat(F.lit("Stop "), k.cast("string"))).alias("name_en"),
        k.alias("pos"),
        hashed_lat(k).alias("lat"),
        hashed_lng(k).alias("lng"),
    )


CTES.add(
    "site",
    f"""SELECT 'site-' || s_suppkey AS site_id, s_name AS name,
    CASE WHEN s_suppkey % 5 <> 0 THEN 'Stop ' || s_suppkey END AS name_en, s_suppkey AS pos,
    {sql_lat('s_suppkey')} AS lat, {sql_lng('s_suppkey')} AS lng FROM supplier""",
)


def facilities(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    there = F.col("c_acctbal") >= UNLOCATED_BELOW
    feature = feature_of(F.col("c_mktsegment"), SEGMENTS)
    dataset = F.concat_ws("-", F.lit("ds"), F.col("c_nationkey").cast("string"), feature)
    return t("customer").select(
        F.concat_ws(":", dataset, k.cast("string")).alias("facility_id"),
        feature.alias("feature"),
        dataset.alias("dataset_id"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("organization"),
        F.concat_ws(" ", "c_mktsegment", (k % 50).cast("string")).alias("name"),
        F.when(there, hashed_lat(k + CUSTOMER_SHIFT)).alias("lat"),
        F.when(there, hashed_lng(k + CUSTOMER_SHIFT)).alias("lng"),
        F.when(there, pick(["source", "geocode"], k % 2)).alias("coord_source"),
        F.when(there & (k % 2 == 1), pick(["exact", "partial"], (k % 4 - 1) / 2)).alias(
            "precision"
        ),
        F.when(~there, pick([fv.NO_ADDRESS, fv.NOT_FOUND, fv.OUTSIDE_REGION], k % 3)).alias(
            "unlocated_reason"
        ),
    )


CTES.add(
    "facility",
    f"""SELECT 'ds-' || c_nationkey || '-' || feature || ':' || c_custkey AS facility_id, feature,
    'ds-' || c_nationkey || '-' || feature AS dataset_id, 'NATION_' || c_nationkey AS organization,
    c_mktsegment || ' ' || (c_custkey % 50) AS name, c_custkey AS k,
    CASE WHEN there THEN {sql_lat(f'c_custkey + {CUSTOMER_SHIFT}')} END AS lat,
    CASE WHEN there THEN {sql_lng(f'c_custkey + {CUSTOMER_SHIFT}')} END AS lng,
    CASE WHEN there THEN {sql_pick(['source', 'geocode'], 'c_custkey % 2')} END AS coord_source,
    CASE WHEN there AND c_custkey % 2 = 1
      THEN CASE c_custkey % 4 WHEN 1 THEN 'exact' ELSE 'partial' END END AS "precision",
    CASE WHEN NOT there THEN
      {sql_pick([fv.NO_ADDRESS, fv.NOT_FOUND, fv.OUTSIDE_REGION], 'c_custkey % 3')} END
      AS unlocated_reason
    FROM (SELECT *, c_acctbal >= {UNLOCATED_BELOW} AS there,
      {sql_feature('c_mktsegment', SEGMENTS)} AS feature FROM customer)""",
)


def order_spots(t: Tables) -> DataFrame:
    """Orders as many small facilities; several share a spot."""
    k = F.col("o_orderkey") % 7919 + ORDER_SHIFT
    return t("orders").select(
        feature_of(F.col("o_orderpriority"), PRIORITIES).alias("feature"),
        hashed_lat(k).alias("lat"),
        hashed_lng(k).alias("lng"),
    )


CTES.add(
    "order_spot",
    f"""SELECT {sql_feature('o_orderpriority', PRIORITIES)} AS feature,
    {sql_lat(f'o_orderkey % 7919 + {ORDER_SHIFT}')} AS lat,
    {sql_lng(f'o_orderkey % 7919 + {ORDER_SHIFT}')} AS lng FROM orders""",
)


def report(t: Tables) -> DataFrame:
    """Ingest report of the customer datasets."""
    return (
        facilities(t)
        .groupBy("feature", "dataset_id", "organization")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("coord_source").isNull()).alias("unlocated"),
        )
        .withColumn(
            "status",
            F.when(F.col("dataset_id").endswith("4-library"), F.lit("failed"))
            .when(F.col("unlocated") * 4 > F.col("rows"), F.lit("degraded"))
            .otherwise(F.lit("ok")),
        )
    )


CTES.add(
    "report",
    """SELECT *, CASE WHEN dataset_id LIKE '%4-library' THEN 'failed'
      WHEN unlocated * 4 > rows THEN 'degraded' ELSE 'ok' END AS status
    FROM (SELECT feature, dataset_id, organization, count(*) AS rows,
      count(*) FILTER (coord_source IS NULL) AS unlocated FROM facility GROUP BY ALL)""",
    ("facility",),
)

# --- areas -------------------------------------------------------------------------------------

def area_polygons(t: Tables) -> DataFrame:
    """25 rectangles, one per nation, that tile the region."""
    k = F.col("n_nationkey")
    south = F.lit(35.58) + F.floor(k / 5) * F.lit(0.05)
    west = F.lit(139.58) + (k % 5) * F.lit(0.06)
    north = F.lit(35.58) + (F.floor(k / 5) + 1) * F.lit(0.05)
    east = F.lit(139.58) + (k % 5 + 1) * F.lit(0.06)

    def corner(lng: Column, lat: Column) -> Column:
        return F.struct(lng.alias("lng"), lat.alias("lat"))

    return t("nation").select(
        F.lpad(k.cast("string"), 5, "0").alias("code"),
        F.col("n_name").alias("name"),
        F.array(
            corner(west, south), corner(east, south), corner(east, north), corner(west, north),
            corner(west, south),
        ).alias("ring"),
    )


CTES.add(
    "disc_offset",
    " UNION ALL ".join(
        ["SELECT 0 AS pos, 0::DOUBLE AS az, 0::DOUBLE AS d",
         f"SELECT 1 + i, 360::DOUBLE * i / 8, {RADIUS_M / 2}::DOUBLE FROM range(8) t(i)",
         f"SELECT 9 + i, 360::DOUBLE * i / 16, {RADIUS_M}::DOUBLE FROM range(16) t(i)"]
    ),
)
CTES.add("disc_ring", "SELECT site_id, lat, lng, o.* FROM site, disc_offset o", ("site", "disc_offset"))
CTES.add("disc_moved", sql_geodesic("disc_ring"), ("disc_ring",))
CTES.add(
    "disc_point",
    f"""SELECT site_id, pos, {sql_round('CASE WHEN d = 0 THEN lat ELSE lat2 END', 6)} AS lat,
    {sql_round('CASE WHEN d = 0 THEN lng ELSE lng2 END', 6)} AS lng FROM disc_moved""",
    ("disc_moved",),
)
CTES.add(
    "site_area",
    """SELECT DISTINCT p.site_id, lpad(n.n_nationkey::VARCHAR, 5, '0') AS code, n.n_name AS name
    FROM disc_point p JOIN nation n
      ON p.lat >= 35.58::DOUBLE + (n.n_nationkey // 5) * 0.05::DOUBLE
     AND p.lat < 35.58::DOUBLE + (n.n_nationkey // 5 + 1) * 0.05::DOUBLE
     AND p.lng >= 139.58::DOUBLE + (n.n_nationkey % 5) * 0.06::DOUBLE
     AND p.lng < 139.58::DOUBLE + (n.n_nationkey % 5 + 1) * 0.06::DOUBLE""",
    ("disc_point",),
)


def site_areas(t: Tables) -> DataFrame:
    points = cut(areas.disc_points(sites(t), RADIUS_M))
    return cut(areas.areas_by_polygons(points, area_polygons(t)))


# --- radius, coverage, aggregates ----------------------------------------------------------------

CTES.add("site_xy", sql_project("site", "lat", "lng", "sx", "sy"), ("site",))
CTES.add(
    "facility_xy",
    sql_project("(SELECT * FROM facility WHERE lat IS NOT NULL)", "lat", "lng", "fx", "fy"),
    ("facility",),
)
CTES.add(
    "pair",
    f"""SELECT s.site_id, f.feature, f.facility_id, f.dataset_id, f.coord_source,
    {sql_round('sqrt((sx-fx)*(sx-fx) + (sy-fy)*(sy-fy))', 1)} AS distance_m
    FROM site_xy s, facility_xy f
    WHERE sqrt((sx-fx)*(sx-fx) + (sy-fy)*(sy-fy)) <= {RADIUS_M}""",
    ("site_xy", "facility_xy"),
)
CTES.add(
    "feature_dim",
    " UNION ALL ".join(
        f"SELECT {i} AS fpos, '{f}' AS feature, {w}::DOUBLE AS weight"
        for i, (f, w) in enumerate(fv.WEIGHTS.items())
    ),
)
CTES.add(
    "near_count",
    """SELECT s.site_id, d.feature, count(p.facility_id) AS n
    FROM site s CROSS JOIN (SELECT * FROM feature_dim WHERE feature <> 'stationUsage') d
    LEFT JOIN pair p ON p.site_id = s.site_id AND p.feature = d.feature GROUP BY ALL""",
    ("site", "feature_dim", "pair"),
)
CTES.add(
    "coverage",
    f"""SELECT feature, organization, CASE WHEN NOT bool_or(status = 'degraded')
      AND (sum(unlocated) = 0 OR sum(unlocated) / sum(rows)::DOUBLE <= {fv.UNLOCATED_TOLERANCE})
      THEN 'covered' ELSE 'partial' END AS coverage, sum(rows)::BIGINT AS rows,
      sum(unlocated)::BIGINT AS unlocated
    FROM report WHERE status IN ('ok', 'degraded') GROUP BY ALL""",
    ("report",),
)
CTES.add(
    "area_cover",
    """SELECT a.site_id, d.feature, a.code, a.name, coalesce(c.coverage, 'uncovered') AS coverage,
      coalesce(c.unlocated, 0)::BIGINT AS unlocated
    FROM site_area a CROSS JOIN (SELECT * FROM feature_dim WHERE feature <> 'stationUsage') d
    LEFT JOIN coverage c ON c.organization = a.name AND c.feature = d.feature""",
    ("site_area", "feature_dim", "coverage"),
)
CTES.add(
    "place_aggregate",
    """SELECT n.site_id, n.feature, CASE WHEN done THEN 'complete' ELSE 'incomplete' END AS status,
      CASE WHEN done THEN n END AS count, n AS lower_bound
    FROM (SELECT n.*, coalesce((SELECT bool_and(coverage = 'covered') FROM area_cover a
      WHERE a.site_id = n.site_id AND a.feature = n.feature), false) AS done FROM near_count n) n""",
    ("near_count", "area_cover"),
)


def pairs(t: Tables, groups: list[str] | None = None, runs: bool = False) -> DataFrame:
    return radius.radius_pairs(sites(t), facilities(t), RADIUS_M, groups=groups, runs=runs)


def covered_areas(t: Tables) -> DataFrame:
    covered = coverage.municipality_coverage(report(t), fv.UNLOCATED_TOLERANCE)
    return coverage.area_coverage(site_areas(t), covered, PLACE_FEATURES)


def place_aggregates(t: Tables) -> DataFrame:
    counts = radius.radius_counts(sites(t), facilities(t), RADIUS_M, PLACE_FEATURES)
    return coverage.site_aggregates(counts, covered_areas(t))


# --- ridership -----------------------------------------------------------------------------------

def yearbook(t: Tables, table: Column | None = None) -> DataFrame:
    """Line items as yearbook rows: one table per return flag, April to March years."""
    ship = F.col("l_shipdate")
    k = F.col("l_suppkey")
    return t("lineitem").select(
        (F.col("l_returnflag") if table is None else table).alias("table_name"),
        F.col("l_orderkey").alias("row_no"),
        (F.year(ship) - F.when(F.month(ship) < 4, 1).otherwise(0)).alias("fiscal_year"),
        F.concat(F.lit("Supplier#"), F.lpad(k.cast("string"), 9, "0")).alias("station"),
        F.when(F.col("l_quantity") > 10, F.concat_ws(" ", F.lit("Stop"), k.cast("string"),
                                                     "l_linenumber")).alias("station_en"),
        F.when(F.col("l_linestatus") == "F", F.lit(fv.DEFAULT_OPERATOR))
        .otherwise(F.lit("東京地下鉄")).alias("operator"),
        F.col("l_linestatus").alias("line"),
        F.when(F.col("l_quantity") > 2, F.col("l_quantity").cast("long")).alias("thousands"),
    )


CTES.add(
    "yearbook",
    f"""SELECT l_returnflag AS table_name, l_orderkey AS row_no, l_linenumber,
      year(l_shipdate) - CASE WHEN month(l_shipdate) < 4 THEN 1 ELSE 0 END AS fiscal_year,
      'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') AS station,
      CASE WHEN l_quantity > 10 THEN 'Stop ' || l_suppkey || ' ' || l_linenumber END AS station_en,
      CASE l_linestatus WHEN 'F' THEN '{fv.DEFAULT_OPERATOR}' ELSE '東京地下鉄' END AS operator,
      l_linestatus AS line, CASE WHEN l_quantity > 2 THEN l_quantity::BIGINT END AS thousands
    FROM lineitem""",
)
CTES.add(
    "usage",
    """SELECT s.site_id, CASE WHEN a.annual IS NULL THEN 'incomplete' ELSE 'complete' END AS status,
      round_even(a.annual * 1000.0::DOUBLE / a.days, 0)::BIGINT AS count,
      coalesce(round_even(a.annual * 1000.0::DOUBLE / a.days, 0)::BIGINT, 0) AS lower_bound,
      a.fiscal_year
    FROM site s LEFT JOIN (SELECT station, sum(thousands)::DOUBLE AS annual, fiscal_year,
        date_diff('day', make_date(fiscal_year, 4, 1), make_date(fiscal_year + 1, 4, 1))::DOUBLE
          AS days
      FROM yearbook WHERE thousands IS NOT NULL
        AND fiscal_year = (SELECT max(fiscal_year) FROM yearbook)
      GROUP BY station, fiscal_year) a ON a.station = s.name""",
    ("site", "yearbook"),
)


def aggregates(t: Tables) -> DataFrame:
    """All six features."""
    used = usage.daily_usage(sites(t), yearbook(t)).select(
        "site_id", F.lit("stationUsage").alias("feature"), "status", "count", "lower_bound"
    )
    return place_aggregates(t).unionByName(used)


CTES.add(
    "aggregate_all",
    """SELECT * FROM place_aggregate UNION ALL
    SELECT site_id, 'stationUsage', status, count, lower_bound FROM usage""",
    ("place_aggregate", "usage"),
)

# --- scoring -------------------------------------------------------------------------------------

CTES.add(
    "matrix",
    """SELECT s.site_id, d.feature, d.fpos, d.weight, a.count::DOUBLE AS raw
    FROM site s CROSS JOIN feature_dim d
    LEFT JOIN aggregate_all a ON a.site_id = s.site_id AND a.feature = d.feature""",
    ("site", "feature_dim", "aggregate_all"),
)
CTES.add(
    "ranked",
    f"""SELECT *, {sql_round('100 - percentile', 1)} AS low FROM (
      SELECT site_id, feature, fpos, weight, raw, CASE WHEN raw IS NULL OR n < 3 THEN NULL
        WHEN n = 1 THEN 50 ELSE
        {sql_round('(rk - 1 + (eq - 1) / 2.0::DOUBLE) / (n - 1)::DOUBLE * 100', 1)} END
        AS percentile
      FROM (SELECT *, rank() OVER (PARTITION BY feature, raw IS NULL ORDER BY raw) AS rk,
        count(*) OVER (PARTITION BY feature, raw) AS eq,
        count(raw) OVER (PARTITION BY feature) AS n FROM matrix))""",
    ("matrix",),
)
_FEATURES = list(fv.WEIGHTS)
CTES.add(
    "lows",
    "SELECT site_id, "
    + ", ".join(f"max(low) FILTER (feature = '{f}') AS l{i}" for i, f in enumerate(_FEATURES))
    + " FROM ranked GROUP BY site_id",
    ("ranked",),
)
CTES.add(
    "variant",
    " UNION ALL ".join(
        f"SELECT {v} AS variant, "
        + ", ".join(f"{w!r}::DOUBLE AS w{i}" for i, w in enumerate(ws.values()))
        for v, ws in enumerate(sc.weight_variants())
    ),
)
_available = [f"(CASE WHEN l{i} IS NULL THEN 0 ELSE w{i} END)" for i in range(6)]
_points = [f"coalesce(l{i} * w{i}, 0)" for i in range(6)]
CTES.add(
    "variant_score",
    f"""SELECT site_id, variant, covered, coverage, l0, l1, l2, l3, l4, l5,
      CASE WHEN coverage >= {fv.MIN_COVERAGE} THEN {sql_round('points / covered', 1)} END AS score
    FROM (SELECT *, {sql_round('covered / total', 3)} AS coverage FROM (
      SELECT *, {sql_sum(_available)} AS covered, {sql_sum([f'w{i}' for i in range(6)])} AS total,
        {sql_sum(_points)} AS points FROM lows CROSS JOIN variant))""",
    ("lows", "variant"),
)
CTES.add(
    "score",
    "SELECT * FROM variant_score WHERE variant = 0",
    ("variant_score",),
)
CTES.add(
    "variant_rank",
    """SELECT site_id, variant, rank() OVER (PARTITION BY variant ORDER BY score DESC) AS rank,
    count(*) OVER (PARTITION BY variant) AS n FROM variant_score WHERE score IS NOT NULL""",
    ("variant_score",),
)
CTES.add(
    "score_table",
    """SELECT s.site_id, s.score, s.coverage, b.rank, b.n AS of,
      CASE WHEN b.rank IS NOT NULL THEN r.lo END AS rank_min,
      CASE WHEN b.rank IS NOT NULL THEN r.hi END AS rank_max
    FROM score s LEFT JOIN (SELECT * FROM variant_rank WHERE variant = 0) b USING (site_id)
    LEFT JOIN (SELECT site_id, min(rank) AS lo, max(rank) AS hi FROM variant_rank GROUP BY 1) r
      USING (site_id)""",
    ("score", "variant_rank"),
)


def ranked(t: Tables) -> DataFrame:
    return sc.percentiles(cut(publish.raw_matrix(sites(t), aggregates(t))))


def lows(t: Tables) -> DataFrame:
    return cut(sc.lows_by_site(ranked(t)))


def published(t: Tables) -> DataFrame:
    """Score table with the site columns the explore queries need."""
    return sites(t).join(sc.score_table(lows(t)), "site_id")


CTES.add("published", "SELECT * FROM site JOIN score_table USING (site_id)", ("site", "score_table"))
