"""Checks of geometry, radius counts, completeness, scoring and exploring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.functions import display, geo
from placegauge.functions.rounding import round_half_even
from placegauge.operators import areas, coverage, explore, publish, radius
from placegauge.operators import scoring as sc
from placegauge.plans import testbed as tb
from placegauge.plans.checks.base import (
    CTES,
    Tables,
    check,
    hashed_lat,
    hashed_lng,
    sql_lat,
    sql_lng,
    sql_project,
    sql_round,
)
from placegauge.session import cut

select = CTES.select


@check(
    "haversine_distance",
    f"""SELECT l_orderkey, l_linenumber, {sql_round('''2 * 6371008.8::DOUBLE * asin(sqrt(
      pow(sin((p2 - p1) / 2), 2) + cos(p1) * cos(p2) * pow(sin(radians(b2 - b1) / 2), 2)))''', 1)}
      AS metres
    FROM (SELECT *, radians({sql_lat('l_suppkey')}) AS p1, {sql_lng('l_suppkey')} AS b1,
      radians({sql_lat(f'l_partkey + {tb.PART_SHIFT}')}) AS p2,
      {sql_lng(f'l_partkey + {tb.PART_SHIFT}')} AS b2 FROM lineitem)""",
)
def haversine_distance(t: Tables) -> DataFrame:
    s, p = F.col("l_suppkey"), F.col("l_partkey") + tb.PART_SHIFT
    placed = t("lineitem").select(
        "l_orderkey", "l_linenumber", hashed_lat(s).alias("a1"), hashed_lng(s).alias("b1"),
        hashed_lat(p).alias("a2"), hashed_lng(p).alias("b2"),
    )
    metres = geo.haversine_m(*[F.col(c) for c in ("a1", "b1", "a2", "b2")])
    return placed.withColumn("m", metres).select(
        "l_orderkey", "l_linenumber", round_half_even(F.col("m"), 1).alias("metres")
    )


@check(
    "plane_projection",
    f"""SELECT o_orderkey, {sql_round('x', 3)} AS x, {sql_round('y', 3)} AS y FROM (
    {sql_project(f"(SELECT o_orderkey, {sql_lat('o_orderkey')} AS lat, {sql_lng('o_orderkey')} AS lng FROM orders)",
                 'lat', 'lng', 'x', 'y')})""",
)
def plane_projection(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    placed = t("orders").select("o_orderkey", hashed_lat(k).alias("lat"), hashed_lng(k).alias("lng"))
    return geo.project(placed, "lat", "lng", "x", "y").select(
        "o_orderkey", *[round_half_even(F.col(c), 3).alias(c) for c in ("x", "y")]
    )


@check("disc_points", select("SELECT * FROM disc_point", "disc_point"))
def disc_points(t: Tables) -> DataFrame:
    return areas.disc_points(tb.sites(t), tb.RADIUS_M)


@check(
    "radius_pairs",
    select("SELECT site_id, feature, facility_id, distance_m FROM pair", "pair"),
)
def radius_pairs(t: Tables) -> DataFrame:
    pairs = radius.nearest_first(tb.pairs(t, runs=True))
    return pairs.select("site_id", "feature", "facility_id", "distance_m")


CTES.add("order_xy", sql_project("order_spot", "lat", "lng", "fx", "fy"), ("order_spot",))


@check(
    "radius_counts",
    select(
        """SELECT s.site_id, d.feature, count(o.fx) AS n
        FROM site_xy s CROSS JOIN (SELECT * FROM feature_dim WHERE feature <> 'stationUsage') d
        LEFT JOIN order_xy o ON o.feature = d.feature
          AND sqrt((sx-fx)*(sx-fx) + (sy-fy)*(sy-fy)) <= 500
        GROUP BY ALL""",
        "site_xy", "order_xy", "feature_dim",
    ),
)
def radius_counts(t: Tables) -> DataFrame:
    return radius.radius_counts(
        tb.sites(t), tb.order_spots(t), float(fv.DEFAULT_RADIUS_M), tb.PLACE_FEATURES
    )


@check("site_areas", select("SELECT * FROM site_area", "site_area"))
def site_areas(t: Tables) -> DataFrame:
    return tb.site_areas(t)


CTES.add(
    "area_answer",
    """SELECT DISTINCT lat, lng, CASE WHEN (lat * 1000000)::BIGINT % 7 = 0 THEN ''
      WHEN lng < 139.7 THEN '14' || lpad(((lng * 1000)::BIGINT % 900)::VARCHAR, 3, '0')
      ELSE '1310' || (1 + (lat * 100)::BIGINT % 9) END AS code FROM disc_point""",
    ("disc_point",),
)


@check(
    "areas_by_lookup",
    select(
        f"""SELECT DISTINCT site_id, code, CASE code {' '.join(
            f"WHEN '{c}' THEN '{n}'" for c, n in fv.MUNICIPALITIES.items() if c < '13110')}
          ELSE '(都外 ' || code || ')' END AS name
        FROM disc_point JOIN area_answer USING (lat, lng) WHERE code <> ''""",
        "disc_point", "area_answer",
    ),
)
def areas_by_lookup(t: Tables) -> DataFrame:
    points = cut(areas.disc_points(tb.sites(t), tb.RADIUS_M))

    def digits(c, scale):
        return F.rint(F.col(c) * scale).cast("long")

    code = (
        F.when(digits("lat", 1000000) % 7 == 0, F.lit(""))
        .when(
            F.col("lng") < 139.7,
            F.concat(F.lit("14"), F.lpad((digits("lng", 1000) % 900).cast("string"), 3, "0")),
        )
        .otherwise(F.concat(F.lit("1310"), (digits("lat", 100) % 9 + 1).cast("string")))
    )
    answers = points.select("lat", "lng", code.alias("code")).distinct()
    return areas.areas_by_lookup(points, answers)


@check(
    "ring_areas",
    f"""WITH v AS (
        SELECT s_suppkey // 100 AS b, s_suppkey % 100 AS i, 139.6::DOUBLE + (s_suppkey % 100) * 0.0025::DOUBLE AS x,
          {sql_lat('s_suppkey')} AS y FROM supplier
        UNION ALL SELECT DISTINCT s_suppkey // 100, 1000 + c.i, c.x, 35.5::DOUBLE FROM supplier,
          (VALUES (0, 139.85::DOUBLE), (1, 139.6::DOUBLE)) c(i, x)),
      e AS (SELECT b, x AS ax, y AS ay,
          coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS "by"
        FROM v WINDOW w AS (PARTITION BY b ORDER BY i)),
      p AS (SELECT c_custkey AS k, {sql_lat('c_custkey')} AS lat, {sql_lng('c_custkey')} AS lng FROM customer)
    SELECT 'c' || k AS site_id, lpad(b::VARCHAR, 5, '0') AS code FROM p, e
    WHERE (ay > lat) <> ("by" > lat) AND lng < (bx - ax) * ((lat - ay) / ("by" - ay)) + ax
    GROUP BY k, b HAVING count(*) % 2 = 1""",
)
def ring_areas(t: Tables) -> DataFrame:
    """Every customer's place in rings of a hundred suppliers each, jagged in the north."""
    k = F.col("s_suppkey")
    corner = F.struct((k % 100).alias("i"), (F.lit(139.6) + (k % 100) * F.lit(0.0025)).alias("lng"), hashed_lat(k).alias("lat"))
    blocks = t("supplier").groupBy(F.floor(k / 100).alias("b")).agg(F.array_sort(F.collect_list(corner)).alias("north"))
    north = F.transform("north", lambda c: F.struct(c["lng"].alias("lng"), c["lat"].alias("lat")))
    south = F.array(*[F.struct(F.lit(x).alias("lng"), F.lit(35.5).alias("lat")) for x in (139.85, 139.6)])
    ring = F.concat(north, south, F.slice(north, 1, 1))
    code = F.lpad(F.col("b").cast("string"), 5, "0")
    c = F.col("c_custkey")
    points = t("customer").select(
        F.concat(F.lit("c"), c.cast("string")).alias("site_id"), F.lit(0).alias("pos"),
        hashed_lat(c).alias("lat"), hashed_lng(c).alias("lng"),
    )
    shapes = blocks.select(code.alias("code"), code.alias("name"), ring.alias("ring"))
    return areas.areas_by_polygons(points, shapes).select("site_id", "code")


@check("municipality_coverage", select("SELECT * FROM coverage", "coverage"))
def municipality_coverage(t: Tables) -> DataFrame:
    return coverage.municipality_coverage(tb.report(t), fv.UNLOCATED_TOLERANCE)


@check("area_coverage", select("SELECT * FROM area_cover", "area_cover"))
def area_coverage(t: Tables) -> DataFrame:
    return tb.covered_areas(t)


@check("site_aggregates", select("SELECT * FROM place_aggregate", "place_aggregate"))
def site_aggregates(t: Tables) -> DataFrame:
    return tb.place_aggregates(t)


CTES.add(
    "evidence",
    """SELECT site_id, feature, dataset_id FROM pair UNION
    SELECT a.site_id, r.feature, r.dataset_id FROM site_area a JOIN report r
      ON r.organization = a.name WHERE r.status IN ('ok', 'degraded')""",
    ("pair", "site_area", "report"),
)


def evidence(t: Tables) -> DataFrame:
    near = tb.pairs(t, ["feature", "dataset_id"])
    return cut(coverage.evidence_datasets(near, tb.site_areas(t), tb.report(t)))


@check("evidence_datasets", select("SELECT * FROM evidence", "evidence"))
def evidence_datasets(t: Tables) -> DataFrame:
    return evidence(t)


@check(
    "municipality_scope",
    select("SELECT name FROM site_area UNION SELECT '東京都建設局'", "site_area"),
)
def municipality_scope(t: Tables) -> DataFrame:
    return areas.scope_of(tb.site_areas(t), ["東京都建設局"])


@check("raw_matrix", select("SELECT site_id, feature, raw FROM matrix", "matrix"))
def raw_matrix(t: Tables) -> DataFrame:
    return publish.raw_matrix(tb.sites(t), tb.aggregates(t))


@check(
    "raw_matrix_with_base",
    select(
        """SELECT s.site_id, d.feature, CASE WHEN d.feature IN ('culture', 'park', 'library')
          THEN (s.pos % 40)::DOUBLE ELSE m.raw END AS raw
        FROM site s CROSS JOIN feature_dim d
        JOIN matrix m ON m.site_id = s.site_id AND m.feature = d.feature""",
        "site", "feature_dim", "matrix",
    ),
)
def raw_matrix_with_base(t: Tables) -> DataFrame:
    """Three features have no aggregate and take the base values."""
    known = tb.aggregates(t).where(F.col("feature").isin("tourism", "publicFacility", "stationUsage"))
    base = tb.sites(t).select(
        "site_id",
        F.explode(F.array(*[F.lit(f) for f in fv.FEATURES])).alias("feature"),
        (F.col("pos") % 40).alias("raw"),
    )
    return publish.raw_matrix(tb.sites(t), known, base)


@check(
    "feature_sources",
    select(
        """SELECT feature, feature IN (SELECT feature FROM place_aggregate) AS real
        FROM feature_dim""",
        "feature_dim", "place_aggregate",
    ),
)
def feature_sources(t: Tables) -> DataFrame:
    return publish.feature_sources(tb.place_aggregates(t))


@check(
    "percentile_ranks",
    select("SELECT site_id, feature, raw, percentile, low FROM ranked", "ranked"),
)
def percentile_ranks(t: Tables) -> DataFrame:
    return tb.ranked(t)


@check(
    "order_percentiles",
    f"""SELECT site_id, feature, raw, percentile, {sql_round('100 - percentile', 1)} AS low FROM (
      SELECT o_orderkey AS site_id, o_orderpriority AS feature, raw, CASE WHEN n = 1 THEN 50 ELSE
        {sql_round('(rk - 1 + (eq - 1) / 2.0::DOUBLE) / (n - 1)::DOUBLE * 100', 1)} END AS percentile
      FROM (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY raw) AS rk,
        count(*) OVER (PARTITION BY o_orderpriority, raw) AS eq,
        count(*) OVER (PARTITION BY o_orderpriority) AS n
        FROM (SELECT *, floor(o_totalprice / 100) AS raw FROM orders)))""",
)
def order_percentiles(t: Tables) -> DataFrame:
    """The same ranking over every order: many rows, many ties."""
    matrix = t("orders").select(
        F.col("o_orderkey").alias("site_id"),
        F.col("o_orderpriority").alias("feature"),
        F.floor(F.col("o_totalprice") / 100).cast("double").alias("raw"),
    )
    return sc.percentiles(matrix, min_values=1)


@check("site_scores", select("SELECT site_id, score, coverage FROM score", "score"))
def site_scores(t: Tables) -> DataFrame:
    return sc.scores(tb.lows(t)).select("site_id", "score", "coverage")


@check(
    "score_ranks",
    select("SELECT site_id, score, rank, of FROM score_table", "score_table"),
)
def score_ranks(t: Tables) -> DataFrame:
    return sc.ranks(sc.scores(tb.lows(t))).select("site_id", "score", "rank", "of")


@check(
    "rank_ranges",
    select(
        """SELECT site_id, min(rank) AS rank_min, max(rank) AS rank_max
        FROM score LEFT JOIN variant_rank USING (site_id) GROUP BY site_id""",
        "score", "variant_rank",
    ),
)
def rank_ranges(t: Tables) -> DataFrame:
    return sc.rank_ranges(tb.lows(t))


@check("score_table", select("SELECT * FROM score_table", "score_table"))
def score_table(t: Tables) -> DataFrame:
    return sc.score_table(tb.lows(t))


CTES.add(
    "effective",
    f"""SELECT m.site_id, m.feature, {sql_round(
        'CASE WHEN m.low IS NOT NULL THEN m.weight / s.covered END', 4)} AS effective_weight
    FROM ranked m JOIN score s USING (site_id)""",
    ("ranked", "score"),
)


@check("effective_weights", select("SELECT * FROM effective", "effective"))
def effective_weights(t: Tables) -> DataFrame:
    return sc.effective_weights(tb.lows(t))


_covered = " + ".join(
    f"(CASE WHEN l{i} IS NULL THEN 0 ELSE {w}::DOUBLE END)"
    for i, w in enumerate(fv.WEIGHTS.values())
)


@check(
    "feature_breakdown",
    select(
        f"""SELECT r.site_id, r.feature, raw, percentile, low, weight,
          CASE WHEN low IS NOT NULL THEN weight / c END AS effective_weight,
          CASE WHEN low IS NOT NULL THEN weight * low / c END AS contribution,
          raw IS NULL AS missing
        FROM ranked r JOIN (SELECT site_id, 0::DOUBLE + {_covered} AS c FROM lows) USING (site_id)""",
        "ranked", "lows",
    ),
)
def feature_breakdown(t: Tables) -> DataFrame:
    return sc.feature_breakdown(tb.ranked(t))


@check(
    "dominant_feature",
    select(
        """SELECT site_id, (SELECT feature FROM ranked r WHERE r.site_id = s.site_id
          AND percentile IS NOT NULL ORDER BY percentile DESC, fpos LIMIT 1) AS dominant
        FROM site s""",
        "site", "ranked",
    ),
)
def dominant_feature(t: Tables) -> DataFrame:
    return sc.dominant_feature(tb.ranked(t))


@check(
    "missing_reasons",
    select(
        """SELECT r.site_id, r.feature, a.name AS municipality, a.coverage,
          r.raw IS NOT NULL AS not_comparable
        FROM ranked r LEFT JOIN area_cover a ON a.site_id = r.site_id AND a.feature = r.feature
          AND a.coverage <> 'covered' WHERE r.percentile IS NULL""",
        "ranked", "area_cover",
    ),
)
def missing_reasons(t: Tables) -> DataFrame:
    return explore.missing_reasons(tb.ranked(t), tb.covered_areas(t))


@check(
    "top_sites",
    select(
        """SELECT site_id, score FROM published WHERE score IS NOT NULL
        ORDER BY score DESC, pos LIMIT 10""",
        "published",
    ),
)
def top_sites(t: Tables) -> DataFrame:
    return explore.top_sites(tb.published(t), 10).select("site_id", "score")


@check(
    "site_search",
    """SELECT 'site-' || s_suppkey AS site_id FROM supplier WHERE s_name LIKE '%stop 1%'
      OR (s_suppkey % 5 <> 0 AND 'stop ' || s_suppkey LIKE '%stop 1%')
      OR 'site-' || s_suppkey LIKE '%stop 1%'""",
)
def site_search(t: Tables) -> DataFrame:
    return explore.search(tb.sites(t), "  Stop 1").select("site_id")


@check(
    "sorted_sites",
    select("SELECT site_id, score FROM published", "published"),
)
def sorted_sites(t: Tables) -> DataFrame:
    return explore.sort_sites(tb.published(t), "score", True).select("site_id", "score")


@check(
    "sorted_names",
    "SELECT 'site-' || s_suppkey AS site_id FROM supplier",
)
def sorted_names(t: Tables) -> DataFrame:
    return explore.sort_sites(tb.sites(t), "name", False).select("site_id")


@check(
    "display_texts",
    select(
        """SELECT site_id, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 67 THEN 'large'
          WHEN score >= 34 THEN 'medium' ELSE 'small' END AS band,
          CASE WHEN score IS NULL THEN '?' WHEN score >= 67 THEN 'L'
          WHEN score >= 34 THEN 'M' ELSE 'S' END AS label,
          coalesce(printf('%.1f', score), '—') AS score_text,
          coalesce(format('{:,d}', u.count), '欠損') AS usage_text,
          'No. ' || CASE WHEN pos + 1 < 1000 THEN lpad((pos + 1)::VARCHAR, 3, '0')
            ELSE (pos + 1)::VARCHAR END AS observation,
          of || ' 駅中 ' || rank || ' 位' AS rank_text,
          CASE WHEN rank_min = rank_max THEN rank_min || ' 位'
            ELSE rank_min || '〜' || rank_max || ' 位' END AS range_text
        FROM published JOIN usage u USING (site_id)""",
        "published", "usage",
    ),
)
def display_texts(t: Tables) -> DataFrame:
    from placegauge.operators.usage import daily_usage

    used = daily_usage(tb.sites(t), tb.yearbook(t)).select("site_id", F.col("count").alias("used"))
    rows = tb.published(t).join(used, "site_id").join(
        explore.observation_numbers(tb.sites(t)), "site_id"
    )
    band = display.score_band(F.col("score"))
    return rows.select(
        "site_id",
        band.alias("band"),
        display.band_label(
            band, {"large": "L", "medium": "M", "small": "S", "unknown": "?"}
        ).alias("label"),
        display.score_text(F.col("score")).alias("score_text"),
        display.raw_text(F.col("used")).alias("usage_text"),
        display.observation_text(F.col("observation")).alias("observation"),
        display.rank_text(F.col("of"), F.col("rank")).alias("rank_text"),
        display.range_text(F.col("rank_min"), F.col("rank_max")).alias("range_text"),
    )


@check(
    "headline_counts",
    select(
        """SELECT (SELECT count(*) FROM published) AS sites,
          (SELECT count(score) FROM published) AS scored,
          (SELECT count(DISTINCT dataset_id) FROM evidence) AS sources""",
        "published", "evidence",
    ),
)
def headline_counts(t: Tables) -> DataFrame:
    sources = evidence(t).select(F.col("dataset_id").alias("source_id"))
    return explore.headline_counts(tb.published(t), sources)
