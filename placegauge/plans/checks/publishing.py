"""Checks of ridership, the site master, the published tables and their gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.functions import text as tx
from placegauge.operators import contract, explore, publish, quality, usage
from placegauge.operators import sites as st
from placegauge.plans import testbed as tb
from placegauge.plans.checks import catalog as cc
from placegauge.plans.checks import places
from placegauge.plans.checks.base import (
    CTES,
    Tables,
    check,
    hashed_lat,
    hashed_lng,
    pick,
    sql_lat,
    sql_lng,
    sql_pick,
    sql_round,
)
from placegauge.session import cut

select = CTES.select

# --- ridership -----------------------------------------------------------------------------------


@check("daily_usage", select("SELECT * FROM usage", "usage"))
def daily_usage(t: Tables) -> DataFrame:
    return usage.daily_usage(tb.sites(t), tb.yearbook(t))


@check(
    "usage_lines",
    select(
        """SELECT s.site_id, y.operator, y.line, y.thousands FROM site s
        JOIN yearbook y ON y.station = s.name WHERE y.thousands IS NOT NULL
          AND y.fiscal_year = (SELECT max(fiscal_year) FROM yearbook)""",
        "site", "yearbook",
    ),
)
def usage_lines(t: Tables) -> DataFrame:
    return usage.usage_lines(tb.sites(t), tb.yearbook(t))


@check(
    "english_names",
    f"""WITH latest AS (SELECT *, rank() OVER (PARTITION BY table_name ORDER BY fiscal_year DESC) AS r
      FROM (SELECT o_orderpriority AS table_name, o_orderkey AS row_no, year(o_orderdate) AS
        fiscal_year, 'S' || (o_custkey % 300) AS station, CASE WHEN o_orderkey % 3 <> 0 THEN
        'Name ' || o_orderkey END AS station_en, CASE WHEN o_orderstatus <> 'P'
        THEN '{fv.DEFAULT_OPERATOR}' ELSE '東京地下鉄' END AS operator FROM orders))
    SELECT station, arg_min(station_en, (table_name, row_no)) AS station_en FROM latest
    WHERE r = 1 AND station_en IS NOT NULL AND operator = '{fv.DEFAULT_OPERATOR}' GROUP BY 1""",
)
def english_names(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t("orders").select(
        F.col("o_orderpriority").alias("table_name"),
        k.alias("row_no"),
        F.year("o_orderdate").alias("fiscal_year"),
        F.concat(F.lit("S"), (F.col("o_custkey") % 300).cast("string")).alias("station"),
        F.when(k % 3 != 0, F.concat(F.lit("Name "), k.cast("string"))).alias("station_en"),
        F.when(F.col("o_orderstatus") != "P", F.lit(fv.DEFAULT_OPERATOR))
        .otherwise(F.lit("東京地下鉄")).alias("operator"),
        F.lit(1).alias("thousands"),
    )
    return usage.english_names(rows)


@check(
    "yearbook_problems",
    """SELECT rule, 'part-' || p_partkey AS key FROM (
      SELECT p_partkey, unnest([CASE WHEN p_size % 5 = 0 THEN 'no year' END,
        CASE WHEN p_partkey % 7 = 0 THEN 'no station' END,
        CASE WHEN p_partkey % 11 = 0 THEN 'no passengers' END]) AS rule FROM part)
    WHERE rule IS NOT NULL""",
)
def yearbook_problems(t: Tables) -> DataFrame:
    """Parts as tables, some without a column that sums need."""
    k = F.col("p_partkey")
    fields = F.array(
        F.when(F.col("p_size") % 5 == 0, F.lit("Year")).otherwise(F.lit("年度 Fiscal year")),
        F.when(k % 7 == 0, F.lit("駅名")).otherwise(F.lit("駅")),
        F.when(k % 11 == 0, F.lit("乗車人員 定期")).otherwise(F.lit("乗車人員 総数")),
    )
    return usage.table_problems(
        t("part").select(F.concat(F.lit("part-"), k.cast("string")).alias("dataset_id"), fields.alias("fields"))
    )


ERAS = ["令和", "平成", "昭和"]


def yearbook_listing(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    number = F.when(k % 7 == 0, F.lit("元")).otherwise((k % 30 + 1).cast("string"))
    return t("orders").select(
        k.alias("pos"),
        F.concat(F.lit("東京都統計年鑑　"), pick(ERAS, k % 3), number, F.lit("年　4　"),
                 pick(["運輸・観光", "人口"], k % 2)).alias("title"),
        pick(["東京都総務局", "東京都"], k / 2 % 2).alias("organization"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("modified"),
    )


CTES.add(
    "yearbook_package",
    f"""SELECT * FROM (SELECT o_orderkey AS pos, strftime(o_orderdate, '%Y-%m-%d') AS modified,
      CASE o_orderkey % 3 WHEN 0 THEN 2018 WHEN 1 THEN 1988 END
        + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE o_orderkey % 30 + 1 END AS year
      FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey // 2) % 2 = 0) WHERE year IS NOT NULL""",
)


@check("yearbook_years", select("SELECT pos, year FROM yearbook_package", "yearbook_package"))
def yearbook_years(t: Tables) -> DataFrame:
    return usage.yearbook_packages(yearbook_listing(t)).select("pos", "year")


@check(
    "latest_yearbook",
    select(
        """SELECT pos, year, modified FROM yearbook_package
        ORDER BY year DESC, modified DESC, pos LIMIT 1""",
        "yearbook_package",
    ),
)
def latest_yearbook(t: Tables) -> DataFrame:
    found = usage.latest_package(usage.yearbook_packages(yearbook_listing(t)))
    return found.select("pos", "year", "modified")


@check(
    "fiscal_days",
    """SELECT o_orderkey, date_diff('day', make_date(year(o_orderdate), 4, 1),
      make_date(year(o_orderdate) + 1, 4, 1)) AS days, CASE WHEN o_orderkey % 10 = 0 THEN NULL
      ELSE floor(o_totalprice)::BIGINT END AS value FROM orders""",
)
def fiscal_days(t: Tables) -> DataFrame:
    """Days of a fiscal year, and amounts read back from text with commas."""
    amount = F.format_number(F.floor("o_totalprice"), 0)
    text = F.when(F.col("o_orderkey") % 10 == 0, F.lit("-")).otherwise(amount)
    return t("orders").select(
        "o_orderkey",
        tx.fiscal_days(F.year("o_orderdate")).alias("days"),
        tx.number_text(text).alias("value"),
    )


# --- site master ---------------------------------------------------------------------------------

OPERATORS = ["東日本旅客鉄道", "東京地下鉄", "ゆりかもめ", "京王電鉄"]
LINES = ["山手線", "2号線日比谷線", "12号線大江戸線", "京浜東北線", "1線"]
SHORT = [fv.OPERATOR_SHORT.get(o, o) for o in OPERATORS]
SHORT_LINES = ["山手線", "日比谷線", "大江戸線", "京浜東北線", "1線"]


def rail(t: Tables) -> DataFrame:
    """Orders as rail stations with one to three vertices; two stations share a group."""
    k, s = F.col("o_orderkey"), F.col("o_custkey") % 250

    def vertex(i):
        return F.array(hashed_lng(k + i * 1000), hashed_lat(k + i * 1000))

    return t("orders").select(
        k.alias("pos"),
        F.concat(F.lit("S"), s.cast("string")).alias("station"),
        pick(OPERATORS, k % 4).alias("operator"),
        pick(LINES, k / 4 % 5).alias("line"),
        F.concat(F.lit("g"), F.floor(s / 2).cast("string")).alias("group_code"),
        F.transform(F.sequence(F.lit(0), k % 3), vertex).alias("vertices"),
    )


CTES.add(
    "rail",
    f"""SELECT o_orderkey AS pos, 'S' || (o_custkey % 250) AS station, o_orderkey % 4 = 0 AS own,
      {sql_pick(SHORT, 'o_orderkey % 4')} || {sql_pick(SHORT_LINES, 'o_orderkey // 4 % 5')} AS label,
      (o_custkey % 250) // 2 AS grp,
      list_avg([{sql_lat('o_orderkey + i * 1000')} for i in range(o_orderkey % 3 + 1)]) AS lat,
      list_avg([{sql_lng('o_orderkey + i * 1000')} for i in range(o_orderkey % 3 + 1)]) AS lng
    FROM orders""",
)
CTES.add("place_name", "SELECT s_suppkey * 3 AS k, 'S' || (s_suppkey * 3) AS name FROM supplier")


def place_names(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") * 3
    return t("supplier").select(k.alias("pos"), F.concat(F.lit("S"), k.cast("string")).alias("name"))


def spellings(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t("part").where(k % 9 != 0).select(
        F.concat(F.lit("S"), k.cast("string")).alias("station"),
        F.concat(F.lit(" Sta. Name-"), k.cast("string"), F.lit("! ")).alias("station_en"),
    )


@check(
    "site_master",
    select(
        f"""SELECT n.k AS pos, 'sta-name-' || n.k AS site_id, n.name, ' Sta. Name-' || n.k || '! '
          AS name_en, {sql_round('avg(r.lat)', 6)} AS lat, {sql_round('avg(r.lng)', 6)} AS lng
        FROM place_name n JOIN rail r ON r.station = n.name AND r.own
        WHERE n.k % 9 <> 0 AND n.k IN (SELECT p_partkey FROM part) GROUP BY n.k, n.name""",
        "place_name", "rail",
    ),
)
def site_master(t: Tables) -> DataFrame:
    return st.site_master(place_names(t), rail(t), OPERATORS[0], spellings(t))


@check(
    "site_lines",
    select(
        """SELECT n.name, r.label, min(r.pos) AS first_pos FROM place_name n
        JOIN (SELECT DISTINCT station, grp FROM rail WHERE own) o ON o.station = n.name
        JOIN rail r USING (grp) GROUP BY ALL""",
        "place_name", "rail",
    ),
)
def site_lines(t: Tables) -> DataFrame:
    return st.site_lines(st.own_stations(place_names(t), rail(t), OPERATORS[0]), rail(t))


@check(
    "site_attributes",
    select(
        """SELECT n.k AS pos, lines, grps AS "groups",
          CASE WHEN n.k % 4 = 0 THEN 'M' || n.k % 5 END AS municipality,
          'M' || n.k % 5 || '|M9' AS area_municipalities
        FROM place_name n
        JOIN (SELECT name, string_agg(label, '|' ORDER BY first_pos) AS lines FROM (
          SELECT n.name, r.label, min(r.pos) AS first_pos FROM place_name n
          JOIN (SELECT DISTINCT station, grp FROM rail WHERE own) o ON o.station = n.name
          JOIN rail r USING (grp) GROUP BY ALL) GROUP BY name) l ON l.name = n.name
        JOIN (SELECT station, string_agg('g' || grp, '|' ORDER BY 'g' || grp) AS grps
          FROM (SELECT DISTINCT station, grp FROM rail WHERE own) GROUP BY station) g ON g.station = n.name
        WHERE n.k % 9 <> 0 AND n.k IN (SELECT p_partkey FROM part)""",
        "place_name", "rail",
    ),
)
def site_attributes(t: Tables) -> DataFrame:
    """The master with its lines, groups and municipalities in order."""
    names, tracks = place_names(t), rail(t)
    master = cut(st.site_master(names, tracks, OPERATORS[0], spellings(t)))
    own = st.own_stations(names, tracks, OPERATORS[0])
    code = F.concat(F.lit("M"), (F.col("pos") % 5).cast("string"))
    one = master.select("site_id", "pos", code.alias("code"), code.alias("name"))
    other = master.select("site_id", F.lit("M9").alias("code"), F.lit("M9").alias("name"))
    children = st.site_children(
        master, own, tracks, one.where("pos % 4 = 0").drop("pos"), other.unionByName(one.drop("pos"))
    )
    whole = st.with_attributes(master, children)
    return whole.select(
        "pos", "municipality",
        *[F.array_join(c, "|").alias(c) for c in ("lines", "groups", "area_municipalities")],
    )


@check(
    "unresolved_sites",
    select(
        """SELECT name, 'no station' AS problem FROM place_name
          WHERE name NOT IN (SELECT station FROM rail WHERE own) UNION ALL
        SELECT name, 'no english name' FROM place_name
          WHERE k % 9 = 0 OR k NOT IN (SELECT p_partkey FROM part)""",
        "place_name", "rail",
    ),
)
def unresolved_sites(t: Tables) -> DataFrame:
    own = st.own_stations(place_names(t), rail(t), OPERATORS[0])
    return st.unresolved(place_names(t), own, spellings(t))


@check(
    "duplicate_names",
    "SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_names(t: Tables) -> DataFrame:
    return st.duplicates(t("part"), "p_name")


# --- published tables ------------------------------------------------------------------------------


def document_report(t: Tables) -> DataFrame:
    k, n = F.col("doc_id"), F.col("n_chars")
    failed = k % 5 == 2
    return t("documents").where(k % 4 != 0).select(
        F.col("lang").alias("feature"),
        F.concat(F.lit("doc-"), k.cast("string")).alias("dataset_id"),
        pick(list(fv.INGEST_STATUSES), k % 5).alias("status"),
        F.when(~failed, n).alias("rows"),
        F.when(~failed, F.floor(n / 2)).alias("with_source"),
        F.when(~failed, F.floor(n / 4)).alias("geocoded"),
        F.when(~failed, k % 7).alias("unlocated"),
        F.when(~failed, k % 3).alias("excluded"),
        F.when(~failed, k % 2).alias("outside"),
        F.when(failed, F.lit("unsupported format: pdf")).alias("error"),
    )


def register(t: Tables) -> DataFrame:
    kept = cc.overridden(t).withColumn("license", F.lit("CC-BY-4.0"))
    return publish.register(kept, document_report(t))


@check(
    "provenance_register",
    select(
        """SELECT o.feature, o.dataset_id, o.name, o.organization, o.auto_status, o.note AS review_note,
          CASE WHEN k % 4 <> 0 THEN ['ok', 'degraded', 'failed', 'out-of-scope',
            'no-matching-rows'][1 + k % 5] END AS ingest_status,
          CASE WHEN k % 4 <> 0 THEN CASE WHEN k % 5 = 2 THEN 0 ELSE d.n_chars // 2 + d.n_chars // 4
            END END AS located,
          CASE WHEN k % 4 <> 0 AND k % 5 <> 2 THEN d.n_chars END AS "rows",
          CASE WHEN k % 4 <> 0 AND k % 5 = 2 THEN 'unsupported format: pdf' END AS error
        FROM overridden o JOIN documents d ON d.doc_id = o.k WHERE o.status = 'accepted'""",
        "overridden",
    ),
)
def provenance_register(t: Tables) -> DataFrame:
    return publish.register_order(register(t)).select(
        "feature", "dataset_id", "name", "organization", "auto_status", "review_note",
        F.col("ingest.status").alias("ingest_status"), "ingest.located", "ingest.rows",
        "ingest.error",
    )


@check(
    "register_stats",
    f"""SELECT feature, candidates, accepted, review, rejected, "order" FROM (
      SELECT {tb.sql_feature('o_orderpriority', tb.PRIORITIES)} AS feature, count(*) AS candidates,
        count(*) FILTER (o_orderstatus = 'F') AS accepted,
        count(*) FILTER (o_orderstatus = 'O') AS review,
        count(*) FILTER (o_orderstatus = 'P') AS rejected FROM orders GROUP BY 1)
      JOIN (SELECT unnest({[str(f) for f in fv.FEATURES]}) AS feature,
        unnest(range({len(fv.FEATURES)})) AS "order") USING (feature)""",
)
def register_stats(t: Tables) -> DataFrame:
    from placegauge.operators.manifest import status_counts

    states = F.create_map(F.lit("F"), F.lit("accepted"), F.lit("O"), F.lit("review"), F.lit("P"),
                          F.lit("rejected"))
    entries = t("orders").select(
        tb.feature_of(F.col("o_orderpriority"), tb.PRIORITIES).alias("feature"),
        F.element_at(states, F.col("o_orderstatus")).alias("status"),
    )
    return explore.register_stats(status_counts(entries))


def place_manifest(t: Tables) -> DataFrame:
    """Manifest entries of the place datasets; those of two nations are unknown."""
    keys = tb.facilities(t).select("feature", "dataset_id", "organization").distinct()
    known = keys.where(~F.col("organization").isin("NATION_3", "NATION_8"))
    return known.select(
        "feature", "dataset_id", "organization", F.lit("list").alias("name"),
        F.concat(F.lit("https://example.org/"), "dataset_id").alias("source_url"),
        F.lit("cc-by").alias("license"),
    )


CTES.add(
    "site_source",
    """SELECT e.site_id, e.feature, e.dataset_id AS source_id, r.organization || ' list' AS source_name,
      r.organization, 'https://example.org/' || e.dataset_id AS url, 'cc-by' AS license,
      'opendata' AS kind FROM evidence e JOIN report r USING (feature, dataset_id)
    WHERE r.organization NOT IN ('NATION_3', 'NATION_8')""",
    ("evidence", "report"),
)


def sources(t: Tables) -> DataFrame:
    return publish.site_sources(places.evidence(t), place_manifest(t))


@check("site_sources", select("SELECT * FROM site_source", "site_source"))
def site_sources(t: Tables) -> DataFrame:
    return sources(t)


@check(
    "base_sources",
    """SELECT id, kind, array_to_string(kept, ',') AS features FROM (
      SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'opendata' ELSE 'fixture' END AS kind,
        CASE WHEN p_partkey % 3 = 0 THEN wanted
          ELSE list_filter(wanted, lambda f: f NOT IN ('tourism', 'culture')) END AS kept
      FROM (SELECT p_partkey, (['tourism', 'culture', 'park'])[1:1 + p_partkey % 3] AS wanted FROM part))
    WHERE kind <> 'fixture' OR len(kept) > 0""",
)
def base_sources(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    features = F.array(*[F.lit(f) for f in ("tourism", "culture", "park")])
    base = t("part").select(
        k.alias("id"),
        F.when(k % 3 == 0, F.lit("opendata")).otherwise(F.lit("fixture")).alias("kind"),
        F.slice(features, F.lit(1), (k % 3 + 1).cast("int")).alias("features"),
    )
    real = t("customer").select(
        tb.feature_of(F.col("c_mktsegment"), tb.SEGMENTS[:2]).alias("feature")
    ).where("feature IS NOT NULL")
    trimmed = publish.trim_base_sources(base, real)
    return trimmed.select("id", "kind", F.array_join("features", ",").alias("features"))


# --- gates -----------------------------------------------------------------------------------------


@check(
    "site_violations",
    """WITH s AS (SELECT CASE WHEN s_suppkey % 20 = 0 THEN 'Site_' || s_suppkey
        ELSE 'site-' || (s_suppkey % 90) END AS id, s_suppkey AS k FROM supplier)
    SELECT 'id is not a slug' AS rule, id AS key FROM s WHERE k % 20 = 0 UNION ALL
    SELECT 'name missing', id FROM s WHERE k % 17 = 0 UNION ALL
    SELECT 'invalid coordinates', id FROM s WHERE k % 13 = 0 OR k % 31 = 0 UNION ALL
    SELECT 'duplicate site id', id FROM s GROUP BY id HAVING count(*) > 1""",
)
def site_violations(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    broken = t("supplier").select(
        F.when(k % 20 == 0, F.concat(F.lit("Site_"), k.cast("string")))
        .otherwise(F.concat(F.lit("site-"), (k % 90).cast("string"))).alias("site_id"),
        F.when(k % 17 != 0, F.col("s_name")).alias("name"),
        F.when(k % 13 == 0, F.lit(91.0)).otherwise(hashed_lat(k)).alias("lat"),
        F.when(k % 31 != 0, hashed_lng(k)).alias("lng"),
    )
    return quality.site_violations(broken)


@check(
    "score_violations",
    """WITH s AS (SELECT *, l_orderkey || '-' || l_linenumber AS id, l_quantity * 2.5 AS score,
        l_discount * 12 AS coverage, l_linenumber AS rank FROM lineitem)
    SELECT 'score out of range' AS rule, id AS key FROM s WHERE score > 100 UNION ALL
    SELECT 'coverage out of range', id FROM s WHERE coverage > 1 UNION ALL
    SELECT 'rank outside its range', id FROM s WHERE rank NOT BETWEEN 2 AND 6 UNION ALL
    SELECT 'percentile out of range', id || '/park' FROM s WHERE score > 100 UNION ALL
    SELECT 'missing value was ranked', id || '/park' FROM s WHERE l_tax = 0 UNION ALL
    SELECT 'negative raw value', id || '/park' FROM s WHERE l_tax = 0.01""",
)
def score_violations(t: Tables) -> DataFrame:
    made = t("lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), "l_linenumber").alias("site_id"),
        (F.col("l_quantity") * 2.5).alias("score"),
        (F.col("l_discount") * 12).alias("coverage"),
        F.col("l_linenumber").alias("rank"),
        F.lit(2).alias("rank_min"),
        F.lit(6).alias("rank_max"),
        F.lit("park").alias("feature"),
        F.when(F.col("l_tax") == 0.01, F.lit(-1.0)).when(F.col("l_tax") != 0, F.lit(1.0)).alias("raw"),
        (F.col("l_quantity") * 2.5).alias("percentile"),
        F.lit(None).cast("double").alias("low"),
    )
    return quality.score_violations(made, made)


@check(
    "published_violations",
    select(
        """SELECT 'scored without rank' AS rule, site_id AS key FROM score_table
        WHERE score IS NOT NULL AND rank IS NULL""",
        "score_table",
    ),
)
def published_violations(t: Tables) -> DataFrame:
    """The real score table passes its gate: no row."""
    from placegauge.operators import scoring as sc
    from placegauge.session import cut

    ranked = cut(tb.ranked(t))
    low = cut(sc.lows_by_site(ranked))
    table = cut(sc.score_table(low))
    return quality.score_violations(table, ranked).unionByName(
        quality.weight_violations(sc.effective_weights(low), table)
    )


@check(
    "aggregate_violations",
    """WITH a AS (SELECT o_orderkey || '/park' AS key, o_orderstatus AS s, o_orderkey % 10 AS n
      FROM orders)
    SELECT 'unknown status' AS rule, key FROM a WHERE s = 'P' UNION ALL
    SELECT 'incomplete with a count', key FROM a WHERE s <> 'F' AND n <> 3 UNION ALL
    SELECT 'complete without a count', key FROM a WHERE s = 'F' AND n = 3 UNION ALL
    SELECT 'count differs from what was found', key FROM a WHERE s = 'F' AND n = 7 UNION ALL
    SELECT 'negative lower bound', key FROM a WHERE n = 0""",
)
def aggregate_violations(t: Tables) -> DataFrame:
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 10
    states = F.create_map(F.lit("F"), F.lit("complete"), F.lit("O"), F.lit("incomplete"), F.lit("P"),
                          F.lit("partly"))
    made = t("orders").select(
        k.alias("site_id"),
        F.lit("park").alias("feature"),
        F.element_at(states, F.col("o_orderstatus")).alias("status"),
        F.when(n == 0, F.lit(-1)).when(n != 3, n).alias("count"),
        F.when(n == 0, F.lit(-1)).when(n == 7, n + 1).otherwise(n).alias("lower_bound"),
    )
    return quality.aggregate_violations(made)


@check(
    "source_violations",
    """SELECT 'no sources' AS rule, 'site-' || s_suppkey AS key FROM supplier
      WHERE s_suppkey NOT IN (SELECT ps FROM (SELECT p_partkey % 70 AS ps FROM part)) UNION ALL
    SELECT 'source without url', 'site-' || (p_partkey % 70) || '/' || p_partkey FROM part
      WHERE p_partkey % 5 = 0 AND p_partkey % 2 = 0""",
)
def source_violations(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    made = t("part").select(
        F.concat(F.lit("site-"), (k % 70).cast("string")).alias("site_id"),
        k.cast("string").alias("source_id"),
        pick(["opendata", "fixture"], k % 2).alias("kind"),
        F.when(k % 5 != 0, F.lit("https://example.org")).alias("url"),
    )
    return quality.source_violations(tb.sites(t), made)


@check(
    "unsourced_values",
    select(
        """SELECT 'value without source' AS rule, m.site_id || '/' || m.feature AS key FROM matrix m
        WHERE raw IS NOT NULL AND feature <> 'stationUsage' AND NOT EXISTS (SELECT 1 FROM site_source s
          WHERE s.site_id = m.site_id AND s.feature = m.feature)""",
        "matrix", "site_source",
    ),
)
def unsourced_values(t: Tables) -> DataFrame:
    return quality.unsourced_values(tb.ranked(t), sources(t), tb.PLACE_FEATURES)


@check(
    "register_violations",
    select(
        """SELECT 'source url is no url' AS rule, feature || '/' || dataset_id AS key FROM overridden
        WHERE status = 'accepted' AND k % 8 = 0""",
        "overridden",
    ),
)
def register_violations(t: Tables) -> DataFrame:
    bad = F.regexp_extract("dataset_id", "([0-9]+)$", 1).cast("long") % 8 == 0
    rows = register(t).withColumn(
        "source_url", F.when(bad, F.lit("ftp:/x")).otherwise(F.col("source_url"))
    )
    return quality.register_violations(rows)


@check(
    "evidence_violations",
    """SELECT 'negative distance' AS rule, l_suppkey || '/' || l_orderkey || '-' || l_linenumber AS key
      FROM lineitem WHERE l_tax < 0.02 UNION ALL
    SELECT 'unknown coordinate source', l_suppkey || '/' || l_orderkey || '-' || l_linenumber
      FROM lineitem WHERE l_returnflag = 'R'""",
)
def evidence_violations(t: Tables) -> DataFrame:
    kinds = F.create_map(F.lit("A"), F.lit("source"), F.lit("N"), F.lit("geocode"), F.lit("R"),
                         F.lit("guess"))
    made = t("lineitem").select(
        F.col("l_suppkey").alias("site_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), "l_linenumber").alias("facility_id"),
        (F.col("l_tax") - 0.02).alias("distance_m"),
        F.element_at(kinds, F.col("l_returnflag")).alias("coord_source"),
    )
    return quality.evidence_violations(made)


@check(
    "text_digests",
    """SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes, 'utf-8' AS encoding,
      make_timestamp(1700000000000000 + doc_id * 1000000) AS retrieved_at FROM documents""",
)
def text_digests(t: Tables) -> DataFrame:
    """The landing log's digest and length, on whole document texts."""
    from placegauge.sources.files import landing_log

    raw = t("documents").select(
        F.col("doc_id").alias("dataset_id"), F.lit("").alias("path"),
        F.octet_length("text").alias("bytes"),
        F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("retrieved_at"),
        F.col("text").cast("binary").alias("content"),
    )
    return landing_log(raw).select(
        F.col("dataset_id").alias("doc_id"), "sha256", "bytes", "encoding", "retrieved_at"
    )


@check(
    "site_documents",
    select(
        """SELECT s.site_id, max(r.raw) FILTER (r.feature = 'park') AS park,
          max(r.percentile) FILTER (r.feature = 'stationUsage') AS usage_percentile,
          max(r.low) FILTER (r.feature = 'tourism') AS tourism_low,
          max(e.effective_weight) FILTER (r.feature = 'library') AS library_weight,
          any_value(t.score) AS score, any_value(t.rank) AS rank, any_value(t.rank_max) AS worst
        FROM site s JOIN ranked r USING (site_id) JOIN score_table t USING (site_id)
        JOIN effective e ON e.site_id = s.site_id AND e.feature = r.feature GROUP BY s.site_id""",
        "site", "ranked", "score_table", "effective",
    ),
)
def site_documents(t: Tables) -> DataFrame:
    from placegauge.operators import scoring as sc
    from placegauge.session import cut

    ranked = cut(tb.ranked(t))
    low = cut(sc.lows_by_site(ranked))
    made = publish.site_documents(tb.sites(t), ranked, sc.score_table(low), sc.effective_weights(low))
    return made.select(
        "site_id", F.col("raw")["park"].alias("park"),
        F.col("normalized")["stationUsage"].alias("usage_percentile"),
        F.col("lows")["tourism"].alias("tourism_low"),
        F.col("weights")["library"].alias("library_weight"),
        "score", "ranking.rank", F.get("ranking.range", 1).alias("worst"),
    )


@check(
    "area_violations",
    """SELECT 'area without code or name' AS rule, s_suppkey || '/park/' || (s_suppkey % 7) AS key
      FROM supplier WHERE s_suppkey % 9 = 0 UNION ALL
    SELECT 'unknown coverage', s_suppkey || '/park/' || (s_suppkey % 7) FROM supplier
      WHERE s_suppkey % 4 = 3 UNION ALL
    SELECT 'negative unlocated', s_suppkey || '/park/' || (s_suppkey % 7) FROM supplier
      WHERE s_acctbal < 0""",
)
def area_violations(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    made = t("supplier").select(
        k.alias("site_id"), F.lit("park").alias("feature"), (k % 7).cast("string").alias("code"),
        F.when(k % 9 != 0, F.col("s_name")).alias("name"),
        pick(["covered", "partial", "uncovered", "maybe"], k % 4).alias("coverage"),
        F.floor("s_acctbal").alias("unlocated"),
    )
    return quality.area_violations(made)


@check(
    "yearbook_entry",
    select(
        f"""SELECT 'y-' || (pos % 50) AS dataset_id, '{fv.YEARBOOK_REASON}'
          || coalesce((SELECT string_agg(p_name || '駅別乗車人員', '・' ORDER BY p_partkey)
            FROM part WHERE p_partkey % 50 = pos % 50 AND p_size > 25), '') AS reason,
          (SELECT 'u' || min(p_partkey) FROM part WHERE p_partkey % 50 = pos % 50 AND p_size > 25)
            AS resource_url
        FROM (SELECT * FROM yearbook_package ORDER BY year DESC, modified DESC, pos LIMIT 1)""",
        "yearbook_package",
    ),
)
def yearbook_entry(t: Tables) -> DataFrame:
    """The chosen package among fifty, whose files are all parts."""
    found = usage.latest_package(usage.yearbook_packages(yearbook_listing(t)))
    package = found.select(
        F.concat(F.lit("y-"), (F.col("pos") % 50).cast("string")).alias("name"), "title", "organization",
        F.lit("https://example.org/y").alias("source_url"), F.lit("cc-by").alias("license_id"),
        F.col("modified").alias("metadata_modified"),
    )
    return usage.yearbook_entry(package, part_tables(t)).select("dataset_id", "reason", "resource_url")


def part_tables(t: Tables) -> DataFrame:
    """Every part as a file of one of fifty packages; some are station tables."""
    k = F.col("p_partkey")
    files = t("part").select(
        F.concat(F.lit("y-"), (k % 50).cast("string")).alias("package"),
        k.alias("pos"), k.cast("string").alias("id"),
        F.concat("p_name", F.when(F.col("p_size") > 25, F.lit("駅別乗車人員")).otherwise(F.lit("")))
        .alias("name"),
        F.concat(F.lit("u"), k.cast("string")).alias("url"), F.lit("csv").alias("format"),
    )
    return usage.station_tables(files)


@check(
    "yearbook_entries",
    f"""SELECT 'y-' || n AS dataset_id, 'u' || min(p_partkey) AS resource_url, count(p_partkey) AS n_tables,
      '{fv.YEARBOOK_REASON}' AS reason
    FROM (SELECT unnest(range(60)) AS n) LEFT JOIN part ON p_partkey % 50 = n AND p_size > 25 GROUP BY n""",
)
def yearbook_entries(t: Tables) -> DataFrame:
    """All fifty packages, and ten without any table."""
    name = F.concat(F.lit("y-"), F.col("id").cast("string"))
    packages = t.spark.range(60).select(
        name.alias("name"), name.alias("title"), F.lit("x").alias("organization"), F.lit("x").alias("source_url"),
        F.lit("x").alias("license_id"), F.lit("x").alias("metadata_modified"),
    )
    return usage.yearbook_entries(packages, part_tables(t)).select(
        "dataset_id", "resource_url", "n_tables", "reason"
    )


@check(
    "yearbook_tables",
    """SELECT 'y-' || (p_partkey % 50) AS package, p_name || '駅別乗車人員' AS name, 'u' || p_partkey AS url,
      row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) AS place
    FROM part WHERE p_size > 25""",
)
def yearbook_tables(t: Tables) -> DataFrame:
    return usage.yearbook_listing(part_tables(t)).select("package", "name", "url", "place")


CTES.add(
    "edition",
    """SELECT *, 'T' || n AS t, n % 10 = 3 AS bad FROM (
      SELECT *, (replace(station, 'Supplier#', '')::BIGINT * 7 + l_linenumber) % 50 AS n FROM yearbook)""",
    ("yearbook",),
)
CTES.add(
    "edition_member",
    """SELECT station, count(*) AS n_expected, count(*) FILTER (NOT bad) AS n_read,
      string_agg(t, ',' ORDER BY t) FILTER (bad) AS missing
    FROM (SELECT DISTINCT station, t, bad FROM edition) GROUP BY station""",
    ("edition",),
)
CTES.add(
    "edition_usage",
    """SELECT station, fiscal_year, sum(thousands)::DOUBLE * 1000 / date_diff('day',
      make_date(fiscal_year, 4, 1), make_date(fiscal_year + 1, 4, 1))::DOUBLE AS per_day
    FROM edition WHERE NOT bad AND thousands IS NOT NULL
      AND fiscal_year = (SELECT max(fiscal_year) FROM edition WHERE NOT bad) GROUP BY station, fiscal_year""",
    ("edition",),
)


@check(
    "usage_lineage",
    select(
        """SELECT site_id, CASE WHEN per_day IS NOT NULL AND missing IS NULL THEN 'complete' ELSE 'incomplete' END
            AS status,
          CASE WHEN missing IS NULL THEN round_even(per_day, 0)::BIGINT END AS count,
          coalesce(round_even(per_day, 0)::BIGINT, 0) AS lower_bound, fiscal_year,
          coalesce(n_expected, 0) AS n_expected, coalesce(n_read, 0) AS n_read, coalesce(missing, '') AS missing
        FROM site s LEFT JOIN edition_member m ON m.station = s.name
          LEFT JOIN edition_usage u ON u.station = s.name""",
        "site", "edition_member", "edition_usage",
    ),
)
def usage_lineage(t: Tables) -> DataFrame:
    """Fifty tables of which five cannot be read: only the sites that they list are incomplete."""
    number = (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 50
    edition = tb.yearbook(t, F.concat(F.lit("T"), number.cast("string")))
    names = t.spark.range(50).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("dataset_id"), "id")
    fields = F.array(F.lit("Fiscal year"), F.when(F.col("id") % 10 == 3, F.lit("Stop")).otherwise(F.lit("駅")),
                     F.lit("乗車人員 総数"))
    datasets = names.select("dataset_id", fields.alias("fields"))
    unread = usage.table_problems(datasets).select(F.col("key").alias("table_name"))
    rows = cut(edition.join(unread, "table_name", "left_anti"))
    found = usage.checked_usage(
        tb.sites(t), rows, cut(usage.table_members(edition)), usage.table_states(datasets, rows)
    )
    return found.withColumn("missing", F.array_join("missing", ","))


@check(
    "english_names_listed",
    f"""WITH latest AS (SELECT *, rank() OVER (PARTITION BY table_name ORDER BY fiscal_year DESC) AS r
      FROM (SELECT o_orderpriority AS table_name, -ascii(o_orderpriority) AS pos, o_orderkey AS row_no,
        year(o_orderdate) AS fiscal_year, 'S' || (o_custkey % 300) AS station, 'Name ' || o_orderkey AS station_en
        FROM orders))
    SELECT station, arg_min(station_en, (pos, row_no)) AS station_en FROM latest WHERE r = 1 GROUP BY 1""",
)
def english_names_listed(t: Tables) -> DataFrame:
    """Tables listed in another order than that of their names: the listed order counts."""
    k = F.col("o_orderkey")
    rows = t("orders").select(
        F.col("o_orderpriority").alias("table_name"), (-F.ascii("o_orderpriority")).alias("table_pos"),
        k.alias("row_no"), F.year("o_orderdate").alias("fiscal_year"),
        F.concat(F.lit("S"), (F.col("o_custkey") % 300).cast("string")).alias("station"),
        F.concat(F.lit("Name "), k.cast("string")).alias("station_en"),
        F.lit(fv.DEFAULT_OPERATOR).alias("operator"), F.lit(1).alias("thousands"),
    )
    return usage.english_names(rows)


# --- contracts -------------------------------------------------------------------------------

CTES.add("k", "SELECT o_orderkey AS k, 's' || o_orderkey AS s FROM orders")


@check(
    "contract_violations",
    select(
        """SELECT 'values' AS name, 'feature: unknown value' AS rule, s || '/zoo' AS key FROM k WHERE k % 3 = 2 UNION ALL
        SELECT 'values', 'raw: out of range', s || '/' || (['park', 'library', 'zoo'])[1 + k % 3] FROM k WHERE k % 9 = 0 UNION ALL
        SELECT 'values', 'percentile: out of range', s || '/' || (['park', 'library', 'zoo'])[1 + k % 3] FROM k WHERE k % 103 > 100 UNION ALL
        SELECT 'weights', 'effective_weight: out of range', 's' || k // 2 || '/park' FROM k WHERE k % 12 = 11 UNION ALL
        SELECT 'weights', 'not unique', 's' || k // 2 || '/park' FROM k GROUP BY k // 2 HAVING count(*) > 1 UNION ALL
        SELECT 'scores', 'score: out of range', s FROM k WHERE k % 102 = 101 UNION ALL
        SELECT 'scores', 'coverage: missing', s FROM k WHERE k % 3 = 0 UNION ALL
        SELECT 'scores', 'rank: out of range', s FROM k WHERE k % 5 = 0 UNION ALL
        SELECT 'evidence', 'name: blank', s || '/park/f' FROM k WHERE k % 7 = 0 UNION ALL
        SELECT 'evidence', 'distance_m: out of range', s || '/park/f' FROM k WHERE k % 11 = 0 UNION ALL
        SELECT 'evidence', 'coord_source: unknown value', s || '/park/f' FROM k WHERE k % 3 = 2 UNION ALL
        SELECT 'lines', 'operator: blank', s || '//' FROM k WHERE k % 6 = 0 UNION ALL
        SELECT 'lines', 'thousands: out of range', s || CASE WHEN k % 6 = 0 THEN '//' ELSE '/op/' END FROM k WHERE k % 8 = 0 UNION ALL
        SELECT 'usage', 'missing[]: blank', s FROM k WHERE k % 4 = 1 UNION ALL
        SELECT 'register', 'source_url: no match', 'park/' || s FROM k WHERE k % 10 = 0 UNION ALL
        SELECT 'register', 'status: unknown value', 'park/' || s FROM k WHERE k % 4 = 0 UNION ALL
        SELECT 'register', 'ingest.status: unknown value', 'park/' || s FROM k WHERE k % 5 <> 0 AND k % 2 = 1 UNION ALL
        SELECT 'sources', 'url: no column', ''""",
        "k",
    ),
)
def contract_violations(t: Tables) -> DataFrame:
    """Every order as a row of each published table, much of it broken."""
    k = F.col("o_orderkey")
    site, park = F.concat(F.lit("s"), k.cast("string")).alias("site_id"), F.lit("park").alias("feature")
    orders = t("orders")
    number = F.lit(None).cast("double")
    made = {
        "values": orders.select(
            site, pick(["park", "library", "zoo"], k % 3).alias("feature"), ((k % 9).cast("double") - 1).alias("raw"),
            (k % 103).cast("double").alias("percentile"), number.alias("low")),
        "weights": orders.select(
            F.concat(F.lit("s"), F.floor(k / 2).cast("string")).alias("site_id"), park,
            (k % 12 / F.lit(10.0)).alias("effective_weight")),
        "scores": orders.select(
            site, (k % 102).cast("double").alias("score"), F.when(k % 3 != 0, F.lit(0.5)).alias("coverage"),
            (k % 5).alias("rank"), *[F.lit(1).alias(c) for c in ("of", "rank_min", "rank_max")]),
        "evidence": orders.select(
            site, park, F.lit("f").alias("facility_id"), F.when(k % 7 == 0, F.lit(" ")).otherwise(F.lit("n")).alias("name"),
            F.when(k % 11 == 0, F.lit(-0.1)).otherwise(F.lit(3.0)).alias("distance_m"),
            pick(["source", "geocode", "guess"], k % 3).alias("coord_source")),
        "lines": orders.select(
            site, F.when(k % 6 == 0, F.lit("")).otherwise(F.lit("op")).alias("operator"), F.lit("").alias("line"),
            F.when(k % 8 == 0, F.lit(-1)).otherwise(F.lit(1)).alias("thousands")),
        "usage": orders.select(
            site, F.lit("complete").alias("status"), F.lit(1).alias("count"), F.lit(1).alias("lower_bound"),
            F.lit(2023).alias("fiscal_year"), F.array(F.lit("t"), F.when(k % 4 == 1, F.lit("")).otherwise(F.lit("u"))).alias("missing")),
        "register": orders.select(
            park, site.alias("dataset_id"), F.lit("n").alias("name"),
            F.when(k % 10 == 0, F.lit("ftp://x")).otherwise(F.lit("https://x")).alias("source_url"),
            F.when(k % 4 == 0, F.lit("review")).otherwise(F.lit("accepted")).alias("status"),
            F.lit("accepted").alias("auto_status"), F.lit("r").alias("reason"),
            F.when(k % 5 != 0, F.struct(pick(["ok", "odd"], k % 2).alias("status"), F.lit(1).alias("located"))).alias("ingest")),
        "sources": orders.select(
            site, park, F.lit("d").alias("source_id"), F.lit("n").alias("source_name"), F.lit("opendata").alias("kind")),
    }
    found = [
        contract.published(name, df).select(F.lit(name).alias("name"), "rule", "key") for name, df in made.items()
    ]
    return reduce(DataFrame.unionByName, found)
