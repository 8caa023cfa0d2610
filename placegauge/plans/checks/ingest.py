"""Checks of column roles, cleaning, filters, addresses, reports and duplicates.

Customers are read as the rows of differently shaped municipal lists, one list per nation and
segment.  Their texts are put together from the key, so the SQL side knows the clean form.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.functions import text as tx
from placegauge.operators import dedupe, facilities, inspections, roles
from placegauge.plans import testbed as tb
from placegauge.session import checkpoint_folder, cut, require_checkpoint_folder
from placegauge.plans.checks.base import (
    CTES,
    Tables,
    check,
    hashed_lat,
    hashed_lng,
    pick,
    sql_lat,
    sql_list,
    sql_lng,
    sql_pick,
    sql_round,
)
from placegauge.sources import files, ranges

select = CTES.select

TOWNS = ["丸の内", "銀座", "本町"]
KANJI = ["一", "二", "三", "十", "十二", "二十三"]
KANJI_VALUES = [1, 2, 3, 10, 12, 23]
TAILS = ["", "ほか", "先", "　金剛院", "/別地", "・他", "", ""]
NAME_WORDS = ["中央", "緑", "第一", "ＡＢＣ", "東", "西 ", "南"]
NAME_KINDS = ["公園", "図書館", "会館", "文化財（無形）", "観光案内", "倉庫"]
NAME_ENDS = ["", "分館", "（改修中）", "分室"]
CATEGORIES = ["無形文化財", "施設", "公園"]
MUNICIPALITIES = list(fv.MUNICIPALITIES.values())
ORGANIZATIONS = MUNICIPALITIES[:24] + ["東京都建設局"]
SCOPE = MUNICIPALITIES[0:24:2] + ["東京都建設局"]
WIDE_DIGITS = "０１２３４５６７８９"
STYLES = [
    ["名称", "緯度", "経度", "所在地", "種別"],
    ["施設名", "lat", "LNG", "住所", "分類", "大分類"],
    ["ID", " Name", "Latitude", "Long itude", "Address", "Category"],
    ["観光ポイント_名称", "観光ポイント_緯度", "観光ポイント_経度", "観光ポイント_所在地", "備考"],
    ["番号", "緯度", "経度"],
]
NAMELESS_NATION = 23


def listing(t: Tables) -> DataFrame:
    """Customers with the parts their rows are made of."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    feature = tb.feature_of(F.col("c_mktsegment"), tb.SEGMENTS)
    own = F.when(k % 5 == 0, F.lit("")).otherwise(pick(MUNICIPALITIES, k % 62))
    organization = pick(ORGANIZATIONS, nation)
    number = (k % 30 + 1).cast("string")
    wide = F.when(k % 4 == 0, F.translate(number, "0123456789", WIDE_DIGITS)).otherwise(number)
    return t("customer").select(
        k.alias("k"),
        nation.alias("nation"),
        feature.alias("feature"),
        F.concat_ws("-", F.lit("ds"), nation.cast("string"), feature).alias("dataset_id"),
        organization.alias("organization"),
        F.when(nation == NAMELESS_NATION, 4).otherwise(nation % 4).alias("style"),
        F.when(k % 97 == 0, F.lit("  "))
        .otherwise(F.concat(pick(NAME_WORDS, k % 7), pick(NAME_KINDS, k % 6), pick(NAME_ENDS, k % 4)))
        .alias("name"),
        F.when(k % 13 == 0, F.lit("x"))
        .when(k % 17 == 0, F.lit("0"))
        .when(F.col("c_acctbal") < 2000, F.lit(""))
        .otherwise(F.concat(F.lit(" "), hashed_lat(k).cast("string")))
        .alias("lat_text"),
        F.when(F.col("c_acctbal") < 2000, F.lit("")).otherwise(hashed_lng(k).cast("string")).alias(
            "lng_text"
        ),
        own.alias("own"),
        F.concat(
            pick(TOWNS, k % 3), pick(KANJI, k % 6), F.lit("丁目"), number, F.lit("番"),
            (k % 9 + 1).cast("string"), F.lit("号"),
        ).alias("below"),
        F.when(k % 11 == 0, F.lit(""))
        .when(k % 19 == 0, F.lit("長野県軽井沢町1"))
        .otherwise(
            F.concat(
                F.when(k % 3 == 0, F.lit("東京都 ")).otherwise(F.lit("")),
                F.when(k % 23 == 0, own).otherwise(F.lit("")),
                own,
                pick(TOWNS, k % 3), pick(KANJI, k % 6), F.lit("丁目"), wide, F.lit("番"),
                (k % 9 + 1).cast("string"), F.lit("号"), pick(TAILS, k % 8),
            )
        )
        .alias("address_text"),
        pick(CATEGORIES, k % 3).alias("category"),
        pick(["", "大"], k % 2).alias("category2"),
    )


CTES.add(
    "listing",
    f"""SELECT *, CASE WHEN own = '' AND nation < 24 THEN organization ELSE own END AS placed
    FROM (SELECT c_custkey AS k, c_nationkey AS nation,
      {tb.sql_feature('c_mktsegment', tb.SEGMENTS)} AS feature,
      'ds-' || c_nationkey || '-' || {tb.sql_feature('c_mktsegment', tb.SEGMENTS)} AS dataset_id,
      {sql_pick(ORGANIZATIONS, 'c_nationkey')} AS organization,
      CASE WHEN c_nationkey = {NAMELESS_NATION} THEN 4 ELSE c_nationkey % 4 END AS style,
      CASE WHEN c_custkey % 97 <> 0 THEN {sql_pick(NAME_WORDS, 'c_custkey % 7')}
        || {sql_pick(NAME_KINDS, 'c_custkey % 6')} || {sql_pick(NAME_ENDS, 'c_custkey % 4')} END AS name,
      CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 0
        WHEN c_acctbal < 2000 THEN NULL ELSE {sql_lat('c_custkey')} END AS lat0,
      CASE WHEN c_acctbal < 2000 THEN NULL ELSE {sql_lng('c_custkey')} END AS lng0,
      CASE WHEN c_custkey % 5 = 0 THEN '' ELSE {sql_pick(MUNICIPALITIES, 'c_custkey % 62')} END AS own,
      {sql_pick(TOWNS, 'c_custkey % 3')} AS town, {sql_pick(KANJI, 'c_custkey % 6')} AS kanji,
      {KANJI_VALUES}[1 + c_custkey % 6] AS block,
      c_custkey % 30 + 1 AS n, c_custkey % 9 + 1 AS m,
      c_custkey % 11 <> 0 AS has_address,
      c_custkey % 11 <> 0 AND c_custkey % 19 = 0 AS outside,
      {sql_pick(CATEGORIES, 'c_custkey % 3')} AS category,
      {sql_pick(['', '大'], 'c_custkey % 2')} AS category2
    FROM customer)""",
)


def datasets(t: Tables) -> DataFrame:
    fields = F.element_at(
        F.array(*[F.array(*[F.lit(f) for f in style]) for style in STYLES]),
        (F.col("style") + 1).cast("int"),
    )
    return (
        listing(t)
        .select("dataset_id", "style", "feature", "organization", "nation")
        .distinct()
        .withColumn("fields", fields)
    )


CTES.add(
    "dataset_field",
    "SELECT dataset_id, unnest(fields) AS field, unnest(range(len(fields))) AS field_pos FROM ("
    "SELECT DISTINCT dataset_id, CASE style "
    + " ".join(f"WHEN {i} THEN {sql_list(s)}" for i, s in enumerate(STYLES))
    + " END AS fields FROM listing)",
    ("listing",),
)
CTES.add(
    "candidate",
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{role}', {i}, '{c.lower()}')"
        for role, names in fv.ROLE_CANDIDATES.items()
        for i, c in enumerate(names)
    )
    + ") v(role, cand_pos, cand)",
)
CTES.add(
    "role_match",
    """SELECT *, CASE WHEN header = cand THEN 1 WHEN starts_with(header, cand) THEN 2
      WHEN suffix(header, '_' || cand) THEN 3 END AS pass
    FROM (SELECT *, replace(lower(trim(field)), ' ', '') AS header FROM dataset_field), candidate""",
    ("dataset_field", "candidate"),
)


@check(
    "column_roles",
    select(
        """SELECT dataset_id, role, arg_min(field, (pass, cand_pos, field_pos)) AS field
        FROM role_match WHERE pass IS NOT NULL GROUP BY ALL""",
        "role_match",
    ),
)
def column_roles(t: Tables) -> DataFrame:
    return roles.column_roles(datasets(t))


@check(
    "category_columns",
    select(
        """SELECT d.dataset_id, count(c.field) AS n, string_agg(c.field, ',' ORDER BY c.field_pos)
          AS fields
        FROM (SELECT DISTINCT dataset_id FROM listing) d LEFT JOIN (
          SELECT DISTINCT dataset_id, field, field_pos FROM role_match
          WHERE role = 'category' AND pass IS NOT NULL) c USING (dataset_id) GROUP BY ALL""",
        "listing", "role_match",
    ),
)
def category_columns(t: Tables) -> DataFrame:
    found = roles.category_columns(datasets(t))
    joined = F.nullif(F.array_join("fields", ","), F.lit(""))
    return found.select("dataset_id", F.size("fields").cast("long").alias("n"), joined.alias("fields"))


def records(t: Tables, row_no: Column | None = None) -> DataFrame:
    cells = {
        "名称": "name", "施設名": "name", " Name": "name", "観光ポイント_名称": "name",
        "緯度": "lat_text", "lat": "lat_text", "Latitude": "lat_text", "観光ポイント_緯度": "lat_text",
        "経度": "lng_text", "LNG": "lng_text", "Long itude": "lng_text",
        "観光ポイント_経度": "lng_text",
        "所在地": "address_text", "住所": "address_text", "Address": "address_text",
        "観光ポイント_所在地": "address_text",
        "種別": "category", "分類": "category", "Category": "category", "大分類": "category2",
        "ID": "k", "番号": "k", "備考": "category2",
    }
    rec = F.lit(None).cast("map<string,string>")
    for i, style in enumerate(STYLES):
        entries = [v for f in style for v in (F.lit(f), F.col(cells[f]).cast("string"))]
        rec = F.when(F.col("style") == i, F.create_map(*entries)).otherwise(rec)
    number = row_no if row_no is not None else F.col("k") + 1
    return listing(t).select("dataset_id", number.alias("row_no"), rec.alias("rec"))


_VALID = (
    "coalesce(lat0 BETWEEN 20 AND 36.5 AND lng0 BETWEEN 136 AND 154, false)"
)


@check(
    "fill_rates",
    select(
        f"""SELECT dataset_id, count(*) AS sample_size, count(*) AS total,
          {sql_round('count(*) FILTER (valid) / count(*)', 3)} AS coord_fill,
          CASE WHEN any_value(style) <> 4 THEN {sql_round(
            'count(*) FILTER (has_address) / count(*)', 3)} END AS address_fill
        FROM (SELECT *, {_VALID} AS valid FROM listing) GROUP BY 1""",
        "listing",
    ),
)
def fill_rates(t: Tables) -> DataFrame:
    return roles.fill_rates(
        records(t, F.col("k") % 100 + 1), roles.role_table(datasets(t)), datasets(t)
    )


@check(
    "kept_inspections",
    select(
        f"""SELECT dataset_id, sha256(dataset_id) AS sha256, same AS reused,
          CASE WHEN same THEN 7 ELSE rows END AS total,
          CASE WHEN same THEN cast(0.125 AS double) ELSE coord_fill END AS coord_fill,
          CASE WHEN NOT same THEN address_fill END AS address_fill, same OR has_address AS has_address
        FROM (SELECT dataset_id, any_value(nation) % 3 <> 0 AS same, count(*) AS rows,
            any_value(style) <> 4 AS has_address,
            {sql_round('count(*) FILTER (valid) / count(*)', 3)} AS coord_fill,
            CASE WHEN any_value(style) <> 4 THEN {sql_round(
              'count(*) FILTER (has_address) / count(*)', 3)} END AS address_fill
          FROM (SELECT *, {_VALID} AS valid FROM listing) GROUP BY 1)""",
        "listing",
    ),
)
def kept_inspections(t: Tables) -> DataFrame:
    """A second run: every third nation's files have other bytes than when they were inspected."""
    found = cut(datasets(t))
    now = F.sha2("dataset_id", 256)
    before = F.when(F.col("nation") % 3 == 0, F.sha2(F.concat("dataset_id", F.lit("old")), 256)).otherwise(now)
    kept = found.select(
        "dataset_id", before.alias("sha256"), F.lit(7).cast("bigint").alias("sample_size"),
        F.lit(7).cast("bigint").alias("total"), F.lit(0.125).alias("coord_fill"),
        F.lit(None).cast("double").alias("address_fill"), F.lit(True).alias("has_address"), "fields",
    )
    current = inspections.digests(found.select("dataset_id", now.alias("sha256")))
    rows = records(t, F.col("k") % 100 + 1)
    return inspections.renewed(current, kept, found.select("dataset_id", "fields"), rows).select(
        "dataset_id", "sha256", "reused", "total", "coord_fill", "address_fill", "has_address"
    )


def entries(t: Tables) -> DataFrame:
    """Accepted manifest entries of the lists; some are in a format nobody can read."""
    return datasets(t).select(
        "feature",
        "dataset_id",
        "organization",
        (F.col("nation") % 3 == 0).alias("row_filter"),
        F.when(F.col("nation") % 7 == 5, F.lit("pdf")).otherwise(F.lit("CSV")).alias("format"),
        F.concat(F.lit("https://example.org/dataset/"), "dataset_id").alias("source_url"),
        F.concat(F.lit("https://example.org/file/"), "dataset_id").alias("resource_url"),
    )


CTES.add(
    "listed",
    f"""SELECT *, dataset_id || ':' || (k + 1) AS facility_id, nation % 3 = 0 AS row_filter,
      CASE WHEN {_VALID} THEN lat0 END AS lat, CASE WHEN {_VALID} THEN lng0 END AS lng,
      list_filter(CASE style WHEN 1 THEN [category, category2] WHEN 3 THEN []
        ELSE [category] END, lambda c: c <> '') AS categories
    FROM listing WHERE name IS NOT NULL AND nation % 7 <> 5 AND style <> 4""",
    ("listing",),
)


def normalised(t: Tables) -> DataFrame:
    table = cut(roles.role_table(datasets(t)))
    failed = facilities.unreadable(entries(t), table).select("feature", "dataset_id")
    usable = entries(t).join(failed, ["feature", "dataset_id"], "left_anti")
    return facilities.normalise(records(t), table, usable)


@check(
    "normalised_facilities",
    select(
        f"""SELECT facility_id, feature, dataset_id, organization, trim(name) AS name, lat, lng,
          CASE WHEN lat IS NOT NULL THEN 'source' END AS coord_source,
          array_to_string(categories, '|') AS categories, has_address, row_filter
        FROM listed""",
        "listed",
    ),
)
def normalised_facilities(t: Tables) -> DataFrame:
    return normalised(t).select(
        "facility_id", "feature", "dataset_id", "organization", "name", "lat", "lng",
        "coord_source", F.array_join("categories", "|").alias("categories"),
        F.col("address").isNotNull().alias("has_address"), "row_filter",
    )


@check(
    "unreadable_datasets",
    select(
        """SELECT DISTINCT feature, dataset_id, CASE WHEN nation % 7 = 5
          THEN 'unsupported format: pdf' ELSE 'name column not found' END AS error
        FROM listing WHERE nation % 7 = 5 OR style = 4""",
        "listing",
    ),
)
def unreadable_datasets(t: Tables) -> DataFrame:
    failed = facilities.unreadable(entries(t), roles.role_table(datasets(t)))
    return failed.select("feature", "dataset_id", "error")


_DEFINITION_ROWS = ", ".join(
    f"('{f}', {sql_list(d['keywords'])}, {sql_list(d.get('include_names', ()))}::VARCHAR[], "
    f"{sql_list(d.get('exclude_markers', ()))}::VARCHAR[], "
    f"{sql_list(d.get('exclude_categories', ()))}::VARCHAR[], "
    f"{sql_list([w + s for w in d.get('exclude_names', ()) for s in fv.BRANCH_SUFFIXES])}::VARCHAR[])"
    for f, d in fv.FEATURE_DEFINITIONS.items()
)
CTES.add(
    "definition",
    f"SELECT * FROM (VALUES {_DEFINITION_ROWS}) "
    "v(feature, keywords, include_names, markers, bad_categories, endings)",
)
CTES.add(
    "marked",
    """SELECT *, len(list_filter(endings, lambda e: suffix(base, e))) > 0
        OR len(list_filter(markers, lambda m: contains(name, m))) > 0
        OR len(list_filter(categories, lambda c:
             len(list_filter(bad_categories, lambda w: contains(c, w))) > 0)) > 0 AS hard,
      (len(include_names) = 0 OR len(list_filter(include_names, lambda w: contains(name, w))) > 0)
        AND (NOT row_filter OR len(list_filter(list_concat(keywords, include_names),
          lambda w: contains(name || ' ' || array_to_string(categories, ' '), w))) > 0) AS ruled
    FROM (SELECT l.*, d.* EXCLUDE (feature), regexp_replace(l.name, '[（(].*?[）)]$', '') AS base
      FROM listed l JOIN definition d USING (feature))""",
    ("listed", "definition"),
)


@check(
    "marked_rows",
    select("SELECT facility_id, hard, ruled FROM marked", "marked"),
)
def marked_rows(t: Tables) -> DataFrame:
    return facilities.mark_excluded(normalised(t)).select("facility_id", "hard", "ruled")


@check(
    "rule_rows",
    select("SELECT facility_id, feature FROM marked WHERE NOT hard AND ruled", "marked"),
)
def rule_rows(t: Tables) -> DataFrame:
    marked = facilities.mark_excluded(normalised(t))
    return facilities.select_rows(marked).select("facility_id", "feature")


def judgements(t: Tables) -> DataFrame:
    """All rows of some mixed lists are judged, and most rows of the others."""
    k, nation = F.col("k"), F.col("nation")
    return (
        listing(t)
        .where((nation % 6 == 0) | (k % 10 != 0))
        .select(
            F.concat_ws(":", "dataset_id", (k + 1).cast("string")).alias("facility_id"),
            F.when(k % 3 == 0, F.lit("none")).otherwise(F.col("feature")).alias("category"),
            (k % 10 / F.lit(10.0)).alias("confidence"),
        )
    )


CTES.add(
    "selected",
    """SELECT *, CASE WHEN row_filter AND all_judged THEN 'judgement' ELSE 'rule' END AS classified_by
    FROM (SELECT *, bool_and(nation % 6 = 0 OR k % 10 <> 0) OVER (PARTITION BY dataset_id)
      AS all_judged FROM marked WHERE NOT hard)
    WHERE CASE WHEN row_filter AND all_judged THEN k % 3 <> 0 AND (k % 10) / 10.0 >= 0.5
      ELSE ruled END""",
    ("marked",),
)


def selected(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    marked = cut(facilities.mark_excluded(rows if rows is not None else normalised(t)))
    return facilities.select_rows(marked, judgements(t))


@check(
    "judged_rows",
    select("SELECT facility_id, feature, classified_by FROM selected", "selected"),
)
def judged_rows(t: Tables) -> DataFrame:
    return selected(t).select("facility_id", "feature", "classified_by")


@check(
    "row_judgements",
    select(
        """SELECT facility_id, feature, classified_by,
          CASE classified_by WHEN 'judgement' THEN CASE WHEN k % 3 = 0 THEN 'none' ELSE feature END END AS category,
          CASE classified_by WHEN 'judgement' THEN (k % 10) / 10::DOUBLE END AS confidence FROM selected""",
        "selected",
    ),
)
def row_judgements(t: Tables) -> DataFrame:
    """Rows keep the judgement that counted them."""
    return selected(t).select(
        "facility_id", "feature", "classified_by", "semantic.category", "semantic.confidence"
    )


@check(
    "name_keys",
    """SELECT k, replace(replace(regexp_replace(name, '[（(].*?[）)]', '', 'g'), 'ＡＢＣ', 'ABC'),
      ' ', '') AS key FROM (WITH """
    + f"listing AS ({CTES.parts['listing'][0]})"
    + " SELECT k, name FROM listing WHERE name IS NOT NULL)",
)
def name_keys(t: Tables) -> DataFrame:
    return listing(t).where("trim(name) <> ''").select("k", tx.name_key(F.col("name")).alias("key"))


_QUERY = "'東京都' || placed || town || kanji || '丁目' || n || '番' || m || '号'"


@check(
    "complete_addresses",
    select(
        f"""SELECT k, CASE WHEN k % 11 = 0 THEN '東京都' || home
            WHEN k % 19 = 0 THEN '東京都' || home || '長野県軽井沢町1' ELSE {_QUERY} END AS query
          FROM (SELECT *, CASE WHEN organization LIKE '東京都%' THEN '' ELSE organization END AS home
            FROM listing)""",
        "listing",
    ),
)
def complete_addresses(t: Tables) -> DataFrame:
    """Also where there is no address, and where it lies outside the region."""
    query = tx.complete_address(F.col("address_text"), F.col("organization"))
    return listing(t).select("k", query.alias("query"))


@check(
    "canonical_addresses",
    select(
        """SELECT k, own || town || block || '-' || n || '-' || m AS canonical,
          town || kanji || '丁目' || n || '番' || m || '号' AS below FROM listing""",
        "listing",
    ),
)
def canonical_addresses(t: Tables) -> DataFrame:
    text = F.concat("own", "below")
    return listing(t).select(
        "k",
        tx.canonical_address(text).alias("canonical"),
        tx.below_municipality(text).alias("below"),
    )


@check(
    "match_precision",
    select(
        """SELECT k, CASE WHEN k % 5 = 0 THEN 'exact' WHEN k % 5 IN (1, 2) THEN 'partial'
          WHEN k % 5 = 3 AND block = 1 THEN 'partial' END AS "precision" FROM listing""",
        "listing",
    ),
)
def match_precision(t: Tables) -> DataFrame:
    """Same address in digits and hyphens; block only; town only; first block; nothing below."""
    k = F.col("k")
    town = F.concat(F.lit("東京都"), "own", pick(TOWNS, k % 3))
    block = pick([str(v) for v in KANJI_VALUES], k % 6)
    matched = (
        F.when(k % 5 == 0, F.concat(F.lit("東京都"), "own", "below"))
        .when(k % 5 == 1, F.concat(town, block, F.lit("丁目")))
        .when(k % 5 == 2, town)
        .when(k % 5 == 3, F.concat(town, F.lit("１丁目")))
        .otherwise(F.concat(F.lit("東京都"), "own"))
    )
    query = F.concat(town, block, F.lit("－"), (k % 30 + 1).cast("string"), F.lit("−"),
                     (k % 9 + 1).cast("string"))
    return listing(t).select("k", tx.match_precision(query, matched).alias("precision"))


# Four answers per query: the municipality, one that depends on the numbers, the exact address far
# away, and the block.  The last is missing for some queries.
_ANSWER = "(n + m) % 4"


def candidates(t: Tables) -> DataFrame:
    k = F.col("k")
    n, m = k % 30 + 1, k % 9 + 1
    placed = F.when(
        (F.col("own") == "") & (F.col("nation") < 24), F.col("organization")
    ).otherwise(F.col("own"))
    area = F.concat(F.lit("東京都"), placed)
    town = F.concat(area, pick(TOWNS, k % 3))
    block = F.concat(town, pick(KANJI, k % 6), F.lit("丁目"))
    exact = F.concat(area, "below")
    first = (
        F.when((n + m) % 4 == 0, F.translate(exact, "0123456789", WIDE_DIGITS))
        .when((n + m) % 4 == 1, block)
        .when((n + m) % 4 == 2, town)
        .otherwise(F.concat(area, F.lit("別町一丁目")))
    )

    def answer(pos: int, title: Column, lat: Column, lng: Column) -> Column:
        return F.struct(
            F.lit(pos).alias("pos"), title.alias("title"), lat.alias("lat"), lng.alias("lng")
        )

    lat, lng = F.lit(35.5) + n / F.lit(1000.0), F.lit(139.5) + m / F.lit(1000.0)
    answers = F.array(
        answer(0, area, lat, lng),
        answer(1, first, lat, lng),
        answer(2, exact, F.lit(0.0), F.lit(0.0)),
        answer(3, F.when(n % 2 == 0, block).otherwise(area), lat + 0.1, lng + 0.1),
    )
    return (
        listing(t)
        .where("k % 11 <> 0 AND k % 19 <> 0")
        .select(exact.alias("query"), F.explode(answers).alias("a"))
        .select("query", "a.*")
        .distinct()
    )


CTES.add(
    "address_hit",
    f"""SELECT DISTINCT query, CASE WHEN a < 3 THEN lat ELSE lat + 0.1::DOUBLE END AS lat,
      CASE WHEN a < 3 THEN lng ELSE lng + 0.1::DOUBLE END AS lng,
      CASE a WHEN 0 THEN translate(query, '0123456789', '{WIDE_DIGITS}') WHEN 2 THEN
        '東京都' || placed || town ELSE '東京都' || placed || town || kanji || '丁目' END AS matched,
      CASE a WHEN 0 THEN 'exact' ELSE 'partial' END AS "precision"
    FROM (SELECT *, {_QUERY} AS query, {_ANSWER} AS a, 35.5::DOUBLE + n / 1000::DOUBLE AS lat,
        139.5::DOUBLE + m / 1000::DOUBLE AS lng FROM listing WHERE has_address AND NOT outside)
    WHERE a < 3 OR n % 2 = 0""",
    ("listing",),
)


@check("address_matches", select("SELECT * FROM address_hit", "address_hit"))
def address_matches(t: Tables) -> DataFrame:
    found = candidates(t)
    return facilities.address_matches(found.select("query"), found)


CTES.add(
    "located",
    f"""SELECT s.* EXCLUDE (lat, lng), coalesce(s.lat, h.lat) AS lat, coalesce(s.lng, h.lng) AS lng,
      CASE WHEN s.lat IS NOT NULL THEN 'source' WHEN h.query IS NOT NULL THEN 'geocode' END
        AS coord_source, h.matched, h."precision",
      CASE WHEN s.lat IS NOT NULL THEN NULL WHEN NOT has_address THEN 'no-address'
        WHEN outside THEN 'outside-tokyo' WHEN NOT in_scope THEN 'out-of-geocode-scope'
        WHEN n = 7 THEN 'geocode-error' WHEN h.query IS NULL THEN 'geocode-not-found' END
        AS unlocated_reason
    FROM (SELECT *, {_QUERY} AS query, organization IN ({', '.join(f"'{o}'" for o in SCOPE)})
        AS in_scope FROM selected) s
    LEFT JOIN address_hit h ON s.query = h.query AND s.lat IS NULL AND s.has_address
      AND NOT s.outside AND s.in_scope AND n <> 7""",
    ("selected", "address_hit"),
)


def located(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    answers = cut(candidates(t))
    failed = answers.where(F.col("query").rlike("丁目7番")).select("query")
    return facilities.locate(cut(selected(t, rows)), answers, SCOPE, failed)


@check(
    "located_facilities",
    select(
        """SELECT facility_id, feature, lat, lng, coord_source, matched, "precision",
        unlocated_reason, classified_by FROM located""",
        "located",
    ),
)
def located_facilities(t: Tables) -> DataFrame:
    return located(t).select(
        "facility_id", "feature", "lat", "lng", "coord_source", "matched", "precision",
        "unlocated_reason", "classified_by",
    )


CTES.add(
    "ingest_row",
    """SELECT feature, dataset_id, count(*) AS "rows",
      count(*) FILTER (coord_source = 'source') AS with_source,
      count(*) FILTER (coord_source = 'geocode') AS geocoded,
      count(*) FILTER ("precision" = 'partial') AS geocoded_partial,
      count(*) FILTER (unlocated_reason = 'outside-tokyo') AS outside,
      count(*) FILTER (unlocated_reason = 'out-of-geocode-scope') AS out_of_scope
    FROM located GROUP BY ALL""",
    ("located",),
)
CTES.add(
    "ingest_report",
    """SELECT feature, dataset_id, organization, CASE WHEN error IS NOT NULL THEN 'failed'
        WHEN row_filter AND r = 0 THEN 'no-matching-rows'
        WHEN r > 0 AND r - oos - o = 0 AND ws + g = 0 THEN 'out-of-scope'
        WHEN r - oos - o > 0 AND (ws + g) / (r - oos - o) < 0.5 THEN 'degraded' ELSE 'ok' END
        AS status,
      CASE WHEN error IS NULL THEN r END AS "rows", CASE WHEN error IS NULL THEN a - r END AS excluded,
      CASE WHEN error IS NULL THEN ws END AS with_source, CASE WHEN error IS NULL THEN g END AS geocoded,
      CASE WHEN error IS NULL THEN gp END AS geocoded_partial,
      CASE WHEN error IS NULL THEN r - ws - g - o END AS unlocated,
      CASE WHEN error IS NULL THEN o END AS outside,
      CASE WHEN error IS NULL THEN oos END AS out_of_scope, error
    FROM (SELECT d.*, coalesce("rows", 0) AS r, coalesce(with_source, 0) AS ws,
        coalesce(geocoded, 0) AS g, coalesce(geocoded_partial, 0) AS gp,
        coalesce(i.outside, 0) AS o, coalesce(i.out_of_scope, 0) AS oos,
        coalesce((SELECT count(*) FROM listed l WHERE l.dataset_id = d.dataset_id), 0) AS a
      FROM (SELECT DISTINCT feature, dataset_id, organization, nation % 3 = 0 AS row_filter,
          CASE WHEN nation % 7 = 5 THEN 'unsupported format: pdf'
            WHEN style = 4 THEN 'name column not found' END AS error FROM listing) d
      LEFT JOIN ingest_row i USING (feature, dataset_id))""",
    ("listing", "listed", "ingest_row"),
)


def report(t: Tables) -> DataFrame:
    table = cut(roles.role_table(datasets(t)))
    errors = facilities.unreadable(entries(t), table).select("feature", "dataset_id", "error")
    noted = entries(t).join(errors, ["feature", "dataset_id"], "left")
    rows = cut(normalised(t))
    return facilities.ingest_report(noted, rows, located(t, rows))


@check("ingest_report", select("SELECT * FROM ingest_report", "ingest_report"))
def ingest_report(t: Tables) -> DataFrame:
    return report(t)


@check(
    "unlocated_by_reason",
    select(
        """SELECT feature, unlocated_reason AS reason, count(*) AS n FROM located
        WHERE coord_source IS NULL GROUP BY ALL""",
        "located",
    ),
)
def unlocated_by_reason(t: Tables) -> DataFrame:
    return facilities.unlocated_by_reason(located(t))


# --- duplicates ----------------------------------------------------------------------------------

SAME_PLACE = {f: d.get("same_place_m") for f, d in fv.FEATURE_DEFINITIONS.items()}


def crowd(t: Tables) -> DataFrame:
    """Customers packed into a small area, with few names and shared spots."""
    k = F.col("c_custkey")
    spot = k % 1000 + (k * 13) % 7 * 1000
    lat = F.lit(35.6) + ((spot * 7919) % 10007) / F.lit(10007.0) * F.lit(0.02)
    lng = F.lit(139.6) + ((spot * 104729) % 10009) / F.lit(10009.0) * F.lit(0.025)
    there = k % 29 != 0
    return t("customer").select(
        F.concat_ws(":", F.lit("c"), k.cast("string")).alias("facility_id"),
        tb.feature_of(F.col("c_mktsegment"), tb.SEGMENTS).alias("feature"),
        F.concat(F.lit("施設 "), (k % 3).cast("string"), pick(["", "（旧）"], k % 2)).alias("name"),
        F.when(there, lat).alias("lat"),
        F.when(there, lng).alias("lng"),
        F.when(there, pick(["source", "geocode", "geocode"], k % 3)).alias("coord_source"),
        F.when(there, pick([None, "exact", "partial"], k % 3)).alias("precision"),
        F.when(~there, F.lit(fv.NO_ADDRESS)).alias("unlocated_reason"),
    )


_SPOT = "(c_custkey % 1000 + (c_custkey * 13) % 7 * 1000)"
CTES.add(
    "crowd",
    f"""SELECT 'c:' || c_custkey AS id, {tb.sql_feature('c_mktsegment', tb.SEGMENTS)} AS feature,
      c_custkey % 3 AS key, c_custkey % 3 AS rank, c_custkey % 29 <> 0 AS there,
      35.6::DOUBLE + (({_SPOT}*7919) % 10007)::DOUBLE / 10007::DOUBLE * 0.02::DOUBLE AS lat,
      139.6::DOUBLE + (({_SPOT}*104729) % 10009)::DOUBLE / 10009::DOUBLE * 0.025::DOUBLE AS lng
    FROM customer""",
)
_METRES = (
    "2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + "
    "cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))"
)
CTES.add(
    "edge",
    f"""SELECT * FROM (SELECT a.id AS hi, b.id AS lo, a.rank AS hi_rank, a.feature,
        a.key = b.key AND {_METRES} <= 150 AS by_name,
        a.feature IN ('culture', 'publicFacility') AND {_METRES} <= 30 AS by_place
      FROM crowd a JOIN crowd b ON a.feature = b.feature AND (a.rank, a.id) < (b.rank, b.id)
      WHERE a.there AND b.there) WHERE by_name OR by_place""",
    ("crowd",),
)


def _dedupe_sql(query: str) -> str:
    """The greedy scan as rounds over explicit pairs; fine for the check's scale only."""
    head = CTES.select("", "crowd", "edge").replace("WITH ", "WITH RECURSIVE ", 1)
    return (
        head
        + """, state AS (SELECT id, 0 AS status, 0 AS r FROM crowd WHERE there
        UNION ALL
        SELECT s.id, CASE WHEN s.status <> 0 THEN s.status WHEN bool_or(h.status = 1) THEN 2
          WHEN coalesce(bool_or(h.status = 0), false) THEN 0 ELSE 1 END, s.r + 1
        FROM state s LEFT JOIN edge e ON e.lo = s.id LEFT JOIN state h ON h.id = e.hi
        WHERE (SELECT min(status) FROM state) = 0
        GROUP BY s.id, s.status, s.r),
        last AS (SELECT * FROM state WHERE r = (SELECT max(r) FROM state)),
        absorbed AS (SELECT l.id AS facility_id, c.feature, coalesce(
            arg_min(e.hi, (e.hi_rank, e.hi)) FILTER (e.by_name AND k.status = 1),
            arg_min(e.hi, (e.hi_rank, e.hi)) FILTER (e.by_place AND k.status = 1)) AS absorbed_by
          FROM last l JOIN crowd c ON c.id = l.id LEFT JOIN edge e ON e.lo = l.id
          LEFT JOIN last k ON k.id = e.hi WHERE l.status = 2 GROUP BY ALL) """
        + query
    )


@check(
    "absorbed_duplicates",
    _dedupe_sql("SELECT feature, facility_id, absorbed_by FROM absorbed"),
)
def absorbed_duplicates(t: Tables) -> DataFrame:
    return dedupe.merge_places(crowd(t))[1]


@check(
    "ingest_totals",
    _dedupe_sql(
        """SELECT feature, 1::BIGINT AS datasets, 0::BIGINT AS failed, 1::BIGINT AS degraded,
          0::BIGINT AS out_of_scope, count(*) AS "rows", count(*) - count(a.facility_id) AS facilities,
          count(*) FILTER (there) - count(a.facility_id) AS located,
          count(*) FILTER (NOT there) AS unlocated, count(a.facility_id) AS merged_duplicates
        FROM (SELECT * FROM crowd) c LEFT JOIN (SELECT facility_id FROM absorbed) a
          ON a.facility_id = c.id GROUP BY feature"""
    ),
)
def ingest_totals(t: Tables) -> DataFrame:
    rows = crowd(t)
    one = rows.select("feature").distinct().withColumn("status", F.lit("degraded"))
    return facilities.ingest_totals(one, rows, dedupe.merge_places(rows)[0])


@check(
    "rule_predictions",
    select(
        f"""SELECT k, coalesce((SELECT arg_min(d.feature, list_position({list(fv.FEATURE_DEFINITIONS)}, d.feature))
          FROM definition d WHERE len(list_filter(d.endings, lambda e: suffix(base, e))) = 0
            AND len(list_filter(d.markers, lambda m: contains(name, m))) = 0
            AND NOT (contains(category, '無形') AND len(d.bad_categories) > 0)
            AND (len(d.include_names) = 0
              OR len(list_filter(d.include_names, lambda w: contains(name, w))) > 0)
            AND len(list_filter(list_concat(d.keywords, d.include_names),
              lambda w: contains(name || ' ' || category, w))) > 0), 'none') AS prediction
        FROM (SELECT k, name, category, regexp_replace(name, '[（(].*?[）)]$', '') AS base FROM listing
          WHERE name IS NOT NULL)""",
        "listing", "definition",
    ),
)
def rule_predictions(t: Tables) -> DataFrame:
    """What the rules alone would count a row as."""
    answer = facilities.rule_prediction(F.col("name"), F.array("category"))
    return listing(t).where("trim(name) <> ''").select("k", answer.alias("prediction"))


@check(
    "decoded_texts",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16' WHEN 2 THEN 'cp932' END
        AS encoding,
      CASE doc_id % 4 WHEN 2 THEN '公園' || regexp_replace(text, '[^\x0A\x20-\x7E]', '', 'g')
        WHEN 3 THEN NULL ELSE text END AS text FROM documents""",
)
def decoded_texts(t: Tables) -> DataFrame:
    """Texts in three encodings, and bytes that are in none of them."""
    plain = F.regexp_replace("text", "[^\\x0A\\x20-\\x7E]", "")
    park = F.unhex(F.lit("8CF68980"))  # the same word in CP932
    kind = F.col("doc_id") % 4
    content = (
        F.when(kind == 0, F.encode("text", "UTF-8"))
        .when(kind == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .when(kind == 2, F.concat(park, F.encode(plain, "US-ASCII")))
        .otherwise(F.concat(F.encode(plain, "US-ASCII"), F.unhex(F.lit("8120"))))
    )
    return files.decoded(t("documents").select("doc_id", content.alias("content")))


def written(df: DataFrame, name: str) -> str:
    """A new folder beside the checkpoints."""
    require_checkpoint_folder(df.sparkSession)
    return f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


@check(
    "decoded_rows",
    """SELECT doc_id, coalesce(trim(text, E' \\t\\n\\r'), '') AS text, coalesce(lang, '') AS lang FROM documents""",
)
def decoded_rows(t: Tables) -> DataFrame:
    """Every document through CSV files with quoted line breaks, each file read by its blocks."""
    documents = t("documents").select("doc_id", "text", "lang")
    folder = written(documents, "csv")
    documents.write.options(header=True, quoteAll=True, quote='"', escape='"').csv(folder)
    found = ranges.scan(t.spark, folder).records
    return found.select(
        F.col("rec")["doc_id"].cast("bigint").alias("doc_id"),
        F.col("rec")["text"].alias("text"),
        F.col("rec")["lang"].alias("lang"),
    )


@check(
    "feature_rows",
    """SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) AS row_no,
      p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN (p_size / 2.0::DOUBLE)::VARCHAR END AS lat
    FROM part""",
)
def feature_rows(t: Tables) -> DataFrame:
    """Every part as a GeoJSON feature, 500 a file; points have a place."""
    place = F.when(
        F.col("p_partkey") % 3 == 0,
        F.struct(
            F.lit("Point").alias("type"),
            F.array(F.lit(139.5), F.col("p_size") / F.lit(2.0)).alias("coordinates"),
        ),
    )
    feature = F.struct(
        F.struct(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")).alias("properties"),
        place.alias("geometry"),
    )
    parts = t("part").select((F.floor(F.col("p_partkey") / 500)).alias("file"), "p_partkey", feature.alias("feature"))
    collections = parts.groupBy("file").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("p_partkey", "feature"))), lambda e: e["feature"]
        ).alias("features")
    )
    folder = written(parts, "geojson")
    collections.write.partitionBy("file").option("ignoreNullFields", False).json(folder)
    found = ranges.scan(t.spark, folder).records
    return found.select(
        F.col("rec")["key"].cast("bigint").alias("p_partkey"),
        "row_no",
        F.col("rec")["name"].alias("name"),
        F.col("rec")[fv.GEOJSON_LAT].alias("lat"),
    )
