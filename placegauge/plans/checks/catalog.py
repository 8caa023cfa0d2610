"""Checks of catalog selection, manifests, judgements and evaluation.

Parts are read as catalog packages: titles, notes, tags and files are put together from the key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.operators import catalog, evaluation, judgements, manifest, quality
from placegauge.operators import inspections as kept
from placegauge.plans import jobs
from placegauge.plans.checks.base import (
    CTES,
    Tables,
    check,
    pick,
    sql_list,
    sql_pick,
    sql_round,
    sql_sum,
)
from placegauge.session import checkpoint_folder, cut, require_checkpoint_folder

select = CTES.select

AREAS = ["中央区", "港区", "千代田区"]
SUBJECTS = ["公園", "図書館", "文化財", "観光施設", "公共施設", "統計"]
FORMS = ["一覧", "リスト", "", "写真", "の推移"]
FILE_NAMES = ["公園", "その他", "資料"]
FORMATS = ["csv", "PDF", " GeoJSON ", "xlsx", "zip"]
LICENSE_IDS = ["CC-BY-4.0", "other", None]
LICENSE_TITLES = ["x", "クリエイティブ・コモンズ 表示", "y", None]
NOW = "2026-01-01 00:00:00"
RESOURCE = (
    "array<struct<id string, name string, format string, url string, datastore_active boolean, "
    "last_modified string, metadata_modified string>>"
)


def packages(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    key = k.cast("string")

    def resource(i: Column) -> Column:
        day = F.date_add(F.lit("2015-01-01").cast("date"), ((k * 37 + i * 11) % 4000).cast("int"))
        url = F.concat_ws("/", F.lit("https://example.org"), (k % 500).cast("string"), i.cast("string"))
        return F.struct(
            F.concat_ws("-", key, i.cast("string")).alias("id"),
            F.concat(pick(FILE_NAMES, (k + i) % 3), i.cast("string")).alias("name"),
            pick(FORMATS, (k * 3 + i) % 5).alias("format"),
            F.when((k + i) % 9 != 0, url).alias("url"),
            ((k + i) % 6 == 0).alias("datastore_active"),
            F.when((k + i) % 4 != 0, F.concat(day.cast("string"), F.lit("T00:00:00"))).alias(
                "last_modified"
            ),
            F.lit(None).cast("string").alias("metadata_modified"),
        )

    many = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < k % 4)
    return t("part").select(
        key.alias("id"),
        F.concat(F.lit("pkg-"), key).alias("name"),
        F.concat(pick(AREAS, k % 3), pick(SUBJECTS, k % 6), pick(FORMS, k % 5)).alias("title"),
        F.concat(F.col("p_name"), F.when(k % 4 == 0, F.lit("公園の説明")).otherwise(F.lit(""))).alias(
            "notes"
        ),
        pick(AREAS, k % 3).alias("organization"),
        pick(LICENSE_IDS, k % 3).alias("license_id"),
        pick(LICENSE_TITLES, k % 4).alias("license_title"),
        F.when(k % 7 != 0, F.concat(F.lit("2019-0"), (k % 9 + 1).cast("string"), F.lit("-01"))).alias(
            "metadata_modified"
        ),
        F.array(F.col("p_type"), F.when(k % 7 == 0, F.lit("図書館")).otherwise(F.lit("x"))).alias("tags"),
        F.lit(None).cast("string").alias("update_frequency"),
        F.concat(F.lit("https://example.org/dataset/pkg-"), key).alias("source_url"),
        F.transform(many, resource).cast(RESOURCE).alias("resources"),
    )


CTES.add(
    "package",
    f"""SELECT p_partkey AS k, p_partkey::VARCHAR AS id, 'pkg-' || p_partkey AS name,
      {sql_pick(AREAS, 'p_partkey % 3')} || {sql_pick(SUBJECTS, 'p_partkey % 6')}
        || {sql_pick(FORMS, 'p_partkey % 5')} AS title,
      p_name || CASE WHEN p_partkey % 4 = 0 THEN '公園の説明' ELSE '' END AS notes,
      {sql_pick(AREAS, 'p_partkey % 3')} AS organization,
      {sql_pick(LICENSE_IDS, 'p_partkey % 3')} AS license_id,
      {sql_pick(LICENSE_TITLES, 'p_partkey % 4')} AS license_title,
      CASE WHEN p_partkey % 7 <> 0 THEN '2019-0' || (p_partkey % 9 + 1) || '-01' END
        AS metadata_modified,
      p_type || ' ' || CASE WHEN p_partkey % 7 = 0 THEN '図書館' ELSE 'x' END AS tags
    FROM part""",
)
CTES.add(
    "resource",
    f"""SELECT k, i, k || '-' || i AS rid, {sql_pick(FILE_NAMES, '(k + i) % 3')} || i AS rname,
      {sql_pick(FORMATS, '(k * 3 + i) % 5')} AS format,
      CASE WHEN (k + i) % 9 <> 0 THEN 'https://example.org/' || (k % 500) || '/' || i END AS url,
      (k + i) % 6 = 0 AS active, CASE WHEN (k + i) % 4 <> 0 THEN
        strftime(DATE '2015-01-01' + ((k * 37 + i * 11) % 4000)::INT, '%Y-%m-%d') || 'T00:00:00' END
        AS modified
    FROM package, range(4) r(i) WHERE i < k % 4""",
    ("package",),
)
_WORD_ROWS = ", ".join(
    f"('{f}', {sql_list(d['keywords'])}, {sql_list(d['list_hints'])}, "
    f"{sql_list(tuple(d['exclude_keywords']) + fv.GLOBAL_EXCLUDE_KEYWORDS)})"
    for f, d in fv.FEATURE_DEFINITIONS.items()
)
CTES.add("words", f"SELECT * FROM (VALUES {_WORD_ROWS}) v(feature, keywords, hints, excluded)")
CTES.add(
    "wanted",
    """SELECT * FROM (SELECT p.*, w.*, list_filter(keywords, lambda x: contains(title, x)) AS th,
        list_filter(hints, lambda x: contains(title, x)) AS hh,
        list_filter(keywords, lambda x: contains(coalesce(names, ''), x)) AS rh,
        list_filter(keywords, lambda x: contains(notes || ' ' || tags, x)) AS oh,
        list_filter(excluded, lambda x: contains(title, x)) AS xh
      FROM package p LEFT JOIN (SELECT k, string_agg(rname, '|') AS names FROM resource GROUP BY k)
        USING (k) CROSS JOIN words w) WHERE len(th) + len(rh) + len(oh) > 0""",
    ("package", "resource", "words"),
)


def wanted(t: Tables) -> DataFrame:
    return catalog.with_semantics(catalog.with_best_resource(catalog.candidates(packages(t))))


@check("catalog_candidates", select("SELECT feature, id FROM wanted", "wanted"))
def catalog_candidates(t: Tables) -> DataFrame:
    return catalog.candidates(packages(t)).select("feature", "id")


CTES.add(
    "scored_resource",
    f"""SELECT *, CASE WHEN active THEN 1.0::DOUBLE ELSE CASE upper(trim(format)) {' '.join(
        f"WHEN '{f}' THEN {s}::DOUBLE" for f, s in fv.FORMAT_SCORES.items())} END END AS fscore
    FROM resource""",
    ("resource",),
)
CTES.add(
    "best",
    """SELECT * FROM (SELECT w.feature, r.*, row_number() OVER (PARTITION BY w.feature, r.k
        ORDER BY len(list_filter(w.keywords, lambda x: contains(r.rname, x))) > 0 DESC,
          fscore DESC, coalesce(modified, '') DESC, i) AS rn
      FROM wanted w JOIN scored_resource r USING (k) WHERE fscore IS NOT NULL AND url IS NOT NULL)
    WHERE rn = 1""",
    ("wanted", "scored_resource"),
)


@check(
    "best_resource",
    select("SELECT feature, k::VARCHAR AS id, rid, fscore AS format_score FROM best", "best"),
)
def best_resource(t: Tables) -> DataFrame:
    rows = catalog.with_best_resource(catalog.candidates(packages(t)))
    return rows.where("resource IS NOT NULL").select(
        "feature", "id", F.col("resource.id").alias("rid"), "format_score"
    )


def order_files(t: Tables) -> DataFrame:
    """Line items as the files of an order."""
    return t("lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").alias("pos"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), "l_linenumber").alias("id"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("name"),
        pick(FORMATS, F.col("l_partkey") % 5).alias("format"),
        F.when(F.col("l_tax") > 0, F.concat(F.lit("u"), F.col("l_suppkey").cast("string"))).alias("url"),
        (F.col("l_discount") > 0.08).alias("datastore_active"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("last_modified"),
        F.lit(None).cast("string").alias("metadata_modified"),
    )


@check(
    "best_file_per_order",
    f"""SELECT l_orderkey, l_linenumber AS pos, fscore AS format_score FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'A' DESC,
        fscore DESC, l_shipdate DESC, l_linenumber) AS rn
      FROM (SELECT *, CASE WHEN l_discount > 0.08 THEN 1.0::DOUBLE ELSE CASE
        upper(trim({sql_pick(FORMATS, 'l_partkey % 5')})) {' '.join(
          f"WHEN '{f}' THEN {s}::DOUBLE" for f, s in fv.FORMAT_SCORES.items())} END END AS fscore
        FROM lineitem WHERE l_tax > 0) WHERE fscore IS NOT NULL) WHERE rn = 1""",
)
def best_file_per_order(t: Tables) -> DataFrame:
    best = catalog.best_resource_rows(order_files(t), ["l_orderkey"], ("A",))
    return best.select("l_orderkey", "pos", "format_score")


CTES.add(
    "semantic",
    """SELECT *, CASE WHEN len(th) > 0 AND len(hh) > 0 THEN 1.0::DOUBLE WHEN len(th) > 0
        OR len(rh) > 0 THEN 0.7::DOUBLE WHEN len(oh) > 0 THEN 0.4::DOUBLE ELSE 0::DOUBLE END AS sem
    FROM wanted""",
    ("wanted",),
)


@check(
    "semantic_signal",
    select(
        """SELECT feature, id, sem AS semantic, len(th) = 0 AS row_filter, len(xh) AS excluded,
          CASE WHEN len(th) > 0 AND len(hh) > 0 THEN 'タイトルに「'
              || array_to_string(list_concat(th, hh), '」「') || '」を含む'
            WHEN len(th) > 0 THEN 'タイトルに「' || array_to_string(th, '」「')
              || '」を含む（一覧を示す語なし）'
            WHEN len(rh) > 0 THEN 'リソース名に「' || array_to_string(list_sort(rh), '」「')
              || '」を含む（カテゴリ別ファイル）'
            ELSE '説明・タグのみに「' || array_to_string(oh, '」「') || '」を含む' END AS reason
        FROM semantic""",
        "semantic",
    ),
)
def semantic_signal(t: Tables) -> DataFrame:
    return catalog.with_semantics(catalog.candidates(packages(t))).select(
        "feature", "id", "semantic", "row_filter",
        F.size("excluded_hits").cast("long").alias("excluded"),
        F.col("semantic_text").alias("reason"),
    )


def inspections(rows: DataFrame) -> DataFrame:
    """What inspecting the worthwhile candidates found; some could not be read."""
    k = F.col("id").cast("long")
    has_address = k % 4 != 1
    return catalog.worth_inspecting(rows).where(k % 13 != 0).select(
        "feature",
        F.col("name").alias("dataset_id"),
        F.when(k % 5 != 0, k % 11 / F.lit(10.0)).alias("coord_fill"),
        F.when(has_address, k % 9 / F.lit(8.0)).alias("address_fill"),
        has_address.alias("has_address"),
    )


CTES.add(
    "inspected",
    f"""SELECT s.*, b.rid, b.format, b.url, b.active, b.fscore, b.modified AS rmod,
      s.sem >= 0.7 AND len(s.xh) = 0 AND b.rid IS NOT NULL AND s.k % 13 <> 0 AS seen,
      CASE WHEN s.k % 5 <> 0 THEN (s.k % 11) / 10::DOUBLE END AS coord,
      CASE WHEN s.k % 4 <> 1 THEN (s.k % 9) / 8::DOUBLE ELSE 0 END AS addr,
      coalesce(b.modified, s.metadata_modified) AS changed
    FROM semantic s LEFT JOIN best b ON b.k = s.k AND b.feature = s.feature""",
    ("semantic", "best"),
)
_SIGNALS = [
    "0.35::DOUBLE * sem", "0.15::DOUBLE * coalesce(fscore, 0)",
    "0.3::DOUBLE * coalesce(location, 0.5::DOUBLE)", "0.1::DOUBLE * license_score",
    "0.1::DOUBLE * freshness",
]
CTES.add(
    "decided",
    f"""SELECT *, CASE WHEN rid IS NULL OR len(xh) > 0 OR sem = 0 THEN 'rejected'
        WHEN confidence >= 0.75 AND sem >= 0.7 AND location >= 0.8 THEN 'accepted'
        ELSE 'review' END AS status
    FROM (SELECT *, {sql_round(sql_sum(_SIGNALS), 3)} AS confidence FROM (
      SELECT *, CASE WHEN NOT seen THEN NULL WHEN coord >= 0.8 THEN 1 WHEN addr >= 0.8 THEN 0.8
          WHEN coord > 0 THEN {sql_round('coord / 0.8::DOUBLE', 3)}
          WHEN addr > 0 THEN {sql_round('addr * 0.8::DOUBLE', 3)} ELSE 0 END AS location,
        CASE WHEN NOT seen THEN NULL WHEN coord >= 0.8 THEN 'source' WHEN addr >= 0.8 THEN 'geocode'
          WHEN coord > 0 THEN 'source' WHEN addr > 0 THEN 'geocode' END AS location_source,
        CASE WHEN lower(license_id) IN ('cc-by-4.0') OR contains(license_title, '表示') THEN 1
          ELSE 0.5 END::DOUBLE AS license_score,
        CASE WHEN changed IS NULL THEN 0.3 WHEN years <= 2 THEN 1 WHEN years <= 5 THEN 0.6
          ELSE 0.3 END::DOUBLE AS freshness
      FROM (SELECT *, date_diff('day', changed::TIMESTAMP, TIMESTAMP '{NOW}') / 365.25::DOUBLE
        AS years FROM inspected)))""",
    ("inspected",),
)


def entries(t: Tables) -> DataFrame:
    rows = cut(wanted(t))
    return catalog.evaluate(rows, inspections(rows), F.lit(NOW).cast("timestamp"))


@check(
    "dataset_evaluation",
    select(
        """SELECT feature, name AS dataset_id, sem AS semantic, coalesce(fscore, 0) AS format_score,
          location, location_source, license_score, freshness, confidence, status,
          len(th) = 0 AS row_filter, url AS resource_url FROM decided""",
        "decided",
    ),
)
def dataset_evaluation(t: Tables) -> DataFrame:
    return entries(t).select(
        "feature", "dataset_id", "semantic", "format_score", "location", "location_source",
        "license_score", "freshness", "confidence", "status", "row_filter", "resource_url",
    )


@check(
    "verdict_reasons",
    select(
        """SELECT feature, name AS dataset_id, concat_ws('。',
          CASE WHEN len(th) > 0 AND len(hh) > 0 THEN 'タイトルに「'
              || array_to_string(list_concat(th, hh), '」「') || '」を含む'
            WHEN len(th) > 0 THEN 'タイトルに「' || array_to_string(th, '」「')
              || '」を含む（一覧を示す語なし）'
            WHEN len(rh) > 0 THEN 'リソース名に「' || array_to_string(list_sort(rh), '」「')
              || '」を含む（カテゴリ別ファイル）'
            ELSE '説明・タグのみに「' || array_to_string(oh, '」「') || '」を含む' END,
          CASE WHEN rid IS NULL THEN '機械可読なリソースがない（PDF・画像等のみ）' WHEN len(xh) > 0
            THEN '除外語「' || array_to_string(xh, '」「') || '」を含む' ELSE
            concat_ws('。', CASE WHEN active THEN 'DataStore(API) 対応 ' ELSE '' END || upper(format),
              CASE WHEN NOT seen THEN '位置情報は未検査（取得失敗または非対応形式）' ELSE concat_ws('。',
                '座標充足率 ' || round_even(coord * 100, 0)::INT || '%',
                CASE WHEN coord >= 0.8 THEN NULL
                  WHEN addr >= 0.8 THEN '住所充足率 ' || round_even(addr * 100, 0)::INT
                    || '%。住所からジオコーディングする'
                  WHEN coord > 0 THEN NULL
                  WHEN addr > 0 THEN '住所充足率 ' || round_even(addr * 100, 0)::INT || '%（不足）'
                  WHEN coord IS NOT NULL THEN '座標・住所とも値がない'
                  ELSE '座標列・住所列が見つからない' END) END,
              CASE WHEN license_score = 1 THEN coalesce(license_id, license_title)
                ELSE 'ライセンス不明（' || coalesce(license_id, '未設定') || '）' END) END,
          '更新 ' || changed[1:10]) AS reason
        FROM decided""",
        "decided",
    ),
)
def verdict_reasons(t: Tables) -> DataFrame:
    return entries(t).select("feature", "dataset_id", "reason")


def answers(rows: DataFrame) -> DataFrame:
    k = F.regexp_extract("dataset_id", "([0-9]+)$", 1).cast("long")
    return rows.where(k % 10 != 0).select(
        "feature",
        "dataset_id",
        F.when(k % 4 == 0, F.lit("mixed")).when(k % 4 == 1, F.lit("none")).otherwise(
            F.col("feature")).alias("category"),
        (k % 8 / F.lit(8.0)).alias("confidence"),
        (k % 7 / F.lit(7.0)).alias("list_score"),
    )


CTES.add(
    "judged",
    """SELECT *, CASE WHEN status <> 'review' OR k % 10 = 0 THEN status
        WHEN sure >= 0.7 AND k % 4 <> 1 AND listed >= 0.45
          THEN CASE WHEN coalesce(location, 0) >= 0.8 THEN 'accepted' ELSE 'review' END
        WHEN sure >= 0.7 AND (k % 4 = 1 OR listed < 0.3) THEN 'rejected' ELSE 'review' END AS verdict,
      len(th) = 0 OR (status = 'review' AND k % 10 <> 0 AND sure >= 0.7 AND k % 4 = 0
        AND listed >= 0.45) AS mixed
    FROM (SELECT *, (k % 8) / 8::DOUBLE AS sure, (k % 7) / 7::DOUBLE AS listed FROM decided)""",
    ("decided",),
)


@check(
    "classifier_verdicts",
    select(
        "SELECT feature, name AS dataset_id, verdict AS status, mixed AS row_filter FROM judged",
        "judged",
    ),
)
def classifier_verdicts(t: Tables) -> DataFrame:
    rows = cut(entries(t))
    decided = judgements.apply_dataset_judgements(rows, answers(rows))
    return decided.select("feature", "dataset_id", "status", "row_filter")


@check(
    "classifier_notes",
    select(
        f"""SELECT feature, name AS dataset_id, asked AS kept,
          CASE WHEN asked AND k % 6 <> 5 THEN CASE k % 4 WHEN 0 THEN 'mixed' WHEN 1 THEN 'none' ELSE feature END END
            AS category,
          CASE WHEN NOT asked THEN '' WHEN k % 6 = 5 THEN '。model 失敗: timeout' ELSE '。model: '
            || CASE k % 4 WHEN 0 THEN 'mixed' WHEN 1 THEN 'none' ELSE feature END
            || '（確信度 ' || printf('%.2f', sure) || '、一覧 ' || printf('%.2f', listed) || '）'
            || CASE verdict WHEN 'accepted' THEN ' → 採用' WHEN 'rejected' THEN ' → 不採用' ELSE
              CASE WHEN sure >= 0.7 AND k % 4 <> 1 AND listed >= 0.45 THEN '{fv.NOTE_NO_PLACE}'
                ELSE '{fv.NOTE_UNSURE}' END END END AS note
        FROM (SELECT *, status = 'review' AND k % 10 <> 0 AS asked FROM judged)""",
        "judged",
    ),
)
def classifier_notes(t: Tables) -> DataFrame:
    """What reasons say of the classifier's answers, some of which failed."""
    rows = cut(entries(t))
    k = F.regexp_extract("dataset_id", "([0-9]+)$", 1).cast("long")
    failed = k % 6 == 5
    given = answers(rows).select(
        "feature", "dataset_id", F.when(~failed, F.col("category")).alias("category"), "confidence", "list_score",
        F.lit("model").alias("classifier"), F.when(failed, F.lit("timeout")).alias("error"),
    )
    told = judgements.apply_dataset_judgements(rows, given)
    before = rows.select("feature", "dataset_id", F.length("reason").alias("n"))
    return told.join(before, ["feature", "dataset_id"]).select(
        "feature", "dataset_id", F.col("semantic").isNotNull().alias("kept"), "semantic.category",
        F.col("reason").substr(F.col("n") + 1, F.length("reason")).alias("note"),
    )


CTES.add(
    "deduped",
    """SELECT *, CASE WHEN status = 'rejected' THEN NULL WHEN by_title <> name THEN by_title
        WHEN by_url <> name THEN by_url END AS duplicate_of
    FROM (SELECT *, first_value(name) OVER (PARTITION BY feature, organization, title
          ORDER BY confidence DESC, name) AS by_title,
        CASE WHEN url IS NOT NULL THEN first_value(name) OVER (PARTITION BY feature, url
          ORDER BY confidence DESC, name) END AS by_url FROM decided)""",
    ("decided",),
)


@check(
    "catalog_duplicates",
    select(
        """SELECT feature, name AS dataset_id, duplicate_of, CASE WHEN duplicate_of IS NOT NULL
          AND status = 'accepted' THEN 'review' ELSE status END AS status,
          duplicate_of IS NOT NULL AND status = 'accepted' AS noted FROM deduped""",
        "deduped",
    ),
)
def catalog_duplicates(t: Tables) -> DataFrame:
    noted = F.col("reason").endswith("と重複の可能性")
    return manifest.mark_duplicates(cut(entries(t))).select(
        "feature", "dataset_id", "duplicate_of", "status", noted.alias("noted")
    )


# --- documents as manifest entries, their labels as human decisions --------------------------------

def document_entries(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    status = pick(list(fv.STATUSES), k % 3)
    return t("documents").select(
        F.col("lang").alias("feature"),
        F.concat(F.lit("doc-"), k.cast("string")).alias("dataset_id"),
        F.col("text").alias("name"),
        F.col("source").alias("organization"),
        F.when(k % 6 != 0, F.concat(F.lit("https://example.org/"), F.sha2("text", 256))).alias(
            "resource_url"
        ),
        F.lit("https://example.org/d").alias("source_url"),
        status.alias("status"),
        status.alias("auto_status"),
        F.when(k % 50 != 0, F.lit("r")).otherwise(F.lit("")).alias("reason"),
        (k % 17 / F.lit(16.0)).alias("confidence"),
    )


CTES.add(
    "doc",
    """SELECT doc_id AS k, lang AS feature, 'doc-' || doc_id AS dataset_id, text AS name,
      source AS organization, CASE WHEN doc_id % 6 <> 0 THEN 'https://example.org/' || sha256(text)
        END AS resource_url,
      ['accepted', 'review', 'rejected'][1 + doc_id % 3] AS status,
      CASE WHEN doc_id % 50 <> 0 THEN 'r' ELSE '' END AS reason, (doc_id % 17) / 16::DOUBLE AS confidence
    FROM documents""",
)


@check(
    "document_duplicates",
    select(
        """SELECT feature, dataset_id, CASE WHEN status = 'rejected' THEN NULL
          WHEN by_title <> dataset_id THEN by_title WHEN by_url <> dataset_id THEN by_url END
          AS duplicate_of
        FROM (SELECT *, first_value(dataset_id) OVER (PARTITION BY feature, organization,
            regexp_replace(name, '[\\s　]+', '', 'g') ORDER BY confidence DESC, dataset_id)
            AS by_title,
          CASE WHEN resource_url IS NOT NULL THEN first_value(dataset_id) OVER (
            PARTITION BY feature, resource_url ORDER BY confidence DESC, dataset_id) END AS by_url
          FROM doc)""",
        "doc",
    ),
)
def document_duplicates(t: Tables) -> DataFrame:
    """Whole texts as titles and their digests as URLs: copies meet under both keys."""
    marked = manifest.mark_duplicates(document_entries(t))
    return marked.select("feature", "dataset_id", "duplicate_of")


def overrides(t: Tables) -> DataFrame:
    """Labels as decisions: for one feature or for all, a few with an unknown status."""
    k = F.col("doc_id")
    status = F.when(F.col("toxic") == 1, F.lit("rejected")).when(
        F.col("quality") == 1, F.lit("accepted")).otherwise(F.lit("unsure"))
    known = t("documents").select("doc_id", "lang")
    return (
        t("labels")
        .join(known, "doc_id")
        .withColumn("feature", F.explode(F.when(k % 3 == 0, F.array("lang", F.lit(None)))
                                         .when(k % 3 == 1, F.array(F.lit(None).cast("string")))
                                         .otherwise(F.array("lang"))))
        .select(
            "feature",
            F.concat(F.lit("doc-"), k.cast("string")).alias("dataset_id"),
            F.when(F.col("feature").isNull() & (k % 3 == 0), F.lit("review")).otherwise(status).alias(
                "status"
            ),
            F.when(k % 2 == 0, F.concat(F.lit("n"), k.cast("string"))).alias("note"),
        )
    )


CTES.add(
    "decision",
    """SELECT 'doc-' || doc_id AS dataset_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1
      THEN 'accepted' ELSE 'unsure' END AS status,
      CASE WHEN doc_id % 2 = 0 THEN 'n' || doc_id ELSE '' END AS note FROM labels
      WHERE doc_id IN (SELECT doc_id FROM documents)""",
)
CTES.add(
    "overridden",
    """SELECT d.* EXCLUDE (status), coalesce(o.status, d.status) AS status, d.status AS auto_status,
      o.note FROM doc d LEFT JOIN (SELECT * FROM decision WHERE status <> 'unsure') o
      USING (dataset_id)""",
    ("doc", "decision"),
)


def overridden(t: Tables) -> DataFrame:
    every = overrides(t)
    bad = manifest.invalid_overrides(every).select("dataset_id").distinct()
    return manifest.apply_overrides(
        document_entries(t), every.join(bad, "dataset_id", "left_anti")
    )


@check(
    "manual_overrides",
    select(
        "SELECT feature, dataset_id, status, auto_status, note FROM overridden", "overridden"
    ),
)
def manual_overrides(t: Tables) -> DataFrame:
    return overridden(t).select(
        "feature", "dataset_id", "status", "auto_status", F.col("review.note").alias("note")
    )


@check(
    "invalid_overrides",
    """SELECT 'doc-' || doc_id AS dataset_id, 'unsure' AS status FROM labels
      WHERE toxic = 0 AND quality = 0 AND doc_id IN (SELECT doc_id FROM documents)""",
)
def invalid_overrides(t: Tables) -> DataFrame:
    return manifest.invalid_overrides(overrides(t)).select("dataset_id", "status")


@check(
    "status_counts",
    select(
        """SELECT feature, count(*) AS candidates, count(*) FILTER (status = 'accepted') AS accepted,
          count(*) FILTER (status = 'review') AS review,
          count(*) FILTER (status = 'rejected') AS rejected FROM overridden GROUP BY 1""",
        "overridden",
    ),
)
def status_counts(t: Tables) -> DataFrame:
    return manifest.status_counts(overridden(t))


SEARCHED = [*fv.FEATURE_DEFINITIONS, "neverListed"]


@check(
    "feature_totals",
    select(
        f"""SELECT f.feature, coalesce(candidates, 0) AS candidates, coalesce(accepted, 0) AS accepted,
          coalesce(review, 0) AS review, coalesce(rejected, 0) AS rejected,
          coalesce(inspected, 0) AS inspected
        FROM (SELECT unnest({sql_list(SEARCHED)}) AS feature) f LEFT JOIN (
          SELECT feature, count(*) AS candidates, count(*) FILTER (status = 'accepted') AS accepted,
            count(*) FILTER (status = 'review') AS review,
            count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (seen) AS inspected
          FROM decided GROUP BY 1) d USING (feature)""",
        "decided",
    ),
)
def feature_totals(t: Tables) -> DataFrame:
    """Entries with their inspections, counted for each feature, also one that nothing was found for."""
    rows = cut(wanted(t))
    found = inspections(rows)
    decided = cut(catalog.evaluate(rows, found, F.lit(NOW).cast("timestamp")))
    return manifest.feature_totals(kept.attach(decided, found), SEARCHED)


@check(
    "manifest_update",
    select(
        """SELECT feature, dataset_id, status FROM doc WHERE feature NOT IN ('en', 'de') UNION ALL
        SELECT 'en', 'new-' || l_orderkey || '-' || l_linenumber, 'accepted' FROM lineitem""",
        "doc",
    ),
)
def manifest_update(t: Tables) -> DataFrame:
    """Two languages searched: one gets entries made of line items, one has no hit any more."""
    fresh = t("lineitem").select(
        F.lit("en").alias("feature"),
        F.concat_ws("-", F.lit("new"), F.col("l_orderkey").cast("string"), "l_linenumber").alias(
            "dataset_id"
        ),
        F.lit("accepted").alias("status"),
    )
    existing = document_entries(t).select("feature", "dataset_id", "status", "reason")
    return manifest.replace_features(existing, fresh, ["en", "de"]).select("feature", "dataset_id", "status")


@check(
    "manifest_violations",
    select(
        """SELECT 'missing reason' AS rule, feature || '/' || dataset_id AS key FROM doc
          WHERE reason = '' UNION ALL
        SELECT 'accepted without resource', feature || '/' || dataset_id FROM doc
          WHERE status = 'accepted' AND resource_url IS NULL""",
        "doc",
    ),
)
def manifest_violations(t: Tables) -> DataFrame:
    return quality.manifest_violations(document_entries(t))


# --- judgement store and evaluation ----------------------------------------------------------------

def questions(t: Tables) -> DataFrame:
    """Every conversation turn is asked about its text; equal texts are one question."""
    asked = F.concat(F.lit('["'), F.col("role"), F.lit('"]'))
    return t("conversations").select(
        "conv_id", "turn", judgements.judgement_key(F.col("text"), asked).alias("key")
    )


CTES.add(
    "question",
    """SELECT conv_id, turn, sha256('{"questions": ["' || role || '"], "state": '
      || to_json(text)::VARCHAR || '}') AS key FROM conversations""",
)


@check("judgement_keys", select("SELECT * FROM question", "question"))
def judgement_keys(t: Tables) -> DataFrame:
    return questions(t)


@check(
    "judgement_store",
    select(
        """SELECT key, min(conv_id) % 2 = 0 AS stored FROM question GROUP BY key""", "question"
    ),
)
def judgement_store(t: Tables) -> DataFrame:
    """Half of the answers are stored; the open ones are answered and added."""
    asked = cut(questions(t))
    firsts = asked.groupBy("key").agg(F.min("conv_id").alias("first"))
    store = firsts.where("first % 2 = 0").select("key", F.lit(True).alias("stored"))
    _, misses = judgements.split_by_store(asked, store)
    fresh = misses.select("key", F.lit(False).alias("stored"))
    return judgements.add_to_store(store, fresh)


def labelled(t: Tables) -> DataFrame:
    """Labels as truth, and three ways to guess them from the document."""
    k = F.col("doc_id")
    docs = t("documents").select("doc_id", "n_chars", "lang")
    return t("labels").join(docs, "doc_id").select(
        k.alias("item_id"),
        F.when(F.col("quality") == 1, F.lit("good")).otherwise(F.lit("bad")).alias("label"),
        (k % 10 == 0).alias("ambiguous"),
        F.when(F.col("n_chars") > 300, F.lit("good")).otherwise(F.lit("bad")).alias("rule"),
        F.when(k % 4 != 0, F.lit("good")).otherwise(F.lit("bad")).alias("model"),
        (k % 101 / F.lit(100.0)).alias("sure"),
        F.when(k % 3 != 0, F.col("toxic") == 1).alias("truth"),
    )


CTES.add(
    "labelled",
    """SELECT doc_id AS item_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label,
      doc_id % 10 = 0 AS ambiguous, CASE WHEN n_chars > 300 THEN 'good' ELSE 'bad' END AS rule,
      CASE WHEN doc_id % 4 <> 0 THEN 'good' ELSE 'bad' END AS model,
      (doc_id % 101) / 100::DOUBLE AS sure, CASE WHEN doc_id % 3 <> 0 THEN toxic = 1 END AS truth
    FROM labels JOIN documents USING (doc_id)""",
)


@check(
    "predictor_accuracy",
    select(
        f"""SELECT p AS predictor, count(*) AS scored, {sql_round(
          "count(*) FILTER (CASE p WHEN 'rule' THEN rule ELSE model END = label) / count(*)", 3)}
          AS accuracy
        FROM labelled, (SELECT unnest(['rule', 'model']) AS p) WHERE NOT ambiguous GROUP BY p""",
        "labelled",
    ),
)
def predictor_accuracy(t: Tables) -> DataFrame:
    return judgements.accuracy(labelled(t), ["rule", "model"])


@check(
    "confidence_gates",
    select(
        f"""SELECT gate, {sql_round('count(*) FILTER (sure >= gate) / count(*)', 3)} AS coverage,
          {sql_round('''count(*) FILTER (sure >= gate AND model = label)
            / greatest(count(*) FILTER (sure >= gate), 1)''', 3)} AS accuracy
        FROM labelled, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS gate)
        WHERE NOT ambiguous GROUP BY gate""",
        "labelled",
    ),
)
def confidence_gates(t: Tables) -> DataFrame:
    return judgements.confidence_gates(labelled(t), "model", "sure")


@check(
    "threshold_accuracy",
    select(
        f"""SELECT count(*) AS scored, {sql_round(
          'count(*) FILTER ((sure >= 0.5) = truth) / count(*)', 3)} AS accuracy
        FROM labelled WHERE NOT ambiguous AND truth IS NOT NULL""",
        "labelled",
    ),
)
def threshold_accuracy(t: Tables) -> DataFrame:
    return judgements.threshold_accuracy(labelled(t), "sure", "truth")


@check(
    "confusion",
    select(
        """SELECT label, model AS answer, count(*) AS n FROM labelled
        WHERE NOT ambiguous AND model <> label GROUP BY ALL""",
        "labelled",
    ),
)
def confusion(t: Tables) -> DataFrame:
    return judgements.confusion(labelled(t), "model")


@check(
    "disagreements",
    select(
        """SELECT item_id, CASE WHEN rule = label THEN 'rule' ELSE 'model' END AS "right" FROM labelled
        WHERE NOT ambiguous AND (rule = label) <> (model = label)""",
        "labelled",
    ),
)
def disagreements(t: Tables) -> DataFrame:
    return judgements.disagreements(labelled(t), "rule", "model")


@check(
    "answer_stability",
    f"""SELECT count(*) AS items, {sql_round('count(*) FILTER (n = 1) / count(*)', 3)} AS stable_rate
    FROM (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id)""",
)
def answer_stability(t: Tables) -> DataFrame:
    """Event types as the answers of repeated questions about a user."""
    repeated = t("events").select(
        F.col("user_id").alias("item_id"), F.col("event_type").alias("answer")
    )
    return judgements.stability(repeated)


@check(
    "call_costs",
    f"""SELECT count(*) AS calls, sum(user_id)::BIGINT AS tokens,
      {sql_round('sum(user_id)::DOUBLE / 1e6::DOUBLE * 0.042::DOUBLE', 4)} AS cost,
      {sql_round('list_sort(list(value))[1 + count(*) // 2]', 3)} AS p50
    FROM events""",
)
def call_costs(t: Tables) -> DataFrame:
    calls = t("events").select(F.col("user_id").alias("tokens"), F.col("value").alias("latency"))
    return judgements.call_costs(calls, 0.042)


# --- the evaluation as one run ---------------------------------------------------------------

EVAL_NAMES = ["中央公園", "中央図書館", "物置", "郷土資料館"]
EVAL_TRUTHS = ["park", "library", "none", "culture"]
EVAL_QUESTIONS = {
    kind: {language: f'{{"category": "{kind} {language}"}}' for language in ("ja", "en")}
    for kind in ("facility", "dataset")
}

CTES.add(
    "eval_item",
    f"""SELECT doc_id AS k, CASE WHEN doc_id % 3 = 0 THEN 'dataset' ELSE 'facility' END AS kind,
      {sql_pick(EVAL_TRUTHS, 'doc_id % 4')} AS truth,
      CASE WHEN quality = 1 THEN {sql_pick(EVAL_TRUTHS, 'doc_id % 4')} ELSE 'none' END AS label,
      doc_id % 10 = 0 AS ambiguous, CASE WHEN doc_id % 7 <> 0 THEN toxic = 1 END AS destination,
      CASE WHEN doc_id % 3 = 0 THEN {sql_pick(EVAL_TRUTHS, '(doc_id // 3) % 4')}
        ELSE {sql_pick(EVAL_TRUTHS, 'doc_id % 4')} END AS rule
    FROM labels""",
)
CTES.add(
    "eval_row",
    """SELECT *, CASE WHEN k % 23 <> 0 THEN CASE WHEN k * 7 % 11 = 0 THEN 'none' ELSE truth END END AS model,
      CASE WHEN k % 23 <> 0 THEN truth = 'none' OR NOT (k * 7 % 11 = 0 OR (k * 7 + 1) % 11 = 0
        OR (k * 7 + 2) % 11 = 0) END AS stable,
      CASE WHEN k % 23 <> 0 THEN CASE WHEN k % 4 = 1 THEN 'none' ELSE truth END END AS other,
      (k % 101) / 100::DOUBLE AS sure, (k % 97) / 96::DOUBLE AS score,
      NOT ambiguous AND k % 23 <> 0 AS scored FROM eval_item""",
    ("eval_item",),
)


def evaluation_run(t: Tables) -> jobs.Evaluation:
    """Labels as two sets of JSON lines, answered three times in one language and once in another."""
    k = F.col("doc_id")
    truth = pick(EVAL_TRUTHS, k % 4)
    rows = t("labels").select(
        k.alias("k"),
        F.concat(pick(EVAL_NAMES, k % 4), k.cast("string")).alias("name"),
        F.lit("").alias("categories"), F.lit("一覧").alias("source"), F.lit("区").alias("organization"),
        F.array(F.lit("名称"), F.lit("住所")).alias("columns"),
        F.when(k % 3 == 0, pick(EVAL_TRUTHS, F.floor(k / 3) % 4)).alias("rule"),
        F.when(F.col("quality") == 1, truth).otherwise(F.lit("none")).alias("label"),
        F.when(k % 10 == 0, F.lit(True)).alias("ambiguous"),
        F.when(k % 7 != 0, F.col("toxic") == 1).alias("destination"),
        truth.alias("truth"),
    )
    require_checkpoint_folder(t.spark)
    folder = f"{checkpoint_folder(t.spark)}/labelled-{uuid.uuid4().hex}"
    paths, stored = {}, []
    for kind, own in (("facility", rows.where("k % 3 <> 0")), ("dataset", rows.where("k % 3 = 0"))):
        paths[kind] = f"{folder}/{kind}"
        own.drop("k", "truth").write.json(paths[kind])
        state = evaluation.item_state(F.lit(kind))
        asks = F.explode(F.array(*[
            F.struct(F.lit(r).alias("repeat"), F.lit(language).alias("language"),
                     F.lit(EVAL_QUESTIONS[kind][language]).alias("question"))
            for r, language in ((0, "ja"), (1, "ja"), (2, "ja"), (0, "en"))
        ]))
        n = F.col("k")
        ja = F.when((n * 7 + F.col("q.repeat")) % 11 == 0, F.lit("none")).otherwise(F.col("truth"))
        en = F.when(n % 4 == 1, F.lit("none")).otherwise(F.col("truth"))
        stored.append(own.where("k % 23 <> 0").withColumn("q", asks).select(
            judgements.judgement_key(state, F.col("q.question")).alias("key"),
            F.col("q.repeat").alias("repeat"),
            F.when(F.col("q.language") == "ja", ja).otherwise(en).alias("category"),
            (n % 101 / F.lit(100.0)).alias("confidence"), (n % 97 / F.lit(96.0)).alias("list_score"),
            (n % 50 + 100).alias("tokens"), (n % 13 / F.lit(10.0)).alias("latency"),
        ))
    return jobs.evaluate_classifier(t.spark, paths, EVAL_QUESTIONS, stored[0].unionByName(stored[1]), 0.042)


def _share_sql(part: str, whole: str) -> str:
    return sql_round(f"count(*) FILTER ({part})::DOUBLE / greatest(count(*) FILTER ({whole}), 1)::DOUBLE", 3)


EVAL_METRICS = [
    ("items", "", "count(*)"), ("scored", "", "count(*) FILTER (scored)"), ("open", "", "count(*) FILTER (k % 23 = 0)"),
    *[("accuracy", name, _share_sql(f"scored AND {c} = label", "scored"))
      for name, c in (("rule", "rule"), ("model", "model"), ("model_other", "other"))],
    ("stable_rate", "model", _share_sql("stable", "k % 23 <> 0")),
    ("destination_accuracy", "model",
     _share_sql("scored AND (score >= 0.5) = destination", "scored AND destination IS NOT NULL")),
    ("fixed", "model", "count(*) FILTER (scored AND model = label AND rule <> label)"),
    ("broken", "model", "count(*) FILTER (scored AND model <> label AND rule = label)"),
    *[(metric, str(g), _share_sql(f"scored AND sure >= {g} {more}", whole.format(g=g)))
      for g in judgements.GATES
      for metric, more, whole in (("coverage", "", "scored"),
                                  ("gate_accuracy", "AND model = label", "scored AND sure >= {g}"))],
]


@check(
    "classifier_evaluation",
    select(
        " UNION ALL ".join(
            f"SELECT kind, '{metric}' AS metric, '{name}' AS name, ({value})::DOUBLE AS value FROM eval_row GROUP BY kind"
            for metric, name, value in EVAL_METRICS
        ),
        "eval_row",
    ),
)
def classifier_evaluation(t: Tables) -> DataFrame:
    """The whole run over every label: JSON lines, rules, stored answers with repeats, all metrics."""
    return evaluation_run(t).metrics


@check(
    "evaluation_differences",
    select(
        f"""SELECT kind, {sql_pick(EVAL_NAMES, 'k % 4')} || k AS name, label, rule, model,
          CASE WHEN rule = label THEN 'rule' ELSE 'model' END AS "right"
        FROM eval_row WHERE scored AND (rule = label) <> (model = label)""",
        "eval_row",
    ),
)
def evaluation_differences(t: Tables) -> DataFrame:
    return evaluation_run(t).differences
