"""Catalog packages -> dataset candidates with evidence and a verdict.

A package row: id, name, title, notes, organization, license_id, license_title,
metadata_modified, tags array<string>, update_frequency, source_url,
resources array<struct<id, name, format, url, datastore_active, last_modified, metadata_modified>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.functions import signals
from placegauge.functions.staging import with_computed
from placegauge.functions.text import contains_any, hits, words_array


def definition_words(feature: Column, part: str, definitions=fv.FEATURE_DEFINITIONS) -> Column:
    """The word list of the row's feature; exclusions include those of all features."""
    shared = fv.GLOBAL_EXCLUDE_KEYWORDS if part == "exclude_keywords" else ()
    words = F.create_map(
        *[
            v
            for f, d in definitions.items()
            for v in (F.lit(f), words_array(tuple(d.get(part, ())) + tuple(shared)))
        ]
    )
    return F.coalesce(F.element_at(words, feature), words_array(()))


def searched_text(packages: DataFrame) -> Column:
    """Everything of a package a keyword is looked for in."""
    return F.concat_ws(
        "\n", "title", F.transform("resources", lambda r: r["name"]), "notes", "tags"
    )


def candidates(packages: DataFrame, definitions=fv.FEATURE_DEFINITIONS) -> DataFrame:
    """One row per (feature, package id) with a keyword anywhere in the package.

    All keywords of all features are tried in one pass over the packages.  Of several packages with
    one id the first by content stays, the same one whatever the order of the rows.
    """
    # Put together once a package, not once a keyword.
    searched = with_computed(packages, {"__text": searched_text(packages)})
    text = F.col("__text")
    found = F.array_compact(
        F.array(
            *[F.when(contains_any(text, d["keywords"]), F.lit(f)) for f, d in definitions.items()]
        )
    )
    rows = with_computed(searched, {"__features": found}).where(F.size("__features") > 0)
    whole = F.struct(*packages.columns)
    # Packages move once, before they are copied to their features.
    one = rows.groupBy("id").agg(
        F.min_by(F.struct("__features", *packages.columns), F.to_json(whole)).alias("p"),
    )
    return one.select("p.*").withColumn("feature", F.explode("__features")).drop("__features")


def resource_order(resource: Column, keywords, pos: Column) -> Column:
    """Sort key of a resource: names the feature, format, newest, first listed. Null: unusable."""
    score = signals.format_score(resource["format"], resource["datastore_active"])
    affinity = F.when(
        F.size(hits(F.coalesce(resource["name"], F.lit("")), keywords)) > 0, 1
    ).otherwise(0)
    modified = F.coalesce(
        F.nullif(resource["last_modified"], F.lit("")),
        F.nullif(resource["metadata_modified"], F.lit("")),
        F.lit(""),
    )
    usable = score.isNotNull() & (F.coalesce(resource["url"], F.lit("")) != "")
    key = F.struct(
        affinity.alias("affinity"), score.alias("score"), modified.alias("modified"),
        (-pos).alias("order"),
    )
    return F.when(usable, key)


def with_best_resource(rows: DataFrame) -> DataFrame:
    """Adds ``resource`` and ``format_score``, chosen inside the package row (no shuffle)."""
    keywords = definition_words(F.col("feature"), "keywords")
    ranked = F.transform(
        "resources",
        lambda r, i: F.struct(resource_order(r, keywords, i).alias("key"), r.alias("resource")),
    )
    best = F.array_max(F.filter(ranked, lambda x: x["key"].isNotNull()))
    return (
        rows.withColumn("__best", best)
        .withColumns({"resource": F.col("__best.resource"), "format_score": F.col("__best.key.score")})
        .drop("__best")
    )


def best_resource_rows(resources: DataFrame, keys: list[str], keywords) -> DataFrame:
    """The same choice over a long resource table: one max per key, with partial sums."""
    columns = [c for c in resources.columns if c not in keys]
    row = F.struct(*columns)
    keyed = resources.withColumn("__r", row)
    order = resource_order(F.col("__r"), keywords, F.col("pos"))
    return (
        keyed.withColumn("__o", order)
        .where("__o IS NOT NULL")
        .groupBy(*keys)
        .agg(F.max_by(F.struct("__r", "__o"), "__o").alias("b"))
        .select(*keys, F.col("b.__o.score").alias("format_score"), "b.__r.*")
    )


def with_semantics(rows: DataFrame) -> DataFrame:
    """Adds hit lists, ``semantic``, ``semantic_text``, ``excluded_hits`` and ``row_filter``."""
    feature = F.col("feature")
    # Texts and lists are made once a row, not once a keyword or a use.
    texts = {
        "__title": F.coalesce("title", F.lit("")),
        "__names": F.transform("resources", lambda r: F.coalesce(r["name"], F.lit(""))),
        "__other": F.concat_ws(" ", F.coalesce("notes", F.lit("")), "tags"),
    }
    rows = with_computed(rows, texts)
    title, names, other = (F.col(c) for c in texts)
    keywords = definition_words(feature, "keywords")
    lists = signals.semantic_hits(
        title, names, other, keywords, definition_words(feature, "list_hints")
    )
    cols = [F.col(n) for n in lists]
    return with_computed(
        rows,
        {
            **lists,
            "excluded_hits": hits(title, definition_words(feature, "exclude_keywords")),
            "row_filter": signals.names_no_keyword(title, keywords),
        },
    ).drop(*texts).withColumns(
        {
            "semantic": signals.semantic_signal(*cols),
            "semantic_text": signals.semantic_reason(*cols),
        }
    )


def worth_inspecting(rows: DataFrame) -> DataFrame:
    """Candidates whose resource is worth reading: cheap evidence first."""
    return rows.where(
        F.col("resource").isNotNull()
        & (F.col("semantic") >= fv.ACCEPT_MIN_SEMANTIC)
        & (F.size("excluded_hits") == 0)
    )


def evaluate(rows: DataFrame, inspections: DataFrame, now: Column) -> DataFrame:
    """Manifest entries from candidates with resource and semantics.

    ``inspections``: feature, dataset_id, coord_fill, address_fill, has_address — absent when the
    resource was not read, which leaves the location unknown.
    """
    joined = rows.withColumn("dataset_id", F.col("name")).join(
        inspections.select(
            "feature", "dataset_id", "coord_fill", "address_fill", "has_address",
            F.lit(True).alias("inspected"),
        ),
        ["feature", "dataset_id"],
        "left",
    )
    where = (
        F.coalesce("inspected", F.lit(False)),
        F.col("coord_fill"),
        F.col("address_fill"),
        F.coalesce("has_address", F.lit(False)),
    )
    resource = F.col("resource")
    modified = F.coalesce(
        F.nullif(resource["last_modified"], F.lit("")), F.col("metadata_modified")
    )
    signalled = joined.withColumns(
        {
            "location": signals.location_signal(*where),
            "location_source": signals.location_source(*where),
            "license_score": signals.license_signal(F.col("license_id"), F.col("license_title")),
            "modified": modified,
            "freshness": signals.freshness_signal(modified, now),
            "format_score": F.coalesce("format_score", F.lit(0.0)),
            "has_resource": resource.isNotNull(),
        }
    )
    parts = [F.col(c) for c in ("semantic", "format_score", "location", "license_score", "freshness")]
    decided = signalled.withColumn("confidence", signals.confidence(*parts))
    status = signals.verdict(
        F.col("has_resource"),
        F.col("excluded_hits"),
        F.col("semantic"),
        F.col("confidence"),
        F.col("location"),
    )
    active = F.coalesce(resource["datastore_active"], F.lit(False))
    detail = [
        F.concat(
            F.when(active, F.lit("DataStore(API) 対応 ")).otherwise(F.lit("")),
            F.upper(F.coalesce(resource["format"], F.lit(""))),
        ),
        location_text(),
        license_text(),
    ]
    reason = signals.verdict_reason(
        F.col("semantic_text"), F.col("has_resource"), F.col("excluded_hits"), F.col("semantic"),
        detail, F.col("modified"),
    )
    return decided.withColumns({"status": status, "reason": reason}).select(
        "feature",
        "dataset_id",
        F.coalesce(F.nullif("title", F.lit("")), F.col("name")).alias("name"),
        "organization",
        "source_url",
        resource["url"].alias("resource_url"),
        resource["id"].alias("resource_id"),
        F.lower(F.coalesce(resource["format"], F.lit(""))).alias("format"),
        active.alias("datastore_active"),
        "location_source",
        "row_filter",
        "status",
        F.col("status").alias("auto_status"),
        "confidence",
        "reason",
        "semantic",
        "format_score",
        "location",
        "license_score",
        "freshness",
        F.coalesce("license_id", "license_title").alias("license"),
        F.col("modified").alias("last_modified"),
        "update_frequency",
        F.lit(None).cast("string").alias("duplicate_of"),
    )


def _percent(rate: Column) -> Column:
    return F.concat(F.rint(rate * 100).cast("int").cast("string"), F.lit("%"))


def location_text() -> Column:
    """What the inspection found, in words."""
    coords, address = F.col("coord_fill"), F.coalesce("address_fill", F.lit(0.0))
    has_address = F.coalesce("has_address", F.lit(False))
    coord_note = F.when(coords.isNotNull(), F.concat(F.lit("座標充足率 "), _percent(coords)))
    from_source = coords >= fv.ACCEPT_MIN_FILL
    address_note = (
        F.when(F.coalesce(from_source, F.lit(False)), F.lit(None).cast("string"))
        .when(
            has_address & (address >= fv.ACCEPT_MIN_FILL),
            F.concat(
                F.lit("住所充足率 "), _percent(address), F.lit("。住所からジオコーディングする")
            ),
        )
        .when(F.coalesce(coords > 0, F.lit(False)), F.lit(None).cast("string"))
        .when(
            has_address & (address > 0),
            F.concat(F.lit("住所充足率 "), _percent(address), F.lit("（不足）")),
        )
        .when(coords.isNotNull(), F.lit("座標・住所とも値がない"))
        .otherwise(F.lit("座標列・住所列が見つからない"))
    )
    return F.when(
        F.coalesce("inspected", F.lit(False)),
        F.concat_ws(fv.REASON_SEPARATOR, coord_note, address_note),
    ).otherwise(F.lit("位置情報は未検査（取得失敗または非対応形式）"))


def license_text() -> Column:
    known = F.col("license_score") == 1.0
    unknown = F.concat(
        F.lit("ライセンス不明（"), F.coalesce(F.nullif("license_id", F.lit("")), F.lit("未設定")),
        F.lit("）"),
    )
    return F.when(
        known, F.coalesce(F.nullif("license_id", F.lit("")), F.col("license_title"))
    ).otherwise(unknown)
