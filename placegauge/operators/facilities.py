"""Records of differently shaped datasets -> facilities, and which of them count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.functions.staging import with_computed
from placegauge.functions.text import (
    any_contains_any,
    below_of_normal,
    canonical_of_normal,
    complete_address,
    contains_any,
    names_place_kind,
    normal_address,
    outside_region,
    precision_of,
    strip,
)
from placegauge.operators.judgements import SEMANTIC, semantic
from placegauge.operators.roles import number, valid_coordinates
from placegauge.operators.skew import split_join
from placegauge.session import cut


def normalise(
    records: DataFrame, roles: DataFrame, entries: DataFrame, hot_rows: int | None = None
) -> DataFrame:
    """Facilities of all datasets that have a name column.

    ``entries``: feature, dataset_id, organization, source_url, resource_url, row_filter.
    """
    role = {r: F.element_at("rec", F.col(f"{r}_field")) for r in ("name", "lat", "lng", "address")}
    categories = F.filter(
        F.transform("category_fields", lambda f: F.element_at("rec", f)),
        lambda v: F.coalesce(v != "", F.lit(False)),
    )
    described = entries.join(roles.where("name_field IS NOT NULL"), "dataset_id")
    rows = split_join(records, described, ["dataset_id"], F.col("row_no"), "inner", hot_rows)
    read = rows.select(
        F.concat_ws(":", "dataset_id", F.col("row_no").cast("string")).alias("facility_id"),
        "feature",
        "dataset_id",
        "organization",
        "source_url",
        "resource_url",
        "row_filter",
        strip(role["name"]).alias("name"),
        F.nullif(strip(role["address"]), F.lit("")).alias("address"),
        number(role["lat"]).alias("lat"),
        number(role["lng"]).alias("lng"),
        categories.alias("categories"),
    )
    located = valid_coordinates(F.col("lat"), F.col("lng"))
    return read.where("name IS NOT NULL AND name <> ''").withColumns(
        {
            "coord_source": F.when(located, F.lit("source")),
            "lat": F.when(located, F.col("lat")),
            "lng": F.when(located, F.col("lng")),
        }
    )


def unreadable(
    entries: DataFrame, roles: DataFrame, file_errors: DataFrame | None = None
) -> DataFrame:
    """Accepted entries that fail: format not readable, file not readable, or no name column."""
    bad_format = ~F.lower(F.coalesce("format", F.lit(""))).isin(*fv.READABLE_FORMATS)
    checked = entries.join(roles.select("dataset_id", "name_field"), "dataset_id", "left")
    error = F.when(
        bad_format, F.concat(F.lit("unsupported format: "), F.coalesce("format", F.lit("None")))
    )
    if file_errors is not None:
        own = file_errors.select("dataset_id", F.col("error").alias("__file"))
        checked = checked.join(own, "dataset_id", "left")
        error = F.coalesce(error, F.col("__file"))
    error = F.coalesce(
        error, F.when(F.col("name_field").isNull(), F.lit("name column not found"))
    )
    failed = checked.withColumn("error", error).where("error IS NOT NULL")
    return failed.drop("name_field", "__file")


def hard_excluded(name: Column, categories: Column, definition: dict) -> Column:
    """Explicitly not this feature: kind of place, marker in the name, category word."""
    return (
        names_place_kind(name, definition.get("exclude_names", ()))
        | contains_any(name, definition.get("exclude_markers", ()))
        | any_contains_any(categories, definition.get("exclude_categories", ()))
    )


def rule_match(name: Column, categories: Column, row_filter: Column, definition: dict) -> Column:
    """The name filter of the feature, and for mixed lists a keyword in name or categories."""
    include = definition.get("include_names", ())
    named = contains_any(name, include) if include else F.lit(True)
    text = F.concat_ws(" ", name, categories)
    about = contains_any(text, tuple(definition["keywords"]) + tuple(include))
    return named & (~F.coalesce(row_filter, F.lit(False)) | about)


def mark_excluded(facilities: DataFrame, definitions=fv.FEATURE_DEFINITIONS) -> DataFrame:
    """Adds ``hard`` (hit by a hard rule) and ``ruled`` (kept by the rule filters)."""
    name, categories, mixed = F.col("name"), F.col("categories"), F.col("row_filter")
    hard, ruled = F.lit(False), F.lit(True)
    for feature, definition in definitions.items():
        here = F.col("feature") == feature
        hard = F.when(here, hard_excluded(name, categories, definition)).otherwise(hard)
        ruled = F.when(here, rule_match(name, categories, mixed, definition)).otherwise(ruled)
    return facilities.withColumns({"hard": hard, "ruled": ruled})


def select_rows(
    marked: DataFrame,
    judgements: DataFrame | None = None,
    min_confidence: float = fv.FACILITY_MIN_CONFIDENCE,
) -> DataFrame:
    """Rows that count, with ``classified_by`` and, where a judgement decided, it as ``semantic``.

    Hard rules come first.  In mixed datasets the judgement decides, provided every remaining row
    of the dataset was judged; otherwise, and in all other datasets, the rules do.

    ``judgements``: facility_id, category, confidence.
    """
    left = marked.where(~F.col("hard"))
    if judgements is None:
        return (
            left.where("ruled")
            .withColumns({"classified_by": F.lit("rule"), "semantic": F.lit(None).cast(SEMANTIC)})
            .drop("hard", "ruled")
        )
    plain = left.where(~F.coalesce("row_filter", F.lit(False)))
    mixed = left.where(F.coalesce("row_filter", F.lit(False)))
    judged = mixed.join(
        judgements.select(
            "facility_id", F.col("category").alias("judged"), F.col("confidence").alias("sure"),
            semantic(judgements).alias("semantic"),
        ),
        "facility_id",
        "left",
    )
    complete = judged.groupBy("feature", "dataset_id").agg(
        F.bool_and(F.col("judged").isNotNull()).alias("all_judged")
    )
    fits = F.coalesce(
        (F.col("judged") == F.col("feature")) & (F.col("sure") >= min_confidence), F.lit(False)
    )
    decided = (
        split_join(judged, complete, ["feature", "dataset_id"], F.col("facility_id"))
        .where(F.when(F.col("all_judged"), fits).otherwise(F.col("ruled")))
        .withColumns({
            "classified_by": F.when(F.col("all_judged"), F.lit("judgement")).otherwise(F.lit("rule")),
            "semantic": F.when(F.col("all_judged"), F.col("semantic")),
        })
        .drop("judged", "sure", "all_judged")
    )
    ruled = plain.where("ruled").withColumns(
        {"classified_by": F.lit("rule"), "semantic": F.lit(None).cast(SEMANTIC)}
    )
    return ruled.unionByName(decided).drop("hard", "ruled")


def _judge_answers(rows: DataFrame) -> DataFrame:
    """Adds ``answer`` and ``rank`` to rows of query and candidate; rank is null if unacceptable.

    Municipality-level and unrelated answers are refused, also ones outside the region.
    """
    normal = rows.withColumns(
        {"__q": normal_address(F.col("query")), "__t": normal_address(F.col("title"))}
    )
    judged = with_computed(
        normal,
        {
            "__qc": canonical_of_normal(F.col("__q")),
            "__tc": canonical_of_normal(F.col("__t")),
            "__below": below_of_normal(F.col("__t")),
        },
    ).withColumn(
        "__precision", precision_of(F.col("__qc"), F.col("__tc"), F.col("__below"))
    )
    usable = F.col("__precision").isNotNull() & valid_coordinates(F.col("lat"), F.col("lng"))
    return judged.withColumns(
        {
            "answer": F.struct(
                "lat", "lng", F.col("title").alias("matched"),
                F.col("__precision").alias("precision"),
            ),
            "rank": F.when(usable, F.col("pos")),
        }
    )


def address_matches(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query, lat, lng, matched, precision): first acceptable candidate of each distinct query.

    ``candidates``: query, pos, title, lat, lng, in the order the lookup gave them.
    """
    rows = _judge_answers(queries.select("query").distinct().join(candidates, "query"))
    first = rows.where("rank IS NOT NULL").groupBy("query").agg(
        F.min_by("answer", "rank").alias("m")
    )
    return first.select("query", "m.*")


def locate(
    facilities: DataFrame,
    candidates: DataFrame,
    scope: list[str] | DataFrame | None = None,
    failed_queries: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Fills coordinates from addresses; whatever stays unlocated gets ``unlocated_reason``.

    Addresses are cleaned and matched once per distinct (address, organization) text.
    ``scope``: organizations to look up, all when empty.  ``failed_queries``: query.
    """
    located = facilities.where("coord_source IS NOT NULL").withColumns(
        {
            "precision": F.lit(None).cast("string"),
            "matched": F.lit(None).cast("string"),
            "unlocated_reason": F.lit(None).cast("string"),
        }
    )
    missing = facilities.where("coord_source IS NULL").drop("lat", "lng", "coord_source")
    asked = missing.where("address IS NOT NULL").select("address", "organization").distinct()
    asked = asked.withColumn("outside", outside_region(F.col("address")))
    if scope is None or (isinstance(scope, list) and not scope):
        asked = asked.withColumn("in_scope", F.lit(True))
    elif isinstance(scope, list):
        asked = asked.withColumn(
            "in_scope", F.coalesce(F.col("organization").isin(*scope), F.lit(False))
        )
    else:
        names = scope.select(F.col("name").alias("organization"), F.lit(True).alias("in_scope"))
        asked = asked.join(names.distinct(), "organization", "left").withColumn(
            "in_scope", F.coalesce("in_scope", F.lit(False))
        )
    asked = asked.withColumn(
        "query",
        F.when(
            ~F.col("outside") & F.col("in_scope"),
            complete_address(F.col("address"), F.col("organization")),
        ),
    )
    keys = ["address", "organization", "outside", "in_scope", "query"]
    asked = cut(asked)
    answered = (
        _judge_answers(
            split_join(
                asked.where("query IS NOT NULL"), candidates, ["query"],
                F.struct("address", "organization"), "left", hot_rows,
            )
        )
        .groupBy(*keys)
        .agg(F.min_by("answer", "rank").alias("m"))
        .select(*keys, "m.*")
    )
    looked_up = answered.unionByName(
        asked.where("query IS NULL"), allowMissingColumns=True
    )
    if failed_queries is not None:
        broken = failed_queries.select("query", F.lit(True).alias("broken")).distinct()
        looked_up = looked_up.join(broken, "query", "left")
    else:
        looked_up = looked_up.withColumn("broken", F.lit(None).cast("boolean"))
    # A missing organization is a key of its own; rows without an address find nothing.
    org = F.coalesce(F.concat(F.lit("="), "organization"), F.lit("")).alias("__org")
    answers = looked_up.select(*[c for c in looked_up.columns if c != "organization"], org)
    joined = split_join(
        missing.select("*", org), answers, ["address", "__org"], F.col("facility_id"), "left",
        hot_rows,
    ).drop("__org")
    broken = F.coalesce("broken", F.lit(False))
    reason = (
        F.when(F.col("address").isNull(), F.lit(fv.NO_ADDRESS))
        .when(F.col("outside"), F.lit(fv.OUTSIDE_REGION))
        .when(~F.col("in_scope"), F.lit(fv.OUT_OF_SCOPE))
        .when(broken, F.lit(fv.LOOKUP_ERROR))
        .when(F.col("precision").isNull(), F.lit(fv.NOT_FOUND))
    )
    found = reason.isNull()
    filled = joined.withColumn("unlocated_reason", reason).withColumns(
        {
            "coord_source": F.when(found, F.lit("geocode")),
            "lat": F.when(found, F.col("lat")),
            "lng": F.when(found, F.col("lng")),
            "precision": F.when(found, F.col("precision")),
            "matched": F.when(found, F.col("matched")),
        }
    )
    return located.unionByName(filled.select(*located.columns))


def ingest_report(entries: DataFrame, marked: DataFrame, rows: DataFrame) -> DataFrame:
    """Per (feature, dataset_id): counters and status.

    ``marked`` are all named rows before filtering, ``rows`` the located, counting ones.  Entries
    listed with an ``error`` are failed and keep null counters.
    """
    keys = ["feature", "dataset_id"]
    before = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("read"))
    source, reason = F.col("coord_source"), F.col("unlocated_reason")
    after = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("kept"),
        F.count_if(source == "source").alias("with_source"),
        F.count_if(source == "geocode").alias("geocoded"),
        F.count_if(F.col("precision") == "partial").alias("geocoded_partial"),
        F.count_if(reason == fv.OUTSIDE_REGION).alias("outside"),
        F.count_if(reason == fv.OUT_OF_SCOPE).alias("out_of_scope"),
    )
    joined = entries.join(before, keys, "left").join(after, keys, "left")
    counters = [
        "read", "kept", "with_source", "geocoded", "geocoded_partial", "outside", "out_of_scope",
    ]
    failed = F.col("error").isNotNull()
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counters}).withColumns(
        {
            "located": F.col("with_source") + F.col("geocoded"),
            "in_scope": F.col("kept") - F.col("out_of_scope") - F.col("outside"),
        }
    )

    def counted(value: Column, name: str) -> Column:
        return F.when(~failed, value).alias(name)

    return filled.select(
        *keys,
        "organization",
        F.when(failed, F.lit("failed")).otherwise(dataset_status()).alias("status"),
        counted(F.col("kept"), "rows"),
        counted(F.col("read") - F.col("kept"), "excluded"),
        counted(F.col("with_source"), "with_source"),
        counted(F.col("geocoded"), "geocoded"),
        counted(F.col("geocoded_partial"), "geocoded_partial"),
        counted(F.col("kept") - F.col("located") - F.col("outside"), "unlocated"),
        counted(F.col("outside"), "outside"),
        counted(F.col("out_of_scope"), "out_of_scope"),
        "error",
    )


def with_provenance(report: DataFrame, manifest: DataFrame, log: DataFrame) -> DataFrame:
    """The report with each dataset's name and URL and what the landing log says of its file."""
    named = manifest.select("feature", "dataset_id", "name", "resource_url")
    landed = log.select("dataset_id", "retrieved_at", "sha256", "encoding")
    return report.join(named, ["feature", "dataset_id"], "left").join(landed, "dataset_id", "left")


def dataset_status() -> Column:
    """State of a read dataset from row_filter, kept, located and in_scope."""
    kept, located, scoped = F.col("kept"), F.col("located"), F.col("in_scope")
    return (
        F.when(F.coalesce("row_filter", F.lit(False)) & (kept == 0), F.lit("no-matching-rows"))
        .when((kept > 0) & (scoped == 0) & (located == 0), F.lit("out-of-scope"))
        .when(
            (scoped > 0) & (F.try_divide(located, scoped) < fv.DEGRADED_BELOW), F.lit("degraded")
        )
        .otherwise(F.lit("ok"))
    )


def ingest_totals(report: DataFrame, rows: DataFrame, facilities: DataFrame) -> DataFrame:
    """Per feature: dataset counts, rows before and facilities after merging, located or not."""
    per_dataset = report.groupBy("feature").agg(
        F.count(F.lit(1)).alias("datasets"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "degraded").alias("degraded"),
        F.count_if(F.col("status") == "out-of-scope").alias("out_of_scope"),
    )
    before = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"))
    after = facilities.groupBy("feature").agg(
        F.count(F.lit(1)).alias("facilities"),
        F.count_if(F.col("coord_source").isNotNull()).alias("located"),
        F.count_if(F.col("coord_source").isNull()).alias("unlocated"),
    )
    joined = per_dataset.join(before, "feature", "left").join(after, "feature", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("rows", "facilities", "located", "unlocated")}
    return joined.withColumns(zero).withColumn(
        "merged_duplicates", F.col("rows") - F.col("facilities")
    )


def unlocated_by_reason(facilities: DataFrame) -> DataFrame:
    """(feature, reason, n)"""
    return (
        facilities.where("coord_source IS NULL")
        .groupBy("feature", F.col("unlocated_reason").alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def rule_prediction(
    name: Column, categories: Column, definitions=fv.FEATURE_DEFINITIONS
) -> Column:
    """What the rules alone say: the first defined feature that would count it, else none."""
    mixed = F.lit(True)
    answer = F.lit("none")
    for feature in reversed(definitions):
        definition = definitions[feature]
        counts = ~hard_excluded(name, categories, definition) & rule_match(
            name, categories, mixed, definition
        )
        answer = F.when(counts, F.lit(feature)).otherwise(answer)
    return answer


def output_order(facilities: DataFrame) -> DataFrame:
    """Located facilities by id, then the unlocated ones."""
    return facilities.orderBy(
        F.col("coord_source").isNull(),
        F.when(F.col("coord_source").isNotNull(), F.col("facility_id")),
        "facility_id",
    )
