"""Jobs: each reads tables or landed files and writes tables for the next one.

discover -> ingest -> aggregate (+ ridership) -> build -> export.  Tables lie below one folder and
are partitioned by feature where features are renewed one by one.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.operators import (
    areas,
    catalog,
    contract,
    coverage,
    dedupe,
    evaluation,
    facilities,
    inspections,
    judgements,
    manifest,
    publish,
    quality,
    radius,
    roles,
    scoring,
    sites,
    usage,
)
from placegauge.session import cut
from placegauge.sources import ranges, tables


@dataclass(frozen=True)
class Settings:
    """What people adjust."""

    radius_m: float = float(fv.DEFAULT_RADIUS_M)
    tolerance: float = fv.UNLOCATED_TOLERANCE
    dedupe_m: float = fv.DEDUPE_DISTANCE_M
    facility_min_confidence: float = fv.FACILITY_MIN_CONFIDENCE
    extra_scope: tuple[str, ...] = ("東京都建設局",)
    features: tuple[str, ...] = tuple(f for f in fv.FEATURES if f != "stationUsage")
    definitions: dict = field(default_factory=lambda: fv.FEATURE_DEFINITIONS)


def inspect_landed(
    spark: SparkSession, folder: str, log: DataFrame | None = None, kept: DataFrame | None = None
) -> DataFrame:
    """What inspecting the landed files says of each dataset (``inspections.SCHEMA``).

    With a landing ``log`` (dataset_id, path, sha256) and the inspections ``kept`` by an earlier run,
    only files of datasets with another digest are opened.  The names of these files pass through the
    driver, as Spark's own listing of the folder does.
    """
    if log is None:
        found = ranges.scan(spark, folder)
        return inspections.inspected(found.datasets, found.records).withColumn(
            "sha256", F.lit(None).cast("string")
        )
    log = cut(log.select("dataset_id", "path", "sha256"))
    current = cut(inspections.digests(log))
    kept = spark.createDataFrame([], inspections.SCHEMA) if kept is None else kept
    todo = cut(inspections.changed(current, kept))
    same = inspections.known(current, kept)
    paths = [r.path for r in log.join(todo, "dataset_id", "left_semi").select("path").collect()]
    if not paths:
        return same
    found = ranges.scan(spark, paths)
    fresh = inspections.inspected(found.datasets, found.records)
    return same.unionByName(fresh.join(todo, "dataset_id"))


def discover(
    packages: DataFrame,
    inspected: DataFrame,
    now: Column,
    overrides: DataFrame | None = None,
    judged: DataFrame | None = None,
    existing: DataFrame | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """The manifest after looking through the catalog; fails when it breaks a rule.

    ``inspected``: dataset_id, coord_fill, address_fill, has_address, and what else of
    ``inspections.SCHEMA`` is to be kept with the entries.
    """
    found = catalog.with_best_resource(catalog.candidates(packages, settings.definitions))
    rows = cut(catalog.with_semantics(found))
    read = catalog.worth_inspecting(rows).select("feature", F.col("name").alias("dataset_id"))
    looked_at = cut(read.join(inspected, "dataset_id"))
    entries = catalog.evaluate(rows, looked_at, now)
    if judged is not None:
        entries = judgements.apply_dataset_judgements(entries, judged)
    entries = inspections.attach(manifest.mark_duplicates(cut(entries)), looked_at)
    if overrides is not None:
        quality.require_clean(
            manifest.invalid_overrides(overrides).select(
                F.lit("invalid override status").alias("rule"), F.col("dataset_id").alias("key")
            ),
            "overrides",
        )
        entries = manifest.apply_overrides(entries, overrides)
    else:
        entries = entries.withColumn("review", F.lit(None).cast("struct<status string, note string>"))
    merged = cut(entries if existing is None else manifest.replace_features(existing, entries, settings.definitions))
    quality.require_clean(quality.manifest_violations(merged), "manifest")
    return merged


@dataclass(frozen=True)
class Ingested:
    facilities: DataFrame
    absorbed: DataFrame
    report: DataFrame
    totals: DataFrame
    reasons: DataFrame


def ingest(
    datasets: DataFrame,
    records: DataFrame,
    manifest_table: DataFrame,
    candidates: DataFrame,
    scope: DataFrame | list[str] | None = None,
    judged: DataFrame | None = None,
    settings: Settings = Settings(),
    file_errors: DataFrame | None = None,
    log: DataFrame | None = None,
) -> Ingested:
    """Accepted datasets -> located, merged facilities and a report per dataset.

    ``file_errors``: (dataset_id, error) of files that could not be read.  ``log``: landing log,
    for the provenance of the report.
    """
    accepted = manifest_table.where(F.col("status") == "accepted").select(
        "feature", "dataset_id", "organization", "row_filter", "format", "source_url", "resource_url"
    )
    records = cut(records)  # files are parsed once
    table = cut(roles.role_table(datasets))
    errors = cut(
        facilities.unreadable(accepted, table, file_errors).select("feature", "dataset_id", "error")
    )
    usable = accepted.join(errors, ["feature", "dataset_id"], "left_anti")
    read = cut(facilities.mark_excluded(
        facilities.normalise(records, table, usable), settings.definitions))
    kept = cut(facilities.select_rows(read, judged, settings.facility_min_confidence))
    located = cut(facilities.locate(kept, candidates, scope))
    noted = accepted.join(errors, ["feature", "dataset_id"], "left")
    report = facilities.ingest_report(noted, read, located)
    if log is not None:
        report = facilities.with_provenance(report, manifest_table, log)
    report = cut(report)
    merged, absorbed = dedupe.merge_places(located, settings.definitions, settings.dedupe_m)
    merged = cut(merged)
    return Ingested(
        merged,
        absorbed,
        report,
        facilities.ingest_totals(report, located, merged),
        facilities.unlocated_by_reason(merged),
    )


@dataclass(frozen=True)
class Aggregated:
    aggregates: DataFrame
    areas: DataFrame
    pairs: DataFrame
    evidence: DataFrame


def aggregate(
    site_table: DataFrame,
    merged: DataFrame,
    report: DataFrame,
    site_areas: DataFrame,
    settings: Settings = Settings(),
) -> Aggregated:
    """Counts within the radius, null where a touched municipality's data is incomplete."""
    features = list(settings.features)
    covered = coverage.municipality_coverage(report, settings.tolerance)
    states = cut(coverage.area_coverage(site_areas, covered, features))
    pairs = cut(radius.radius_pairs(
        site_table,
        merged.select(
            "facility_id", "feature", "name", "lat", "lng", "coord_source", "dataset_id",
            "organization",
        ),
        settings.radius_m,
    ))
    counts = radius.counted_pairs(site_table, pairs, features)
    quality.require_clean(
        quality.area_violations(states).unionByName(quality.evidence_violations(pairs)), "evidence"
    )
    return Aggregated(
        cut(coverage.site_aggregates(counts, states)),
        states,
        pairs,
        cut(coverage.evidence_datasets(pairs, site_areas, report)),
    )


@dataclass(frozen=True)
class Built:
    ranked: DataFrame
    table: DataFrame
    weights: DataFrame
    sources: DataFrame


def build(
    site_table: DataFrame,
    aggregates: DataFrame,
    evidence: DataFrame,
    manifest_table: DataFrame,
    base: DataFrame | None = None,
    other_sources: DataFrame | None = None,
) -> Built:
    """Percentiles, scores, ranks and sources; fails when a published value would break a rule.

    ``other_sources``: rows like those of ``publish.site_sources`` for base data and the yearbook.
    Every site and every value has to have a source.
    """
    matrix = cut(publish.raw_matrix(site_table, aggregates, base))
    ranked = cut(scoring.percentiles(matrix))
    lows = cut(scoring.lows_by_site(ranked))
    table = cut(scoring.score_table(lows))
    weights = scoring.effective_weights(lows)
    sources = publish.site_sources(evidence, manifest_table)
    if other_sources is not None:
        real = [r.feature for r in aggregates.select("feature").distinct().collect()]  # at most six
        sources = publish.all_sources(sources, other_sources, real)
    sources = cut(sources)
    quality.require_columns(site_table, ["site_id", "name", "lat", "lng"], "sites")
    violations = (
        quality.site_violations(site_table)
        .unionByName(quality.score_violations(table, ranked))
        .unionByName(quality.aggregate_violations(aggregates))
        .unionByName(quality.weight_violations(weights, table))
        .unionByName(quality.source_violations(site_table, sources))
        .unionByName(quality.unsourced_values(ranked.where("raw > 0"), sources, list(fv.FEATURES)))
    )
    quality.require_clean(violations, "published table")
    return Built(ranked, table, weights, sources)


def export(
    site_table: DataFrame,
    built: Built,
    counted: Aggregated,
    ingested: Ingested,
    manifest_table: DataFrame,
    folder: str,
    ridden: Ridership | None = None,
) -> None:
    """Publishes all result tables at once, with the evidence behind them, if all keep their contract.

    ``tables.current`` reads them; a run that fails leaves what was published before.
    """
    register = publish.register(manifest_table, ingested.report)
    rows = {
        "sites": site_table,
        "values": built.ranked,
        "weights": built.weights,
        "scores": built.table,
        "sources": built.sources,
        "evidence": counted.pairs,
        "areas": counted.areas,
        "aggregates": counted.aggregates,
        "facilities": ingested.facilities,
        "register": publish.register_order(register),
    }
    if ridden is not None:
        rows |= {"usage": ridden.usage, "lines": ridden.lines}
    renewed = {
        name: tables.Publication(df, partial(contract.published, name)) for name, df in rows.items()
    }
    renewed["documents"] = tables.Publication(
        publish.site_documents(site_table, built.ranked, built.table, built.weights), format="json"
    )
    more = quality.evidence_count_violations(counted.aggregates, counted.pairs).unionByName(
        quality.weight_violations(built.weights, built.table)
    )
    quality.require_clean(more, "published tables")
    tables.publish(site_table.sparkSession, folder, renewed, "published tables")


def station_sites(
    names: DataFrame,
    rail: DataFrame,
    operator: str,
    rows: DataFrame,
    polygons: DataFrame,
    settings: Settings = Settings(),
) -> DataFrame:
    """The site master with lines, groups and municipalities.

    Fails on names that cannot be resolved and on duplicates.
    """
    english = cut(usage.english_names(rows))
    own = sites.own_stations(names, rail, operator)
    problems = sites.unresolved(names, own, english).select(
        F.col("problem").alias("rule"), F.col("name").alias("key")
    )
    twice = sites.duplicates(names, "name").select(
        F.lit("duplicate name").alias("rule"), F.col("value").alias("key")
    )
    quality.require_clean(problems.unionByName(twice), "site names")
    master = cut(sites.site_master(names, rail, operator, english))
    quality.require_clean(quality.site_violations(master), "site master")
    centres = master.select("site_id", F.lit(0).alias("pos"), "lat", "lng")
    children = sites.site_children(
        master, own, rail, areas.areas_by_polygons(centres, polygons),
        touched_areas(master, polygons, settings.radius_m),
    )
    return cut(sites.with_attributes(master, children))


@dataclass(frozen=True)
class Ridership:
    """``aggregates`` like those of the facility features, and what they consist of.

    usage: with fiscal year and the tables of each site.  lines: site_id, operator, line, thousands.
    entry: the yearbook in the manifest.  sources: rows for ``build``'s ``other_sources``.
    """

    aggregates: DataFrame
    usage: DataFrame
    lines: DataFrame
    entry: DataFrame
    sources: DataFrame


def ridership(
    site_table: DataFrame,
    records: DataFrame,
    datasets: DataFrame,
    package: DataFrame,
    resources: DataFrame,
    expected: DataFrame | None = None,
) -> Ridership:
    """Usage of every site from the station tables of the chosen yearbook.

    ``records`` and ``datasets`` are those of its files, ``package`` its one row, ``resources`` the
    listed files of packages: package, pos, id, name, url, format.  A table that cannot be read ends
    the job; with ``expected`` (station, table_name: the tables that should list a station, say of
    the edition before) only the sites it should list are incomplete.
    """
    rows = cut(usage.yearbook_rows(records, datasets))
    states = cut(usage.table_states(datasets, rows))
    members = usage.table_members(rows)
    if expected is None:
        problems = usage.table_problems(datasets).unionByName(
            states.where("state = 'no year'").select(F.col("state").alias("rule"), F.col("table_name").alias("key"))
        )
        quality.require_clean(problems, "yearbook tables")
    else:
        members = members.unionByName(expected.select("station", "table_name")).distinct()
    used = cut(usage.checked_usage(site_table, rows, cut(members), states))
    entry = cut(usage.yearbook_entry(package, usage.station_tables(resources)))
    counted = used.where("fiscal_year IS NOT NULL").select("site_id", F.lit("stationUsage").alias("feature"))
    evidence = counted.join(
        F.broadcast(entry.select("feature", "dataset_id")), "feature"  # the one yearbook
    )
    sources = publish.site_sources(evidence, entry).withColumn("kind", F.lit("statistics"))
    return Ridership(
        used.select("site_id", F.lit("stationUsage").alias("feature"), "status", "count", "lower_bound"),
        used,
        usage.usage_lines(site_table, rows),
        entry,
        sources,
    )


def touched_areas(site_table: DataFrame, polygons: DataFrame, radius_m: float) -> DataFrame:
    """Municipalities each site's disc touches."""
    points = cut(areas.disc_points(site_table, radius_m))
    return cut(areas.areas_by_polygons(points, polygons))


@dataclass(frozen=True)
class Evaluation:
    """predictions: an item a row.  metrics: kind, metric, name, value.  costs: one row."""

    predictions: DataFrame
    metrics: DataFrame
    confusions: DataFrame
    differences: DataFrame
    costs: DataFrame
    unanswered: DataFrame


def evaluate_classifier(
    spark: SparkSession,
    paths: dict[str, str],
    questions: dict[str, dict[str, str]],
    answers: DataFrame,
    price_per_million: float,
    languages: tuple[str, str] = ("ja", "en"),
) -> Evaluation:
    """Rules and classifier against the labelled JSON lines at ``paths``, by kind.

    ``answers`` are stored: key, repeat, category, confidence, list_score, tokens, latency.
    """
    sets = [evaluation.labelled(tables.labelled_items(spark, path), kind) for kind, path in paths.items()]
    items = evaluation.frozen(*sets)
    predicted = cut(evaluation.predictions(items, questions, answers, languages))
    used = answers.join(evaluation.asked(items, questions).select("key").distinct(), "key", "left_semi")
    return Evaluation(
        predicted,
        evaluation.metrics(predicted),
        evaluation.confusions(predicted),
        evaluation.differences(predicted),
        judgements.call_costs(used, price_per_million),
        evaluation.unanswered(predicted, questions, answers),
    )
