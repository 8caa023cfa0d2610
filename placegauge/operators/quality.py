"""Gates as violation tables: one row per rule hit. An empty table lets a job publish."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegauge import fixed_values as fv


class QualityError(ValueError):
    """Published data would break a rule."""


def _hits(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) of the rows for which a rule's condition is true; one pass for all rules."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), key.cast("string").alias("key"))


def _repeated(df: DataFrame, key: Column, rule: str) -> DataFrame:
    counted = df.groupBy(key.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1").select(F.lit(rule).alias("rule"), "key")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) == ""


def _not_percent(column: str) -> Column:
    value = F.col(column)
    return value.isNotNull() & (F.isnan(value) | ~value.between(0, 100))


def site_violations(sites: DataFrame) -> DataFrame:
    """Ids, names and coordinates of published sites."""
    def outside(c: str, limit: float) -> Column:
        return ~F.coalesce(F.col(c).between(-limit, limit), F.lit(False))

    rules = {
        "id is not a slug": ~F.coalesce(F.col("site_id").rlike("^[a-z0-9-]+\\z"), F.lit(False)),
        "name missing": _blank("name"),
        "invalid coordinates": outside("lat", 90) | outside("lng", 180),
    }
    return _all(
        [
            _hits(sites, F.col("site_id"), rules),
            _repeated(sites, F.col("site_id"), "duplicate site id"),
        ]
    )


def score_violations(table: DataFrame, ranked: DataFrame) -> DataFrame:
    """Ranges of scores, percentiles, coverage and ranks."""
    site = F.col("site_id")
    cell = F.concat_ws("/", "site_id", "feature")
    of_table = {
        "score out of range": _not_percent("score"),
        "coverage out of range": ~F.coalesce(F.col("coverage").between(0, 1), F.lit(False)),
        "rank outside its range": F.coalesce(
            ~F.col("rank").between(F.col("rank_min"), F.col("rank_max")), F.lit(False)
        ),
        "scored without rank": F.col("score").isNotNull() & F.col("rank").isNull(),
    }
    of_cells = {
        "percentile out of range": _not_percent("percentile"),
        "low out of range": _not_percent("low"),
        "missing value was ranked": F.col("raw").isNull() & F.col("percentile").isNotNull(),
        "negative raw value": F.coalesce(F.col("raw") < 0, F.lit(False)),
    }
    return _all([_hits(table, site, of_table), _hits(ranked, cell, of_cells)])


def aggregate_violations(aggregates: DataFrame) -> DataFrame:
    """Null gate of counts: incomplete has none, complete counts everything that was found."""
    done = F.col("status") == "complete"
    rules = {
        "unknown feature": ~F.coalesce(F.col("feature").isin(*fv.FEATURES), F.lit(False)),
        "unknown status": ~F.coalesce(
            F.col("status").isin("complete", "incomplete"), F.lit(False)
        ),
        "incomplete with a count": ~done & F.col("count").isNotNull(),
        "complete without a count": done & F.col("count").isNull(),
        "count differs from what was found": F.coalesce(
            done & (F.col("count") != F.col("lower_bound")), F.lit(False)
        ),
        "negative lower bound": F.col("lower_bound") < 0,
    }
    return _hits(aggregates, F.concat_ws("/", "site_id", "feature"), rules)


def weight_violations(effective: DataFrame, scored: DataFrame) -> DataFrame:
    """Effective weights of a scored site sum to 1."""
    sums = effective.groupBy("site_id").agg(F.sum("effective_weight").alias("total"))
    joined = scored.where("score IS NOT NULL").select("site_id").join(sums, "site_id", "left")
    off = ~F.coalesce(F.abs(F.col("total") - 1.0) < 0.005, F.lit(False))
    return _hits(joined, F.col("site_id"), {"effective weights do not sum to 1": off})


def source_violations(sites: DataFrame, sources: DataFrame) -> DataFrame:
    """Every site has a source, and every source but a fixture has a URL."""
    bare = sites.join(sources.select("site_id"), "site_id", "left_anti")
    rules = {"source without url": (F.col("kind") != "fixture") & _blank("url")}
    return _all(
        [
            _hits(bare, F.col("site_id"), {"no sources": F.lit(True)}),
            _hits(sources, F.concat_ws("/", "site_id", "source_id"), rules),
        ]
    )


def unsourced_values(ranked: DataFrame, sources: DataFrame, features: list[str]) -> DataFrame:
    """Real, non-null values no source stands behind."""
    real = ranked.where(F.col("raw").isNotNull() & F.col("feature").isin(*features))
    bare = real.join(sources.select("site_id", "feature"), ["site_id", "feature"], "left_anti")
    return _hits(
        bare, F.concat_ws("/", "site_id", "feature"), {"value without source": F.lit(True)}
    )


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """Keys are unique, decisions are explained, accepted datasets can be read."""
    key = F.concat_ws("/", "feature", "dataset_id")
    known = {
        c: ~F.coalesce(F.col(c).isin(*fv.STATUSES), F.lit(False)) for c in ("status", "auto_status")
    }
    rules = {
        "missing reason": _blank("reason"),
        "missing source url": _blank("source_url"),
        "unknown status": known["status"],
        "unknown automatic status": known["auto_status"],
        "accepted without resource": (F.col("status") == "accepted") & _blank("resource_url"),
    }
    return _all([_hits(manifest, key, rules), _repeated(manifest, key, "duplicate entry")])


def register_violations(register: DataFrame) -> DataFrame:
    ingest = F.col("ingest")
    rules = {
        "not accepted": F.col("status") != "accepted",
        "source url is no url": ~F.coalesce(
            F.col("source_url").rlike("^https?://[^\\s]+"), F.lit(False)
        ),
        "unknown ingest status": ingest.isNotNull()
        & ~F.coalesce(ingest["status"].isin(*fv.INGEST_STATUSES), F.lit(False)),
        "located is not a count": F.coalesce(ingest["located"] < 0, F.lit(False)),
    }
    return _hits(register, F.concat_ws("/", "feature", "dataset_id"), rules)


def evidence_violations(evidence: DataFrame) -> DataFrame:
    """Facilities in evidence: distance and the source of their coordinates."""
    rules = {
        "negative distance": F.coalesce(F.col("distance_m") < 0, F.lit(True)),
        "unknown coordinate source": ~F.coalesce(
            F.col("coord_source").isin("source", "geocode"), F.lit(False)
        ),
    }
    return _hits(evidence, F.concat_ws("/", "site_id", "facility_id"), rules)


def area_violations(covered_areas: DataFrame) -> DataFrame:
    """Municipalities behind counts: code, name and state."""
    rules = {
        "area without code or name": _blank("code") | _blank("name"),
        "unknown coverage": ~F.coalesce(
            F.col("coverage").isin("covered", "partial", "uncovered"), F.lit(False)
        ),
        "negative unlocated": ~F.coalesce(F.col("unlocated") >= 0, F.lit(False)),
    }
    return _hits(covered_areas, F.concat_ws("/", "site_id", "feature", "code"), rules)


def evidence_count_violations(aggregates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Counts that differ from the facilities listed behind them; of incomplete ones the lower bound."""
    listed = evidence.groupBy("site_id", "feature").agg(F.count(F.lit(1)).alias("listed"))
    joined = aggregates.where(F.col("feature") != "stationUsage").join(listed, ["site_id", "feature"], "left")
    off = F.coalesce("count", "lower_bound") != F.coalesce("listed", F.lit(0))
    return _hits(joined, F.concat_ws("/", "site_id", "feature"), {"count differs from its evidence": off})


def require_columns(df: DataFrame, columns: list[str], what: str) -> None:
    """Fails the job when a table lacks a column of the contract."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise QualityError(f"{what}: missing columns {missing}")


def require_clean(violations: DataFrame, what: str, show: int = 20) -> None:
    """Fails the job when there is a violation; the message lists the first few."""
    rows = violations.limit(show).collect()
    if rows:
        listed = "; ".join(f"{r['rule']}: {r['key']}" for r in rows)
        raise QualityError(f"{what}: {listed}")
