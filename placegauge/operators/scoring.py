"""Relative scoring on the long matrix (site_id, feature, raw).

No step sorts all sites in one task: ranks are taken over the histogram of values, which is dealt
by ranges, and looked up by value.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.functions.rounding import compensated_sum, round_half_even
from placegauge.functions.staging import with_computed
from placegauge.operators.skew import split_join
from placegauge.session import cut


def value_histogram(values: DataFrame) -> DataFrame:
    """(feature, raw, equal) for each distinct non-null value of each feature."""
    return (
        values.where(F.col("raw").isNotNull())
        .groupBy("feature", "raw")
        .agg(F.count(F.lit(1)).alias("equal"))
    )


def value_ranks(histogram: DataFrame) -> DataFrame:
    """(feature, raw, below, equal, n) from a value histogram; ``below`` counts smaller values.

    Spark deals the distinct values by ranges that it samples from them, so ranges hold about as
    many values each however narrow or skewed the values are.  Sums over ranges, one row for each
    partition and feature, give where a range starts; inside a range values are summed in order.
    """
    ranged = cut(
        histogram.repartitionByRange("feature", "raw").withColumn("range", F.spark_partition_id())
    )
    before = Window.partitionBy("feature").orderBy("range")
    ranges = (
        ranged.groupBy("feature", "range")
        .agg(F.sum("equal").alias("in_range"))
        .withColumn("offset", F.sum("in_range").over(before) - F.col("in_range"))
        .withColumn("n", F.sum("in_range").over(Window.partitionBy("feature")))
        .drop("in_range")
    )
    inside = Window.partitionBy("feature", "range").orderBy("raw")
    return (
        ranged.withColumn("inside", F.sum("equal").over(inside) - F.col("equal"))
        .join(ranges, ["feature", "range"])
        .select("feature", "raw", (F.col("offset") + F.col("inside")).alias("below"), "equal", "n")
    )


def percentiles(
    matrix: DataFrame,
    min_values: int = fv.MIN_COMPARABLE_VALUES,
    hot_rows: int | None = None,
) -> DataFrame:
    """Adds ``percentile`` (average rank of ties, 0-100, 1 decimal) and ``low`` = 100 - percentile.

    Null stays null and is not counted; a feature with fewer than ``min_values`` values is not
    ranked at all, and a single value ranks 50.
    """
    matrix = matrix.withColumn("raw", F.col("raw").cast("double") + F.lit(0.0))
    n1 = (F.col("n") - 1).cast("double")
    average = F.col("below") + (F.col("equal") - 1) / F.lit(2.0)
    histogram = cut(value_histogram(matrix))  # read by three branches
    ranked = value_ranks(histogram).withColumn(
        "share", F.try_divide(average, n1) * F.lit(100.0)
    )
    shares = ranked.select(
        "feature",
        "raw",
        F.when(F.col("n") < min_values, F.lit(None))
        .when(F.col("n") == 1, F.lit(50.0))
        .otherwise(round_half_even(F.col("share"), 1))
        .alias("percentile"),
    )
    counts = histogram.select("feature", "raw", F.col("equal").alias("__n"))
    joined = split_join(
        matrix, shares, ["feature", "raw"], F.col("site_id"), "left", hot_rows, counts
    )
    return joined.withColumn(
        "low", round_half_even(F.lit(100.0) - F.col("percentile"), 1)
    )


def lows_by_site(ranked: DataFrame, features=fv.FEATURES) -> DataFrame:
    """One row per site with a column ``low_<feature>`` for each of the fixed features."""
    return ranked.groupBy("site_id").agg(
        *[F.max(F.when(F.col("feature") == f, F.col("low"))).alias(f"low_{f}") for f in features]
    )


def _with_score(lows: DataFrame, weight: dict[str, Column]) -> DataFrame:
    """Adds ``covered``, ``coverage`` and ``score`` of the weighted mean of what is available."""
    low = {f: F.col(f"low_{f}") for f in weight}
    available = [F.when(low[f].isNotNull(), weight[f]).otherwise(F.lit(0.0)) for f in weight]
    points = [F.coalesce(low[f] * weight[f], F.lit(0.0)) for f in weight]
    with_coverage = with_computed(
        lows,
        {
            "covered": compensated_sum(available),
            "__total": compensated_sum(list(weight.values())),
            "__points": compensated_sum(points),
        },
        {
            "__share": F.col("covered") / F.col("__total"),
            "__mean": F.try_divide(F.col("__points"), F.col("covered")),
        },
        {
            "covered": F.col("covered"),
            "__mean": F.col("__mean"),
            "coverage": round_half_even(F.col("__share"), 3),
        },
    )
    enough = F.col("coverage") >= fv.MIN_COVERAGE
    score = F.when(enough, round_half_even(F.col("__mean"), 1))
    return with_computed(with_coverage, {"score": score}).drop("__mean")


def scores(lows: DataFrame, weights: dict[str, float] = fv.WEIGHTS) -> DataFrame:
    """Adds ``score`` (null below the coverage gate), ``coverage`` and ``covered``."""
    return _with_score(lows, {f: F.lit(w) for f, w in weights.items()})


def weight_variants(weights: dict[str, float] = fv.WEIGHTS) -> list[dict[str, float]]:
    """The base weights, then each weight alone scaled down and up."""
    scaled = [
        {**weights, f: weights[f] * factor}
        for f, factor in product(weights, fv.SENSITIVITY_FACTORS)
    ]
    return [dict(weights), *scaled]


def competition_ranks(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by..., score, rank, of): rank 1 is the highest score, ties share (1, 2, 2, 4).

    Scores have one decimal between 0 and 100, so this table has at most 1001 rows per ``by``.
    """
    histogram = (
        scored.where(F.col("score").isNotNull())
        .groupBy(*by, "score")
        .agg(F.count(F.lit(1)).alias("equal"))
    )
    keyed = histogram.withColumn("__all", F.lit(1))
    group = Window.partitionBy("__all", *by)
    above = group.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return keyed.select(
        *by,
        "score",
        (F.coalesce(F.sum("equal").over(above), F.lit(0)) + 1).alias("rank"),
        F.sum("equal").over(group).alias("of"),
    )


def ranks(scored: DataFrame) -> DataFrame:
    """Adds ``rank`` and ``of`` to scored sites; both null without a score."""
    table = competition_ranks(scored, [])
    return scored.join(F.broadcast(table), "score", "left")  # at most 1001 rows


def _variant_ranks(lows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(site_id, variant, score, coverage, rank, of), thirteen rows per site; variant 0 is base."""
    variants = F.array(
        *[
            F.struct(F.lit(i).alias("variant"), *[F.lit(w).alias(f"w_{f}") for f, w in v.items()])
            for i, v in enumerate(weight_variants(weights))
        ]
    )
    each = lows.withColumn("v", F.explode(variants)).select(
        "site_id", *[f"low_{f}" for f in weights], "v.*"
    )
    scored = _with_score(each, {f: F.col(f"w_{f}") for f in weights}).select(
        "site_id", "variant", "score", "coverage"
    )
    table = competition_ranks(scored, ["variant"])
    return scored.join(F.broadcast(table), ["variant", "score"], "left")  # at most 13 x 1001 rows


def rank_ranges(lows: DataFrame, weights: dict[str, float] = fv.WEIGHTS) -> DataFrame:
    """(site_id, rank_min, rank_max) over the weight variants; null where never ranked."""
    return _variant_ranks(lows, weights).groupBy("site_id").agg(
        F.min("rank").alias("rank_min"), F.max("rank").alias("rank_max")
    )


def score_table(lows: DataFrame, weights: dict[str, float] = fv.WEIGHTS) -> DataFrame:
    """(site_id, score, coverage, rank, of, rank_min, rank_max); no range without a base rank.

    Base values are those of variant 0, so everything comes from one grouping per site.
    """

    def base(column: str) -> Column:
        return F.max(F.when(F.col("variant") == 0, F.col(column))).alias(column)

    grouped = _variant_ranks(lows, weights).groupBy("site_id").agg(
        *[base(c) for c in ("score", "coverage", "rank", "of")],
        F.min("rank").alias("rank_min"),
        F.max("rank").alias("rank_max"),
    )
    ranked = F.col("rank").isNotNull()
    return grouped.withColumns(
        {c: F.when(ranked, F.col(c)) for c in ("of", "rank_min", "rank_max")}
    )


def effective_weights(lows: DataFrame, weights: dict[str, float] = fv.WEIGHTS) -> DataFrame:
    """(site_id, feature, effective_weight): weights redistributed over what is available."""
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.lit(w).alias("weight"),
                F.col(f"low_{f}").alias("low"),
            )
            for f, w in weights.items()
        ]
    )
    each = scores(lows, weights).select("site_id", "covered", F.explode(rows).alias("r"))
    return each.select(
        "site_id",
        "r.feature",
        F.when(F.col("r.low").isNotNull(), F.try_divide("r.weight", "covered")).alias("share"),
    ).select("site_id", "feature", round_half_even(F.col("share"), 4).alias("effective_weight"))


def feature_breakdown(ranked: DataFrame, weights: dict[str, float] = fv.WEIGHTS) -> DataFrame:
    """Per site and feature: raw, percentile, low, weight, unrounded share and contribution."""
    weight = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
    covered = sum(
        (F.when(F.col(f"low_{f}").isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
         for f, w in weights.items()),
        F.lit(0.0),
    )
    sums = lows_by_site(ranked, tuple(weights)).select("site_id", covered.alias("covered"))
    rows = ranked.join(sums, "site_id").withColumn("weight", F.element_at(weight, F.col("feature")))
    usable = F.col("low").isNotNull() & (F.col("covered") != 0)
    return rows.select(
        "site_id",
        "feature",
        "raw",
        "percentile",
        "low",
        "weight",
        F.when(usable, F.try_divide("weight", "covered")).alias("effective_weight"),
        F.when(usable, F.try_divide(F.col("weight") * F.col("low"), F.col("covered"))).alias(
            "contribution"
        ),
        F.col("raw").isNull().alias("missing"),
    )


def dominant_feature(ranked: DataFrame, features=fv.FEATURES) -> DataFrame:
    """(site_id, dominant): feature of the highest percentile, earlier feature on ties."""
    position = F.create_map(*[F.lit(v) for i, f in enumerate(features) for v in (f, i)])
    key = F.struct(
        F.col("percentile"),
        (-F.element_at(position, F.col("feature"))).alias("order"),
        F.col("feature"),
    )
    best = F.max(F.when(F.col("percentile").isNotNull(), key))
    return ranked.groupBy("site_id").agg(best["feature"].alias("dominant"))
