"""Split joins give what plain joins give, also where one key holds a third of the rows."""

import random

import pytest
from plain_rows import rows
from pyspark.sql import functions as F

from placegauge.operators import manifest, radius, skew
from placegauge.operators import scoring as sc


def tables(spark):
    rng = random.Random(8)
    data = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "lost", None])) for i in range(300)]
    other = [("hot", 1), ("hot", 2), ("a", 3), ("b", 4), ("b", 5), ("c", 6), ("unused", 7)]
    return (spark.createDataFrame(data, "id int, k string"),
            spark.createDataFrame(other, "k string, v int"))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("least", [1, 50, 10**9])
def test_same_as_join(spark, how, least):
    left, right = tables(spark)
    got = skew.split_join(left, right, ["k"], F.col("id"), how, least)
    assert rows(got, "id", "k", "v") == rows(left.join(right, "k", how), "id", "k", "v")


@pytest.mark.parametrize("least", [1, 2, 50, 10**9])
def test_both_sides_cut(spark, least):
    left, right = tables(spark)
    right = right.unionByName(spark.range(40).selectExpr("'hot' as k", "cast(id + 10 as int) as v"))
    got = skew.split_join(left, right, ["k"], F.col("id"), "inner", least, other_spread=F.col("v"))
    assert rows(got, "id", "k", "v") == rows(left.join(right, "k"), "id", "k", "v")


def test_parts_follow_the_rows(spark, monkeypatch):
    left, _ = tables(spark)
    assert rows(skew.hot_keys(left, ["k"], 30)) == rows(
        left.where("k is not null").groupBy("k").count().selectExpr("k", "cast(ceil(count / 30) as int) p").where("p > 1"))
    many = spark.range(6000).selectExpr("cast(id % 2000 as string) as k")
    assert skew.hot_keys(many, ["k"], 1).count() == 2000
    # No more keys than can be broadcast: parts grow instead.
    monkeypatch.setattr(skew, "HOT_KEYS", 4)
    uneven = many.unionByName(spark.range(6000).selectExpr("'big' as k"))
    assert rows(skew.hot_keys(uneven, ["k"], 1)) == [("big", 2)]


def test_operators_with_split_keys(spark):
    values = [0.0] * 60 + [float(v) for v in range(1, 100)]
    df = spark.createDataFrame([(f"s{i}", "park", v) for i, v in enumerate(values)],
                               "site_id string, feature string, raw double")
    plain, split = sc.percentiles(df), sc.percentiles(df, hot_rows=10)
    assert rows(plain, "site_id", "percentile") == rows(split, "site_id", "percentile")

    rng = random.Random(1)
    s = spark.createDataFrame([(f"s{i}", rng.uniform(35.6, 35.62), 139.7) for i in range(20)],
                              "site_id string, lat double, lng double")
    f = spark.createDataFrame(
        [(f"f{i}", "park", 35.61 if i % 3 == 0 else rng.uniform(35.6, 35.62), 139.7) for i in range(90)],
        "facility_id string, feature string, lat double, lng double")
    assert rows(radius.radius_pairs(s, f, 500.0)) == rows(radius.radius_pairs(s, f, 500.0, 3))
    assert rows(radius.radius_counts(s, f, 500.0, ["park"])) == rows(
        radius.radius_counts(s, f, 500.0, ["park"], 3))

    entries = spark.createDataFrame(
        [("park", f"d{i}", "同じ" if i % 3 == 0 else f"t{i % 7}", "港区", None if i % 2 else f"u{i % 5}",
          "accepted", "accepted", "r", (i % 4) / 4) for i in range(80)],
        "feature string, dataset_id string, name string, organization string, resource_url string, "
        "status string, auto_status string, reason string, confidence double")
    assert rows(manifest.mark_duplicates(entries)) == rows(manifest.mark_duplicates(entries, 2))
