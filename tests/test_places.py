"""Radius join, areas, coverage, completeness, ridership, site master."""

import math
import random
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
from plain_rows import rows
from pyspark.sql import functions as F

from placegauge.functions import geo
from placegauge.operators import areas, coverage, radius, sites, usage
from placegauge.plans.registry import QUERIES


def test_radius_is_metric_and_inclusive(spark):
    site = spark.createDataFrame([("akiba", 35.6984, 139.7731)], "site_id string, lat double, lng double")
    around = site.select(
        "lat", "lng",
        F.explode(F.array(*[F.lit(float(a)) for a in (0, 45, 90, 180, 270)])).alias("az"),
        F.lit("park").alias("feature"),
    )
    points = []
    for label, d in (("in", 495.0), ("out", 505.0)):
        moved = geo.geodesic_direct(around.withColumn("d", F.lit(d)), "lat", "lng", "az", "d", "a", "b")
        points += [(f"{label}{r['az']}", "park", r["a"], r["b"]) for r in moved.collect()]
    points.append(("unlocated", "park", None, None))
    facs = spark.createDataFrame(points, "facility_id string, feature string, lat double, lng double")
    found = rows(radius.radius_pairs(site, facs, 500.0), "facility_id", "distance_m")
    assert len(found) == 5 and all(f.startswith("in") and abs(d - 495) <= 1 for f, d in found)
    assert rows(radius.radius_counts(site, facs, 500.0, ["park", "library"])) == [
        ("akiba", "library", 0), ("akiba", "park", 5)]
    assert rows(radius.radius_counts(site, facs.limit(0), 500.0, ["park"])) == [("akiba", "park", 0)]


def test_radius_against_all_pairs(spark):
    rng = random.Random(4)
    where = [(f"s{i}", rng.uniform(35.6, 35.7), rng.uniform(139.6, 139.8)) for i in range(40)]
    # a third of the facilities stand on one spot
    facs = [
        (f"f{i}", "park", *((35.65, 139.7) if i % 3 == 0 else
                            (rng.uniform(35.6, 35.7), rng.uniform(139.6, 139.8))))
        for i in range(300)
    ]
    s = spark.createDataFrame(where, "site_id string, lat double, lng double")
    f = spark.createDataFrame(facs, "facility_id string, feature string, lat double, lng double")
    sx = {r[0]: (r[1], r[2]) for r in rows(geo.project(s, "lat", "lng", "x", "y"), "site_id", "x", "y")}
    fx = {r[0]: (r[1], r[2]) for r in rows(geo.project(f, "lat", "lng", "x", "y"), "facility_id", "x", "y")}
    want = {(a, b): round(math.dist(sx[a], fx[b]), 1)
            for a in sx for b in fx if math.dist(sx[a], fx[b]) <= 1500}
    got = {(r[0], r[1]): r[2]
           for r in rows(radius.radius_pairs(s, f, 1500.0), "site_id", "facility_id", "distance_m")}
    assert got == want
    counts = {r[0]: r[2] for r in rows(radius.radius_counts(s, f, 1500.0, ["park"]))}
    assert counts == {a: sum(k[0] == a for k in want) for a in sx}


def test_groups_near_a_site_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    spots = [(35.65 + rng.uniform(-0.05, 0.05), 139.7 + rng.uniform(-0.06, 0.06)) for _ in range(40)]
    where = [(f"s{i}", *spots[i % 7]) if i % 3 == 0 else
             (f"s{i}", rng.uniform(35.6, 35.7), rng.uniform(139.64, 139.76)) for i in range(60)]
    facs = [(f"f{i}", "park" if i % 5 else None, f"d{i % 9}" if i % 11 else f"rare{i % 70}",
             *(spots[i % 40] if i % 4 == 0 else (rng.uniform(35.6, 35.7), rng.uniform(139.64, 139.76))))
            for i in range(500)]
    facs += [("gone", "park", "unlocated", None, None), ("odd", "park", "odd", float("nan"), 139.7)]
    s = spark.createDataFrame([*where, ("nowhere", None, None)], "site_id string, lat double, lng double")
    f = spark.createDataFrame(
        facs, "facility_id string, feature string, dataset_id string, lat double, lng double")
    keys = ["feature", "dataset_id"]
    listed = radius.radius_pairs(s, f, 1500.0).select("site_id", *keys).distinct()
    want = sorted(map(str, listed.collect()))
    for hot in (None, 3):
        found = radius.radius_pairs(s, f, 1500.0, hot, groups=keys)
        assert sorted(map(str, found.collect())) == want


def test_groups_are_found_without_listing_pairs(spark):
    """A crowd around a crowd: nine million pairs, two rows a site."""
    s = spark.range(3000).selectExpr("concat('s', id) site_id", "35.65 + id / 1e7 lat", "139.7D lng")
    f = spark.range(3000).selectExpr(
        "concat('f', id) facility_id", "'park' feature", "concat('d', id % 2) dataset_id", "35.65 + id / 1e7 lat",
        "139.7001D lng")
    found = radius.radius_pairs(s, f, 1000.0, groups=["feature", "dataset_id"])
    assert found.count() == 6000


def test_pairs_of_small_tables_are_found_by_many_tasks(spark):
    s = spark.createDataFrame([(f"s{i}", 35.6 + i / 500, 139.7) for i in range(40)],
                              "site_id string, lat double, lng double")
    f = spark.createDataFrame([(f"f{i}", "park", 35.6 + i / 2000, 139.7) for i in range(160)],
                              "facility_id string, feature string, lat double, lng double")
    found = radius.radius_pairs(s, f, 1000.0)
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    # What is too far away is dropped by the join itself.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joined = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "SQRT" in joined.upper()


def crowd(spark, seed):
    rng = random.Random(seed)
    spots = [(35.65 + rng.uniform(-0.02, 0.02), 139.7 + rng.uniform(-0.02, 0.02)) for _ in range(30)]
    where = [(f"s{i % 50}" if i % 9 else None, *rng.choice(spots)) for i in range(70)]
    where += [("nowhere", None, None), ("odd", float("nan"), 139.7), ("far", 40.0, 141.0)]
    facs = [(f"f{i % 300}" if i % 13 else None, ["park", "library", None, "学校"][i % 4], *(
        rng.choice(spots) if i % 3 else (rng.uniform(35.6, 35.7), rng.uniform(139.66, 139.74)))) for i in range(400)]
    facs += [("unlocated", "park", None, 139.7), ("odd", "park", 35.65, float("nan")), ("pole", "park", 90.0, 139.7)]
    return (spark.createDataFrame(where, "site_id string, lat double, lng double"),
            spark.createDataFrame(facs, "facility_id string, feature string, lat double, lng double"))


COLUMNS = ["site_id", "feature", "facility_id", "distance_m"]


def test_runs_are_the_list_in_order(spark):
    s, f = crowd(spark, 5)
    for radius_m in (300.0, 1500.0):
        want = radius.nearest_first(radius.radius_pairs(s, f, radius_m)).select(*COLUMNS).collect()
        got = radius.nearest_first(radius.radius_pairs(s, f, radius_m, runs=True)).select(*COLUMNS).collect()
        assert len(want) > 500 and got == want
    assert not radius.radius_pairs(s, f.limit(0), 300.0, runs=True).count()
    assert not radius.radius_pairs(s.limit(0), f, 300.0, runs=True).count()


def test_lists_are_not_sorted_after_they_were_made(spark, tmp_path):
    """Pairs are far more than sites and facilities: sorting them fills the disks."""
    spark.range(40).selectExpr("id s_suppkey", "concat('S', id) s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(900).selectExpr(
        "id c_custkey", "cast(id % 25 as int) c_nationkey", "double(id % 9000 - 800) c_acctbal",
        "array('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')[cast(id % 5 as int)] c_mktsegment",
    ).write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES["radius_pairs"](spark, str(tmp_path))
    assert found.columns == COLUMNS
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "Sort" not in above and "Repartition" not in above and "Join" not in plan
    listed = [tuple(r) for r in found.collect()]
    assert len(listed) > 100 and listed == sorted(listed, key=lambda r: (r[0], r[1], r[3], r[2]))


def test_lists_of_crowds_are_made_in_slices(monkeypatch):
    monkeypatch.setattr(radius, "LISTED", 200)
    monkeypatch.setattr(radius, "RUN", 7)
    rng = np.random.default_rng(2)
    n, strip = 300, 100.0 / radius.STRIPS
    ids = [f"f{i:03}" if i else None for i in range(n)]
    x, y = rng.uniform(0, 250, n), rng.uniform(-40, 120, n)
    feature = [["park", None, "library"][i % 3] for i in range(n)]
    order = np.lexsort((x, np.floor(y / strip)))
    # Numbers go up in jumps, as those of several partitions do.
    number = np.arange(n) + (np.arange(n) // 100 << 33)
    tables = [pa.table({"facility_id": pa.array(ids[a:a + 100]), "number": number[a:a + 100]}) for a in (0, 100, 200)]
    spots = pa.table({"strip": np.floor(y / strip).astype(int), "fx": x, "fy": y, "feature": feature, "number": number})
    spots = spots.take(pa.array(order))
    near = radius.Facilities(iter(tables), lambda: iter([spots[:50], spots[50:]]), None, 100.0)
    # Forty rows of one id, and ids with one or two rows.
    site = [None] * 40 + ["a", "b", "b", "c"]
    sx, sy = rng.uniform(0, 250, len(site)), rng.uniform(-40, 120, len(site))
    want = []
    for i, own in enumerate(site):
        away = np.sqrt((sx[i] - x) ** 2 + (sy[i] - y) ** 2)
        want += [(own, feature[k], ids[k], round(float(away[k]), 1)) for k in range(n) if away[k] <= 100.0]
    want.sort(key=lambda r: (r[0] or "", r[1] or "", r[3], r[2] or ""))
    got = []
    for batch in near.lists(pa.array(site), sx, sy):
        for row in batch.to_pylist():
            assert 0 < len(row["run"]) <= 7
            got += [(row["site_id"], row["feature"], p["facility_id"], p["distance_m"]) for p in row["run"]]
    assert got == want and len(got) > 3000


def test_tenths_are_rounded_on_the_stored_value():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.uniform(0, 1000, 5000), np.arange(0, 4000) / 20, np.arange(0, 4000) * 0.05, [0.25, 0.75, 0.35]])
    exact = [int(Decimal(float(v)).quantize(Decimal("0.1"), ROUND_HALF_EVEN) * 10) for v in values]
    assert radius.tenths(values).tolist() == exact


def test_disc_points_lie_on_their_circles(spark):
    site = spark.createDataFrame([("a", 35.6984, 139.7731)], "site_id string, lat double, lng double")
    points = areas.disc_points(site, 500.0)
    placed = geo.project(points, "lat", "lng", "x", "y").orderBy("pos").collect()
    centre = placed[0]
    dists = [round(math.hypot(p["x"] - centre["x"], p["y"] - centre["y"]) / 0.9999) for p in placed]
    assert dists == [0] + [250] * 8 + [500] * 16


def test_areas(spark):
    site = spark.createDataFrame([("a", 35.70, 139.70), ("b", 35.70, 139.75)],
                                 "site_id string, lat double, lng double")

    def square(west, east):
        corners = [(west, 35.6), (east, 35.6), (east, 35.8), (west, 35.8), (west, 35.6)]
        return [{"lng": x, "lat": y} for x, y in corners]

    polygons = spark.createDataFrame(
        [("13101", "千代田区", square(139.6, 139.7001)), ("13102", "中央区", square(139.7001, 139.72))],
        "code string, name string, ring array<struct<lng: double, lat: double>>")
    points = areas.disc_points(site, 500.0)
    assert rows(areas.areas_by_polygons(points, polygons)) == [
        ("a", "13101", "千代田区"), ("a", "13102", "中央区")]
    answers = points.select("lat", "lng", F.when(F.col("site_id") == "a", F.lit("131069"))
                            .when(F.col("pos") < 3, F.lit("11203")).alias("code"))
    assert rows(areas.areas_by_lookup(points, answers)) == [
        ("a", "13106", "台東区"), ("b", "11203", "(都外 11203)")]


REPORT = ("feature string, dataset_id string, organization string, status string, "
          "`rows` long, unlocated long")


def test_coverage_states(spark):
    report = spark.createDataFrame(
        [
            ("park", "1", "千代田区", "ok", 100, 0), ("park", "2", "台東区", "ok", 100, 2),
            ("park", "3", "港区", "out-of-scope", 10, 10), ("park", "4", "新宿区", "failed", None, None),
            ("park", "5", "東京都建設局", "ok", 100, 0), ("park", "6", "文京区", "ok", 10, 0),
            ("park", "7", "文京区", "failed", None, None), ("park", "8", "北区", "degraded", 9, 0),
            ("park", "9", "豊島区", "ok", 190, 7), ("park", "a", "板橋区", "ok", 0, 0),
            ("park", "b", "目黒区", "no-matching-rows", 0, 0),
        ], REPORT)
    strict = {r[0]: r[1] for r in rows(coverage.municipality_coverage(report), "organization", "coverage")}
    assert strict == {"千代田区": "covered", "台東区": "partial", "文京区": "covered",
                      "北区": "partial", "豊島区": "partial", "板橋区": "covered"}
    loose = {r[0]: r[1:] for r in rows(coverage.municipality_coverage(report, 0.05),
                                       "organization", "coverage", "rows", "unlocated")}
    assert loose["豊島区"] == ("covered", 190, 7) and loose["台東区"][0] == "covered"


def test_null_gate(spark):
    report = spark.createDataFrame(
        [("park", "1", "A区", "ok", 10, 0), ("park", "2", "B区", "ok", 10, 9)], REPORT)
    site_areas = spark.createDataFrame(
        [("s1", "1", "A区"), ("s2", "1", "A区"), ("s2", "2", "B区"), ("s3", "9", "(都外 9)")],
        "site_id string, code string, name string")
    states = coverage.area_coverage(site_areas, coverage.municipality_coverage(report), ["park"])
    counts = spark.createDataFrame(
        [(s, "park", n) for s, n in (("s1", 0), ("s2", 4), ("s3", 1), ("s4", 2))],
        "site_id string, feature string, n long")
    assert rows(coverage.site_aggregates(counts, states)) == [
        ("s1", "park", "complete", 0, 0), ("s2", "park", "incomplete", None, 4),
        ("s3", "park", "incomplete", None, 1), ("s4", "park", "incomplete", None, 2)]
    pairs = spark.createDataFrame([("s4", "park", "9")], "site_id string, feature string, dataset_id string")
    assert rows(coverage.evidence_datasets(pairs, site_areas, report)) == [
        ("s1", "park", "1"), ("s2", "park", "1"), ("s2", "park", "2"), ("s4", "park", "9")]


def test_usage(spark):
    fields = ["Fiscal year", "駅", "Station", "乗車人員・総数", "系統", "会社名"]
    datasets = spark.createDataFrame(
        [("jr", fields[:4]), ("metro", [fields[0], fields[1], *fields[3:]]), ("old", fields[:4])],
        "dataset_id string, fields array<string>")

    def rec(names, values):
        return dict(zip(names, values))

    records = spark.createDataFrame(
        [
            ("jr", 1, rec(fields[:4], ["2023", "東京", "Tokyo", "158,616"])),
            ("jr", 2, rec(fields[:4], ["2022", "東京", "Old", "1"])),
            ("jr", 3, rec(fields[:4], ["2023", "新", "New", "-"])),
            ("jr", 4, rec(fields[:4], ["合計", "東京", "x", "5"])),
            ("metro", 1, rec(["Fiscal year", "駅", "乗車人員・総数", "系統", "会社名"],
                             ["2023", "東京", "35391", "丸ノ内線", "東京地下鉄"])),
            ("old", 1, rec(fields[:4], ["2021", "東京", "Tokio", "7"])),
        ], "dataset_id string, row_no long, rec map<string,string>")
    table = usage.yearbook_rows(records, datasets)
    site = spark.createDataFrame([("tokyo", "東京"), ("new", "新")], "site_id string, name string")
    assert rows(usage.daily_usage(site, table)) == [
        ("new", "incomplete", None, 0, None),
        ("tokyo", "complete", round((158616 + 35391) * 1000 / 366), 530074, 2023)]
    assert rows(usage.usage_lines(site, table), "operator", "line", "thousands") == [
        ("JR東日本", "", 158616), ("東京地下鉄", "丸ノ内線", 35391)]
    assert rows(usage.english_names(table)) == [("東京", "Tokyo")]


def test_usage_needs_every_table_that_lists_a_station(spark):
    fields = ["Fiscal year", "駅", "乗車人員・総数"]
    datasets = spark.createDataFrame(
        [("one", fields), ("two", fields), ("bad", ["Fiscal year", "Stop"]), ("late", fields)],
        "dataset_id string, fields array<string>")
    records = spark.createDataFrame(
        [("one", 1, dict(zip(fields, ["2023", "A", "10"]))), ("two", 1, dict(zip(fields, ["2023", "A", "5"]))),
         ("one", 2, dict(zip(fields, ["2023", "B", "7"]))), ("two", 2, dict(zip(fields, ["2023", "C", "9"])))],
        "dataset_id string, row_no long, rec map<string,string>")
    table = usage.yearbook_rows(records, datasets)
    states = usage.table_states(datasets, table)
    assert rows(states) == [("bad", "unreadable", None), ("late", "no year", None), ("one", "read", 2023), ("two", "read", 2023)]
    site = spark.createDataFrame([(s.lower(), s) for s in "ABCD"], "site_id string, name string")
    members = usage.table_members(table)
    before = members.unionByName(spark.createDataFrame(
        [("B", "bad"), ("C", "late"), ("C", "gone"), ("D", "bad")], "station string, table_name string"))
    got = rows(usage.checked_usage(site, table, before, states), "site_id", "status", "count", "lower_bound", "missing")
    per_day = [round(n * 1000 / 366) for n in (15, 7, 9)]
    assert got == [
        ("a", "complete", per_day[0], per_day[0], []), ("b", "incomplete", None, per_day[1], ["bad"]),
        ("c", "incomplete", None, per_day[2], ["gone", "late"]), ("d", "incomplete", None, 0, ["bad"])]
    # A table that cannot be read and is expected of nobody may list anybody.
    got = rows(usage.checked_usage(site, table, members, states), "site_id", "status", "count")
    assert got == [(s, "incomplete", None) for s in "abcd"]
    good = datasets.where("dataset_id IN ('one', 'two')")
    got = rows(usage.checked_usage(site, table, members, usage.table_states(good, table)), "site_id", "count")
    assert got == [("a", per_day[0]), ("b", per_day[1]), ("c", per_day[2]), ("d", None)]


def test_site_master(spark):
    rail = spark.createDataFrame(
        [
            (0, "上野", "東日本旅客鉄道", "山手線", "g1", [[139.0, 35.0], [139.2, 35.2]]),
            (1, "上野", "東日本旅客鉄道", "東北線", "g1", [[139.3, 35.3]]),
            (2, "上野", "東京地下鉄", "2号線日比谷線", "g1", [[0.0, 0.0]]),
            (3, "京成上野", "京成電鉄", "京成本線", "g1", [[0.0, 0.0]]),
            (4, "赤羽", "東日本旅客鉄道", "山手線", "g2", [[0.0, 0.0]]),
        ], "pos long, station string, operator string, line string, group_code string, "
           "vertices array<array<double>>")
    names = spark.createDataFrame([(0, "上野"), (1, "幻")], "pos int, name string")
    english = spark.createDataFrame([("上野", "Ueno")], "station string, station_en string")
    own = sites.own_stations(names, rail, "東日本旅客鉄道")
    assert rows(sites.site_master(names, rail, "東日本旅客鉄道", english)) == [
        (0, "ueno", "上野", "Ueno", 35.2, 139.2)]
    lines = sorted(rows(sites.site_lines(own, rail)), key=lambda r: r[2])
    assert [r[1] for r in lines] == ["JR山手線", "JR東北線", "東京メトロ日比谷線", "京成電鉄京成本線"]
    assert rows(sites.unresolved(names, own, english)) == [
        ("幻", "no english name"), ("幻", "no station")]


def test_counts_measure_a_small_share_of_the_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    px, py, sx, sy = (rng.uniform(0, 3000, n) for n in (20_000, 20_000, 500, 500))
    px[:300], py[:300] = sx[:300] + 600, sy[:300] + 800  # on the rim, up to rounding
    kind, n = rng.integers(0, 3, len(px)), rng.integers(1, 9, len(px))
    within = np.sqrt((sx[:, None] - px) ** 2 + (sy[:, None] - py) ** 2) <= 1000.0
    wanted = np.stack([np.where(within & (kind == k), n, 0).sum(axis=1) for k in range(3)], axis=1)
    measured, shares = [], radius._shares

    def counting(ends):
        measured.append(int(ends[-1]) if len(ends) else 0)
        return shares(ends)

    monkeypatch.setattr(radius, "_shares", counting)
    monkeypatch.setattr(radius, "MEASURED", 1000)
    found = radius.disc_sums(px, py, kind, n, 3, sx, sy, 1000.0)
    assert (found == wanted).all()
    assert sum(measured) < within.sum() / 10
    # Odd cases: nothing on one side, a radius of nothing, all points in one spot.
    assert radius.disc_sums(px[:0], py[:0], kind[:0], n[:0], 3, sx, sy, 1.0).sum() == 0
    assert radius.disc_sums(px, py, kind, n, 3, sx[:0], sy[:0], 1.0).shape == (0, 3)
    spot = np.zeros(3)
    assert radius.disc_sums(spot, spot, kind[:3] * 0, n[:3], 1, spot[:1], spot[:1], 0.0)[0, 0] == n[:3].sum()


def test_counts_of_odd_rows(spark):
    places = "site_id string, lat double, lng double"
    site = spark.createDataFrame(
        [("a", 35.6, 139.7), ("a", 35.6, 139.7), (None, 35.6, 139.7), ("none", None, 139.7), ("nan", float("nan"), 139.7)],
        places,
    )
    facs = spark.createDataFrame(
        [("park", 35.6, 139.7), ("park", 35.6, 139.7), (None, 35.6, 139.7), ("other", 35.6, 139.7), ("park", None, 1.0),
         ("park", float("nan"), 139.7)],
        "feature string, lat double, lng double",
    )
    for hot in (None, 1):
        assert rows(radius.radius_counts(site, facs, 500.0, ["park"], hot)) == sorted(
            [("a", "park", 4), (None, "park", 2), ("none", "park", 0), ("nan", "park", 0)], key=repr
        )
