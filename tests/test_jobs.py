"""The jobs one after the other on a small catalog with landed files."""

from dataclasses import replace

import pytest
from plain_rows import rows
from pyspark.sql import functions as F
from test_selection import PACKAGE, package, res

from placegauge.operators import explore, quality
from placegauge.plans import jobs
from placegauge.sources import files, tables


def square(west, east):
    corners = [(west, 35.0), (east, 35.0), (east, 36.0), (west, 36.0), (west, 35.0)]
    return [{"lng": x, "lat": y} for x, y in corners]


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    (folder / "park").mkdir()
    body = "名称,緯度,経度,所在地\n"
    body += "A公園,35.7000,139.7000,\nA 公園,35.7001,139.7000,\nB公園,35.7010,139.7010,\n"
    body += "C公園,,,港区赤坂一丁目1-1\nD公園,,,長野県x\nトイレ横公園,35.7,139.7,\n"
    (folder / "park" / "good.csv").write_bytes(body.encode("cp932"))
    (folder / "park" / "odd.csv").write_bytes("番号,値\n1,2\n".encode())
    return str(folder)


@pytest.fixture(scope="module")
def manifest_table(spark, landed):
    packages = spark.createDataFrame(
        [
            package("good", "公園一覧", [res("r", url="https://example.org/good.csv")]),
            package("odd", "公園リスト", [res("r", url="https://example.org/odd.csv")]),
            package("plan", "公園計画", [res("r")]),
        ],
        PACKAGE,
    )
    orders = spark.createDataFrame(
        [("park", "odd", "accepted", "checked by hand")],
        "feature string, dataset_id string, status string, note string",
    )
    return jobs.discover(
        packages, jobs.inspect_landed(spark, landed), F.lit("2026-01-01").cast("timestamp"), orders
    )


def test_discover(manifest_table):
    assert rows(manifest_table, "dataset_id", "status", "auto_status") == [
        ("good", "accepted", "accepted"), ("odd", "accepted", "review"),
        ("plan", "rejected", "rejected")]


def test_all_jobs(spark, landed, manifest_table, tmp_path):
    accepted = manifest_table
    datasets, records = files.read_tables(spark, files.landed(spark, landed))
    answers = spark.createDataFrame(
        [("東京都港区赤坂一丁目1-1", 0, "東京都港区", 35.6, 139.7),
         ("東京都港区赤坂一丁目1-1", 1, "東京都港区赤坂一丁目", 35.7005, 139.7005)],
        "query string, pos int, title string, lat double, lng double")
    landed_files = files.landed(spark, landed)
    got = jobs.ingest(
        datasets, records, accepted, answers, ["港区"], file_errors=files.file_errors(landed_files),
        log=files.landing_log(landed_files))
    report = {r["dataset_id"]: r for r in got.report.collect()}
    assert report["odd"]["status"] == "failed" and report["odd"]["error"] == "name column not found"
    good = report["good"]
    assert good["encoding"] == "cp932" and len(good["sha256"]) == 64 and good["retrieved_at"] and good["resource_url"]
    assert (good["status"], good["rows"], good["with_source"], good["geocoded"], good["outside"],
            good["unlocated"]) == ("ok", 6, 4, 1, 1, 0)
    assert rows(got.absorbed) == [("park", "good:2", "good:1")]
    (totals,) = got.totals.collect()
    assert (totals["rows"], totals["facilities"], totals["merged_duplicates"], totals["failed"]) == (
        6, 5, 1, 1)
    assert rows(got.reasons) == [("park", "outside-tokyo", 1)]

    sites = spark.createDataFrame(
        [(0, "a", "A", "A", 35.7, 139.7), (1, "b", "B", "B", 35.71, 139.7),
         (2, "c", "C", "C", 35.72, 139.7), (3, "d", "D", "D", 35.7, 139.95)],
        "pos int, site_id string, name string, name_en string, lat double, lng double")
    polygons = spark.createDataFrame(
        [("13103", "港区", square(139.6, 139.9)), ("12203", "(都外 12203)", square(139.9, 140.0))],
        "code string, name string, ring array<struct<lng: double, lat: double>>")
    settings = jobs.Settings(features=("park",))
    site_areas = jobs.touched_areas(sites, polygons, settings.radius_m)
    counted = jobs.aggregate(sites, got.facilities, got.report, site_areas, settings)
    assert rows(counted.aggregates, "site_id", "status", "count", "lower_bound") == [
        ("a", "complete", 4, 4), ("b", "complete", 0, 0), ("c", "complete", 0, 0),
        ("d", "incomplete", None, 0)]
    assert rows(counted.evidence, "site_id", "dataset_id") == [("a", "good"), ("b", "good"), ("c", "good")]

    base = sites.select(
        "site_id",
        F.explode(F.array(*[F.lit(f) for f in ("tourism", "culture", "publicFacility", "library")]))
        .alias("feature"), (F.col("pos") * 2).alias("raw"))
    fields = ["Fiscal year", "駅", "乗車人員 総数", "系統"]
    book = spark.createDataFrame([("t1", fields, 1)], "dataset_id string, fields array<string>, pos int")
    records = spark.createDataFrame(
        [("t1", i, dict(zip(fields, ["2023", n, str(1000 * (i + 1)), "本線"]))) for i, n in enumerate("ABC")],
        "dataset_id string, row_no long, rec map<string,string>")
    package = spark.createDataFrame(
        [("book", "年鑑", "統計局", "https://example.org/book", "cc-by", "2024")],
        "name string, title string, organization string, source_url string, license_id string, metadata_modified string")
    resources = spark.createDataFrame(
        [("book", 2, "r2", "駅別乗車人員 二", "u2", "CSV"), ("book", 1, "r1", "駅別乗車人員 一", "u1", "csv"),
         ("book", 0, "r0", "目次", "u0", "csv"), ("old", 0, "x", "駅別乗車人員", "ux", "csv")],
        "package string, pos int, id string, name string, url string, format string")
    with pytest.raises(quality.QualityError, match="no station"):
        jobs.ridership(sites, records, book.unionByName(spark.createDataFrame(
            [("t2", ["Fiscal year", "乗車人員 総数"], 2)], book.schema)), package, resources)
    usage = jobs.ridership(sites, records, book, package, resources)
    assert rows(usage.lines, "site_id", "line", "thousands") == [("a", "本線", 1000), ("b", "本線", 2000), ("c", "本線", 3000)]
    assert rows(usage.entry, "dataset_id", "resource_id", "resource_url") == [("book", "r1", "u1")]
    assert usage.entry.first()["reason"].endswith("駅別乗車人員 一・駅別乗車人員 二")
    assert rows(usage.sources, "site_id", "source_id", "kind") == [
        (s, "book", "statistics") for s in "abc"]
    assert rows(usage.usage, "site_id", "fiscal_year", "n_read") == [("a", 2023, 1), ("b", 2023, 1), ("c", 2023, 1), ("d", None, 0)]
    every = counted.aggregates.unionByName(usage.aggregates)
    others = every.select("site_id", "feature").unionByName(base.select("site_id", "feature")).select(
        "site_id", "feature", F.concat(F.lit("base-"), "feature").alias("source_id"), F.lit("base").alias("source_name"),
        F.lit(None).cast("string").alias("organization"), F.lit("https://example.org/base").alias("url"),
        F.lit("cc-by").alias("license"),
        F.when(F.col("feature") == "stationUsage", "statistics").otherwise("fixture").alias("kind"))
    with pytest.raises(quality.QualityError, match="value without source"):
        jobs.build(sites, every, counted.evidence, accepted, base, others.where("feature <> 'library'"))
    built = jobs.build(sites, every, counted.evidence, accepted, base, others)
    assert rows(built.sources.where("site_id = 'a'"), "feature", "kind") == [
        ("culture", "fixture"), ("library", "fixture"), ("park", "opendata"), ("publicFacility", "fixture"),
        ("stationUsage", "statistics"), ("tourism", "fixture")]
    table = {r["site_id"]: r for r in built.table.collect()}
    assert table["a"]["coverage"] == 1.0 and table["d"]["coverage"] == 0.7
    assert {r["rank"] for r in table.values()} == {1, 2, 3, 4}
    top = explore.top_sites(built.table.join(sites.select("site_id", "pos"), "site_id"), 1).first()
    assert table[top["site_id"]]["rank"] == 1

    folder = str(tmp_path)
    jobs.export(sites, built, counted, got, accepted, folder, usage)

    def published(name, features=None):
        return tables.current(spark, folder, name, features)

    assert published("evidence").count() == counted.pairs.count() > 0
    assert published("areas").count() > 0 and published("facilities").count() == got.facilities.count()
    assert published("lines").count() == 3 and published("usage").count() == 4
    assert {"sha256", "retrieved_at"} <= set(published("register").columns)
    (doc,) = published("documents").where("site_id = 'a'").collect()
    assert doc["raw"]["park"] == 4 and doc["ranking"]["of"] == 4
    assert published("scores").count() == 4
    assert rows(published("values").where("feature = 'park'"), "site_id", "raw") == [
        ("a", 4.0), ("b", 0.0), ("c", 0.0), ("d", None)]
    assert rows(published("register"), "dataset_id", "ingest.status") == [("good", "ok"), ("odd", "failed")]

    # A run whose tables break a rule publishes none of them.
    scores = rows(published("scores"))
    worse = replace(built, table=built.table.withColumn("score", F.lit(50.0)),
                    ranked=built.ranked.withColumn("percentile", F.lit(101.0)))
    with pytest.raises(quality.QualityError, match="values: percentile: out of range"):
        jobs.export(sites, worse, counted, got, accepted, folder, usage)
    short = replace(counted, pairs=counted.pairs.limit(1))
    with pytest.raises(quality.QualityError, match="count differs from its evidence"):
        jobs.export(sites, built, short, got, accepted, folder, usage)
    assert rows(published("scores")) == scores


def test_gates_stop_a_job(spark):
    polygons = spark.createDataFrame(
        [("13103", "港区", square(139.6, 139.7))], "code string, name string, ring array<struct<lng double, lat double>>")
    names = spark.createDataFrame([(0, "幻")], "pos int, name string")
    rail = spark.createDataFrame(
        [], "pos long, station string, operator string, line string, group_code string, "
            "vertices array<array<double>>")
    yearbook = spark.createDataFrame(
        [], "table_name string, row_no int, fiscal_year int, station string, station_en string, "
            "operator string, line string, thousands long")
    with pytest.raises(quality.QualityError, match="no station"):
        jobs.station_sites(names, rail, "x", yearbook, polygons)
    some = spark.createDataFrame([(0, "幻")], names.schema)
    track = spark.createDataFrame(
        [(5, "幻", "x", "幻線", "g", [[139.65, 35.5], [139.65, 35.5]]), (3, "幻", "都", "別線", "g", [[0.0, 0.0]])],
        rail.schema)
    spelt = spark.createDataFrame([("t", 1, 2023, "幻", "Maboroshi", "JR東日本", "", 5)], yearbook.schema)
    (site,) = jobs.station_sites(some, track, "x", spelt, polygons).collect()
    assert (site["site_id"], site["lines"], site["groups"], site["municipality"], site["area_municipalities"]) == (
        "maboroshi", ["都別線", "x幻線"], ["g"], "港区", ["港区"])


def test_search_and_sort(spark):
    sites = spark.createDataFrame(
        [(0, "ueno", "上野", "Ueno", 5.0), (1, "okachi", "御徒町", None, None),
         (2, "akiba", "秋葉原", "Akihabara", 9.0)],
        "pos int, site_id string, name string, name_en string, score double")
    assert [r["site_id"] for r in explore.search(sites, " UEN ").collect()] == ["ueno"]
    assert [r["site_id"] for r in explore.search(sites, "徒").collect()] == ["okachi"]
    assert explore.search(sites, "  ").count() == 3
    down = [r["site_id"] for r in explore.sort_sites(sites, "score", True).collect()]
    up = [r["site_id"] for r in explore.sort_sites(sites, "score", False).collect()]
    assert down == ["akiba", "ueno", "okachi"] and up == ["ueno", "akiba", "okachi"]
    named = [r["site_id"] for r in explore.sort_sites(sites, "name", False).collect()]
    assert named == ["akiba", "ueno", "okachi"]
