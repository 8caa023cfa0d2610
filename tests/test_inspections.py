"""Inspections that are kept and used again by the digest of what was read."""

from plain_rows import rows
from pyspark.sql import functions as F
from test_selection import PACKAGE, package, res

from placegauge.operators import inspections, manifest
from placegauge.plans import jobs
from placegauge.sources import files

BODY = "名称,緯度,経度\nA公園,35.7,139.7\nB公園,,\n"
NAMES = ("plain", "公 園[1]", "star{a}")


def write(folder, name, body):
    (folder / f"{name}.csv").write_bytes(body.encode())


def log_of(spark, folder):
    return files.landing_log(files.landed(spark, str(folder)))


def test_only_changed_files_are_read_again(spark, tmp_path, monkeypatch):
    for name in NAMES:
        write(tmp_path, name, BODY)
    first = jobs.inspect_landed(spark, str(tmp_path), log_of(spark, tmp_path)).cache()
    want = [(name, 2, 0.5, False) for name in sorted(NAMES)]
    assert rows(first, "dataset_id", "total", "coord_fill", "has_address") == want

    # Kept values that the files do not say, so that reuse shows.
    kept = first.withColumn("total", F.lit(99).cast("bigint"))
    write(tmp_path, "公 園[1]", BODY + "C公園,35.8,139.8\n")
    write(tmp_path, "new", BODY)
    opened, scan = [], jobs.ranges.scan

    def seen(spark, paths):
        opened.extend(paths)
        return scan(spark, paths)

    monkeypatch.setattr(jobs.ranges, "scan", seen)
    second = jobs.inspect_landed(spark, str(tmp_path), log_of(spark, tmp_path), kept)
    assert rows(second, "dataset_id", "total") == sorted(
        [("plain", 99), ("star{a}", 99), ("公 園[1]", 3), ("new", 2)])
    assert sorted(path.split("/")[-1] for path in opened) == ["new.csv", "公 園[1].csv"]

    opened.clear()
    third = jobs.inspect_landed(spark, str(tmp_path), log_of(spark, tmp_path), second.cache())
    assert rows(third, "dataset_id", "total") == rows(second, "dataset_id", "total") and not opened


def test_digests(spark):
    log = spark.createDataFrame(
        [("a", "1"), ("b", "2"), ("b", "1"), ("c", None)], "dataset_id string, sha256 string")
    got = dict(rows(inspections.digests(log)))
    assert got["a"] == "1" and len(got["b"]) == 64 and set(got) == {"a", "b"}


def test_kept_twice_and_empty(spark):
    current = spark.createDataFrame([("a", "1"), ("b", "2")], "dataset_id string, sha256 string")
    one = ("a", "1", 2, 2, 0.5, None, False, ["名称"])
    kept = spark.createDataFrame([one, one, ("b", "old", 1, 1, None, None, False, [])], inspections.SCHEMA)
    assert rows(inspections.known(current, kept), "dataset_id", "total") == [("a", 2)]
    assert rows(inspections.changed(current, kept)) == [("b", "2")]
    none = spark.createDataFrame([], inspections.SCHEMA)
    assert inspections.known(current, none).count() == 0
    assert inspections.changed(current, none).count() == 2


def test_manifest_keeps_inspections(spark, tmp_path):
    write(tmp_path, "good", BODY)
    packages = spark.createDataFrame(
        [package("good", "公園一覧", [res("r", url="https://example.org/good.csv")]),
         package("plan", "公園計画", [res("r")])],
        PACKAGE,
    )
    log, now = log_of(spark, tmp_path), F.lit("2026-01-01").cast("timestamp")
    first = jobs.discover(packages, jobs.inspect_landed(spark, str(tmp_path), log), now)
    kept = inspections.of_manifest(first)
    assert rows(kept, "dataset_id", "total", "coord_fill") == [("good", 2, 0.5)]
    assert kept.columns[1:] == list(inspections.FOUND)
    again = jobs.inspect_landed(spark, str(tmp_path), log, kept.withColumn("total", F.lit(99)))
    second = jobs.discover(packages, again, now, existing=first)
    assert rows(inspections.of_manifest(second), "dataset_id", "total") == [("good", 99)]
    assert rows(
        manifest.feature_totals(second.where("feature = 'park'"), ["park", "museum"]),
        "feature", "candidates", "inspected") == [("museum", 0, 0), ("park", 2, 1)]
