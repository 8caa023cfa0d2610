"""Catalog evidence, verdicts, duplicates, overrides, judgements, filters."""

import hashlib
import json
import random

import pytest
from plain_rows import rows
from pyspark.sql import functions as F

from placegauge.operators import catalog, facilities, judgements, manifest, quality, roles, usage
from placegauge.plans.checks.catalog import RESOURCE

PACKAGE = (
    "id string, name string, title string, notes string, organization string, license_id string, "
    "license_title string, metadata_modified string, tags array<string>, update_frequency string, "
    f"source_url string, resources {RESOURCE}"
)


def res(rid, fmt="CSV", name="x", url="u", active=False, modified=None):
    return (rid, name, fmt, url, active, modified, None)


def package(pid, title, resources, notes="", tags=(), modified="2025-06-01T00:00:00"):
    return (pid, pid, title, notes, "港区", "cc-by-4.0", None, modified, list(tags), None,
            f"https://example.org/{pid}", resources)


def entries(spark, packages, inspected):
    rows_ = catalog.with_semantics(catalog.with_best_resource(
        catalog.candidates(spark.createDataFrame(packages, PACKAGE))))
    found = spark.createDataFrame(
        inspected, "feature string, dataset_id string, coord_fill double, address_fill double, "
        "has_address boolean")
    now = F.lit("2026-01-01").cast("timestamp")
    out = catalog.evaluate(rows_, found, now)
    return {(r["feature"], r["dataset_id"]): r for r in out.collect()}


def test_verdicts(spark):
    got = entries(
        spark,
        [
            package("good", "公園一覧", [res("r")]),
            package("addresses", "公園一覧", [res("r")]),
            package("sparse", "公園一覧", [res("r")]),
            package("unseen", "公園一覧", [res("r")]),
            package("pdf", "公園一覧", [res("r", "PDF")]),
            package("plan", "公園整備計画", [res("r")]),
            package("notes", "区の施設", [res("r")], notes="公園の位置"),
            package("file", "区の施設", [res("r", name="図書館")]),
        ],
        [
            ("park", "good", 0.9, None, False), ("park", "addresses", 0.1, 0.95, True),
            ("park", "sparse", 0.4, 0.2, True), ("library", "file", 0.0, 0.5, True),
        ],
    )
    status = {k[1]: r["status"] for k, r in got.items()}
    assert status == {
        "good": "accepted", "addresses": "accepted", "sparse": "review", "unseen": "review",
        "pdf": "rejected", "plan": "rejected", "notes": "review", "file": "review",
    }
    signal = {k[1]: (r["semantic"], r["location"], r["location_source"]) for k, r in got.items()}
    assert signal["good"] == (1.0, 1.0, "source")
    assert signal["addresses"] == (1.0, 0.8, "geocode")
    assert signal["sparse"] == (1.0, 0.5, "source")
    assert signal["unseen"] == (1.0, None, None)
    assert signal["notes"] == (0.4, None, None)
    assert signal["file"] == (0.7, 0.4, "geocode")
    assert got[("library", "file")]["row_filter"] and not got[("park", "good")]["row_filter"]
    # .35 + .15*.8 + .3 + .1 + .1
    assert got[("park", "good")]["confidence"] == 0.97
    assert got[("park", "pdf")]["reason"].startswith("タイトルに「公園」「一覧」を含む。機械可読な")


@pytest.mark.parametrize(
    "resources, best",
    [
        ([res("a"), res("b", "GeoJSON")], "b"),
        ([res("a", "GeoJSON"), res("b", active=True)], "b"),
        ([res("a", active=True), res("b", "xls", name="公園")], "b"),
        ([res("a", modified="2020"), res("b", modified="2021")], "b"),
        ([res("a"), res("b")], "a"),
        ([res("a", "PDF"), res("b", url=None)], None),
        ([], None),
    ],
)
def test_best_resource(spark, resources, best):
    df = spark.createDataFrame([package("p", "公園", resources)], PACKAGE)
    (row,) = catalog.with_best_resource(catalog.candidates(df)).collect()
    assert (row["resource"]["id"] if row["resource"] else None) == best


ENTRY = ("feature string, dataset_id string, name string, organization string, resource_url string, "
         "status string, auto_status string, reason string, confidence double, source_url string")


def entry(did, confidence, status="accepted", name="公園 一覧", url=None, org="港区", feature="park"):
    return (feature, did, name, org, url, status, status, "r", confidence, "https://example.org")


def plain_duplicates(data):
    """One pass in order, remembering the first entry of every key."""
    seen, out = {}, {}
    for e in sorted(data, key=lambda e: (-e[8], e[1])):
        keys = [("title", e[3] or "", "".join(e[2].split()))]
        if e[4]:
            keys.append(("url", e[4]))
        original = next((seen[k] for k in keys if k in seen), None)
        out[e[1]] = original if e[5] != "rejected" else None
        for k in keys:
            seen.setdefault(k, e[1])
    return out


def test_duplicates(spark):
    import random

    rng = random.Random(2)
    data = [
        entry(f"d{i}", rng.randrange(4) / 4, rng.choice(["accepted", "review", "rejected"]),
              rng.choice(["公園　一覧", "公園一覧", "緑地", "x"]), rng.choice([None, "u1", "u2", ""]),
              rng.choice(["港区", None]))
        for i in range(60)
    ]
    marked = manifest.mark_duplicates(spark.createDataFrame(data, ENTRY))
    want = plain_duplicates(data)
    for r in marked.collect():
        assert r["duplicate_of"] == want[r["dataset_id"]]
        if r["duplicate_of"]:
            assert r["status"] != "accepted"
    first = manifest.mark_duplicates(spark.createDataFrame(
        [entry("a", 0.9), entry("b", 0.8)], ENTRY)).where("dataset_id = 'b'").first()
    assert (first["status"], first["auto_status"]) == ("review", "review")
    assert first["reason"] == "r。a と重複の可能性"


def test_overrides_and_merge(spark):
    data = spark.createDataFrame(
        [entry("a", 1.0, "review"), entry("a", 1.0, "review", feature="culture"),
         entry("b", 1.0, "accepted")], ENTRY)
    orders = spark.createDataFrame(
        [("park", "a", "accepted", "ok"), (None, "a", "rejected", None)],
        "feature string, dataset_id string, status string, note string")
    out = manifest.apply_overrides(data, orders)
    assert rows(out, "feature", "dataset_id", "status", "auto_status", "review.note") == [
        ("culture", "a", "rejected", "review", ""), ("park", "a", "accepted", "review", "ok"),
        ("park", "b", "accepted", "accepted", None)]
    bad = spark.createDataFrame([(None, "z", "maybe", None)],
                                "feature string, dataset_id string, status string, note string")
    assert manifest.invalid_overrides(bad).count() == 1
    new = spark.createDataFrame([entry("c", 1.0, "rejected")], ENTRY)
    merged = manifest.replace_features(data, new, ["park"])
    emptied = manifest.replace_features(data, new, ["park", "culture"])
    assert rows(emptied, "feature", "dataset_id") == [("park", "c")]
    assert rows(merged, "feature", "dataset_id") == [("culture", "a"), ("park", "c")]
    assert rows(manifest.status_counts(merged)) == [("culture", 1, 0, 1, 0), ("park", 1, 0, 0, 1)]
    twice = quality.manifest_violations(data.unionByName(data.where("feature = 'culture'")))
    assert ("duplicate entry", "culture/a") in rows(twice)
    assert ("accepted without resource", "park/b") in rows(twice)


def test_classifier_verdicts(spark):
    cases = {  # category, confidence, list score, location -> status, row filter
        "take": (("park", 0.9, 0.5, 0.9), ("accepted", False)),
        "mixed": (("mixed", 0.9, 0.5, 0.9), ("accepted", True)),
        "nowhere": (("park", 0.9, 0.5, 0.5), ("review", False)),
        "other": (("none", 0.9, 0.9, 0.9), ("rejected", False)),
        "nolist": (("park", 0.9, 0.2, 0.9), ("rejected", False)),
        "between": (("park", 0.9, 0.4, 0.9), ("review", False)),
        "unsure": (("none", 0.6, 0.1, 0.9), ("review", False)),
    }
    data = spark.createDataFrame(
        [("park", k, "review", "review", v[0][3], False) for k, v in cases.items()]
        + [("park", "done", "accepted", "accepted", 1.0, False),
           ("park", "unjudged", "review", "review", 1.0, False)],
        "feature string, dataset_id string, status string, auto_status string, location double, "
        "row_filter boolean")
    judged = spark.createDataFrame(
        [("park", k, *v[0][:3]) for k, v in cases.items()] + [("park", "done", "none", 1.0, 0.0)],
        "feature string, dataset_id string, category string, confidence double, list_score double")
    out = {r["dataset_id"]: (r["status"], r["row_filter"])
           for r in judgements.apply_dataset_judgements(data, judged).collect()}
    assert out == {**{k: v[1] for k, v in cases.items()}, "done": ("accepted", False),
                   "unjudged": ("review", False)}


def test_reasons_tell_what_the_classifier_said(spark):
    data = spark.createDataFrame(
        [("park", k, "review", "review", loc, False, "規則") for k, loc in
         [("take", 0.9), ("nowhere", 0.5), ("other", 0.9), ("between", 0.9), ("failed", 0.9), ("unasked", 0.9)]]
        + [("park", "done", "accepted", "accepted", 1.0, False, "規則")],
        "feature string, dataset_id string, status string, auto_status string, location double, row_filter boolean, "
        "reason string")
    judged = spark.createDataFrame(
        [("park", "take", "mixed", 0.905, 0.5, "m", None), ("park", "nowhere", "park", 0.9, 0.5, "m", None),
         ("park", "other", "none", 0.9, None, "m", None), ("park", "between", "park", 0.9, 0.4, None, None),
         ("park", "failed", None, None, None, "m", "timeout"), ("park", "done", "none", 1.0, 0.0, "m", None)],
        "feature string, dataset_id string, category string, confidence double, list_score double, classifier string, "
        "error string")
    got = {r["dataset_id"]: r for r in judgements.apply_dataset_judgements(data, judged).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        "take": "規則。m: mixed（確信度 0.91、一覧 0.50） → 採用",
        "nowhere": "規則。m: park（確信度 0.90、一覧 0.50）。位置情報が不足のため要確認のまま",
        "other": "規則。m: none（確信度 0.90、一覧 0.00） → 不採用",
        "between": "規則。classifier: park（確信度 0.90、一覧 0.40）。判断が分かれるため要確認のまま",
        "failed": "規則。m 失敗: timeout", "unasked": "規則", "done": "規則"}
    assert {k for k, r in got.items() if r["semantic"]} == {"take", "nowhere", "other", "between", "failed"}
    assert got["failed"]["status"] == "review" and got["take"]["semantic"]["category"] == "mixed"


def test_judgement_key_is_canonical_json(spark):
    questions = {"category": {"criteria": {"a": "公園", "b": "x"}, "type": "choice"}}
    state = '施設名: "中央"\n種別: \\公園/\t緑'
    want = hashlib.sha256(json.dumps(
        {"state": state, "questions": questions}, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    asked = json.dumps(questions, ensure_ascii=False, sort_keys=True)
    df = spark.createDataFrame([(state, asked)], "s string, q string")
    assert rows(df.select(judgements.judgement_key(F.col("s"), F.col("q")))) == [(want,)]


FACILITY = ("facility_id string, feature string, dataset_id string, name string, "
            "categories array<string>, row_filter boolean")


def test_row_filters(spark):
    data = [
        ("1", "publicFacility", "d", "中央図書館", [], False),      # counted elsewhere
        ("2", "publicFacility", "d", "神田公園出張所", [], False),  # only named after a park
        ("3", "publicFacility", "d", "備蓄倉庫", [], False),
        ("4", "publicFacility", "d", "小学校", [], False),          # no include word
        ("5", "culture", "m", "能楽", ["無形文化財"], True),
        ("6", "culture", "m", "本堂", ["文化財（建造物）"], True),
        ("7", "culture", "m", "本堂", [], True),                    # mixed list, no keyword
        ("8", "park", "d", "なかよし広場", [], False),
    ]
    marked = facilities.mark_excluded(spark.createDataFrame(data, FACILITY))
    assert [r[0] for r in rows(facilities.select_rows(marked), "facility_id")] == ["2", "6", "8"]
    judged = spark.createDataFrame(
        [("5", "culture", 1.0), ("6", "none", 0.9), ("7", "culture", 0.6)],
        "facility_id string, category string, confidence double")
    assert rows(facilities.select_rows(marked, judged), "facility_id", "classified_by") == [
        ("2", "rule"), ("7", "judgement"), ("8", "rule")]
    # one row without an answer: the rules decide for the whole dataset
    assert rows(facilities.select_rows(marked, judged.where("facility_id <> '7'")),
                "facility_id", "classified_by") == [("2", "rule"), ("6", "rule"), ("8", "rule")]


def test_report_states(spark):
    entry_schema = ("feature string, dataset_id string, organization string, row_filter boolean, "
                    "error string")
    datasets = [("park", d, "港区", d == "none", "x" if d == "failed" else None)
                for d in ("ok", "degraded", "scope", "none", "empty", "failed", "outside")]
    schema = ("feature string, dataset_id string, coord_source string, precision string, "
              "unlocated_reason string")

    def row(d, source=None, reason=None, precision=None):
        return ("park", d, source, precision, reason)

    located = spark.createDataFrame(
        [row("ok", "source"), row("ok", "geocode", precision="partial"), row("ok", None, "no-address"),
         row("degraded", "source"), *[row("degraded", None, "geocode-not-found")] * 2,
         row("scope", None, "out-of-geocode-scope"),
         row("outside", None, "outside-tokyo"), row("outside", "source")], schema)
    read = located.unionByName(spark.createDataFrame([row("none"), row("ok")], schema))
    out = facilities.ingest_report(spark.createDataFrame(datasets, entry_schema), read, located)
    got = {r["dataset_id"]: r for r in out.collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "ok": "ok", "degraded": "degraded", "scope": "out-of-scope", "none": "no-matching-rows",
        "empty": "ok", "failed": "failed", "outside": "ok"}
    ok = got["ok"]
    assert (ok["rows"], ok["excluded"], ok["with_source"], ok["geocoded"], ok["geocoded_partial"],
            ok["unlocated"]) == (3, 1, 1, 1, 1, 1)
    assert got["scope"]["unlocated"] == 1 and got["outside"]["unlocated"] == 0
    assert got["failed"]["rows"] is None and got["failed"]["error"] == "x"


def test_descriptors_and_public_fields(spark):
    data = spark.createDataFrame(
        [("park", "d", "n", "o", [f"f{k}" for k in range(30)], ["_id", "name", "_rank", "x_y"])],
        "feature string, dataset_id string, name string, organization string, files array<string>, "
        "fields array<string>")
    whole = judgements.dataset_descriptors(data).first()
    assert len(whole.files) == 30 and whole.fields == ["_id", "name", "_rank", "x_y"]
    some = judgements.dataset_descriptors(data, files=2, fields=1).first()
    assert some.files == ["f0", "f1"] and some.fields == ["_id"]
    assert roles.public_fields(data).first().fields == ["name", "x_y"]


def test_same_survivor_whatever_the_order(spark):
    asked = [("k", "park", str(n)) for n in range(20)] + [("known", "park", "1")]
    store = spark.createDataFrame([("known", "yes")], "key string, answer string")
    found = set()
    for seed in range(3):
        random.Random(seed).shuffle(asked)
        answered, left = judgements.split_by_store(
            spark.createDataFrame(asked, "key string, feature string, dataset_id string"), store)
        assert rows(answered, "key", "answer") == [("known", "yes")]
        found |= set(rows(left))
    assert found == {("k", "park", "0")}


def test_yearbook_table_with_other_columns_is_named(spark):
    data = spark.createDataFrame(
        [("good", ["Fiscal year", "駅", "乗車人員 総数"]), ("bad", ["Fiscal year", "Stop", "乗車人員 総数"])],
        "dataset_id string, fields array<string>")
    assert rows(usage.table_problems(data)) == [("no station", "bad")]


def test_searched_texts_are_made_once_a_row(spark):
    package = spark.createDataFrame(
        [("1", "pkg-1", "公園の一覧", "港区の公園", "港区", None, None, None, ["公園"], None, "https://example.org/1",
          [("1-0", "公園0", "csv", "https://example.org/1/0", False, None, None)])],
        "id string, name string, title string, notes string, organization string, license_id string, "
        "license_title string, metadata_modified string, tags array<string>, update_frequency string, "
        "source_url string, resources array<struct<id string, name string, format string, url string, "
        "datastore_active boolean, last_modified string, metadata_modified string>>",
    )
    # However many keywords are looked for, the plan puts a text together in one place.
    found = catalog.with_semantics(catalog.candidates(package.repartition(2)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws(") == 2
    assert [(r.feature, r.title_hits, r.other_hits) for r in found.where("feature = 'park'").collect()] == [
        ("park", ["公園"], ["公園"])]
