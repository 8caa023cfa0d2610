"""Encodings, blank rows, headers, GeoJSON, row numbers."""

import hashlib
import json

from plain_rows import rows

from placegauge.operators import facilities, roles
from placegauge.sources import files, tables


def land(folder, name, data):
    path = folder / "park" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return path


CSV = '名称, 緯度 ,経度,備考\r\n中央公園,35.70,139.70,"一行目\n二行目, 続き"\r\n ,,,\r\n緑公園,,,"引用""符"\r\n'


def test_csv_in_every_encoding(spark, tmp_path):
    bodies = {
        "plain": CSV.encode("utf-8"),
        "marked": b"\xef\xbb\xbf" + CSV.encode("utf-8"),
        "sjis": CSV.encode("cp932"),
        "wide": CSV.encode("utf-16"),
    }
    for name, body in bodies.items():
        land(tmp_path, f"{name}.csv", body)
    land(tmp_path, "other.pdf", b"%PDF")
    landed = files.landed(spark, str(tmp_path))
    datasets, records = files.read_tables(spark, files.readable(landed))
    fields = {r["dataset_id"]: r["fields"] for r in datasets.collect()}
    assert set(fields) == set(bodies)
    got = {}
    for r in records.collect():
        got.setdefault(r["dataset_id"], []).append((r["row_no"], r["rec"]))
    expected = [
        (1, {"名称": "中央公園", "緯度": "35.70", "経度": "139.70", "備考": "一行目\n二行目, 続き"}),
        (2, {"名称": "緑公園", "緯度": "", "経度": "", "備考": '引用"符'}),
    ]
    for name in bodies:
        assert fields[name] == ["名称", "緯度", "経度", "備考"], name
        assert sorted(got[name], key=lambda x: x[0]) == expected, name


def test_rows_longer_than_header_and_repeated_headers(spark, tmp_path):
    land(tmp_path, "a.csv", "name,x,x\nA,1,2,3\n,,,9\nB,,4\n".encode())
    land(tmp_path, "b.csv", "name,y\nC,5\n".encode())
    datasets, records = files.read_tables(spark, files.landed(spark, str(tmp_path)))
    got = {(r["dataset_id"], r["row_no"]): r["rec"] for r in records.collect()}
    assert got == {
        ("a", 1): {"name": "A", "x": "2"},
        ("a", 2): {"name": "B", "x": "4"},
        ("b", 1): {"name": "C", "y": "5"},
    }


def test_geojson(spark, tmp_path):
    doc = {
        "type": "FeatureCollection",
        "features": [
            {
                "properties": {" 名称 ": " A ", "緯度": "0", "n": None},
                "geometry": {"type": "Point", "coordinates": [139.7, 35.7, 1]},
            },
            {"properties": {"名称": "", "x": ""}, "geometry": None},
            {
                "properties": {"名称": "B", "x": 3},
                "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]},
            },
        ],
    }
    land(tmp_path, "g.geojson", json.dumps(doc, ensure_ascii=False).encode())
    land(tmp_path, "broken.json", b"{nope")
    land(tmp_path, "c.csv", b"name\nx\n")
    datasets, records = files.read_tables(spark, files.landed(spark, str(tmp_path)))
    fields = {r["dataset_id"]: r["fields"] for r in datasets.collect()}
    assert fields["g"] == ["名称", "緯度", "n", "経度", "x"]
    assert "broken" not in fields
    got = {r["row_no"]: r["rec"] for r in records.where("dataset_id = 'g'").collect()}
    assert got == {
        1: {"名称": "A", "緯度": "35.7", "経度": "139.7", "n": ""},
        2: {"名称": "B", "x": "3"},
    }


def test_one_bad_file_among_good_ones(spark, tmp_path):
    land(tmp_path, "good.csv", "name,y\n公園,1\n".encode())
    land(tmp_path, "sjis.csv", "name,y\n公園,1\n".encode("cp932"))
    land(tmp_path, "bad.csv", b"name,y\n\x81\x20,1\n")
    land(tmp_path, "empty.csv", b"\r\n , \r\n")
    land(tmp_path, "cut.geojson", b'{"features": [')
    land(tmp_path, "bad.json", b'{"features": "\x81\x20"}')
    land(tmp_path, "none.json", b"[]")
    landed = files.readable(files.landed(spark, str(tmp_path)))
    assert rows(files.file_errors(landed)) == [
        ("bad", files.UNDECODABLE), ("bad", files.UNDECODABLE), ("cut", files.NO_FEATURES),
        ("empty", files.NO_HEADER), ("none", files.NO_FEATURES)]
    datasets, records = files.read_tables(spark, landed)
    assert rows(datasets, "dataset_id") == [("good",), ("sjis",)]
    assert rows(records.selectExpr("dataset_id", "row_no", "rec['name']")) == [
        ("good", 1, "公園"), ("sjis", 1, "公園")]
    entries = spark.createDataFrame(
        [(d, "csv") for d in ("good", "sjis", "empty", "lost")], "dataset_id string, format string")
    failed = facilities.unreadable(entries, roles.role_table(datasets), files.file_errors(landed))
    assert rows(failed, "dataset_id", "error") == [
        ("empty", files.NO_HEADER), ("lost", "name column not found")]


def test_many_rows_of_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ROW_BATCH", 7)
    land(tmp_path, "long.csv", ("name,v\n" + "".join(f"n{k},{k}\n" for k in range(100))).encode())
    _, records = files.read_tables(spark, files.landed(spark, str(tmp_path)))
    got = {r.row_no: r.rec for r in records.collect()}
    assert got == {k + 1: {"name": f"n{k}", "v": str(k)} for k in range(100)}


def test_landing_log(spark, tmp_path):
    body = b"a,b\n1,2\n"
    land(tmp_path, "d.csv", body)
    (row,) = files.landing_log(files.landed(spark, str(tmp_path))).collect()
    assert (row["dataset_id"], row["bytes"], row["encoding"]) == ("d", len(body), "utf-8")
    assert row["sha256"] == hashlib.sha256(body).hexdigest()


def test_rail_stations(spark, tmp_path):
    doc = {
        "features": [
            {
                "properties": {
                    "N02_003": "2号線日比谷線", "N02_004": "東京地下鉄", "N02_005": "上野",
                    "N02_005g": "003",
                },
                "geometry": {"type": "LineString", "coordinates": [[139.7, 35.7], [139.8, 35.8]]},
            }
        ]
    }
    path = tmp_path / "rail.geojson"
    path.write_text(json.dumps(doc, ensure_ascii=False), encoding="utf-8")
    (row,) = files.rail_stations(spark, str(path)).collect()
    assert (row["pos"], row["station"], row["group_code"]) == (0, "上野", "003")
    assert row["vertices"] == [[139.7, 35.7], [139.8, 35.8]]


def test_packages_and_feature_tables(spark, tmp_path):
    package = {
        "id": "1", "name": "p", "title": "公園一覧", "organization": {"title": "港区"},
        "tags": [{"name": "t"}], "extras": [{"key": "更新頻度", "value": "年"}],
        "resources": [{"id": "r", "format": "CSV", "url": "u", "datastore_active": True}],
    }
    path = tmp_path / "packages.json"
    path.write_text(json.dumps(package, ensure_ascii=False) + "\n", encoding="utf-8")
    (row,) = tables.packages(spark, str(path), "https://example.org/dataset/").collect()
    assert row["organization"] == "港区" and row["tags"] == ["t"]
    assert row["update_frequency"] == "年" and row["source_url"].endswith("/dataset/p")

    target = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1), ("b", 2)], "feature string, v int")
    tables.write_feature_table(first, target)
    tables.write_feature_table(first.where("feature = 'a'").selectExpr("feature", "v + 9 v"), target)
    assert rows(tables.read_feature_table(spark, target), "feature", "v") == [("a", 10), ("b", 2)]
    assert rows(tables.read_feature_table(spark, target, ["b"]), "v") == [(2,)]


def test_fill_rates_of_files(spark, tmp_path):
    lines = ["名称,緯度,経度,所在地"] + [f"n{i},35.7,139.7," for i in range(40)]
    lines += [f"n{i},,,港区" for i in range(20)]
    land(tmp_path, "d.csv", "\n".join(lines).encode())
    datasets, records = files.read_tables(spark, files.landed(spark, str(tmp_path)))
    table = roles.role_table(datasets)
    (row,) = roles.fill_rates(records, table, datasets).collect()
    assert (row["sample_size"], row["total"]) == (60, 60)
    assert (row["coord_fill"], row["address_fill"]) == (0.667, 0.333)
