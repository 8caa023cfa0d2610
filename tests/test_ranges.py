"""Files cut into many blocks give the rows that whole files give."""

import csv
import io
import json
import random

import pytest
from plain_rows import rows

from placegauge.sources import files, ranges


def land(folder, name, data):
    path = folder / "park" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


@pytest.fixture(params=[37, 700])
def block_bytes(request, spark):
    """Blocks of so many bytes while a test runs."""
    if request.param:
        spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def both(spark, folder):
    landed = files.readable(files.landed(spark, str(folder)))
    datasets, records = files.read_tables(spark, landed)
    whole = rows(datasets), rows(records, "dataset_id", "row_no", "rec"), rows(files.file_errors(landed).distinct())
    found = ranges.scan(spark, str(folder))
    cut = rows(found.datasets), rows(found.records, "dataset_id", "row_no", "rec"), rows(found.errors)
    return whole, cut


CELLS = ["", " ", "a", 'q"q', "x,y", "two\nlines", "\r\n", "公園", "駅\n前", '"', '""', "a\rb", "  b ", "}", "{"]


def random_csv(seed, lines, width=3):
    pick = random.Random(seed)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=pick.choice(["\n", "\r\n"]))
    if seed % 2:
        out.write("\n ,,\n")
    writer.writerow([f"h{k % (width - seed % 2)}" for k in range(width)])
    for _ in range(lines):
        writer.writerow([pick.choice(CELLS) for _ in range(pick.choice([1, width - 1, width, width, width + 2]))])
    return out.getvalue()


def test_csv(spark, tmp_path, block_bytes):
    for seed in range(4):
        text = random_csv(seed, 60)
        land(tmp_path, f"u{seed}.csv", text.encode())
        land(tmp_path, f"s{seed}.CSV", text.encode("cp932"))
    land(tmp_path, "m.csv", b"\xef\xbb\xbf" + random_csv(5, 30).encode())
    land(tmp_path, "w.csv", random_csv(6, 30).encode("utf-16"))
    land(tmp_path, "big.csv", random_csv(7, 30).encode("utf-16-be").join([b"\xfe\xff", b""]))
    land(tmp_path, "open.csv", b'a,b\n1,"never closed\n2,3\n4,5\n' + b"6,7\n" * 40)
    land(tmp_path, "long.csv", ("a,b\n1,\"" + "line\n" * 300 + '"\n2,3\n').encode())
    land(tmp_path, "odd.csv", b'a,b\nx"y,"z"w"\n"p" "q,r\n"",s"\n')
    land(tmp_path, "head.csv", b'"name\nof it","b\n\n\nc"\n1,2\n')
    land(tmp_path, "empty.csv", b"")
    land(tmp_path, "blank.csv", b"\r\n , \r\n")
    land(tmp_path, "bad.csv", b"a,b\n" + b"1,2\n" * 30 + b"\x81\x20,1\n")
    land(tmp_path, "name%20x.csv", b"a\n1")
    land(tmp_path, "other.pdf", b"%PDF")
    whole, cut = both(spark, tmp_path)
    assert cut == whole


def feature(pick, k):
    place = pick.choice(
        [None, {"type": "Point", "coordinates": [139.5 + k, 35]}, {"type": "LineString", "coordinates": [[1, 2], [3, 4]]},
         {"type": "Point", "coordinates": [1]}]
    )
    props = {f"k{pick.randrange(4)}": pick.choice(["", " v ", "}", '"{[', "\\", "二", None, 3, {"a": [1, "}"]}, [{}, "]"]])
             for _ in range(pick.randrange(4))}
    return {"type": "Feature", "properties": pick.choice([props, props, None]), "geometry": place}


def test_geojson(spark, tmp_path, block_bytes):
    for seed in range(4):
        pick = random.Random(seed)
        document = {
            "type": "FeatureCollection",
            "crs": {"properties": {"name": "}", "features": [{"properties": {"k0": "no"}}]}},
            "features": [feature(pick, k) for k in range(25)],
            "more": [{"properties": {"k1": "no"}}],
        }
        if seed % 2:
            document = dict(reversed(document.items()))
        for name, settings in {"a": {}, "b": {"indent": 1, "ensure_ascii": False}, "c": {"separators": (",", ":")}}.items():
            land(tmp_path, f"{name}{seed}.geojson", json.dumps(document, **settings).encode() + b"\n" * (seed % 3))
    text = json.dumps({"features": [feature(random.Random(9), k) for k in range(20)]}, ensure_ascii=False)
    land(tmp_path, "sjis.json", text.encode("cp932"))
    land(tmp_path, "none.json", b'{"features": []}')
    land(tmp_path, "mixed.json", b'{"features": [null, {"properties": {"a": "1"}}, {"properties": {}}]}')
    for name, body in {
        "cut": text[:300], "object": '{"features": {}}', "null": '{"features": null}', "list": '[{"features": [{}]}]',
        "word": '{"a": "features"}', "empty": "", "text": "{nope", "deep": '{"a": {"features": [{"properties": {"x": "1"}}]}}',
        "broken": '{"features": [{"properties": {"a": }}, {"properties": {"a": "1"}}]}',
    }.items():
        land(tmp_path, f"{name}.json", body.encode())
    whole, cut = both(spark, tmp_path)
    assert cut == whole


def test_large_files_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    land(tmp_path, "one.csv", b"a,b\n" + b'1,"x\ny"\n' * 20_000)
    land(tmp_path, "one.geojson", json.dumps({"features": [feature(random.Random(k), k) for k in range(2000)]}).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        for glob, end in ((ranges.CSV_FILES, "\n"), (ranges.JSON_FILES, "}")):
            read = ranges.pieces(spark, str(tmp_path), glob, end)
            assert read.select("block").distinct().count() > 5
        want = [(n,) for n in range(1, 20_001)]
        assert rows(ranges.scan(spark, str(tmp_path)).records.where("dataset_id = 'one' AND rec['a'] = '1'"), "row_no") == sorted(want, key=repr)
        # Too many blocks to broadcast: dealt by block, in the same order.
        monkeypatch.setattr(ranges, "BROADCAST_BLOCKS", 0)
        assert rows(ranges.scan(spark, str(tmp_path)).records.where("dataset_id = 'one' AND rec['a'] = '1'"), "row_no") == sorted(want, key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("seed", range(30))
def test_state_after_a_line(seed):
    """A cell is open after a line exactly where the reader goes on to the next line."""
    pick = random.Random(seed)
    text = "".join(pick.choice('"",ab\r') for _ in range(pick.randrange(12))).rstrip("\r")
    for inside in (False, True):
        begun = '"' if inside else ""
        joined = [c for row in csv.reader(io.StringIO(begun + text + "\nMARK", newline="")) for c in row]
        assert ranges.inside_after(text.encode(), inside) == any("MARK" in c and c != "MARK" for c in joined)
