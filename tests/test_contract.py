"""Contracts of published tables, and publishing all or nothing."""

import pytest
from plain_rows import rows
from pyspark.sql import functions as F

from placegauge.operators import contract, quality
from placegauge.operators.contract import Contract, list_of, number, struct, text, whole
from placegauge.sources import tables

SHAPE = Contract(
    {
        "k": text(filled=True), "kind": text(among=("x", "y")).or_null(), "url": text(matches="^https?://"),
        "share": number(0, 1).or_null(), "n": whole(1),
        "tags": list_of(text(filled=True)).or_null(),
        "parts": list_of(struct(name=text(), size=number(0))),
    },
    ("k",),
)
COLUMNS = "k string, kind string, url string, share double, n int, tags array<string>, parts array<struct<name string, size double>>"


def broken(spark, data, columns=COLUMNS, shape=SHAPE):
    return rows(contract.violations(spark.createDataFrame(data, columns), shape), "rule", "key")


def test_every_rule(spark):
    good = ("a", "x", "http://a", 0.5, 1, ["t"], [("p", 1.0)])
    assert broken(spark, [good, ("b", None, "https://b", None, 9, None, [])]) == []
    bad = [
        ("", "z", "ftp://a", 1.5, 0, ["", "t"], [("p", -1.0)]),
        ("c", "x", None, float("nan"), None, [None], None),
        ("d", "x", "http://d", -0.1, 1, [], [(None, None)]),
        (None, "x", "http://e", 0.0, 1, [], [None]),
        good, good,
    ]
    assert broken(spark, bad) == sorted([
        ("k: blank", ""), ("kind: unknown value", ""), ("url: no match", ""), ("share: out of range", ""),
        ("n: out of range", ""), ("tags[]: blank", ""), ("parts[].size: out of range", ""),
        ("url: missing", "c"), ("share: out of range", "c"), ("n: missing", "c"), ("tags[]: missing", "c"), ("parts: missing", "c"),
        ("share: out of range", "d"), ("parts[].name: missing", "d"), ("parts[].size: missing", "d"),
        ("k: missing", ""), ("parts[]: missing", ""),
        ("not unique", "a"),
    ], key=repr)


def test_columns_of_other_kinds(spark):
    data = [(1, "x", 0.5, "1", ["t"], [("p",)])]
    columns = "k int, kind string, share double, n string, tags array<string>, parts array<struct<name string>>"
    assert broken(spark, data, columns) == [
        ("k: wrong kind", "int"), ("n: wrong kind", "string"), ("parts[].size: no column", ""), ("url: no column", "")]


def test_published_tables_change_together_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "out")

    def table(v, features):
        df = spark.createDataFrame([(f, v) for f in features], "feature string, v int")
        gate = lambda staged: quality._hits(staged, F.col("feature"), {"too large": F.col("v") > 8})
        return tables.Publication(df, gate, features)

    def state():
        return [rows(tables.current(spark, folder, n)) for n in ("one", "two")]

    tables.publish(spark, folder, {"one": table(1, ["a", "b"]), "two": table(2, ["a"])}, "first")
    assert state() == [[("a", 1), ("b", 1)], [("a", 2)]]
    # Only the features at hand are renewed; one without rows is empty then.
    empty = tables.Publication(spark.createDataFrame([], "feature string, v int"), None, ["b"])
    tables.publish(spark, folder, {"one": table(3, ["a"])}, "second")
    tables.publish(spark, folder, {"one": empty}, "third")
    assert state() == [[("a", 3)], [("a", 2)]]
    with pytest.raises(quality.QualityError, match="two: too large: a"):
        tables.publish(spark, folder, {"one": table(4, ["a", "b"]), "two": table(9, ["a"])}, "fourth")
    assert state() == [[("a", 3)], [("a", 2)]]
    # A table that cannot be computed leaves everything as it was, too.
    lost = tables.Publication(spark.range(1).select(F.lit("a").alias("feature"), F.raise_error(F.lit("x")).cast("int").alias("v")), None, ["a"])
    with pytest.raises(Exception, match="x"):
        tables.publish(spark, folder, {"two": table(5, ["a"]), "one": lost}, "fifth")
    assert state() == [[("a", 3)], [("a", 2)]]
    assert rows(tables.current(spark, folder, "one", ["a"])) == [("a", 3)]
    with pytest.raises(ValueError, match="not published"):
        tables.current(spark, folder, "three")
