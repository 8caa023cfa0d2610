"""Vector codes against plain Lloyd with Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placegauge.llm import vector_codes as vc

SCHEMA = "id long, label int, vector array<float>"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """``[(id, label, code, error)]`` and the codebooks."""
    clean = []
    for key, label, vector in rows:
        if not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        clean.append((key, label, [math.floor(float(np.float32(x)) * scale) for x in vector]))
    clean.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not clean:
        return [], []
    dims = len(clean[0][2])
    most = vc.largest(dims)
    clean = [(k, lab, [max(-most, min(most, x)) for x in v]) for k, lab, v in clean if len(v) == dims]
    ranges = vc.bounds(dims, parts)
    books = [[v[a:b] for _, _, v in clean[:entries]] for a, b in ranges]

    def nearest(part, book):
        far = [sum((x - y) ** 2 for x, y in zip(part, entry, strict=True)) for entry in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for at, (a, b) in enumerate(ranges):
            groups = {}
            for _, _, v in clean:
                groups.setdefault(nearest(v[a:b], books[at])[0], []).append(v[a:b])
            for entry, members in groups.items():
                books[at][entry] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for key, label, v in clean:
        found = [nearest(v[a:b], book) for (a, b), book in zip(ranges, books, strict=True)]
        out.append((key, label, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)))
    return sorted(out, key=repr), books


def clustered(n, dims, seed=0, spread=0.05, centres=12):
    pick = random.Random(seed)
    middles = [[pick.uniform(-1, 1) for _ in range(dims)] for _ in range(centres)]
    return [
        (k, None if k % 11 == 0 else k % 4, [x + pick.gauss(0, spread) for x in pick.choice(middles)])
        for k in range(n)
    ]


def compressed(spark, rows, **settings):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("x", "code", "error", "trees", "label_error", "name"):
        df = df.withColumn(name, F.lit("own"))
    codes, books = vc.compressed(df, **settings)
    return sorted((tuple(r) for r in codes.collect()), key=repr), [b.tolist() for b in books]


@pytest.mark.parametrize(
    ("rows", "settings"),
    [
        (clustered(300, 8), {"entries": 16}),
        (clustered(300, 8, spread=0.5), {"entries": 40, "rounds": 2}),
        (clustered(120, 10, seed=2), {"entries": 256}),  # fewer vectors than entries, uneven parts
        # Few different integers: many ties and unused entries.
        ([(k, 1, [random.Random(k).choice([0.0, 0.001, 0.002, -0.001])] * 4) for k in range(200)], {"entries": 32}),
        ([(k, 1, [0.5, -0.25, 0.125, 1.0]) for k in range(100)], {"entries": 8}),
        ([(k, 1, [random.Random(k).uniform(-1, 1) * 1e30, 2.0, -3.5, 1e5]) for k in range(80)], {"entries": 8}),
    ],
)
def test_same_as_plain_lloyd(spark, monkeypatch, rows, settings):
    monkeypatch.setattr(vc, "LEAF", 4)
    assert compressed(spark, rows, **settings) == brute(rows, **settings)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vc, "BLOCK_BYTES", 40 * 4 * 8)
    rows = clustered(500, 8, seed=3)
    assert compressed(spark, rows, entries=20) == brute(rows, entries=20)


def test_awkward_vectors(spark):
    rows = clustered(60, 8, seed=4)
    rows += [
        (None, 1, rows[3][2]), (None, None, rows[4][2]), (5, 2, rows[6][2]), (7, 0, rows[7][2]), (7, 0, rows[7][2]),
        (100, 1, None), (101, 1, []), (102, 1, [None] * 8), (103, 1, [float("nan")] * 8),
        (104, 1, [float("inf")] + [0.0] * 7), (105, 1, [0.5] * 7), (106, 1, [0.0] * 8),
    ]
    assert compressed(spark, rows, entries=10) == brute(rows, entries=10)
    empty = spark.createDataFrame(rows, SCHEMA).limit(0)
    codes, books = vc.compressed(empty)
    assert (codes.collect(), books, codes.columns) == ([], [], ["id", "label", "code", "error"])


def test_label_errors_put_null_labels_together(spark):
    df = spark.createDataFrame(
        [(1, None, "a", 3), (2, None, "b", 4), (3, 1, "c", 5), (4, 1, "d", 6), (4, 1, "d", 6)],
        "id long, label int, code string, error long",
    )
    got = sorted((r.id, r.label_error) for r in vc.with_label_errors(df).collect())
    assert got == [(1, 7), (2, 7), (3, 17), (4, 17), (4, 17)]


def test_pairs_of_nodes_are_pruned():
    points = np.array([r[2] for r in clustered(2000, 8, seed=5, spread=0.01)])
    parts = vc.tree(np.floor(points * 1024).astype(np.int64), 16)
    book = parts.points[:: len(parts.points) // 12][:12]
    whole, uncertain = vc.nearest(parts, vc.tree(book, 1))
    covered = sum(int(parts.end[k] - parts.begin[k]) for k, _ in whole)
    assert covered > 300
    assert covered + sum(int(parts.end[k] - parts.begin[k]) for k, _ in uncertain) == 2000
    for node, entry in whole:
        far = ((parts.points[parts.begin[node] : parts.end[node], None] - book) ** 2).sum(2)
        assert (far.argmin(1) == entry).all()
