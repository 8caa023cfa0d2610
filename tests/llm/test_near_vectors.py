import numpy as np
import pytest
from llm_tables import plain
from test_near_text import smallest

from placegauge.llm import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, a string, n long"


def around(rng, center, cosine, count):
    out = []
    for _ in range(count):
        side = rng.normal(size=len(center))
        side -= side @ center * center
        out.append(cosine * center + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side))
    return out


def brute(rows):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            x = np.array(v, dtype=np.float32).astype(np.float64)
            if len(x) and np.any(x):
                ok[k] = (i, x / np.linalg.norm(x), label)
    pairs = {
        (p[0], q[0])
        for p in ok.values() for q in ok.values()
        if p[0] != q[0] and p[2] == q[2] and len(p[1]) == len(q[1]) and p[1] @ q[1] >= 0.93
    }
    found = smallest({i for i, _, _ in rows if i is not None}, pairs)
    return {i: (sum(p == i for p, _ in pairs), found.get(i)) for i, _, _ in rows}


@pytest.mark.parametrize("block", [512, 8])
def test_same_links_as_direct_comparison(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 64))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    vectors = [(v, k % 3) for k, c in enumerate(centers) for v in around(rng, c, 0.99, 25)]
    vectors += [(v, 1) for c in centers[:3] for v in around(rng, c, 0.955, 10)]
    vectors += [(v, 2) for v in rng.normal(size=(150, 64))] + [(vectors[0][0], 0)] * 5
    rows = [(k, [float(np.float32(x)) for x in 3 * v], label) for k, (v, label) in enumerate(vectors)]
    rows += [
        (2000, None, 1), (2001, [0.0] * 64, 1), (2002, [float("nan")] * 64, 1), (2003, [None] * 64, 1),
        (2004, rows[0][1], None), (None, rows[0][1], 0), (2005, [1.0, 2.0], 0), (2006, [2.0, 4.0], 0), (2007, [], 0),
        (2008, [float("inf")] + [1.0] * 63, 1), (3, rows[3][1], rows[3][2]),
    ]
    df = spark.createDataFrame([(*r, None, 7) for r in rows], SCHEMA).repartition(3)
    got = {r[0]: tuple(r[1:]) for r in near_vectors.near_duplicates(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    linked = sum(n for n, _ in want.values())
    # Nothing below the threshold, and almost every link (bands miss few at the threshold).
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _, _ in got.values()) >= 0.99 * linked
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)
    assert all(k == (c == i) or i is None for i, (_, c, k) in got.items())


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    one = rng.normal(size=(2000, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    two = np.array([around(rng, v, 0.931, 1)[0] for v in one])
    labels = np.zeros(2000, dtype=np.int64)
    a, b = near_vectors.buckets(one, labels), near_vectors.buckets(two, labels)
    met = (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
    assert met.mean() >= 0.995


def test_empty_table(spark):
    assert near_vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, [1.0], 1, None, None)], SCHEMA)
    assert plain(near_vectors.near_duplicates(one), "vec_id", "n_links", "component_id", "kept") == [(1, 0, 1, True)]
