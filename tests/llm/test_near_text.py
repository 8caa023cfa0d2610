import re

import numpy as np
import pytest
from llm_tables import awkward, documents, edited, plain, prose

from placegauge.llm import near_text
from placegauge.llm.common import WordHashes, Windows, components


def shingle_set(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def smallest(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute(rows, size, percent):
    sets = [(d, shingle_set(t, size)) for d, t in rows]
    links = []
    for i, (d, x) in enumerate(sets):
        for e, y in sets[:i]:
            if x and y and d is not None and e is not None and d != e and 100 * len(x & y) >= percent * len(x | y):
                links.append((d, e))
    found = smallest({d for d, _ in sets if d is not None}, links)
    return sorted(
        ((d, len(x), found[d] if d is not None else None, d is None or found[d] == d) for d, x in sets), key=repr
    )


@pytest.mark.parametrize("block", [1024, 16])
def test_same_components_as_direct_comparison(spark, monkeypatch, block):
    monkeypatch.setattr(near_text, "BLOCK", block)
    rows = [r for r in awkward() if r[0] != 905] + [(700 + k, prose(100 + k, 60)) for k in range(30)]
    for family in range(6):
        base = prose(family, 120)
        rows += [(100 * family + k, edited(base, 31 * family + k, 0.004 * k)) for k in range(60 if family else 5)]
        rows += [(100 * family + 70 + k, base.upper() if k else base) for k in range(4)]
    rows += [(800, "a b"), (801, "A  b"), (802, "a b c"), (803, "b a"), (804, "x " * 50), (805, "x " * 80)]
    got = near_text.near_duplicates(documents(spark, rows), size=4)
    assert plain(got, "doc_id", "n_shingles", "component_id", "kept") == brute(rows, 4, 80)
    left = near_text.without_near_duplicates(documents(spark, rows), size=4)
    kept = sorted({d for d, _, _, k in brute(rows, 4, 80) if k and d is not None})
    assert sorted({r.doc_id for r in left.collect() if r.doc_id is not None}) == kept
    assert left.columns == documents(spark, rows).columns


def test_empty_table(spark):
    assert near_text.near_duplicates(documents(spark, [])).count() == 0
    assert plain(near_text.near_duplicates(documents(spark, [(1, None), (2, "")])), "doc_id", "component_id") == [
        (1, 1), (2, 2)]


def test_estimates_follow_similarities():
    base = prose(3, 600)
    known, windows = WordHashes(), Windows(0xE7037ED1A0B428DB)
    for share in (0.0, 0.02, 0.05):
        other = edited(base, 5, share)
        one, two = (near_text.shingles(t, 5, known, windows) for t in (base, other))
        true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
        a, b = (np.frombuffer(near_text.sketch(near_text.minima(s)), dtype=np.uint64) for s in (one, two))
        agree = near_text.agreements(a[None], b[None])[0] / near_text.MINIMA
        assert abs((agree - 1 / 16) / (15 / 16) - true) < 0.15


def test_components_of_chains_stars_and_cycles(spark):
    rng = np.random.default_rng(4)
    links = [(k, k + 1) for k in range(200, 330)] + [(500, 500 + k) for k in range(1, 80)] + [(1, 1), (3, 2)]
    links += [tuple(map(int, rng.integers(600, 700, 2))) for _ in range(70)]
    real = [(a, b) for a, b in links if a != b]
    got = components(spark.createDataFrame(links, "src long, dst long"), "test")
    want = smallest({n for pair in real for n in pair}, real)
    assert {r.node: r.component for r in got.collect()} == want
    assert components(spark.createDataFrame([], "src long, dst long"), "none").count() == 0
