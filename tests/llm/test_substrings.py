import hashlib
import re

import numpy as np
import pytest
from llm_tables import awkward, documents, edited, plain, prose

from placegauge.llm import substrings


def brute(rows, window):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    low = {}
    for d, w in split:
        for i in range(len(w) - window + 1) if d is not None else ():
            key = tuple(w[i : i + window])
            low[key] = min(d, low.get(key, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if low[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [6, 50, 120])
def test_same_words_as_direct_search(spark, window):
    passage = prose(7, 140)
    base = prose(8, 400)
    rows = [r for r in awkward() if r[0] != 904] + [
        (1, passage), (2, "start " + passage + " end"), (3, passage + "\n" + passage), (4, base), (5, base),
        (6, edited(base, 1, 0.01)), (7, edited(base, 2, 0.005)), (8, " ".join(["x"] * 300)),
        (9, " ".join(["x"] * 90)), (10, prose(9, window)), (11, prose(9, window)), (12, prose(9, window - 1)),
        (13, prose(9, window - 1)), (0, prose(10, 30) + " " + base[300:1500]),
    ]
    got = substrings.deduplicated(documents(spark, rows), window)
    assert plain(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute(rows, window)


def test_one_id_with_two_texts_and_nothing_at_all(spark):
    rows = [(1, prose(1, 60)), (1, prose(2, 60)), (2, prose(2, 60)), (None, prose(1, 60))]
    got = substrings.deduplicated(documents(spark, rows))
    assert plain(got, "doc_id", "n_removed") == [(1, 0), (1, 0), (2, 60), (None, 0)]
    assert substrings.deduplicated(documents(spark, [])).count() == 0


def test_equal_stretches_choose_equal_anchors():
    rng = np.random.default_rng(1)
    one, two = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(0, 2**63, 200).astype(np.uint64)
    two[40:120] = one[90:170]
    spread = 26
    a, b = substrings.chosen(one, spread), substrings.chosen(two, spread)
    assert [int(x) - 50 for x in a[90 : 170 - spread + 1]] == [int(x) for x in b[40 : 120 - spread + 1]]
