import re

import pytest
from llm_tables import awkward, documents, plain, prose

from placegauge.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items, window):
    out = []
    for doc_id, text in rows:
        own, hit, found = words(text), set(), set()
        for item, item_text in items:
            need = words(item_text)
            m = min(window, len(need))
            for s in range(len(need) - m + 1) if m and item is not None else ():
                for i in range(len(own) - m + 1):
                    if own[i : i + m] == need[s : s + m]:
                        hit.update(range(i, i + m))
                        found.add(item)
        out.append((doc_id, len(own), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [10**6, 40])
def test_same_hits_as_direct_search(spark, block_bytes):
    passage = prose(50, 30)
    rows = awkward()[:-4] + [
        (1, "x " + passage.upper() + " y"),
        (2, passage[: len(passage) // 2]),
        (3, "Seven! words-only; here, to: find (now)."),
        (4, prose(51, 200) + " " + passage + " " + passage),
        (5, "a b a b a b a b a b a b a b"),
    ]
    rows = [r for r in rows if not r[1] or len(r[1]) < 5000]
    items = [
        (1, passage), (2, "seven words only here"), (3, passage), (4, None), (5, ""), (None, passage),
        (6, "a b a b a b a b a b"), (7, "--- !!"), (8, "one"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(documents(spark, rows), bench, 10, block_bytes)
    assert plain(found, "doc_id", "n_words", "hits", "items") == brute(rows, items, 10)
    kept = decontaminate.decontaminated(documents(spark, rows), bench, 10, block_bytes)
    clean = sorted((d, len(w)) for (d, w), b in zip(rows, [brute([r], items, 10)[0] for r in rows])
                   if d is not None and w is not None and not b[2])
    assert sorted((r.doc_id, len(r.text)) for r in kept.where("doc_id is not null and text is not null").collect()) == clean
    assert kept.columns == documents(spark, rows).columns


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    rows = [(1, "a b c"), (2, None)]
    assert plain(decontaminate.contamination(documents(spark, rows), nothing), "doc_id", "hits") == [(1, []), (2, [])]
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(documents(spark, []), bench).count() == 0
