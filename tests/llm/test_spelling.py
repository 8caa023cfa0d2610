"""Spelling variants against a version that compares all words with each other."""

import zlib
from collections import Counter

import pytest
from llm_tables import documents, plain, prose

from placegauge.llm import spelling

LETTERS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | {chr(c) for c in range(0xC0, 0x100)}


def brute_counts(rows, least_length, least_count, every):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c in LETTERS:
                run += c.lower() if c.isascii() else c
                continue
            if run:
                key = "null" if doc_id is None else str(doc_id)
                h = zlib.crc32(f"{key}:{run}".encode())
                if h % every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= least_length:
                    counts[run] += 1
            run = ""
    return {w: n for w, n in counts.items() if n >= least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, least_length=5, least_count=3, every=97, factor=2):
    counts = brute_counts(rows, least_length, least_count, every)
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    forms = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= factor * n else None
    out = []
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        form = forms[w]
        out.append((w, form, root, n, len(near[w]), counts[form] if form else None))
    return sorted(out, key=repr)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def variants(spark, rows, **settings):
    return plain(spelling.variants(documents(spark, rows).select("doc_id", "text"), **settings), *COLUMNS)


@pytest.mark.parametrize("every", [97, 3])
def test_same_as_comparing_all(spark, every):
    # Few letters, so that many words are one edit apart, some in several ways.
    words = ["".join("abé"[(k // 3**i) % 3] for i in range(2 + k % 7)) for k in range(700)]
    rows = [(k, prose(k, 150, words)) for k in range(40)]
    rows += [
        (None, prose(70, 90, words)),
        (90, None), (91, ""), (92, " 12 \t"),
        (93, prose(71, 200, words)), (93, prose(71, 200, words)),
        (94, "Straße ÉCOLE école ×× abc÷abc " * 4),
        (95, "aaaaab aaaaaa aaaaaab baaaaa " * 5),
    ]
    got = variants(spark, rows, every=every)
    assert got == brute(rows, every=every)
    assert any(r[1] for r in got)


def test_chains_end_at_their_root(spark):
    text = "abcde " * 3 + "abcdef " * 6 + "abcdefg " * 12 + "abcdefgh " * 24 + "abcdefghi " * 48
    rows = [(1, text)]
    got = variants(spark, rows, every=10**9)
    assert got == brute(rows, every=10**9)
    assert {r[2] for r in got} == {"abcdefghi"}


def test_ties_take_the_smaller_word(spark):
    rows = [(1, "aaaaa " * 3 + "aaaaé " * 6 + "aaaaz " * 6 + "baaaa " * 5)]
    assert variants(spark, rows, every=10**9) == brute(rows, every=10**9)


def test_very_long_words(spark):
    long = "abcdefghij" * 3000
    rows = [(k, f"{long} {long[:-1]} {long}x x{long[1:]} {'a' * 20_000}") for k in range(3)]
    got = variants(spark, rows, every=10**9)
    assert got == brute(rows, every=10**9)
    assert len(got) == 5 and sum(r[4] for r in got) > 0


@pytest.mark.parametrize("part_rows", [1, 10**6])
def test_hot_chunks_are_split(spark, part_rows):
    words = [f"hotte{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = plain(spelling.near_pairs(df, part_rows), "word", "near")
    assert got == sorted(((a, b) for a in words for b in words if a < b and one_edit(a, b)), key=repr)


def test_counts_are_handed_on_in_pieces(spark, monkeypatch):
    rows = [(k, prose(k, 60)) for k in range(30)]
    want = variants(spark, rows, least_length=3)
    monkeypatch.setattr(spelling, "HELD_WORDS", 5)
    assert variants(spark, rows, least_length=3) == want == brute(rows, least_length=3)


def test_empty_table_and_short_words(spark):
    empty = documents(spark, [(1, "x")]).limit(0).select("doc_id", "text")
    assert spelling.variants(empty).collect() == []
    assert variants(spark, [(1, "ab ac abc " * 3)], least_length=2) == brute(
        [(1, "ab ac abc " * 3)], least_length=2
    )
    with pytest.raises(ValueError, match="no two chunks"):
        spelling.variants(empty, least_length=1)
