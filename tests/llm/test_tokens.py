import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_tables import awkward, documents, plain, prose

from placegauge.llm import common, id_coder, id_files, packing, token_counts
from placegauge.llm.tokens import Encoder, read_vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(read_vocabulary(PATH))


def test_parts_give_the_ids_of_the_whole(encoder):
    pick = random.Random(3)
    marks = [" ", "\n", "\t", "a", "B", "é", "'", "'s", "1", ".", "<|endoftext|>", " ", "　", "​",
             "\x1c", "\x85", "  ", "\r\n", "don't", "漢"]
    texts = ["".join(pick.choices(marks, k=pick.randint(0, 14))) for _ in range(3000)] + [prose(1, 500)]
    assert [encoder.ids(t) for t in texts] == [encoder.encode(t) for t in texts]


def test_added_tokens_are_those_of_the_library(encoder):
    from tokenizers import Tokenizer

    plain_one = Tokenizer.from_file(PATH)
    for text in ("a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|>  <|endoftext|>y z", "a <|endoftext| >", "a b"):
        want = plain_one.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want
    assert np.frombuffer(encoder.ids("a<|endoftext|>b"), "<u4").tolist() == [64, 50256, 65]


def greedy(entries, word):
    starts = {e[1:] for e in entries if e[:1] == b" " and len(e) > 1}
    rest = {e for e in entries if e and b" " not in e}
    count, at, now = 0, 0, starts
    while at < len(word) or now is starts:
        for end in range(len(word), at, -1):
            if word[at:end] in now:
                at = end
                break
        else:
            at += now is rest  # a byte that begins nothing; or the bare start of the word
        now, count = rest, count + 1
    return count


def test_counts_are_those_of_greedy_matching():
    pick = random.Random(2)
    for _ in range(300):
        entries = [bytes(pick.choices(b"abc", k=pick.randint(1, 5))) for _ in range(pick.randint(0, 9))]
        entries += [b" " + bytes(pick.choices(b"abc", k=pick.randint(1, 5))) for _ in range(pick.randint(0, 6))]
        automaton = token_counts.Automaton(entries)
        for _ in range(15):
            word = bytes(pick.choices(b"abc", k=pick.randint(1, 9)))
            assert automaton.count(word) == greedy(entries, word), (entries, word)


def test_token_counts_of_awkward_rows(spark):
    entries = token_counts.vocabulary_bytes(read_vocabulary(PATH))
    rows = [r for r in awkward() if r[0] != 905]
    got = plain(token_counts.token_counts(documents(spark, rows), PATH), "doc_id", "n_words", "n_tokens")
    automaton = token_counts.Automaton(entries)
    want = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        want.append((doc_id, len(words), sum(map(automaton.count, words))))
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(documents(spark, []), PATH).count() == 0


def check_places(rows, encoder, got, most):
    pieces = {}
    for doc_id, text in rows:
        ids = encoder.encode(text or "") + (2).to_bytes(4, "little")
        n = len(ids) // 4
        cuts = [0, *range(n % most or most, n + 1, most)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            key = (doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))
            pieces[key] = pieces.get(key, 0) + 1
    found, bins = {}, {}
    for r in got:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        found[key] = found.get(key, 0) + 1
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert found == pieces
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= most
    return bins


def test_packing_places_every_piece_once(spark, encoder, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_ROWS", 40)
    rows = [r for r in awkward() if r[0] != 905] + [(k, prose(k, 1 + (k * k) % 700)) for k in range(150)]
    rows += [(300 + k, "same") for k in range(90)] + [(500, prose(77, 4000))]
    got = packing.packed(documents(spark, rows), PATH).collect()
    bins = check_places(rows, encoder, got, 1024)
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 1024) + 1
    assert packing.packed(documents(spark, []), PATH).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_holds(score):
    capacity = packing.Capacity(tokens=100, documents=4, attention=5000, score=score)
    rng = np.random.default_rng(1)
    histogram = {int(n): int(c) for n, c in zip(rng.permutation(70)[:40] + 1, rng.integers(1, 50, 40), strict=True)}
    bins, ranks = {}, {}
    for length, first, many, sequence, offset in packing.plan(histogram, capacity):
        for k in range(many):
            bins.setdefault(sequence + k, []).append((offset, length))
            ranks.setdefault(length, []).append(first + k)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    for held in bins.values():
        lengths = [n for _, n in sorted(held)]
        assert [o for o, _ in sorted(held)] == [sum(lengths[:k]) for k in range(len(lengths))]
        assert sum(lengths) <= 100 and len(lengths) <= 4 and sum(n * n for n in lengths) <= 5000
    with pytest.raises(ValueError):
        packing.plan({80: 1}, capacity)


def test_group_round_trip():
    rng = np.random.default_rng(1)
    for ids in (
        np.zeros(0, int), np.array([7]), rng.integers(0, 2**31 - 2, 3000), np.zeros(3000, int),
        rng.integers(0, 3, 2000), rng.zipf(1.2, 4000) % 50_000, np.arange(1500), np.full(1500, 2**31 - 2),
    ):
        data = id_coder.write_group([1, None, 3], [0, len(ids), 0], ids.astype(np.uint32))
        keys, lengths, back = id_coder.read_group(data)
        assert keys == [1, None, 3] and lengths.tolist() == [0, len(ids), 0] and np.array_equal(back, ids)
    repeated = np.tile(rng.integers(0, 50_000, 40), 100)
    assert len(id_coder.write_group([1], [4000], repeated.astype(np.uint32))) < 4000


def test_damage_is_found():
    data = bytearray(id_coder.write_group([1], [2000], (np.arange(2000) * 7 % 999).astype(np.uint32)))
    for at in (0, 9, 40, len(data) // 2, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 0x10
        with pytest.raises(id_coder.IdError):
            id_coder.read_group(bytes(bad))


def test_files_give_back_every_document(spark, encoder, tmp_path, monkeypatch):
    monkeypatch.setattr(id_files, "GROUP_IDS", 3000)
    rows = [r for r in awkward() if r[0] != 905] + [(k, prose(k, 1 + (k * 37) % 300)) for k in range(120)]
    path = str(tmp_path / "ids")
    id_files.write_ids(documents(spark, rows), PATH, path)
    got = id_files.document_digests(spark, path).collect()
    raw = [(d, encoder.encode(t or "") + (2).to_bytes(4, "little")) for d, t in
           sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))]
    start, want = 0, []
    for doc_id, ids in raw:
        want.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted([tuple(r) for r in got], key=lambda r: r[1]) == want
    empty = str(tmp_path / "none")
    id_files.write_ids(documents(spark, []), PATH, empty)
    assert id_files.document_digests(spark, empty).count() == 0


def test_what_a_worker_keeps_goes_when_another_step_begins():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3])], ["x"])
    made = []

    def asking(rows):
        common.made_once("kept", "source", made.append)
        yield rows

    def other(rows):
        yield rows

    for _ in range(2):  # kept from task to task, also over one without rows
        assert list(common.worked(iter([batch]), asking)) == [batch]
        assert list(common.worked(iter([batch.slice(0, 0)]), other)) == []
    assert made == ["source"] and "kept" in common._made
    assert list(common.worked(iter([batch]), other)) == [batch]
    assert common._made == {}


def test_blocks_of_a_group_learn_from_one_another():
    rng = np.random.default_rng(4)
    ids = (rng.permutation(40_000)[:2000])[(rng.zipf(1.3, 60_000) - 1) % 2000].astype(np.uint32)
    _, many = np.unique(ids, return_counts=True)
    entropy = -(many / len(ids) * np.log2(many / len(ids))).sum()
    data = id_coder.write_group([1], [len(ids)], ids)
    # 2.36 times the entropy of the ids when every block began anew and order 0 was a bit length.
    assert 8 * len(data) < 1.35 * entropy * len(ids)
    assert np.array_equal(id_coder.read_group(data)[2], ids)


def test_a_step_of_the_coder_makes_no_table_of_symbols(monkeypatch):
    ids = np.random.default_rng(5).integers(0, 5000, 40_000).astype(np.uint32)
    renewed = []
    renew = id_coder.Model.renew
    monkeypatch.setattr(id_coder.Model, "renew", lambda self: (renewed.append(1), renew(self)))
    data = id_coder.write_group([1], [len(ids)], ids)
    assert len(renewed) < 30  # 512 steps
    assert np.array_equal(id_coder.read_group(data)[2], ids)


def test_digits_that_change_no_id_are_found_as_well():
    data = bytearray(id_coder.write_group([1], [900], (np.arange(900) % 31).astype(np.uint32)))
    for at in range(len(data) - 12, len(data)):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(id_coder.IdError):
            id_coder.read_group(bytes(bad))
    with pytest.raises(id_coder.IdError):
        id_coder.read_group(bytes(data[:-4]))


def test_digests_do_not_hand_the_ids_on(spark, tmp_path):
    path = str(tmp_path / "ids")
    id_files.write_ids(documents(spark, [(1, "a b"), (2, None)]), PATH, path)
    plan = id_files.document_digests(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert [bytes(r.ids) for r in id_files.read_ids(spark, path).orderBy("doc_id").collect()][1] == b"\2\0\0\0"
