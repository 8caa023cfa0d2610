from llm_tables import awkward, documents, prose

from placegauge.llm import line_templates as lt


def brute(rows, min_docs, similarity):
    """All lines of a leaf in one list, in the order of their keys."""
    lines, docs = {}, {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            tokens = lt.tokens_of(line)
            if tokens and doc_id is not None:
                key = lt._signed(lt.key_of(tokens))
                lines[key] = tokens
                docs.setdefault(key, set()).add(doc_id)
    leaves = {}
    for key in sorted(lines):
        leaves.setdefault(lt.leaf_of(lines[key]), []).append((key, lines[key]))
    named = {}
    for leaf, group in leaves.items():
        named |= {k: (leaf, tuple(t)) for k, t in lt.joined(group, similarity).items()}
    owners = {}
    for key, template in named.items():
        owners.setdefault(template, set()).update(docs[key])
    out = {}
    for doc_id, text in rows:
        left = []
        for line in (text or "").split("\n"):
            tokens = lt.tokens_of(line)
            own = owners[named[lt._signed(lt.key_of(tokens))]] if tokens and doc_id is not None else set()
            if len(own) < min_docs or doc_id == min(own):
                left.append(line)
        out.setdefault(doc_id, set()).add(None if text is None else "\n".join(left))
    return out


def test_same_lines_as_one_list_per_leaf(spark):
    rows = [r for r in awkward() if r[0] != 905]
    for k in range(40):
        name = prose(k, 1)
        rows.append((k, f"{prose(k, 12)}\nShared by all of us here\n\nPosted by the user {name} on day {k}\n"
                        f"Page {k} of 40\n{prose(k % 4, 15)}\n{prose(k, 9)}"))
    got = {}
    for r in lt.deduplicated(documents(spark, rows), 5).collect():
        got.setdefault(r.doc_id, set()).add(r.text)
    assert got == brute(rows, 5, lt.SIMILARITY)
    first = next(iter(got[0]))
    assert "Shared by all of us here" in first and "Page 0 of 40" in first
    assert all("Shared" not in next(iter(got[k])) and "Page" not in next(iter(got[k])) for k in range(1, 40))
    assert all(prose(k, 12) in next(iter(got[k])) for k in range(40))


def test_leaves_of_several_chunks_join_again(spark, monkeypatch):
    monkeypatch.setattr(lt, "CHUNK", 8)
    rows = [(k, f"{prose(k, 9)}\nPosted by the user {prose(1000 + k, 1)}x{'y' * k} in the open") for k in range(60)]
    got = {r.doc_id: r.text for r in lt.deduplicated(documents(spark, rows), 10).collect()}
    assert "Posted" in got[0] and not any("Posted" in got[k] for k in range(1, 60))


def test_many_templates_in_one_leaf(spark, monkeypatch):
    rows = []
    for k in range(20):
        lines = [f"We are here {prose(700 + t, 4)} {prose(9000 + 50 * t + k, 1)}{'y' * k} end" for t in range(12)]
        alone = [f"We are here {prose(20_000 + 7 * k + n, 6)}" for n in range(7)]
        rows.append((k, "\n".join(lines + alone)))
    want = brute(rows, 10, lt.SIMILARITY)
    assert len(next(iter(want[19])).split("\n")) == 7
    monkeypatch.setattr(lt, "CHUNK", 12)
    got = {r.doc_id: {r.text} for r in lt.deduplicated(documents(spark, rows), 10).collect()}
    assert got == want


def test_numbers_alone_recur_by_their_text(spark):
    rows = [(k, f"{k} {k + 1} {7 * k}\n2019-01-{k:02}\n| {k} | 4 |\n| {k} | kg{'a' * k} |\n12 34 56\nPage {k} of 20")
            for k in range(20)]
    got = {r.doc_id: r.text for r in lt.deduplicated(documents(spark, rows), 10).collect()}
    assert got[0] == rows[0][1]
    assert all(got[k].split("\n") == rows[k][1].split("\n")[:4] for k in range(1, 20))


def test_few_documents_and_none(spark):
    rows = [(k, "rare line of text\nmore") for k in range(4)] + [(9, None), (10, "")]
    got = {r.doc_id: (r.text, r.lines_dropped) for r in lt.deduplicated(documents(spark, rows), 5).collect()}
    assert got == {**{k: ("rare line of text\nmore", 0) for k in range(4)}, 9: (None, 0), 10: ("", 0)}
    assert lt.deduplicated(documents(spark, [])).count() == 0
