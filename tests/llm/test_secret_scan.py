import random
import re

from llm_tables import awkward, documents, prose

from placegauge.llm import secret_scan


def brute(text):
    spans = []
    for m in re.finditer(
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A
    ):
        if len(m[1]) >= 8:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def test_patterns_are_those_of_a_plain_search():
    pick = random.Random(5)
    parts = ["token", "Secret", "API_KEY", "apikey", "passwd", "PASSWORD", "=", ":", " ", '"', "'", "AKIA", "AKIA1234",
             "ABCDEFGH1234", "deadbeef" * 4, "0123456789abcdef", "abcdefgh", "x", "\n", "é", "toKen", "ſecret", "--/+_"]
    for _ in range(6000):
        text = "".join(pick.choices(parts, k=pick.randint(1, 12)))
        assert secret_scan.pattern_spans(text, secret_scan.key_runs(text)) == brute(text), text


def findings(count):
    pick = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    out = []
    for k in range(count):
        secret = "".join(pick.choices("0123456789abcdef" if k % 3 else alphabet, k=40))
        plain = "".join(pick.choices("0123456789", k=pick.randint(16, 19))) if k % 2 else (
            "www.example.org/" + "/".join(pick.choices(["page", "news", "2024"], k=3)))
        out += [(f'the key = "{secret}" of', secret, True), (f"see {plain} for", plain, False)]
    return [(secret_scan.window(t, t.index(c), t.index(c) + len(c)), label) for t, c, label in out]


def test_network_learns_and_keeps_the_wanted_recall():
    rows = findings(300)
    net = secret_scan.train([w for w, _ in rows], [y for _, y in rows])
    p = net.probabilities([w for w, _ in rows])
    found = p >= net.threshold
    positive = [y for _, y in rows]
    assert sum(f for f, y in zip(found, positive, strict=True) if y) >= 0.95 * sum(positive)
    assert sum(f for f, y in zip(found, positive, strict=True) if not y) <= 0.05 * sum(positive)
    assert secret_scan.train([w for w, _ in rows], [True] * len(rows)) is None


def test_spans_of_awkward_rows(spark):
    pick = random.Random(4)
    secret = "".join(pick.choices("0123456789abcdef", k=40))
    rows = awkward() + [(k, f"{prose(k, 20)} token = {''.join(pick.choices('0123456789abcdef', k=40))} "
                            f"{prose(k, 5)} {pick.randint(10**15, 10**16)}") for k in range(200)]
    rows += [(700, f"é {secret[:31]} x"), (701, f"AKIA{'Q' * 12} {secret}")]
    got = {r.doc_id: r for r in secret_scan.scanned(documents(spark, rows)).collect()}
    assert (got[900].base, got[900].spans, got[901].n_hex) == ("", "", 0)
    for doc_id, text in rows:
        if doc_id not in (None, 904):
            want = brute(text or "")
            assert got[doc_id].base == secret_scan.written(want)
            assert set(filter(None, got[doc_id].base.split(","))) <= set(got[doc_id].spans.split(","))
    assert got[701].n_access == 1 and got[701].n_hex == 1
    # What looks like the labelled findings is found without a keyword or full length.
    assert got[700].spans == "model:2:33"
    assert secret_scan.scanned(documents(spark, [])).count() == 0


def test_windows_cover_long_candidates():
    for size in (16, 39, 40, 41, 50, 55, 200, 1003):
        got = list(secret_scan.places(7, 7 + size))
        assert (got[0][0], got[-1][1]) == (7, 7 + size)
        assert all(b - a == min(size, 40) for a, b in got)
        assert all(0 < c - a <= 10 for (a, _), (c, _) in zip(got, got[1:], strict=False))


def test_key_far_inside_a_run_is_found(spark):
    pick = random.Random(11)
    rows = [(k, f"{prose(k, 20)} token = {''.join(pick.choices('0123456789abcdef', k=40))} {prose(k, 5)} "
                f"{'/'.join(prose(9000 + 7 * k + n, 1) for n in range(12))}/2024") for k in range(200)]
    path = "/".join(prose(50 + n, 1) for n in range(20))[:75] + "/v2/"
    secret = "".join(pick.choices("0123456789abcdef", k=31))
    net = secret_scan.learnt(documents(spark, rows))
    rows = [(900, f"see {path}{secret} x"), (901, f"see {path}{path} x")]
    got = {r.doc_id: r.spans for r in secret_scan.scanned(documents(spark, rows), net).collect()}
    assert len(path) > 40 and got[900] == f"model:4:{4 + len(path) + 31}" and got[901] == ""


def test_letters_alone_and_parts_beside_spans_are_candidates(spark):
    pick = random.Random(13)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

    def secret(size, alphabet=letters + "0123456789"):
        return "".join(pick.choices(alphabet, k=size))

    rows = [(k, f"{prose(k, 20)} token = {secret(pick.randint(16, 40))} {prose(k, 5)} "
                f"{''.join(prose(9000 + 5 * k + n, 1) for n in range(5))[:30]:x<16} {prose(k, 3)}") for k in range(300)]
    net = secret_scan.learnt(documents(spark, rows))
    key, beside = secret(32, letters), secret(39)
    rows = [(900, f"see {key} x"), (901, f"AKIA{'Q' * 16}/{beside} x"), (902, f"see {prose(3, 9).replace(' ', '')[:28]} x")]
    got = {r.doc_id: r.spans for r in secret_scan.scanned(documents(spark, rows), net).collect()}
    assert got == {900: "model:4:36", 901: "access:0:20,model:20:60", 902: ""}
    assert list(secret_scan.candidates([(0, 60)], [(0, 1, 20)])) == [(0, 20, True), (20, 60, False)]


def test_all_findings_are_learnt_from(spark, monkeypatch):
    """Many parts: what only a few of all documents show is known, and parts make one network."""
    pick = random.Random(17)

    def secret(alphabet, size=40):
        return "".join(pick.choices(alphabet, k=size))

    rows = [(k, f"{prose(k, 8)} token = {secret('0123456789abcdef')} {prose(k, 3)} "
                f"{'/'.join(prose(9000 + 7 * k + n, 1) for n in range(12))}/2024") for k in range(400)]
    docs = documents(spark, rows)
    seen = []
    whole = secret_scan._mean_network
    monkeypatch.setattr(secret_scan, "PART_FINDINGS", 300, raising=False)
    monkeypatch.setattr(secret_scan, "_mean_network", lambda shown, *rest: seen.append(shown) or whole(shown, *rest))
    net = secret_scan.learnt(docs)
    learnt = secret_scan.findings(docs).distinct().count()
    every = secret_scan.examples(["x" * 64] * learnt, [False] * learnt)
    assert seen[0].select("part").distinct().count() > 1
    assert seen[0].where("place >= 0").count() > len(every[0]) * 3 // 4
    key = secret("0123456789abcdef", 31)
    plain = "/".join(prose(50 + n, 1) for n in range(20))[:75]
    got = {r.doc_id: r.spans for r in secret_scan.scanned(
        documents(spark, [(900, f"see {key} x"), (901, f"see {plain} x")]), net).collect()}
    assert got == {900: "model:4:35", 901: ""}
