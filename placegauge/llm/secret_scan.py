"""Secret scan: fixed patterns, and a character convolutional network over every candidate.

Candidates are runs of at least 16 key characters, or what patterns leave of them.  The network sees a
candidate and the characters around it, a long one in overlapping windows of which the likeliest
counts, learns from all labelled findings of all documents (runs
that the patterns cover, and runs that they do not), and its threshold is the calibrated probability
of one half, or lower if the wanted share of held-out findings is not recalled otherwise.  What it finds beside
the patterns is added; what the patterns find always stays.

Findings are dealt by hash to parts of some thousands.  In a round every part goes on training from the same network,
and the next network is the mean of theirs; calibration and threshold are sums over the held-out findings of all parts.

Defined results: a null text is an empty one and has no spans; repeated rows are scanned row by
row; without findings of both kinds to learn from, the patterns stand alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegauge.llm.common import arrow_rows, keep

KINDS = ("assign", "access", "hex", "model")
# Weight of the prior on the scale (1) and shift (0) of the calibration.
PRIOR = 0.1
# Findings that are trained on in one task, and passes over them: all in a row where there is one part,
# else rounds of one pass, fewer the more parts there are, but at least the second number.
PART_FINDINGS = 6000
PASSES, LEAST_ROUNDS = 30, 4
RECALL = 0.97
# Steps of a logit in which the threshold is looked for, and the logits it is looked for among.
LOGIT_STEP, LOGIT_LIMIT = 0.01, 1000.0
# Characters of a candidate, and on each side of them, that the network sees at once; a longer
# candidate is seen in windows this many characters apart.
INSIDE, AROUND, STEP = 40, 12, 10
# Share of the training in which every missing label is believed.
TRUSTED = 1 / 6
# Windows that are scored at once.
SCORED = 512

ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
WORDS = ("password", "passwd", "secret", "token", "api")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = 16

Span = tuple[int, int, int]  # start, index of the kind, end


def pattern_spans(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind.

    Access keys and hexadecimal strings consist of key characters, so they lie inside runs.
    """
    spans = []
    low = text.lower()
    if any(word in low for word in WORDS):
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    for start, end in runs:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, start, end)]
        if end - start >= 32:
            spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text, start, end)]
    return sorted(spans)


def key_runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in RUN.finditer(text)]


def candidates(runs: list[tuple[int, int]], spans: list[Span]) -> Iterator[tuple[int, int, bool]]:
    """The parts of runs outside and inside the spans, long enough for a key; whether inside."""
    for start, end in runs:
        at = start
        for low, high in sorted((s, e) for s, _, e in spans if s < end and start < e):
            low, high = max(low, at), min(high, end)
            if low - at >= LEAST:
                yield at, low, False
            if high - low >= LEAST:
                yield low, high, True
            at = max(at, high)
        if end - at >= LEAST:
            yield at, end, False


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


# --- the network -----------------------------------------------------------------------------

_CLASSES = ["aeiou", "bcdf", "ghjklmnpqrstvwxyz", "AEIOU", "BCDF", "GHJKLMNPQRSTVWXYZ", "0123456789",
            "+/", "_", ".", "=", "-", " ", "\n\t\r", "\"'`", ":", "@", ",;|()[]{}<>"]
_CLASS_OF = {c: k for k, group in enumerate(_CLASSES, start=1) for c in group}
OTHER, CHANNELS = len(_CLASSES) + 1, len(_CLASSES) + 3  # 0 is padding; the last marks the inside
_CODES = np.full(256, OTHER, dtype=np.int64)
for _c, _k in _CLASS_OF.items():
    _CODES[ord(_c)] = _k


def places(start: int, end: int) -> Iterator[tuple[int, int]]:
    """Windows of a candidate; together they cover it, and the last ends with it."""
    low = start
    while low + INSIDE < end:
        yield low, low + INSIDE
        low += STEP
    yield max(start, min(low, end - INSIDE)), end


def window(text: str, start: int, end: int) -> str:
    """What the network sees: context, the characters of one window, context; fixed length."""
    inside = text[start : min(end, start + INSIDE)]
    return (
        text[max(0, start - AROUND) : start].rjust(AROUND, "\0")
        + inside.ljust(INSIDE, "\0")
        + text[end : end + AROUND].ljust(AROUND, "\0")
    )


def encoded(windows: list[str]) -> np.ndarray:
    """Characters to channels: windows x length x channels."""
    raw = np.frombuffer("".join(windows).encode("latin-1", "replace"), dtype=np.uint8)
    codes = _CODES[raw].reshape(len(windows), -1)
    codes[raw.reshape(codes.shape) == 0] = 0
    x = np.eye(CHANNELS, dtype=np.float32)[codes]
    x[:, :, 0] = 0
    x[:, AROUND : AROUND + INSIDE, -1] = codes[:, AROUND : AROUND + INSIDE] > 0
    return x


@dataclass
class Network:
    """One convolution of width 5, maximum and mean over the window, and a logistic output."""

    filters: np.ndarray  # 5 * channels x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length, channels = x.shape
        views = np.lib.stride_tricks.sliding_window_view(x, 5, axis=1)
        flat = views.transpose(0, 1, 3, 2).reshape(n * (length - 4), 5 * channels)
        made = np.maximum(flat @ self.filters + self.bias, 0).reshape(n, length - 4, -1)
        return flat, made

    def logits(self, x: np.ndarray) -> np.ndarray:
        _, made = self.hidden(x)
        return np.concatenate([made.max(axis=1), made.mean(axis=1)], axis=1) @ self.out + self.out_bias

    def probabilities(self, windows: list[str]) -> np.ndarray:
        if not windows:
            return np.zeros(0)
        return _sigmoid(self.scale * self.logits(encoded(windows)) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def spliced(key: str, other: str, number: int) -> str:
    """The window of a key behind or before a piece of another run, or of a shortened key."""
    inside, rest = (w[AROUND : AROUND + INSIDE].rstrip("\0") for w in (key, other))
    size = 4 + 7 * number % 17
    made = (rest[-size:] + inside, inside[: INSIDE - size] + rest[:size], inside[: INSIDE - size])[number % 3]
    return "\0" * AROUND + made[:INSIDE].ljust(INSIDE, "\0") + "\0" * AROUND


def examples(windows: list[str], labels: list[bool]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """What is shown of findings, its labels, and whether it is held out, as every fifth finding is.

    Each finding is also shown without its context, so that a key is known by itself too, and each
    labelled one next to a piece of another run, as windows of long runs show it.
    """
    held = np.arange(len(labels)) % 5 == 4
    mixed = [k for k, label in enumerate(labels) if label]
    held = np.concatenate([held, held, held[mixed]])
    y = np.array([*labels, *labels, *[True] * len(mixed)], dtype=np.float64)
    others = [w for w, label in zip(windows, labels, strict=True) if not label]
    shown = (
        windows
        + ["\0" * AROUND + w[AROUND:-AROUND] + "\0" * AROUND for w in windows]
        + [spliced(windows[k], others[n % len(others)] if others else "", n) for n, k in enumerate(mixed)]
    )
    return shown, y, held


def started(filters: int = 16) -> tuple[Network, np.random.Generator]:
    random = np.random.default_rng(7)
    net = Network(random.normal(0, 0.15, (5 * CHANNELS, filters)).astype(np.float32),
                  np.zeros(filters), random.normal(0, 0.1, 2 * filters), 0.0)
    return net, random


def fitted(
    net: Network, windows: list[str], y: np.ndarray, share: float, turns: range, of: int, random: np.random.Generator
) -> Network:
    """Adam on the logistic loss, from a network on; ``turns`` of all ``of`` passes.

    ``share`` is that of the labelled among all that is learnt from.
    """
    x = encoded(windows)
    state = [np.zeros_like(np.asarray(p, dtype=np.float64)) for p in
             (net.filters, net.bias, net.out, net.out_bias) for _ in range(2)]
    learn, step = np.arange(len(y)), 0
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    for turn in turns:
        random.shuffle(learn)
        for low in range(0, len(learn), 128):
            step += 1
            rows = learn[low : low + 128]
            flat, made = net.hidden(x[rows])
            n, length, width = made.shape
            top = made.argmax(axis=1)
            pooled = np.concatenate([made.max(axis=1), made.mean(axis=1)], axis=1)
            likely = _sigmoid(pooled @ net.out + net.out_bias)
            wrong = (likely - y[rows]) * weight[rows] / n
            # What still looks like the labelled after a while may be a key that no pattern knows.
            wrong[(turn >= TRUSTED * of) & (y[rows] == 0) & (likely > 0.9)] = 0
            back = wrong[:, None] * net.out
            grad = np.repeat(back[:, None, width:] / length, length, axis=1)
            np.put_along_axis(
                grad, top[:, None, :],
                np.take_along_axis(grad, top[:, None, :], axis=1) + back[:, None, :width], axis=1,
            )
            grad = (grad * (made > 0)).reshape(n * length, width)
            grads = [flat.T @ grad, grad.sum(axis=0), pooled.T @ wrong, wrong.sum()]
            values = [net.filters, net.bias, net.out, net.out_bias]
            for k, g in enumerate(grads):
                state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
                state[2 * k + 1] = 0.999 * state[2 * k + 1] + 0.001 * g * g
                first = state[2 * k] / (1 - 0.9**step)
                second = state[2 * k + 1] / (1 - 0.999**step)
                values[k] = values[k] - 0.01 * first / (np.sqrt(second) + 1e-8)
            net = Network(values[0].astype(np.float32), values[1], values[2], float(values[3]))
    return net


def train(windows: list[str], labels: list[bool]) -> Network | None:
    """The network of one part's findings."""
    shown, y, held = examples(windows, labels)
    if not (0 < y[~held].sum() < (~held).sum() and 0 < y[held].sum() < held.sum()):
        return None
    net, random = started()
    own = [w for w, out in zip(shown, held, strict=True) if not out]
    net = fitted(net, own, y[~held], float(y[~held].mean()), range(PASSES), PASSES, random)
    z, y = net.logits(encoded([w for w, out in zip(shown, held, strict=True) if out])), y[held]

    def sums(a: float, b: float, n1: float, n0: float) -> list[float]:
        aim = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        t = a * z + b
        p = _sigmoid(t)
        w = p * (1 - p)
        return [float(v.sum()) for v in
                (np.logaddexp(0, t) - aim * t, (aim - p) * z, aim - p, w * z * z, w * z, w)]

    steps = np.floor(np.clip(z[y > 0], -LOGIT_LIMIT, LOGIT_LIMIT) / LOGIT_STEP)
    return finished(net, sums, y.sum(), (1 - y).sum(), sorted(zip(*np.unique(steps, return_counts=True), strict=True)))


def finished(net: Network, sums, n1: float, n0: float, steps: list[tuple[float, int]]) -> Network:
    """The network with calibration and threshold; ``steps`` counts the logits of the labelled."""
    net.scale, net.shift = calibrated(sums, float(n1), float(n0))
    missed = 0
    for step, count in steps:
        missed += count
        if missed > int((1 - RECALL) * n1):
            break
    # Even odds, or less where only that keeps the wanted recall.
    net.threshold = min(0.5, float(_sigmoid(net.scale * step * LOGIT_STEP + net.shift)))
    return net


def calibrated(sums, n1: float, n0: float) -> tuple[float, float]:
    """Scale and shift of a logistic fit, with softened targets and a weak prior on both.

    ``sums(a, b, n1, n0)``: loss, two slopes and three curvatures over all held-out findings.  Newton's
    steps are halved until the loss falls: where findings separate, whole steps run away.
    """

    def prior(a: float, b: float) -> float:
        return PRIOR * ((a - 1) ** 2 + b**2) / 2

    a, b = 1.0, 0.0
    at = sums(a, b, n1, n0)
    for _ in range(50):
        _, by_a, by_b, aa, ab, bb = at
        hessian = np.array([[aa, ab], [ab, bb]]) + PRIOR * np.eye(2)
        move = np.linalg.solve(hessian, [by_a - PRIOR * (a - 1), by_b - PRIOR * b])
        now = at[0] + prior(a, b)
        while np.abs(move).max() > 1e-7:
            at = sums(a + move[0], b + move[1], n1, n0)
            if at[0] + prior(a + move[0], b + move[1]) <= now:
                break
            move = move / 2
        else:
            break
        a, b = a + move[0], b + move[1]
    return float(max(a, 1e-3)), float(b)


# --- over a table ----------------------------------------------------------------------------

def findings(docs: DataFrame) -> DataFrame:
    """``seen (window), labelled`` of the candidates of all rows of ``docs``."""

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen, labels = [], []
        for value in batch["text"]:
            text = value.as_py() or ""
            runs = key_runs(text)
            if not runs:
                continue
            spans = pattern_spans(text, runs)
            for start, end, labelled in candidates(runs, spans):
                for low, high in places(start, end):
                    seen.append(window(text, low, high))
                    labels.append(labelled)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.string()), pa.array(labels, pa.bool_())], ["seen", "labelled"]
        )

    return arrow_rows(docs.select("text"), read, "seen string, labelled boolean")


def learnt(docs: DataFrame) -> Network | None:
    """The network of all findings of all documents."""
    found = keep(findings(docs.select("doc_id", "text")).distinct(), "secret-findings")
    parts = max(1, math.ceil(found.count() / PART_FINDINGS))
    key = F.xxhash64("seen")
    dealt = found.withColumns({"key": key, "part": F.pmod(key, F.lit(parts)).cast("int")})

    def expand(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "seen", "labelled"])
        shown, y, held = examples(list(rows["seen"]), list(rows["labelled"]))
        return pd.DataFrame({"part": rows["part"].iloc[0], "place": range(len(y)), "shown": shown, "y": y, "held": held})

    shown = keep(
        dealt.groupBy("part").applyInPandas(expand, "part int, place int, shown string, y double, held boolean"),
        "secret-examples",
    )
    sizes = {r.held: (r.n1, r.n - r.n1) for r in shown.groupBy("held").agg(F.sum("y").alias("n1"), F.count("*").alias("n")).collect()}
    if len(sizes) < 2 or not all(n1 and n0 for n1, n0 in sizes.values()):
        return None
    share = sizes[False][0] / sum(sizes[False])
    rounds = max(LEAST_ROUNDS, math.ceil(PASSES / parts))
    net, _ = started()
    # One part makes all passes at once.
    for turns in [range(PASSES)] if parts == 1 else [range(turn, turn + 1) for turn in range(rounds)]:
        net = _mean_network(shown.where("NOT held"), net, share, turns, PASSES if parts == 1 else rounds)
    return _calibrated_on(shown.where("held"), net, *sizes[True])


def _mean_network(shown: DataFrame, net: Network, share: float, turns: range, of: int) -> Network:
    """The mean of what every part makes of the network, weighted by its rows."""
    shapes = [net.filters.shape, net.bias.shape, net.out.shape, (1,)]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        random = np.random.default_rng([7, turns.start]) if turns.start else started()[1]
        made = fitted(net, list(rows["shown"]), rows["y"].to_numpy(), share, turns, of, random)
        flat = np.concatenate([np.ravel(v) for v in (made.filters, made.bias, made.out, made.out_bias)])
        return pd.DataFrame({"place": range(len(flat)), "value": flat.astype(np.float64), "n": len(rows)})

    # Decimal sums, so that the order of the parts does not matter; one row a parameter is collected.
    weighted = F.sum((F.col("value") * F.col("n")).cast("decimal(38,15)")).cast("double")
    means = (
        shown.groupBy("part").applyInPandas(fit, "place int, value double, n bigint")
        .groupBy("place").agg((weighted / F.sum("n")).alias("value")).orderBy("place").collect()
    )
    cuts = np.cumsum([math.prod(shape) for shape in shapes])[:-1]
    values = [v.reshape(shape) for v, shape in zip(np.split(np.array([r.value for r in means]), cuts), shapes, strict=True)]
    return Network(values[0].astype(np.float32), values[1], values[2], float(values[3][0]))


def _calibrated_on(held: DataFrame, net: Network, n1: float, n0: float) -> Network:
    """The network with calibration and threshold from sums over all rows of ``held``."""

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        z = net.logits(encoded(batch["shown"].to_pylist())) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), batch["y"]], ["z", "y"])

    scored = keep(arrow_rows(held.select("shown", "y"), score, "z double, y double"), "secret-logits")

    def sums(a: float, b: float, n1: float, n0: float) -> list[float]:
        aim = F.when(F.col("y") > 0, (n1 + 1) / (n1 + 2)).otherwise(1 / (n0 + 2))
        t, z, p, w = F.col("t"), F.col("z"), F.col("p"), F.col("w")
        rows = scored.withColumn("t", z * a + b).withColumn("p", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), t)))))
        rows = rows.withColumns({"w": p * (1 - p), "aim": aim})
        terms = (F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t))) - F.col("aim") * t,
                 (F.col("aim") - p) * z, F.col("aim") - p, w * z * z, w * z, w)
        return [float(v) for v in rows.agg(*[F.sum(v.cast("decimal(38,15)")) for v in terms]).first()]

    near = F.greatest(F.lit(-LOGIT_LIMIT), F.least(F.lit(LOGIT_LIMIT), F.col("z")))
    steps = scored.where("y > 0").groupBy(F.floor(near / LOGIT_STEP).alias("step")).count().orderBy("step").collect()
    return finished(net, sums, n1, n0, [(r["step"], r["count"]) for r in steps])


def likely(net: Network, found: list[tuple[int, str, int, int]]) -> Iterator[tuple[int, int, int]]:
    """``row, start, end`` of the candidates with a window over the threshold."""
    windows = (
        (number, window(text, low, high))
        for number, (_, text, start, end) in enumerate(found) for low, high in places(start, end)
    )
    hits = set()
    while some := list(islice(windows, SCORED)):
        over = net.probabilities([seen for _, seen in some]) >= net.threshold
        hits.update(number for (number, _), hit in zip(some, over, strict=True) if hit)
    for number in sorted(hits):
        row, _, start, end = found[number]
        yield row, start, end


def scanned(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """``doc_id, base, spans`` of every row, as ``kind:start:end`` lists; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(network or learnt(docs))

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        net = shared.value
        base, open_runs = [], []
        for row, value in enumerate(batch["text"]):
            text = value.as_py() or ""
            runs = key_runs(text)
            spans = pattern_spans(text, runs)
            base.append(spans)
            for start, end, labelled in candidates(runs, spans) if net else ():
                if not labelled:
                    open_runs.append((row, text, start, end))
        every = [list(spans) for spans in base]
        for row, start, end in likely(net, open_runs):
            every[row].append((start, 3, end))
        counts = [[sum(k == kind for _, k, _ in spans) for spans in base] for kind in range(3)]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], *[pa.array(c, pa.int64()) for c in counts],
             pa.array([written(s) for s in base], pa.string()),
             pa.array([written(sorted(s)) for s in every], pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"],
        )

    return arrow_rows(
        docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), scan,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string",
    )
