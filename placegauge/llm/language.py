"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (lengths 1 to 3 together) that both
have, whatever their number of occurrences, over the geometric mean of their numbers of n-grams.
A bounded sample of labelled texts gives Nystroem landmarks and, for every language, a kernel ridge
regression of "this language" against the rest; texts are scored by matrix products in batches.

Defined results: a null text or one without letters is ``und`` with score 0; so is everything if
no text is labelled.  Repeated rows are scored row by row; rows without doc_id or lang teach nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placegauge.llm.common import arrow_rows, lists

# Labelled texts that are learnt from, in all, and at most for one language.
SAMPLE_TEXTS = 2400
SAMPLE_PER_LANGUAGE = 150
# Landmarks of one language, and in all.
LANDMARKS_PER_LANGUAGE = 24
LANDMARKS = 384
RIDGE = 1e-3
# Share of a text's n-grams that landmarks have, below which its score shrinks.
KNOWN_SHARE = 0.3
BATCH = 64

_NO_LETTERS = re.compile(r"[\W\d_]+")


def grams(text: str | None) -> np.ndarray:
    """Sorted codes of the distinct n-grams of a text's letters; empty if it has none.

    A code point takes 21 bits, so that up to three fit into one integer.
    """
    clean = f" {_NO_LETTERS.sub(' ', text.lower()).strip()} " if text else "  "
    if not any(map(str.isalpha, clean)):
        return np.zeros(0, dtype=np.int64)
    one = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    two = (one[:-1] << 21) | one[1:]
    three = (two[:-1] << 21) | one[2:]
    return np.concatenate([np.unique(one), np.unique(two), np.unique(three)])


@dataclass
class Model:
    """n-grams of the landmarks, which landmark has which, and the weights of every language."""

    languages: list[str]
    vocabulary: np.ndarray
    presence: np.ndarray  # n-grams x landmarks
    sizes: np.ndarray  # square roots of the landmarks' numbers of n-grams
    weights: np.ndarray  # landmarks x languages

    def present(self, found: list[np.ndarray]) -> np.ndarray:
        """Which n-grams of the vocabulary each text has."""
        rows = np.zeros((len(found), len(self.vocabulary)), dtype=np.float32)
        for row, codes in zip(rows, found, strict=True):
            at = np.searchsorted(self.vocabulary, codes)
            at[at == len(self.vocabulary)] = 0
            row[at[self.vocabulary[at] == codes]] = 1
        return rows

    def kernel(self, found: list[np.ndarray], rows: np.ndarray | None = None) -> np.ndarray:
        rows = self.present(found) if rows is None else rows
        own = np.sqrt(np.maximum(1, [len(codes) for codes in found]))
        return (rows @ self.presence).astype(np.float64) / own[:, None] / self.sizes

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [grams(text) for text in texts]
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        rows = self.present(found)
        worth = self.kernel(found, rows) @ self.weights
        best = worth.argmax(axis=1)
        # A text of strange n-grams is like no language, whichever it is least unlike.
        known = rows.sum(axis=1) / np.maximum(1, [len(codes) for codes in found])
        scores = np.clip((1 + worth.max(axis=1)) / 2, 0, 1) * np.minimum(1, known / KNOWN_SHARE)
        return [
            (self.languages[k], float(score)) if len(codes) else ("und", 0.0)
            for k, score, codes in zip(best, scores, found, strict=True)
        ]


def fit(languages: list[str], found: list[np.ndarray]) -> Model:
    """Landmarks are the first texts of each language in the given order."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros(1, np.int64), np.zeros((1, 0), np.float32), np.ones(0), np.zeros((0, 0)))
    each = max(1, min(LANDMARKS_PER_LANGUAGE, LANDMARKS // len(names)))
    marks = [
        codes for name in names
        for codes in [c for own, c in zip(languages, found, strict=True) if own == name][:each]
    ]
    vocabulary = np.unique(np.concatenate(marks))
    presence = np.zeros((len(vocabulary), len(marks)), dtype=np.float32)
    for column, codes in enumerate(marks):
        presence[np.searchsorted(vocabulary, codes), column] = 1
    model = Model(names, vocabulary, presence, np.sqrt([len(c) for c in marks]), np.zeros(0))
    among = model.kernel(marks)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    large = values > 1e-8 * values.max()
    root = vectors[:, large] / np.sqrt(values[large])  # Nystroem map of a kernel row
    gathered = np.zeros((root.shape[1], root.shape[1]))
    aims = np.zeros((root.shape[1], len(names)))
    for low in range(0, len(found), BATCH):
        rows = model.kernel(found[low : low + BATCH]) @ root
        wanted = np.array([[1 if n == name else -1 for name in names] for n in languages[low : low + BATCH]])
        gathered += rows.T @ rows
        aims += rows.T @ wanted
    ridge = RIDGE * len(found) * np.eye(root.shape[1])
    model.weights = root @ np.linalg.solve(gathered + ridge, aims)
    return model


def held_out() -> Column:
    """Documents that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learnt(docs: DataFrame) -> Model:
    """The model of a bounded sample of the labelled texts, the same for the same table.

    For each language the texts with the smallest hashes of their ids; Spark limits every
    partition before it shuffles.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    names = labelled.select("lang").distinct().count()
    most = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_TEXTS // max(1, names)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    sample = (
        labelled.where("text is not null").select("lang", "doc_id", "text")
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    )

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(
            [batch["lang"], batch["place"], lists([grams(t.as_py()) for t in batch["text"]], pa.int64())],
            ["lang", "place", "grams"],
        )

    table = arrow_rows(
        sample.select("lang", "place", "text"), read, "lang string, place int, grams array<bigint>"
    ).toArrow().sort_by([("lang", "ascending"), ("place", "ascending")])
    pairs = [
        (lang, np.array(codes.values))
        for lang, codes in zip(table["lang"].to_pylist(), table["grams"], strict=True)
        if len(codes.values)
    ]
    return fit([lang for lang, _ in pairs], [codes for _, codes in pairs])


def identified(
    docs: DataFrame, model: Model | None = None, lang_column: str = "lang_pred", score_column: str = "score"
) -> DataFrame:
    """``docs`` with the language and its score (0 to 1), from the text alone; no shuffle.

    Other columns stay, whatever their names; those named like the two given give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or learnt(docs))
    rows = docs.drop(lang_column, score_column)

    def predict(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = []
        for low in range(0, batch.num_rows, BATCH):
            made += shared.value.predict(batch["text"].slice(low, BATCH).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([m[0] for m in made], pa.string()),
             pa.array([m[1] for m in made], pa.float64())],
            [*batch.schema.names, lang_column, score_column],
        )

    schema = docs.drop(lang_column, score_column).schema.add(lang_column, "string").add(score_column, "double")
    return arrow_rows(rows, predict, schema)
