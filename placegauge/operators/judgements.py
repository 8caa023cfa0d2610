"""Stored classifier answers: keys, hits and misses, and how good the answers are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.functions.rounding import round_half_even
from placegauge.functions.signals import classifier_verdict
from placegauge.operators.skew import split_join
from placegauge.session import cut

GATES = (0.5, 0.6, 0.7, 0.8, 0.9)


def judgement_key(state: Column, questions: Column) -> Column:
    """Content key of what is asked; the model's name is not part of it.

    The text is canonical JSON: keys in order, one blank after ``:`` and ``,``.  ``questions`` is
    JSON text of that form, ``state`` any text.
    """
    quoted = F.to_json(F.array(state))
    quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    return F.sha2(
        F.concat(F.lit('{"questions": '), questions, F.lit(', "state": '), quoted, F.lit("}")), 256
    )


def split_by_store(asked: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, distinct open questions): hits carry the stored answer, misses are to be asked.

    A popular question is split; of equal keys the first row by content is asked.
    """
    whole = F.struct(*asked.columns)
    answered = split_join(asked, store, ["key"], whole)
    first = asked.groupBy("key").agg(F.min_by(whole, F.to_json(whole)).alias("q"))
    return answered, first.join(store, "key", "left_anti").select("q.*")


def add_to_store(store: DataFrame, answers: DataFrame) -> DataFrame:
    """New answers replace old ones of the same key."""
    return store.join(answers.select("key"), "key", "left_anti").unionByName(answers)


SEMANTIC = "struct<classifier string, category string, confidence double, list_score double, error string>"


def semantic(judged: DataFrame) -> Column:
    """What was judged and by whom, as it is kept; columns that ``judged`` lacks are null."""
    kept = []
    for name in ("classifier", "category", "confidence", "list_score", "error"):
        given = F.col(name) if name in judged.columns else F.lit(None)
        kept.append(given.alias(name))
    return F.struct(*kept).cast(SEMANTIC)


def judgement_note(decision: Column, outcome: Column) -> Column:
    """What the classifier said and what became of it, or that it failed; null without either."""

    def two(x: Column) -> Column:
        return F.format_string("%.2f", round_half_even(F.coalesce(x, F.lit(0.0)), 2))

    name = F.coalesce(decision["classifier"], F.lit(fv.CLASSIFIER))
    said = F.concat(
        name, F.lit(": "), decision["category"], F.lit(fv.NOTE_CONFIDENCE), two(decision["confidence"]),
        F.lit(fv.NOTE_LIST), two(decision["list_score"]), F.lit(fv.NOTE_END), outcome,
    )
    failed = F.concat(name, F.lit(fv.NOTE_FAILED), decision["error"])
    return F.when(decision["error"].isNotNull(), failed).otherwise(said)


def apply_dataset_judgements(entries: DataFrame, judgements: DataFrame) -> DataFrame:
    """Rule-``review`` entries decided by their judgement where it is clear.

    ``judgements``: feature, dataset_id, category, confidence, list_score; also classifier and error,
    where known.  Entries that were asked about keep the judgement as ``semantic``, and their
    ``reason`` says what it was and what became of it.
    """
    judged = judgements.select("feature", "dataset_id", semantic(judgements).alias("__judged"))
    joined = entries.drop("semantic").join(judged, ["feature", "dataset_id"], "left")
    decision = F.col("__judged")
    asked = (F.col("status") == "review") & decision.isNotNull()
    usable = F.when(decision["error"].isNull(), decision["category"])
    status, mixed = classifier_verdict(
        F.col("feature"), F.col("status"), usable, decision["confidence"], decision["list_score"], F.col("location")
    )
    sure = decision["confidence"] >= fv.DATASET_MIN_CONFIDENCE
    fits = decision["category"].isin(fv.MIXED) | (decision["category"] == F.col("feature"))
    listed = F.coalesce(decision["list_score"], F.lit(0.0)) >= fv.DATASET_MIN_LIST
    outcome = (
        F.when(status == "accepted", F.lit(fv.NOTE_ACCEPTED))
        .when(status == "rejected", F.lit(fv.NOTE_REJECTED))
        .when(sure & fits & listed, F.lit(fv.NOTE_NO_PLACE))
        .otherwise(F.lit(fv.NOTE_UNSURE))
    )
    note = F.when(asked, F.concat(F.lit(fv.REASON_SEPARATOR), judgement_note(decision, outcome)))
    columns = {
        "__status": status,
        "__mixed": mixed,
        "__note": F.coalesce(note, F.lit("")),
        "semantic": F.when(asked, decision),
    }
    changes = {
        "auto_status": F.when(F.col("__status") != F.col("status"), F.col("__status")).otherwise(F.col("auto_status")),
        "row_filter": F.col("row_filter") | F.col("__mixed"),
        "status": F.col("__status"),
    }
    if "reason" in entries.columns:
        changes["reason"] = F.concat("reason", "__note")
    kept = [c for c in entries.columns if c != "semantic"]
    return joined.withColumns(columns).withColumns(changes).select(*kept, "semantic")


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: round_half_even(F.col(n), 3) for n in names})


def accuracy(items: DataFrame, predictors: list[str]) -> DataFrame:
    """(predictor, scored, accuracy) over unambiguous items. ``items``: label, ambiguous, …"""
    scored = items.where(~F.coalesce("ambiguous", F.lit(False)))
    pairs = F.array(
        *[F.struct(F.lit(p).alias("predictor"), F.col(p).alias("answer")) for p in predictors]
    )
    each = scored.select("label", F.explode(pairs).alias("p")).select("label", "p.*")
    counted = each.groupBy("predictor").agg(
        F.count(F.lit(1)).alias("scored"),
        _share(F.count_if(F.col("answer") == F.col("label")), F.count(F.lit(1))).alias("accuracy"),
    )
    return _rounded(counted, "accuracy")


def stability(answers: DataFrame) -> DataFrame:
    """(items, stable_rate): share of items with one distinct answer over all repeats."""
    per_item = answers.groupBy("item_id").agg(
        (F.min("answer").eqNullSafe(F.max("answer"))).alias("same")
    )
    counted = per_item.agg(
        F.count(F.lit(1)).alias("items"),
        _share(F.count_if("same"), F.count(F.lit(1))).alias("stable_rate"),
    )
    return _rounded(counted, "stable_rate")


def confidence_gates(items: DataFrame, predictor: str, sure: str, gates=GATES) -> DataFrame:
    """(gate, coverage, accuracy) of the answers at least that confident."""
    scored = items.where(~F.coalesce("ambiguous", F.lit(False)))
    each = scored.withColumn("gate", F.explode(F.array(*[F.lit(g) for g in gates])))
    kept = F.col(sure) >= F.col("gate")
    right = kept & (F.col(predictor) == F.col("label"))
    counted = each.groupBy("gate").agg(
        _share(F.count_if(kept), F.count(F.lit(1))).alias("coverage"),
        _share(F.count_if(right), F.greatest(F.count_if(kept), F.lit(1))).alias("accuracy"),
    )
    return _rounded(counted, "coverage", "accuracy")


def threshold_accuracy(items: DataFrame, score: str, truth: str, threshold: float = 0.5):
    """(scored, accuracy) of ``score >= threshold`` as an answer to a yes/no label."""
    known = items.where(
        ~F.coalesce("ambiguous", F.lit(False)) & F.col(truth).isNotNull()
    )
    right = (F.col(score) >= threshold) == F.col(truth)
    counted = known.agg(
        F.count(F.lit(1)).alias("scored"),
        F.try_divide(F.count_if(right), F.count(F.lit(1))).alias("accuracy"),
    )
    return _rounded(counted, "accuracy")


def confusion(items: DataFrame, predictor: str) -> DataFrame:
    """(label, answer, n) of the wrong answers."""
    wrong = items.where(
        ~F.coalesce("ambiguous", F.lit(False)) & (F.col(predictor) != F.col("label"))
    )
    return wrong.groupBy("label", F.col(predictor).alias("answer")).agg(
        F.count(F.lit(1)).alias("n")
    )


def disagreements(items: DataFrame, one: str, other: str) -> DataFrame:
    """Items one predictor has right and the other wrong: (item_id, right)."""
    scored = items.where(~F.coalesce("ambiguous", F.lit(False)))
    right_one = F.col(one) == F.col("label")
    right_other = F.col(other) == F.col("label")
    return scored.where(right_one != right_other).select(
        "item_id", F.when(right_one, F.lit(one)).otherwise(F.lit(other)).alias("right")
    )


def call_costs(calls: DataFrame, price_per_million: float) -> DataFrame:
    """(calls, tokens, cost, p50): token price and the upper median of the latency.

    The median is read off the histogram of latencies in milliseconds.
    """
    from placegauge.operators.scoring import value_histogram, value_ranks

    totals = calls.agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))
    values = calls.select(F.lit("latency").alias("feature"), F.col("latency").alias("raw"))
    middle = F.floor(F.col("n") / 2)
    median = value_ranks(cut(value_histogram(values))).where(
        (F.col("below") <= middle) & (middle < F.col("below") + F.col("equal"))
    )
    one_row = (
        totals.unionByName(median.select(F.col("raw").alias("p50")), allowMissingColumns=True)
        .agg(*[F.max(c).alias(c) for c in ("calls", "tokens", "p50")])
        .withColumn("cost", F.col("tokens") / 1e6 * price_per_million)
    )
    return one_row.select(
        "calls",
        "tokens",
        round_half_even(F.col("cost"), 4).alias("cost"),
        round_half_even(F.col("p50"), 3).alias("p50"),
    )


def dataset_descriptors(
    entries: DataFrame, files: int | None = None, fields: int | None = None
) -> DataFrame:
    """What a dataset is described by when it is judged; ``files`` and ``fields`` may limit both.

    ``entries``: feature, dataset_id, name, organization, files array<string>, fields array<string>.
    """
    return entries.select(
        "feature",
        "dataset_id",
        "name",
        "organization",
        *[
            (F.slice(name, 1, most) if most is not None else F.col(name)).alias(name)
            for name, most in (("files", files), ("fields", fields))
        ],
    )
