"""How good rules and classifier are on a labelled set: one keyed join, one pass of sums.

A labelled item is asked in several languages, and in the first one several times.  Questions and
answers meet by the content key of what was asked, so answers come from the store like all others;
repeats of a question are a group, of which the first counts and all tell whether it is stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.functions.rounding import round_half_even
from placegauge.operators.facilities import rule_prediction
from placegauge.operators.judgements import GATES, judgement_key
from placegauge.operators.skew import split_join
from placegauge.session import cut

PREDICTORS = ("rule", "model", "model_other")


def item_state(kind: Column) -> Column:
    """The text by which an item is described when it is asked about."""
    facility, dataset = fv.ITEM_STATE["facility"], fv.ITEM_STATE["dataset"]

    def given(text: Column, default: str) -> Column:
        return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))

    def line(names: list[str], values: list[Column]) -> Column:
        lines = [F.concat(F.lit(f"{n}: "), F.coalesce(v, F.lit(""))) for n, v in zip(names, values, strict=True)]
        return F.concat_ws("\n", *lines)

    columns = F.array_join(F.coalesce("columns", F.array().cast("array<string>")), ", ")
    return F.when(
        kind == "facility",
        line(facility, [F.col("name"), given(F.col("categories"), fv.NO_CATEGORIES), F.col("source")]),
    ).otherwise(line(dataset, [F.col("name"), F.col("organization"), given(columns, fv.NO_COLUMNS)]))


def labelled(items: DataFrame, kind: str) -> DataFrame:
    """(kind, item_no, name, label, ambiguous, destination, rule, state) of a labelled set.

    Facilities are answered by the rules here; datasets bring the rules' answer along.
    """
    categories = F.when(F.col("categories") != "", F.array("categories")).otherwise(F.array().cast("array<string>"))
    rule = rule_prediction(F.col("name"), categories) if kind == "facility" else F.col("rule")
    return items.select(
        F.lit(kind).alias("kind"),
        F.monotonically_increasing_id().alias("item_no"),
        "name",
        "label",
        F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"),
        "destination",
        rule.alias("rule"),
        item_state(F.lit(kind)).alias("state"),
    )


def asked(items: DataFrame, questions: dict[str, dict[str, str]]) -> DataFrame:
    """(kind, item_no, language, key): ``questions`` is canonical JSON by kind and language."""
    each = [
        F.struct(F.lit(kind).alias("of"), F.lit(language).alias("language"), F.lit(text).alias("text"))
        for kind, texts in questions.items()
        for language, text in texts.items()
    ]
    rows = items.withColumn("q", F.explode(F.array(*each))).where(F.col("q.of") == F.col("kind"))
    key = judgement_key(F.col("state"), F.col("q.text"))
    return rows.select("kind", "item_no", F.col("q.language").alias("language"), key.alias("key"))


def predictions(
    items: DataFrame, questions: dict[str, dict[str, str]], answers: DataFrame, languages: tuple[str, str]
) -> DataFrame:
    """Items with the answers of all predictors; ``model`` is null where nothing is stored.

    ``answers``: key, repeat, category, confidence, list_score.  ``model`` is the first answer in the
    first language, ``stable`` whether its repeats agree, ``model_other`` that in the second.
    """
    met = split_join(
        answers.select("key", "repeat", "category", "confidence", "list_score"),
        asked(items, questions), ["key"], F.col("repeat"),
    )
    first, other = (F.col("language") == language for language in languages)

    def earliest(of: Column, column: str) -> Column:
        return F.min_by(F.when(of, F.col(column)), F.when(of, F.col("repeat")))

    grouped = met.groupBy("kind", "item_no").agg(
        earliest(first, "category").alias("model"),
        earliest(first, "confidence").alias("confidence"),
        earliest(first, "list_score").alias("list_score"),
        (F.min(F.when(first, F.col("category"))) == F.max(F.when(first, F.col("category")))).alias("stable"),
        earliest(other, "category").alias("model_other"),
    )
    return items.join(grouped, ["kind", "item_no"], "left")


def metrics(predicted: DataFrame, gates: tuple[float, ...] = GATES) -> DataFrame:
    """(kind, metric, name, value) for each kind of item, rounded to 3 digits.

    Ambiguous items and those without a stored answer are counted, but not scored.
    """
    answered = F.col("model").isNotNull()
    scored = ~F.col("ambiguous") & answered

    def share(part: Column, whole: Column) -> Column:
        return F.count_if(part) / F.greatest(F.count_if(whole), F.lit(1))

    def right(predictor: str) -> Column:
        return scored & F.coalesce(F.col(predictor) == F.col("label"), F.lit(False))

    known = scored & F.col("destination").isNotNull()
    wanted: list[tuple[str, str, Column]] = [
        ("items", "", F.count(F.lit(1))),
        ("scored", "", F.count_if(scored)),
        ("open", "", F.count_if(~answered)),
        *[("accuracy", p, share(right(p), scored)) for p in PREDICTORS],
        ("stable_rate", "model", share(F.coalesce("stable", F.lit(False)), answered)),
        ("destination_accuracy", "model",
         F.try_divide(F.count_if(known & ((F.col("list_score") >= 0.5) == F.col("destination"))), F.count_if(known))),
        ("fixed", "model", F.count_if(right("model") & ~right("rule"))),
        ("broken", "model", F.count_if(right("rule") & ~right("model"))),
    ]
    for gate in gates:
        sure = scored & (F.col("confidence") >= gate)
        wanted.append(("coverage", str(gate), share(sure, scored)))
        wanted.append(("gate_accuracy", str(gate), share(sure & right("model"), sure)))
    sums = predicted.groupBy("kind").agg(
        *[value.cast("double").alias(f"m{k}") for k, (_, _, value) in enumerate(wanted)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.lit(n).alias("name"), F.col(f"m{k}").alias("value"))
            for k, (m, n, _) in enumerate(wanted)
        ]
    )
    each = sums.select("kind", F.inline(rows))
    return each.where("value IS NOT NULL").withColumn("value", round_half_even(F.col("value"), 3))


def confusions(predicted: DataFrame) -> DataFrame:
    """(kind, label, answer, n) of the classifier's wrong answers."""
    wrong = predicted.where(~F.col("ambiguous") & (F.col("model") != F.col("label")))
    return wrong.groupBy("kind", "label", F.col("model").alias("answer")).agg(F.count(F.lit(1)).alias("n"))


def differences(predicted: DataFrame) -> DataFrame:
    """(kind, name, label, rule, model, right) where just one of rules and classifier is right."""
    rule, model = F.col("rule") == F.col("label"), F.col("model") == F.col("label")
    return predicted.where(~F.col("ambiguous") & (rule != model)).select(
        "kind", "name", "label", "rule", "model", F.when(rule, F.lit("rule")).otherwise(F.lit("model")).alias("right")
    )


def unanswered(predicted: DataFrame, questions: dict[str, dict[str, str]], answers: DataFrame) -> DataFrame:
    """Distinct (kind, language, key, state) that the store has no answer to: what to ask next."""
    open_ = asked(predicted, questions).join(answers.select("key").distinct(), "key", "left_anti")
    states = predicted.select("kind", "item_no", "state")
    return open_.join(states, ["kind", "item_no"]).select("kind", "language", "key", "state").distinct()


def frozen(*sets: DataFrame) -> DataFrame:
    """All labelled sets as one table whose item numbers stay."""
    both = sets[0]
    for more in sets[1:]:
        both = both.unionByName(more)
    return cut(both)
