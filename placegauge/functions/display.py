"""Display texts of published values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placegauge import fixed_values as fv


def score_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit("unknown"))
        .when(score >= fv.BAND_LARGE, F.lit("large"))
        .when(score >= fv.BAND_MEDIUM, F.lit("medium"))
        .otherwise(F.lit("small"))
    )


def band_label(band: Column, labels: dict[str, str]) -> Column:
    """The caller's word for a band."""
    words = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
    return F.element_at(words, band)


def score_text(score: Column) -> Column:
    one_decimal = F.format_string("%.1f", score)
    return F.when(score.isNull(), F.lit(fv.NO_SCORE_TEXT)).otherwise(one_decimal)


def raw_text(value: Column) -> Column:
    return F.when(value.isNull(), F.lit(fv.NO_RAW_TEXT)).otherwise(F.format_number(value, 0))


def observation_text(position: Column) -> Column:
    """1-based position as 'No. 001'; longer numbers are not cut."""
    text = position.cast("string")
    return F.concat(
        F.lit("No. "), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)
    )


def rank_text(of: Column, rank: Column) -> Column:
    return F.concat(of.cast("string"), F.lit(" 駅中 "), rank.cast("string"), F.lit(" 位"))


def range_text(lowest: Column, highest: Column) -> Column:
    low, high = lowest.cast("string"), highest.cast("string")
    return F.when(lowest == highest, F.concat(low, F.lit(" 位"))).otherwise(
        F.concat(low, F.lit("〜"), high, F.lit(" 位"))
    )
