"""Evidence signals of a catalog package, and the verdicts built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.functions.rounding import compensated_sum, round_half_even
from placegauge.functions.text import contains_any, hits, words_array


def _found(words: Column) -> Column:
    return F.size(words) > 0


def semantic_hits(title, resource_names, other_text, keywords, list_hints) -> dict[str, Column]:
    """The word lists that decide the semantic signal."""
    in_resources = F.array_sort(
        F.array_distinct(F.flatten(F.transform(resource_names, lambda n: hits(n, keywords))))
    )
    return {
        "title_hits": hits(title, keywords),
        "hint_hits": hits(title, list_hints),
        "resource_hits": in_resources,
        "other_hits": hits(other_text, keywords),
    }


def semantic_signal(title_hits, hint_hits, resource_hits, other_hits) -> Column:
    """1.0 title names concept and list, 0.7 title or a resource name, 0.4 notes or tags, else 0."""
    return (
        F.when(_found(title_hits) & _found(hint_hits), F.lit(1.0))
        .when(_found(title_hits) | _found(resource_hits), F.lit(0.7))
        .when(_found(other_hits), F.lit(0.4))
        .otherwise(F.lit(0.0))
    )


def _text(template: str, words: Column) -> Column:
    before, after = template.split("{words}")
    return F.concat(F.lit(before), F.array_join(words, fv.QUOTE_SEPARATOR), F.lit(after))


def semantic_reason(title_hits, hint_hits, resource_hits, other_hits) -> Column:
    return (
        F.when(
            _found(title_hits) & _found(hint_hits),
            _text(fv.REASON_TITLE_LIST, F.concat(title_hits, hint_hits)),
        )
        .when(_found(title_hits), _text(fv.REASON_TITLE, title_hits))
        .when(_found(resource_hits), _text(fv.REASON_RESOURCE, resource_hits))
        .when(_found(other_hits), _text(fv.REASON_NOTES, other_hits))
        .otherwise(F.lit(fv.REASON_NO_KEYWORD))
    )


def format_score(fmt: Column, datastore_active: Column) -> Column:
    """Usability of a resource format; null when it cannot be read."""
    scores = F.create_map(*[F.lit(v) for kv in fv.FORMAT_SCORES.items() for v in kv])
    key = F.upper(F.trim(F.coalesce(fmt, F.lit(""))))
    return F.when(F.coalesce(datastore_active, F.lit(False)), F.lit(fv.DATASTORE_SCORE)).otherwise(
        F.element_at(scores, key)
    )


def location_signal(inspected, coord_fill, address_fill, has_address) -> Column:
    """Null when not inspected; source coordinates first, then addresses to look up."""
    address = F.when(has_address, F.coalesce(address_fill, F.lit(0.0))).otherwise(F.lit(0.0))
    return F.when(
        inspected,
        F.when(coord_fill >= fv.ACCEPT_MIN_FILL, F.lit(1.0))
        .when(address >= fv.ACCEPT_MIN_FILL, F.lit(fv.GEOCODE_LOCATION))
        .when(coord_fill > 0, round_half_even(coord_fill / F.lit(fv.ACCEPT_MIN_FILL), 3))
        .when(address > 0, round_half_even(address * F.lit(fv.GEOCODE_LOCATION), 3))
        .otherwise(F.lit(0.0)),
    )


def location_source(inspected, coord_fill, address_fill, has_address) -> Column:
    address = F.when(has_address, F.coalesce(address_fill, F.lit(0.0))).otherwise(F.lit(0.0))
    return F.when(
        inspected,
        F.when(coord_fill >= fv.ACCEPT_MIN_FILL, F.lit("source"))
        .when(address >= fv.ACCEPT_MIN_FILL, F.lit("geocode"))
        .when(coord_fill > 0, F.lit("source"))
        .when(address > 0, F.lit("geocode")),
    )


def license_signal(license_id: Column, license_title: Column) -> Column:
    known = F.coalesce(F.lower(license_id).isin(*fv.OPEN_LICENSE_IDS), F.lit(False))
    return F.when(
        known | contains_any(license_title, fv.OPEN_LICENSE_WORDS), F.lit(1.0)
    ).otherwise(F.lit(0.5))


def freshness_signal(modified: Column, now: Column) -> Column:
    """By age in whole days / 365.25; missing or unreadable counts as old."""
    then = F.try_to_timestamp(modified)
    age = F.unix_micros(now) - F.unix_micros(then)
    years = F.floor(age / F.lit(86_400_000_000.0)) / F.lit(365.25)
    return F.when(years <= 2, F.lit(1.0)).when(years <= 5, F.lit(0.6)).otherwise(F.lit(0.3))


def confidence(semantic, fmt, location, license_, freshness) -> Column:
    """Weighted sum; an unknown location counts half."""
    w = fv.SIGNAL_WEIGHTS
    terms = [
        F.lit(w["semantic"]) * F.coalesce(semantic, F.lit(0.0)),
        F.lit(w["format"]) * F.coalesce(fmt, F.lit(0.0)),
        F.lit(w["location"]) * F.coalesce(location, F.lit(fv.UNKNOWN_LOCATION)),
        F.lit(w["license"]) * F.coalesce(license_, F.lit(0.0)),
        F.lit(w["freshness"]) * F.coalesce(freshness, F.lit(0.0)),
    ]
    return round_half_even(compensated_sum(terms), 3)


def verdict(has_resource, excluded_hits, semantic, confidence_, location) -> Column:
    accepted = (
        (confidence_ >= fv.ACCEPT_CONFIDENCE)
        & (semantic >= fv.ACCEPT_MIN_SEMANTIC)
        & F.coalesce(location >= fv.ACCEPT_MIN_LOCATION, F.lit(False))
    )
    return (
        F.when(~has_resource | _found(excluded_hits) | (semantic == 0), F.lit("rejected"))
        .when(accepted, F.lit("accepted"))
        .otherwise(F.lit("review"))
    )


def verdict_reason(
    semantic_text, has_resource, excluded_hits, semantic, detail: list[Column], modified
) -> Column:
    """Sentences in the order they were decided; details only for a usable candidate."""
    usable = has_resource & ~_found(excluded_hits) & (semantic != 0)
    updated = fv.REASON_UPDATED.split("{date}")[0]
    parts = [
        semantic_text,
        F.when(~has_resource, F.lit(fv.REASON_NO_RESOURCE)).when(
            _found(excluded_hits), _text(fv.REASON_EXCLUDED, excluded_hits)
        ),
        *[F.when(usable, d) for d in detail],
        F.when(modified != "", F.concat(F.lit(updated), F.substring(modified, 1, 10))),
    ]
    return F.concat_ws(fv.REASON_SEPARATOR, *parts)


def classifier_verdict(feature, status, category, judged_confidence, list_score, location):
    """Columns (status, row_filter) for a rule-``review`` row with a judgement; others keep theirs.

    row_filter is true only where a mixed list was judged usable.
    """
    listed = F.coalesce(list_score, F.lit(0.0))
    confident = judged_confidence >= fv.DATASET_MIN_CONFIDENCE
    usable = category.isin(fv.MIXED) | (category == feature)
    located = F.coalesce(location, F.lit(0.0)) >= fv.ACCEPT_MIN_LOCATION
    decides = (status == "review") & category.isNotNull()
    take = decides & confident & usable & (listed >= fv.DATASET_MIN_LIST)
    drop = decides & confident & (~usable | (listed < fv.DATASET_REJECT_LIST))
    new_status = (
        F.when(take & located, F.lit("accepted"))
        .when(~take & drop, F.lit("rejected"))
        .otherwise(status)
    )
    return new_status, F.coalesce(take & (category == fv.MIXED), F.lit(False))


def names_no_keyword(title: Column, keywords) -> Column:
    """The title does not name the concept, so rows have to be filtered one by one."""
    words = keywords if isinstance(keywords, Column) else words_array(keywords)
    return ~contains_any(title, words)
