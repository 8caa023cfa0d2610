"""What published tables have to look like, declared once and checked in one pass over each table.

A contract names the columns of a table with their kind, values, patterns and ranges, also those inside
lists and structs, and the columns that no two rows may share.  ``violations`` turns it into one
projection, whose rows are the rules that are broken, and one grouping for uniqueness.  Kinds and
columns are compared with the schema, without reading a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placegauge import fixed_values as fv

KINDS = {
    "text": (T.StringType,),
    "number": (T.NumericType,),
    "whole": (T.IntegralType,),
    "list": (T.ArrayType,),
    "struct": (T.StructType,),
}


@dataclass(frozen=True)
class Field:
    """One column, element of a list or part of a struct."""

    kind: str
    optional: bool = False
    filled: bool = False
    among: tuple[str, ...] | None = None
    matches: str | None = None
    least: float | None = None
    most: float | None = None
    each: Field | None = None
    parts: tuple[tuple[str, Field], ...] = ()

    def or_null(self) -> Field:
        return replace(self, optional=True)


@dataclass(frozen=True)
class Contract:
    fields: dict[str, Field]
    key: tuple[str, ...]
    unique: bool = True


def text(**rules) -> Field:
    return Field("text", **rules)


def number(least: float | None = None, most: float | None = None, kind: str = "number") -> Field:
    return Field(kind, least=least, most=most)


def whole(least: float | None = None, most: float | None = None) -> Field:
    return number(least, most, "whole")


def list_of(each: Field) -> Field:
    return Field("list", each=each)


def struct(**parts: Field) -> Field:
    return Field("struct", parts=tuple(parts.items()))


ID, URL = text(filled=True), text(matches=r"^https?://[^\s]+")
FEATURE = text(among=tuple(fv.FEATURES))
PERCENT, SHARE, COUNT, PLACE = number(0, 100), number(0, 1), whole(0), whole(1)
STATUS = text(among=("complete", "incomplete"))

CONTRACTS = {
    "sites": Contract(
        {"site_id": text(matches=r"^[a-z0-9-]+\z"), "name": text(filled=True), "lat": number(-90, 90),
         "lng": number(-180, 180)},
        ("site_id",),
    ),
    "values": Contract(
        {"site_id": ID, "feature": FEATURE, "raw": number(0).or_null(), "percentile": PERCENT.or_null(),
         "low": PERCENT.or_null()},
        ("site_id", "feature"),
    ),
    "weights": Contract(
        {"site_id": ID, "feature": FEATURE, "effective_weight": SHARE.or_null()}, ("site_id", "feature")
    ),
    "scores": Contract(
        {"site_id": ID, "score": PERCENT.or_null(), "coverage": SHARE, "rank": PLACE.or_null(), "of": PLACE.or_null(),
         "rank_min": PLACE.or_null(), "rank_max": PLACE.or_null()},
        ("site_id",),
    ),
    "evidence": Contract(
        {"site_id": ID, "feature": FEATURE, "facility_id": ID, "name": text(filled=True), "distance_m": number(0),
         "coord_source": text(among=("source", "geocode"))},
        ("site_id", "feature", "facility_id"),
    ),
    "areas": Contract(
        {"site_id": ID, "feature": FEATURE, "code": ID, "name": text(filled=True),
         "coverage": text(among=("covered", "partial", "uncovered")), "unlocated": number(0)},
        ("site_id", "feature", "code"),
    ),
    "aggregates": Contract(
        {"site_id": ID, "feature": FEATURE, "status": STATUS, "count": COUNT.or_null(), "lower_bound": COUNT},
        ("site_id", "feature"),
    ),
    "usage": Contract(
        {"site_id": ID, "status": STATUS, "count": COUNT.or_null(), "lower_bound": COUNT,
         "fiscal_year": whole().or_null(), "missing": list_of(ID)},
        ("site_id",),
    ),
    "lines": Contract(
        {"site_id": ID, "operator": text(filled=True), "line": text(), "thousands": number(0)},
        ("site_id", "operator", "line"), unique=False,
    ),
    "sources": Contract(
        {"site_id": ID, "feature": FEATURE, "source_id": ID, "source_name": text(filled=True), "url": URL.or_null(),
         "kind": text(among=("fixture", "opendata", "statistics"))},
        ("site_id", "feature", "source_id"),
    ),
    "register": Contract(
        {"feature": FEATURE, "dataset_id": ID, "name": text(filled=True), "source_url": URL,
         "status": text(among=("accepted",)), "auto_status": text(among=tuple(fv.STATUSES)),
         "reason": text(filled=True),
         "ingest": struct(status=text(among=tuple(fv.INGEST_STATUSES)), located=number(0).or_null()).or_null()},
        ("feature", "dataset_id"),
    ),
    "facilities": Contract(
        {"facility_id": ID, "feature": FEATURE, "name": text(filled=True), "lat": number(-90, 90).or_null(),
         "lng": number(-180, 180).or_null(), "coord_source": text(among=("source", "geocode")).or_null()},
        ("feature", "facility_id"),
    ),
}


def _rules(path: str, value: Column, field: Field) -> Iterator[tuple[str, Column]]:
    """(rule, whether it is broken) of a value and what is inside it; never null."""

    def broken(condition: Column) -> Column:
        return F.coalesce(value.isNotNull() & condition, F.lit(False))

    if not field.optional:
        yield f"{path}: missing", value.isNull()
    if field.filled:
        yield f"{path}: blank", broken(F.trim(value) == "")
    if field.among is not None:
        yield f"{path}: unknown value", broken(~value.isin(*field.among))
    if field.matches is not None:
        yield f"{path}: no match", broken(~value.rlike(field.matches))
    if field.least is not None or field.most is not None:
        outside = F.lit(False) if field.kind == "whole" else F.isnan(value.cast("double"))
        if field.least is not None:
            outside = outside | (value < field.least)
        if field.most is not None:
            outside = outside | (value > field.most)
        yield f"{path}: out of range", broken(outside)
    if field.each is not None:
        # The same rules hold for every element; a rule is named once for a row.
        def of(k: int):
            return lambda element: list(_rules("", element, field.each))[k][1]

        for k, (name, _) in enumerate(_rules(f"{path}[]", F.get(value, 0), field.each)):
            yield name, broken(F.exists(value, of(k)))
    for name, part in field.parts:
        for rule, condition in _rules(f"{path}.{name}", value[name], part):
            yield rule, broken(condition)


def _kind_breaks(path: str, kind: T.DataType, field: Field) -> Iterator[tuple[str, str]]:
    """(rule, found type) where a column is of another kind than declared."""
    if not isinstance(kind, KINDS[field.kind]):
        yield f"{path}: wrong kind", kind.simpleString()
    elif field.each is not None:
        yield from _kind_breaks(f"{path}[]", kind.elementType, field.each)
    else:
        for name, part in field.parts:
            if name not in kind.names:
                yield f"{path}.{name}: no column", ""
            else:
                yield from _kind_breaks(f"{path}.{name}", kind[name].dataType, part)


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(rule, key) of everything in a table that breaks its contract."""
    static: list[tuple[str, str]] = []
    rules: list[tuple[str, Column]] = []
    for name, field in contract.fields.items():
        if name not in df.columns:
            static.append((f"{name}: no column", ""))
            continue
        wrong = list(_kind_breaks(name, df.schema[name].dataType, field))
        static += wrong
        if not wrong:
            rules += _rules(name, F.col(name), field)
    found = df.sparkSession.createDataFrame(static, "rule string, key string")
    if any(name not in df.columns for name in contract.key):
        return found
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in contract.key])
    broken = F.array_compact(F.array(*[F.when(condition, F.lit(rule)) for rule, condition in rules]))
    parts = [found, df.select(F.explode(broken).alias("rule"), key.alias("key"))]
    if contract.unique:
        counted = df.groupBy(*contract.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        parts.append(counted.select(F.lit("not unique").alias("rule"), key.alias("key")))
    return reduce(DataFrame.unionByName, parts)


def published(name: str, rows: DataFrame) -> DataFrame:
    """Violations of the contract of a published table."""
    return violations(rows, CONTRACTS[name])
