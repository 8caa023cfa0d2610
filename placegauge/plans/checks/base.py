"""Registry of checked queries, the given tables, and small SQL text helpers.

A check pairs a Spark query over the given tables with SQL that must return the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placegauge.functions import geo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")


def check(name: str, sql: str | None = None):
    """Registers ``fn(tables) -> DataFrame`` with its SQL counterpart."""

    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def pick(values: list, index: Column) -> Column:
    """Element of a literal list at a 0-based index."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def hashed_lat(k: Column) -> Column:
    return F.lit(35.6) + ((k * 7919) % 10007) / F.lit(10007.0) * F.lit(0.2)


def hashed_lng(k: Column) -> Column:
    return F.lit(139.6) + ((k * 104729) % 10009) / F.lit(10009.0) * F.lit(0.25)


# --- SQL text --------------------------------------------------------------------------------

def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def sql_pick(values, index: str) -> str:
    return f"({sql_list(values)})[1 + ({index})::INT]"


def sql_lat(k: str) -> str:
    return f"(35.6::DOUBLE + ((({k})*7919) % 10007)::DOUBLE / 10007::DOUBLE * 0.2::DOUBLE)"


def sql_lng(k: str) -> str:
    return f"(139.6::DOUBLE + ((({k})*104729) % 10009)::DOUBLE / 10009::DOUBLE * 0.25::DOUBLE)"


def sql_round(x: str, digits: int) -> str:
    """Correctly rounded on the stored value, ties to even; null stays null."""
    return f"CAST(printf('%.{digits}f', ({x})::DOUBLE) AS DOUBLE)"


def sql_sum(terms: list[str]) -> str:
    """Compensated sum in list order."""
    total, errors = "0::DOUBLE", []
    for term in terms:
        new = f"({total} + {term})"
        errors.append(
            f"CASE WHEN abs({total}) >= abs({term}) THEN ({total} - {new}) + {term} "
            f"ELSE ({term} - {new}) + {total} END"
        )
        total = new
    carry = "0::DOUBLE"
    for error in errors:
        carry = f"({carry} + ({error}))"
    return f"({total} + {carry})"


def sql_stages(source: str, *stages: dict[str, str]) -> str:
    """One nested SELECT per stage."""
    query = f"SELECT * FROM {source}"
    for stage in stages:
        added = ", ".join(f"{v} AS {k}" for k, v in stage.items())
        query = f"SELECT *, {added} FROM ({query})"
    return query


def sql_project(source: str, lat: str, lng: str, x: str, y: str) -> str:
    t = f"{x}_"
    north, east = f"{t}xi", f"{t}eta"
    for j, a in enumerate(geo.SERIES_ALPHAS, start=1):
        north += f" + {a!r}::DOUBLE * sin(2*{j}*{t}xi) * cosh(2*{j}*{t}eta)"
        east += f" + {a!r}::DOUBLE * cos(2*{j}*{t}xi) * sinh(2*{j}*{t}eta)"
    e, lng0 = geo.SERIES_E, 139.0 + 50.0 / 60.0
    return sql_stages(
        source,
        {f"{t}s": f"sin(radians({lat}))", f"{t}d": f"radians({lng} - {lng0!r}::DOUBLE)"},
        {f"{t}t": f"sinh(atanh({t}s) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * {t}s))"},
        {f"{t}xi": f"atan2({t}t, cos({t}d))",
         f"{t}eta": f"atanh(sin({t}d) / sqrt(1 + {t}t * {t}t))"},
        {x: f"({east}) * {geo.SERIES_SCALE!r}::DOUBLE",
         y: f"(({north}) - {geo.SERIES_XI0!r}::DOUBLE) * {geo.SERIES_SCALE!r}::DOUBLE"},
    )


def sql_geodesic(source: str) -> str:
    """Adds lat2, lng2 from lat, lng, az, d."""
    f, a, b = geo.GRS80_FLATTENING, 6378137.0, geo.GRS80_B
    e2 = (a * a - b * b) / (b * b)

    def swing(s: str) -> str:
        c2m = f"cos(2*s1 + {s})"
        return (
            f"start + bb * sin({s}) * ({c2m} + bb / 4 * cos({s}) * (2 * {c2m} * {c2m} - 1))"
        )

    return sql_stages(
        source,
        {"sin1": "sin(radians(az))", "cos1": "cos(radians(az))",
         "tanu": f"{1 - f!r}::DOUBLE * tan(radians(lat))"},
        {"cu": "1 / sqrt(1 + tanu * tanu)"},
        {"su": "tanu * cu", "s1": "atan2(tanu, cos1)", "sa": "cu * sin1"},
        {"ca2": "1 - sa * sa"},
        {"u2": f"ca2 * {e2!r}::DOUBLE"},
        {"aa": "1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - u2 * 175)))",
         "bb": "u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - u2 * 47)))"},
        {"start": f"d / (aa * {b!r}::DOUBLE)"},
        {"sig1": swing("start")},
        {"sig": swing("sig1")},
        {"ss": "sin(sig)", "cs": "cos(sig)", "c2m": "cos(2*s1 + sig)",
         "cc": f"{f / 16!r}::DOUBLE * ca2 * (4 + {f!r}::DOUBLE * (4 - 3 * ca2))"},
        {"crs": "su * ss - cu * cs * cos1",
         "lam": "atan2(ss * sin1, cu * cs - su * ss * cos1)",
         "turn": "sig + cc * ss * (c2m + cc * cs * (2 * c2m * c2m - 1))"},
        {"lat2": "degrees(atan2(su * cs + cu * ss * cos1, "
                 f"{1 - f!r}::DOUBLE * sqrt(sa * sa + crs * crs)))",
         "lng2": f"lng + degrees(lam - (1 - cc) * {f!r}::DOUBLE * sa * turn)"},
    )


class Ctes:
    """Named SQL parts; ``select`` puts the needed ones in front of a query, in defined order."""

    def __init__(self) -> None:
        self.parts: dict[str, tuple[str, tuple[str, ...]]] = {}

    def add(self, name: str, body: str, needs: tuple[str, ...] = ()) -> None:
        self.parts[name] = (body, needs)

    def select(self, query: str, *names: str) -> str:
        wanted: set[str] = set()

        def want(name: str) -> None:
            if name not in wanted:
                wanted.add(name)
                for need in self.parts[name][1]:
                    want(need)

        for name in names:
            want(name)
        listed = ", ".join(f"{n} AS ({b})" for n, (b, _) in self.parts.items() if n in wanted)
        return f"WITH {listed} {query}"


CTES = Ctes()
