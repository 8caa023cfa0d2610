"""Text expressions: keys, addresses, labels.

All of them run in the JVM except Unicode NFKC, which Spark lacks; it is one Arrow call per batch.
Patterns use ``(?U)`` because blanks and digits are meant in the Unicode sense.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from placegauge import fixed_values as fv

BLANKS = "(?U)\\s+"


def _nfkc_udf():
    """Made by a function so that executors get it by value and need no copy of this package."""

    def normalise(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFKC")

    return F.pandas_udf(normalise, StringType())


_NFKC = _nfkc_udf()


def nfkc(text: Column) -> Column:
    """Compatibility normal form; null stays null."""
    return _NFKC(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def words_array(words) -> Column:
    """Literal array<string>, also when empty."""
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def hits(text: Column, words) -> Column:
    """The words that occur in the text, in word order."""
    words = words if isinstance(words, Column) else words_array(words)
    return F.filter(words, lambda w: F.contains(text, w))


def contains_any(text: Column, words) -> Column:
    """Whether one of the words occurs; false for no words, false for null text."""
    words = words if isinstance(words, Column) else words_array(words)
    return F.coalesce(F.exists(words, lambda w: F.contains(text, w)), F.lit(False))


def any_contains_any(texts: Column, words) -> Column:
    """Whether one of the words occurs in one of the texts."""
    words = words if isinstance(words, Column) else words_array(words)
    return F.coalesce(
        F.exists(texts, lambda t: F.exists(words, lambda w: F.contains(t, w))), F.lit(False)
    )


def name_key(name: Column) -> Column:
    """Equal for spellings of one name: no bracketed notes, no blanks, one width."""
    return without_blanks(F.regexp_replace(nfkc(name), "[（(].*?[）)]", ""))


def title_key(name: Column) -> Column:
    return F.regexp_replace(name, "(?U)[\\s　]+", "")


def header_key(header: Column) -> Column:
    return F.translate(F.lower(strip(header)), " 　", "")


def names_place_kind(name: Column, words) -> Column:
    """The name, without one closing bracket group, ends with word + branch suffix."""
    if not words:
        return F.lit(False)
    base = strip(F.regexp_replace(nfkc(name), "[（(].*?[）)]$", ""))
    kinds = "|".join(re.escape(w) for w in words)
    branches = "|".join(fv.BRANCH_SUFFIXES)
    return F.coalesce(base.rlike(f"(?:{kinds})(?:{branches})\\z"), F.lit(False))


def slug(english: Column) -> Column:
    """Id from a name; empty when nothing of it can be used."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(english), "[^a-z0-9]+", "-"), "^-+|-+$", ""
    )


def line_label(operator: Column, line: Column) -> Column:
    """Short operator name + line name without its leading number."""
    short = F.create_map(*[F.lit(v) for kv in fv.OPERATOR_SHORT.items() for v in kv])
    return F.concat(
        F.coalesce(F.element_at(short, operator), operator),
        F.regexp_replace(line, "(?U)^\\d+号線", ""),
    )


def number_text(text: Column) -> Column:
    """Whole number written with thousands commas; null unless it is digits only."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    return F.when(plain.rlike("^[0-9]+$"), plain.try_cast("bigint"))


def era_year(title: Column) -> Column:
    """Gregorian year of the first era year in a title."""
    pattern = f"({'|'.join(fv.ERA_START)})({fv.ERA_FIRST_YEAR}|[0-9]+)年"
    starts = F.create_map(*[F.lit(v) for kv in fv.ERA_START.items() for v in kv])
    era = F.regexp_extract(title, pattern, 1)
    number = F.regexp_extract(title, pattern, 2)
    year = F.when(number == fv.ERA_FIRST_YEAR, F.lit(1)).otherwise(number.try_cast("int"))
    return F.element_at(starts, F.nullif(era, F.lit(""))) + year


def fiscal_days(year: Column) -> Column:
    """Days from April of the year to the next March."""
    one, april = F.lit(1), F.lit(4)
    return F.datediff(F.make_date(year + 1, april, one), F.make_date(year, april, one))


# --- addresses ---------------------------------------------------------------------------------

_LONGEST_FIRST = sorted(fv.MUNICIPALITIES.values(), key=len, reverse=True)
MUNICIPALITY_PATTERN = "|".join(_LONGEST_FIRST)
PREFECTURE_PATTERN = "^" + fv.PREFECTURE


def normal_address(text: Column) -> Column:
    return without_blanks(nfkc(text))


def kanji_number(run: Column) -> Column:
    """1 to 99 in kanji as a number; null for other runs."""
    digits = F.lit(fv.KANJI_DIGITS)

    def digit(text: Column, empty: int, other: int | None) -> Column:
        at = F.when(F.length(text) == 1, F.position(text, digits))
        known = F.when(at > 0, at - 1)
        value = known if other is None else F.coalesce(known, F.lit(other))
        return F.when(text == "", F.lit(empty)).otherwise(value)

    tens = F.substring_index(run, fv.KANJI_TEN, 1)
    ones = F.substring(run, F.length(tens) + 2, F.length(run))
    return F.when(
        F.contains(run, F.lit(fv.KANJI_TEN)), digit(tens, 1, 1) * 10 + digit(ones, 0, 0)
    ).otherwise(digit(run, 0, None))


def _block_numbers_to_digits(text: Column) -> Column:
    numerals = f"([{fv.KANJI_DIGITS}{fv.KANJI_TEN}]+)$"
    parts = F.split(text, fv.BLOCK_WORD, -1)
    counted = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def convert(part: Column) -> Column:
        run = F.regexp_extract(part, numerals, 1)
        number = F.when(run != "", kanji_number(run)).cast("string")
        return F.concat(F.regexp_replace(part, numerals, ""), F.coalesce(number, run))

    converted = F.concat(F.transform(counted, convert), F.slice(parts, -1, 1))
    return F.array_join(converted, fv.BLOCK_WORD)


def canonical_of_normal(address: Column) -> Column:
    """One spelling of block and lot numbers, for an address without blanks."""
    a = _block_numbers_to_digits(address)
    a = F.regexp_replace(a, fv.HYPHEN_PATTERN, "-")
    a = F.regexp_replace(a, fv.BLOCK_WORDS_PATTERN, "-")
    a = F.regexp_replace(a, "-+", "-")
    return F.regexp_replace(a, "-+$", "")


def canonical_address(text: Column) -> Column:
    return canonical_of_normal(normal_address(text))


def drop_trailing_place(address: Column) -> Column:
    """Tokens joined up to the first digit-free one that follows a token with digits."""
    tokens = F.filter(F.split(address, "(?U)[\\s　]+"), lambda t: t != "")
    start = F.struct(
        F.lit("").alias("kept"), F.lit(False).alias("numbered"), F.lit(False).alias("done")
    )

    def step(state: Column, token: Column) -> Column:
        has_digit = token.rlike("(?U)\\d")
        done = state["done"] | (state["numbered"] & ~has_digit)
        return F.struct(
            F.when(done, state["kept"]).otherwise(F.concat(state["kept"], token)).alias("kept"),
            (state["numbered"] | has_digit).alias("numbered"),
            done.alias("done"),
        )

    return F.aggregate(tokens, start, step, lambda state: state["kept"])


def without_county(address: Column) -> Column:
    return F.regexp_replace(address, "(?U)" + fv.COUNTY_PATTERN, "")


def complete_address(address: Column, organization: Column) -> Column:
    """Cleaned listing address with prefecture and, where known, municipality in front."""
    a = without_blanks(drop_trailing_place(nfkc(address)))
    a = F.element_at(F.split(a, fv.AREA_SEPARATORS_PATTERN, 2), 1)
    a = F.regexp_replace(a, fv.AND_OTHERS_PATTERN, "")
    a = F.regexp_replace(a, fv.IN_FRONT_PATTERN, "")
    a = F.regexp_replace(a, PREFECTURE_PATTERN, "")
    a = F.regexp_replace(a, f"^({MUNICIPALITY_PATTERN})\\1", "$1")
    named = without_county(a).rlike(f"^(?:{MUNICIPALITY_PATTERN})")
    own = F.coalesce(organization.isin(*fv.MUNICIPALITIES.values()), F.lit(False))
    return F.concat(
        F.lit(fv.PREFECTURE), F.when(~named & own, organization).otherwise(F.lit("")), a
    )


def below_of_normal(address: Column) -> Column:
    rest = without_county(F.regexp_replace(address, PREFECTURE_PATTERN, ""))
    return F.regexp_replace(rest, f"^(?:{MUNICIPALITY_PATTERN})", "")


def below_municipality(matched: Column) -> Column:
    """What an address says below its municipality; empty when nothing."""
    return below_of_normal(normal_address(matched))


def precision_of(query: Column, matched: Column, below: Column) -> Column:
    """exact, partial or null from canonical texts and what the match says below the municipality.

    A prefix counts only where a component of the query ends.
    """
    following = F.substring(query, F.length(matched) + 1, F.lit(1))
    boundary = (following == "-") | (~matched.rlike("(?U)\\d$") & following.rlike("(?U)^\\d"))
    return F.when(below == "", F.lit(None).cast("string")).otherwise(
        F.when(query == matched, F.lit("exact")).when(
            F.startswith(query, matched) & boundary, F.lit("partial")
        )
    )


def match_precision(query: Column, matched: Column) -> Column:
    return precision_of(
        canonical_address(query), canonical_address(matched), below_municipality(matched)
    )


def outside_region(address: Column) -> Column:
    """The address starts with another prefecture."""
    starts = "^(?:" + "|".join(fv.OTHER_PREFECTURES) + ")"
    return F.coalesce(normal_address(address).rlike(starts), F.lit(False))
