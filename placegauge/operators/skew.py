"""Equi-joins in which a few keys hold much of the data.

Spark's adaptive skew handling works on finished shuffle partitions and not in every plan; these
joins do not depend on it.  The rows per key are counted first (summed per task before anything is
shuffled).  A key with more rows than a part should have is cut into as many parts as its rows
need, and the other side is copied to those parts, for such keys only; ``both`` counts and cuts the
other side too, so that a key that is large on both sides becomes a grid of parts.

A part has ``PART_ROWS`` rows, or one ``HOT_KEYS``-th of all rows if that is more; so at most
``HOT_KEYS`` keys are cut on each side, which bounds what is broadcast, and no task gets more than
that share.  The counting is a second pass: hand in a written or checkpointed table, not a long
computation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 10_000
PART_ROWS = 100_000


def hot_keys(
    rows: DataFrame, keys: list[str], part_rows: int | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """``keys`` and ``__parts`` of every key that needs several parts; non-null keys only."""
    if counts is None:
        counts = rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    whole = F.broadcast(counts.agg(F.sum("__n").alias("__all")))  # one row
    size = F.greatest(F.lit(part_rows or PART_ROWS), F.ceil(F.col("__all") / HOT_KEYS))
    parts = F.ceil(F.col("__n") / size).cast("int")
    return counts.crossJoin(whole).select(*keys, parts.alias("__parts")).where("__parts > 1")


def split_join(
    rows: DataFrame,
    other: DataFrame,
    keys: list[str],
    spread: Column,
    how: str = "inner",
    part_rows: int | None = None,
    counts: DataFrame | None = None,
    other_spread: Column | None = None,
    spread_out: bool = False,
) -> DataFrame:
    """``rows`` joined with ``other`` on ``keys``; inner or left.  See ``split_sides``."""
    if other_spread is not None and how != "inner":
        raise ValueError("only inner joins cut both sides")
    left, right, on = split_sides(rows, other, keys, spread, part_rows, counts, other_spread, spread_out)
    return left.join(right, on, how).drop("__a", "__d")


def split_sides(
    rows: DataFrame,
    other: DataFrame,
    keys: list[str],
    spread: Column,
    part_rows: int | None = None,
    counts: DataFrame | None = None,
    other_spread: Column | None = None,
    spread_out: bool = False,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the numbers of their parts, and the columns on which they meet: every row of
    ``rows`` meets every row of ``other`` with its key exactly once.

    ``spread`` is anything that differs between rows of one key.  Rows with a null key keep their place
    by their own hash instead of meeting in one task.  ``counts`` (keys
    and ``__n``) saves the counting where the rows per key are known.  ``other_spread`` has the
    other side counted and cut as well (inner joins).  ``spread_out`` is for small tables with many
    matches: the keys are dealt to at least four tasks a core, where their size alone would ask for few.
    """
    hot = hot_keys(rows, keys, part_rows, counts).withColumnRenamed("__parts", "__across")
    if other_spread is not None:
        down = hot_keys(other, keys, part_rows).withColumnRenamed("__parts", "__down")
        hot = hot.join(down, keys, "full")
    else:
        hot = hot.withColumn("__down", F.lit(1))
    hot = F.broadcast(hot)  # at most HOT_KEYS rows for each side
    across, down = F.coalesce("__across", F.lit(1)), F.coalesce("__down", F.lit(1))

    def number(of: Column, parts: Column) -> Column:
        return F.pmod(F.xxhash64(of), parts).cast("int")

    def every(parts: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), parts.cast("int") - 1))

    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    left = rows.join(hot, keys, "left").withColumn(
        "__a", F.when(no_key, number(spread, F.lit(1 << 16))).otherwise(number(spread, across))
    )
    right = other.join(hot, keys, "left").withColumn("__a", every(across))
    on = [*keys, "__a"]
    if other_spread is not None:
        left = left.withColumn("__d", every(down))
        right = right.withColumn("__d", number(other_spread, down))
        on.append("__d")
    left, right = left.drop("__across", "__down"), right.drop("__across", "__down")
    if spread_out:
        spark = rows.sparkSession
        tasks = max(
            4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
        )
        left, right = left.repartition(tasks, *on), right.repartition(tasks, *on)
    return left, right, on
