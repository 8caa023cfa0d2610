"""One place listed several times -> one facility, by priority.

Going through the facilities in priority order, one is absorbed by the first kept facility of the
same name within ``max_distance_m``, else by the first kept one within ``same_place_m``.  That order
is kept exactly, without listing pairs:

* Same name at the same spot: only the first can be kept, so such rows are one *point* here.
* Grid cells are so small that two points of one cell always conflict, whatever their names where
  the place rule holds.  Per cell only the first undecided point (a min) is a candidate, and at most
  one point of a cell is ever kept.
* A round goes through the candidates of each tile (many cells, so a bounded number of candidates)
  in priority order and keeps those whose earlier neighbours are all decided; candidates of the tiles
  around are seen as undecided.  What the kept ones absorb is removed for good, however crowded.
  A chain of dependencies is followed through a whole tile in one round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.functions.geo import SphereGrid, haversine_m
from placegauge.functions.text import name_key
from placegauge.operators.skew import split_join
from placegauge.session import cut, require_checkpoint_folder

TILE_M = 4000.0


def coordinate_priority(source: Column, precision: Column) -> Column:
    """Source coordinates first, then exact, then partial lookups, then anything else."""
    ranks = F.create_map(*[F.lit(v) for kv in fv.COORD_PRIORITY.items() for v in kv])
    key = F.when(source == "source", F.lit("source")).otherwise(
        F.concat_ws("/", source, F.coalesce(precision, F.lit("")))
    )
    return F.coalesce(F.element_at(ranks, key), F.lit(fv.COORD_PRIORITY_OTHER))


class _Rule:
    """One absorption rule: which points can conflict, and on which grid they are looked up."""

    def __init__(self, name: str, metres: float, keys: list[str], features=None) -> None:
        self.name = name
        self.metres = metres
        self.grid = SphereGrid(metres)
        self.keys = keys
        self.cell = [f"{name}_x", f"{name}_y"]
        self.features = features

    def add_cell(self, points: DataFrame) -> DataFrame:
        """Cell columns, and whether the rule applies to the feature at all."""
        cell = self.grid.cell(F.col("lat"), F.col("lng"))
        applies = F.lit(True)
        if self.features is not None:
            applies = F.col("feature").isin(*self.features)
        return points.withColumns({**dict(zip(self.cell, cell)), f"{self.name}_on": applies})

    @property
    def applies(self) -> Column:
        return F.col(f"{self.name}_on")

    @property
    def group(self) -> list[str]:
        """Join key: where the rule does not apply, nothing matches, but rows stay spread."""
        return [*self.keys, *self.cell, f"{self.name}_on"]

    def around(self, df: DataFrame) -> DataFrame:
        """Copies each row to the cells in reach of its own."""
        near = F.explode(self.grid.neighbours(*[F.col(c) for c in self.cell]))
        return (
            df.where(self.applies)
            .withColumn("__n", near)
            .drop(*self.cell)
            .withColumns({self.cell[0]: F.col("__n.cx"), self.cell[1]: F.col("__n.cy")})
            .drop("__n")
        )


@dataclass(frozen=True)
class _Tiles:
    """Candidates of every cell, and the local scan that keeps some of them."""

    rules: list[_Rule]

    def cell(self) -> tuple[Column, list[Column]]:
        """Name that a cell is bound to (none where the place rule holds) and the cell itself."""
        near, *places = self.rules
        key, cell = F.col("key"), [F.col(c) for c in near.cell]
        for rule in places:
            key = F.when(rule.applies, F.lit("")).otherwise(key)
            cell = [F.when(rule.applies, F.col(c)).otherwise(was) for c, was in zip(rule.cell, cell)]
        return key, cell

    def candidates(self, open_points: DataFrame) -> DataFrame:
        """First undecided point of each cell and how many the cell has, summed up per task."""
        key, (x, y) = self.cell()
        cells = open_points.select(
            "feature", key.alias("cell_key"), x.alias("cell_x"), y.alias("cell_y"),
            F.struct("prio", "key", "lat", "lng").alias("p"),
        )
        first = cells.groupBy("feature", "cell_key", "cell_x", "cell_y").agg(
            F.min("p").alias("p"), F.count(F.lit(1)).alias("many")
        )
        return first.select("feature", "cell_key", "many", "p.*")

    def dealt(self, candidates: DataFrame) -> DataFrame:
        """Each candidate in its own tile and, not as its home, in the tiles within reach."""
        grid = SphereGrid(TILE_M)
        reach = (self.rules[0].metres + max(r.metres for r in self.rules)) * 1.001
        narrow = math.cos(math.radians(max(map(abs, fv.LAT_RANGE))))
        north = reach / (math.radians(1.0) * fv.EARTH_RADIUS_M)
        lat, lng = F.col("lat"), F.col("lng")
        tiles = [
            F.struct(*[c.alias(n) for c, n in zip(grid.cell(lat + i * north, lng + j * north / narrow), "xy")])
            for i in (0, -1, 1) for j in (0, -1, 1)
        ]
        rows = candidates.withColumn("home", tiles[0]).withColumn(
            "tile", F.explode(F.array_distinct(F.array(*tiles)))
        )
        return rows.select(
            "feature", "cell_key", "tile.x", "tile.y", "prio.rank", "prio.id", "key", "lat", "lng", "many",
            (F.col("tile") == F.col("home")).alias("at_home"),
        )

    def kept(self, open_points: DataFrame) -> DataFrame:
        """Candidates that no undecided point can absorb any more."""
        near = self.rules[0].metres
        places = {f: r.metres for r in self.rules[1:] for f in r.features}
        group = ["feature", "cell_key", "x", "y"]
        rows = self.dealt(self.candidates(open_points))
        rows = rows.repartition(*group).sortWithinPartitions(*group, "rank", "id")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                part = pa.Table.from_batches([batch])
                held = pa.concat_tables([held, part]) if held is not None else part
                names = list(zip(*(held[c].to_pylist() for c in group), strict=True))
                starts = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
                for low, high in zip(starts, starts[1:], strict=False):
                    yield chosen(held.slice(low, high - low))
                held = held.slice(starts[-1])
            if held is not None:
                yield chosen(held)

        def chosen(tile: pa.Table) -> pa.RecordBatch:
            metres = places.get(tile["feature"][0].as_py())
            rows = tile.filter(pa.array(_kept_in_tile(tile, near, metres)))
            names = ["feature", "rank", "id", "key", "lat", "lng"]
            return pa.RecordBatch.from_arrays([rows[c].combine_chunks() for c in names], names)

        flat = rows.mapInArrow(
            scan, "feature string, rank int, id string, key string, lat double, lng double"
        )
        points = flat.select("feature", "key", "lat", "lng", F.struct("rank", "id").alias("prio"))
        for rule in self.rules:
            points = rule.add_cell(points)
        return points.select(*open_points.columns)


def _kept_in_tile(tile: pa.Table, near: float, place: float | None) -> np.ndarray:
    """Which candidates are kept for certain; rows come in priority order.

    An earlier candidate that is kept closes its cell.  One that is not leaves the other points of
    its cell undecided, if there are any.
    """
    lat, lng = np.radians(tile["lat"].to_numpy()), np.radians(tile["lng"].to_numpy())
    key = np.array(tile["key"].to_pylist(), dtype=object)
    crowded = tile["many"].to_numpy() > 1
    at_home = tile["at_home"].to_numpy(zero_copy_only=False)
    reach = near + (place or near)
    kept = np.zeros(len(lat), dtype=bool)
    gone = np.zeros(len(lat), dtype=bool)
    for i in np.flatnonzero(at_home):
        h = np.sin((lat[:i] - lat[i]) / 2) ** 2
        h = h + np.cos(lat[:i]) * np.cos(lat[i]) * np.sin((lng[:i] - lng[i]) / 2) ** 2
        metres = 2 * fv.EARTH_RADIUS_M * np.arcsin(np.sqrt(h))
        conflict = (metres <= near) & (key[:i] == key[i])
        if place is not None:
            conflict |= metres <= place
        if (conflict & kept[:i]).any():
            gone[i] = True
            continue
        undecided = conflict & ~gone[:i]
        others = (metres <= reach) & crowded[:i] & ~kept[:i]
        kept[i] = not (undecided | others).any()
    return kept


def _neighbours(kept: DataFrame, rule: _Rule) -> DataFrame:
    """Per cell the kept points in reach; a cell holds one, so the list has a fixed bound."""
    entry = F.struct("prio", "lat", "lng")
    listed = rule.around(kept.select(*rule.group, entry.alias("entry")))
    return listed.groupBy(*rule.group).agg(F.collect_list("entry").alias("kept"))


def _first_within(rule: _Rule, name: str) -> Column:
    """First kept point of the looked-up list that is near enough; null when none."""
    near = F.filter(
        name,
        lambda k: haversine_m(k["lat"], k["lng"], F.col("lat"), F.col("lng")) <= rule.metres,
    )
    return F.array_min(F.transform(near, lambda k: k["prio"]))


def _decide(points: DataFrame, rules: list[_Rule]) -> DataFrame:
    """Kept points.  Each round keeps at least the first undecided point of all."""
    tiles = _Tiles(rules)
    open_points, kept = cut(points), []
    while not open_points.isEmpty():
        keep = cut(tiles.kept(open_points))
        kept.append(keep)
        left = open_points
        for rule in rules:
            near = _neighbours(keep, rule)
            # One row per cell on the right; Spark splits what is crowded on the left.
            left = left.join(near, rule.group, "left")
            left = left.where(_first_within(rule, "kept").isNull()).drop("kept")
        open_points = cut(left.select(*points.columns))
    return reduce(DataFrame.unionByName, kept) if kept else open_points


def absorb(
    facilities: DataFrame,
    max_distance_m: float = fv.DEDUPE_DISTANCE_M,
    same_place_m: dict[str, float] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Located facilities with ``absorbed_by`` (null: kept).

    Needs facility_id, feature, name, lat, lng, coord_source, precision.  ``same_place_m`` gives,
    for some features, the distance within which the name does not matter.
    """
    require_checkpoint_folder(facilities.sparkSession)
    rules = [_Rule("near", max_distance_m, ["feature", "key"])]
    places = same_place_m or {}
    for i, metres in enumerate(sorted(set(places.values()))):
        features = [f for f, m in places.items() if m == metres]
        rules.append(_Rule(f"place{i}", metres, ["feature"], features))
    located = facilities.where("coord_source IS NOT NULL").select(
        "feature",
        name_key(F.col("name")).alias("key"),
        "lat",
        "lng",
        F.struct(
            coordinate_priority(F.col("coord_source"), F.col("precision")).alias("rank"),
            F.col("facility_id").alias("id"),
        ).alias("prio"),
    )
    points = located.groupBy("feature", "key", "lat", "lng").agg(F.min("prio").alias("prio"))
    for rule in rules:
        points = rule.add_cell(points)
    kept = _decide(points, rules).select(*points.columns)

    # The absorber of a row is decided per point: every kept point in reach is known by now.
    looked = points
    for rule in rules:
        near = _neighbours(kept, rule).withColumnRenamed("kept", f"{rule.name}_kept")
        looked = split_join(looked, near, rule.group, F.col("prio"), "left", hot_rows).withColumn(
            f"{rule.name}_first", _first_within(rule, f"{rule.name}_kept")
        )
    firsts = looked.select("feature", "key", "lat", "lng", *[f"{r.name}_first" for r in rules])
    rows = split_join(
        located, firsts, ["feature", "key", "lat", "lng"], F.col("prio"), "inner", hot_rows
    )
    # Only a kept facility that came earlier can absorb; by name first, then by place.
    earlier = [
        F.when(F.col(f"{r.name}_first") < F.col("prio"), F.col(f"{r.name}_first")["id"])
        for r in rules
    ]
    return rows.select(
        "feature", F.col("prio")["id"].alias("facility_id"), F.coalesce(*earlier).alias("absorbed_by")
    )


def merge_places(
    facilities: DataFrame,
    definitions=fv.FEATURE_DEFINITIONS,
    max_distance_m: float = fv.DEDUPE_DISTANCE_M,
) -> tuple[DataFrame, DataFrame]:
    """(kept facilities, absorbed (feature, facility_id, absorbed_by)) with each feature's own rule.

    Unlocated facilities cannot be compared and all stay.
    """
    places = {f: d["same_place_m"] for f, d in definitions.items() if d.get("same_place_m")}
    absorbed = cut(
        absorb(facilities, max_distance_m, places).where("absorbed_by IS NOT NULL")
    )
    kept = facilities.join(
        absorbed.select("feature", "facility_id"), ["feature", "facility_id"], "left_anti"
    )
    return kept, absorbed
