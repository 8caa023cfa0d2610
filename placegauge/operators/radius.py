"""Sites and the facilities around them: an equi-join on grid cells, then the exact distance.

A grid line lies every half ``radius``, so everything within the radius of a site is in its own
cell or one of the 24 around it.  Sites are copied to those cells; facilities stay single.  The
distance is a condition of the join, so that what is too far away never becomes a row.

Counts list no pairs: where a run of sorted points is within the radius for certain, running sums
count it, and only points near the rim are measured.

A list in order is not sorted after it was made, since the pairs are far more than sites and facilities: ranges of
sites are dealt to tasks with all places of facilities, and every site's own list is made in order.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegauge.functions.geo import cell_index, neighbour_cells, planar_m, project
from placegauge.functions.rounding import round_half_even
from placegauge.functions.staging import with_computed
from placegauge.operators.skew import split_join, split_sides
from placegauge.session import cut

# Cells a radius reaches.
REACH = 2
# Cells are a little wider than that, against rounding at their borders.
MARGIN = 1 + 1e-9
# What is nearer to the rim than this share of the radius and as many metres is measured.
SLACK = 1e-6
# Distances that a task holds at once.
MEASURED = 1 << 20
# Strips that the radius is cut into where lists are made, and distances and pairs of a list handed over at once.
STRIPS = 16
LISTED = 1 << 17
RUN = 1 << 14


def _near(
    sites: DataFrame, points: DataFrame, radius_m: float, spread: list[str], hot: int | None
) -> DataFrame:
    """Each site with each point at most ``radius_m`` away (rim included), both in the plane.

    Cells that hold very many points or sites are split on the side that has them.  The tables are
    small against their pairs, so tasks are not counted by the size of the tables.
    """
    size = radius_m / REACH * MARGIN
    site_cells = (
        project(sites.select("site_id", "lat", "lng"), "lat", "lng", "sx", "sy")
        .withColumn(
            "cell",
            F.explode(
                neighbour_cells(
                    cell_index(F.col("sx"), size), cell_index(F.col("sy"), size), REACH, REACH
                )
            ),
        )
        .select("site_id", "sx", "sy", "cell.cx", "cell.cy")
    )
    point_cells = (
        project(points.where("lat IS NOT NULL AND lng IS NOT NULL"), "lat", "lng", "fx", "fy")
        .withColumn("cx", cell_index(F.col("fx"), size))
        .withColumn("cy", cell_index(F.col("fy"), size))
    )
    return (
        split_join(
            point_cells, site_cells, ["cx", "cy"], F.struct("fx", "fy", *spread), part_rows=hot,
            other_spread=F.col("site_id"), spread_out=True,
        )
        .where(_metres() <= radius_m)
        .drop("cx", "cy")
    )


def _metres() -> Column:
    return planar_m(*[F.col(c) for c in ("sx", "sy", "fx", "fy")])


def _near_groups(
    sites: DataFrame, points: DataFrame, radius_m: float, groups: list[str], hot: int | None
) -> DataFrame:
    """(site_id, groups): the distinct values that some point within the radius has, without listing
    all points.

    On cells of a third of the radius, all points of a site's own cell and of the eight around it are
    within the radius, so what they hold is found by cells.  Only what the other cells in reach hold
    and those nine do not is decided by the distance of its points.
    """
    size = radius_m / 3 * MARGIN

    def celled(rows: DataFrame, x: str, y: str) -> DataFrame:
        placed = rows.where(~F.isnan(x) & ~F.isnan(y))
        return placed.withColumn("cx", cell_index(F.col(x), size)).withColumn("cy", cell_index(F.col(y), size))

    def shifted(rows: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
        """Copied to the cells that many steps away; ``px, py`` is the cell of the points."""
        moved = F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i, j in steps])
        return rows.select("g", F.col("cx").alias("px"), F.col("cy").alias("py"), F.explode(moved).alias("to")).select(
            "g", "px", "py", "to.cx", "to.cy"
        )

    steps = [(i, j) for i in range(-3, 4) for j in range(-3, 4)]
    inner = [(i, j) for i, j in steps if max(abs(i), abs(j)) <= 1]
    # A struct, so that groups with a null are equal too.
    located = points.where("lat IS NOT NULL AND lng IS NOT NULL").select("lat", "lng", F.struct(*groups).alias("g"))
    spots = cut(celled(project(located.distinct(), "lat", "lng", "fx", "fy"), "fx", "fy").drop("lat", "lng"))
    own = cut(
        celled(project(sites.select("site_id", "lat", "lng"), "lat", "lng", "sx", "sy"), "sx", "sy").drop("lat", "lng")
    )
    met = own.select("cx", "cy").distinct()
    held = spots.select("cx", "cy", "g").distinct()
    sure = cut(shifted(held, inner).select("cx", "cy", "g").distinct().join(met, ["cx", "cy"], "left_semi"))
    cell = ["cx", "cy"]
    found = split_join(own, sure, cell, F.col("site_id"), part_rows=hot).select("site_id", "g")
    open_cells = cut(
        shifted(held, [s for s in steps if s not in inner])
        .join(met, cell, "left_semi")
        .join(sure, [*cell, "g"], "left_anti")
    )
    far = split_join(
        spots.withColumnsRenamed({"cx": "px", "cy": "py"}), open_cells, ["px", "py", "g"], F.struct("fx", "fy"),
        part_rows=hot, other_spread=F.struct(*cell),
    ).select(*cell, "g", "fx", "fy")
    measured = split_join(
        far, own, cell, F.struct("fx", "fy", "g"), part_rows=hot, other_spread=F.col("site_id"), spread_out=True
    ).where(_metres() <= radius_m)
    return found.unionByName(measured.select("site_id", "g")).distinct().select("site_id", "g.*")


def radius_pairs(
    sites: DataFrame,
    facilities: DataFrame,
    radius_m: float,
    hot_rows: int | None = None,
    groups: list[str] | None = None,
    runs: bool = False,
) -> DataFrame:
    """One row per (site, facility) within the radius, with ``distance_m`` to one decimal.

    The nearest-first list of a site is this table in the order (distance_m, facility_id); it
    stays in rows because one site may have any number of neighbours.

    The list grows with sites times facilities.  Who only needs to know which values of some columns
    it holds names them as ``groups``: distinct (site_id, groups) of the same pairs, not listed.

    With ``runs`` the list comes in order and in pieces, for ``nearest_first``: (site_id, feature, run), where a run has
    (facility_id, distance_m) of up to ``RUN`` pairs.  Ids and features are texts.
    """
    if runs:
        return _near_runs(sites, facilities, radius_m)
    if groups:
        return _near_groups(sites, facilities, radius_m, groups, hot_rows)
    near = with_computed(
        _near(sites, facilities, radius_m, ["facility_id"], hot_rows), {"metres": _metres()}
    )
    return near.withColumn("distance_m", round_half_even(F.col("metres"), 1)).drop(
        "metres", "sx", "sy", "fx", "fy"
    )


def disc_sums(
    px: np.ndarray, py: np.ndarray, kind: np.ndarray, n: np.ndarray, kinds: int,
    sx: np.ndarray, sy: np.ndarray, radius_m: float,
) -> np.ndarray:
    """Sums of ``n`` over the points at most ``radius_m`` from each site: sites x kinds.

    Points are cut by northing into strips of about equal numbers and sorted by easting inside them.
    What a site surely reaches of a strip is one run, which running sums count; the points beside it
    that may be in reach are measured.  With the square root of the points as strips, a site costs
    about that many steps instead of one for each point.
    """
    sums = np.zeros((len(sx), kinds), dtype=np.int64)
    outer = radius_m * (1 + SLACK) + SLACK
    inner = max(0.0, radius_m * (1 - SLACK) - SLACK)
    for strip in np.array_split(np.argsort(py), max(1, int(len(py) ** 0.5 / 2))):
        if not len(strip):
            continue
        strip = strip[np.argsort(px[strip])]
        x, y, own, many = px[strip], py[strip], kind[strip], n[strip]
        south, north = y.min(), y.max()
        least = np.maximum(0.0, np.maximum(south - sy, sy - north))
        at = np.flatnonzero(least <= outer)
        half = np.sqrt(outer * outer - least[at] ** 2)
        low = np.searchsorted(x, sx[at] - half, "left")
        high = np.searchsorted(x, sx[at] + half, "right")
        some = high > low
        at, low, high = at[some], low[some], high[some]
        most = np.maximum(np.abs(sy[at] - south), np.abs(sy[at] - north))
        half = np.sqrt(np.maximum(0.0, inner * inner - most**2))
        first = np.where(most < inner, np.searchsorted(x, sx[at] - half, "left"), low)
        last = np.where(most < inner, np.searchsorted(x, sx[at] + half, "right"), low)
        running = np.zeros((len(strip) + 1, kinds), dtype=np.int64)
        running[np.arange(1, len(strip) + 1), own] = many
        running = running.cumsum(axis=0)
        sums[at] += running[last] - running[first]
        begin, length = np.concatenate([low, last]), np.concatenate([first - low, high - last])
        site = np.concatenate([at, at])
        for share in _shares(length.cumsum()):
            steps = length[share]
            points = np.repeat(begin[share] - (steps.cumsum() - steps), steps) + np.arange(steps.sum())
            of = np.repeat(site[share], steps)
            dx, dy = sx[of] - x[points], sy[of] - y[points]
            within = np.sqrt(dx * dx + dy * dy) <= radius_m
            np.add.at(sums, (of[within], own[points[within]]), many[points[within]])
    return sums


def _shares(ends: np.ndarray) -> list[slice]:
    """Cuts runs that end at the given sums into shares of about ``MEASURED`` points."""
    if not len(ends) or not ends[-1]:
        return []
    cuts = np.searchsorted(ends, np.arange(MEASURED, int(ends[-1]), MEASURED), "right").tolist()
    bounds = [0, *cuts, len(ends)]
    return [slice(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if b > a]


def radius_counts(
    sites: DataFrame,
    facilities: DataFrame,
    radius_m: float,
    features: list[str],
    hot_rows: int | None = None,
) -> DataFrame:
    """(site_id, feature, n) for every site and feature, 0 where nothing is near.

    Facilities at one spot are counted before the join, so a crowded spot is joined once.  Sites are
    copied to the nine tiles as wide as the radius that they reach into; a tile is counted by
    ``disc_sums``, in parts where it holds very many sites or spots.
    """
    spots = (
        facilities.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col("feature").isin(*features))
        .groupBy("feature", "lat", "lng")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    zeros = sites.select(
        "site_id", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature")
    ).withColumn("n", F.lit(0).cast("long"))
    size, tile = radius_m * MARGIN, ["cx", "cy"]

    def placed(rows: DataFrame, x: str, y: str) -> DataFrame:
        return project(rows, "lat", "lng", x, y).where(~F.isnan(x) & ~F.isnan(y))

    kind = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")) - 1
    points = placed(spots, "fx", "fy").select(
        cell_index(F.col("fx"), size).alias("cx"), cell_index(F.col("fy"), size).alias("cy"),
        "fx", "fy", kind.cast("int").alias("kind"), "n",
    )
    around = neighbour_cells(cell_index(F.col("sx"), size), cell_index(F.col("sy"), size))
    reached = placed(sites.select("site_id", "lat", "lng"), "sx", "sy").select(
        "site_id", "sx", "sy", F.explode(around).alias("cell")
    ).select("site_id", "sx", "sy", "cell.cx", "cell.cy")
    left, right, on = split_sides(
        points, reached, tile, F.struct("fx", "fy", "kind"), hot_rows, other_spread=F.col("site_id"),
        spread_out=True,
    )
    site_type = sites.schema["site_id"].dataType.simpleString()

    def counted(near: pa.Table, some: pa.Table) -> pa.Table:
        columns = [near[c].to_numpy() for c in ("fx", "fy", "kind", "n")]
        sums = disc_sums(*columns, len(features), some["sx"].to_numpy(), some["sy"].to_numpy(), radius_m)
        row, place = np.nonzero(sums)
        return pa.table({
            "site_id": some["site_id"].take(pa.array(row)),
            "feature": pa.array([features[k] for k in place], pa.string()),
            "n": pa.array(sums[row, place], pa.int64()),
        })

    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(
        counted, f"site_id {site_type}, feature string, n bigint"
    )
    return zeros.unionByName(found).groupBy("site_id", "feature").agg(F.sum("n").alias("n"))


def counted_pairs(sites: DataFrame, pairs: DataFrame, features: list[str]) -> DataFrame:
    """(site_id, feature, n) of listed pairs, 0 where a site has none: no second spatial join."""
    zeros = sites.select(
        "site_id", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"), F.lit(0).alias("n")
    )
    ones = pairs.where(F.col("feature").isin(*features)).select("site_id", "feature", F.lit(1).alias("n"))
    return zeros.unionByName(ones).groupBy("site_id", "feature").agg(F.sum("n").alias("n"))


def nearest_first(pairs: DataFrame) -> DataFrame:
    """Pairs in list order: the runs of ``radius_pairs`` opened, or a range sort of listed pairs, where one
    crowded site is spread over several tasks."""
    if "run" in pairs.columns:
        return pairs.select("site_id", "feature", F.explode("run").alias("pair")).select("site_id", "feature", "pair.*")
    return pairs.orderBy("site_id", "feature", "distance_m", "facility_id")


IDS, SPOTS, SITES = range(3)


def _near_runs(sites: DataFrame, facilities: DataFrame, radius_m: float) -> DataFrame:
    """(site_id, feature, run) in list order.

    Sites are cut into as many ranges of their ids as there are tasks (two a core), and a task gets the facilities as
    blocks of columns, which it keeps on its own disk: what is dealt grows with facilities and cores, not with pairs.
    """
    spark = sites.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism

    def placed(rows: DataFrame, x: str, y: str) -> DataFrame:
        there = project(rows.where("lat IS NOT NULL AND lng IS NOT NULL"), "lat", "lng", x, y)
        return there.where((F.abs(x) < float("inf")) & (F.abs(y) < float("inf")))

    block = "task int, kind int, block bigint, data binary"
    # The number of a facility goes up with its id.
    numbered = cut(
        placed(facilities.select("facility_id", "feature", "lat", "lng"), "fx", "fy")
        .orderBy("facility_id")
        .select("facility_id", "feature", "fx", "fy", F.monotonically_increasing_id().alias("number"))
    )
    strip = cell_index(F.col("fy"), radius_m / STRIPS)
    kept = cut(
        numbered.select("facility_id", "number").mapInArrow(_blocks(IDS), block).unionByName(
            numbered.select(strip.alias("strip"), "fx", "fy", "feature", "number")
            .orderBy("strip", "fx")
            .mapInArrow(_blocks(SPOTS), block)
        )
    )
    # By itself, since a range's number is that of its task.
    ranges = cut(
        placed(sites.select("site_id", "lat", "lng"), "sx", "sy")
        .select("site_id", "sx", "sy")
        .repartitionByRange(tasks, "site_id")
        .sortWithinPartitions("site_id")
        .mapInArrow(_blocks(SITES), block)
    )
    copies = kept.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    return copies.unionByName(ranges).repartitionById(tasks, "task").mapInArrow(
        _list_maker(radius_m), "site_id string, feature string, run array<struct<facility_id string, distance_m double>>"
    )


def _blocks(kind: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a partition as blocks that are numbered in its order; ``task`` is its own number."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.record_batch({
                "task": pa.array([part], pa.int32()), "kind": pa.array([kind], pa.int32()),
                "block": pa.array([(part << 32) + k], pa.int64()),
                "data": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            })

    return packed


def _list_maker(radius_m: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        with tempfile.TemporaryFile(dir=folder) as spool:
            places = []
            for batch in batches:
                for kind, block, data in zip(batch["kind"].to_pylist(), batch["block"].to_pylist(), batch["data"], strict=True):
                    data = data.as_buffer()
                    places.append((kind, block, spool.tell(), data.size))
                    spool.write(data)

            def tables(wanted: int) -> Iterator[pa.Table]:
                for kind, _, at, size in sorted(places):
                    if kind == wanted:
                        spool.seek(at)
                        yield pa.ipc.open_stream(spool.read(size)).read_all()

            own = [*tables(SITES)]
            if own:
                site = pa.concat_tables(own).combine_chunks()
                near = Facilities(tables(IDS), lambda: tables(SPOTS), folder, radius_m)
                yield from near.lists(site["site_id"].combine_chunks(), site["sx"].to_numpy(), site["sy"].to_numpy())

    return lists


class Facilities:
    """Places of facilities sorted by strip and easting, and their ids: columns in files, so that a task's memory
    does not grow with them."""

    def __init__(
        self, ids: Iterator[pa.Table], spots: Callable[[], Iterator[pa.Table]], folder: str | None, radius_m: float
    ) -> None:
        self.folder, self.radius_m, self.height = folder, radius_m, radius_m / STRIPS
        ends, texts, valid = self._file(), self._file(), self._file()
        ends.write(np.zeros(1, dtype=np.int64))
        first, base, total, length = [], [], 0, 0
        for table in ids:
            first.append(table["number"][0].as_py())
            base.append(total)
            total += len(table)
            for text in table["facility_id"].chunks:
                lengths = pc.fill_null(pc.binary_length(text), 0).to_numpy().astype(np.int64)
                ends.write(length + lengths.cumsum())
                length += int(lengths.sum())
                whole = pc.fill_null(text, "")
                texts.write(b"".join(whole.cast(pa.binary()).to_pylist()))
                valid.write(text.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
        kinds: set[str | None] = set()
        n = 0
        for table in spots():
            kinds.update(table["feature"].unique().to_pylist())
            n += len(table)
        ordered = sorted(kinds, key=lambda f: (f is not None, (f or "").encode()))
        self.features = pa.array(ordered, pa.string())
        at = {f: k for k, f in enumerate(ordered)}
        # A pair is one number: site, feature, tenths of a metre, facility.
        self.of_facility = max(1, total.bit_length())
        self.of_metres = self.of_facility + (int(radius_m * 10) + 2).bit_length()
        self.of_feature = self.of_metres + len(ordered).bit_length()
        if self.of_feature > 62:
            raise ValueError("radius, features and facilities do not fit a number of 63 bits")
        first, base = np.array(first, dtype=np.int64), np.array(base, dtype=np.int64)
        easting, northing, number = self._file(), self._file(), self._file()
        strips, starts, seen = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
        for table in spots():
            easting.write(table["fx"].to_numpy())
            northing.write(table["fy"].to_numpy())
            told = table["feature"].combine_chunks().dictionary_encode(null_encoding="encode")
            kind = np.array([at[f] for f in told.dictionary.to_pylist()], dtype=np.int64)[told.indices.to_numpy()]
            high = table["number"].to_numpy()
            block = np.searchsorted(first, high, "right") - 1
            number.write(kind << self.of_metres | base[block] + high - first[block])
            strip = table["strip"].to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], strip[1:] != strip[:-1]]))
            strips.append(strip[begin])
            starts.append(begin + seen)
            seen += len(strip)
        strip, start = np.concatenate(strips), np.concatenate(starts)
        new = np.concatenate([[True], strip[1:] != strip[:-1]])[: len(strip)]
        self.strip, self.start = strip[new], np.append(start[new], n)
        self.x, self.y = self._mapped(easting, np.float64, n), self._mapped(northing, np.float64, n)
        self.number = self._mapped(number, np.int64, n)
        ends, texts = self._mapped(ends, np.int64, total + 1), self._mapped(texts, np.uint8, length)
        self.ids = pa.LargeStringArray.from_buffers(total, pa.py_buffer(ends), pa.py_buffer(texts))
        valid = self._mapped(valid, np.uint8, total)
        self.valid = None if valid.all() else valid

    def _file(self):
        return tempfile.TemporaryFile(dir=self.folder)

    @staticmethod
    def _mapped(file, kind, n: int) -> np.ndarray:
        file.flush()
        # The file goes when the array does.
        return np.asarray(np.memmap(file, kind, "r", shape=(n,))) if n else np.zeros(0, dtype=kind)

    def reach(self, sx: np.ndarray, sy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and length of the run of each strip (sites x strips) in which the site may reach something."""
        outer = self.radius_m * (1 + SLACK) + SLACK
        wide = 2 * STRIPS + 5
        begin, length = np.zeros((len(sx), wide), dtype=np.int64), np.zeros((len(sx), wide), dtype=np.int64)
        order = np.argsort(sy)
        lowest = np.floor((sy - outer) / self.height).astype(np.int64) - 1
        for k, strip in enumerate(self.strip):
            south, north = strip * self.height, (strip + 1) * self.height
            at = order[np.searchsorted(sy[order], south - outer) : np.searchsorted(sy[order], north + outer, "right")]
            if not len(at):
                continue
            a, b = self.start[k], self.start[k + 1]
            least = np.maximum(0.0, np.maximum(south - sy[at], sy[at] - north))
            half = np.sqrt(np.maximum(0.0, outer * outer - least * least))
            low = np.searchsorted(self.x[a:b], sx[at] - half, "left")
            high = np.searchsorted(self.x[a:b], sx[at] + half, "right")
            begin[at, strip - lowest[at]], length[at, strip - lowest[at]] = a + low, high - low
        return begin, length

    def lists(self, site_id: pa.Array, sx: np.ndarray, sy: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Runs of sites that are sorted by id; rows with one id have one list."""
        no = site_id.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], no[1:] != no[:-1]]))
        ends = np.append(first[1:], len(no))
        sites = 1 << min(20, 63 - self.of_feature)
        # Shares of ids with about as many rows.
        for share in np.split(np.arange(len(first)), np.flatnonzero(np.diff(first // 4096)) + 1):
            own = slice(first[share[0]], ends[share[-1]])
            at = own.start
            near = *self.reach(sx[own], sy[own]), sx[own], sy[own]
            sums = np.add.reduceat(near[1].sum(axis=1), first[share] - at)
            k = 0
            while k < len(share):
                stop = k + max(1, int(np.searchsorted(sums[k : k + sites].cumsum(), LISTED, "right")))
                some = share[k:stop]
                rows = np.arange(first[some[0]], ends[some[-1]]) - at
                if len(some) == 1 and len(rows) > 1 and sums[k] > LISTED:
                    found = self._sliced(rows, *near)
                else:
                    found = [self._keys(rows, no[rows + at] - no[first[some[0]]], *near)]
                for keys in found:
                    keys.sort()
                    for part in range(0, len(keys), LISTED):
                        yield self._runs(keys[part : part + LISTED], site_id, first[some])
                k = stop

    def _keys(
        self, rows: np.ndarray, no: np.ndarray, begin: np.ndarray, length: np.ndarray, sx: np.ndarray, sy: np.ndarray
    ) -> np.ndarray:
        begin, length, run = _pieces(begin[rows].ravel(), length[rows].ravel(), LISTED)
        own = run // (2 * STRIPS + 5)
        found = [np.zeros(0, dtype=np.int64)]
        for share in _shares(length.cumsum()):
            steps, of = length[share], own[share]
            points = np.repeat(begin[share] - (steps.cumsum() - steps), steps) + np.arange(steps.sum())
            dx, dy = np.repeat(sx[rows[of]], steps) - self.x[points], np.repeat(sy[rows[of]], steps) - self.y[points]
            metres = np.sqrt(dx * dx + dy * dy)
            within = metres <= self.radius_m
            keys = self.number[points[within]] | tenths(metres[within]) << self.of_facility
            found.append(keys | np.repeat(no[of], steps)[within] << self.of_feature)
        return np.concatenate(found)

    def _sliced(
        self, rows: np.ndarray, begin: np.ndarray, length: np.ndarray, sx: np.ndarray, sy: np.ndarray
    ) -> Iterator[np.ndarray]:
        """Keys of very many rows with one id, a slice of the order at a time."""
        zero = np.zeros(1, dtype=np.int64)

        def keys(row: int) -> np.ndarray:
            return self._keys(np.array([row]), zero, begin, length, sx, sy)

        every = max(1, int(length[rows].sum()) // LISTED)
        sample = np.sort(np.concatenate([keys(row)[row % every :: every] for row in rows]))
        bounds = [-1, *np.unique(sample[LISTED // every :: max(1, LISTED // every)]).tolist(), (1 << 63) - 1]
        for low, high in zip(bounds, bounds[1:], strict=False):
            some = [k[(k > low) & (k <= high)] for k in map(keys, rows)]
            yield np.concatenate(some)

    def _runs(self, keys: np.ndarray, site_id: pa.Array, first: np.ndarray) -> pa.RecordBatch:
        group = keys >> self.of_metres
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        begin, _, _ = _pieces(begin, np.diff(np.append(begin, len(keys))), RUN)
        group = group[begin]
        facility = keys & ((1 << self.of_facility) - 1)
        ids = self.ids.take(pa.array(facility)).cast(pa.string())
        if self.valid is not None:
            ids = pc.if_else(pa.array(self.valid[facility].astype(bool)), ids, pa.scalar(None, pa.string()))
        metres = (keys >> self.of_facility & ((1 << (self.of_metres - self.of_facility)) - 1)) / 10.0
        kinds = 1 << (self.of_feature - self.of_metres)
        return pa.record_batch({
            "site_id": site_id.take(pa.array(first[group // kinds])),
            "feature": self.features.take(pa.array(group % kinds)),
            "run": pa.ListArray.from_arrays(
                pa.array(np.append(begin, len(keys)).astype(np.int32)),
                pa.StructArray.from_arrays([ids, pa.array(metres)], ["facility_id", "distance_m"]),
            ),
        })


def _pieces(begin: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut into pieces of ``most`` at most: begin, size and the run of each; empty runs have none."""
    pieces = -(-size // most)
    run = np.repeat(np.arange(len(size)), pieces)
    nth = np.arange(len(run)) - np.repeat(pieces.cumsum() - pieces, pieces)
    return begin[run] + nth * most, np.minimum(size[run] - nth * most, most), run


def tenths(metres: np.ndarray) -> np.ndarray:
    """``round_half_even`` to one decimal, times ten, of values from zero."""
    scaled = metres * 10.0
    units = np.rint(scaled)
    tie = np.flatnonzero(scaled - np.floor(scaled) == 0.5)
    if len(tie):
        x, floor = metres[tie], np.floor(scaled[tie])
        head = x * 134217729.0 - (x * 134217729.0 - x)
        lost = (head * 10.0 - scaled[tie]) + (x - head) * 10.0
        units[tie] = np.where(lost > 0, floor + 1.0, np.where(lost < 0, floor, units[tie]))
    return units.astype(np.int64)
