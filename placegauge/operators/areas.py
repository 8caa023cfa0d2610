"""Which municipalities a disc around a site touches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegauge import fixed_values as fv
from placegauge.functions.geo import cell_index, disc_offsets, geodesic_direct
from placegauge.functions.rounding import round_half_even
from placegauge.functions.staging import with_computed
from placegauge.operators.skew import split_sides
from placegauge.session import cut

# A power of two: cell borders and cell numbers are exact.
POLYGON_CELL_DEG = 1 / 64
# How far beyond its computed place an edge is still listed, against rounding; listing more is harmless.
EDGE_MARGIN_DEG = 1e-9
# Points, and rings, of a cell that are compared at once; both may be very many.
CELL_POINTS = 2_000
# Neighbours among them that share what is known of the edges beside them.
SLAB_POINTS = 256
# Points that are measured against edges at once.
MEASURED = 1 << 18


def disc_points(sites: DataFrame, radius_m: float) -> DataFrame:
    """(site_id, pos, lat, lng): 25 samples per site, coordinates to 6 decimals."""
    offsets = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(az).alias("az"), F.lit(float(d)).alias("d"))
            for i, (az, d) in enumerate(disc_offsets(radius_m))
        ]
    )
    around = sites.select("site_id", "lat", "lng", F.explode(offsets).alias("o")).select(
        "site_id", "lat", "lng", "o.pos", "o.az", "o.d"
    )
    moved = geodesic_direct(around, "lat", "lng", "az", "d", "to_lat", "to_lng")
    centre = F.col("d") == 0.0
    exact = moved.select(
        "site_id",
        "pos",
        F.when(centre, F.col("lat")).otherwise(F.col("to_lat")).alias("to_lat"),
        F.when(centre, F.col("lng")).otherwise(F.col("to_lng")).alias("to_lng"),
    )
    return with_computed(
        exact,
        {
            "lat": round_half_even(F.col("to_lat"), 6),
            "lng": round_half_even(F.col("to_lng"), 6),
        },
    ).drop("to_lat", "to_lng")


def area_name(code: Column) -> Column:
    """Name of a municipality code; areas outside the prefecture get a pseudo-name."""
    names = F.create_map(*[F.lit(v) for kv in fv.MUNICIPALITIES.items() for v in kv])
    before, after = fv.OUTSIDE_AREA_FORMAT.split("{code}")
    outside = F.concat(F.lit(before), code, F.lit(after))
    return F.coalesce(F.element_at(names, code), outside)


def _distinct_areas(found: DataFrame) -> DataFrame:
    return found.groupBy("site_id", "code").agg(F.min("name").alias("name"))


def areas_by_lookup(points: DataFrame, lookup: DataFrame) -> DataFrame:
    """(site_id, code, name) from answers given per sampled point; points without one are ignored.

    ``lookup``: lat, lng (6 decimals), code.
    """
    answers = lookup.where(F.col("code").isNotNull() & (F.col("code") != "")).select(
        "lat", "lng", F.substring("code", 1, 5).alias("code")
    )
    found = points.join(answers, ["lat", "lng"])
    return _distinct_areas(found.withColumn("name", area_name(F.col("code"))))


def ring_edges(polygons: DataFrame) -> DataFrame:
    """(ring_id, code, name, a, b): one row per edge of every ring."""
    numbered = polygons.select(F.monotonically_increasing_id().alias("ring_id"), "code", "name", "ring")
    n = F.size("ring")
    edges = F.arrays_zip(
        F.slice("ring", F.lit(1), n - 1).alias("a"), F.slice("ring", F.lit(2), n - 1).alias("b")
    )
    listed = numbered.where(n > 1).select("ring_id", "code", "name", F.explode(edges).alias("e"))
    return listed.select("ring_id", "code", "name", "e.a", "e.b")


def _lat_at(lng: Column) -> Column:
    """Where the edge from a to b meets a meridian; within the edge also after rounding."""
    a, b = F.col("a"), F.col("b")
    at = a["lat"] + (b["lat"] - a["lat"]) * F.try_divide(lng - a["lng"], b["lng"] - a["lng"])
    return F.greatest(F.least(a["lat"], b["lat"]), F.least(F.greatest(a["lat"], b["lat"]), at))


def edge_index(edges: DataFrame) -> DataFrame:
    """(cx, cy, code, name, odd, edges): cells that a ring meets or holds.

    A cell lists the edges that pass through it and no others: an edge is copied once for each cell
    it crosses, however large its ring.  ``odd`` says whether a point that sits in the cell's south-east
    corner has an odd number of edges to its east, which accounts for all the edges not listed.  It
    changes along a column of cells only where the ring crosses the column's eastern border, so each
    crossing is one row and cells without any edge need none.
    """
    size = POLYGON_CELL_DEG
    west, east = F.least("a.lng", "b.lng"), F.greatest("a.lng", "b.lng")
    columns = edges.withColumn("cx", F.explode(F.sequence(cell_index(west, size), cell_index(east, size))))
    left, right = F.col("cx") * size, (F.col("cx") + 1) * size
    first = F.when(F.col("a.lng") <= F.col("b.lng"), F.col("a.lat")).otherwise(F.col("b.lat"))
    last = F.when(F.col("a.lng") <= F.col("b.lng"), F.col("b.lat")).otherwise(F.col("a.lat"))
    upright = F.col("a.lng") == F.col("b.lng")
    from_lat = F.when(~upright & (west < left), _lat_at(left)).otherwise(first)
    to_lat = F.when(~upright & (east > right), _lat_at(right)).otherwise(last)
    crosses = (F.col("a.lng") >= right) != (F.col("b.lng") >= right)
    placed = cut(
        columns.withColumn("border_lat", F.when(crosses, _lat_at(right)))
        .withColumn("south", F.least(from_lat, to_lat) - EDGE_MARGIN_DEG)
        .withColumn("north", F.greatest(from_lat, to_lat) + EDGE_MARGIN_DEG)
    )
    ring = ["ring_id", "code", "name", "cx"]
    rows = F.sequence(cell_index(F.col("south"), size), cell_index(F.col("north"), size))
    listed = (
        placed.withColumn("cy", F.explode(rows))
        .groupBy(*ring, "cy")
        .agg(F.collect_list(F.struct("a", "b", "border_lat")).alias("edges"))
    )
    # Of the crossings of a column's eastern border those above a corner count for it: sorted from
    # the north, corners between the first and the second, the third and the fourth, ... are odd.
    below = F.ceil(F.col("border_lat") / F.lit(size)) - 1
    columns_met = (
        placed.where("border_lat IS NOT NULL")
        .groupBy(*ring)
        .agg(F.sort_array(F.collect_list(below), asc=False).alias("at"))
    )
    pairs = F.sequence(F.lit(0), F.floor(F.size("at") / 2).cast("int") - 1)
    runs = columns_met.where(F.size("at") > 1).select(*ring, "at", F.explode(pairs).alias("k"))
    top, bottom = F.get("at", 2 * F.col("k")), F.get("at", 2 * F.col("k") + 1) + 1
    odd = (
        runs.where(bottom <= top)
        .select(*ring, F.explode(F.sequence(bottom, top)).alias("cy"))
        .withColumn("odd", F.lit(True))
    )
    none = F.array().cast(listed.schema["edges"].dataType)
    return listed.join(odd, [*ring, "cy"], "full").select(
        "cx", "cy", "code", "name",
        F.coalesce("odd", F.lit(False)).alias("odd"),
        F.coalesce("edges", none).alias("edges"),
    )


def areas_by_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(site_id, code, name) from closed rings.

    ``polygons``: code, name, ring array<struct<lng, lat>>.  A point lies inside where an odd number
    of edges passes to its east.  Points are met with the rings of their cell of ``edge_index``.

    Sites with one place need no more than that: a group has all rings of a code that meet the cell, so
    what it finds is distinct, and many sites in many rings are listed without being dealt again.  Only what
    sites with several places find is put together.
    """
    boxes = cut(edge_index(cut(ring_edges(polygons))))
    located = points.where(
        "lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng)"
    ).select("site_id", "lat", "lng")
    place = F.struct("lat", "lng")
    ends = cut(located.groupBy("site_id").agg(F.min(place).alias("at"), F.max(place).alias("to")))
    alone = F.col("site_id").isNotNull() & (F.col("at") == F.col("to"))
    n_one, n_several = ends.agg(F.count_if(alone), F.count_if(~alone)).first()
    found = []
    if n_one:
        found.append(_met_areas(ends.where(alone).select("site_id", "at.lat", "at.lng"), boxes))
    if n_several or not n_one:
        several = located.join(ends.where(~alone), "site_id", "left_semi").unionByName(located.where("site_id IS NULL"))
        found.append(_distinct_areas(_met_areas(several, boxes)))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _met_areas(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """(site_id, code, name) of every point, once for each code: the rings of a cell are kept together by code."""
    size = POLYGON_CELL_DEG
    celled = points.withColumn("cx", cell_index(F.col("lng"), size)).withColumn(
        "cy", cell_index(F.col("lat"), size)
    )
    met = boxes.join(celled.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi")
    left, right, on = split_sides(
        celled, met, ["cx", "cy"], F.struct("site_id", "lat", "lng"), part_rows=CELL_POINTS,
        other_spread=F.col("code"), spread_out=True,
    )
    code, name, site = (
        f.dataType.simpleString() for f in (boxes.schema["code"], boxes.schema["name"], points.schema["site_id"])
    )
    # A list has the sites of a slab, so a code and its name are handed over once for all of them.
    lists = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(
        sites_by_area, f"code {code}, name {name}, sites array<{site}>"
    )
    return lists.select(F.explode("sites").alias("site_id"), "code", "name")


def sites_by_area(points: pa.Table, rings: pa.Table) -> pa.Table:
    """(code, name, sites) of one cell: which of its points lie in the rings of an area."""
    none = {"code": rings["code"][:0], "name": rings["name"][:0], "sites": pa.array([], pa.list_(points["site_id"].type))}
    if not len(points) or not len(rings):
        return pa.table(none)
    # Rings of a code and a name are neighbours; of the names of a code the least comes first.
    rings = rings.sort_by([("code", "ascending"), ("name", "ascending")]).combine_chunks()
    code_no, name_no = (
        pc.dictionary_encode(rings[c].combine_chunks(), null_encoding="encode").indices.to_numpy() for c in ("code", "name")
    )
    other_code = np.concatenate([[True], code_no[1:] != code_no[:-1]])
    starts = np.flatnonzero(other_code | np.concatenate([[True], name_no[1:] != name_no[:-1]]))
    again = np.flatnonzero(~other_code[starts])
    edges = rings["edges"].combine_chunks()
    of = np.repeat(np.arange(len(rings)), pc.list_value_length(edges).to_numpy())
    flat = edges.flatten()
    a, b = flat.field("a"), flat.field("b")
    values = [c.to_numpy(zero_copy_only=False) for c in (
        a.field("lng"), a.field("lat"), b.field("lng"), b.field("lat"), flat.field("border_lat")
    )]
    odd = rings["odd"].to_numpy().astype(np.uint8)
    corner = points["cy"][0].as_py() * POLYGON_CELL_DEG
    border = (points["cx"][0].as_py() + 1) * POLYGON_CELL_DEG
    lng, lat = points["lng"].to_numpy(), points["lat"].to_numpy()
    kinds = rings.select(["code", "name"]).take(pa.array(starts))
    sites = points["site_id"].combine_chunks()
    tables = []
    for slab in np.array_split(np.argsort(lng), -(-len(lng) // SLAB_POINTS)):
        slab = slab[np.argsort(lat[slab])]
        inside = points_in_rings(lng[slab], lat[slab], corner, border, odd, of, *values)
        if len(starts) < len(rings):
            inside = np.bitwise_or.reduceat(inside, starts, axis=1)
        for k in again:
            # The columns before hold what the other names of the code found first.
            same = int(np.searchsorted(code_no[starts], code_no[starts[k]]))
            inside[:, k] &= ~inside[:, same:k].any(axis=1)
        inside = np.ascontiguousarray(inside.T)
        many = np.count_nonzero(inside, axis=1)
        found = np.flatnonzero(many)
        offsets = np.concatenate([[0], many[found].cumsum()]).astype(np.int32)
        at = sites.take(pa.array(slab[np.nonzero(inside)[1]]))
        some = kinds.take(pa.array(found))
        tables.append(pa.table({
            "code": some["code"], "name": some["name"], "sites": pa.ListArray.from_arrays(pa.array(offsets), at)
        }))
    return pa.concat_tables(tables)


def points_in_rings(
    x: np.ndarray, y: np.ndarray, corner: float, border: float, odd: np.ndarray, of: np.ndarray,
    ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, crossing: np.ndarray,
) -> np.ndarray:
    """Which points of a cell, sorted by latitude, lie in which rings: points x rings, true or false.

    Listed edges (of ring ``of``) are counted up to the cell's eastern border, and beyond it by the
    corner's ``odd``, turned once for each edge that crosses the border between the corner's latitude
    and the point's.  An edge passes a run of the points; where it lies to the east of all of them the run
    is turned at its two ends, and only for edges among them the points of the run are measured.
    """
    rings = len(odd)
    turned = np.zeros((len(y) + 1, rings), dtype=np.uint8)
    turned[0] = odd
    cells = turned.reshape(-1)
    crosses = ~np.isnan(crossing)
    ring, met = of[crosses], crossing[crosses]
    np.add.at(cells, ring, (met <= corner).astype(np.uint8))
    np.add.at(cells, np.searchsorted(y, met) * rings + ring, np.uint8(1))
    # The part of an edge beyond the border is the corner's matter.
    near = crosses | (ax < border)
    # So is an edge to the west of all points nobody's.
    near &= np.maximum(ax, bx) > x.min() - EDGE_MARGIN_DEG
    of, ax, ay, bx, by, crossing, crosses = (v[near] for v in (of, ax, ay, bx, by, crossing, crosses))
    begin = np.where(crosses & (ax >= border), crossing, ay)
    end = np.where(crosses & (ax < border), crossing, by)
    low = np.searchsorted(y, np.minimum(begin, end))
    high = np.searchsorted(y, np.maximum(begin, end))
    east = np.minimum(ax, bx) > x.max() + EDGE_MARGIN_DEG
    for at in (low, high):
        np.add.at(cells, at[east] * rings + of[east], np.uint8(1))
    for k in range(1, len(y)):
        turned[k] += turned[k - 1]
    among = np.flatnonzero(~east & (high > low))
    for share in np.split(among, _shares((high - low)[among])):
        steps = high[share] - low[share]
        edge = np.repeat(share, steps)
        point = np.arange(len(edge)) + np.repeat(low[share] - (steps.cumsum() - steps), steps)
        at = (bx - ax)[edge] * ((y[point] - ay[edge]) / (by - ay)[edge]) + ax[edge]
        hit = x[point] < at
        np.add.at(cells, point[hit] * rings + of[edge[hit]], np.uint8(1))
    return (turned[:-1] & 1).astype(bool)


def _shares(steps: np.ndarray) -> np.ndarray:
    """Where to split runs of so many points into shares of about ``MEASURED``."""
    ends = steps.cumsum()
    total = int(ends[-1]) if len(ends) else 0
    return np.unique(np.searchsorted(ends, np.arange(MEASURED, total, MEASURED), "right"))


def scope_of(site_areas: DataFrame, extra: list[str]) -> DataFrame:
    """Distinct names of all touched areas and the extra organizations."""
    names = site_areas.select("name")
    if extra:
        spark = site_areas.sparkSession
        names = names.union(
            spark.range(1).select(F.explode(F.array(*[F.lit(e) for e in extra])).alias("name"))
        )
    return names.distinct()
