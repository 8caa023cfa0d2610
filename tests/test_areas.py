"""Points in rings: cells with their own edges against counting all edges of all rings."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from plain_rows import rows

from placegauge.operators import areas

POLYGONS = "code string, name string, ring array<struct<lng: double, lat: double>>"


def inside(lng, lat, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > lat) != (by > lat) and lng < (bx - ax) * ((lat - ay) / (by - ay)) + ax:
            odd = not odd
    return odd


def star(seed, lng, lat, radius, corners):
    pick = random.Random(seed)
    ring = [
        (lng + radius * r * math.cos(2 * math.pi * k / corners), lat + radius * r * math.sin(2 * math.pi * k / corners))
        for k, r in enumerate(pick.uniform(0.2, 1) for _ in range(corners))
    ]
    return [*ring, ring[0]]


def square(west, south, side):
    return [(west, south), (west + side, south), (west + side, south + side), (west, south + side), (west, south)]


def found(spark, points, polygons):
    at = spark.createDataFrame(
        [(f"s{k}", 0, lat, lng) for k, (lng, lat) in enumerate(points)], "site_id string, pos int, lat double, lng double"
    )
    shapes = spark.createDataFrame(polygons, POLYGONS)
    return rows(areas.areas_by_polygons(at, shapes), "site_id", "code")


def brute(points, polygons):
    return sorted(
        {(f"s{k}", code) for k, (lng, lat) in enumerate(points) for code, _, ring in polygons
         if ring and inside(lng, lat, ring)}, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_same_as_counting_all_edges(spark, seed):
    pick = random.Random(seed)
    polygons = [
        (f"{k:05}", f"n{k}", star(100 * seed + k, pick.uniform(-0.3, 0.3), pick.uniform(-0.3, 0.3),
                                  pick.choice([0.001, 0.02, 0.3]), pick.choice([3, 8, 200])))
        for k in range(12)
    ]
    polygons.append(("00003", "other part", square(0.25, 0.25, 1 / 64)))
    polygons.append(("90000", "on the grid", square(-0.25, -0.125, 0.5)))
    polygons.append(("90001", "bow", [(-0.2, -0.2), (0.2, 0.2), (0.2, -0.2), (-0.2, 0.2), (-0.2, -0.2)]))
    polygons += [("90002", "none", None), ("90003", "empty", []), ("90004", "point", [(0.0, 0.0)])]
    points = [(pick.uniform(-0.5, 0.5), pick.uniform(-0.5, 0.5)) for _ in range(600)]
    # Corners and borders of cells and rings.
    grid = [k / 64 for k in (-16, -8, -1, 0, 1, 16)]
    points += [(x, y) for x in grid for y in grid]
    points += [p for _, _, ring in polygons if ring for p in ring[:3]]
    assert found(spark, points, polygons) == brute(points, polygons)


def test_a_ring_as_large_as_a_country(spark):
    ring = star(7, 139.0, 36.0, 4.0, 20_000)
    edges = areas.ring_edges(spark.createDataFrame([("1", "large", ring)], POLYGONS))
    index = areas.edge_index(edges)
    listed, cells = index.selectExpr("sum(size(edges))", "count(*)").first()
    crossed = sum(
        abs(int(ax * 64) - int(bx * 64)) + abs(int(ay * 64) - int(by * 64)) + 1
        for (ax, ay), (bx, by) in zip(ring, ring[1:])
    )
    # Once for each cell that an edge crosses, and inner cells without any edge.
    assert listed <= crossed * 1.01 and cells < 600 * 600
    pick = random.Random(1)
    points = [(pick.uniform(135, 143), pick.uniform(32, 40)) for _ in range(200)]
    assert found(spark, points, [("1", "large", ring)]) == brute(points, [("1", "large", ring)])


def test_crowded_cells_are_dealt_to_many_tasks(spark, monkeypatch):
    """Few points in many rings: the pairs are many, so neither side's size decides on the tasks."""
    monkeypatch.setattr(areas, "CELL_POINTS", 3, raising=False)
    pick = random.Random(9)
    points = [(pick.uniform(0, 0.014), pick.uniform(0, 0.014)) for _ in range(40)]
    polygons = [(f"{k:05}", f"n{k}", square(-0.1, -0.1, 0.1 + k / 2000)) for k in range(30)]
    assert found(spark, points, polygons) == brute(points, polygons)
    at = spark.createDataFrame(
        [(f"s{k}", 0, lat, lng) for k, (lng, lat) in enumerate(points)], "site_id string, pos int, lat double, lng double"
    )
    plan = areas.areas_by_polygons(at, spark.createDataFrame(polygons, POLYGONS))
    plan = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [cx" in plan


def test_areas_of_sites_with_one_place_are_listed_where_they_are_found(spark):
    """Many sites in many rings: what is found is not dealt and sorted again to be distinct."""
    polygons = [(f"{k:05}", f"n{k}", square(-0.1, -0.1, 0.1 + k / 2000)) for k in range(30)]
    polygons += [("00003", "a better name", square(-0.05, -0.05, 0.1)), ("00004", None, square(-0.05, -0.05, 0.1)),
                 (None, "no code", square(0.0, 0.0, 0.01)), (None, "no code", square(0.0, 0.0, 0.01)),
                 ("90000", "not closed by null", [*square(0.0, 0.0, 0.01)[:2], None, (0.01, 0.01), (0.0, 0.0)])]
    one = [("a", 0.004, 0.004), ("a", 0.004, 0.004), ("b", 0.012, 0.003), ("nan", float("nan"), 0.004), ("none", None, 0.0)]
    several = [("c", 0.004, 0.004), ("c", 0.004, 0.0041), ("c", 0.3, 0.3), (None, 0.004, 0.004), (None, 0.005, 0.004)]
    at = spark.createDataFrame([*one, *several], "site_id string, lat double, lng double")
    shapes = spark.createDataFrame(polygons, POLYGONS)
    result = areas.areas_by_polygons(at, shapes)
    want = {}
    for site, lat, lng in [*one[:3], *several]:
        for code, name, ring in polygons[:-1]:
            if inside(lng, lat, ring):
                want.setdefault((site, code), []).append(name)
    names = {key: min((n for n in found if n is not None), default=None) for key, found in want.items()}
    got = rows(result, "site_id", "code", "name")
    assert [r for r in got if r[1] != "90000"] == sorted(((*k, n) for k, n in names.items()), key=repr)
    plan = result._jdf.queryExecution().optimizedPlan()
    parts = plan.children()
    assert plan.nodeName() == "Union" and parts.size() == 2
    above = [parts.apply(k).toString().split("CoGroups")[0] for k in range(2)]
    assert "Aggregate" not in above[0] and "Aggregate" in above[1]


def test_slabs_of_a_cell_and_shares_of_a_slab(monkeypatch):
    """The points of a cell cut into slabs, and what is measured cut into shares, give the same."""
    monkeypatch.setattr(areas, "SLAB_POINTS", 7)
    monkeypatch.setattr(areas, "MEASURED", 5)
    pick = random.Random(3)
    size = areas.POLYGON_CELL_DEG
    at = [(pick.uniform(0, size), pick.uniform(0, size)) for _ in range(60)]
    # Within the cell, so that all edges are listed and nothing is odd from outside.
    stars = [star(k, size / 2, size / 2, size / 2.1, pick.choice([3, 9, 40])) for k in range(25)]
    edges = [[{"a": {"lng": a[0], "lat": a[1]}, "b": {"lng": b[0], "lat": b[1]}, "border_lat": None}
              for a, b in zip(s, s[1:])] for s in stars]
    place = pa.struct([("lng", pa.float64()), ("lat", pa.float64())])
    points = pa.table({"site_id": list(range(60)), "lng": [p[0] for p in at], "lat": [p[1] for p in at],
                       "cx": pa.array([0] * 60), "cy": pa.array([0] * 60)})
    rings = pa.table({
        "code": [f"{k // 2}" for k in range(25)], "name": [f"n{k}" for k in range(25)], "odd": [False] * 25,
        "edges": pa.array(edges, pa.list_(pa.struct([("a", place), ("b", place), ("border_lat", pa.float64())]))),
    })
    found = areas.sites_by_area(points, rings)
    got = [(site, code) for code, sites in zip(found["code"].to_pylist(), found["sites"].to_pylist()) for site in sites]
    assert len(got) == len(set(got))
    assert set(got) == {(i, f"{k // 2}") for i, p in enumerate(at) for k, s in enumerate(stars) if inside(*p, s)}
    assert not len(areas.sites_by_area(points[:0], rings)) and not len(areas.sites_by_area(points, rings[:0]))
    inside_none = areas.points_in_rings(np.array([0.1]), np.array([0.1]), 0.0, 1.0, np.array([0, 1], dtype=np.uint8),
                                        np.array([], dtype=int), *[np.array([])] * 5)
    assert inside_none.tolist() == [[False, True]]
