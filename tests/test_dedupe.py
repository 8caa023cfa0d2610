"""Absorption by priority: what must hold of the result, on crowded spots and long chains."""

import numpy as np
import pytest
from plain_rows import rows

from placegauge.operators import dedupe

SCHEMA = (
    "facility_id string, feature string, name string, lat double, lng double, "
    "coord_source string, precision string, unlocated_reason string"
)
PLACES = {"culture": 30.0}
SOURCES = [("source", None), ("geocode", "exact"), ("geocode", "partial"), ("geocode", None)]
NEAR = 150.0


def facilities(count, seed, width=0.02, names=4, spots=None):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(count):
        lat, lng = (35.7, 139.7) + rng.random(2) * width
        if spots and k % 3 == 0:
            lat, lng = 35.701 + 0.0002 * (k % spots), 139.702
        kind = SOURCES[rng.integers(4)]
        feature = "culture" if rng.random() < 0.5 else "park"
        out.append((f"set:{k}", feature, f"name {rng.integers(names)}", float(lat), float(lng), *kind, None))
    return out


def unit_vectors(data):
    lat, lng = np.radians([r[3] for r in data]), np.radians([r[4] for r in data])
    return np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], axis=1)


def check(data, absorbed):
    """Three conditions that only the outcome of a scan by priority meets."""
    ids = np.array([r[0] for r in data])
    at = unit_vectors(data)
    chord = np.linalg.norm(at[:, None] - at[None], axis=2)
    metres = 2 * 6371008.8 * np.arcsin(chord / 2)
    feature, name = (np.array([r[c] for r in data]) for c in (1, 2))
    same = feature[:, None] == feature[None]
    by_name = same & (name[:, None] == name[None]) & (metres <= NEAR)
    by_place = same & (feature == "culture")[:, None] & (metres <= PLACES["culture"])
    order = np.lexsort([ids, [SOURCES.index(r[5:7]) for r in data]])
    place = np.argsort(order)
    kept = np.array([i not in absorbed for i in ids])
    # 1. no two kept ones conflict
    clash = (by_name | by_place) & kept[:, None] & kept[None]
    np.fill_diagonal(clash, False)
    assert not clash.any()
    for k in np.flatnonzero(~kept):
        # 2. and 3. an absorbed one names its first earlier kept neighbour, by name before by place
        for rule in (by_name, by_place):
            ahead = np.flatnonzero(rule[k] & kept & (place < place[k]))
            if len(ahead):
                assert absorbed[ids[k]] == ids[ahead[place[ahead].argmin()]]
                break
        else:
            raise AssertionError(f"{ids[k]} has no kept earlier neighbour")


def absorbed_of(spark, data, hot=None):
    df = spark.createDataFrame(data, SCHEMA)
    out = dedupe.absorb(df, NEAR, PLACES, hot_rows=hot).where("absorbed_by IS NOT NULL")
    return {r.facility_id: r.absorbed_by for r in out.collect()}


@pytest.fixture
def rounds(monkeypatch):
    made = []
    whole = dedupe._Tiles.kept

    def kept(tiles, points):
        made.append(1)
        return whole(tiles, points)

    monkeypatch.setattr(dedupe._Tiles, "kept", kept)
    return made


@pytest.mark.parametrize("hot", [None, 5])
def test_crowds(spark, hot):
    data = facilities(350, 1, spots=7)
    check(data, absorbed_of(spark, data, hot))


def test_small_tiles_agree(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "TILE_M", 500.0)
    data = facilities(300, 2, width=0.015, names=2)
    check(data, absorbed_of(spark, data))


def test_many_names_at_one_spot(spark, rounds):
    data = [(f"s:{k}", "culture", f"item {k}", 35.66, 139.75, "source", None, None) for k in range(1000)]
    found = absorbed_of(spark, data)
    assert len(found) == 999 and set(found.values()) == {"s:0"} and len(rounds) == 1


def test_long_chain_takes_few_rounds(spark, rounds):
    data = [(f"{k:04d}", "park", "path", 35.4 + k * 0.001, 139.6, "source", None, None) for k in range(200)]
    found = absorbed_of(spark, data)
    assert found == {f"{k:04d}": f"{k - 1:04d}" for k in range(1, 200, 2)}
    assert len(rounds) < 20


def test_ids_are_text_and_unlocated_ones_stay(spark):
    data = [
        ("q:2", "park", "Lake", 35.61, 139.71, "source", None, None),
        ("q:10", "park", "Lake", 35.61, 139.71, "source", None, None),
        ("v", "park", "Hill", 35.63, 139.73, "geocode", "partial", None),
        ("w", "park", "Hill", 35.6302, 139.73, "geocode", "exact", None),
        ("n1", "park", "Gate", 35.65, 139.75, "source", None, None),
        ("n2", "park", "Wall", 35.65, 139.75, "source", None, None),
        ("lost", "park", "Lake", None, None, None, None, "no-address"),
    ]
    assert absorbed_of(spark, data) == {"q:2": "q:10", "v": "w"}
    kept, absorbed = dedupe.merge_places(spark.createDataFrame(data, SCHEMA))
    assert absorbed.count() == 2
    assert [r[0] for r in rows(kept, "facility_id")] == ["lost", "n1", "n2", "q:10", "w"]
