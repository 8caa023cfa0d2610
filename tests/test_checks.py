"""Registered queries against their SQL at the smallest scale.

A choice across all modules by default; CHECK_ALL=1 runs every query.
"""

import os

import pytest
from compare import compare, connect

from placegauge.plans.registry import ORACLES, QUERIES

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
CHOSEN = [
    "haversine_distance", "plane_projection", "radius_pairs", "radius_counts", "areas_by_lookup",
    "order_percentiles", "score_table", "missing_reasons", "column_roles", "fill_rates",
    "judged_rows", "complete_addresses", "address_matches", "absorbed_duplicates",
    "verdict_reasons", "best_file_per_order", "document_duplicates", "manual_overrides",
    "judgement_store", "call_costs", "daily_usage", "site_master", "provenance_register",
    "base_sources", "score_violations", "text_digests",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("CHECK_ALL") else CHOSEN)
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name)) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
