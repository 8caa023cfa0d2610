"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the scale folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from placegauge.plans.registry import QUERIES
from placegauge.session import build_session

HEADLINE = [
    "haversine_distance",
    "radius_counts",
    "radius_pairs",
    "site_areas",
    "site_aggregates",
    "order_percentiles",
    "score_table",
    "daily_usage",
    "column_roles",
    "normalised_facilities",
    "located_facilities",
    "ingest_report",
    "absorbed_duplicates",
    "dataset_evaluation",
    "best_file_per_order",
    "document_duplicates",
    "judgement_store",
    "site_master",
    "score_violations",
    "provenance_register",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names.split(",") if names else HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
