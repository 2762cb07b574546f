"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local threads, and
BENCH_QUERIES a comma list of names or `all`. Each query runs in full into a sink that drops rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from fraudspark.plans import catalog, registry
from fraudspark.session import build_session

HEADLINE = [
    "gp01_portfolio", "gp02_related_owner_work", "gp03_job_timelines", "gp05_contractor_profile",
    "gp06_contractor_collaboration", "gp07_owner_fraud_score", "gp08_fraud_rings", "gp09_violated_properties",
    "gp12_owners_violations_and_jobs", "gp13_borough_density", "gp14_penalties_by_type", "jn01_shared_address_pairs",
    "jn02_similar_addresses", "jn06_property_enrichment", "jn12_permit_after_violation", "jn13_complaint_before_permit",
    "wn01_follow_ups", "wn06_recent_permits", "wn07_repeat_violations", "ent05_owner_nodes", "ent08_edges",
    "dq01_dataset_quality", "dq03_numeric_summary", "ag07_box_statistics", "rs02_property_scores", "rs10_composite",
    "rs12_building_risk", "gr01_co_occurrence_edges", "gr05_components", "gr06_label_propagation", "gr15_modularity",
    "ep04_project_documents", "sm02_alerts_per_window",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(registry.QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # start the engine before the clock
    seconds: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/"))
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.removeprefix("sf")) if scale.startswith("sf") else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
