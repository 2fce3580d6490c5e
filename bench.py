"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import time

from strandloom.plans import catalogue
from strandloom.session import session

QUERIES = ("c02_compact_groups", "p1_build_panel", "p2_screen_to_calls", "d06_one_mismatch_hits", "c31_assign_evidence", "e05_species_calls_lineage_aware", "e07_consolidation", "f06_open_set_predict", "f15_holdout_validation", "g05_target_performance", "p3_threshold_sweep", "b27_read_metrics", "b04_kmer_windows_multi_k")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": str(4 * int(cpus) if cpus.isdigit() else 32), "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in QUERIES:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
