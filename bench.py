"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tagloom import catalogue
from tagloom.session import session
from tagloom.sources.readers import force

#: the programs with published numbers, and the nested workloads by three plans
HEADLINE = (
    "loop_conditional_sum", "loop_equal_and_match", "loop_word_count", "loop_histogram", "loop_linear_regression", "loop_group_by",
    "loop_matrix_add", "loop_matrix_multiply", "array_multiply", "matrix_factorization",
    "bounce_rate_per_day", "bounce_rate_per_type", "top_partner_per_group", "pairwise_corr", "pagerank_per_group", "kmeans_centroids",
    "average_distances_per_group", "lang_corr_scalar_sum", "lang_group_having_order", "lang_equi_join", "lifted_count", "split_baseline",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    wanted = list(catalogue.QUERIES) if "--all" in sys.argv else HEADLINE
    force(catalogue.QUERIES["bounce_rate_per_type"](spark, sf))  # starts the JVM's compilers
    times = {}
    for name in wanted:
        began = time.time()
        force(catalogue.QUERIES[name](spark, sf))
        times[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
