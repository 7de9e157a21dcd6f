"""Wall-clock of the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.  Each
query is run once to warm up on the smallest tables and then timed in full; short ones
three times, for the median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from famloom.session import local_session  # noqa: E402
from query_catalog import QUERIES  # noqa: E402

HEADLINE = [
    "annotation_stats",
    "annotation_diff",
    "annotation_diff_summary",
    "interval_merge",
    "interval_difference",
    "exclusive_regions",
    "append_annotations",
    "jaccard_pairs",
    "family_similarities",
    "redundant_families",
    "superfamily_report",
    "novelty_scores",
    "leaf_distribution",
    "exclusive_leaves",
    "breadth_top",
    "stars",
    "rank_profiles",
    "map_ids",
    "remove_ids",
    "uncovered_clusters",
    "state_runs",
    "trim_alignments",
    "length_bins",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    spark = local_session("bench", cores=cores, partitions=int(cores) if cores.isdigit() else 8)
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE

    def run(name: str, tables: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in names:
        if os.path.isdir(small):
            run(name, small)
        times = [run(name, folder)]
        if times[0] < 5:  # short runs vary: take the median of three
            times += [run(name, folder) for _ in range(2)]
        seconds[name] = round(statistics.median(times), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
