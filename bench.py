"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: tables (default sf0.1); BENCH_CPUS: local cores (default 8). Every query runs once
after a short warm-up and writes to Spark's ``noop`` sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postloom.plans import catalog  # noqa: E402
from postloom.session import local_session  # noqa: E402

HEADLINE = (
    "flagship_accepted_by_source", "d3_dedup_ttl", "d5_two_stage_dedup", "d6_dedup_first", "d8_admit_rate_limit",
    "d4_dedup_ttl_stream",
    "q1_list_jobs", "q4_set_status", "q5_stats_by_source", "q7_board_counts", "q10_upsert_contacts", "s4_export_rows",
    "p4_normalize_date", "p5_validate_contract", "p21_normalize_url", "p9_flatten_ashby", "p11_parse_listing_cards",
    "p13_cards_naukri", "p13_cards_career_page", "f1_stack_filter", "f5_score_search_results", "j1_draft_candidates",
    "j1_draft_candidates_all", "j2_apply_candidates", "c9_discover_contacts", "r4_rank_global",
    "g1_observation_category", "g3_render_email", "g8_candidate_profile", "g12_render_digest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, partitions=cpus, app="bench")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
        "shuffle_partitions": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
