"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tokenloom.catalog import lake, load  # noqa: E402
from tokenloom.session import build_session  # noqa: E402

#: Ingest steps first: they write the normalised tables the queries read.
INGEST = ["linear_events", "linear_turn_table", "linear_items", "graph_log", "graph_turn_table", "conversation_log"]
HEADLINE = [
    "context_composition_peak",
    "context_largest",
    "context_size_per_turn",
    "growth_timeline",
    "growth_largest_jumps",
    "prompt_spikes",
    "prompt_spike_causes",
    "chain_sizes",
    "chain_members",
    "ratio_fit",
    "residual_steps",
    "lifecycle_linear",
    "lifecycle_items",
    "diff_by_category",
    "compaction_diff_items",
    "turn_costs",
    "session_costs",
    "cost_what_if",
    "corpus_totals",
    "corpus_by_tool",
    "session_diagnostics",
    "format_drift",
    "duplicate_groups",
    "content_compressed_sizes",
    "secret_scan",
    "redact_text",
    "e2e_linear_turns",
    "e2e_graph_turns",
    "ingest_graph_events",
    "ingest_linear_events",
    "scan_log_files",
    "alert_candidates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(max(8, int(cpus))),
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    # Start-up of the JVM and of code generation is not a query.
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in INGEST:
        start = time.perf_counter()
        getattr(lake, name)(spark, sf_dir)
        times[f"ingest:{name}"] = round(time.perf_counter() - start, 3)
    for name in os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split():
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of ingest steps and headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
