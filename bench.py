"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the local cores. Each query is
run to the end with a ``noop`` sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sourceloom.plans.catalog import QUERIES  # noqa: E402
from sourceloom.session import build_session  # noqa: E402

HEADLINE = [
    "category_counts",
    "build_summary",
    "all_facts",
    "kb_json",
    "kb_collisions",
    "py_params",
    "js_methods",
    "cpp_docstrings",
    "jl_merge",
    "ignore_filter",
    "change_context",
    "commit_scope",
    "kb_staleness",
    "context_text",
    "prompt_render",
    "commit_message",
    "message_trailers",
    "staleness_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
