"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the cores. Every query runs twice on fresh plans and its second time counts,
so that class loading and code generation of the first run do not drown the work.
"""

from __future__ import annotations

import json
import os
import time

from sheetloom import build_session
from sheetloom.suite import QUERIES, load_all

HEADLINES = [
    "profile_table_lineitem",
    "profile_counts_document_text",
    "infer_types_all_tables",
    "numeric_stats_extendedprice",
    "histogram_extendedprice",
    "blank_stats_lineitem",
    "rule_results_all",
    "quality_summary",
    "rule_unique",
    "unique_document_rows",
    "filter_contains",
    "page_offset_limit",
    "page_deep_lineitem",
    "window_envelope",
    "tx_preview",
    "tx_apply_chain",
    "patch_cells",
    "sql_workspace_join",
    "csv_lineitem_roundtrip",
    "xlsx_roundtrip",
    "xlsx_lineitem",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    spark = build_session(f"local[{cpus}]", "bench", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    seconds = {}
    for name in HEADLINES:
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
