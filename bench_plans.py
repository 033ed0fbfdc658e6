"""Time our plans against the plain alternative of one job per statistic, on lineitem and orders.

Prints one line per comparison; BENCH_SF_DIR and BENCH_CPUS as in bench.py.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from sheetloom import build_session, scratch_dir
from sheetloom.functions.text import blank, blank_cell, text_of
from sheetloom.operators import grid, profile, rules
from sheetloom.plans.versions import DocumentStore
from sheetloom.sources import delimited, ingest, workbooks
from sheetloom.suite import load_all


def seconds(work) -> float:
    best = []
    for _ in range(2):
        started = time.perf_counter()
        work()
        best.append(time.perf_counter() - started)
    return round(min(best), 2)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    settings = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    spark = build_session(f"local[{cpus}]", "plans", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    from sheetloom.suite.inputs import dirty_orders
    from sheetloom.suite.quality import RULES

    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    orders = dirty_orders(spark, folder)
    all_rules = [r for r, _ in RULES]

    def report(name: str, ours, plain) -> None:
        print(f"{name}: {seconds(ours)} s, plain {seconds(plain)} s", flush=True)

    report(
        "blank statistics of lineitem, one aggregate vs one scan per column",
        lambda: grid.blank_stats(items).collect(),
        lambda: [items.where(blank_cell(items, c)).count() for c in items.columns],
    )
    report(
        "17 rules on dirty orders, fused vs two scans per rule",
        lambda: rules.rule_results(orders, all_rules).collect(),
        lambda: [(rules.violations(orders, r).count(), orders.where(~blank(text_of(orders, r.column))).count()) for r in all_rules],
    )
    report(
        "types and counts of lineitem, one scan and one shuffle vs one column at a time",
        lambda: (profile.infer_types(items).collect(), profile.profile_counts(items).collect()),
        lambda: [(profile.infer_types(items, [c]).collect(), profile.profile_counts(items, [c]).collect()) for c in items.columns],
    )
    numbered = items.withColumn("_row_id", F.monotonically_increasing_id())
    path = scratch_dir(spark, "numbered")
    numbered.write.parquet(path)
    numbered = spark.read.parquet(path)
    order, deep = grid.Sort("l_extendedprice", "desc"), int(numbered.count() * 0.83)
    last = grid.page_rows(numbered, order, deep - 1, 25).first()
    report(
        f"page of 100 rows at offset {deep}, sorted keys then ids vs offset over whole rows",
        lambda: grid.page_rows(numbered, order, deep, 100).collect(),
        lambda: grid.page_rows(numbered, order, deep, 100, deep_offset=10**9).collect(),
    )
    print("the same page after a known row:", seconds(lambda: grid.next_page(numbered, order, (last.l_extendedprice, last._row_id), 100).collect()), "s")
    csv = scratch_dir(spark, "csv")
    print("CSV export of lineitem:", seconds(lambda: delimited.write_delimited(items, csv, mode="overwrite")), "s")
    print("CSV sniff:", seconds(lambda: delimited.sniff(spark, csv)), "s")
    print("CSV read:", seconds(lambda: delimited.read_delimited(spark, csv).write.format("noop").mode("overwrite").save()), "s")
    book = scratch_dir(spark, "book")
    print("lineitem as one sheet, written by one task:", seconds(lambda: workbooks.write_workbooks(items.coalesce(1), book, mode="overwrite")), "s")
    print("unpacked and parsed:", seconds(lambda: workbooks.workbook_rows(spark, book).write.format("noop").mode("overwrite").save()), "s")
    print("stored as a document:", seconds(lambda: ingest.ingest_workbooks(DocumentStore(spark, scratch_dir(spark, "store")), book)), "s")
    spark.stop()


if __name__ == "__main__":
    main()
