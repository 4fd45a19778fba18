"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import contextlib
import io
import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "summarize_lineitem", "tabstat_lineitem", "detail_lineitem", "describe_lineitem", "codebook_numeric", "crosstab_flag_status",
    "frequency_priority", "bysort_quartiles", "collapse_orders", "anova_priority", "kruskal_wallis_priority", "correlation_pairs",
    "regress_coefficients", "regress_by_returnflag", "regress_heteroskedasticity", "regress_reset", "information_criteria",
    "error_metrics", "direction_accuracy", "xtreg_comparison", "xtreg_first_difference", "hausman_test", "areg_one_way",
    "areg_two_way", "iv_coefficients", "histogram_price", "box_stats", "qq_observed", "quantiles_by_selection", "row_index_entities",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from catalog import all_entries

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    only = set(sys.argv[1:])
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries = {e.name: e for e in all_entries()}
    times: dict[str, float] = {}
    scans: dict[str, int] = {}  # table scans in the plan of the result; jobs that a query runs when called come on top
    exchanges: dict[str, int] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        runs = []
        for _ in range(repeats + 1):  # the first run warms up
            start = time.perf_counter()
            entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        plan = io.StringIO()
        with contextlib.redirect_stdout(plan):
            entries[name].run(spark, sf_dir).explain()
        scans[name] = len(re.findall(r"FileScan|Scan ExistingRDD", plan.getvalue()))
        exchanges[name] = len(re.findall(r"- Exchange", plan.getvalue()))
        times[name] = round(sorted(runs[1:])[len(runs[1:]) // 2] if repeats else runs[0], 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": total, "unit": "sec", "queries": times, "scans": scans, "exchanges": exchanges, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
