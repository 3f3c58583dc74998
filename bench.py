"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "score_signals", "verdict_category_cube", "rule_triggers_top", "confusion_matrix", "fp_leave_one_out", "downweight_simulation", "label_discrimination", "rule_contains_any", "rule_regex_any",
    "ioc_text", "url_features", "html_features", "filename_features", "sender_history", "trust_tier", "notify_dedupe", "rate_limit_windows", "fingerprint", "scope_any_first_item", "intel_max_floor", "mail_indicators", "mail_verdicts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("mailglass-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from mailglass.plans import catalog

    found = catalog.queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            found[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
