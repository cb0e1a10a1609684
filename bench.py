"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores,
``BENCH_RUNS`` the number of timed runs after the warm-up (median reported).
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from sheetloom import get_session
from sheetloom.catalog import QUERIES

HEADLINE = [
    "agg_sumif", "agg_median", "pivot_rows_sum", "pivot_cols_mean", "pivot_rows_median", "vlookup_left", "hlookup",
    "if_number", "concatenate", "rank_desc", "serial_number", "fill_ffill", "fill_median", "fill_mode",
    "remove_duplicates", "missing_report", "anomalies_mad", "quality_report", "keyword_match", "fix_trim_spaces",
    "fix_clean_currency", "fix_date_format", "fix_capitalize_text", "fuzzy_pairs", "fuzzy_groups", "rate_limit_batch",
    "recipe_replay",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    spark = get_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)  # warm-up: code generation, file listing
        seconds[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
