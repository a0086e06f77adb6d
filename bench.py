"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every
query starts from the source tables: derived tables shared by queries are dropped before each one.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tallyframe.plans.queries import QUERIES, forget
from tallyframe.session import configure

HEADLINE = [
    "monthly_series", "month_coverage", "ranked_findings", "components", "source_refs", "evidence_packets", "finding_cards",
    "run_summary", "parse_long", "quality_issues", "validate_answers", "carry_over", "lead_rollup", "dedupe_uploads", "document_labels",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    rows: dict[str, float] = {}
    for name in HEADLINE:
        forget()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    rows["parse_rows_per_sec"] = round(lines / seconds["parse_long"])
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), **rows}))
    spark.stop()


if __name__ == "__main__":
    main()
