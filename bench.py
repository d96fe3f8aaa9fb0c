"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from logloom.functions import shell
from logloom.session import session
from logloom.plans import queries

HEADLINES = (
    "d5_unverified_fix", "d1_test_modified", "d2b_revert_pairs", "d2c_git_reverts", "d4_never_read", "d6_error_suppressed", "d7_stale_context", "d8_destructive",
    "session_meta", "main_path", "merge_timeline", "redact_email", "redact_assignment", "redact_counts", "content_hash", "shared_lines", "dedupe_keep_best",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    found, all_queries = {}, queries.queries()
    # The JVM and the Python workers are warm.
    spark.read.parquet(f"{sf_dir}/events.parquet").select(shell.writes_of(F.lit("ls").alias("x"))).write.format("noop").mode("overwrite").save()
    for name in HEADLINES:
        began = time.perf_counter()
        all_queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        found[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
