"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from spanloom.session import session

QUERIES = ("union_islands", "union_seconds", "daily_occupancy", "overlap_pairs", "overlap_pairs_global", "complement_gaps", "availability_candidates", "shared_windows", "common_free", "recur_daily", "recur_weekly", "override_resolve", "freebusy_lines")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="bench-")
    conf = {"spark__sql__shuffle__partitions": cpus, "spark__driver__memory": "8g", "spark__ui__enabled": "false", "spark__ui__showConsoleProgress": "false", "spark__sql__warehouse__dir": f"{scratch}/warehouse", "spark__checkpoint__dir": f"file://{scratch}/checkpoints"}
    spark = session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    from spanloom.plans.queries import QUERIES as REGISTERED

    REGISTERED["union_seconds"](spark, sf_dir).collect()  # starts the JVM's compilers
    times = {}
    for name in QUERIES:
        began = time.perf_counter()
        REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "calendar queries, whole result, one run each after warm-up", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
