"""Times the headline searches on $BENCH_SF_DIR with $BENCH_CPUS threads; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from nearfield.plans import queries as core

NAMES = ["topk_exact", "topk_raw_query", "topk_similar", "topk_subset", "topk_unnormalized_rows", "lsh_signature", "topk_ann_bucket_only", "topk_ann_fallback", "cascade_f16_f8_f32"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    every = core.queries()
    taken = {}
    for name in NAMES:
        best = None
        for _ in range(3):  # the plan is built anew each time; the first run warms up
            began = time.perf_counter()
            every[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - began)
        taken[name] = round(best, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
