"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built and fully executed into Spark's ``noop`` sink (no
collect to the driver): one warm-up run, then the median of
$BENCH_REPEAT timed runs.  The time includes the small scalar jobs a query
runs while it is being built (row counts, quantile bounds).  Prints one JSON
line; ``value`` is the sum of the per-query medians.

Set BENCH_QUERIES=key1,key2 to run a subset.  Set BENCH_REPLICATE=100 to
also run the ordered operators on ``events`` replicated that many times with
sf0.1); the copies are derived by Spark from the table, nothing is written.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from sparkseries.operators import impute_missing, resample, rolling_window  # noqa: E402
from sparkseries.plans.queries import QUERIES, events  # noqa: E402
from sparkseries.session import build_session  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    t = time.perf_counter()
    run(fn())
    return time.perf_counter() - t


def replicated(spark, sf: str, copies: int):
    # spread the (small) source first so the copies are generated by every core
    e = events(spark, sf).repartition(spark.sparkContext.defaultParallelism * 2)
    k = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("__copy")
    x = e.select("*", k)
    return x.select(
        (F.col("event_id") + F.col("__copy").cast("bigint") * F.lit(10**9)).alias("event_id"),
        F.timestamp_add("DAY", F.col("__copy") * 30, F.col("ts")).alias("ts"),
        "user_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    wanted = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    copies = int(os.environ.get("BENCH_REPLICATE", "0"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app="sparkseries-bench")
    spark.sparkContext.setLogLevel("ERROR")

    jobs = {k: (lambda q=q: q(spark, sf)) for k, q in QUERIES.items() if not wanted or k in wanted}
    if copies:
        def rep():
            return replicated(spark, sf, copies)
        jobs.update({
            f"x{copies}_rolling_rows_mean": lambda: rolling_window(rep(), ["value"], 10, "mean", ts="ts",
                                                                   tie=["event_id"]),
            f"x{copies}_rolling_time_sum": lambda: rolling_window(rep(), ["value"], "5min", "sum", ts="ts"),
            f"x{copies}_impute_ffill": lambda: impute_missing(rep().select("ts", "event_id", "value"), "ffill",
                                                              ts="ts", tie=["event_id"]),
            f"x{copies}_interpolate_time": lambda: impute_missing(rep().select("ts", "event_id", "value"),
                                                                  "interpolate", ts="ts", tie=["event_id"]),
            f"x{copies}_resample_mean": lambda: resample(rep(), "1min", "mean", ts="ts"),
        })

    results: dict[str, float] = {}
    for key, fn in jobs.items():
        timed(fn)  # warm-up
        results[key] = round(statistics.median(timed(fn) for _ in range(repeat)), 3)
        print(f"# {key}: {results[key]}s", file=sys.stderr, flush=True)

    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
        "cpus": cpus,
        "spark": spark.version,
        "repeat": repeat,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
