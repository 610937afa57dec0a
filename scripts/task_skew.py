"""

Runs each operator with Spark's event log written to a fresh scratch folder,
then reports wall time, the number of tasks, and the longest against the
median task of every stage, and whether any exchange in the executed plan is
a ``SinglePartition`` one over row data.

Usage: python scripts/task_skew.py [sf_dir] [copies]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

import bench  # noqa: E402
from sparkseries.operators import impute_missing, resample, rolling_window  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 100
    logdir = tempfile.mkdtemp(prefix="run-evlog-", dir="/tmp")
    spark = (SparkSession.builder.master("local[8]").appName("task-skew")
             .config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", logdir).config("spark.eventLog.compress", "false").config("spark.sql.shuffle.partitions", "64")
             .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    rep = bench.replicated(spark, sf, copies)
    ops = {
        "rolling_rows_mean": lambda: rolling_window(rep, ["value"], 10, "mean", ts="ts", tie=["event_id"]),
        "rolling_time_sum": lambda: rolling_window(rep, ["value"], "5min", "sum", ts="ts"),
        "impute_ffill": lambda: impute_missing(rep.select("ts", "event_id", "value"), "ffill", ts="ts",
                                               tie=["event_id"]),
        "interpolate_time": lambda: impute_missing(rep.select("ts", "event_id", "value"), "interpolate",
                                                   ts="ts", tie=["event_id"]),
        "resample_mean_1min": lambda: resample(rep, "1min", "mean", ts="ts"),
    }
    report = {}
    for name, fn in ops.items():
        spark.sparkContext.setJobGroup(name, name)
        t = time.perf_counter()
        df = fn()
        df.write.format("noop").mode("overwrite").save()
        wall = time.perf_counter() - t
        plan = df._jdf.queryExecution().executedPlan().toString()
        singles = [ln.strip()[:90] for ln in plan.splitlines() if "SinglePartition" in ln]
        report[name] = {"sec": round(wall, 2), "single_partition_exchanges": len(singles)}
    spark.stop()
    # stage -> task durations, grouped by job group
    stages: dict[int, list[int]] = {}
    records: dict[int, list[int]] = {}
    group_of: dict[int, str] = {}
    files = [p for p in glob.glob(os.path.join(logdir, "**", "*"), recursive=True) if os.path.isfile(p)]
    for path in sorted(files):
        with open(path) as fh:
            for line in fh:
                try:
                    ev = json.loads(line)
                except ValueError:
                    continue
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    g = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        group_of[sid] = g
                elif kind == "SparkListenerTaskEnd":
                    info = ev["Task Info"]
                    m = ev.get("Task Metrics") or {}
                    recs = ((m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                            + (m.get("Input Metrics") or {}).get("Records Read", 0))
                    stages.setdefault(ev["Stage ID"], []).append(info["Finish Time"] - info["Launch Time"])
                    records.setdefault(ev["Stage ID"], []).append(recs)
    for sid, times in sorted(stages.items()):
        g = group_of.get(sid)
        if g in report and len(times) > 1:
            worst = report[g].setdefault("worst_stage", {"tasks": 0, "max_ms": 0, "median_ms": 0})
            if max(times) > worst["max_ms"]:
                recs = records.get(sid, [0])
                report[g]["worst_stage"] = {"stage": sid, "tasks": len(times), "max_ms": max(times),
                                            "median_ms": int(statistics.median(times)),
                                            "max_records": max(recs),
                                            "median_records": int(statistics.median(recs))}
    print(json.dumps({"rows": copies * spark_rows(sf), "copies": copies, "ops": report}, indent=1))


def spark_rows(sf: str) -> int:
    import pyarrow.parquet as pq
    return pq.ParquetFile(f"{sf}/events.parquet").metadata.num_rows


if __name__ == "__main__":
    main()
