"""Streaming resample equals batch resample on the same files."""

from pyspark.sql import functions as F

from conftest import close
from sparkseries.operators import resample
from sparkseries.streaming import resample_stream, start_resample_stream


def test_stream_matches_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "in")
    # two files arriving one after the other
    src.filter(F.col("ts") < "2024-01-15").coalesce(1).write.parquet(folder + "/a")
    src.filter(F.col("ts") >= "2024-01-15").coalesce(1).write.parquet(folder + "/b")
    stream = resample_stream(spark, folder + "/*", src.schema, "6H", ["mean", "count"], ts="ts",
                             columns=["value"], watermark="0 seconds", max_files_per_trigger=1)
    q = (stream.writeStream.format("memory").queryName("buckets").outputMode("complete").start())
    q.processAllAvailable()
    q.stop()
    got = {r["ts"]: (r["value_mean"], r["value_count"]) for r in spark.table("buckets").collect()}
    want = {r["ts"]: (r["value_mean"], r["value_count"])
            for r in resample(src, "6H", ["mean", "count"], ts="ts", columns=["value"]).collect()}
    assert set(got) == set(want)
    assert all(close(got[k][0], want[k][0]) and got[k][1] == want[k][1] for k in want)


def test_stream_append_sink(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "in2")
    src.coalesce(1).write.parquet(folder)
    stream = resample_stream(spark, folder, src.schema, "1D", "sum", ts="ts", columns=["value"],
                             watermark="1 hour")
    out = str(tmp_path / "out")
    q = start_resample_stream(stream, out, checkpoint=str(tmp_path / "ckpt"), available_now=True)
    q.awaitTermination(120)
    written = spark.read.parquet(out)
    # all days but the last are finished (the watermark has passed them)
    assert written.count() == 29
