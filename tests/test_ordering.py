"""Chunked ordered operators equal the plain global-window plan, with no
full-table single-partition exchange, for several chunk sizes."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkseries.operators import create_lags, difference, impute_missing, rolling_window
from sparkseries.operators import ordering as O
from sparkseries.operators import timeframes as TF

EVENTS = "/root/testdata/sf0.01/events.parquet"


@pytest.fixture(scope="module")
def gappy(spark):
    e = spark.read.parquet(EVENTS)
    return e.select("ts", "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"),
                    F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("et"),
                    # long null runs that cross chunk boundaries
                    F.when(F.col("event_id") % 1000 < 5, F.col("value")).alias("sparse"))


def same(a, b, key=("ts", "event_id")):
    cols = sorted(a.columns)
    assert sorted(b.columns) == cols
    ra = [tuple(r) for r in a.select(*cols).orderBy(*key).collect()]
    rb = [tuple(r) for r in b.select(*cols).orderBy(*key).collect()]
    assert len(ra) == len(rb)
    for x, y in zip(ra, rb):
        for u, v in zip(x, y):
            if isinstance(u, float) and isinstance(v, float):
                assert abs(u - v) <= 1e-9 * max(1.0, abs(u)), (x, y)
            else:
                assert u == v, (x, y)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def assert_no_full_single_partition(df):
    plan = plan_of(df)
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = "\n".join(lines[i + 1:i + 8])
            # only one-row-per-chunk tables may be gathered
            assert "__ss_chunk" in below and "__ss_rn" not in below, below


SIZES = [300, 1700, 10**9]


@pytest.mark.parametrize("per", SIZES)
def test_rolling_rows(gappy, per):
    base = rolling_window(gappy, ["v", "sparse"], 7, "mean", ts="ts", tie=["event_id"], rows_per_chunk=10**9)
    got = rolling_window(gappy, ["v", "sparse"], 7, "mean", ts="ts", tie=["event_id"], rows_per_chunk=per)
    same(got, base)
    w = Window.orderBy("ts", "event_id").rowsBetween(-6, 0)
    ref = gappy.select("ts", "event_id", F.when(F.count("v").over(w) >= 7, F.avg("v").over(w)).alias("v"))
    same(got.select("ts", "event_id", "v"), ref)
    if per == 300:
        assert_no_full_single_partition(got)


@pytest.mark.parametrize("per", SIZES)
def test_rolling_time(gappy, per):
    got = rolling_window(gappy, ["v"], "20min", "sum", ts="ts", rows_per_chunk=per)
    w = Window.orderBy(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
                       ).rangeBetween(-(20 * 60 * 10**6 - 1), 0)
    ref = gappy.select("ts", F.when(F.count("v").over(w) >= 1, F.sum("v").over(w)).alias("v"))
    same(got, ref, key=("ts",))
    if per == 300:
        assert_no_full_single_partition(got)


@pytest.mark.parametrize("per", SIZES)
def test_shift_ops(gappy, per):
    w = Window.orderBy("ts", "event_id")
    d = difference(gappy.select("ts", "event_id", "v"), ["v"], 3, ts="ts", tie=["event_id"], rows_per_chunk=per)
    same(d, gappy.select("ts", "event_id", (F.col("v") - F.lag("v", 3).over(w)).alias("v")))
    lags = create_lags(gappy.select("ts", "event_id", "v"), ["v"], [2, -4], ts="ts", tie=["event_id"],
                       rows_per_chunk=per)
    same(lags, gappy.select("ts", "event_id", "v", F.lag("v", 2).over(w).alias("v_lag_2"),
                            F.lead("v", 4).over(w).alias("v_lag_-4")))


@pytest.mark.parametrize("per", SIZES)
@pytest.mark.parametrize("method,limit", [("ffill", None), ("ffill", 3), ("bfill", None), ("bfill", 2),
                                          ("interpolate", None), ("interpolate", 3)])
def test_fills(gappy, per, method, limit):
    src = gappy.select("ts", "event_id", "v", "et", "sparse")
    base = impute_missing(src, method, limit, ts="ts", tie=["event_id"], rows_per_chunk=10**9)
    got = impute_missing(src, method, limit, ts="ts", tie=["event_id"], rows_per_chunk=per)
    same(got, base)
    if per == 300 and limit is None:
        assert_no_full_single_partition(got)


def test_fill_reference_window(gappy):
    w = Window.orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    got = impute_missing(gappy.select("ts", "event_id", "sparse"), "ffill", ts="ts", tie=["event_id"],
                         rows_per_chunk=500)
    same(got, gappy.select("ts", "event_id", F.last("sparse", ignorenulls=True).over(w).alias("sparse")))


def test_heavy_timestamp_is_split(spark):
    # one timestamp holds half of all rows: it must not become one chunk
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(seconds=i), i, float(i)) for i in range(3000)]
    rows += [(t0 + timedelta(seconds=1500), 10_000 + i, float(i % 17)) for i in range(3000)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, id bigint, v double")
    c = O.chunk(df, "ts", ["id"], rows_per_chunk=500)
    sizes = [r["count"] for r in c.df.groupBy(O.CHUNK).count().collect()]
    assert max(sizes) <= 1500, sizes
    got = rolling_window(df, ["v"], 5, "sum", ts="ts", tie=["id"], rows_per_chunk=500)
    w = Window.orderBy("ts", "id").rowsBetween(-4, 0)
    ref = df.select("ts", "id", F.when(F.count("v").over(w) >= 5, F.sum("v").over(w)).alias("v"))
    same(got, ref, key=("ts", "id"))


@pytest.mark.parametrize("agg", ["sum", "count", "mean", "std", "min"])
def test_heavy_timestamp_time_frames(spark, agg):
    # one timestamp holds half the rows: frames are computed per distinct
    # timestamp and joined back instead of copying the hot rows around
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(seconds=i), i, float(i % 23) if i % 5 else None) for i in range(2000)]
    rows += [(t0 + timedelta(seconds=700), 10_000 + i, float(i % 13)) for i in range(2000)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, id bigint, v double")
    c = O.chunk(df, "ts", ["id"], rows_per_chunk=400, split_ties=False)
    assert c.heavy
    got = rolling_window(df, ["v"], "90s", agg, ts="ts", tie=["id"], rows_per_chunk=400)
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    w = Window.orderBy(us).rangeBetween(-(90 * 10**6 - 1), 0)
    fn = {"sum": F.sum, "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min}[agg]
    val = fn("v").over(w) if agg == "count" else F.when(F.count("v").over(w) >= 1, fn("v").over(w))
    ref = df.select("ts", "id", val.alias("v"))
    same(got, ref, key=("ts", "id"))


def test_one_chunk_per_task(spark):
    df = spark.read.parquet(EVENTS)
    c = O.chunk(df, "ts", ["event_id"], rows_per_chunk=1000)
    placed, key = c.place(c.df)
    assert key == O.PART
    per_task = placed.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct(O.CHUNK).alias("k")).collect()
    assert len(per_task) == c.n_chunks and all(r["k"] == 1 for r in per_task)


PLAIN = {"sum": F.sum, "count": F.count, "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max}


def plain_frames(df, col, agg, width_us):
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    w = Window.orderBy(us).rangeBetween(-(width_us - 1), 0)
    least = {"count": 0, "std": 2, "var": 2}.get(agg, 1)
    return F.when(F.count(col).over(w) >= least, PLAIN[agg](col).over(w)).alias(col)


@pytest.mark.parametrize("agg", sorted(PLAIN))
@pytest.mark.parametrize("width,per", [("3D", 300), ("7min", 300)])
def test_merged_time_frames(gappy, monkeypatch, agg, width, per):
    monkeypatch.setattr(TF, "NARROW_ROWS", 0)
    got = rolling_window(gappy.select("ts", "event_id", "v"), ["v"], width, agg, ts="ts", tie=["event_id"], rows_per_chunk=per)
    us = {"3D": 3 * 86400, "7min": 7 * 60}[width] * 10**6
    same(got, gappy.select("ts", "event_id", plain_frames(gappy, "v", agg, us)), key=("ts", "event_id"))


@pytest.mark.parametrize("agg", ["sum", "mean", "std", "max"])
def test_merged_frames_forget_what_left(spark, monkeypatch, agg):
    """Huge and infinite values, a step of the level and rows without a time: nothing outside a frame shows in it."""
    monkeypatch.setattr(TF, "NARROW_ROWS", 0)
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(minutes=i), i, 1e6 + i % 10) for i in range(3000)]
    rows[5], rows[40], rows[900] = (*rows[5][:2], 1e17), (*rows[40][:2], float("inf")), (*rows[900][:2], -1e15)
    rows += [(None, 5000 + i, float(i)) for i in range(7)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, id bigint, v double")
    got = rolling_window(df, ["v"], "4h", agg, ts="ts", tie=["id"], rows_per_chunk=100)
    keyed = df.where("ts is not null")
    ref = keyed.select("ts", "id", plain_frames(keyed, "v", agg, 4 * 3600 * 10**6))
    late = "id > 1200"  # frames after the last extreme value agree to the last digits
    same(got.where(f"ts is not null and {late}"), ref.where(late), key=("ts", "id"))
    a, b = ({r["id"]: r["v"] for r in d.collect()} for d in (got.where("ts is not null"), ref))
    assert all(x == b[i] or (x != x and b[i] != b[i]) or abs(x - b[i]) <= 1e-6 * abs(b[i]) for i, x in a.items() if x is not None)
    alone = {r["v"] for r in got.where("ts is null").collect()}
    assert len(alone) == 1 and abs(alone.pop() - {"sum": 21.0, "mean": 3.0, "std": 2.160246899469287, "max": 6.0}[agg]) < 1e-12


def test_time_sums_are_exact_and_typed_alike(spark):
    """Bigint sums beyond 2**53 and 2**63; the type does not depend on a hot timestamp."""
    t0, big = datetime(2024, 1, 1), 9007199254740993
    rows = [(t0 + timedelta(seconds=i), i, big if i % 2 else 2**63 - 1, i % 9) for i in range(600)]
    plain = spark.createDataFrame(rows, "ts timestamp_ntz, id bigint, v bigint, k int").withColumn("d", F.col("k").cast("decimal(9,2)"))
    hot = plain.unionByName(plain.where("id = 7").crossJoin(spark.range(500).select("id").withColumnRenamed("id", "x")).drop("x"))
    a = rolling_window(plain, ["v", "k", "d"], "2s", "sum", ts="ts", rows_per_chunk=100)
    b = rolling_window(hot, ["v", "k", "d"], "2s", "sum", ts="ts", rows_per_chunk=100)
    assert a.schema == b.schema and [f.dataType.simpleString() for f in a.schema] == [
        "timestamp_ntz", "decimal(38,0)", "bigint", "decimal(19,2)"]
    got = [r["v"] for r in a.orderBy("ts").collect()]
    assert got[0] == 2**63 - 1 and set(got[1:]) == {2**63 - 1 + big}
    at_7 = {r["v"] for r in b.where("ts = timestamp_ntz '2024-01-01 00:00:07'").collect()}
    assert at_7 == {2**63 - 1 + 501 * big}
    one = rolling_window(plain, ["v"], "1s", "sum", ts="ts", rows_per_chunk=100)
    assert {int(r["v"]) for r in one.collect()} == {big, 2**63 - 1}
    mean = rolling_window(plain, ["d"], "2s", "mean", ts="ts", rows_per_chunk=100)
    assert mean.schema["d"].dataType.simpleString() == "decimal(13,6)"


def test_binary_search_buckets_match_case_tree(gappy, monkeypatch):
    # many chunks: the JVM binary search path must give the same chunks and results
    tree = O.chunk(gappy, "ts", ["event_id"], rows_per_chunk=100)
    monkeypatch.setattr(O, "CASE_TREE_MAX", 4)
    search = O.chunk(gappy, "ts", ["event_id"], rows_per_chunk=100)
    assert tree.bounds == search.bounds and len(search.bounds) > 4
    a = tree.df.select("event_id", O.CHUNK).orderBy("event_id").collect()
    b = search.df.select("event_id", O.CHUNK).orderBy("event_id").collect()
    assert a == b
    got = rolling_window(gappy.select("ts", "event_id", "v"), ["v"], "30min", "sum", ts="ts", tie=["event_id"],
                         rows_per_chunk=100)
    w = Window.orderBy(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
                       ).rangeBetween(-(30 * 60 * 10**6 - 1), 0)
    same(got, gappy.select("ts", "event_id", F.when(F.count("v").over(w) >= 1, F.sum("v").over(w)).alias("v")))


@pytest.mark.parametrize("window,per", [(50, 40), (600, 1000), (7, 300)])
def test_edge_rows_in_blocks(gappy, monkeypatch, window, per):
    # blocks far smaller than the edge set, frames longer than a chunk
    monkeypatch.setattr(O, "EDGE_BLOCK", 64)
    src = gappy.select("ts", "event_id", "v").where("event_id < 4000")
    got = rolling_window(src, ["v"], window, "count", ts="ts", tie=["event_id"], rows_per_chunk=per)
    w = Window.orderBy("ts", "event_id")
    f = w.rowsBetween(-(window - 1), 0)
    same(got, src.select("ts", "event_id", F.when(F.count(F.lit(1)).over(f) >= window, F.count("v").over(f)).alias("v")))
    assert_no_full_single_partition(got)
    lags = create_lags(src, ["v"], [window, -3], ts="ts", tie=["event_id"], rows_per_chunk=per)
    same(lags, src.select("ts", "event_id", "v", F.lag("v", window).over(w).alias(f"v_lag_{window}"),
                          F.lead("v", 3).over(w).alias("v_lag_-3")))


@pytest.mark.parametrize("tie", [["name"], ["const", "name"], ["const", "name", "id"]])
def test_hot_and_null_times_split_along_any_tie(spark, tie):
    t0 = datetime(2024, 1, 1)
    rows = [(None if i % 3 == 0 else t0 + timedelta(days=i % 2), f"{i * 7919 % 9973:05d}", 1, i, float(i % 17))
            for i in range(6000)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, name string, const int, id bigint, v double")
    c = O.chunk(df, "ts", tie, rows_per_chunk=500)
    sizes = [r["count"] for r in c.df.groupBy(O.CHUNK).count().collect()]
    assert max(sizes) <= 1000 and sum(sizes) == 6000, sizes
    got = difference(df, ["v"], 1, ts="ts", tie=tie, rows_per_chunk=500)
    w = Window.orderBy("ts", "name")
    same(got, df.withColumn("v", F.col("v") - F.lag("v").over(w)), key=("ts", "name"))


def test_many_hot_dates(spark):
    df = spark.range(60_000).select((F.col("id") % 600).alias("d"), "id", F.col("id").cast("double").alias("v"))
    df = df.select(F.timestamp_seconds(F.col("d") * 86400).cast("timestamp_ntz").alias("ts"), "id", "v")
    c = O.chunk(df, "ts", ["id"], rows_per_chunk=50)
    sizes = [r["count"] for r in c.df.groupBy(O.CHUNK).count().collect()]
    assert len(c.heavy) == 600 and max(sizes) <= 100 and sum(sizes) == 60_000


def test_bursts_and_large_keys(spark, monkeypatch):
    # nearly all keys lie in a millionth of the range; keys above 2**53 differ by one
    big = 2**60
    df = spark.range(20_000).select(F.when(F.col("id") < 10, F.lit(-(2**62)) + F.col("id")).otherwise(
        F.lit(big) + F.col("id")).alias("k"), F.when(F.col("id") % 5 == 0, F.col("id").cast("double")).alias("v"))
    for tree in (1024, 4):
        monkeypatch.setattr(O, "CASE_TREE_MAX", tree)
        c = O.chunk(df, "k", rows_per_chunk=500)
        sizes = [r["count"] for r in c.df.groupBy(O.CHUNK).count().collect()]
        assert max(sizes) <= 1100 and len(sizes) >= 20, sizes
        got = impute_missing(df, "ffill", ts="k", rows_per_chunk=500)
        w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        same(got, df.select("k", F.last("v", ignorenulls=True).over(w).alias("v")), key=("k",))
