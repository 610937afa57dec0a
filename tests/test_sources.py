"""Loader, detection, schema, info, export (reference fixtures L1-L3, X8, X9)."""

import tempfile
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sparkseries.sources import (
    data_info,
    detect_time_column,
    export_parquet,
    export_roundtrip,
    load_days,
    load_series,
    parquet_schema,
)


@pytest.fixture
def readings(tmp_path):
    """One day of readings at ten-minute steps from two meters."""
    n = 144
    at = [datetime(2023, 5, 4) + timedelta(minutes=10 * i) for i in range(n)]
    df = pd.DataFrame({"taken": at, "kwh": [0.25 * (i % 7) for i in range(n)], "meter": ["north", "south"] * (n // 2)})
    p = str(tmp_path / "readings.parquet")
    df.to_parquet(p, engine="pyarrow")
    return p


def test_load_success(spark, readings):
    s = load_series(spark, readings)
    assert s.ts == "taken"
    assert s.df.count() == 144
    assert s.df.columns == ["taken", "kwh", "meter"]


def test_load_missing(spark):
    with pytest.raises(FileNotFoundError):
        load_series(spark, "/nonexistent/file.parquet")


def test_load_empty(spark, tmp_path):
    p = str(tmp_path / "empty.parquet")
    pd.DataFrame({"taken": pd.Series([], dtype="datetime64[us]"), "kwh": pd.Series([], dtype="float64")}).to_parquet(p)
    with pytest.raises(ValueError):
        load_series(spark, p)


def test_load_no_time_column(spark, tmp_path):
    p = str(tmp_path / "untimed.parquet")
    pd.DataFrame({"meter": ["north", "south"], "kwh": [0.5, 0.75]}).to_parquet(p)
    with pytest.raises(ValueError):
        load_series(spark, p)


def test_detect_datetime(spark):
    df = spark.createDataFrame([("north", datetime(2023, 5, 4), 0.5)], "meter string, taken timestamp_ntz, kwh double")
    assert detect_time_column(df) == "taken"


def test_detect_none(spark):
    df = spark.createDataFrame([("north", 0.5), ("south", 0.75)], "meter string, kwh double")
    assert detect_time_column(df) is None


def test_detect_string_first_wins(spark):
    df = spark.createDataFrame([("2024-01-01", 1, None), ("20240102", 2, None)],
                               "d string, v bigint, t timestamp_ntz")
    assert detect_time_column(df) == "d"


def test_string_time_column_parsed(spark, tmp_path):
    p = str(tmp_path / "s.parquet")
    pd.DataFrame({"when": ["2024-01-01 00:00:00", "2024-01-01 01:00:00"], "v": [1.0, float("nan")]}).to_parquet(p)
    s = load_series(spark, p)
    assert s.ts == "when"
    assert dict(s.df.dtypes)["when"] == "timestamp_ntz"
    # NaN became NULL
    assert s.df.filter("v IS NULL").count() == 1


def test_parquet_schema(spark, readings):
    rows = parquet_schema(spark, readings).orderBy("position").collect()
    assert [r["column"] for r in rows] == ["taken", "kwh", "meter"]
    assert rows[0]["type"].startswith("timestamp")
    assert rows[1]["type"] == "double"


def test_data_info(spark, readings):
    s = load_series(spark, readings)
    r = data_info(s.df, s.ts).first()
    assert r["n_rows"] == 144 and r["n_columns"] == 3
    assert r["duration_us"] == 143 * 600_000_000
    assert r["frequency_us"] == 600_000_000  # evenly spaced ten-minute grid


def test_data_info_irregular(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert data_info(df, "ts").first()["frequency_us"] is None


def test_export_roundtrip(spark, readings):
    s = load_series(spark, readings)
    back = export_roundtrip(spark, s.df)
    assert back.ts == "taken"
    assert back.df.exceptAll(s.df).count() == 0 and s.df.exceptAll(back.df).count() == 0


def test_nanosecond_timestamps(spark, tmp_path):
    p = str(tmp_path / "ns.parquet")
    t = pa.table({"ts": pa.array([1_704_067_200_000_001_999, 1_704_067_200_500_000_000], pa.timestamp("ns")),
                  "v": [1.0, 2.0]})
    pq.write_table(t, p)
    s = load_series(spark, p)
    got = [r["ts"] for r in s.df.orderBy("ts").collect()]
    assert got[0] == pd.Timestamp("2024-01-01 00:00:00.000001").to_pydatetime()
    assert got[1] == pd.Timestamp("2024-01-01 00:00:00.5").to_pydatetime()


def test_unparseable_time_value_raises(spark, tmp_path):
    p = str(tmp_path / "bad.parquet")
    values = [f"2024-01-01 {h:02d}:00:00" for h in range(24)] * 5 + ["not a time"]
    pd.DataFrame({"when": values, "v": range(len(values))}).to_parquet(p)
    s = load_series(spark, p)  # the first 100 values parse, so the column is taken
    assert s.ts == "when"
    with pytest.raises(Exception, match="unparseable time value"):
        s.df.collect()


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "bigint", "date"])
def test_data_info_regular_step(spark, kind):
    # 100,000 places: more than three bitmaps; for dates one row a day
    unit = "interval '1' second" if kind.startswith("timestamp") else "interval '1' day"
    at = "id" if kind == "bigint" else f"cast({kind}'2024-01-01' + id * {unit} AS {kind})"
    n = 5_000 if kind == "date" else 100_000
    df = spark.range(n).selectExpr(f"{at} AS t", "id").repartition(7)
    step = {"bigint": 1, "date": 86_400_000_000}.get(kind, 1_000_000)
    r = data_info(df, "t").first()
    assert (r["n_rows"], r["frequency_us"], r["duration_us"]) == (n, step, step * (n - 1))
    first, last = df.selectExpr("min(t)", "max(t)").first()
    assert (r["start_ts"], r["end_ts"]) == (first, last)
    # one time twice and another missing: count and extremes are those of the grid
    twice = df.filter("id <> 7").unionByName(df.filter("id = 8"))
    r = data_info(twice, "t").first()
    assert r["n_rows"] == n and r["frequency_us"] is None
    # one row off the grid
    if kind == "bigint":
        assert data_info(df.selectExpr("CASE WHEN id = 7 THEN 22 ELSE 3 * id END AS t"), "t").first()["frequency_us"] is None


def test_data_info_without_times(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "t timestamp_ntz, v int")
    for d, n in ((df, 2), (df.filter("v < 0"), 0)):
        assert tuple(data_info(d, "t").first()) == (n, 2, None, None, None, None)


def test_export_by_day(spark, tmp_path):
    rows = [(datetime(2024, 1, 1 + (i % 4 if i > 600 else 0)) + timedelta(seconds=i), i) for i in range(1000)]
    # one instant with many rows, and rows without a time
    rows += [(datetime(2024, 1, 2), 2000 + i) for i in range(300)] + [(None, 5000 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v int")
    path = export_parquet(df, str(tmp_path / "days"), partition_by_day="t", rows_per_file=100)
    whole = load_series(spark, path)
    assert whole.ts == "t" and sorted(r["v"] for r in whole.df.collect()) == sorted(v for _, v in rows)
    assert max(r["n"] for r in whole.df.selectExpr("input_file_name() f").groupBy("f").agg({"*": "count"}).toDF("f", "n").collect()) <= 100
    back = load_days(spark, path, "2024-01-02", "2024-01-03 00:00:00", ts="t").df
    assert back.columns == ["t", "v"]
    lo, hi = datetime(2024, 1, 2), datetime(2024, 1, 3)
    assert sorted(r["v"] for r in back.collect()) == sorted(v for t, v in rows if t is not None and lo <= t <= hi)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(t_date" in plan and "GreaterThanOrEqual(t" in plan
    with pytest.raises(ValueError, match="t_date"):
        export_parquet(whole.df, str(tmp_path / "again"), partition_by_day="t")


def test_nanoseconds_in_folders_and_zones(spark, tmp_path):
    ns = [-1, 1_704_067_200_000_001_999]
    for i in range(3):
        t = pa.table({"plain": pa.array(ns, pa.timestamp("ns")), "utc": pa.array(ns, pa.timestamp("ns", tz="UTC")),
                      "n": pa.array([i, 2**60], pa.int64())})
        (tmp_path / "many").mkdir(exist_ok=True)
        pq.write_table(t, str(tmp_path / "many" / f"part {i}.parquet"))
    df = load_series(spark, f"file:{tmp_path}/many").df
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["timestamp_ntz", "timestamp", "bigint"]
    got = df.selectExpr("cast(plain AS string) p", "unix_micros(utc) u", "n").distinct().collect()
    assert {(r["p"], r["u"]) for r in got} == {("1969-12-31 23:59:59.999999", -1), ("2024-01-01 00:00:00.000001", ns[1] // 1000)}
    assert {r["n"] for r in got} == {0, 1, 2, 2**60}
    pq.write_table(pa.table({"plain": pa.array([1], pa.timestamp("us"))}), str(tmp_path / "many" / "x.parquet"))
    with pytest.raises(ValueError, match="differ"):
        load_series(spark, f"file:{tmp_path}/many")
