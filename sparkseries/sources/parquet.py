"""Parquet sources and sinks (S1-S5).

``load_series`` reads a Parquet path, finds the time axis (first column in
schema order that is a timestamp, or a string whose first 100 values parse),
parses it if it is a string, and turns float NaN into NULL.  Nothing is read
beyond the footers except two bounded probes (``limit``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from sparkseries.functions.columns import epoch_us, from_epoch_us, nan_to_null
from sparkseries.session import scratch_path

# Formats tried, in order, when a string column is probed for
# dates (after Spark's own ISO-8601 parsing).
DATE_FORMATS = ("yyyyMMdd", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy", "MM/dd/yyyy HH:mm",
                "MM/dd/yyyy HH:mm:ss", "dd.MM.yyyy", "yyyy-MM-dd HH:mm:ss.SSSSSS")
PROBE_ROWS = 100

NANOS_CONF = "spark.sql.legacy.parquet.nanosAsLong"


@dataclass
class Series:
    """A loaded frame and the name of its time column."""

    df: DataFrame
    ts: str


def parse_time(c: Column) -> Column:
    """String -> timestamp_ntz using ISO-8601 or one of ``DATE_FORMATS``; NULL if none fits."""
    tries = [F.try_to_timestamp(c)] + [F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def detect_time_column(df: DataFrame) -> str | None:
    """First column that is a timestamp/date, or a string whose first 100 values parse."""
    strings: list[str] = []
    found = None
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            found = f.name
            break
        if isinstance(f.dataType, T.StringType):
            strings.append(f.name)
    if strings:
        # one bounded job probes every string column that precedes the first timestamp
        probe = df.select(*strings).limit(PROBE_ROWS)
        aggs = []
        for i, s in enumerate(strings):
            ok = F.col(s).isNull() | parse_time(F.col(s)).isNotNull()
            aggs += [F.bool_and(ok).alias(f"ok{i}"), F.count(s).alias(f"n{i}")]
        row = probe.agg(*aggs).first()
        for i, s in enumerate(strings):
            if row[f"n{i}"] and row[f"ok{i}"]:
                return s
    return found


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        df = spark.read.parquet(path)
        df.schema  # noqa: B018 - forces footer inference now
        if spark.conf.get(NANOS_CONF, "false") == "true":
            return _read_nanos(spark, path)
        return df
    except AnalysisException as e:
        msg = str(e)
        if "PATH_NOT_FOUND" in msg or "Path does not exist" in msg:
            raise FileNotFoundError(f"no such Parquet path: {path}") from e
        if "NANOS" in msg:
            return _read_nanos(spark, path)
        raise
    except Exception as e:  # py4j errors from schema conversion
        if "NANOS" in str(e):
            return _read_nanos(spark, path)
        raise


def _nanos_columns(df: DataFrame) -> dict[str, T.DataType]:
    """Nanosecond columns and their timestamp types, from one footer read through Spark's own file system."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return {}
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0]))
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        found = {}
        for field in reader.getFooter().getFileMetaData().getSchema().getFields():
            kind = str(field.getLogicalTypeAnnotation()) if field.isPrimitive() else ""
            if kind.startswith("TIMESTAMP(NANOS"):
                found[field.getName()] = T.TimestampType() if kind.endswith("true)") else T.TimestampNTZType()
        return found
    finally:
        reader.close()


def _read_nanos(spark: SparkSession, path: str) -> DataFrame:
    """Nanosecond timestamps: read as epoch-ns longs and truncate to µs.

    Spark refuses ``TIMESTAMP(NANOS)`` unless the session reads them as longs;
    that flag is session-wide and stays set for this session, since readers need it when the plan runs.
    The footers of all files are compared (in tasks): a column that is nanoseconds in one file and
    microseconds in another raises, as its longs could not be told apart.  Instants (UTC-adjusted) stay instants.
    """
    spark.conf.set(NANOS_CONF, "true")
    try:
        df = spark.read.option("mergeSchema", "true").parquet(path)
    except Exception as e:
        if "MERGE" in str(e):
            raise ValueError(f"{path}: files differ in the type of a column: {e}") from e
        raise
    ns = _nanos_columns(df)
    # floor, so that times before 1970 are cut towards the past like later ones
    return df.select(*[
        from_epoch_us(F.expr(f"(`{c}` - pmod(`{c}`, 1000)) div 1000"), ns[c]).alias(c)
        if c in ns else F.col(c) for c in df.columns])


def load_series(spark: SparkSession, path: str, *, time_column: str | None = None) -> Series:
    """Read ``path`` and return the frame with its time axis (S1).

    Raises ``FileNotFoundError`` for a missing path, ``ValueError`` for an
    empty table or one without a time column.  A string time column is parsed;
    a value that does not parse raises when the data is read.
    """
    df = _read(spark, path)
    if df.isEmpty():
        raise ValueError(f"{path} holds no rows")
    ts = time_column or detect_time_column(df)
    if ts is None:
        raise ValueError(f"{path}: neither a timestamp column nor a string column that reads as time")
    if isinstance(df.schema[ts].dataType, T.StringType):
        parsed = parse_time(F.col(ts))
        checked = F.when(F.col(ts).isNotNull() & parsed.isNull(),
                         F.raise_error(F.concat(F.lit("unparseable time value: "), F.col(ts)))
                         .cast("timestamp_ntz")).otherwise(parsed)
        df = df.withColumn(ts, checked)
    elif isinstance(df.schema[ts].dataType, T.DateType):
        df = df.withColumn(ts, F.col(ts).cast("timestamp_ntz"))
    return Series(nan_to_null(df), ts)


# Spark type -> the Arrow type name the Parquet footer reports.
ARROW_NAMES = {
    "bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8",
    "double": "double", "float": "float", "string": "string", "boolean": "bool",
    "timestamp_ntz": "timestamp[us]", "timestamp": "timestamp[us, tz=UTC]", "date": "date32[day]",
    "binary": "binary",
}


def arrow_type_name(dt: T.DataType) -> str:
    s = dt.simpleString()
    if isinstance(dt, T.DecimalType):
        return f"decimal128({dt.precision}, {dt.scale})"
    return ARROW_NAMES.get(s, s)


def parquet_schema(spark: SparkSession, path: str) -> DataFrame:
    """``position, column, type`` from the footer, without reading data (S3)."""
    schema = _read(spark, path).schema
    rows = [(i + 1, f.name, arrow_type_name(f.dataType)) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(rows, "position int, column string, type string")


def data_info(df: DataFrame, ts: str) -> DataFrame:
    """One row: ``n_rows, n_columns, start_ts, end_ts, duration_us, frequency_us`` (S4).

    ``frequency_us`` is the common step when the timestamps are exactly an
    evenly spaced grid (every gap equal), else NULL.  Only where count and extremes allow a grid is the time column read
    again: its places on the grid are marked in bitmaps of 32,768 places, filled in every task before they
    are shuffled (one bit per row instead of one row per time).
    """
    us = epoch_us(df, ts)
    r = df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    freq = None
    n, lo, hi = r["n_rows"], r["lo"], r["hi"]
    if n and n > 1 and lo is not None and hi > lo and (hi - lo) % (n - 1) == 0:
        step = (hi - lo) // (n - 1)
        at = df.select((us - F.lit(lo)).alias("d")).select("d", F.expr(f"d div {step}L + 1").alias("place"))
        maps = at.groupBy(F.bitmap_bucket_number("place")).agg(
            F.count_if(F.col("d") % F.lit(step) != 0).alias("off"),
            F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("place"))).alias("nd"))
        chk = maps.agg(F.sum("off").alias("off"), F.sum("nd").alias("nd")).first()
        if chk["off"] == 0 and chk["nd"] == n:
            freq = step

    def time(value) -> Column:
        kind = df.schema[ts].dataType
        if isinstance(kind, T.IntegralType):
            return F.lit(value).cast(kind)
        if isinstance(kind, T.DateType):
            return F.timestamp_micros(F.lit(value).cast("bigint")).cast("date")
        return from_epoch_us(F.lit(value).cast("bigint"), kind)

    duration = None if lo is None else hi - lo
    return df.sparkSession.range(1).select(
        F.lit(n).cast("bigint").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        time(lo).alias("start_ts"), time(hi).alias("end_ts"), F.lit(duration).cast("bigint").alias("duration_us"),
        F.lit(freq).cast("bigint").alias("frequency_us"))


def column_info(df: DataFrame) -> DataFrame:
    """``position, column, dtype`` of a frame (the reference's ``dtypes``)."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def export_parquet(df: DataFrame, path: str, *, partition_by_day: str | None = None,
                   rows_per_file: int = 5_000_000) -> str:
    """Write (overwrite) as Parquet; the time axis stays an ordinary column (S5).

    ``partition_by_day=ts`` adds a ``{ts}_date`` partition column.  Rows are laid out by ranges of (day, time, row
    hash) and sorted, so a task writes few days, a day with very many rows -- also rows without a
    time, or of one instant -- is shared by several tasks, and row groups hold narrow time ranges.  Files
    hold at most ``rows_per_file`` rows.  :func:`load_days` prunes folders and row groups.
    """
    w = df
    if partition_by_day:
        ts, day = partition_by_day, f"{partition_by_day}_date"
        if day in df.columns:
            raise ValueError(f"the frame already has a column {day!r}")
        w = df.withColumn(day, F.to_date(F.col(ts)))
        w = w.repartitionByRange(F.col(day), F.col(ts), F.xxhash64(*[F.col(c) for c in df.columns]))
        w = w.sortWithinPartitions(day, ts)
        w.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(day).parquet(path)
    else:
        w.write.mode("overwrite").parquet(path)
    return path


def load_days(spark: SparkSession, path: str, start, end, *, ts: str) -> Series:
    """Rows with ``start <= ts <= end`` of an export partitioned by day, without its day column.

    The days become partition filters (other folders are not listed in the scan), the times pushed filters.
    """
    from sparkseries.operators.select import filter_time_range, time_literal

    day = f"{ts}_date"
    df = nan_to_null(_read(spark, path))
    kind = df.schema[ts].dataType
    days = F.col(day).between(F.to_date(time_literal(start, kind)), F.to_date(time_literal(end, kind)))
    return Series(filter_time_range(df.filter(days), start, end, ts=ts).drop(day), ts)


def export_roundtrip(spark: SparkSession, df: DataFrame, path: str | None = None) -> Series:
    """Write to ``path`` (default: a new place in the shared scratch folder) and load it back."""
    path = path or scratch_path(spark, "export")
    export_parquet(df, path)
    return load_series(spark, path)
