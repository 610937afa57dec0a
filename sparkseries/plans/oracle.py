"""DuckDB oracle SQL for the registered queries (tables are pre-registered views).

Written independently of the Spark plans: plain SQL windows, ``quantile_cont``,
``corr`` and ``generate_series`` spines.  Doubles are rounded to 6 places as
on the Spark side.
"""

from __future__ import annotations

from sparkseries.plans.queries import FLAG_END, FLAG_START, RANGE_END, RANGE_START

HOUR_US = 3_600_000_000
DAY_US = 86_400_000_000

LINEITEM_NUM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax")
EVENTS_NUM = ("event_id", "user_id", "value")

GAPPY = ("g AS (SELECT ts, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v, "
         "CASE WHEN event_id % 5 <> 0 THEN event_type END AS et FROM events)")
ORD = "ORDER BY ts, event_id"


def _ts_lit(s: str) -> str:
    return f"TIMESTAMP '{s if ' ' in s else s + ' 00:00:00'}'"


def _bucket(step_us: int) -> str:
    """Epoch-aligned bucket start (steps that divide a day)."""
    return f"make_timestamp((epoch_us(ts) // {step_us}) * {step_us})"


def _basic_stats(src: str, cols: tuple[str, ...], from_sql: str) -> str:
    def row(stat: str, fn) -> str:
        cells = ", ".join(f"round(CAST({fn(c)} AS DOUBLE), 6) AS {c}" for c in cols)
        return f"SELECT '{stat}' AS statistic, {cells} FROM {src}"
    stats = [("count", lambda c: f"count({c})"), ("mean", lambda c: f"avg({c})"),
             ("std", lambda c: f"stddev_samp({c})"), ("min", lambda c: f"min({c})"),
             ("q25", lambda c: f"quantile_cont({c}, 0.25)"), ("q50", lambda c: f"quantile_cont({c}, 0.5)"),
             ("q75", lambda c: f"quantile_cont({c}, 0.75)"), ("max", lambda c: f"max({c})")]
    body = " UNION ALL ".join(row(s, f) for s, f in stats)
    return f"{from_sql} {body}" if from_sql else body


def _corr() -> str:
    rows = []
    for a in LINEITEM_NUM:
        cells = ", ".join(f"round(corr({a}, {b}), 6) AS {b}" for b in LINEITEM_NUM)
        rows.append(f"SELECT '{a}' AS \"column\", {cells} FROM lineitem")
    return " UNION ALL ".join(rows)


def _zscore_stats(cols) -> str:
    parts = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in cols)
    return f"s AS (SELECT {parts} FROM events)"


def _zflag(c: str, t: float) -> str:
    return f"coalesce(abs(({c} - m_{c}) / s_{c}) > {t}, false)"


def _iqr_stats(table: str, cols) -> str:
    parts = ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in cols)
    return f"q AS (SELECT {parts} FROM {table})"


def _iqr_cond(c: str, t: float) -> str:
    return f"({c} < a_{c} - {t} * (b_{c} - a_{c}) OR {c} > b_{c} + {t} * (b_{c} - a_{c}))"


def _outlier_stats() -> str:
    rows = [f"SELECT '{c}' AS \"column\", CAST(count_if({_iqr_cond(c, 1.5)}) AS BIGINT) AS count, "
            f"round(CAST(count_if({_iqr_cond(c, 1.5)}) AS DOUBLE) / count({c}) * 100.0, 6) AS percentage "
            f"FROM lineitem, q" for c in LINEITEM_NUM]
    return f"WITH {_iqr_stats('lineitem', LINEITEM_NUM)} " + " UNION ALL ".join(rows)


def _outlier_summary() -> str:
    rows = [f"SELECT '{c}' AS \"column\", CAST(count_if({_zflag(c, 3.0)}) AS BIGINT) AS count, "
            f"round(CAST(count_if({_zflag(c, 3.0)}) AS DOUBLE) / count(*) * 100.0, 6) AS percentage "
            f"FROM events, s" for c in EVENTS_NUM]
    return f"WITH {_zscore_stats(EVENTS_NUM)} " + " UNION ALL ".join(rows)


def _histogram(c: str, bins: int) -> str:
    def edge(i: str) -> str:
        return f"(CASE WHEN {i} >= {bins} THEN hi ELSE CAST({i} AS DOUBLE) * ((hi - lo) / {bins}) + lo END)"
    return f"""(WITH r AS (SELECT CAST(min({c}) AS DOUBLE) AS lo0, CAST(max({c}) AS DOUBLE) AS hi0 FROM events),
rr AS (SELECT CASE WHEN lo0 IS NULL THEN 0.0 WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
              CASE WHEN lo0 IS NULL THEN 1.0 WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM r),
x AS (SELECT CAST({c} AS DOUBLE) AS x, lo, hi FROM events, rr WHERE {c} IS NOT NULL),
g0 AS (SELECT x, lo, hi, least(CAST(trunc((x - lo) / (hi - lo) * {float(bins)}) AS BIGINT), {bins - 1}) AS g FROM x),
g1 AS (SELECT x, lo, hi, CASE WHEN x < {edge('g')} THEN g - 1 ELSE g END AS g FROM g0),
g2 AS (SELECT CASE WHEN x >= {edge('g + 1')} AND g <> {bins - 1} THEN g + 1 ELSE g END AS bin FROM g1),
cnt AS (SELECT bin, count(*) AS n FROM g2 GROUP BY bin),
b AS (SELECT unnest(range({bins})) AS bin)
SELECT '{c}' AS "column", CAST(b.bin AS INTEGER) AS bin,
       round(({edge('b.bin')} + {edge('b.bin + 1')}) / 2, 6) AS bin_center,
       coalesce(cnt.n, 0) AS count
FROM b CROSS JOIN rr LEFT JOIN cnt ON cnt.bin = b.bin)"""


def _distributions() -> str:
    return " UNION ALL ".join(f"SELECT * FROM {_histogram(c, 50)}" for c in ("value", "user_id", "event_id"))


def _time_bucket_stats() -> str:
    step = 6 * HOUR_US
    aggs = ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, count({c}) AS {c}_count"
                     for c in EVENTS_NUM)
    outs = ", ".join(f"round(a.{c}_mean, 6) AS {c}_mean, round(a.{c}_std, 6) AS {c}_std, "
                     f"coalesce(a.{c}_count, 0) AS {c}_count" for c in EVENTS_NUM)
    return (f"WITH a AS (SELECT epoch_us(ts) // {step} AS k, {aggs} FROM events GROUP BY 1), "
            "r AS (SELECT min(k) AS k0, max(k) AS k1 FROM a), "
            "sp AS (SELECT unnest(generate_series(k0, k1)) AS k FROM r) "
            f"SELECT make_timestamp(sp.k * {step}) AS ts, {outs} FROM sp LEFT JOIN a ON a.k = sp.k")


def _interpolate(limit: int | None, by_time: bool) -> str:
    order = ORD if by_time else "ORDER BY event_id"
    pos = "CAST(epoch_us(ts) AS DOUBLE)" if by_time else "CAST(i AS DOUBLE)"
    keep = "ts, event_id, et" if by_time else "event_id"
    formula = ("CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0 "
               "ELSE v0 + (v1 - v0) * ((pos - p0) / (p1 - p0)) END")
    if limit is not None:
        formula = f"CASE WHEN v IS NULL AND i - i0 > {limit} THEN NULL ELSE {formula} END"
    return f"""WITH {GAPPY},
s AS (SELECT *, row_number() OVER ({order}) - 1 AS i FROM g),
t AS (SELECT *, {pos} AS pos FROM s),
p AS (SELECT *,
  last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER wp AS p0,
  last_value(v IGNORE NULLS) OVER wp AS v0,
  last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER wp AS i0,
  first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER wn AS p1,
  first_value(v IGNORE NULLS) OVER wn AS v1
  FROM t
  WINDOW wp AS ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         wn AS ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT {keep}, round({formula}, 6) AS v FROM p"""


def _fill(method: str, limit: int | None) -> str:
    if method == "ffill":
        frame = f"{limit} PRECEDING" if limit else "UNBOUNDED PRECEDING"
        w = f"({ORD} ROWS BETWEEN {frame} AND CURRENT ROW)"
        fn = "last_value"
    else:
        frame = f"{limit} FOLLOWING" if limit else "UNBOUNDED FOLLOWING"
        w = f"({ORD} ROWS BETWEEN CURRENT ROW AND {frame})"
        fn = "first_value"
    return (f"WITH {GAPPY} SELECT ts, event_id, round({fn}(v IGNORE NULLS) OVER {w}, 6) AS v, "
            f"{fn}(et IGNORE NULLS) OVER {w} AS et FROM g")


def _rows_window(col: str, n: int, expr: str, src: str, min_expr: str | None = None) -> str:
    need = min_expr or f"count({col}) OVER w >= {n}"
    return (f"SELECT ts, event_id, round(CASE WHEN {need} THEN {expr} END, 6) AS {col} FROM {src} "
            f"WINDOW w AS ({ORD} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")


def _time_window(fn: str, width_us: int) -> str:
    return (f"WITH {GAPPY} SELECT ts, round(CASE WHEN count(v) OVER w >= 1 THEN {fn}(v) OVER w END, 6) AS v "
            f"FROM g WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL '{width_us - 1} microseconds' "
            "PRECEDING AND CURRENT ROW)")


def _flagship() -> str:
    src = (f"WITH g AS (SELECT ts, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events "
           f"WHERE ts BETWEEN {_ts_lit(FLAG_START)} AND {_ts_lit(FLAG_END)}), "
           f"f AS (SELECT ts, last_value(v IGNORE NULLS) OVER ({ORD} ROWS BETWEEN UNBOUNDED PRECEDING "
           "AND CURRENT ROW) AS v FROM g), "
           f"r AS (SELECT epoch_us(ts) // {HOUR_US} AS k, avg(v) AS v FROM f GROUP BY 1), "
           "rr AS (SELECT v FROM r WHERE v IS NOT NULL)")
    return _basic_stats("rr", ("v",), src)


SQL: dict[str, str] = {
    "load_series": "SELECT * FROM events",
    "filter_time_range": f"SELECT * FROM events WHERE ts BETWEEN {_ts_lit(RANGE_START)} AND {_ts_lit(RANGE_END)}",
    "detect_time_column": (
        "SELECT table_name, column_name AS time_column FROM ("
        "SELECT table_name, column_name, row_number() OVER (PARTITION BY table_name ORDER BY ordinal_position) AS rn "
        "FROM information_schema.columns WHERE table_name IN ('events', 'lineitem', 'orders') "
        "AND (data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE')) WHERE rn = 1"),
    "parquet_schema": (
        "SELECT CAST(ordinal_position AS INTEGER) AS position, column_name AS \"column\", "
        "CASE data_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'DOUBLE' THEN 'double' "
        "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp[us]' ELSE lower(data_type) END AS type "
        "FROM information_schema.columns WHERE table_name = 'events'"),
    "data_info": (
        "WITH b AS (SELECT count(*) AS n, count(DISTINCT ts) AS nd, min(ts) AS t0, max(ts) AS t1, "
        "min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events), "
        "s AS (SELECT *, CASE WHEN n > 1 AND hi > lo AND (hi - lo) % (n - 1) = 0 THEN (hi - lo) // (n - 1) END "
        "AS step FROM b), "
        "o AS (SELECT count(*) AS k FROM events, s WHERE s.step IS NOT NULL AND (epoch_us(ts) - s.lo) % s.step <> 0) "
        "SELECT n AS n_rows, (SELECT count(*) FROM information_schema.columns WHERE table_name = 'events') "
        "AS n_columns, t0 AS start_ts, t1 AS end_ts, hi - lo AS duration_us, "
        "CASE WHEN step IS NOT NULL AND nd = n AND (SELECT k FROM o) = 0 THEN step END AS frequency_us FROM s"),
    "export_roundtrip": "SELECT * FROM events",
    "export_partitioned": (
        f"SELECT * REPLACE (round(value, 6) AS value) FROM events WHERE ts BETWEEN {_ts_lit(RANGE_START)} AND {_ts_lit(RANGE_END)}"),
    "data_info_regular": (
        "WITH g AS (SELECT TIMESTAMP '2024-01-01' + to_seconds(event_id) AS ts FROM events) SELECT count(*) AS n_rows, "
        "2::BIGINT AS n_columns, min(ts) AS start_ts, max(ts) AS end_ts, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us, "
        "CASE WHEN count(DISTINCT ts) = count(*) AND epoch_us(max(ts)) - epoch_us(min(ts)) = (count(*) - 1) * 1000000 "
        "THEN 1000000::BIGINT END AS frequency_us FROM g"),
    "tail_rows": "SELECT ts, event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000",
    "resample_mean": (
        f"SELECT {_bucket(HOUR_US)} AS ts, round(avg(event_id), 6) AS event_id, "
        "round(avg(user_id), 6) AS user_id, round(avg(value), 6) AS value FROM events GROUP BY 1"),
    "resample_sum_gapfill": (
        f"WITH o AS (SELECT (min(epoch_us(ts)) // {DAY_US}) * {DAY_US} AS origin FROM events), "
        "a AS (SELECT (epoch_us(e.ts) - o.origin) // 420000000 AS k, sum(e.value) AS s FROM events e, o GROUP BY 1), "
        "r AS (SELECT min(k) AS k0, max(k) AS k1 FROM a), "
        "sp AS (SELECT unnest(generate_series(k0, k1)) AS k FROM r) "
        "SELECT make_timestamp(o.origin + sp.k * 420000000) AS ts, round(coalesce(a.s, 0), 6) AS value "
        "FROM sp CROSS JOIN o LEFT JOIN a ON a.k = sp.k"),
    "resample_multi": (
        f"SELECT * FROM (SELECT {_bucket(HOUR_US)} AS ts, round(avg(value), 6) AS value_mean, "
        "round(stddev_samp(value), 6) AS value_std, round(max(value), 6) AS value_max, "
        "count(DISTINCT user_id) AS user_id FROM events GROUP BY 1) "
        "WHERE value_mean IS NOT NULL AND value_std IS NOT NULL AND value_max IS NOT NULL AND user_id IS NOT NULL"),
    "resample_median_first": (
        f"SELECT {_bucket(6 * HOUR_US)} AS ts, round(quantile_cont(value, 0.5), 6) AS value_median, "
        "round(first(value ORDER BY ts, event_id), 6) AS value_first, "
        "round(last(value ORDER BY ts, event_id), 6) AS value_last, count(value) AS value_count "
        "FROM events GROUP BY 1"),
    "resample_expr": (
        f"SELECT {_bucket(HOUR_US)} AS ts, round(max(value) - min(value), 6) AS value FROM events GROUP BY 1"),
    "time_bucket_stats": _time_bucket_stats(),
    "basic_stats": _basic_stats("lineitem", LINEITEM_NUM, ""),
    "two_valued_quantiles": _basic_stats("(SELECT CAST(event_id % 2 AS DOUBLE) AS v FROM events)", ["v"], ""),
    "column_info": (
        "SELECT CAST(ordinal_position AS INTEGER) AS position, column_name AS \"column\", "
        "CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
        "ELSE lower(data_type) END AS dtype FROM information_schema.columns WHERE table_name = 'events'"),
    "correlation_matrix": _corr(),
    "outlier_flags_zscore": (
        f"WITH {_zscore_stats(EVENTS_NUM)} SELECT ts, "
        + ", ".join(f"{_zflag(c, 3.0)} AS {c}" for c in EVENTS_NUM) + " FROM events, s"),
    "outlier_flags_iqr": (
        f"WITH {_iqr_stats('events', EVENTS_NUM)} SELECT ts, "
        + ", ".join(f"coalesce({_iqr_cond(c, 1.5)}, false) AS {c}" for c in EVENTS_NUM) + " FROM events, q"),
    "outlier_stats": _outlier_stats(),
    "outlier_summary": _outlier_summary(),
    "distributions": _distributions(),
    "custom_aggregate": (
        "SELECT o_orderpriority, round(avg(o_totalprice), 6) AS o_totalprice, "
        "CAST(sum(o_custkey) AS BIGINT) AS o_custkey FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1"),
    "custom_aggregate_multi": (
        "SELECT o_orderstatus, round(avg(o_totalprice), 6) AS o_totalprice_mean, "
        "round(stddev_samp(o_totalprice), 6) AS o_totalprice_std, round(min(o_totalprice), 6) AS o_totalprice_min, "
        "round(max(o_totalprice), 6) AS o_totalprice_max, "
        "round(quantile_cont(o_totalprice, 0.5), 6) AS o_totalprice_median, "
        "count(o_totalprice) AS o_totalprice_count, "
        "round(first(o_totalprice ORDER BY o_orderdate, o_orderkey), 6) AS o_totalprice_first, "
        "round(last(o_totalprice ORDER BY o_orderdate, o_orderkey), 6) AS o_totalprice_last, "
        "count(DISTINCT o_custkey) AS o_custkey FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1"),
    "custom_aggregate_expr": (
        "SELECT event_type, round(max(value) - min(value), 6) AS value FROM events "
        "WHERE event_type IS NOT NULL GROUP BY 1"),
    "custom_aggregate_merged": (
        "WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST) AS k FROM events) "
        "SELECT event_type, round(avg(value) FILTER (WHERE k <= 10), 6) AS value_top10, count(value) AS value_count FROM r "
        "WHERE event_type IS NOT NULL GROUP BY 1"),
    "resample_merged": (
        f"WITH b AS (SELECT {_bucket(6 * HOUR_US)} AS t, value FROM events WHERE value IS NOT NULL), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY value DESC) AS k FROM b) "
        "SELECT t AS ts, round(avg(value), 6) AS value FROM r WHERE k <= 5 GROUP BY 1"),
    "rolling_rows_blocks": f"WITH {GAPPY} " + _rows_window("v", 4, "max(v) OVER w - min(v) OVER w", "g"),
    "rolling_rows_mean": _rows_window("value", 10, "avg(value) OVER w", "events"),
    "rolling_rows_std": f"WITH {GAPPY} " + _rows_window("v", 10, "stddev_samp(v) OVER w", "g"),
    "rolling_rows_count": (
        f"WITH {GAPPY} SELECT ts, event_id, "
        "CAST(CASE WHEN count(*) OVER w >= 5 THEN count(v) OVER w END AS DOUBLE) AS v "
        f"FROM g WINDOW w AS ({ORD} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"),
    "rolling_rows_udf": _rows_window("value", 10, "max(value) OVER w - min(value) OVER w", "events"),
    "rolling_time_sum": _time_window("sum", 300_000_000),
    "rolling_time_mean_1h": _time_window("avg", HOUR_US),
    "rolling_time_wide_sum": _time_window("sum", 3 * 24 * HOUR_US),
    "rolling_time_wide_std": _time_window("stddev_samp", 3 * 24 * HOUR_US),
    "rolling_time_wide_max": _time_window("max", 3 * 24 * HOUR_US),
    "bigint_sums": (
        "WITH e AS (SELECT ts, event_type, 9000000000000000000 - user_id AS v FROM events), "
        "f AS (SELECT ts, sum(v) OVER (ORDER BY ts RANGE BETWEEN INTERVAL '86399999999 microseconds' PRECEDING AND CURRENT ROW) "
        "AS v FROM e) SELECT event_type, CAST(sum(v) AS VARCHAR) AS v FROM e WHERE event_type IS NOT NULL GROUP BY event_type "
        "UNION ALL SELECT strftime(ts, '%Y-%m-%d') AS event_type, CAST(max(v) AS VARCHAR) AS v FROM f GROUP BY 1"),
    "difference": (
        f"SELECT event_id, ts, user_id, event_type, round(value - lag(value) OVER ({ORD}), 6) AS value, props "
        "FROM events"),
    "lag_features": (
        "SELECT ts, event_id, user_id, round(value, 6) AS value, "
        f"round(lag(value, 1) OVER ({ORD}), 6) AS value_lag_1, round(lag(value, 3) OVER ({ORD}), 6) AS value_lag_3, "
        f"round(lead(value, 2) OVER ({ORD}), 6) AS \"value_lag_-2\", "
        f"CAST(lag(user_id, 1) OVER ({ORD}) AS DOUBLE) AS user_id_lag_1, "
        f"CAST(lag(user_id, 3) OVER ({ORD}) AS DOUBLE) AS user_id_lag_3, "
        f"CAST(lead(user_id, 2) OVER ({ORD}) AS DOUBLE) AS \"user_id_lag_-2\" "
        "FROM events"),
    "impute_ffill": _fill("ffill", None),
    "impute_ffill_limit": _fill("ffill", 2),
    "impute_bfill": _fill("bfill", None),
    "impute_bfill_limit": _fill("bfill", 1),
    "interpolate_time": _interpolate(None, True),
    "interpolate_time_limit": _interpolate(2, True),
    "interpolate_linear": _interpolate(None, False),
    "filter_impute_resample_stats": _flagship(),
}
