"""The same results as the registered queries, in SQL for an independent engine.

Every statement is written from the meaning of the operator over whole tables,
with plain windows and recursion, and not from the way Spark computes it.
"""

from __future__ import annotations

USER = "u AS (SELECT CAST(user_id AS VARCHAR) AS series_id, ts, event_id AS seq, value FROM events)"
W = "PARTITION BY series_id ORDER BY ts, seq"
PLACED = f"""{USER}, p AS (
  SELECT *, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM u)"""
HOURLY = """h AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, 0 AS seq, avg(value) AS value
  FROM events GROUP BY 1, 2)"""
HOURLY_PLACED = f"""{HOURLY}, p AS (
  SELECT *, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM h)"""
CUT = "CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)"
CEIL = "CAST(ceil(n * CAST(0.8 AS DOUBLE)) AS BIGINT)"
START = "CASE WHEN L < 60 THEN greatest(n + L - 60, 0) ELSE L - 60 END"
PARTS = f"""c AS (SELECT *, {CEIL} AS L FROM p), s AS (SELECT *, {START} AS test_start FROM c)"""
GAPPY = """g AS (SELECT event_id, ts, user_id, event_type,
  CASE WHEN event_id % 7 <> 0 THEN value END AS value,
  CASE WHEN event_id % 11 <> 0 THEN props END AS props FROM events)"""


def r(expr: str, digits: int = 6) -> str:
    """Rounded as the queries do: a nudge decides values that lie between two roundings."""
    nudge = 0.37 * 10.0 ** -(digits + 2)
    return f"(round(({expr}) + {nudge!r}, {digits}) + 0.0)"


def two(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(18,2)) AS VARCHAR)"


def history(length: int = 12, column: str = "value") -> str:
    """The values before a row as text, oldest first."""
    return f"string_agg({two(column)}, ',') OVER ({W} ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING)"


def errors(digits: int, *names: str) -> str:
    pieces = {
        "n_rows": "count(*) FILTER (actual IS NOT NULL AND predicted IS NOT NULL) AS n_rows",
        "mse": f"{r('avg(pow(predicted - actual, 2))', digits)} AS mse",
        "rmse": f"{r('sqrt(avg(pow(predicted - actual, 2)))', digits)} AS rmse",
        "mae": f"{r('avg(abs(predicted - actual))', digits)} AS mae",
        "mape": f"{r('avg(abs(predicted - actual) / greatest(abs(actual), 2.220446049250313e-16::DOUBLE))', digits)} AS mape",
        "mape_pct": f"{r('avg(abs((predicted - actual) / nullif(actual, 0))) * 100', digits)} AS mape_pct",
        "n_zero": "count(*) FILTER (actual = 0 AND predicted IS NOT NULL) AS n_zero",
    }
    return ", ".join(pieces[n] for n in (names or pieces))


def _profile() -> str:
    kinds = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
             "value": "double", "props": "string"}
    rows = [
        f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column_name, '{k}' AS data_type, "
        f"count({c}) AS n_non_null, count(*) AS n_rows FROM g"
        for i, (c, k) in enumerate(kinds.items())
    ]
    return f"WITH {GAPPY} " + " UNION ALL ".join(rows)


def _nulls() -> str:
    names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    return f"WITH {GAPPY} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null FROM g" for c in names
    )


TEXT_DATES = """t AS (SELECT event_id, ts, CASE event_id % 19
  WHEN 0 THEN strftime(ts, '%b-%y') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%d-%m-%Y')
  WHEN 3 THEN strftime(ts, '%-m/%-d/%Y') WHEN 4 THEN strftime(ts, '%Y/%m/%d') WHEN 5 THEN strftime(ts, '%B %-d, %Y')
  WHEN 6 THEN strftime(ts, '%d-%b-%Y') WHEN 7 THEN strftime(ts, '%b %-d, %Y') WHEN 8 THEN strftime(ts, '%Y-%m')
  WHEN 9 THEN strftime(ts, '%m/%Y') WHEN 10 THEN strftime(ts, '%B %Y') WHEN 11 THEN strftime(ts, '%Y-%m-%d %H:%M')
  WHEN 12 THEN strftime(ts, '%d-%m-%Y %H:%M:%S') WHEN 13 THEN strftime(ts, '%m/%d/%Y %I:%M %p')
  WHEN 14 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 15 THEN strftime(ts, '%A, %B %-d, %Y')
  WHEN 16 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') WHEN 17 THEN 'not a date' END AS text FROM events)"""

TEXT_NUMBERS = """b AS (SELECT event_id, value, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS v FROM events),
t AS (SELECT event_id, value, v, CASE event_id % 10
  WHEN 0 THEN '$' || v WHEN 1 THEN '1,' || lpad(v, 6, '0') WHEN 2 THEN v || '%' WHEN 3 THEN '-' || v WHEN 4 THEN 'N/A'
  WHEN 5 THEN v WHEN 6 THEN v || 'e-05' WHEN 7 THEN '1.2.3' WHEN 8 THEN '.' END AS text FROM b)"""

ACF = f"""{PLACED}, t AS (SELECT *, {CUT} AS m FROM p), d AS (
  SELECT series_id, pos, m, value - avg(value) OVER (PARTITION BY series_id) AS u FROM t WHERE pos < m),
k AS (SELECT range AS lag FROM range(0, 21)),
c AS (SELECT a.series_id, k.lag, a.m, sum(a.u * b.u) AS p FROM d a, k, d b
  WHERE b.series_id = a.series_id AND b.pos = a.pos - k.lag GROUP BY 1, 2, 3),
z AS (SELECT c.series_id, c.lag, c.m, c.p / c0.p AS acf FROM c JOIN c c0 ON c0.series_id = c.series_id AND c0.lag = 0)"""

AR1 = f"""{PLACED}, l AS (SELECT *, {CUT} AS m, lag(value) OVER ({W}) AS y1 FROM p),
t AS (SELECT * FROM l WHERE pos >= 1 AND pos < m),
f AS (SELECT series_id, count(*) AS n_rows, regr_slope(value, y1) AS phi, regr_intercept(value, y1) AS c,
  regr_syy(value, y1) - pow(regr_sxy(value, y1), 2) / regr_sxx(value, y1) AS sse FROM t GROUP BY 1)"""


def aic(sse: str, rows: str, k: int) -> str:
    return f"{rows} * ln({sse} / {rows}) + {rows} * (1 + ln(2 * pi())) + {2 * k}"


BEST = f"""{PLACED}, l AS (SELECT *, {CUT} AS m, lag(value) OVER ({W}) AS y1, lag(value, 2) OVER ({W}) AS y2 FROM p),
t AS (SELECT series_id, value AS y, y1, value - y1 AS z, y1 - y2 AS z1 FROM l WHERE pos >= 2 AND pos < m),
f AS (SELECT series_id, count(*) AS n, regr_syy(y, y1) AS s000,
  regr_syy(y, y1) - pow(regr_sxy(y, y1), 2) / regr_sxx(y, y1) AS s100,
  sum(z * z) AS s010, sum(z * z) - pow(sum(z * z1), 2) / sum(z1 * z1) AS s110 FROM t GROUP BY 1),
o AS (
  SELECT series_id, 0 AS p, 0 AS d, {aic('s000', 'n', 2)} AS aic FROM f UNION ALL
  SELECT series_id, 0, 1, {aic('s010', 'n', 1)} FROM f UNION ALL
  SELECT series_id, 1, 0, {aic('s100', 'n', 3)} FROM f UNION ALL
  SELECT series_id, 1, 1, {aic('s110', 'n', 2)} FROM f)
SELECT series_id, CAST(p AS BIGINT) AS p, CAST(d AS BIGINT) AS d, CAST(0 AS BIGINT) AS q, {r('aic', 5)} AS aic
FROM o QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY aic, p, d) = 1"""

SCALED = f"""{PLACED}, {PARTS}, b AS (
  SELECT *, min(CASE WHEN pos < L THEN value END) OVER (PARTITION BY series_id) AS lo,
  max(CASE WHEN pos < L THEN value END) OVER (PARTITION BY series_id) AS hi FROM s)"""

LINEAR = f"""WITH RECURSIVE {SCALED}, sc AS (
  SELECT *, (value - lo) / (hi - lo) * 2 - 1 AS y FROM b),
lg AS (SELECT *, lag(y) OVER ({W}) AS y1 FROM sc),
f AS (SELECT series_id, regr_slope(y, y1) AS slope, regr_intercept(y, y1) AS c
  FROM lg WHERE pos >= 1 AND pos <= L - 2 GROUP BY 1),
seed AS (SELECT series_id, ts AS last_ts, y1 AS x, lo, hi FROM lg
  WHERE pos = n - 2),
walk AS (
  SELECT f.series_id, 1 AS step, c + slope * x AS y FROM f JOIN seed USING (series_id)
  UNION ALL
  SELECT w.series_id, w.step + 1, f.c + f.slope * w.y FROM walk w JOIN f ON f.series_id = w.series_id WHERE w.step < 10)
SELECT w.series_id, CAST(w.step AS BIGINT) AS step, last_ts + to_days(CAST(w.step AS INTEGER)) AS date,
  {r('lo + (w.y + 1) / 2 * (hi - lo)')} AS predicted, CAST(NULL AS VARCHAR) AS reason
FROM walk w JOIN seed USING (series_id)"""

FEATURES = f"""lag(value) OVER ({W}) AS lag1, lag(value, 2) OVER ({W}) AS lag2,
  CASE WHEN count(value) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
  THEN avg(value) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS rm"""

BASELINES = """l AS (SELECT *, CASE WHEN pos < {cut} THEN 'train' ELSE 'test' END AS split,
  lag(value) OVER ({w}) AS prev, avg(CASE WHEN pos < {cut} THEN value END) OVER (PARTITION BY series_id) AS mean FROM p),
e AS (SELECT series_id, split, 'persistence' AS model, value AS actual, prev AS predicted FROM l
  UNION ALL SELECT series_id, split, 'train_mean', value, mean FROM l)""".format(cut=CUT, w=W)

PANEL_UNION = f"""WITH {USER}, {HOURLY}, x AS (
  SELECT 'user/' || series_id AS series_id, ts, seq, value FROM u
  UNION ALL SELECT 'type/' || series_id, ts, seq, value FROM h
  UNION ALL SELECT 'day/orders', date_trunc('day', o_orderdate), 0, sum(o_totalprice) FROM orders GROUP BY 2
  UNION ALL SELECT 'month/orders', date_trunc('month', o_orderdate), 0, sum(o_totalprice) FROM orders GROUP BY 2),
p AS (SELECT *, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM x),
e AS (SELECT series_id, CASE WHEN pos < {CUT} THEN 'train' ELSE 'test' END AS split, value AS actual,
  lag(value) OVER ({W}) AS predicted FROM p)
SELECT series_id, split, {errors(3, 'n_rows', 'rmse', 'mae')} FROM e GROUP BY 1, 2"""

SEQUENCE_1 = f"""{SCALED}, sc AS (SELECT *, (value - lo) / (hi - lo) * 2 - 1 AS y FROM b),
lg AS (SELECT *, lag(y) OVER ({W}) AS y1 FROM sc),
f AS (SELECT regr_slope(y, y1) AS slope, regr_intercept(y, y1) AS c FROM lg WHERE pos BETWEEN 1 AND L - 2),
e AS (
  SELECT series_id, 'train' AS split, ts, pos, value AS actual, lo + (c + slope * y1 + 1) / 2 * (hi - lo) AS predicted
  FROM lg, f WHERE pos BETWEEN 1 AND L - 2
  UNION ALL
  SELECT series_id, 'test', ts, pos, value, lo + (c + slope * y1 + 1) / 2 * (hi - lo)
  FROM lg, f WHERE pos BETWEEN test_start + 1 AND n - 2)"""

SAVED_1 = f"""WITH RECURSIVE {SEQUENCE_1},
seed AS (SELECT series_id, ts AS last_ts, y1 AS x, lo, hi FROM lg WHERE pos = n - 2),
walk AS (
  SELECT series_id, 1 AS step, c + slope * x AS y FROM seed, f
  UNION ALL
  SELECT w.series_id, w.step + 1, f.c + f.slope * w.y FROM walk w, f WHERE w.step < 10)
SELECT w.series_id, CAST(w.step AS BIGINT) AS step, last_ts + to_days(CAST(w.step AS INTEGER)) AS date,
  {r('lo + (w.y + 1) / 2 * (hi - lo)', 4)} AS predicted, CAST(NULL AS VARCHAR) AS reason
FROM walk w JOIN seed USING (series_id)"""

def long_acf(lags: int) -> str:
    """Autocorrelation of all events as one series, by a self-join on positions."""
    return f"""WITH d AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS i,
    value - avg(value) OVER () AS u, count(*) OVER () AS m FROM events),
  k AS (SELECT range AS lag FROM range(0, {lags + 1})),
  c AS (SELECT k.lag, a.m, sum(a.u * b.u) AS p FROM k, d a, d b WHERE b.i = a.i - k.lag GROUP BY 1, 2),
  z AS (SELECT c.lag, c.m, c.p / c0.p AS acf FROM c, c c0 WHERE c0.lag = 0)
  SELECT 'all' AS series_id, CAST(lag AS BIGINT) AS lag, {r('acf')} AS acf, CASE WHEN lag = 0 THEN 0 ELSE
  {r('''1.959963984540054 * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN acf * acf END) OVER (
    ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / m)''')} END AS band FROM z"""


PER_HOUR_ACF = f"""WITH {HOURLY_PLACED}, d AS (
  SELECT series_id, pos, count(*) OVER (PARTITION BY series_id) AS m, value - avg(value) OVER (PARTITION BY series_id) AS u FROM p),
k AS (SELECT range AS lag FROM range(0, 241)),
c AS (SELECT a.series_id, k.lag, a.m, sum(a.u * b.u) AS p FROM d a, k, d b
  WHERE b.series_id = a.series_id AND b.pos = a.pos - k.lag GROUP BY 1, 2, 3),
z AS (SELECT c.series_id, c.lag, c.m, c.p / c0.p AS acf FROM c JOIN c c0 ON c0.series_id = c.series_id AND c0.lag = 0)
SELECT series_id, CAST(lag AS BIGINT) AS lag, {r('acf')} AS acf, CASE WHEN lag = 0 THEN 0 ELSE
  {r('''1.959963984540054 * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN acf * acf END) OVER (PARTITION BY series_id
    ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / m)''')} END AS band FROM z"""

PACF = f"""WITH RECURSIVE {HOURLY_PLACED}, t AS (SELECT *, {CUT} AS m FROM p), d AS (
  SELECT series_id, pos, m, value - avg(value) OVER (PARTITION BY series_id) AS u FROM t WHERE pos < m),
k AS (SELECT range AS lag FROM range(0, 21)),
c AS (SELECT a.series_id, k.lag, a.m, sum(a.u * b.u) AS p FROM d a, k, d b
  WHERE b.series_id = a.series_id AND b.pos = a.pos - k.lag GROUP BY 1, 2, 3),
rr AS (SELECT series_id, m, list(p ORDER BY lag) AS p FROM c GROUP BY 1, 2),
q AS (SELECT series_id, m, list_transform(p, lambda x: x / p[1]) AS r FROM rr),
dl AS (
  SELECT series_id, m, r, 1 AS lag, r[2] AS pacf, [r[2]] AS phi FROM q
  UNION ALL
  SELECT series_id, m, r, lag + 1, a, list_append(list_transform(range(1, lag + 1), lambda i: phi[i] - a * phi[lag + 1 - i]), a)
  FROM (SELECT *, (r[lag + 2] - list_sum(list_transform(range(1, lag + 1), lambda i: phi[i] * r[lag + 2 - i])))
    / (1 - list_sum(list_transform(range(1, lag + 1), lambda i: phi[i] * r[i + 1]))) AS a FROM dl WHERE lag < 20))
SELECT series_id, CAST(0 AS BIGINT) AS lag, 1.0::DOUBLE AS pacf, 0.0::DOUBLE AS band FROM q
UNION ALL SELECT series_id, lag, {r('pacf')}, {r('1.959963984540054 / sqrt(m)')} FROM dl"""

ARIMA_AR = f"""WITH RECURSIVE best AS (WITH {BEST}), {PLACED},
l AS (SELECT p.*, {CUT.replace('n *', 'p.n *')} AS m, lag(value) OVER (PARTITION BY p.series_id ORDER BY ts, seq) AS y1,
  lag(value, 2) OVER (PARTITION BY p.series_id ORDER BY ts, seq) AS y2, best.p AS bp, best.d AS bd
  FROM p JOIN best USING (series_id)),
f AS (SELECT series_id, bp, bd,
  CASE WHEN bd = 1 THEN 0 WHEN bp = 1 THEN regr_intercept(value, y1) ELSE avg(value) END AS c,
  CASE WHEN bp = 0 THEN 0 WHEN bd = 0 THEN regr_slope(value, y1)
    ELSE sum((value - y1) * (y1 - y2)) / sum(CASE WHEN y2 IS NOT NULL THEN (y1 - y2) * (y1 - y2) END) END AS phi
  FROM l WHERE pos < m GROUP BY 1, 2, 3),
walk AS (
  SELECT f.series_id, 1 AS step, l.n - l.m AS h, bd2.y AS y, bd2.y - l.value AS z
  FROM f JOIN l ON l.series_id = f.series_id AND l.pos = l.m - 1,
    LATERAL (SELECT CASE WHEN f.bd = 0 THEN f.c + f.phi * l.value ELSE l.value + f.phi * (l.value - l.y1) END AS y) bd2
  UNION ALL
  SELECT w.series_id, w.step + 1, w.h, CASE WHEN f.bd = 0 THEN f.c + f.phi * w.y ELSE w.y + f.phi * w.z END,
    f.phi * w.z FROM walk w JOIN f ON f.series_id = w.series_id WHERE w.step < w.h),
e AS (
  SELECT l.series_id, 'train' AS split, value AS actual, CASE WHEN pos < l.bp + l.bd THEN NULL
    WHEN l.bd = 0 THEN c + phi * CASE WHEN l.bp = 1 THEN y1 ELSE 0 END
    WHEN l.bp = 0 THEN y1 ELSE y1 + phi * (y1 - y2) END AS predicted
  FROM l JOIN f USING (series_id) WHERE pos < m
  UNION ALL
  SELECT l.series_id, 'test', value, w.y FROM l JOIN walk w ON w.series_id = l.series_id AND w.step = l.pos - l.m + 1)
SELECT series_id, split, {errors(4, 'n_rows', 'mse', 'rmse', 'mae')} FROM e GROUP BY 1, 2"""

MESSY = f"""WITH {TEXT_DATES.replace('t AS (', 'td AS (', 1)}, {TEXT_NUMBERS.replace('t AS (SELECT event_id, value, v', 'tn AS (SELECT event_id, value, v', 1)},
v AS (SELECT CAST(e.user_id AS VARCHAR) AS series_id, e.event_id AS seq,
  CASE WHEN e.event_id % 19 = 17 THEN NULL ELSE e.ts END AS ts,
  CASE e.event_id % 10 WHEN 1 THEN CAST('1' || lpad(tn.v, 6, '0') AS DOUBLE) WHEN 3 THEN -tn.value
    WHEN 6 THEN CAST(tn.v || 'e-05' AS DOUBLE) WHEN 4 THEN NULL WHEN 7 THEN NULL WHEN 8 THEN NULL ELSE tn.value END AS value
  FROM events e JOIN td USING (event_id) JOIN tn USING (event_id)
  WHERE td.text IS NOT NULL AND tn.text IS NOT NULL),
f AS (SELECT *, lag(value) OVER w AS lag1, lag(value, 2) OVER w AS lag2 FROM v
  WINDOW w AS (PARTITION BY series_id ORDER BY seq)),
k AS (SELECT * FROM f WHERE ts IS NOT NULL AND value IS NOT NULL AND lag1 IS NOT NULL AND lag2 IS NOT NULL),
q AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY seq) - 1 AS pos,
  count(*) OVER (PARTITION BY series_id) AS n FROM k),
e AS (SELECT series_id, CASE WHEN pos < {CUT} THEN 'train' ELSE 'test' END AS split, value AS actual, lag1 AS predicted FROM q)
SELECT series_id, split, {errors(4, 'n_rows', 'rmse', 'mae')} FROM e GROUP BY 1, 2"""

ORACLES: dict[str, str] = {
    "table_profile": _profile(),
    "null_counts": _nulls(),
    "clean_numeric": f"""WITH {TEXT_NUMBERS} SELECT event_id, text,
      {r('''CASE event_id % 10 WHEN 1 THEN CAST('1' || lpad(v, 6, '0') AS DOUBLE)
        WHEN 6 THEN CAST(v || '05' AS DOUBLE) WHEN 4 THEN NULL WHEN 7 THEN NULL WHEN 8 THEN NULL WHEN 9 THEN NULL
        ELSE value END''')} AS digits_only,
      round(CASE event_id % 10 WHEN 1 THEN CAST('1' || lpad(v, 6, '0') AS DOUBLE) WHEN 3 THEN -value
        WHEN 6 THEN CAST(v || 'e-05' AS DOUBLE) WHEN 4 THEN NULL WHEN 7 THEN NULL WHEN 8 THEN NULL WHEN 9 THEN NULL
        ELSE value END, 8) AS signed FROM t""",
    "parse_dates_first_match": f"""WITH {TEXT_DATES} SELECT event_id, text, CASE
      WHEN event_id % 19 = 6 THEN CAST(make_date(2020, CAST(month(ts) AS INTEGER), 1) AS TIMESTAMP)
      WHEN event_id % 19 IN (0, 8, 9, 10) THEN CAST(date_trunc('month', ts) AS TIMESTAMP)
      WHEN event_id % 19 = 16 THEN CASE WHEN month(ts) = 5 THEN CAST(date_trunc('month', ts) AS TIMESTAMP) END
      WHEN event_id % 19 < 16 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) END AS parsed FROM t""",
    "unread_dates": f"""WITH {TEXT_DATES}, s AS (
        SELECT text, regexp_replace(regexp_replace(text, '[0-9]+', '9', 'g'), '[A-Za-z]+', 'a', 'g') AS shape
        FROM t WHERE event_id % 19 = 17 OR (event_id % 19 = 16 AND month(ts) <> 5))
      SELECT shape, count(*) AS n, min(text) AS example FROM s GROUP BY 1""",
    "parse_dates_most_specific": f"""WITH {TEXT_DATES} SELECT event_id, text, try_strptime(text, [
      '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M', '%d-%m-%Y %H:%M:%S', '%m/%d/%Y %I:%M %p', '%a, %d %b %Y %H:%M:%S GMT',
      '%A, %B %d, %Y', '%Y-%m-%d', '%d-%m-%Y', '%m/%d/%Y', '%Y/%m/%d', '%B %d, %Y', '%b %d, %Y', '%d-%b-%Y',
      '%B %Y', '%b-%y', '%Y-%m', '%m/%Y']) AS parsed FROM t""",
    "parse_iso": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) END AS parsed FROM events",
    "concat_day_hour": """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts) END AS timestamp
      FROM events""",
    "dropna_then_project": f"WITH {GAPPY} SELECT ts, value FROM g WHERE value IS NOT NULL AND props IS NOT NULL",
    "preview_head_tail": f"""WITH {PLACED}
      SELECT series_id, 'head' AS part, CAST(pos AS BIGINT) AS place, ts, value FROM p WHERE pos < 5
      UNION ALL SELECT series_id, 'tail', CAST(n - 1 - pos AS BIGINT), ts, value FROM p WHERE pos >= n - 5""",
    "first_rows": f"WITH {PLACED} SELECT series_id, CAST(pos AS BIGINT) AS place, ts, value FROM p WHERE pos < 13",
    "calendar_features": """SELECT event_id AS seq, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week,
      day(ts) AS day_of_month, month(ts) AS month FROM events""",
    "cyclical_features": f"""SELECT event_id AS seq, {r('value')} AS value, year(ts) AS year, month(ts) AS month,
      day(ts) AS day, hour(ts) AS hour, isodow(ts) - 1 AS weekday,
      {r('sin(2 * pi() * hour(ts) / 24)')} AS hour_sin, {r('cos(2 * pi() * hour(ts) / 24)')} AS hour_cos,
      {r('sin(2 * pi() * (isodow(ts) - 1) / 7)')} AS weekday_sin,
      {r('cos(2 * pi() * (isodow(ts) - 1) / 7)')} AS weekday_cos FROM events""",
    "lag_rolling_features": f"""WITH {PLACED}, f AS (SELECT *, {FEATURES} FROM p)
      SELECT series_id, seq, CAST(pos AS BIGINT) AS pos, {r('value')} AS value, {r('lag1')} AS lag1, {r('lag2')} AS lag2,
      {r('rm')} AS rolling_mean_3 FROM f""",
    "leak_safe_features": f"""WITH {PLACED} SELECT series_id, seq, {r(f'lag(value) OVER ({W})')} AS lag1,
      {r(f'lag(value, 2) OVER ({W})')} AS lag2, CASE WHEN pos >= 3 THEN
      {r(f'avg(value) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} END AS rolling_mean_3 FROM p""",
    "warmup_drop": f"""WITH {USER}, f AS (SELECT *, {FEATURES} FROM u),
      k AS (SELECT * FROM f WHERE lag1 IS NOT NULL AND lag2 IS NOT NULL AND rm IS NOT NULL)
      SELECT series_id, seq, CAST(row_number() OVER ({W}) - 1 AS BIGINT) AS pos,
      count(*) OVER (PARTITION BY series_id) AS n, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week,
      day(ts) AS day_of_month, month(ts) AS month, {r('lag1')} AS lag1, {r('lag2')} AS lag2,
      {r('rm')} AS rolling_mean_3, {r('value')} AS value FROM k""",
    "split_floor": f"""WITH {PLACED} SELECT series_id, seq, CAST(pos AS BIGINT) AS pos,
      CASE WHEN pos < {CUT} THEN 'train' ELSE 'test' END AS split FROM p""",
    "split_ceil_overlap": f"""WITH {PLACED}, {PARTS} SELECT series_id, seq, L AS train_rows, CAST(test_start AS BIGINT) AS test_start,
      CAST(pos < L AS BIGINT) AS in_train, CAST(pos >= test_start AS BIGINT) AS in_test FROM s""",
    "split_ceil_overlap_hourly": f"""WITH {HOURLY_PLACED}, {PARTS} SELECT series_id, ts, L AS train_rows,
      CAST(test_start AS BIGINT) AS test_start, CAST(pos < L AS BIGINT) AS in_train,
      CAST(pos >= test_start AS BIGINT) AS in_test FROM s""",
    "split_counts": f"""WITH {PLACED}, {PARTS}
      SELECT series_id, 'train' AS split, count(*) AS n_rows FROM s WHERE pos < L GROUP BY 1
      UNION ALL SELECT series_id, 'test', count(*) FROM s WHERE pos >= test_start GROUP BY 1""",
    "minmax_fit_apply": f"""WITH {SCALED} SELECT series_id, seq, {r('lo')} AS lo, {r('hi')} AS hi,
      {r('(value - lo) / (hi - lo) * 2 - 1')} AS scaled FROM b""",
    "minmax_inverse": f"""WITH {SCALED} SELECT series_id, seq, {r('(value - lo) / (hi - lo)', 4)} AS scaled,
      {r('value')} AS restored, CAST(CAST(CAST(value AS FLOAT) AS DECIMAL(18,2)) AS DOUBLE) AS as_float32 FROM b""",
    "sliding_windows": f"""WITH {PLACED}, x AS (SELECT *, {history()} AS x FROM p)
      SELECT series_id, CAST(pos AS BIGINT) AS pos, x, value AS y, ts AS y_ts FROM x WHERE pos BETWEEN 12 AND n - 2""",
    "split_sliding_windows": f"""WITH {PLACED}, {PARTS}, x AS (SELECT *, {history()} AS x FROM s)
      SELECT series_id, 'train' AS split, CAST(pos AS BIGINT) AS pos, x, value AS y, ts AS y_ts
      FROM x WHERE pos BETWEEN 12 AND L - 2
      UNION ALL SELECT series_id, 'test', CAST(pos AS BIGINT), x, value, ts FROM x
      WHERE pos BETWEEN test_start + 12 AND n - 2""",
    "last_window": f"""WITH {PLACED}, {PARTS}, x AS (SELECT *, {history()} AS x FROM s)
      SELECT series_id, x, value AS y, ts AS y_ts, CAST(NULL AS VARCHAR) AS reason FROM x WHERE pos = n - 2""",
    "slide_append": f"""WITH {PLACED}, x AS (SELECT *,
      string_agg({two('value')}, ',') OVER ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS x FROM p)
      SELECT series_id, CAST(pos AS BIGINT) AS pos, x FROM x WHERE pos BETWEEN 12 AND n - 2""",
    "window_null_gate": f"""WITH {PLACED}, g AS (SELECT series_id, ts, seq, pos, n,
      CASE WHEN seq % 97 <> 0 THEN value END AS v FROM p),
      x AS (SELECT *, 12 - count(v) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS n_null FROM g)
      SELECT series_id, CAST(pos AS BIGINT) AS pos, n_null FROM x
      WHERE pos BETWEEN 12 AND n - 2 AND (n_null > 0 OR v IS NULL)""",
    "hour_profile_sum": f"""WITH {USER}, a AS (SELECT series_id, hour(ts) AS hour, sum(value) AS value FROM u GROUP BY 1, 2)
      SELECT series_id, hour, {r('value', 4)} AS value,
      row_number() OVER (PARTITION BY series_id ORDER BY round(value, 9) DESC, hour) AS rank FROM a""",
    "hour_profile_mean": f"""WITH a AS (SELECT hour(ts) AS hour, avg(value) AS value FROM events GROUP BY 1)
      SELECT 'all' AS series_id, hour, {r('value', 4)} AS value, row_number() OVER (ORDER BY value DESC, hour) AS rank FROM a""",
    "differenced": f"""WITH {USER} SELECT series_id, seq, {r(f'value - lag(value) OVER ({W})')} AS diff1,
      {r(f'value - 2 * lag(value) OVER ({W}) + lag(value, 2) OVER ({W})')} AS diff2 FROM u""",
    "acf_20": f"""WITH {ACF} SELECT series_id, CAST(lag AS BIGINT) AS lag, {r('acf')} AS acf, CASE WHEN lag = 0 THEN 0 ELSE
      {r('''1.959963984540054 * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN acf * acf END) OVER (PARTITION BY series_id
        ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / m)''')} END AS band FROM z""",
    "pacf_2": f"""WITH {ACF}, q AS (SELECT series_id, m, max(CASE WHEN lag = 1 THEN acf END) AS r1,
      max(CASE WHEN lag = 2 THEN acf END) AS r2 FROM z GROUP BY 1, 2)
      SELECT series_id, CAST(0 AS BIGINT) AS lag, 1.0::DOUBLE AS pacf, 0.0::DOUBLE AS band FROM q
      UNION ALL SELECT series_id, 1, {r('r1')}, {r('1.959963984540054 / sqrt(m)')} FROM q
      UNION ALL SELECT series_id, 2, {r('(r2 - r1 * r1) / (1 - r1 * r1)')}, {r('1.959963984540054 / sqrt(m)')} FROM q""",
    "adf_lag0": f"""WITH {PLACED}, l AS (SELECT *, {CUT} AS m, lag(value) OVER ({W}) AS y1 FROM p),
      t AS (SELECT series_id, value - y1 AS dy, y1 FROM l WHERE pos >= 1 AND pos < m),
      f AS (SELECT series_id, count(*) AS n, regr_slope(dy, y1) AS b, regr_sxx(dy, y1) AS sxx,
        regr_syy(dy, y1) - pow(regr_sxy(dy, y1), 2) / regr_sxx(dy, y1) AS sse FROM t GROUP BY 1)
      SELECT series_id, {r('b / sqrt(sse / (n - 2) / sxx)')} AS statistic, n AS n_rows FROM f""",
    "line_extract": """SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, max(value) AS y
      FROM events GROUP BY 1, 2""",
    "line_buckets": f"""WITH {USER} SELECT series_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, {r('min(value)')} AS y_min,
      {r('avg(value)')} AS y_avg, {r('max(value)')} AS y_max FROM u GROUP BY 1, 2""",
    "ar1_fit_aic": f"""WITH {AR1} SELECT series_id, n_rows, {r('c', 5)} AS intercept, {r('phi', 5)} AS phi1,
      {r('sse', 5)} AS sse, {r(aic('sse', 'n_rows', 3), 5)} AS aic FROM f""",
    "ar1_in_sample": f"""WITH {AR1} SELECT l.series_id, CAST(pos AS BIGINT) AS pos, {r('value')} AS value,
      {r('c + phi * y1')} AS predicted FROM l JOIN f USING (series_id) WHERE pos < m""",
    "ar1_forecast": f"""WITH RECURSIVE {AR1}, w AS (
      SELECT f.series_id, 1 AS step, c + phi * value AS y, n - m AS h FROM f JOIN l USING (series_id) WHERE pos = m - 1
      UNION ALL SELECT w.series_id, w.step + 1, f.c + f.phi * w.y, w.h FROM w JOIN f ON f.series_id = w.series_id
      WHERE w.step < w.h)
      SELECT series_id, CAST(step AS BIGINT) AS step, {r('y')} AS predicted FROM w WHERE step <= h""",
    "best_ar_order": f"WITH {BEST}",
    "linear_window_forecast": LINEAR,
    "future_dates": f"""WITH {USER}, l AS (SELECT series_id, max(ts) AS t FROM u GROUP BY 1)
      SELECT series_id, range AS step, t + to_days(CAST(range AS INTEGER)) AS date FROM l, range(1, 31)""",
    "persistence_eval": f"""WITH {HOURLY}, f AS (SELECT *, {FEATURES} FROM h),
      k AS (SELECT * FROM f WHERE lag1 IS NOT NULL AND lag2 IS NOT NULL AND rm IS NOT NULL),
      q AS (SELECT *, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM k),
      e AS (SELECT series_id, CASE WHEN pos < {CUT} THEN 'train' ELSE 'test' END AS split, value AS actual,
        lag1 AS predicted FROM q)
      SELECT series_id, split, {errors(5)} FROM e GROUP BY 1, 2""",
    "persistence_windows_eval": f"""WITH {PLACED}, {PARTS}, x AS (SELECT *, lag(value) OVER ({W}) AS prev FROM s),
      e AS (SELECT series_id, 'train' AS split, value AS actual, prev AS predicted FROM x WHERE pos BETWEEN 12 AND L - 2
        UNION ALL SELECT series_id, 'test', value, prev FROM x WHERE pos BETWEEN test_start + 12 AND n - 2)
      SELECT series_id, split, {errors(5)} FROM e GROUP BY 1, 2""",
    "mean_benchmark": f"""WITH {PLACED} SELECT series_id, CASE WHEN pos < {CUT} THEN 'train' ELSE 'test' END AS split,
      {r('avg(value)', 5)} AS mean_value FROM p GROUP BY 1, 2""",
    "baseline_compare": f"""WITH {PLACED}, {BASELINES}, a AS (
      SELECT series_id, model, sqrt(avg(pow(predicted - actual, 2))) AS rmse, avg(abs(predicted - actual)) AS mae
      FROM e WHERE split = 'test' GROUP BY 1, 2)
      SELECT series_id, model, {r('rmse', 5)} AS rmse, {r('mae', 5)} AS mae,
      row_number() OVER (PARTITION BY series_id ORDER BY rmse, model) AS rank FROM a""",
    "baseline_side_by_side": f"""WITH {HOURLY_PLACED}, {BASELINES}, a AS (
      SELECT series_id, split, model, sqrt(avg(pow(predicted - actual, 2))) AS rmse FROM e GROUP BY 1, 2, 3)
      SELECT series_id, split, {r("max(CASE WHEN model = 'persistence' THEN rmse END)", 5)} AS persistence,
      {r("max(CASE WHEN model = 'train_mean' THEN rmse END)", 5)} AS train_mean FROM a GROUP BY 1, 2""",
    "pacf_20": PACF,
    "arima_ar_eval": ARIMA_AR,
    "messy_pipeline_eval": MESSY,
    "sequence_predictions_1": f"""WITH {SEQUENCE_1} SELECT series_id, split, ts, CAST(pos AS BIGINT) AS pos,
      {r('actual', 4)} AS actual, {r('predicted', 4)} AS predicted FROM e""",
    "sequence_eval_1": f"""WITH {SEQUENCE_1} SELECT series_id, split, {errors(4, 'n_rows', 'rmse', 'mae')}
      FROM e GROUP BY 1, 2""",
    "save_load_forecast": SAVED_1,
    "csv_roundtrip": "SELECT event_id, event_type, value FROM events",
    "quoted_csv_roundtrip": "SELECT event_id, event_type, value, date_trunc('second', ts) AS ts FROM events",
    "strict_timestamps": "SELECT event_id, date_trunc('second', ts) AS parsed FROM events",
    "reuse_forecast": SAVED_1,
    "arima_ma_in_sample": f"""WITH RECURSIVE {HOURLY_PLACED}, z AS (SELECT series_id, pos, value, value - lag(value) OVER ({W}) AS z, ts, seq FROM p),
      u AS (SELECT series_id, pos, value, z - 0.01 - 0.5 * lag(z) OVER ({W}) AS u FROM z),
      e AS (SELECT series_id, pos, u AS e FROM u WHERE pos = 2
        UNION ALL SELECT u.series_id, u.pos, u.u - 0.4 * e.e FROM e JOIN u ON u.series_id = e.series_id AND u.pos = e.pos + 1)
      SELECT u.series_id, CAST(u.pos AS BIGINT) AS pos, {r('value - e', 5)} AS predicted FROM u LEFT JOIN e ON u.series_id = e.series_id AND u.pos = e.pos""",
    # The weight of an error fades with 0.4 to the power of its distance: sixty rows back it is below any double's last digit.
    "long_series_ma_in_sample": f"""WITH p AS (SELECT event_id AS seq, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events),
      z AS (SELECT *, value - lag(value) OVER (ORDER BY pos) AS z FROM p),
      u AS (SELECT *, z - 0.01 - 0.5 * lag(z) OVER (ORDER BY pos) AS u FROM z),
      k AS (SELECT range AS k FROM range(0, 61)),
      e AS (SELECT a.pos, sum(pow(-0.4, k) * b.u) AS e FROM u a, k JOIN u b ON b.pos = a.pos - k WHERE b.pos >= 2 GROUP BY 1)
      SELECT seq, CAST(u.pos AS BIGINT) AS pos, {r('value - e', 5)} AS predicted FROM u LEFT JOIN e USING (pos)""",
    "series_roundtrip": f"WITH {USER} SELECT ts, series_id, seq, value FROM u",
    "panel_union": PANEL_UNION,
    "long_series_features": f"""WITH u AS (SELECT 'all' AS series_id, ts, event_id AS seq, value FROM events),
      f AS (SELECT *, {FEATURES}, row_number() OVER ({W}) - 1 AS pos, {history()} AS x FROM u)
      SELECT seq, CAST(pos AS BIGINT) AS pos, {r('lag1')} AS lag1, {r('lag2')} AS lag2, {r('rm')} AS rolling_mean_3,
      coalesce(x, '') AS x FROM f""",
    "long_series_acf": long_acf(20),
    "long_series_acf_1000": long_acf(1000),
    "acf_240": PER_HOUR_ACF,
}
