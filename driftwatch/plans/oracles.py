"""SQL twins of the registered queries for DuckDB, written from the definitions, not from the plans."""

from __future__ import annotations

READINGS = """
reading_view AS (
  SELECT event_id, user_id AS sensor_id, user_id >> 2 AS motor_id, user_id & 3 AS channel, ts, epoch_us(ts) AS ts_us,
         CAST(CAST(CASE user_id & 3
           WHEN 0 THEN 300.0::double + 2.0::double * ((value - 50.0::double) / 50.0::double)
           WHEN 1 THEN 310.0::double + 1.5::double * ((value - 50.0::double) / 50.0::double)
           WHEN 2 THEN 1538.3::double + 179.0::double * ((value - 50.0::double) / 50.0::double)
           ELSE 40.0::double + 10.0::double * ((value - 50.0::double) / 50.0::double) END AS float) AS double) AS reading
  FROM events
)"""


def _motors(days: int = 1, name: str = "motors") -> str:
    """Four averages per motor and window, collected from averages per sensor."""
    width = 86400 * days
    return f"""
sensor_{name} AS (
  SELECT motor_id, channel, epoch_us(ts) // {width * 1000000} * {width} AS window_start,
         sum(reading) / count(*) AS average, count(*) AS n, max(epoch_us(ts)) AS max_us
  FROM reading_view GROUP BY ALL
),
{name} AS (
  SELECT motor_id, window_start,
         max(average) FILTER (WHERE channel = 0) AS air, max(average) FILTER (WHERE channel = 1) AS process,
         max(average) FILTER (WHERE channel = 2) AS speed, max(average) FILTER (WHERE channel = 3) AS torque,
         coalesce(max(n) FILTER (WHERE channel = 0), 0)::bigint AS n_air,
         coalesce(max(n) FILTER (WHERE channel = 1), 0)::bigint AS n_process,
         coalesce(max(n) FILTER (WHERE channel = 2), 0)::bigint AS n_speed,
         coalesce(max(n) FILTER (WHERE channel = 3), 0)::bigint AS n_torque,
         max(max_us) AS max_us
  FROM sensor_{name} GROUP BY motor_id, window_start
),
complete_{name} AS (
  SELECT *, ((n_air + n_process + n_speed + n_torque) // 4)::bigint AS mean_n FROM {name}
  WHERE air IS NOT NULL AND process IS NOT NULL AND speed IS NOT NULL AND torque IS NOT NULL
)"""


RAD = "({speed} / 60.0::double * pi() * 2.0::double)"


def _ci(air: str, process: str, speed: str, torque: str, n: str) -> str:
    power = f"({torque} * {RAD.format(speed=speed)})"
    return f"""CASE
    WHEN abs(abs({air} - {process}) - 10.00063::double) > 1.64::double * 2.49035776174829::double / sqrt({n}) THEN 'HeatDissipationFailure'
    WHEN abs({power} - 6443.50092908344::double) > 1.64::double * 1782.92606670628::double / sqrt({n}) THEN 'PowerFailure' END"""


def _threshold(diff: str, speed: str, torque: str, age: str) -> str:
    power = f"({torque} * {RAD.format(speed=speed)})"
    return f"""CASE
    WHEN abs({diff}) < 8.6::double AND {speed} < 1380.0::double THEN 'HeatDissipationFailure'
    WHEN NOT ({power} BETWEEN 3500.0::double AND 9000.0::double) THEN 'PowerFailure'
    WHEN ({age}) * {torque} > 11000.0::double THEN 'OverstrainFailure' END"""


CI_ALERTS = f"""
alerts AS (
  SELECT *, {_ci('air', 'process', 'speed', 'torque', 'mean_n')} AS failure FROM complete_motors
)"""

RUNS = """
run_view AS (
  SELECT event_id, CASE event_type WHEN 'click' THEN 'ObjectOriented' WHEN 'view' THEN 'ReactiveStreaming'
           WHEN 'purchase' THEN 'ClientServer' WHEN 'signup' THEN 'SpringQL' ELSE event_type END AS model,
         ([1, 2, 4, 8, 16, 24])[user_id % 6 + 1]::bigint AS motor_groups, (1 << (user_id % 13))::bigint AS window_ms,
         floor(value * 100) + user_id + floor(value * 50) + event_id % 97 AS cpu_time,
         10000 + floor(value * 10) AS peak_memory, (value / 100)::float::double AS load_average, value / 1000 AS delay
  FROM events
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY model, motor_groups, window_ms ORDER BY event_id) AS run_no FROM run_view
),
long_view AS (
  SELECT 'cpu_time' AS metric, motor_groups, window_ms, model, run_no, cpu_time::double AS value FROM numbered
  UNION ALL SELECT 'peak_memory', motor_groups, window_ms, model, run_no, peak_memory::double FROM numbered
  UNION ALL SELECT 'load_average', motor_groups, window_ms, model, run_no, load_average FROM numbered
  UNION ALL SELECT 'delay', motor_groups, window_ms, model, run_no, delay FROM numbered
)"""

# The t probability by its finite series: terms are running products, written as sums of logarithms.
T_TESTS = RUNS + """,
differences AS (
  SELECT c.metric, c.motor_groups, c.window_ms, c.value - b.value AS d
  FROM long_view c JOIN long_view b USING (metric, motor_groups, window_ms, run_no)
  WHERE c.model = 'ReactiveStreaming' AND b.model = 'ObjectOriented'
),
stats AS (
  SELECT metric, motor_groups, window_ms, count(*)::bigint AS n, avg(d) AS mean_diff, stddev_samp(d) AS sd_diff
  FROM differences GROUP BY ALL
),
directed AS (
  SELECT metric, motor_groups, window_ms, 'candidate_greater' AS direction, n, mean_diff, sd_diff FROM stats
  UNION ALL SELECT metric, motor_groups, window_ms, 'baseline_greater', n, -mean_diff, sd_diff FROM stats
),
scored AS (
  SELECT *, CASE WHEN n >= 2 AND sd_diff > 0 THEN mean_diff / (sd_diff / sqrt(n)) END AS t, n - 1 AS df FROM directed
),
angles AS (SELECT *, atan(t / sqrt(df)) AS theta FROM scored WHERE t IS NOT NULL),
steps AS (
  SELECT a.metric, a.motor_groups, a.window_ms, a.direction, k,
         sum(ln(pow(cos(theta), 2) * CASE df % 2 WHEN 1 THEN 2.0::double * k / (2 * k + 1) ELSE (2.0::double * k - 1) / (2 * k) END))
           OVER (PARTITION BY a.metric, a.motor_groups, a.window_ms, a.direction ORDER BY k) AS log_term
  FROM angles a JOIN (SELECT unnest(generate_series(1, (SELECT max(df) FROM angles))) AS k) s ON k <= (df - 2) // 2
),
series AS (
  SELECT metric, motor_groups, window_ms, direction, sum(exp(log_term)) AS total FROM steps GROUP BY ALL
),
tested AS (
  SELECT s.metric, s.motor_groups, s.window_ms, s.direction, s.n, s.mean_diff, s.sd_diff, s.t,
         CASE WHEN s.n < 2 THEN 0.0::double
              WHEN s.sd_diff > 0 THEN 0.5::double - 0.5::double * CASE
                WHEN s.df = 1 THEN 2 * theta / pi()
                WHEN s.df % 2 = 1 THEN 2 / pi() * (theta + sin(theta) * cos(theta) * (1 + coalesce(total, 0)))
                ELSE sin(theta) * (1 + coalesce(total, 0)) END
              WHEN s.mean_diff > 0 THEN 0.0::double WHEN s.mean_diff < 0 THEN 1.0::double END AS p
  FROM scored s
  LEFT JOIN angles a USING (metric, motor_groups, window_ms, direction)
  LEFT JOIN series r USING (metric, motor_groups, window_ms, direction)
)"""

# Reports of a throttled sensor: each next report is the first reading one interval after the last.
THROTTLED = READINGS + """,
report AS (
  WITH RECURSIVE chain AS (
    SELECT DISTINCT sensor_id, 1704067200000000::bigint AS at_us, 0 AS step FROM reading_view
    UNION ALL
    SELECT c.sensor_id, min(r.ts_us), any_value(c.step) + 1
    FROM chain c JOIN reading_view r ON r.sensor_id = c.sensor_id AND r.ts_us >= c.at_us + 86400000000
    GROUP BY c.sensor_id
  )
  SELECT c.sensor_id, c.at_us, avg(r.reading) AS average, count(*)::bigint AS n
  FROM chain c JOIN reading_view r
    ON r.sensor_id = c.sensor_id AND r.ts_us <= c.at_us AND r.ts_us >= c.at_us - 172800000000
  WHERE c.step > 0 GROUP BY ALL
)"""

# A row-by-row state machine: four slots per motor, cleared by an alert.
LATEST_RESET = "WITH RECURSIVE " + THROTTLED + f""",
ordered AS (
  SELECT sensor_id >> 2 AS motor_id, sensor_id & 3 AS channel, at_us, average, n,
         row_number() OVER (PARTITION BY sensor_id >> 2 ORDER BY at_us, sensor_id) AS rn
  FROM report
),
machine AS (
  SELECT DISTINCT motor_id, 0::bigint AS rn, NULL::double AS a0, NULL::double AS a1, NULL::double AS a2, NULL::double AS a3,
         NULL::bigint AS n0, NULL::bigint AS n1, NULL::bigint AS n2, NULL::bigint AS n3, NULL::bigint AS at_us,
         NULL::varchar AS failure
  FROM ordered
  UNION ALL
  SELECT motor_id, rn, a0, a1, a2, a3, n0, n1, n2, n3, at_us,
         CASE WHEN a0 IS NOT NULL AND a1 IS NOT NULL AND a2 IS NOT NULL AND a3 IS NOT NULL THEN
           {_ci('a0', 'a1', 'a2', 'a3', '((n0 + n1 + n2 + n3) // 4)')} END
  FROM (
    SELECT o.motor_id, o.rn, o.at_us,
           CASE WHEN o.channel = 0 THEN o.average WHEN m.failure IS NULL THEN m.a0 END AS a0,
           CASE WHEN o.channel = 1 THEN o.average WHEN m.failure IS NULL THEN m.a1 END AS a1,
           CASE WHEN o.channel = 2 THEN o.average WHEN m.failure IS NULL THEN m.a2 END AS a2,
           CASE WHEN o.channel = 3 THEN o.average WHEN m.failure IS NULL THEN m.a3 END AS a3,
           CASE WHEN o.channel = 0 THEN o.n WHEN m.failure IS NULL THEN m.n0 END AS n0,
           CASE WHEN o.channel = 1 THEN o.n WHEN m.failure IS NULL THEN m.n1 END AS n1,
           CASE WHEN o.channel = 2 THEN o.n WHEN m.failure IS NULL THEN m.n2 END AS n2,
           CASE WHEN o.channel = 3 THEN o.n WHEN m.failure IS NULL THEN m.n3 END AS n3
    FROM machine m JOIN ordered o ON o.motor_id = m.motor_id AND o.rn = m.rn + 1
  )
)
SELECT motor_id, at_us / 1e6 AS time, failure FROM machine WHERE failure IS NOT NULL"""

# A row-by-row state machine that only remembers the last alert and reads the range from the table.
TRAILING_RESET = f"""WITH RECURSIVE {READINGS},
ordered AS (
  SELECT motor_id, channel, ts_us, reading, row_number() OVER (PARTITION BY motor_id ORDER BY ts_us, sensor_id) AS rn
  FROM reading_view
),
machine AS (
  SELECT DISTINCT motor_id, 0::bigint AS rn, 0::bigint AS cleared, 1704067200000000::bigint AS since, NULL::bigint AS at_us,
         NULL::varchar AS failure
  FROM ordered
  UNION ALL
  SELECT motor_id, rn, CASE WHEN failure IS NULL THEN cleared ELSE rn END,
         CASE WHEN failure IS NULL THEN since ELSE at_us END, at_us, failure
  FROM (
    SELECT motor_id, rn, cleared, since, at_us,
           CASE WHEN air IS NOT NULL AND process IS NOT NULL AND speed IS NOT NULL AND torque IS NOT NULL THEN
             {_threshold('air - process', 'speed', 'torque', '(at_us - since) / 8640e6')} END AS failure
    FROM (
      SELECT m.motor_id, o.rn, m.cleared, m.since, o.ts_us AS at_us,
             avg(h.reading) FILTER (WHERE h.channel = 0) AS air, avg(h.reading) FILTER (WHERE h.channel = 1) AS process,
             avg(h.reading) FILTER (WHERE h.channel = 2) AS speed, avg(h.reading) FILTER (WHERE h.channel = 3) AS torque
      FROM machine m
      JOIN ordered o ON o.motor_id = m.motor_id AND o.rn = m.rn + 1
      JOIN ordered h ON h.motor_id = m.motor_id AND h.rn > m.cleared AND h.rn <= o.rn AND h.ts_us > o.ts_us - 172800000000
      GROUP BY ALL
    )
  )
)
SELECT motor_id, at_us / 1e6 AS time, failure FROM machine WHERE failure IS NOT NULL"""

AGE_STRAIN = f"""WITH RECURSIVE {READINGS}, {_motors()},
ordered AS (
  SELECT *, window_start + 86400 AS window_end, row_number() OVER (PARTITION BY motor_id ORDER BY window_start) AS rn
  FROM complete_motors
),
machine AS (
  SELECT DISTINCT motor_id, 0::bigint AS rn, 1704067200::bigint AS since, NULL::bigint AS window_start, NULL::varchar AS failure
  FROM ordered
  UNION ALL
  SELECT motor_id, rn, CASE WHEN failure IS NULL THEN since ELSE window_end END, window_start, failure
  FROM (
    SELECT o.motor_id, o.rn, m.since, o.window_start, o.window_end,
           {_threshold('air - process', 'speed', 'torque', '(o.window_end - m.since) / 8640.0::double')} AS failure
    FROM machine m JOIN ordered o ON o.motor_id = m.motor_id AND o.rn = m.rn + 1
  )
)
SELECT motor_id, window_start::double AS time, failure FROM machine WHERE failure IS NOT NULL"""


def _chain(body: str) -> str:
    return f"""WITH {READINGS},
average AS (
  SELECT motor_id, channel, epoch_us(ts) // 86400000000 * 86400 AS window_start, avg(reading) AS mean
  FROM reading_view GROUP BY ALL
),
a AS (SELECT motor_id, window_start, mean AS air FROM average WHERE channel = 0),
p AS (SELECT motor_id, window_start, mean AS process FROM average WHERE channel = 1),
s AS (SELECT motor_id, window_start, mean AS speed FROM average WHERE channel = 2),
q AS (SELECT motor_id, window_start, mean AS torque FROM average WHERE channel = 3),
diff AS (SELECT motor_id, window_start, air - process AS temperature_difference FROM a LEFT JOIN p USING (motor_id, window_start)),
load AS (SELECT motor_id, window_start, speed, speed * torque AS product, torque FROM s LEFT JOIN q USING (motor_id, window_start))
{body}"""


MOTOR_CHAIN = _chain("""
SELECT motor_id, window_start, round(temperature_difference, 6) AS temperature_difference,
       round(speed, 6) AS rotational_speed, round(product, 6) AS speed_torque_product, round(torque, 6) AS torque
FROM diff LEFT JOIN load USING (motor_id, window_start)""")

_SWEEP_DAYS = (1, 2, 4, 8)

ALERTS_CI = f"""WITH {READINGS}, {_motors()}, {CI_ALERTS}
SELECT motor_id, window_start, max_us / 1e6 AS time, failure FROM alerts WHERE failure IS NOT NULL"""

SLIDING = f"""WITH {READINGS},
spread AS (
  SELECT *, unnest([ts_us // 86400000000 * 86400, (ts_us // 86400000000 - 1) * 86400]) AS window_start FROM reading_view
)
SELECT sensor_id, window_start, round(avg(reading), 6) AS average, count(*)::bigint AS n, max(ts_us) / 1e6 AS max_time
FROM spread GROUP BY sensor_id, window_start"""

THROTTLED_ROWS = f"WITH {THROTTLED} SELECT sensor_id, at_us / 1e6 AS time, round(average, 6) AS average, n FROM report"


SENSOR_TRAILING = f"""WITH {READINGS}
SELECT event_id, sensor_id, round(avg(reading) OVER w, 6) AS average, count(*) OVER w AS n FROM reading_view
WINDOW w AS (PARTITION BY sensor_id ORDER BY ts_us RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW)"""

MOTOR_TRAILING = f"""WITH {READINGS}
SELECT event_id, motor_id, round(avg(reading) FILTER (WHERE channel = 0) OVER w, 6) AS air,
       round(avg(reading) FILTER (WHERE channel = 1) OVER w, 6) AS process,
       round(avg(reading) FILTER (WHERE channel = 2) OVER w, 6) AS speed,
       round(avg(reading) FILTER (WHERE channel = 3) OVER w, 6) AS torque
FROM reading_view
WINDOW w AS (PARTITION BY motor_id ORDER BY ts_us RANGE BETWEEN 172799999999 PRECEDING AND CURRENT ROW)"""

LIVE = f"""WITH {READINGS},
gaps AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY sensor_id ORDER BY ts_us) > 172800000000 AS gap FROM reading_view),
segments AS (
  SELECT *, sum(coalesce(gap, false)::int) OVER (PARTITION BY sensor_id ORDER BY ts_us RANGE UNBOUNDED PRECEDING) AS segment FROM gaps
)
SELECT event_id, sensor_id, ts_us / 1e6 AS time, round(reading, 6) AS reading FROM segments WHERE segment = 0"""


ORACLES: dict[str, str] = {
    "motor_alerts_ci": ALERTS_CI,
    "motor_alerts_threshold": f"""WITH {READINGS}, {_motors()},
alerts AS (
  SELECT *, {_threshold('air - process', 'speed', 'torque', '(window_start + 86400 - 1704067200) / 8640.0::double')} AS failure
  FROM complete_motors
)
SELECT motor_id, window_start, max_us / 1e6 AS time, failure FROM alerts WHERE failure IS NOT NULL""",
    "motor_window_pivot": f"""WITH {READINGS}, {_motors()}
SELECT motor_id, window_start, round(air, 6) AS air, round(process, 6) AS process, round(speed, 6) AS speed,
       round(torque, 6) AS torque, n_air, n_process, n_speed, n_torque FROM motors""",
    "motor_complete": f"""WITH {READINGS}, {_motors()}
SELECT motor_id, window_start, mean_n FROM complete_motors""",
    "sensor_window_avg": f"""WITH {READINGS}
SELECT sensor_id, epoch(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01'))::bigint AS window_start,
       round(avg(reading), 6) AS average, count(*)::bigint AS n, max(ts_us) / 1e6 AS max_time
FROM reading_view GROUP BY ALL""",
    "sensor_sliding_avg": SLIDING,
    "sensor_tumbling_avg": f"""WITH {READINGS}
SELECT sensor_id, epoch(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01'))::bigint AS window_start,
       round(avg(reading), 6) AS average
FROM reading_view GROUP BY ALL""",
    "sensor_trailing_avg": SENSOR_TRAILING,
    "motor_trailing_avg": MOTOR_TRAILING,
    "join_temp_diff": _chain(
        "SELECT motor_id, window_start, round(temperature_difference, 6) AS temperature_difference FROM diff"),
    "join_speed_torque": _chain("""
SELECT motor_id, window_start, round(speed, 6) AS rotational_speed, round(product, 6) AS speed_torque_product,
       round(torque, 6) AS torque FROM load"""),
    "motor_join_chain": MOTOR_CHAIN,
    "motor_join_chain_sql": MOTOR_CHAIN,
    "latest_per_channel": f"""WITH {READINGS},
slots AS (
  SELECT *, CASE WHEN channel = 0 THEN reading END AS x0, CASE WHEN channel = 1 THEN reading END AS x1,
         CASE WHEN channel = 2 THEN reading END AS x2, CASE WHEN channel = 3 THEN reading END AS x3 FROM reading_view
)
SELECT event_id, motor_id, round(last_value(x0 IGNORE NULLS) OVER w, 6) AS air,
       round(last_value(x1 IGNORE NULLS) OVER w, 6) AS process, round(last_value(x2 IGNORE NULLS) OVER w, 6) AS speed,
       round(last_value(x3 IGNORE NULLS) OVER w, 6) AS torque
FROM slots
WINDOW w AS (PARTITION BY motor_id ORDER BY ts_us, sensor_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "consecutive_dedup": f"""WITH {READINGS},
hours AS (SELECT *, ts_us // 3600000000 * 3600 AS ts_hour FROM reading_view),
compared AS (SELECT *, lag(ts_hour) OVER (PARTITION BY motor_id ORDER BY ts_us, sensor_id) AS previous FROM hours)
SELECT motor_id, ts_hour, event_id FROM compared WHERE previous IS DISTINCT FROM ts_hour""",
    "window_sweep": f"WITH {READINGS}, " + ", ".join(_motors(d, f"motors_{d}") for d in _SWEEP_DAYS) + ", sweep AS ("
    + " UNION ALL ".join(
        f"SELECT {d}::bigint AS window_days, motor_id, window_start, "
        f"{_ci('air', 'process', 'speed', 'torque', 'mean_n')} AS failure FROM complete_motors_{d}"
        for d in _SWEEP_DAYS)
    + ") SELECT * FROM sweep WHERE failure IS NOT NULL",
    "run_bounds": f"""WITH {READINGS}
SELECT event_id, sensor_id, ts_us / 1e6 AS time FROM reading_view
WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-11'""",
    "sensor_decode": "SELECT event_id, user_id AS sensor_id, user_id // 4 AS motor_id, user_id % 4 AS channel FROM events",
    "sensor_encode": "SELECT event_id, (user_id // 4) * 4 + user_id % 4 AS sensor_id FROM events",
    "unit_convert": f"""WITH {READINGS}
SELECT event_id, round(reading / 60.0::double * pi() * 2.0::double, 6) AS rad_per_s FROM reading_view WHERE channel = 2""",
    "enum_validate": """SELECT event_type, count(*) FILTER (WHERE event_type IN ('click', 'view'))::bigint AS n_ok,
       count(*) FILTER (WHERE event_type NOT IN ('click', 'view'))::bigint AS n_rejected
FROM events GROUP BY event_type""",
    "readings_union": f"""WITH {READINGS}
SELECT channel, count(*)::bigint AS n, round(sum(reading), 3) AS total FROM reading_view GROUP BY channel""",
    "filename_params": f"""WITH {RUNS}
SELECT DISTINCT motor_groups || '_60_' || window_ms || '_' || window_ms || '_1_400_' || model || '_ru.csv' AS file_name,
       motor_groups, window_ms, CASE WHEN model IN ('ObjectOriented', 'ReactiveStreaming', 'ClientServer', 'SpringQL') THEN model END AS model,
       'ru' AS dataset FROM run_view""",
    "run_metric_long": f"""WITH {RUNS}
SELECT metric, motor_groups, window_ms, model, run_no, round(value, 6) AS value FROM long_view""",
    "metric_quartiles": f"""WITH {RUNS},
q AS (
  SELECT metric, motor_groups, window_ms, model, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
         quantile_cont(value, 0.75) AS q3 FROM long_view GROUP BY ALL
)
SELECT metric, motor_groups, window_ms, model, round(q1 - 1.5::double * (q3 - q1), 9) AS lower_fence,
       round(q1, 9) AS lower_quartile, round(q2, 9) AS median, round(q3, 9) AS upper_quartile,
       round(q3 + 1.5::double * (q3 - q1), 9) AS upper_fence FROM q""",
    "alert_counts": f"""WITH {RUNS}
SELECT motor_groups, window_ms, model, count(*)::bigint AS n FROM run_view GROUP BY ALL""",
    "paired_ttest": f"""WITH {T_TESTS}
SELECT metric, motor_groups, window_ms, direction, n, (round(mean_diff, 12) + 0.0::double)::float AS mean_diff,
       round(sd_diff, 12)::float AS sd_diff, (round(t, 12) + 0.0::double)::float AS t, round(p, 6) AS p FROM tested""",
    "model_verdict": f"""WITH {T_TESTS},
wide AS (
  SELECT metric, motor_groups, window_ms, max(n) AS n, max(p) FILTER (WHERE direction = 'candidate_greater') AS c,
         max(p) FILTER (WHERE direction = 'baseline_greater') AS b FROM tested GROUP BY ALL
)
SELECT metric, motor_groups, window_ms,
       CASE WHEN n < 2 THEN 'insufficient' WHEN c IS NULL OR (c > 0.05 AND b > 0.05) THEN 'equal'
            WHEN c > 0.05 THEN 'declarative better' ELSE 'baseline better' END AS verdict FROM wide""",
    "sensor_liveness": f"""WITH {READINGS},
gaps AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY sensor_id ORDER BY ts_us) > 172800000000 AS gap FROM reading_view),
segments AS (
  SELECT *, sum(coalesce(gap, false)::int) OVER (PARTITION BY sensor_id ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS segment FROM gaps
)
SELECT sensor_id, count(*) FILTER (WHERE segment = 0)::bigint AS kept, count(*) FILTER (WHERE segment > 0)::bigint AS dropped,
       max(ts_us) FILTER (WHERE segment = 0) / 1e6 AS cut_time
FROM segments GROUP BY sensor_id""",
    "alert_delay": f"""WITH {READINGS}, {_motors()}, {CI_ALERTS}
SELECT motor_id, window_start, round(((window_start + 86400)::bigint * 1000000 - max_us) / 1e6, 6) AS delay
FROM alerts WHERE failure IS NOT NULL""",
    "throttled_avg": THROTTLED_ROWS,
    "alerts_latest_reset": LATEST_RESET,
    "alerts_trailing_reset": TRAILING_RESET,
    "alerts_age_strain": AGE_STRAIN,
    "stream_motor_alerts_ci": ALERTS_CI,
    "stream_sensor_sliding_avg": SLIDING,
    "stream_motor_join_chain": MOTOR_CHAIN,
    "stream_sensor_trailing_avg": SENSOR_TRAILING,
    "stream_motor_trailing_avg": MOTOR_TRAILING,
    "stream_live_readings": LIVE,
    "stream_throttled_avg": THROTTLED_ROWS,
    "stream_alerts_latest_reset": LATEST_RESET,
    "stream_alerts_trailing_reset": TRAILING_RESET,
    "stream_alerts_age_strain": AGE_STRAIN,
    "stream_consecutive_dedup": f"""WITH {READINGS},
compared AS (SELECT *, lag(channel) OVER (PARTITION BY motor_id ORDER BY ts_us, sensor_id, event_id) AS previous FROM reading_view)
SELECT motor_id, event_id, channel, ts_us / 1e6 AS time FROM compared WHERE previous IS DISTINCT FROM channel""",
}
