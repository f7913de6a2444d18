"""Building blocks of the comparison SQL (DuckDB dialect): each is a CTE over the ones before."""

from __future__ import annotations

from gaugeworks.functions.text import IDLE_SUGGESTION, NO_REASON
from gaugeworks.schema import BOUNDS, METRICS

def share(event: int, user: int) -> str:
    """A number from 0 up to 1 from the ids."""
    return f"(CAST((event_id * {event} + user_id * {user}) % 997 AS double) / 997e0)"


# The telemetry view of the event table.
TELEMETRY = f"""
t AS (
  SELECT event_id AS seq, ts AS "timestamp",
    concat('gpu-', lpad(CAST(user_id AS varchar), 4, '0')) AS gpu_id,
    concat('node-', lpad(CAST(user_id % 8 AS varchar), 2, '0')) AS node_id,
    CASE WHEN event_type = 'signup' AND k < 25 THEN NULL ELSE value END AS gpu_util,
    100e0 * {share(7, 3)} AS mem_util,
    CASE WHEN event_type = 'error' AND k < 20 THEN NULL ELSE 25e0 + 70e0 * {share(11, 5)} END AS gpu_temp,
    60e0 + 500e0 * {share(13, 17)} AS power_watts,
    CASE WHEN event_type = 'error' THEN floor(30e0 * {share(19, 2)}) ELSE 0e0 END AS ecc_errors,
    CASE WHEN event_type = 'error' AND k >= 80 THEN floor(9e0 * {share(23, 29)}) ELSE 0e0 END AS xid_errors,
    k AS cpu_util, 100e0 * {share(31, 11)} AS ram_util,
    800e0 * {share(37, 13)} AS net_throughput_mbps, 250e0 * {share(41, 19)} AS disk_io_mbps,
    7200e0 * {share(43, 23)} AS job_runtime_s, floor(12e0 * {share(47, 31)}) AS queue_length,
    1e0 + floor(9e0 * {share(53, 37)}) AS active_processes
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS double) AS k FROM events)
)"""

DEDUPLICATED = """
d AS (
  SELECT * FROM t WHERE gpu_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY gpu_id, "timestamp" ORDER BY seq DESC) = 1
)"""

INDEXED = """
i AS (
  SELECT *, row_number() OVER (PARTITION BY gpu_id ORDER BY "timestamp") - 1 AS p,
    count(*) OVER (PARTITION BY gpu_id) AS n
  FROM d
)"""


def each(template: str, separator: str = ", ", metrics=METRICS) -> str:
    """The template once per metric, with `{m}` replaced."""
    return separator.join(template.replace("{m}", m) for m in metrics)


def bounded(m: str) -> str:
    low, high = BOUNDS[m]
    inner = m if low is None else f"greatest({m}, {low})"
    inner = inner if high is None else f"least({inner}, {high})"
    return f"CASE WHEN {m} IS NOT NULL THEN {inner} END AS {m}"


_SEEN = each(
    "last_value({m} IGNORE NULLS) OVER b AS pv_{m}, first_value({m} IGNORE NULLS) OVER f AS qv_{m},"
    " last_value(CASE WHEN {m} IS NOT NULL THEN p END IGNORE NULLS) OVER b AS pp_{m},"
    " first_value(CASE WHEN {m} IS NOT NULL THEN p END IGNORE NULLS) OVER f AS qp_{m}"
)
FILLED = f"""
seen AS (
  SELECT *, {_SEEN} FROM i
  WINDOW b AS (PARTITION BY gpu_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY gpu_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
filled AS (
  SELECT seq, "timestamp", gpu_id, node_id, p, n, {each(
    "CASE WHEN {m} IS NOT NULL THEN {m} WHEN pv_{m} IS NULL THEN qv_{m} WHEN qv_{m} IS NULL THEN pv_{m}"
    " ELSE pv_{m} + (qv_{m} - pv_{m}) * (p - pp_{m})::double / (qp_{m} - pp_{m}) END AS {m}")}
  FROM seen
)"""

BOUNDED = f"""
bounded AS (SELECT * REPLACE ({", ".join(bounded(m) for m in METRICS)}) FROM filled)"""

CLAMP = (
    "CASE WHEN s_{m} > 0 AND abs(({m} - a_{m}) / s_{m}) > 5"
    " THEN least(greatest({m}, a_{m} - 5 * s_{m}), a_{m} + 5 * s_{m}) ELSE {m} END AS {m}"
)
CLEAN = f"""
moments AS (SELECT gpu_id, {each("avg({m}) AS a_{m}, stddev_pop({m}) AS s_{m}")} FROM bounded GROUP BY gpu_id),
clean AS (
  SELECT seq, "timestamp", gpu_id, node_id, p, n, {each(CLAMP)}
  FROM bounded JOIN moments USING (gpu_id)
)"""

STATS = f"""
stats AS (
  SELECT gpu_id, "timestamp" AS window_end_timestamp, p, n, {each(
    "avg({m}) OVER w AS {m}_mean, stddev_pop({m}) OVER w AS {m}_std, max({m}) OVER w AS {m}_max")}
  FROM clean
  WINDOW w AS (PARTITION BY gpu_id ORDER BY p ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
  QUALIFY p >= 29 AND (p - 29) % 5 = 0
)"""

ELEMENTS = f"""
elements AS (
  SELECT s.gpu_id, s.window_end_timestamp, c.p AS pos, {each("c.{m}")}
  FROM (SELECT gpu_id, window_end_timestamp, p FROM stats) s
  JOIN clean c ON c.gpu_id = s.gpu_id AND c.p BETWEEN s.p - 29 AND s.p
),
scaler AS (SELECT {each("avg({m}) AS mu_{m}, stddev_pop({m}) AS sd_{m}")} FROM elements)"""

_SQUARES = each("pow(({m} - mu_{m}) / CASE WHEN sd_{m} = 0 THEN 1 ELSE sd_{m} END, 2)", " + ")
ERRORS = f"""
errors AS (
  SELECT gpu_id, window_end_timestamp, avg(({_SQUARES}) / 13) AS error
  FROM elements, scaler GROUP BY gpu_id, window_end_timestamp
),
limits AS (SELECT quantile_cont(error, 0.01) AS p1, quantile_cont(error, 0.99) AS p99 FROM errors),
anomaly AS (
  SELECT gpu_id, window_end_timestamp, error,
    least(greatest((error - p1) / (greatest(p99, p1 + 1e-8) - p1), 0), 1) AS anomaly_score
  FROM errors, limits
)"""


def norm(value: str, low: float, high: float) -> str:
    return f"least(greatest(({value} - {low}) / ({high} - {low})::double, 0), 1)"


TERM = {
    "anomaly": "0.35e0 * anomaly_score",
    "ecc_xid_errors": f"0.25e0 * greatest({norm('ecc_errors_max', 0, 10)}, {norm('xid_errors_max', 0, 5)})",
    "thermal": f"0.2e0 * {norm('gpu_temp_max', 70, 100)}",
    "utilization_instability": f"0.2e0 * {norm('gpu_util_std', 0, 40)}",
}
HEALTH = f"""
risk AS (
  SELECT stats.*, anomaly_score, least(greatest({" + ".join(TERM.values())}, 0), 1) AS failure_risk_score
  FROM stats JOIN anomaly USING (gpu_id, window_end_timestamp)
),
health AS (
  SELECT *, (1 - failure_risk_score) * 100e0 AS gpu_health_score,
    CASE WHEN failure_risk_score > 0.05 THEN least(greatest((1 - failure_risk_score) * 500e0, 1), 500)
         ELSE 500e0 END AS estimated_time_to_failure_steps
  FROM risk
)"""

LATEST = """
latest AS (
  SELECT * FROM health
  QUALIFY row_number() OVER (PARTITION BY gpu_id ORDER BY window_end_timestamp DESC) = 1
)"""


def rounded(value: str, digits: int) -> str:
    """Half-up on the decimal value, as the displayed fields are rounded."""
    return f"CAST(round(CAST({value} AS decimal(30,9)), {digits}) AS double)"


def tier(risk: str) -> str:
    return f"CASE WHEN {risk} < 0.33 THEN 'low' WHEN {risk} < 0.66 THEN 'medium' ELSE 'high' END"


def time_text(ts: str) -> str:
    return (
        f"CASE WHEN microsecond({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%d %H:%M:%S')"
        f" ELSE strftime({ts}, '%Y-%m-%d %H:%M:%S.%f') END"
    )


DEVICES = f"""
devices AS (
  SELECT gpu_id, {time_text("window_end_timestamp")} AS as_of,
    {rounded("gpu_health_score", 2)} AS gpu_health_score,
    {rounded("failure_risk_score", 4)} AS failure_risk_score,
    {tier("failure_risk_score")} AS risk_tier,
    {rounded("estimated_time_to_failure_steps", 1)} AS estimated_time_to_failure_steps,
    {rounded("anomaly_score", 4)} AS anomaly_score,
    {rounded("gpu_util_mean", 2)} AS gpu_util_mean,
    {rounded("gpu_temp_max", 2)} AS gpu_temp_max
  FROM latest
)"""

SCHEDULED = """
scheduled AS (
  SELECT *, 0.4e0 * (gpu_health_score / 100) + 0.3e0 * (1 - failure_risk_score)
    + 0.2e0 * (1 - least(greatest(gpu_util_mean, 0), 100) / 100)
    + 0.1e0 * (1 - greatest(queue_length_mean, 0)
               / greatest((SELECT max(queue_length_mean) FROM latest), 1)) AS schedule_score
  FROM latest
)"""


def reason(health: str, risk: str, util: str) -> str:
    return (
        f"coalesce(nullif(concat_ws(', ', CASE WHEN {health} >= 80 THEN 'high health score' END,"
        f" CASE WHEN {risk} < 0.2 THEN 'low failure risk' END,"
        f" CASE WHEN {util} < 30 THEN 'currently underutilized' END), ''), '{NO_REASON}')"
    )


def two(value: str) -> str:
    return f"printf('%.2f', {value})"


def alert(gpu: str, risk_tier: str, risk: str, eta: str) -> str:
    return (
        f"CASE WHEN {risk_tier} = 'high' THEN concat({gpu}, ' has high failure risk (', {two(risk)},"
        f" '); estimated ', printf('%.0f', {eta}), ' steps to failure.')"
        f" WHEN {risk_tier} = 'medium' THEN concat({gpu}, ' shows elevated failure risk (', {two(risk)},"
        f" '); monitor closely.') END"
    )


def sentence(risk: str, driver: str, share: str) -> str:
    return (
        f"concat('Failure risk of ', {two(risk)}, ' is primarily driven by ''', {driver},"
        f" ''' (contributes ', {two(share)}, ' of the total score).')"
    )


SUGGESTION = IDLE_SUGGESTION
CHAIN = [
    TELEMETRY, DEDUPLICATED, INDEXED, FILLED, BOUNDED, CLEAN, STATS, ELEMENTS, ERRORS, HEALTH, LATEST,
    DEVICES, SCHEDULED,
]


def query(select: str, upto: str, *extra: str) -> str:
    """`select` with the chain of CTEs up to and including `upto`."""
    return "WITH " + ",".join([*CHAIN[: CHAIN.index(upto) + 1], *extra]) + "\n" + select
