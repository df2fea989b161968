"""DuckDB SQL for every batch job, built from the same parameters as ``plans.jobs``.

These are the correctness oracles: plain SQL over the test tables (views
``events``, ``customer``, ``nation`` ...), written the obvious way (window
functions, joins with range predicates, one row per window start) rather than
the way the Spark plans are built. Time arithmetic is on epoch microseconds.
"""

from __future__ import annotations

from ..functions.time import duration_us
from .jobs import P


def _sliding(src: str, size, slide) -> str:
    """Rows of ``src`` (which has ``ts``) fanned out to every window start ``ws``."""
    s = duration_us(slide or size)
    k = duration_us(size) // s
    return (f"SELECT *, (epoch_us(ts) // {s} - r.k) * {s} AS ws "
            f"FROM ({src}) AS src CROSS JOIN range(0, {k}) AS r(k)")


def _bounds(size) -> str:
    return f"make_timestamp(ws) AS window_start, make_timestamp(ws + {duration_us(size)}) AS window_end"


def _topn(src: str, key: str, size, slide, n: int) -> str:
    return f"""
WITH w AS ({_sliding(src, size, slide)}),
c AS (SELECT ws, {key}, count(*) AS n FROM w GROUP BY ws, {key}),
r AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY n DESC, {key}) AS rank FROM c)
SELECT {_bounds(size)}, {key}, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {n}"""


def _value_balance() -> str:
    # literal microseconds: 1 h windows every 5 min
    return """
WITH w AS (SELECT event_type, CAST(floor(value) AS BIGINT) - 50 AS v, (epoch_us(ts) // 300000000 - k) * 300000000 AS ws
           FROM events CROSS JOIN range(0, 12) AS r(k))
SELECT make_timestamp(ws) AS window_start, make_timestamp(ws + 3600000000) AS window_end, event_type,
       CAST(sum(v) AS BIGINT) AS balance FROM w GROUP BY ws, event_type"""


# The SQL of the following jobs has every parameter as a literal of its own.
WINDOW_EXTREMES = """
WITH w AS (SELECT event_type, value, (epoch_us(ts) // 5000000 - k) * 5000000 AS ws FROM events CROSS JOIN range(0, 720) AS r(k))
SELECT make_timestamp(ws) AS window_start, make_timestamp(ws + 3600000000) AS window_end, event_type, count(value) AS n,
       min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM w GROUP BY ws, event_type"""

WINDOW_QUANTILES = """
WITH w AS (SELECT event_type, value, (epoch_us(ts) // 300000000 - k) * 300000000 AS ws
           FROM events CROSS JOIN range(0, 12) AS r(k) WHERE value IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY ws, event_type ORDER BY value) AS nth, count(*) OVER (PARTITION BY ws, event_type) AS n FROM w)
SELECT make_timestamp(ws) AS window_start, make_timestamp(ws + 3600000000) AS window_end, event_type, n,
       min(value) FILTER (nth * 2 >= n) AS p50, min(value) FILTER (nth * 10 >= n * 9) AS p90 FROM r GROUP BY ws, event_type, n"""

SLIDING_UV = """
WITH w AS (SELECT user_id, (epoch_us(ts) // 300000000 - k) * 300000000 AS ws FROM events CROSS JOIN range(0, 12) AS r(k))
SELECT make_timestamp(ws) AS window_start, make_timestamp(ws + 3600000000) AS window_end, count(DISTINCT user_id) AS uv FROM w GROUP BY ws"""


def _uv_bloom() -> str:
    """2^20 bits, three hashes: one + i * two, each three rounds of integer arithmetic on the low 31 bits and the rest."""
    def step(x: str, m: int) -> str:
        return f"((xor({x}, {x} >> 15) + 1) * {m}) % 2147483647"

    a, b = (1103515245, 1597334677, 812115677), (747796405, 1181783497, 668265263)
    return f"""
WITH v AS (SELECT epoch_us(ts) // 3600000000 * 3600000000 AS ws, user_id & 2147483647 AS low, (user_id >> 31) % 2147483647 AS high,
                  count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1, 2, 3),
r1 AS (SELECT ws, n, ({step('low', a[0])} + high * {a[2]}) % 2147483647 AS a, ({step('low', b[0])} + high * {b[2]}) % 2147483647 AS b FROM v),
r2 AS (SELECT ws, n, {step('a', a[1])} AS a, {step('b', b[1])} AS b FROM r1),
r3 AS (SELECT ws, n, {step('a', a[2])} AS a, {step('b', b[2])} AS b FROM r2),
pv AS (SELECT ws, sum(n)::BIGINT AS pv FROM r3 GROUP BY ws),
bits AS (SELECT ws, count(DISTINCT (a + i * b) % 1048576) AS x FROM r3 CROSS JOIN range(0, 3) AS r(i) GROUP BY ws)
SELECT make_timestamp(ws) AS window_start, make_timestamp(ws + 3600000000) AS window_end, pv,
       round(-(1048576 / 3.0) * ln(1 - least(x, 1048575) / 1048576.0))::BIGINT AS uv FROM pv JOIN bits USING (ws)"""


AD_ROLLUP = """
WITH w AS (SELECT coalesce(r.r_name, 'unknown') AS region, coalesce(na.n_name, 'unknown') AS province,
                  (epoch_us(e.ts) // 300000000 - k) * 300000000 AS ws
           FROM events e CROSS JOIN range(0, 12) AS t(k) LEFT JOIN customer c ON e.user_id = c.c_custkey
           LEFT JOIN nation na ON c.c_nationkey = na.n_nationkey LEFT JOIN region r ON na.n_regionkey = r.r_regionkey
           WHERE e.event_type = 'click')
SELECT make_timestamp(ws) AS window_start, make_timestamp(ws + 3600000000) AS window_end,
       CASE grouping(region, province) WHEN 0 THEN 'province' WHEN 1 THEN 'region' ELSE 'all' END AS grain, region, province,
       count(*) AS n FROM w GROUP BY GROUPING SETS ((ws, region, province), (ws, region), (ws))"""


USER_SESSIONS = """
WITH e AS (SELECT user_id, ts, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000, true) AS fresh
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth
      FROM (SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS event_id FROM e) AS e)
SELECT user_id, min(ts) AS session_start, make_timestamp(epoch_us(max(ts)) + 21600000000) AS session_end, count(*) AS n
FROM s GROUP BY user_id, nth"""

LAST_VIEW = """
SELECT b.user_id, b.ts AS buy_ts, b.event_id AS buy_id, CASE WHEN near THEN v_ts END AS view_ts, CASE WHEN near THEN v_id END AS view_id,
       CASE WHEN near THEN v_value END AS view_value
FROM (SELECT b.*, v.ts AS v_ts, v.event_id AS v_id, v.value AS v_value, epoch_us(b.ts) - epoch_us(v.ts) <= 172800000000 AS near
      FROM (SELECT * FROM events WHERE event_type = 'purchase') AS b
      ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') AS v ON b.user_id = v.user_id AND b.ts >= v.ts) AS b"""


def _k() -> str:
    return "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _pv_uv() -> str:
    s = duration_us(P["pv_uv"]["size"])
    return f"""
SELECT make_timestamp(epoch_us(ts) // {s} * {s}) AS window_start,
       make_timestamp(epoch_us(ts) // {s} * {s} + {s}) AS window_end,
       count(*) AS pv, count(DISTINCT user_id) AS uv
FROM events WHERE event_type = 'view' GROUP BY 1, 2"""


_PROVINCE = ("LEFT JOIN customer c ON e.user_id = c.c_custkey "
             "LEFT JOIN nation na ON c.c_nationkey = na.n_nationkey")


def _ranked_by_day() -> str:
    return ("SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, event_type, "
            "CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events")


def _login_fail(times: int, within) -> str:
    w = duration_us(within)
    leads = ", ".join(f"lead(event_type = 'error', {j}) OVER w AS f{j}" for j in range(1, times))
    conds = " AND ".join(f"f{j}" for j in range(1, times))
    return f"""
WITH s AS (SELECT user_id, ts, event_type = 'error' AS f0, {leads},
                  lead(ts, {times - 1}) OVER w AS last_ts
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, ts AS first_ts, last_ts FROM s
WHERE f0 AND {conds} AND epoch_us(last_ts) - epoch_us(ts) <= {w}"""


def _order_timeout() -> str:
    w = duration_us(P["order_timeout"]["within"])
    return f"""
WITH c AS (SELECT user_id, ts AS create_ts, event_id AS create_id FROM events WHERE event_type = 'signup'),
p AS (SELECT user_id, ts AS pay_ts, event_id AS pay_id FROM events WHERE event_type = 'purchase'),
m AS (SELECT c.user_id, c.create_ts, c.create_id, min(p.pay_ts) AS pay_ts,
             arg_min(p.pay_id, p.pay_ts) AS pay_id
      FROM c LEFT JOIN p ON p.user_id = c.user_id AND p.pay_ts >= c.create_ts
                        AND epoch_us(p.pay_ts) - epoch_us(c.create_ts) <= {w}
      GROUP BY c.user_id, c.create_ts, c.create_id)
SELECT user_id, CASE WHEN pay_ts IS NULL THEN 'timeout' ELSE 'paid' END AS kind,
       create_ts, pay_ts, create_id, pay_id FROM m
UNION ALL
SELECT p.user_id, 'pay_without_create' AS kind, NULL AS create_ts, p.pay_ts, NULL AS create_id, p.pay_id
FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = p.user_id AND c.create_ts <= p.pay_ts)"""


def _pr() -> str:
    return ("p AS (SELECT user_id, ts AS pay_ts, event_id AS pay_id FROM events WHERE event_type = 'purchase'), "
            "r AS (SELECT user_id, ts AS receipt_ts, event_id AS receipt_id FROM events WHERE event_type = 'click')")


def _in_range(a: str = "p", b: str = "r") -> str:
    lo, hi = duration_us(P["reconcile"]["lower"]), duration_us(P["reconcile"]["upper"])
    return (f"{a}.user_id = {b}.user_id AND epoch_us({b}.receipt_ts) - epoch_us({a}.pay_ts) "
            f"BETWEEN {lo} AND {hi}")


def _reconcile_ok() -> str:
    return f"""
WITH {_pr()}
SELECT p.user_id, p.pay_ts, p.pay_id, r.receipt_ts, r.receipt_id FROM p JOIN r ON {_in_range()}"""


def _reconcile() -> str:
    return f"""
WITH {_pr()}
SELECT p.user_id, 'matched' AS kind, p.pay_ts, p.pay_id, r.receipt_ts, r.receipt_id FROM p JOIN r ON {_in_range()}
UNION ALL
SELECT p.user_id, 'pay_only', p.pay_ts, p.pay_id, NULL, NULL FROM p
WHERE NOT EXISTS (SELECT 1 FROM r WHERE {_in_range()})
UNION ALL
SELECT r.user_id, 'receipt_only', NULL, NULL, r.receipt_ts, r.receipt_id FROM r
WHERE NOT EXISTS (SELECT 1 FROM p WHERE {_in_range()})"""


def _temp_rising() -> str:
    d = duration_us(P["temp_rising"]["duration"])
    return f"""
WITH s AS (SELECT user_id, ts, event_id, COALESCE(value > lag(value) OVER w, false) AS rise
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(CASE WHEN rise THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM s),
r AS (SELECT user_id, run, min(ts) AS run_start, max(ts) AS last_ts FROM g WHERE rise GROUP BY user_id, run)
SELECT user_id, run_start, make_timestamp(epoch_us(run_start) + {d}) AS alarm_ts FROM r
WHERE epoch_us(last_ts) - epoch_us(run_start) >= {d}"""


def oracle_sql() -> dict[str, str]:
    hi, hp, cp = P["hot_items"], P["hot_pages"], P["channel_promo"]
    ar, ab = P["ad_by_region"], P["ad_blacklist"]
    return {
        "hot_items": _topn(f"SELECT ts, {_k()} AS item_id FROM events WHERE event_type = 'view'",
                           "item_id", hi["size"], hi["slide"], hi["top"]),
        "hot_pages": _topn(f"SELECT ts, {_k()} AS address FROM events", "address",
                           hp["size"], hp["slide"], hp["top"]),
        "value_balance": _value_balance(),
        "window_extremes": WINDOW_EXTREMES,
        "window_quantiles": WINDOW_QUANTILES,
        "sliding_uv": SLIDING_UV,
        "ad_rollup": AD_ROLLUP,
        "user_sessions": USER_SESSIONS,
        "last_view": LAST_VIEW,
        "uv_bloom": _uv_bloom(),
        "pv_uv": _pv_uv(),
        "pv_uv_sql": _pv_uv(),
        "uv_approx": _pv_uv(),
        "channel_promo": f"""
WITH w AS ({_sliding(f"SELECT e.ts, coalesce(c.c_mktsegment, 'unknown') AS channel, e.event_type AS behavior FROM events e "
                     f"LEFT JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type <> '{cp['exclude']}'",
                     cp["size"], cp["slide"])})
SELECT {_bounds(cp["size"])}, channel, behavior, count(*) AS n FROM w GROUP BY ws, channel, behavior""",
        "ad_by_region": f"""
WITH w AS ({_sliding(f"SELECT e.ts, coalesce(na.n_name, 'unknown') AS province FROM events e {_PROVINCE} "
                     "WHERE e.event_type = 'click'", ar["size"], ar["slide"])})
SELECT {_bounds(ar["size"])}, province, count(*) AS n FROM w GROUP BY ws, province""",
        "ad_blacklist_alerts": f"""
WITH r AS ({_ranked_by_day()})
SELECT user_id, event_type, day, ts AS alert_ts, event_id AS alert_event_id FROM r WHERE rn = {ab["limit"] + 1}""",
        "ad_blacklist_counts": f"""
WITH r AS ({_ranked_by_day()}),
w AS ({_sliding(f"SELECT e.ts, coalesce(na.n_name, 'unknown') AS province FROM r e {_PROVINCE} WHERE e.rn <= {ab['limit']}",
                ab["size"], ab["slide"])})
SELECT {_bounds(ab["size"])}, province, count(*) AS n FROM w GROUP BY ws, province""",
        "login_fail": _login_fail(P["login_fail"]["times"], P["login_fail"]["within"]),
        "login_fail_3in6h": _login_fail(P["login_fail_3in6h"]["times"], P["login_fail_3in6h"]["within"]),
        "order_timeout": _order_timeout(),
        "reconcile": _reconcile(),
        "reconcile_ok": _reconcile_ok(),
        "temp_rising": _temp_rising(),
        "temp_split": f"""
SELECT event_id, ts, user_id, value,
       CASE WHEN value > {P["temp_split"]["threshold"]} THEN 'high' ELSE 'low' END AS kind FROM events""",
    }
