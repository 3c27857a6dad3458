"""The catalog's queries as plain SQL for another engine (DuckDB dialect).

The texts are built from shared common table expressions. Durations are in
seconds, already stretched as in the catalog.
"""

from __future__ import annotations

from signalgraph.functions.scalars import PARAMETER_PATTERN
from signalgraph.schema import SERVICE_GROUPS

W, TICK, BUCKET, SPAN, BUCKETS = 108000, 3600, 1800, 30, 60

LOGS = """
base AS (
  SELECT event_id, epoch_us(ts) / 1000000.0 AS ts,
    CASE user_id % 14 WHEN 0 THEN 'gateway' WHEN 1 THEN 'auth' WHEN 2 THEN 'sessions'
      WHEN 3 THEN 'catalog' WHEN 4 THEN 'search' WHEN 5 THEN 'cart' WHEN 6 THEN 'checkout'
      WHEN 7 THEN 'payments' WHEN 8 THEN 'ledger' WHEN 9 THEN 'inventory'
      WHEN 10 THEN 'recommendations' WHEN 11 THEN 'fulfillment'
      WHEN 12 THEN 'notifications' ELSE 'analytics' END AS service,
    CASE WHEN event_type = 'error' AND value >= 100 THEN 'FATAL'
         WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'WARN'
         WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
    concat('t', CAST(event_id // 10 AS VARCHAR)) AS trace_id,
    concat('s', CAST(event_id AS VARCHAR)) AS span_id,
    value AS latency_ms,
    concat(event_type, ' handled user=u_', CAST(user_id AS VARCHAR), ' took ',
           CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR), 'ms props ', props) AS message
  FROM events),
logs AS (
  SELECT ts, service, level, trace_id, span_id,
    CASE service WHEN 'auth' THEN 'gateway' WHEN 'search' THEN 'gateway'
      WHEN 'sessions' THEN CASE WHEN event_id % 3 = 0 THEN 'cart' ELSE 'auth' END
      WHEN 'catalog' THEN CASE WHEN event_id % 3 = 0 THEN 'cart'
                               WHEN event_id % 3 = 1 THEN 'search' ELSE 'gateway' END
      WHEN 'inventory' THEN CASE WHEN event_id % 3 = 0 THEN 'checkout'
                                 WHEN event_id % 3 = 1 THEN 'fulfillment' ELSE 'catalog' END
      WHEN 'recommendations' THEN 'catalog' WHEN 'cart' THEN 'checkout'
      WHEN 'payments' THEN 'checkout' WHEN 'ledger' THEN 'payments'
      WHEN 'notifications' THEN 'fulfillment' ELSE NULL END AS parent_service,
    latency_ms,
    CASE level WHEN 'WARN' THEN 206 WHEN 'ERROR' THEN 500 WHEN 'FATAL' THEN 503 ELSE 200 END AS status_code,
    message
  FROM base),
clock AS (
  SELECT max(ts) AS now, min(ts) AS started, CAST(floor(max(ts) / 3600) AS BIGINT) + 1 AS last_no,
    CAST(floor(max(ts) / 1800) AS BIGINT) + 1 AS end_bucket
  FROM logs),
recent AS (SELECT logs.* FROM logs, clock WHERE ts >= now - 108000)
"""

LINE_LOGS = """
base AS (
  SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) / 1000000.0 + l_linenumber / 1000.0 AS ts,
    concat('supp_', CAST(l_suppkey % 14 AS VARCHAR)) AS service,
    CASE l_returnflag WHEN 'R' THEN 'ERROR' WHEN 'A' THEN 'WARN' ELSE 'INFO' END AS level,
    CAST(l_orderkey AS VARCHAR) AS trace_id,
    concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '-', CAST(l_partkey AS VARCHAR),
      '-', CAST(l_suppkey AS VARCHAR)) AS span_id,
    CAST(l_quantity AS DOUBLE) AS latency_ms
  FROM lineitem),
logs AS (
  SELECT *, lag(service) OVER (PARTITION BY trace_id ORDER BY l_linenumber, span_id, ts, level, latency_ms) AS parent_service FROM base),
clock AS (SELECT CAST(floor(max(ts) / 86400) AS BIGINT) + 1 AS last_no FROM logs)
"""


def near(expr: str) -> str:
    return f"round({expr} + CAST(1e-9 AS DOUBLE), 6)"


IS_ERROR = "level IN ('ERROR', 'FATAL')"
ERRORS = f"CAST(sum(CASE WHEN {IS_ERROR} THEN 1 ELSE 0 END) AS BIGINT)"
WARNS = "CAST(sum(CASE WHEN level = 'WARN' THEN 1 ELSE 0 END) AS BIGINT)"
AGGS = f"""count(*) AS total, {ERRORS} AS errors, {WARNS} AS warns, avg(latency_ms) AS mean_lat,
  quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99,
  CAST({ERRORS} AS DOUBLE) / count(*) AS error_rate"""
GROUP_CASE = (
    "CASE service " + " ".join(f"WHEN '{s}' THEN '{g}'" for s, g in SERVICE_GROUPS.items()) + " ELSE 'other' END"
)


def ticks(tick: int = TICK) -> str:
    return f"""
hits AS (
  SELECT l.*, unnest(range(pane + 1, least(pane + {SPAN}, last_no) + 1)) AS tick_no
  FROM (SELECT logs.*, CAST(floor(ts / {tick}) AS BIGINT) AS pane FROM logs) l, clock),
ticks AS (
  SELECT tick_no, CAST(tick_no AS DOUBLE) * {tick} AS tick, service, {AGGS}
  FROM hits GROUP BY tick_no, service),
numbered AS (
  SELECT tick_no, tick, row_number() OVER (ORDER BY tick_no) AS seq
  FROM (SELECT DISTINCT tick_no, tick FROM ticks))"""


def sql(select: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join([LOGS, *parts]) + select


TICKS = ticks()
SHOWN_RATES = f"""service, total, errors, warns, {near('mean_lat')} AS mean_lat, {near('p50')} AS p50,
  {near('p95')} AS p95, {near('p99')} AS p99, {near('error_rate')} AS error_rate"""

BUCKET_SPINE = """
spine AS (SELECT unnest(range(end_bucket - 60, end_bucket)) AS bucket FROM clock),
bucketed AS (
  SELECT l.* FROM (SELECT logs.*, CAST(floor(ts / 1800) AS BIGINT) AS bucket FROM logs) l, clock
  WHERE bucket >= end_bucket - 60 AND bucket < end_bucket)"""

RATE_SERIES = f"""{BUCKET_SPINE},
observed AS (
  SELECT service, bucket,
    CAST(sum(CASE WHEN level IN ('ERROR', 'FATAL', 'WARN') THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS rate
  FROM bucketed GROUP BY service, bucket),
dense AS (
  SELECT s.service, spine.bucket, coalesce(o.rate, 0) AS rate
  FROM (SELECT DISTINCT service FROM observed) s CROSS JOIN spine
  LEFT JOIN observed o ON o.service = s.service AND o.bucket = spine.bucket)"""

CALLS = """
calls AS (
  SELECT parent_service AS source, service AS target, tick_no, count(*) AS calls
  FROM hits WHERE parent_service IS NOT NULL AND parent_service <> service
  GROUP BY parent_service, service, tick_no)"""

WEIGHTS = f"""{CALLS},
call_seq AS (SELECT source, target, seq, calls FROM calls JOIN numbered USING (tick_no)),
steps AS (
  SELECT CAST(0 AS BIGINT) AS seq, source, target, CAST(0 AS DOUBLE) AS weight
  FROM (SELECT DISTINCT source, target FROM calls)
  UNION ALL
  SELECT s.seq + 1, s.source, s.target,
    CASE WHEN s.weight * CAST(0.92 AS DOUBLE) + coalesce(c.calls, 0) < 0.3 THEN CAST(0 AS DOUBLE)
         ELSE s.weight * CAST(0.92 AS DOUBLE) + coalesce(c.calls, 0) END
  FROM steps s LEFT JOIN call_seq c ON c.seq = s.seq + 1 AND c.source = s.source AND c.target = s.target
  WHERE s.seq < (SELECT max(seq) FROM numbered)),
weights AS (
  SELECT tick_no, tick, source, target, weight FROM steps JOIN numbered USING (seq) WHERE weight > 0)"""

ZSCORES = """
scored AS (
  SELECT *, count(*) OVER w AS samples,
    avg(CAST(total AS DOUBLE)) OVER w AS m_total, stddev_pop(CAST(total AS DOUBLE)) OVER w AS s_total,
    avg(CAST(errors AS DOUBLE)) OVER w AS m_errors, stddev_pop(CAST(errors AS DOUBLE)) OVER w AS s_errors,
    avg(p95) OVER w AS m_p95, stddev_pop(p95) OVER w AS s_p95
  FROM ticks
  WINDOW w AS (PARTITION BY service ORDER BY tick_no ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
zs AS (
  SELECT tick_no, tick, service, total, errors, p95, samples,
    CASE WHEN samples < 8 OR s_total < 1e-6 THEN 0 ELSE (total - m_total) / s_total END AS z_total,
    CASE WHEN samples < 8 OR s_errors < 1e-6 THEN 0 ELSE (errors - m_errors) / s_errors END AS z_errors,
    CASE WHEN samples < 8 OR s_p95 < 1e-6 THEN 0 ELSE (p95 - m_p95) / s_p95 END AS z_p95
  FROM scored),
signals AS (
  SELECT tick_no, tick, service, 0 AS signal, z_errors AS z, 3.0 AS t FROM zs WHERE z_errors >= 3 AND errors >= 3
  UNION ALL SELECT tick_no, tick, service, 1, z_p95, 3.0 FROM zs WHERE z_p95 >= 3 AND p95 > 100
  UNION ALL SELECT tick_no, tick, service, 2, z_total, 3.0 FROM zs WHERE z_total >= 4 AND total > 20)"""

RULES = """
rules(rule_id, service, metric, op, threshold, duration_s) AS (VALUES
  ('r_err_any', '*', 'error_rate', '>', 0.3, 7200),
  ('r_pay_p95', 'payments', 'p95_latency', '>=', 150.0, 7200),
  ('r_ntf_load', 'notifications', 'logs_per_min', '>', 0.02, 7200),
  ('r_quiet', 'ledger', 'logs_per_min', '<', 0.012, 3600)),
spans AS (SELECT rule_id, 0 AS epoch, CAST(-1 AS DOUBLE) AS from_ts, CAST(1e18 AS DOUBLE) AS to_ts FROM rules)"""

CHANGED_RULES = """
rules(rule_id, service, metric, op, threshold, duration_s) AS (VALUES
  ('r_err_any', '*', 'error_rate', '>', 0.3, 7200),
  ('r_ntf_load', 'notifications', 'logs_per_min', '>', 0.02, 7200)),
spans(rule_id, epoch, from_ts, to_ts) AS (VALUES
  ('r_err_any', 1, 1704067200.0, 1704067200.0 + 5 * 86400),
  ('r_err_any', 2, 1704067200.0 + 8 * 86400, 1704067200.0 + 20 * 86400),
  ('r_ntf_load', 1, 1704067200.0 + 10 * 86400, 1e18))"""


def dwell(scope: str = "r.service") -> str:
    return f"""
valued AS (
  SELECT r.rule_id, {scope} AS scope, s.epoch, r.op, CAST(r.threshold AS DOUBLE) AS threshold, r.duration_s,
    t.tick_no, t.tick, t.service, t.total,
    CASE r.metric WHEN 'error_rate' THEN t.error_rate WHEN 'p95_latency' THEN t.p95
      ELSE t.total / (CAST(108000 AS DOUBLE) / 60) END AS value
  FROM ticks t JOIN rules r ON r.service = '*' OR r.service = t.service
  JOIN spans s ON s.rule_id = r.rule_id AND t.tick >= s.from_ts AND t.tick < s.to_ts),
matched AS (
  SELECT *, row_number() OVER (PARTITION BY tick_no, rule_id, scope ORDER BY total DESC, service) AS place
  FROM valued
  WHERE CASE op WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold
    WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold END),
runs AS (
  SELECT m.*, n.seq, n.seq - row_number() OVER (PARTITION BY rule_id, scope, epoch ORDER BY n.seq) AS run
  FROM matched m JOIN numbered n USING (tick_no) WHERE place = 1),
dwells AS (
  SELECT *, min(tick) OVER (PARTITION BY rule_id, scope, epoch, run) AS entered_at FROM runs),
ripe AS (
  SELECT *, row_number() OVER (PARTITION BY rule_id, scope, epoch, run ORDER BY seq) AS nth_ripe
  FROM dwells WHERE tick - entered_at >= duration_s),
firings AS (
  SELECT *, row_number() OVER (PARTITION BY rule_id, scope ORDER BY seq) AS fired_count FROM ripe WHERE nth_ripe = 1)"""


FIRINGS = f"""
SELECT rule_id, tick_no, service, fired_count,
  {near("least(CAST(0.95 AS DOUBLE), CAST(0.55 AS DOUBLE) + fired_count * CAST(0.05 AS DOUBLE))")} AS severity
FROM firings"""

REACH = """
reach AS (
  SELECT DISTINCT tick_no, source, source AS service, 0 AS hops FROM weights WHERE weight >= 0.1
  UNION
  SELECT r.tick_no, r.source, w.target, r.hops + 1
  FROM reach r JOIN weights w ON w.tick_no = r.tick_no AND w.source = r.service AND w.weight >= 0.1
  WHERE r.hops < 5),
blasts AS (
  SELECT tick_no, source, list(service ORDER BY hops, service) AS blast
  FROM (SELECT tick_no, source, service, min(hops) AS hops FROM reach WHERE hops <= 4 GROUP BY tick_no, source, service)
  GROUP BY tick_no, source)"""

# Anomalies of the detectors without chance: rates and rules.
STEADY = f"""
named(rule_id, position, name) AS (VALUES ('r_err_any', 1, 'error rate anywhere'), ('r_pay_p95', 2, 'payments p95'),
  ('r_ntf_load', 3, 'notifications load'), ('r_quiet', 4, 'ledger quiet')),
steady AS (
  SELECT s.tick_no, s.tick, 'rate_spike' AS kind, s.service,
    greatest(0, least(1, (s.z - s.t) / CAST(6 AS DOUBLE) + CAST(0.5 AS DOUBLE))) AS severity,
    CASE s.signal WHEN 0 THEN printf('error burst: %d errors, z=%.1f', z.errors, s.z)
      WHEN 1 THEN printf('p95 latency jump to %.0fms, z=%.1f', z.p95, s.z)
      ELSE printf('log volume spike: %d logs, z=%.1f', z.total, s.z) END AS description,
    0 AS detector_ord, CAST(-z.total AS DOUBLE) AS ord_1, s.service AS ord_2, s.signal AS ord_3
  FROM signals s JOIN zs z ON z.tick_no = s.tick_no AND z.service = s.service
  UNION ALL
  SELECT f.tick_no, f.tick, 'rule_fired', f.service,
    least(CAST(0.95 AS DOUBLE), CAST(0.55 AS DOUBLE) + f.fired_count * CAST(0.05 AS DOUBLE)),
    concat('rule · ', n.name, ' (observed ', CASE f.rule_id WHEN 'r_err_any' THEN printf('%.1f%%', f.value * 100)
      WHEN 'r_pay_p95' THEN printf('%.0fms', f.value) ELSE printf('%.0f/min', f.value) END, ')'),
    3, CAST(n.position AS DOUBLE), concat(f.rule_id, '|', f.scope), 0
  FROM firings f JOIN named n USING (rule_id)),
hit AS (
  SELECT s.*, coalesce(b.blast, [s.service]) AS blast,
    row_number() OVER (ORDER BY s.tick, s.detector_ord, s.ord_1, s.ord_2, s.ord_3) AS k
  FROM steady s LEFT JOIN blasts b ON b.tick_no = s.tick_no AND b.source = s.service)"""

# One anomaly after the other, with the open incidents as a list.
FOLD = """
fold AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS joined,
    CAST([] AS STRUCT(id BIGINT, seen DOUBLE, services VARCHAR[], impact VARCHAR[])[]) AS held
  UNION ALL
  SELECT k, CASE WHEN place > 0 THEN alive[place].id ELSE k END AS joined,
    CASE WHEN place > 0 THEN list_transform(alive, lambda x, i: CASE WHEN i = place THEN struct_pack(id := x.id, seen := tick,
        services := list_distinct(list_append(x.services, service)), impact := list_distinct(list_concat(x.impact, blast))) ELSE x END)
      ELSE list_append(alive, struct_pack(id := k, seen := tick, services := [service], impact := blast)) END AS held
  FROM (
    SELECT k, tick, service, blast, alive, CASE WHEN list_max(scores) > 0 THEN list_position(scores, list_max(scores)) ELSE 0 END AS place
    FROM (
      SELECT k, tick, service, blast, alive, list_transform(alive, lambda x: CASE
          WHEN list_contains(x.impact, service) OR list_contains(x.services, service) OR list_has_any(x.services, blast)
          THEN CASE WHEN list_contains(x.impact, service) THEN CAST(3 AS DOUBLE) ELSE 0 END
            + CASE WHEN list_contains(x.services, service) THEN 4 ELSE 0 END
            + CASE WHEN list_has_any(x.services, blast) THEN 2 ELSE 0 END + greatest(0, 1 - (tick - x.seen) / CAST(45000 AS DOUBLE))
          ELSE 0 END) AS scores
      FROM (
        SELECT h.k, h.tick, h.service, h.blast, list_filter(f.held, lambda x: h.tick - x.seen <= 45000) AS alive
        FROM fold f JOIN hit h ON h.k = f.k + 1)))),
members AS (
  SELECT h.*, f.joined, first.tick_no AS first_tick_no, first.service AS first_service
  FROM hit h JOIN fold f USING (k) JOIN hit first ON first.k = f.joined)"""

# An incident is active from a signal on; silence makes it resolving, resolved and dropped.
STATES = """
moments AS (
  SELECT joined, tick_no, lag(tick_no) OVER w AS prev, coalesce(lead(tick_no) OVER w, 1000000000) AS nxt
  FROM (SELECT DISTINCT joined, tick_no FROM members) WINDOW w AS (PARTITION BY joined ORDER BY tick_no)),
states AS (
  SELECT joined, tick_no, 'active' AS state FROM moments WHERE prev IS NULL OR prev + 10 < tick_no
  UNION ALL SELECT joined, tick_no + 10, 'resolving' FROM moments WHERE tick_no + 10 < nxt
  UNION ALL SELECT joined, tick_no + 23, 'resolved' FROM moments WHERE tick_no + 23 < nxt
  UNION ALL SELECT joined, tick_no + 173, 'dropped' FROM moments WHERE tick_no + 173 < nxt)"""

# Reachability of the last tick with an anomaly while an incident is kept.
ROOTS = """
ended AS (SELECT joined, max(tick_no) AS tick_no FROM members GROUP BY joined),
graph_of AS (
  SELECT e.joined, max(m.tick_no) AS tick_no FROM ended e
  JOIN (SELECT DISTINCT tick_no FROM members) m ON m.tick_no >= e.tick_no AND m.tick_no - e.tick_no <= 172 GROUP BY e.joined),
parts AS (SELECT DISTINCT joined, first_tick_no, service FROM members),
roots AS (
  SELECT *, row_number() OVER (PARTITION BY joined ORDER BY score DESC, service) AS place FROM (
    SELECT p.joined, p.first_tick_no, p.service, count(r.hops) AS reached_by,
      count(r.hops) * CAST(100 AS DOUBLE) + coalesce(avg(r.hops), 0) AS score
    FROM parts p LEFT JOIN (
      SELECT g.joined, r.source, r.service, min(r.hops) AS hops FROM graph_of g JOIN reach r ON r.tick_no = g.tick_no
      JOIN parts q ON q.joined = g.joined AND q.service = r.source WHERE r.source <> r.service
      GROUP BY g.joined, r.source, r.service) r ON r.joined = p.joined AND r.service = p.service
    GROUP BY p.joined, p.first_tick_no, p.service))"""

EWMA = """
ordered AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY tick_no) AS rn FROM ticks),
ewma AS (
  SELECT service, rn, tick_no, error_rate AS mean, CAST(0 AS DOUBLE) AS variance FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.service, o.rn, o.tick_no,
    CAST(0.35 AS DOUBLE) * o.error_rate + (1 - CAST(0.35 AS DOUBLE)) * e.mean,
    CAST(0.35 AS DOUBLE) * (o.error_rate - e.mean) * (o.error_rate - e.mean) + (1 - CAST(0.35 AS DOUBLE)) * e.variance
  FROM ewma e JOIN ordered o ON o.service = e.service AND o.rn = e.rn + 1)"""

DEPTHS = """
firsts AS (
  SELECT * FROM (
    SELECT trace_id, service, parent_service, ts, span_id,
      row_number() OVER (PARTITION BY trace_id, service ORDER BY ts, span_id, parent_service NULLS FIRST) AS rn
    FROM logs) WHERE rn = 1),
links AS (
  SELECT c.trace_id, c.service, p.service AS parent
  FROM firsts c LEFT JOIN firsts p
    ON p.trace_id = c.trace_id AND p.service = c.parent_service AND (p.ts, p.span_id) < (c.ts, c.span_id)),
levels AS (
  SELECT trace_id, service, CAST(1 AS BIGINT) AS level FROM links WHERE parent IS NULL
  UNION ALL
  SELECT k.trace_id, k.service, l.level + 1 FROM links k JOIN levels l ON l.trace_id = k.trace_id AND l.service = k.parent),
spans_depth AS (
  SELECT s.span_id, s.service, coalesce(l.level, 0) AS depth
  FROM logs s
  LEFT JOIN firsts p ON p.trace_id = s.trace_id AND p.service = s.parent_service AND (p.ts, p.span_id) < (s.ts, s.span_id)
  LEFT JOIN levels l ON l.trace_id = p.trace_id AND l.service = p.service)"""

SUMMARY = """
summary AS (
  SELECT trace_id, min(ts) AS started, (max(ts + latency_ms / 1000.0) - min(ts)) * 1000.0 AS duration_ms,
    array_to_string(list_sort(list(DISTINCT service)), ',') AS services,
    bool_or(level IN ('ERROR', 'FATAL')) AS has_errors, count(*) AS spans
  FROM logs GROUP BY trace_id)"""
SHOWN_SUMMARY = f"SELECT trace_id, started, round(duration_ms, 2) AS duration_ms, services, has_errors, spans FROM summary"

MASKED = f"""
cleaned AS (
  SELECT logs.*, trim(regexp_replace(regexp_replace(message, '{PARAMETER_PATTERN}', '<*>', 'g'), '\\s+', ' ', 'g')) AS masked
  FROM logs),
masks AS (
  SELECT masked, count(*) AS n, min(ts) AS first_ts, arg_min(service, (ts, span_id)) AS first_service
  FROM cleaned GROUP BY masked),
found AS (
  SELECT *, row_number() OVER (ORDER BY first_ts, masked) AS template_id FROM masks),
with_ids AS (SELECT cleaned.*, found.template_id FROM cleaned JOIN found USING (masked))"""

TEMPLATE_AGGS = """max(level) AS level,
  arg_max(level, list_position(['DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL'], level)) AS top_level,
  count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(message, (ts, span_id)) AS example"""

NODES = f"""
node_metrics AS (
  SELECT tick_no, service, total / (CAST(108000 AS DOUBLE) / 60) AS logs_per_min, error_rate, mean_lat AS mean_latency_ms,
    greatest(0, 1 - error_rate * CAST(1.8 AS DOUBLE) - least(p95 / 800, CAST(0.6 AS DOUBLE))) AS health
  FROM ticks)"""

SHOWN_LOG = "ts, service, level, trace_id, span_id, parent_service, latency_ms, status_code, message"

STATS = """
stats AS (
  SELECT service, avg(rate) AS m, stddev_pop(rate) AS s FROM dense GROUP BY service)"""
PAIRS = """
SELECT a.service AS service_a, b.service AS service_b,
  round(CASE WHEN sa.s < 1e-9 OR sb.s < 1e-9 THEN CASE WHEN a.service = b.service THEN 1.0 ELSE 0.0 END
    ELSE greatest(-1, least(1, avg((a.rate - sa.m) * (b.rate - sb.m)) / (sa.s * sb.s))) END + CAST(1e-9 AS DOUBLE), 3) AS corr
FROM dense a JOIN dense b ON a.bucket = b.bucket
JOIN stats sa ON sa.service = a.service JOIN stats sb ON sb.service = b.service
GROUP BY a.service, b.service, sa.s, sb.s"""

# every third bucket's end, from the first that closes up to the last row
MOMENTS = """
rates AS (
  SELECT service, CAST(floor(ts / 1800) AS BIGINT) AS bucket,
    CAST(sum(CASE WHEN level IN ('ERROR', 'FATAL', 'WARN') THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS rate
  FROM logs GROUP BY service, floor(ts / 1800)),
moments AS (
  SELECT unnest(range((SELECT min(bucket) // 3 FROM rates), (SELECT CAST(floor(max(ts) / 5400) AS BIGINT) + 1 FROM logs))) AS m),
present AS (
  SELECT m, service FROM moments JOIN rates ON bucket < 3 * m AND bucket >= 3 * m - 60 GROUP BY m, service),
dense AS (
  SELECT p.m, p.service, k.bucket, coalesce(r.rate, 0) AS rate
  FROM present p, LATERAL (SELECT unnest(range(3 * p.m - 60, 3 * p.m)) AS bucket) k
  LEFT JOIN rates r ON r.service = p.service AND r.bucket = k.bucket),
stats AS (
  SELECT m AS at, service, avg(rate) AS m, stddev_pop(rate) AS s FROM dense GROUP BY dense.m, service)"""

BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"



DOCUMENT_LINES = """SELECT CAST(doc_id AS DOUBLE) AS ts, printf('%010d', line_no) AS span, source AS service, line AS message
  FROM (SELECT doc_id, source, unnest(lines) AS line, unnest(range(len(lines))) AS line_no
    FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents))"""
SHOWN_TEMPLATES = """SELECT row_number() OVER (ORDER BY g.first) AS template_id, array_to_string(t.held[g.place], ' ') AS template,
  CAST(g.count AS BIGINT) AS count, g.first_text
FROM groups g JOIN texts t USING (leaf)"""
NEW_TEMPLATES = """SELECT tick_no, tick, template_id, service, first_text FROM (
  SELECT CAST(floor(first_ts / 2) AS BIGINT) + 1 AS tick_no, (floor(first_ts / 2) + 1) * 2 AS tick,
    row_number() OVER (ORDER BY first) AS template_id, first_service AS service, first_text FROM groups)
WHERE tick - (SELECT min(ts) FROM lines) >= 25"""


def mined(lines: str, shown: str = SHOWN_TEMPLATES, children: int = 100) -> str:
    """Templates of ``lines`` (ts, span, service, message): routing level by level, then
    one message of every leaf after the other, with the leaf's groups as lists of words."""
    levels = "".join(
        f"""
kept{i} AS (
  SELECT leaf, b{i}, row_number() OVER (PARTITION BY leaf ORDER BY min(arrived)) AS place
  FROM route{i} WHERE b{i} IS NOT NULL GROUP BY leaf, b{i}),
route{i + 1} AS (
  SELECT r.* EXCLUDE (leaf), CASE WHEN r.b{i} IS NULL THEN r.leaf
    ELSE concat(r.leaf, ' ', CASE WHEN k.place <= {children} THEN r.b{i} ELSE '<*>' END) END AS leaf
  FROM route{i} r LEFT JOIN kept{i} k ON k.leaf = r.leaf AND k.b{i} = r.b{i}),"""
        for i in range(4)
    )
    branches = ", ".join(f"CASE WHEN starts_with(words[{i + 1}], '<') THEN '<*>' ELSE words[{i + 1}] END AS b{i}" for i in range(4))
    same = " AND ".join(f"r.b{i} IS NOT DISTINCT FROM w.b{i}" for i in range(4))
    return f"""WITH RECURSIVE lines AS ({lines}),
masks AS (
  SELECT masked, count(*) AS n, min((ts, span)) AS arrived, min(ts) AS first_ts, arg_min(service, (ts, span)) AS first_service FROM (
    SELECT ts, span, service, trim(regexp_replace(regexp_replace(message, '{PARAMETER_PATTERN}', '<*>', 'g'), '{BLANKS}', ' ', 'g')) AS masked
    FROM lines) WHERE masked <> '' GROUP BY masked),
worded AS (SELECT *, len(words) AS width, {branches} FROM (SELECT *, string_split(masked, ' ') AS words FROM masks)),
route0 AS (
  SELECT width, b0, b1, b2, b3, min(arrived) AS arrived, CAST(width AS VARCHAR) AS leaf FROM worded GROUP BY width, b0, b1, b2, b3),
{levels}
ordered AS (
  SELECT w.masked, w.words, w.n, w.arrived, w.first_ts, w.first_service, r.leaf, row_number() OVER (PARTITION BY r.leaf ORDER BY w.arrived, w.masked) AS k
  FROM worded w JOIN route4 r ON r.width = w.width AND {same}),
fold AS (
  SELECT leaf, k, CAST(1 AS BIGINT) AS place, [words] AS held FROM ordered WHERE k = 1
  UNION ALL
  SELECT leaf, k, place, CASE WHEN place > len(held) THEN list_append(held, words)
    ELSE list_transform(held, lambda g, nth: CASE WHEN nth = place
      THEN list_transform(g, lambda x, i: CASE WHEN x = words[i] THEN x ELSE '<*>' END) ELSE g END) END AS held
  FROM (
    SELECT leaf, k, words, held, CASE WHEN list_max(scores) >= 0.55 THEN CAST(list_position(scores, list_max(scores)) AS BIGINT)
      ELSE len(held) + 1 END AS place
    FROM (
      SELECT o.leaf, o.k, o.words, f.held, list_transform(f.held, lambda g: CAST(list_sum(list_transform(g,
          lambda x, i: CASE WHEN x = o.words[i] OR x = '<*>' THEN 1 ELSE 0 END)) AS DOUBLE) / len(g)) AS scores
      FROM fold f JOIN ordered o ON o.leaf = f.leaf AND o.k = f.k + 1))),
texts AS (SELECT leaf, arg_max(held, k) AS held FROM fold GROUP BY leaf),
groups AS (
  SELECT o.leaf, f.place, sum(o.n) AS count, min((o.arrived, o.masked)) AS first, arg_min(o.masked, (o.arrived, o.masked)) AS first_text,
    min(o.first_ts) AS first_ts, arg_min(o.first_service, (o.arrived, o.masked)) AS first_service
  FROM ordered o JOIN fold f ON f.leaf = o.leaf AND f.k = o.k GROUP BY o.leaf, f.place)
{shown}"""


ORACLES: dict[str, str] = {
    "service_rates_asof": sql(
        f"SELECT {SHOWN_RATES} FROM rates", f" rates AS (SELECT service, {AGGS} FROM recent GROUP BY service) "
    ),
    "service_rates_ticks": sql(f" SELECT tick_no, tick, {SHOWN_RATES} FROM ticks", TICKS),
    "feature_matrix": sql(
        f"""SELECT service, CAST(total AS DOUBLE) AS total, CAST(errors AS DOUBLE) AS errors, CAST(warns AS DOUBLE) AS warns,
          {near('mean_lat')} AS mean_lat, {near('p95')} AS p95, {near('error_rate')} AS error_rate FROM rates""",
        f" rates AS (SELECT service, {AGGS} FROM recent GROUP BY service) ",
    ).replace("CAST(total AS DOUBLE) AS total", f"{near('CAST(total AS DOUBLE)')} AS total"),
    "timeline": sql(
        f"""SELECT CAST(spine.bucket AS DOUBLE) * 1800 AS ts, CAST(coalesce(total, 0) AS BIGINT) AS total,
          CAST(coalesce(errors, 0) AS BIGINT) AS errors, CAST(coalesce(warns, 0) AS BIGINT) AS warns
        FROM spine LEFT JOIN (
          SELECT bucket, count(*) AS total, {ERRORS} AS errors, {WARNS} AS warns FROM bucketed GROUP BY bucket) c USING (bucket)""",
        BUCKET_SPINE,
    ),
    "latency_series": sql(
        f"""SELECT s.service, CAST(spine.bucket AS DOUBLE) * 1800 AS ts, {near('coalesce(p50, 0)')} AS p50,
          {near('coalesce(p95, 0)')} AS p95, {near('coalesce(p99, 0)')} AS p99, {near('coalesce(mean_lat, 0)')} AS mean
        FROM (SELECT DISTINCT service FROM bucketed) s CROSS JOIN spine
        LEFT JOIN (SELECT service, bucket, {AGGS} FROM bucketed GROUP BY service, bucket) c
          ON c.service = s.service AND c.bucket = spine.bucket""",
        BUCKET_SPINE,
    ),
    "error_rate_series": sql(
        f" SELECT service, CAST(bucket AS DOUBLE) * 1800 AS ts, {near('rate')} AS rate FROM dense", RATE_SERIES
    ),
    "search_logs": sql(
        """SELECT ts, service, level, message, trace_id, span_id, latency_ms FROM recent
        WHERE message ILIKE '%ERROR hand_ed%k%' ORDER BY ts DESC, span_id LIMIT 50"""
    ),
    "search_total": sql(
        "SELECT count(*) AS total_matches FROM recent WHERE message ILIKE '%took 1%' AND level = 'WARN'"
    ),
    "recent_traces": sql(
        f"""SELECT trace_id, max(ts) AS latest FROM recent WHERE {IS_ERROR}
        GROUP BY trace_id ORDER BY latest DESC, trace_id LIMIT 30"""
    ),
    "recent_problems": sql(
        f"""SELECT {SHOWN_LOG}, CAST(place AS INTEGER) AS place FROM (
          SELECT logs.*, row_number() OVER (PARTITION BY service ORDER BY ts DESC, span_id) AS place
          FROM logs, clock WHERE ts >= now - 216000 AND level IN ('ERROR', 'FATAL', 'WARN')) WHERE place <= 10"""
    ),
    "recent_logs": sql(f"SELECT {SHOWN_LOG} FROM logs ORDER BY ts DESC, span_id LIMIT 60"),
    "services": sql("SELECT DISTINCT service FROM logs"),
    "inserted_total": sql("SELECT count(*) AS total_inserted FROM logs"),
    "retention": sql("SELECT ts, span_id, service FROM logs, clock WHERE ts >= now - 432000"),
    "trace_summary": sql(f" {SHOWN_SUMMARY}", SUMMARY),
    "trace_waterfall": sql(
        f"""SELECT trace_id, span_id, service, {near('offset_ms')} AS offset_ms, {near('left_pct')} AS left_pct,
          {near('greatest(CAST(1.2 AS DOUBLE), least(100 - left_pct, latency_ms / total_ms * 100))')} AS width_pct
        FROM (
          SELECT l.trace_id, l.span_id, l.service, l.latency_ms, (ts - started) * 1000.0 AS offset_ms, total_ms,
            greatest(0, least(100, (ts - started) * 1000.0 / total_ms * 100)) AS left_pct
          FROM logs l JOIN (
            SELECT *, CASE WHEN round_even(duration_ms, 2) = 0 THEN 1 ELSE round_even(duration_ms, 2) END AS total_ms
            FROM summary) s ON s.trace_id = l.trace_id)""",
        SUMMARY,
    ),
    "trace_depth": sql(" SELECT span_id, depth FROM spans_depth", DEPTHS, recursive=True),
    "trace": sql(
        """ SELECT l.trace_id, l.span_id, l.service, l.parent_service, l.ts, l.latency_ms, l.level, d.depth, s.started,
          round(s.duration_ms, 2) AS duration_ms, s.services, s.has_errors
        FROM logs l JOIN spans_depth d USING (span_id) JOIN summary s USING (trace_id)
        WHERE l.trace_id = (SELECT trace_id FROM logs, clock WHERE ts >= now - 108000
          GROUP BY trace_id ORDER BY max(ts) DESC, trace_id LIMIT 1)""",
        DEPTHS,
        SUMMARY,
        recursive=True,
    ),
    "edge_counts": sql(
        """SELECT parent_service AS source, service AS target, count(*) AS calls FROM recent
        WHERE parent_service IS NOT NULL AND parent_service <> service GROUP BY parent_service, service"""
    ),
    "edge_ticks": sql(" SELECT source, target, tick_no, calls FROM calls", TICKS, CALLS),
    "neighbours": sql(
        """SELECT parent_service AS source, service AS target, count(*) AS calls,
          CASE WHEN service = 'catalog' THEN 'upstream' ELSE 'downstream' END AS direction
        FROM recent WHERE parent_service IS NOT NULL AND parent_service <> service
          AND (service = 'catalog' OR parent_service = 'catalog') GROUP BY parent_service, service"""
    ),
    "edge_weights": sql(
        f" SELECT tick_no, tick, source, target, {near('weight')} AS weight FROM weights", TICKS, WEIGHTS, recursive=True
    ),
    "graph_edges": sql(
        f"""SELECT tick_no, source, target, {near('weight / max(weight) OVER (PARTITION BY tick_no)')} AS weight
        FROM weights""",
        TICKS,
        WEIGHTS,
        recursive=True,
    ),
    "blast_radius": sql(
        """SELECT tick_no, source, service, CAST(min(hops) AS BIGINT) AS hops FROM reach GROUP BY tick_no, source, service""",
        TICKS,
        WEIGHTS,
        """
reach AS (
  SELECT DISTINCT tick_no, source, source AS service, 0 AS hops FROM weights WHERE weight >= 0.1
  UNION
  SELECT r.tick_no, r.source, w.target, r.hops + 1
  FROM reach r JOIN weights w ON w.tick_no = r.tick_no AND w.source = r.service AND w.weight >= 0.1
  WHERE r.hops < 4)""",
        recursive=True,
    ),
    "node_history": sql(
        f"""SELECT n.tick_no, m.service, {GROUP_CASE} AS grp, {near('logs_per_min')} AS logs_per_min,
          {near('error_rate')} AS error_rate, {near('mean_latency_ms')} AS mean_latency_ms, {near('health')} AS health
        FROM numbered n JOIN (
          SELECT *, coalesce(lead(tick_no) OVER (PARTITION BY service ORDER BY tick_no), CAST(1e15 AS BIGINT)) AS until
          FROM node_metrics) m ON n.tick_no >= m.tick_no AND n.tick_no < m.until""",
        TICKS,
        NODES,
    ),
    "graph_nodes": sql(
        f"""SELECT service, {GROUP_CASE} AS grp, {near('round_even(coalesce(logs_per_min, 0), 2)')} AS logs_per_min,
          {near('round_even(coalesce(error_rate, 0), 4)')} AS error_rate,
          {near('round_even(coalesce(mean_latency_ms, 0), 2)')} AS mean_latency_ms,
          {near('round_even(coalesce(health, 1), 3)')} AS health
        FROM (SELECT service, max(tick_no) AS tick_no FROM (
            SELECT service, tick_no FROM node_metrics
            UNION ALL SELECT source, NULL FROM calls UNION ALL SELECT target, NULL FROM calls) GROUP BY service) s
        LEFT JOIN node_metrics m USING (service, tick_no)""",
        TICKS,
        CALLS,
        NODES,
    ),
    "zscore_signals": sql(
        f""" SELECT tick_no, service, samples, {near('z_total')} AS z_total, {near('z_errors')} AS z_errors,
          {near('z_p95')} AS z_p95 FROM zs""",
        TICKS,
        ZSCORES,
    ),
    "rate_anomalies": sql(
        f""" SELECT tick_no, service, CAST(signal AS BIGINT) AS signal,
          {near('greatest(0, least(1, (z - t) / CAST(6 AS DOUBLE) + CAST(0.5 AS DOUBLE)))')} AS severity FROM signals""",
        TICKS,
        ZSCORES,
    ),
    "iforest_flag_counts": sql(
        " SELECT tick_no, count(*) AS services, true AS as_asked FROM ticks GROUP BY tick_no HAVING count(*) >= 6",
        TICKS,
    ),
    "anomaly_load": sql(
        """ SELECT n.tick_no, count(s.tick_no) AS anomalies_recent
        FROM numbered n LEFT JOIN signals s ON s.tick_no <= n.tick_no AND n.tick_no - s.tick_no <= 30 GROUP BY n.tick_no""",
        TICKS,
        ZSCORES,
    ),
    "steady_anomalies": sql(
        f""" SELECT tick_no, kind, service, {near('severity')} AS severity, description,
          array_to_string(blast, ',') AS blast_radius FROM hit""",
        TICKS, WEIGHTS, ZSCORES, RULES, dwell(), REACH, STEADY, recursive=True,
    ),
    "steady_members": sql(
        " SELECT tick_no, kind, service, ord_3, first_tick_no, first_service FROM members",
        TICKS, WEIGHTS, ZSCORES, RULES, dwell(), REACH, STEADY, FOLD, recursive=True,
    ),
    "steady_roots": sql(
        f" SELECT first_tick_no, service, reached_by, {near('score')} AS score, place FROM roots",
        TICKS, WEIGHTS, ZSCORES, RULES, dwell(), REACH, STEADY, FOLD, ROOTS, recursive=True,
    ),
    "rate_incidents": sql(
        f""" SELECT min(m.tick) AS started, max(m.tick) AS last_ts, {near('max(m.severity)')} AS severity,
          array_to_string(list_sort(list(DISTINCT m.service)), ',') AS services, any_value(i.impact) AS impact,
          count(*) AS anomaly_count, any_value(r.service) AS root_service,
          CASE WHEN count(DISTINCT m.service) <= 1 THEN concat(any_value(r.service), ' · ', any_value(t.kinds))
            ELSE concat(any_value(r.service), ' incident · ', count(DISTINCT m.service), ' services') END AS title
        FROM members m
        JOIN (SELECT joined, service FROM roots WHERE place = 1) r USING (joined)
        JOIN (SELECT joined, string_agg(service, ',' ORDER BY hops, service) AS impact FROM (
            SELECT m.joined, b.service, min(b.hops) AS hops FROM members m
            JOIN (SELECT tick_no, source, service, hops FROM reach WHERE hops <= 4
              UNION ALL SELECT tick_no, service, service, 0 FROM members) b
              ON b.tick_no = m.tick_no AND b.source = m.service GROUP BY m.joined, b.service) GROUP BY joined) i USING (joined)
        JOIN (SELECT joined, string_agg(concat(replace(kind, '_', ' '), '×', n), ', ' ORDER BY k) AS kinds FROM (
            SELECT joined, kind, count(*) AS n, min(k) AS k FROM members GROUP BY joined, kind) GROUP BY joined) t USING (joined)
        GROUP BY m.joined""",
        TICKS, WEIGHTS, ZSCORES, RULES, dwell(), REACH, STEADY, FOLD, ROOTS, recursive=True,
    ),
    # silent for at most 9, 22.5 and 172.5 ticks
    "steady_board": sql(
        f""", moments_at AS (
          SELECT (min(tick_no) + max(tick_no)) // 2 AS told FROM numbered UNION ALL SELECT max(tick_no) FROM numbered),
        shown AS (
          SELECT told, joined, min(tick) AS started, max(tick) AS last_ts, max(severity) AS severity, told - max(m.tick_no) AS silent,
            array_to_string(list_sort(list(DISTINCT service)), ',') AS services, count(*) AS anomaly_count
          FROM moments_at JOIN members m ON m.tick_no <= told GROUP BY told, joined),
        board AS (
          SELECT *, CASE WHEN silent <= 9 THEN 'active' WHEN silent <= 22 THEN 'resolving' ELSE 'resolved' END AS state
          FROM shown WHERE silent <= 172)
        SELECT told AS tick_no, state, started, last_ts, {near('severity')} AS severity, services, anomaly_count,
          state <> 'resolved' AND row_number() OVER (PARTITION BY told ORDER BY state = 'resolved', severity DESC, last_ts DESC) = 1 AS focus,
          count(*) FILTER (state <> 'resolved') OVER (PARTITION BY told) AS active_incidents
        FROM board""",
        TICKS, WEIGHTS, ZSCORES, RULES, dwell(), REACH, STEADY, FOLD, recursive=True,
    ),
    "steady_subgraph": sql(
        f""", near_to AS (
          SELECT m.joined, m.first_tick_no, b.service, min(b.hops) AS hops FROM members m
          JOIN (SELECT tick_no, source, service, hops FROM reach WHERE hops <= 4
            UNION ALL SELECT tick_no, service, service, 0 FROM members) b
            ON b.tick_no = m.tick_no AND b.source = m.service GROUP BY m.joined, m.first_tick_no, b.service),
        ends AS (
          SELECT n.*, n.service = r.service AS is_root, CASE WHEN n.hops > 0 THEN CAST(n.hops AS VARCHAR) END AS label
          FROM near_to n JOIN roots r ON r.joined = n.joined AND r.place = 1),
        edges AS (
          SELECT source, target, {near('round_even(weight / max(weight) OVER (), 3)')} AS weight FROM weights
          WHERE tick_no = (SELECT max(tick_no) FROM numbered))
        SELECT s.first_tick_no, e.source, e.target, e.weight, s.label AS source_label, t.label AS target_label,
          s.is_root AS source_is_root, t.is_root AS target_is_root
        FROM edges e JOIN ends s ON s.service = e.source JOIN ends t ON t.service = e.target AND t.joined = s.joined""",
        TICKS, WEIGHTS, ZSCORES, RULES, dwell(), REACH, STEADY, FOLD, ROOTS, recursive=True,
    ),
    "rule_eval": sql(
        f" SELECT rule_id, tick_no, service, {near('value')} AS value, entered_at, tick - entered_at AS dwell_s FROM dwells",
        TICKS,
        RULES,
        dwell(),
    ),
    "rule_firings": sql(FIRINGS, TICKS, RULES, dwell()),
    "rule_firings_by_service": sql(
        FIRINGS.replace("fired_count,", "fired_count AS nth,"), TICKS, RULES, dwell("t.service")
    ),
    "rule_firings_changed": sql(FIRINGS, TICKS, CHANGED_RULES, dwell()),
    "forecast": sql(
        f" SELECT tick_no, service, {near('mean')} AS forecast, {near('sqrt(variance)')} AS stddev FROM ewma",
        TICKS,
        EWMA,
        recursive=True,
    ),
    "forecast_now": sql(
        f"""SELECT service, {near('arg_max(mean, rn)')} AS forecast, {near('sqrt(arg_max(variance, rn))')} AS stddev
        FROM ewma GROUP BY service""",
        TICKS,
        EWMA,
        recursive=True,
    ),
    "correlation": sql(PAIRS, RATE_SERIES, STATS),
    "masked_messages": sql(" SELECT masked, n, first_ts, first_service FROM masks", MASKED),
    "templates": sql(
        " SELECT template_id, masked AS template, n AS count, first_ts, first_service FROM found", MASKED
    ),
    "template_total": sql(" SELECT count(*) AS templates_tracked FROM found", MASKED),
    "template_assignment": sql(
        " SELECT template_id, service, level, count(*) AS n FROM with_ids GROUP BY template_id, service, level", MASKED
    ),
    "template_explorer": sql(
        f""" SELECT *, {near('count / CAST(max(count) OVER () AS DOUBLE) * 100')} AS bar_pct FROM (
          SELECT template_id, arg_min(service, (ts, span_id)) AS service, {TEMPLATE_AGGS}
          FROM with_ids, clock WHERE ts >= now - 108000 GROUP BY template_id ORDER BY count DESC, template_id LIMIT 80)""",
        MASKED,
    ),
    "top_templates": sql(
        f""" SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY service ORDER BY count DESC, template_id) AS place FROM (
            SELECT service, template_id, {TEMPLATE_AGGS}
            FROM with_ids, clock WHERE ts >= now - 108000 GROUP BY service, template_id)) WHERE place <= 8""",
        MASKED,
    ),
    "new_templates": sql(
        """ SELECT CAST(floor(first_ts / 3600) AS BIGINT) + 1 AS tick_no, (floor(first_ts / 3600) + 1) * 3600 AS tick,
          template_id, first_service AS service FROM found, clock WHERE (floor(first_ts / 3600) + 1) * 3600 - started >= 45000""",
        MASKED,
    ),
    "kpi_counts": sql(
        f""" SELECT {near('count(*) / CAST(108000 AS DOUBLE)')} AS logs_per_sec,
          {near(f'CAST({ERRORS} AS DOUBLE) / greatest(count(*), 1)')} AS error_rate FROM bucketed""",
        BUCKET_SPINE,
    ),
    "service_metrics": sql(
        """ SELECT concat('signalgraph_service_logs_total{service="', service, '"} ', total) AS line FROM rates
        UNION ALL SELECT concat('signalgraph_service_error_rate{service="', service, '"} ', printf('%.4f', error_rate)) FROM rates
        UNION ALL SELECT concat('signalgraph_service_p95_latency_ms{service="', service, '"} ', printf('%.2f', p95)) FROM rates
        UNION ALL SELECT concat('signalgraph_total_inserted ', count(*)) FROM logs""",
        f" rates AS (SELECT service, {AGGS} FROM recent GROUP BY service) ",
    ),
    "line_service_rates": "WITH "
    + LINE_LOGS
    + ","
    + ticks(86400)
    + f" SELECT tick_no, tick, {SHOWN_RATES} FROM ticks",
    "line_edge_ticks": "WITH " + LINE_LOGS + "," + ticks(86400) + "," + CALLS + " SELECT source, target, tick_no, calls FROM calls",
    "line_trace_summary": "WITH " + LINE_LOGS + "," + SUMMARY + f" {SHOWN_SUMMARY}",
    "line_trace_depth": "WITH RECURSIVE "
    + LINE_LOGS
    + ","
    + DEPTHS
    + " SELECT service, CAST(depth AS INTEGER) AS depth, count(*) AS n FROM spans_depth GROUP BY service, depth",
    "stream_service_rates": sql(f" SELECT tick_no, tick, {SHOWN_RATES} FROM ticks", TICKS),
    "stream_forecast": sql(
        f""" SELECT e.tick_no, e.service, {near('z_total')} AS z_total, {near('z_errors')} AS z_errors, {near('z_p95')} AS z_p95,
          {near('mean')} AS forecast, {near('sqrt(variance)')} AS stddev
        FROM ewma e JOIN zs z ON z.tick_no = e.tick_no AND z.service = e.service""",
        TICKS,
        ZSCORES,
        EWMA,
        recursive=True,
    ),
    "stream_rate_anomalies": sql(
        f" SELECT tick_no, kind, service, {near('severity')} AS severity, description FROM hit WHERE kind = 'rate_spike'",
        TICKS, WEIGHTS, ZSCORES, RULES, dwell(), REACH, STEADY, recursive=True,
    ),
    "stream_rule_firings": sql(FIRINGS, TICKS, RULES, dwell()),
    "stream_edge_weights": sql(
        f""" SELECT tick_no, source, target, {near('weight')} AS weight FROM weights
        WHERE (tick_no, source, target) IN (SELECT (tick_no, source, target) FROM calls)""",
        TICKS,
        WEIGHTS,
        recursive=True,
    ),
    "stream_trace_summary": sql(f" {SHOWN_SUMMARY}", SUMMARY),
    "stream_trace_depth": sql(" SELECT span_id, depth FROM spans_depth", DEPTHS, recursive=True),
    "stream_rule_changes": sql(FIRINGS, TICKS, CHANGED_RULES, dwell()),
    "stream_graph": sql(
        f" SELECT tick_no, tick, source, target, {near('weight')} AS weight FROM weights", TICKS, WEIGHTS, recursive=True
    ),
    "stream_blast_radius": sql(
        """ SELECT tick_no, source, service, CAST(min(hops) AS BIGINT) AS hops FROM reach WHERE hops <= 4
        GROUP BY tick_no, source, service""",
        TICKS, WEIGHTS, REACH, recursive=True,
    ),
    "stream_correlation": sql(
        f""" SELECT CAST(a.m * 5400 AS DOUBLE) AS moment, a.service AS service_a, b.service AS service_b,
          {near("""CASE WHEN sa.s < 1e-9 OR sb.s < 1e-9 THEN CASE WHEN a.service = b.service THEN 1.0 ELSE 0.0 END
            ELSE greatest(-1, least(1, avg((a.rate - sa.m) * (b.rate - sb.m)) / (sa.s * sb.s))) END""")} AS corr
        FROM dense a JOIN dense b ON a.m = b.m AND a.bucket = b.bucket
        JOIN stats sa ON sa.at = a.m AND sa.service = a.service JOIN stats sb ON sb.at = b.m AND sb.service = b.service
        GROUP BY a.m, a.service, b.service, sa.s, sb.s""",
        MOMENTS,
    ),
    "stream_incidents": sql(
        " SELECT tick_no, kind, service, ord_3, first_tick_no, first_service FROM members",
        TICKS, WEIGHTS, ZSCORES, RULES, dwell(), REACH, STEADY, FOLD, recursive=True,
    ),
    # silent for more than 9, 22.5 and 172.5 ticks
    "stream_incident_states": sql(
        """ SELECT s.tick_no, s.state, f.tick_no AS first_tick_no, f.kind AS first_kind, f.service AS first_service, f.ord_3 AS first_3
        FROM states s JOIN hit f ON f.k = s.joined WHERE s.tick_no <= (SELECT max(tick_no) FROM numbered)""",
        TICKS, WEIGHTS, ZSCORES, RULES, dwell(), REACH, STEADY, FOLD, STATES, recursive=True,
    ),
    "stream_seconds": sql(
        f""" SELECT CAST(floor(ts / 1800) AS BIGINT) * 1800000000 AS start_us, count(*) AS total, {ERRORS} AS errors, {WARNS} AS warns
        FROM logs GROUP BY floor(ts / 1800)"""
    ),
    "conversation_templates": mined(
        """SELECT CAST(turn AS DOUBLE) AS ts, concat(CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS span, role AS service, text AS message
        FROM conversations"""
    ),
    "document_templates": mined(DOCUMENT_LINES),
    "document_new_templates": mined(DOCUMENT_LINES, NEW_TEMPLATES),
    "stream_new_templates": mined(DOCUMENT_LINES, NEW_TEMPLATES),
    "document_masks": f"""
      SELECT md5(masked) AS masked_md5, count(*) AS n, CAST(min(doc_id) AS DOUBLE) AS first_ts
      FROM (
        SELECT doc_id, trim(regexp_replace(
          regexp_replace(line, '{PARAMETER_PATTERN}', '<*>', 'g'), '{BLANKS}', ' ', 'g')) AS masked
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
      GROUP BY masked""",
    "service_detail_core": sql(
        f"""SELECT r.service, {GROUP_CASE.replace('CASE service', 'CASE r.service')} AS grp,
          {near('round_even(r.total / (CAST(108000 AS DOUBLE) / 60), 2)')} AS logs_per_min,
          {near('round_even(r.error_rate, 4)')} AS error_rate,
          {near('round_even(f.mean, 4)')} AS forecast_error_rate, {near('round_even(f.stddev, 4)')} AS forecast_stddev,
          CAST(60 AS BIGINT) AS points, t.templates, coalesce(p.problems, 0) AS problems
        FROM (SELECT service, {AGGS} FROM recent GROUP BY service) r
        JOIN (SELECT service, arg_max(mean, rn) AS mean, sqrt(arg_max(variance, rn)) AS stddev FROM ewma GROUP BY service) f
          USING (service)
        JOIN (SELECT service, least(8, count(DISTINCT template_id)) AS templates FROM with_ids, clock
              WHERE ts >= now - 108000 GROUP BY service) t USING (service)
        LEFT JOIN (SELECT service, least(10, count(*)) AS problems FROM logs, clock
              WHERE ts >= now - 216000 AND level IN ('ERROR', 'FATAL', 'WARN') GROUP BY service) p USING (service)""",
        TICKS,
        EWMA,
        MASKED,
        recursive=True,
    ),
}
