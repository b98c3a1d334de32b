"""The same queries as DuckDB SQL over the driver tables."""

from __future__ import annotations

from .registry import CONFIG, IP_PATTERN

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US

EV = r"""
base AS (
  SELECT event_id AS seq, ts, 'svc-' || (user_id % 3)::VARCHAR AS source,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END AS level,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'Ledger write refused'
         WHEN event_type = 'error' THEN 'Thumbnail job gave up'
         WHEN event_type = 'signup' THEN 'Door code rejected'
         WHEN event_type = 'purchase' THEN 'Basket paid'
         WHEN event_type = 'view' THEN 'Shelf opened' ELSE 'Tile served' END AS msg,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'waited'
         WHEN event_type = 'error' THEN 'asset' WHEN event_type = 'click' THEN 'tile'
         WHEN event_type = 'signup' THEN 'door'
         WHEN event_type = 'purchase' THEN 'cents' ELSE 'shopper' END AS k,
    CASE WHEN (event_type = 'error' AND event_id % 2 = 0) OR event_type = 'purchase'
              THEN round(value * 100)::BIGINT::VARCHAR
         WHEN event_type = 'error' THEN 'asset_' || user_id::VARCHAR
         WHEN event_type = 'click' THEN 'tile_page_' || user_id::VARCHAR
         WHEN event_type = 'signup' THEN '10.7.0.' || (user_id % 255)::VARCHAR
         ELSE user_id::VARCHAR END AS v,
    strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S.%f') AS t
  FROM events),
ev AS (SELECT source, seq, ts, level, msg || ' | ' || k || '=' || v AS message FROM base),
mixed AS (
  SELECT source || '-' || (seq % 5)::VARCHAR AS source, seq,
  CASE seq % 5
    WHEN 0 THEN 'time="' || d || 'T' || t || 'Z" level=' || lower(level) || ' msg="' || msg || '" ' || k || '=' || v
    WHEN 1 THEN d || ' ' || t || ' [' || level || '] ' || msg || ' | ' || k || '=' || v
    WHEN 2 THEN '{"time":"' || d || 'T' || t || 'Z","level":"' || lower(level) || '","msg":"' || msg || '","' || k || '":"' || v || '"}'
    WHEN 3 THEN d || ' ' || t || ' ' || level || ' ' || msg || ' | ' || k || '=' || v
    ELSE '{"log":"time=\"' || d || 'T' || t || 'Z\" level=' || lower(level) || ' msg=\"' || msg || '\" ' || k || '=' || v || '\n","stream":"stdout","time":"' || d || 'T' || t || 'Z"}'
  END AS line FROM base)"""


def ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def us(c: str) -> str:
    return f"strftime(make_timestamp({c}), '%Y-%m-%d %H:%M:%S.%f')"


def fp(c: str) -> str:
    return (f"regexp_replace({c}, '(^|[^A-Za-z0-9])(?:([0-9][xX])[0-9A-Fa-f]*|[0-9]+)', "
            r"'\1\2*', 'g')")


def with_ev(body: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{EV}{more} {body}"


EVENT = f"source, seq, {ts('ts')} AS ts, level, message"
SIG = "level IN ('ERROR', 'WARN')"

TICKS = f""",
ticks AS (SELECT source, epoch_us(ts) // {HOUR_US} AS idx,
                 count(*) FILTER (level = 'ERROR') AS errors,
                 count(*) FILTER (level = 'WARN') AS warns
          FROM ev GROUP BY ALL),
ends AS (SELECT source, min(idx) AS lo, max(idx) AS hi FROM ticks GROUP BY source),
rates AS (
  SELECT t.source, t.idx, t.errors, t.warns, t.idx - e.lo AS age,
    sum(errors) OVER r / least(60, t.idx - e.lo + 1) AS eps,
    sum(warns) OVER r / least(60, t.idx - e.lo + 1) AS wps,
    coalesce(sum(errors) OVER p, 0) / greatest(least(60, t.idx - e.lo), 1) AS last_eps,
    coalesce(sum(warns) OVER p, 0) / greatest(least(60, t.idx - e.lo), 1) AS last_wps,
    coalesce(sum(errors) OVER one, 0) AS last_errors,
    max(errors) OVER u AS peak_eps, max(warns) OVER u AS peak_wps,
    coalesce(max(errors) OVER b, 0) AS last_peak_eps, coalesce(max(warns) OVER b, 0) AS last_peak_wps
  FROM ticks t JOIN ends e USING (source)
  WINDOW r AS (PARTITION BY t.source ORDER BY t.idx RANGE BETWEEN 59 PRECEDING AND CURRENT ROW),
         p AS (PARTITION BY t.source ORDER BY t.idx RANGE BETWEEN 60 PRECEDING AND 1 PRECEDING),
         one AS (PARTITION BY t.source ORDER BY t.idx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING),
         u AS (PARTITION BY t.source ORDER BY t.idx ROWS UNBOUNDED PRECEDING),
         b AS (PARTITION BY t.source ORDER BY t.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

PATTERNS = f""",
vars AS (SELECT source, message, {fp('message')} AS pattern, count(*) AS count,
                min(seq) AS first_seq, max(seq) AS last_seq, arg_max(ts, seq) AS last_ts,
                arg_min(level, seq) AS level
         FROM ev WHERE {SIG} GROUP BY source, message),
pats AS (SELECT source, pattern, arg_min(level, first_seq) AS level, sum(count)::BIGINT AS count,
                min(first_seq) AS first_seq, arg_max(last_ts, last_seq) AS last_ts
         FROM vars GROUP BY source, pattern)"""


def heart(width: int) -> str:
    return f""",
hm AS (SELECT source, epoch_us(ts) // {width} AS w, CASE WHEN {SIG} THEN message END AS message,
         count(*) AS n, count(*) FILTER (level = 'ERROR') AS e, count(*) FILTER (level = 'WARN') AS wn,
         count(*) FILTER (level = 'INFO') AS i, arg_max(level, seq) AS lv FROM ev GROUP BY ALL),
ht AS (SELECT source, w, '[' || lv || '] ' || message || ' (' || n || ' times)' AS issue
       FROM hm WHERE message IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY source, w ORDER BY lv <> 'ERROR', n DESC, message) = 1),
hb AS (SELECT h.source, h.w, sum(e)::BIGINT AS errors, sum(wn)::BIGINT AS warns, sum(i)::BIGINT AS infos,
              coalesce(any_value(ht.issue), 'None (0 times)') AS top_issue
       FROM hm h LEFT JOIN ht ON ht.source = h.source AND ht.w = h.w GROUP BY h.source, h.w)"""


def recent(width: int) -> str:
    return f""",
rv AS (SELECT source, epoch_us(ts) // {width} AS w, message, {fp('message')} AS pattern, count(*) AS n,
              min(seq) AS fs, arg_min(level, seq) AS lv FROM ev WHERE {SIG} GROUP BY ALL),
rb AS (SELECT source, w, pattern, message FROM rv
       QUALIFY row_number() OVER (PARTITION BY source, w, pattern ORDER BY n DESC, message) = 1),
rp AS (SELECT source, w, pattern, sum(n)::BIGINT AS n, arg_min(lv, fs) AS lv FROM rv GROUP BY ALL),
rk AS (SELECT rp.*, rb.message, row_number() OVER (PARTITION BY rp.source, rp.w, rp.lv
              ORDER BY rp.n DESC, rp.pattern) AS r
       FROM rp JOIN rb USING (source, w, pattern)),
rs AS (SELECT source, w,
   coalesce(string_agg('- ' || message || ' (' || n || ' hits)' || chr(10), '' ORDER BY r)
            FILTER (lv = 'ERROR'), 'No new errors.') AS errors,
   coalesce(string_agg('- ' || message || ' (' || n || ' hits)' || chr(10), '' ORDER BY r)
            FILTER (lv = 'WARN'), 'No new warnings.') AS warns
  FROM rk WHERE r <= 3 GROUP BY source, w)"""


RULES = TICKS + f""",
rules AS (
  SELECT *, age >= 1 AND last_eps >= {CONFIG.eps_critical} AS critical,
    age >= 1 AND last_eps < {CONFIG.eps_critical} AND last_errors >= {CONFIG.eps_warn}
      AND last_errors > 3 * last_eps AS spike,
    age >= 1 AND last_eps < {CONFIG.eps_warn} AND last_wps < {CONFIG.eps_warn} AS recovered
  FROM rates),
reset AS (SELECT *, sum(recovered::INT) OVER (PARTITION BY source ORDER BY idx) AS rc FROM rules),
hits AS (SELECT e.*, r.critical, r.rc, r.idx, r.last_peak_eps, r.last_peak_wps
         FROM ev e JOIN reset r ON r.source = e.source AND r.idx = epoch_us(e.ts) // {HOUR_US}
         WHERE {SIG} AND (r.critical OR r.spike)),
cand AS (SELECT source, epoch_us(ts) AS t, min(seq) AS trigger_seq, arg_min(level, seq) AS level,
           any_value(rc) AS rc, any_value(idx) AS idx, any_value(last_peak_eps) AS peak_eps,
           any_value(last_peak_wps) AS peak_wps,
           CASE WHEN any_value(critical) THEN {6 * HOUR_US} ELSE {24 * HOUR_US} END AS cool
         FROM hits GROUP BY source, epoch_us(ts)),
walk AS (
  (SELECT source, t, rc, NULL::BIGINT AS last, FALSE AS after_recovery FROM cand
   QUALIFY row_number() OVER (PARTITION BY source ORDER BY t) = 1)
  UNION ALL
  (SELECT source, t, rc, last, after_recovery FROM (
     SELECT c.source, c.t, c.rc, CASE WHEN c.rc > g.rc THEN NULL ELSE g.t END AS last,
            c.rc > g.rc AS after_recovery,
            row_number() OVER (PARTITION BY c.source ORDER BY c.t) AS rn
     FROM walk g JOIN cand c ON c.source = g.source AND c.t > g.t
      AND (c.rc > g.rc OR c.t - g.t >= c.cool)) WHERE rn = 1)),
inc AS (SELECT w.source, w.t, w.last, w.after_recovery, c.trigger_seq, c.level, c.peak_eps, c.peak_wps, c.idx
        FROM walk w JOIN cand c USING (source, t)),
isig AS (SELECT * FROM (
           SELECT i.source, i.t, i.last, e.seq, e.ts, e.level, e.message,
             row_number() OVER (PARTITION BY i.source, i.t ORDER BY e.seq DESC) AS rn
           FROM inc i JOIN ev e ON e.source = i.source AND e.seq <= i.trigger_seq AND e.{SIG})
         WHERE rn <= {CONFIG.signal_rows} AND (last IS NULL OR epoch_us(ts) > last)),
ictx AS (SELECT i.source, i.t, e.seq, e.ts, e.level, e.message
         FROM inc i JOIN ev e ON e.source = i.source AND e.seq <= i.trigger_seq
         QUALIFY row_number() OVER (PARTITION BY i.source, i.t ORDER BY e.seq DESC) <= {CONFIG.context_rows}),
heads AS (SELECT i.source, i.t, 'incident_' || strftime(make_timestamp(i.t), '%Y-%m-%d_%H-%M-%S') AS incident_id,
            'Anomaly: ' || i.level || ' Spike Detected' AS reason,
            i.peak_eps::DOUBLE AS peak_eps, i.peak_wps::DOUBLE AS peak_wps,
            (SELECT count(*) FROM ev e WHERE e.source = i.source AND e.seq <= i.trigger_seq) AS total_lines,
            strftime(coalesce(make_timestamp(i.last), (SELECT arg_min(e.ts, e.seq) FROM ev e WHERE e.source = i.source)),
                     '%Y-%m-%dT%H:%M:%SZ') AS started_at,
            strftime(make_timestamp(i.t), '%Y-%m-%dT%H:%M:%SZ') AS ended_at
          FROM inc i)"""

THROTTLE = f""",
sig AS (SELECT ts, seq, source, level, message FROM ev WHERE {SIG}),
pick AS (SELECT min(ts) AS ts FROM sig
         UNION ALL
         SELECT (SELECT min(s.ts) FROM sig s WHERE s.ts > p.ts + INTERVAL 1 HOUR) FROM pick p
         WHERE p.ts IS NOT NULL),
taken AS (SELECT s.* FROM sig s JOIN pick p ON s.ts = p.ts
          QUALIFY row_number() OVER (PARTITION BY s.ts ORDER BY s.seq, s.source) = 1),
keyed AS (SELECT *, CASE WHEN level = 'WARN' THEN 'W' ELSE 'E' END AS k FROM taken),
note AS (SELECT k, min(ts) AS ts FROM keyed GROUP BY k
         UNION ALL
         SELECT k, ts FROM (SELECT c.k, c.ts, row_number() OVER (PARTITION BY c.k ORDER BY c.ts) AS rn
                            FROM note n JOIN keyed c ON c.k = n.k AND c.ts >= n.ts + INTERVAL 2 HOUR)
         WHERE rn = 1)"""

ALERTS = TICKS + THROTTLE + f""",
al AS (SELECT c.ts, c.source, c.seq, c.level, c.message,
         CASE WHEN n.ts IS NULL THEN 'LOGGED' ELSE 'NOTIFIED' END AS status,
         n.ts IS NOT NULL AND c.level = 'ERROR' AND r.last_eps >= {CONFIG.alert_eps} AS push
       FROM keyed c LEFT JOIN note n ON n.k = c.k AND n.ts = c.ts
       JOIN rates r ON r.source = c.source AND r.idx = epoch_us(c.ts) // {HOUR_US})"""

HEALTH = """CASE WHEN eps >= 5 THEN 'CRITICAL SPIKE' WHEN eps >= 1 THEN 'Unstable' WHEN eps >= 0.1 THEN 'Minor Issues'
  WHEN wps >= 200 THEN 'Pre-Incident Warning' WHEN wps >= 100 THEN 'Suspicious Activity'
  WHEN wps >= 50 THEN 'Pressure Building' WHEN eps < 0.01 AND wps < 0.01 THEN 'IDLE' ELSE 'HEALTHY' END"""

TREND = TICKS + """,
frame AS (SELECT source, unnest(range(greatest(lo, hi - 59), hi + 1)) AS idx FROM ends),
trend AS (SELECT f.source, f.idx, coalesce(t.errors, 0) AS errors, coalesce(t.warns, 0) AS warns
          FROM frame f LEFT JOIN ticks t ON t.source = f.source AND t.idx = f.idx)"""

SPACE = (r"[\x{9}\x{A}\x{B}\x{C}\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

# What a stream has emitted at the end of its input: windows that ended before the watermark.
PARSED = with_ev(f"SELECT {EVENT} FROM ev")


TICK = us(f"idx * {HOUR_US}")
STREAM_TICKS = with_ev(f"SELECT source, {TICK} AS tick, errors, warns FROM ticks", TICKS)
STREAM_HEART = with_ev(f"""SELECT source, {us(f'w * {DAY_US}')} AS window_start, errors, warns, infos, top_issue
    FROM hb""", heart(DAY_US))
STREAM_INCIDENTS = with_ev(f"""SELECT source, {us('t')} AS incident_ts, level, {us('last')} AS window_start,
    after_recovery, peak_eps::DOUBLE AS peak_eps, peak_wps::DOUBLE AS peak_wps FROM inc""", RULES, True)


def oracle_sql() -> dict[str, str]:
    tick = TICK
    return {
        "scan_lines": with_ev("SELECT source, line FROM mixed"),
        "multi_source": with_ev("SELECT source, count(*) AS lines FROM mixed GROUP BY source"),
        "detect_format": with_ev(
            "SELECT DISTINCT source, CASE WHEN seq % 5 IN (2, 4) THEN 'json' ELSE 'text' END AS format FROM mixed"),
        "clean_line": f"""
            WITH rows AS (
              SELECT 'd' || doc_id AS id, chr(9) || chr(13) || chr(10) || chr(160) || ' ' || text || ' '
                     || chr(8195) || chr(9) || chr(13) || chr(10) AS text FROM documents
              UNION ALL SELECT 'p' || page_id, html FROM pages),
            c AS (SELECT id, regexp_replace(regexp_replace(
                    replace(replace(text, chr(9), ' '), chr(13), ''), '^{SPACE}+', ''), '{SPACE}+$', '') AS x FROM rows)
            SELECT id, length(x) AS n, md5(x) AS digest FROM c""",
        "parse_logfmt": PARSED, "parse_bracket": PARSED, "parse_simple": PARSED,
        "parse_json": PARSED, "parse_docker": PARSED,
        "parse_all": with_ev(f"SELECT source || '-' || (seq % 5) AS source, seq, {ts('ts')} AS ts, level, message FROM ev"),
        "parse_json_extras": """
            WITH x AS (SELECT event_id, event_type, 'err=' || event_type || ' | none=null | ok=true | props={"k":'
                       || (props->>'k') || '} | user=' || user_id AS extras FROM events)
            SELECT event_id, extras, event_type || ' | ' || extras AS message FROM x""",
        "parse_ts": with_ev(f"""
            SELECT seq, form, CASE WHEN form < 4 THEN {ts('ts')} END AS ts
            FROM ev, (SELECT unnest(range(7)) AS form)"""),
        "signals": with_ev(f"SELECT {EVENT} FROM ev WHERE {SIG}"),
        "min_level": with_ev(f"SELECT {EVENT} FROM ev WHERE level IN ('INFO', 'WARN', 'ERROR')"),
        "search_logs": with_ev(f"""SELECT {EVENT} FROM ev WHERE level = 'WARN'
            AND contains(lower(message), 'code rejected | door') ORDER BY ts DESC, source, seq DESC LIMIT 500"""),
        "filter_logs": with_ev(f"""SELECT {EVENT} FROM ev
            WHERE contains(lower(message), 'error') OR contains(lower(level), 'error')"""),
        "by_source": with_ev("SELECT source AS name, source, seq, message FROM ev WHERE source = 'svc-1'"),
        "format_events": with_ev("""SELECT source, seq, '[' || strftime(ts, '%H:%M:%S') || '] '
            || rpad(level, greatest(5, length(level)::INT), ' ') || ' -> ' || message AS text FROM ev"""),
        "truncate": """SELECT doc_id, CASE WHEN length(text) > 90 THEN substr(text, 1, 87) || '...' ELSE text END AS short
            FROM documents""",
        "age_label": with_ev("""
            SELECT seq, CASE WHEN a < 1000000 THEN '< 1s ago' WHEN a < 60000000 THEN (a // 1000000) || 's ago'
              WHEN a < 3600000000 THEN (a // 60000000) || 'm ' || (a // 1000000 % 60) || 's ago'
              ELSE (a // 3600000000) || 'h ago' END AS age
            FROM (SELECT seq, epoch_us(max(ts) OVER ()) - epoch_us(ts) AS a FROM ev)"""),
        "fingerprint": with_ev(f"SELECT seq, {fp('message')} AS pattern FROM ev"),
        "fingerprint_docs": f"SELECT doc_id, md5({fp('text')}) AS digest FROM documents",
        "patterns": with_ev(f"SELECT source, pattern, level, count, first_seq, {ts('last_ts')} AS last_ts FROM pats", PATTERNS),
        "variants": with_ev(f"SELECT source, pattern, message, count, first_seq, {ts('last_ts')} AS last_ts FROM vars", PATTERNS),
        "top_patterns": f"""
            WITH {EV}, mev AS (SELECT source || '-' || (seq % 5) AS source, seq, ts, level, message FROM ev)
            SELECT source, pattern, arg_min(level, seq) AS level, count(*) AS count
            FROM (SELECT *, {fp('message')} AS pattern FROM mev WHERE {SIG}) GROUP BY source, pattern""",
        "representative": with_ev("""SELECT source, pattern, message, count FROM vars
            QUALIFY row_number() OVER (PARTITION BY source, pattern ORDER BY count DESC, message) = 1""", PATTERNS),
        "pattern_cap": with_ev(f"""SELECT source, pattern, level, count, first_seq, {ts('last_ts')} AS last_ts FROM pats
            QUALIFY row_number() OVER (PARTITION BY source ORDER BY first_seq) <= 2""", PATTERNS),
        "variant_times": with_ev(f"""
            SELECT e.source, v.pattern, e.message,
                   row_number() OVER (PARTITION BY e.source, e.message ORDER BY e.seq DESC) AS rank, {ts('e.ts')} AS ts
            FROM ev e JOIN (SELECT * FROM vars QUALIFY row_number() OVER
                 (PARTITION BY source, pattern ORDER BY first_seq) <= 50) v
              ON v.source = e.source AND v.message = e.message
            WHERE e.{SIG} QUALIFY rank <= 20""", PATTERNS),
        "pattern_times": with_ev(f"""
            SELECT source, pattern, string_agg({ts('ts')}, ',' ORDER BY seq) AS times FROM (
              SELECT source, {fp('message')} AS pattern, seq, ts FROM ev WHERE {SIG}
              QUALIFY row_number() OVER (PARTITION BY source, pattern ORDER BY seq DESC) <= 100)
            GROUP BY source, pattern"""),
        "inspect": with_ev(f"""
            SELECT v.source, v.pattern, p.level, p.count AS total, v.message, v.count, h.times
            FROM vars v JOIN pats p USING (source, pattern)
            LEFT JOIN (SELECT source, message, string_agg({ts('ts')}, ',' ORDER BY seq DESC) AS times FROM (
                 SELECT e.source, e.message, e.seq, e.ts FROM ev e JOIN (SELECT * FROM vars QUALIFY row_number() OVER
                   (PARTITION BY source, pattern ORDER BY first_seq) <= 50) t
                   ON t.source = e.source AND t.message = e.message WHERE e.{SIG}
                 QUALIFY row_number() OVER (PARTITION BY e.source, e.message ORDER BY e.seq DESC) <= 20)
               GROUP BY source, message) h ON h.source = v.source AND h.message = v.message
            WHERE v.pattern = '{IP_PATTERN}'""", PATTERNS),
        "variant_list": with_ev(f"""SELECT source, message, count, {ts('last_ts')} AS last_ts FROM vars
            WHERE pattern = '{IP_PATTERN}'""", PATTERNS),
        "recent_summary": with_ev(f"SELECT source, {us(f'w * {DAY_US}')} AS window_start, errors, warns FROM rs", recent(DAY_US)),
        "totals": with_ev("SELECT source, count(*) AS total_lines FROM ev GROUP BY source"),
        "level_counts": with_ev("SELECT source, level, count(*) AS count FROM ev GROUP BY source, level"),
        "level_pivot": with_ev("""SELECT source, count(*) AS total_lines, count(*) FILTER (level = 'ERROR') AS error,
            count(*) FILTER (level = 'WARN') AS warn, count(*) FILTER (level = 'INFO') AS info,
            count(*) FILTER (level = 'DEBUG') AS debug FROM ev GROUP BY source"""),
        "last_seen": with_ev(f"""SELECT source, {ts("arg_max(ts, seq) FILTER (level = 'ERROR')")} AS last_error_ts,
            {ts("arg_max(ts, seq) FILTER (level = 'WARN')")} AS last_warn_ts FROM ev GROUP BY source"""),
        "top_issue": with_ev(f"SELECT source, {us(f'w * {HOUR_US}')} AS window_start, top_issue FROM hb", heart(HOUR_US)),
        "heartbeat": with_ev(f"""SELECT source, {us(f'w * {DAY_US}')} AS window_start, errors, warns, infos, top_issue,
            'HEARTBEAT [' || strftime(make_timestamp(w * {DAY_US}), '%H:%M') || ']' || chr(10) || 'Duration: 24h0m0s' || chr(10)
            || 'Errors: ' || errors || ' | Warns: ' || warns || ' | Info: ' || infos || chr(10)
            || 'Top Issue: ' || top_issue || chr(10) AS report FROM hb""", heart(DAY_US)),
        "snapshot": with_ev(f"""
            , lv AS (SELECT source, count(*) AS total_lines, count(*) FILTER (level = 'ERROR') AS error,
                     count(*) FILTER (level = 'WARN') AS warn, count(*) FILTER (level = 'INFO') AS info,
                     count(*) FILTER (level = 'DEBUG') AS debug FROM ev GROUP BY source),
            ls AS (SELECT source, {ts("arg_max(ts, seq) FILTER (level = 'ERROR')")} AS last_error_ts,
                     {ts("arg_max(ts, seq) FILTER (level = 'WARN')")} AS last_warn_ts FROM ev GROUP BY source),
            cur AS (SELECT source, eps, wps, peak_eps::DOUBLE AS peak_eps, peak_wps::DOUBLE AS peak_wps FROM rates
                    QUALIFY row_number() OVER (PARTITION BY source ORDER BY idx DESC) = 1),
            tr AS (SELECT source, string_agg(errors::VARCHAR, ',' ORDER BY idx) AS trend_error,
                     string_agg(warns::VARCHAR, ',' ORDER BY idx) AS trend_warn FROM trend GROUP BY source)
            SELECT source, total_lines, error, warn, info, debug, last_error_ts, last_warn_ts, round(eps, 6) AS eps, round(wps, 6) AS wps,
              peak_eps, peak_wps, {HEALTH} AS status, trend_error, trend_warn
            FROM lv JOIN ls USING (source) JOIN cur USING (source) JOIN tr USING (source)""", TREND),
        "situation_report": with_ev(f"""
            , wend AS (SELECT s.source, s.w, s.errors AS et, s.warns AS wt, s.w * 24 + 23 AS idx FROM rs s),
            x AS (SELECT a.source, a.w, a.et, a.wt,
               (SELECT sum(errors) FROM ticks t WHERE t.source = a.source AND t.idx BETWEEN a.idx - 59 AND a.idx)
                 / least(60, a.idx - e.lo + 1) AS eps,
               (SELECT sum(warns) FROM ticks t WHERE t.source = a.source AND t.idx BETWEEN a.idx - 59 AND a.idx)
                 / least(60, a.idx - e.lo + 1) AS wps,
               (SELECT max(errors) FROM ticks t WHERE t.source = a.source AND t.idx <= a.idx)::DOUBLE AS peak_eps,
               (SELECT max(warns) FROM ticks t WHERE t.source = a.source AND t.idx <= a.idx)::DOUBLE AS peak_wps
              FROM wend a JOIN ends e USING (source))
            SELECT source, {us(f'w * {DAY_US}')} AS window_start, round(eps, 6) AS eps, peak_eps, round(wps, 6) AS wps, peak_wps,
              format('[TELEMETRY]' || chr(10) || '- Errors/sec: {{:.2f}} avg | {{:.1f}} peak' || chr(10)
                || '- Warns/sec:  {{:.2f}} avg | {{:.1f}} peak' || chr(10) || chr(10), round(eps, 9), peak_eps, round(wps, 9), peak_wps)
              || '[ERROR PATTERNS]' || chr(10) || et || chr(10) || chr(10) || '[WARNING PATTERNS]' || chr(10) || wt AS report
            FROM x""", TICKS + recent(DAY_US)),
        "ticks": with_ev(f"SELECT source, {tick} AS tick, errors, warns FROM ticks", TICKS),
        "trend": with_ev(f"SELECT source, {tick} AS tick, errors, warns FROM trend", TREND),
        "rolling_rate": with_ev(f"SELECT source, {tick} AS tick, round(eps, 6) AS eps, round(wps, 6) AS wps FROM rates", TICKS),
        "running_peak": with_ev(f"SELECT source, {tick} AS tick, peak_eps::DOUBLE AS peak_eps, peak_wps::DOUBLE AS peak_wps FROM rates", TICKS),
        "peak_rate": with_ev("SELECT source, max(errors)::DOUBLE AS peak_eps, max(warns)::DOUBLE AS peak_wps FROM ticks GROUP BY source", TICKS),
        "status": with_ev(f"SELECT source, {tick} AS tick, round(eps, 6) AS eps, round(wps, 6) AS wps, {HEALTH} AS status FROM rates", TICKS),
        "normalize_trend": with_ev(f"""
            , lg AS (SELECT source, idx, ln(1 + errors) AS x FROM trend),
            mm AS (SELECT *, max(x) OVER (PARTITION BY source) AS mx, min(x) OVER (PARTITION BY source) AS mn FROM lg),
            fl AS (SELECT *, CASE WHEN mx - mn < 0.01 THEN 0 ELSE mn END AS lo,
                     CASE WHEN mx - mn >= 0.01 THEN mx - mn WHEN mx = 0 THEN 1 ELSE mx END AS span FROM mm)
            SELECT source, {tick} AS tick, round((x - lo) / span, 6) AS scaled, round(exp(mx) - 1)::BIGINT AS axis_max,
              round(exp(lo) - 1)::BIGINT AS axis_min FROM fl""", TREND),
        "spike_candidates": with_ev(f"""SELECT source, seq, {ts('ts')} AS ts, level, message,
            CASE WHEN critical THEN 'critical' ELSE 'spike' END AS rule FROM hits""", RULES, True),
        "incidents": with_ev(f"""SELECT source, {us('t')} AS incident_ts, trigger_seq, level, {us('last')} AS window_start,
            after_recovery, peak_eps::DOUBLE AS peak_eps, peak_wps::DOUBLE AS peak_wps FROM inc""", RULES, True),
        "incident_signals": with_ev(f"SELECT source, {us('t')} AS incident_ts, seq, {ts('ts')} AS ts, level, message FROM isig", RULES, True),
        "incident_context": with_ev(f"SELECT source, {us('t')} AS incident_ts, seq, {ts('ts')} AS ts, level, message FROM ictx", RULES, True),
        "incident_reports": with_ev(f"""
            , tr AS (SELECT source, t, string_agg(coalesce(errors, 0)::VARCHAR, ',' ORDER BY fx) AS hourly_trend_errors,
                       string_agg(coalesce(warns, 0)::VARCHAR, ',' ORDER BY fx) AS hourly_trend_warns
                     FROM (SELECT f.source, f.t, f.fx, k.errors, k.warns
                           FROM (SELECT i.source, i.t, unnest(range(greatest(e.lo, i.idx - 48), i.idx)) AS fx
                                 FROM inc i JOIN ends e USING (source)) f
                           LEFT JOIN ticks k ON k.source = f.source AND k.idx = f.fx) GROUP BY source, t),
            sg AS (SELECT source, t, count(*) AS n_signals, string_agg(message, ',' ORDER BY seq) AS signal_messages FROM isig GROUP BY source, t),
            cx AS (SELECT source, t, count(*) AS n_context FROM ictx GROUP BY source, t)
            SELECT source, {us('t')} AS incident_ts, incident_id, reason, peak_eps, peak_wps, total_lines, started_at, ended_at,
              hourly_trend_errors, hourly_trend_warns, n_signals, n_context, signal_messages
            FROM heads JOIN tr USING (source, t) JOIN sg USING (source, t) JOIN cx USING (source, t)""", RULES, True),
        "incident_list": with_ev("""SELECT incident_id || '.json' AS filename,
            replace(replace(incident_id, 'incident_', ''), '_', ' ') AS timestamp, reason, source, peak_eps, peak_wps,
            total_lines, started_at, ended_at FROM heads""", RULES, True),
        "incident_fetch": with_ev("""
            , sg AS (SELECT source, t, string_agg(message, ',' ORDER BY seq) AS signal_messages FROM isig GROUP BY source, t),
            cx AS (SELECT source, t, string_agg(message, ',' ORDER BY seq) AS context_messages FROM ictx GROUP BY source, t)
            SELECT source, incident_id || '.json' AS filename, total_lines, signal_messages, context_messages
            FROM heads JOIN sg USING (source, t) JOIN cx USING (source, t)""", RULES, True),
        "throttle": with_ev(f"SELECT {ts('ts')} AS ts, source, seq, level, message FROM taken", THROTTLE, True),
        "alerts": with_ev(f"SELECT {ts('ts')} AS ts, source, seq, level, message, status, push FROM al", ALERTS, True),
        "alert_lines": with_ev(f"""SELECT {ts('ts')} AS ts, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || status || '] '
            || level || ': ' || message AS line FROM al""", ALERTS, True),
        "history": with_ev(f"""SELECT {EVENT} FROM ev WHERE {SIG}
            QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq DESC) <= 500"""),
        "tail": with_ev(f"""SELECT {EVENT} FROM ev QUALIFY count(*) OVER (PARTITION BY source) <= 2000
            OR row_number() OVER (PARTITION BY source ORDER BY seq DESC) <= 1500"""),
        "signal_history": with_ev(f"""SELECT {EVENT} FROM ev WHERE {SIG}
            QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq DESC) <= 1000"""),
        "state_merge": with_ev(f"SELECT source, pattern, level, count, {ts('last_ts')} AS last_ts FROM pats", PATTERNS),
        "stream_totals": with_ev("SELECT source, level, count(*) AS count FROM ev GROUP BY source, level"),
        "stream_patterns": with_ev(f"SELECT source, pattern, level, count, {ts('last_ts')} AS last_ts FROM pats", PATTERNS),
        "stream_ticks": STREAM_TICKS, "stream_ticks_segments": STREAM_TICKS,
        "stream_heartbeat": STREAM_HEART, "stream_heartbeat_segments": STREAM_HEART,
        "stream_recent_summary": with_ev(f"""SELECT source, {us(f'w * {DAY_US}')} AS window_start, errors, warns
            FROM rs""", recent(DAY_US)),
        "stream_incidents": STREAM_INCIDENTS, "stream_incidents_segments": STREAM_INCIDENTS,
        "stream_incidents_late": STREAM_INCIDENTS,
        "parse_json_duplicates": with_ev("""SELECT source, seq, level, msg || ' | ' || k || '=' || v AS message FROM base"""),
        "parse_docker_deep": PARSED,
        "parse_untimed": with_ev(f"""SELECT source, seq, {ts("coalesce(last_value(CASE WHEN seq % 3 = 1 THEN ts END IGNORE NULLS) OVER (PARTITION BY source ORDER BY seq), first_value(CASE WHEN seq % 3 = 1 THEN ts END IGNORE NULLS) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")} AS ts,
            level, message, seq % 3 = 1 AS timed FROM ev"""),
        "inspect_map": with_ev("""SELECT source, sum(count(*)) OVER (PARTITION BY source)::BIGINT AS total,
            count(*) OVER (PARTITION BY source) AS n_variants, message, count(*) AS count FROM ev
            WHERE message LIKE 'Shelf opened | shopper=%' GROUP BY source, message"""),
        "heartbeat_lines": with_ev(f"""SELECT source, '[' || strftime(make_timestamp((w + 1) * {DAY_US}), '%Y-%m-%d %H:%M:%S')
            || '] System Heartbeat: HEARTBEAT [' || strftime(make_timestamp(w * {DAY_US}), '%H:%M') || ']' || chr(10)
            || 'Duration: 24h0m0s' || chr(10) || 'Errors: ' || errors || ' | Warns: ' || warns || ' | Info: ' || infos || chr(10)
            || 'Top Issue: ' || top_issue || chr(10) AS line FROM hb""", heart(DAY_US)),
        "alert_log": with_ev(f"""SELECT '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || status || '] '
            || level || ': ' || message AS line FROM al""", ALERTS, True),
        "event_store": with_ev(f"""SELECT {EVENT}, {fp('message')} AS pattern FROM ev
            WHERE source IN ('svc-0', 'svc-2') AND {SIG} AND {fp('message')} = '{IP_PATTERN}'"""),
        "detect_sources": with_ev(
            "SELECT DISTINCT source, CASE WHEN seq % 5 IN (2, 4) THEN 'json' ELSE 'text' END AS format FROM mixed"),
        "incident_signals_all": with_ev(f"""SELECT i.source, {us('i.t')} AS incident_ts, e.seq, {ts('e.ts')} AS ts, e.level,
            e.message FROM inc i JOIN ev e ON e.source = i.source AND e.seq <= i.trigger_seq AND e.{SIG}
            WHERE i.last IS NULL OR epoch_us(e.ts) > i.last""", RULES, True),
        "own_parser": with_ev(f"""SELECT source, seq, {ts("date_trunc('second', ts)")} AS ts, level,
            replace(message, '|', '/') AS message FROM ev"""),
        "stream_alerts": with_ev(f"SELECT {ts('ts')} AS ts, source, level, message, status, push FROM al", ALERTS, True),
        "stream_alerts_segments": with_ev(f"SELECT {ts('ts')} AS ts, source, level, message, status, push FROM al", ALERTS, True),
    }
