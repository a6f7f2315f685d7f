"""The catalog's results in plain SQL, for a check by an independent engine."""

from __future__ import annotations

from sqltide.plans.traffic import oracle_table as t

BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_LITERAL = "''(?:[^'']|'''')*''|\\$\\$[^$]*\\$\\$"
_CALL = "([a-z_][a-z0-9_.]*)\\s*\\("
_NO_ROUTINES = "('count','max','upper','in','as','values','now','orders')"


def tokens(sql: str) -> str:
    return f"regexp_replace({sql}, '--[^\\n]*|/\\*[^*]*\\*/|{_LITERAL}', ' ', 'g')"


def _flat(sql: str) -> str:
    return f"regexp_replace({sql}, '\\([^()]*\\)', ' ', 'g')"


def _calls(x: str) -> str:
    return (f"len([c FOR c IN regexp_extract_all(lower({x}), '{_CALL}', 1) "
            f"IF c NOT IN {_NO_ROUTINES}]) > 0")


def _word(x: str) -> str:
    return f"lower(regexp_extract({x}, '[A-Za-z_]+'))"


def _primary(x: str) -> str:
    return f"regexp_extract(lower({_flat(x)}), '\\b(select|insert|update|delete)\\b', 1)"


def _weight(x: str) -> str:
    """Class of one tokenised statement as a two-digit number: weight, then kind."""
    select = f"CASE WHEN {_calls(x)} THEN 30 ELSE 10 END"
    return f"""CASE {_word(x)}
      WHEN 'select' THEN {select} WHEN 'insert' THEN 50 WHEN 'update' THEN 50
      WHEN 'delete' THEN 50 WHEN 'call' THEN 51 WHEN 'create' THEN 60 WHEN 'alter' THEN 60
      WHEN 'drop' THEN 60 WHEN 'begin' THEN 70 WHEN 'start' THEN 70 WHEN 'commit' THEN 80
      WHEN 'end' THEN 80
      WHEN 'rollback' THEN CASE WHEN regexp_matches(lower({x}), '^\\s*rollback\\s+to\\b') THEN 20 ELSE 80 END
      WHEN 'set' THEN 20 WHEN 'reset' THEN 20 WHEN 'discard' THEN 20 WHEN 'savepoint' THEN 20
      WHEN 'release' THEN 20
      WHEN 'copy' THEN CASE WHEN regexp_matches(lower({_flat(x)}), '\\bfrom\\b') THEN 40 ELSE 0 END
      WHEN 'with' THEN CASE WHEN {_primary(x)} = 'select' THEN {select}
                            WHEN {_primary(x)} = '' THEN 0 ELSE 50 END
      ELSE 0 END"""


def _name(weight: str) -> str:
    return f"""CASE {weight} WHEN 10 THEN 'plain_select' WHEN 20 THEN 'utility'
      WHEN 30 THEN 'proc_select' WHEN 40 THEN 'copy_from' WHEN 50 THEN 'dml' WHEN 51 THEN 'call'
      WHEN 60 THEN 'ddl' WHEN 70 THEN 'begin' WHEN 80 THEN 'commit_rollback' ELSE 'unknown' END"""


def single(sql: str) -> str:
    return _name(_weight(tokens(sql)))


def batch(sql: str) -> str:
    return _name(f"list_max([{_weight('s')} FOR s IN string_split({tokens(sql)}, ';')])")


EVENTS = f"e AS ({t('sql_events')})"
CLASSED = f"{EVENTS}, k AS (SELECT *, {batch('sql')} AS stmt_class FROM e)"
_SIGNAL = ("CASE WHEN stmt_class = 'begin' THEN 'in_tx' "
           "WHEN stmt_class = 'commit_rollback' THEN 'idle' END")
STATED = f"""{CLASSED}, s AS (SELECT *, coalesce(last_value({_SIGNAL} IGNORE NULLS) OVER (
    PARTITION BY conn_key ORDER BY pos {BEFORE}), 'idle') AS tx_state FROM k)"""
DECIDED = f"""{STATED}, d AS (SELECT *, CASE WHEN stmt_class = 'unknown' THEN 'drop'
    WHEN stmt_class = 'plain_select' AND tx_state <> 'in_tx' THEN 'drop' ELSE 'keep' END AS action
    FROM s)"""

# --- messages --------------------------------------------------------------------------------

def _last_pos(condition: str, part: str, frame: str = BEFORE) -> str:
    return f"max(CASE WHEN {condition} THEN pos END) OVER (PARTITION BY {part} ORDER BY pos {frame})"


_RESET = "regexp_matches(upper(trim(sql)), '^(DISCARD|RESET|DEALLOCATE) ALL(;|$)')"


def _messages(max_sql: int = 1 << 62, max_copy: int = 1 << 62, pooler: bool = False) -> str:
    """CTEs up to ``g``: every message with the state of its connection."""
    on = "true" if pooler else "false"
    return f"""
m0 AS ({t('messages')}),
m1 AS (SELECT * EXCLUDE (sql), CASE WHEN strlen(sql) <= {max_sql} THEN sql END AS sql,
         coalesce(strlen(sql) > {max_sql}, false) AS oversized FROM m0),
m AS (SELECT *, CASE WHEN sql IS NOT NULL THEN {batch('sql')} END AS cls,
         coalesce({on} AND {_RESET}, false) AS is_reset FROM m1),
p AS (SELECT *, {_last_pos("msg_type = 'P' AND sql IS NOT NULL", "conn_key, coalesce(stmt_name, '')")} AS p_pos,
         coalesce({_last_pos("msg_type = 'Q' AND is_reset", "conn_key")}, -1) AS q_reset FROM m),
b AS (SELECT p.*, d.sql AS d_sql, d.cls AS d_cls, coalesce(d.is_reset, false) AS d_reset,
         coalesce(p.msg_type = 'B' AND d.is_reset AND p_pos > q_reset, false) AS cand
      FROM p LEFT JOIN m d ON p.msg_type = 'B' AND d.pos = p.p_pos),
b2 AS (SELECT *, (msg_type = 'Q' AND is_reset) OR (cand AND p_pos > coalesce(
         {_last_pos("cand", "conn_key")}, -1)) AS resets FROM b),
c AS (SELECT *, coalesce({_last_pos("resets", "conn_key")}, -1) AS reset_pos,
         {_last_pos("msg_type = 'Q' AND cls = 'copy_from'", "conn_key")} AS copy_pos,
         coalesce({_last_pos("msg_type IN ('c', 'f')", "conn_key")}, -1) AS end_pos,
         sum(CASE WHEN msg_type = 'd' THEN strlen(chunk) ELSE 0 END) OVER (
             PARTITION BY conn_key ORDER BY pos {SO_FAR}) AS copied FROM b2),
c2 AS (SELECT c.*, s.sql AS copy_sql, CASE WHEN copy_open AND c.msg_type = 'c'
         THEN c.copied - s.copied END AS copy_bytes FROM
         (SELECT *, copy_pos IS NOT NULL AND copy_pos > greatest(end_pos, reset_pos) AS copy_open
          FROM c) c LEFT JOIN c s ON c.msg_type IN ('c', 'd') AND s.pos = c.copy_pos),
f AS (SELECT *, coalesce(msg_type = 'B' AND p_pos > reset_pos, false) AS bound,
         coalesce(msg_type = 'Q' AND cls = 'copy_from', false) AS copy_start,
         coalesce((msg_type = 'Q' AND sql IS NOT NULL AND cls <> 'copy_from')
           OR (msg_type = 'B' AND p_pos > reset_pos) OR copy_bytes <= {max_copy}, false) AS is_event,
         CASE msg_type WHEN 'Q' THEN cls WHEN 'B' THEN d_cls WHEN 'c' THEN 'copy_from' END AS ev_cls,
         CASE msg_type WHEN 'Q' THEN sql WHEN 'B' THEN d_sql WHEN 'c' THEN copy_sql END AS ev_sql
      FROM c2),
g1 AS (SELECT *, sum(CASE WHEN is_event THEN 1 ELSE 0 END) OVER w AS seq,
         coalesce({_last_pos("is_event AND (ev_cls = 'commit_rollback' OR resets)", "conn_key")}, -1) AS close_pos,
         coalesce({_last_pos("is_event AND ev_cls IN ('begin', 'dml', 'ddl', 'copy_from')", "conn_key")}, -2) AS open_before,
         coalesce(last_value(CASE WHEN msg_type = 'Z' THEN CASE tx_status WHEN 'I' THEN 'idle'
             WHEN 'T' THEN 'in_tx' WHEN 'E' THEN 'failed' END
             WHEN is_event AND ev_cls = 'begin' THEN 'in_tx'
             WHEN is_event AND ev_cls = 'commit_rollback' THEN 'idle' END IGNORE NULLS)
             OVER (PARTITION BY conn_key ORDER BY pos {BEFORE}), 'idle') AS tx_state,
         {_last_pos("(is_event AND msg_type IN ('Q', 'B')) OR copy_start", "conn_key")} AS start_pos,
         coalesce({_last_pos("msg_type IN ('C', 'Z')", "conn_key")}, -1) AS done_pos
       FROM f WINDOW w AS (PARTITION BY conn_key ORDER BY pos {SO_FAR})),
g2 AS (SELECT *, is_event AND (ev_cls = 'begin' OR (ev_cls IN ('dml', 'ddl', 'copy_from')
         AND open_before < close_pos + CASE WHEN close_pos < 0 THEN 1 ELSE 0 END)) AS opens FROM g1),
g AS (SELECT *, CASE WHEN is_event AND {_last_pos("opens", "conn_key", SO_FAR)} > close_pos
         THEN {_last_pos("opens", "conn_key", SO_FAR)} ELSE -1 END AS tx_pos FROM g2),
tx AS (SELECT pos AS tx_pos, row_number() OVER (ORDER BY pos) AS tx_id FROM g WHERE opens),
x AS (SELECT g.conn_key, g.pos, g.seq, CAST((epoch_us(g.ts) - epoch_us(s.ts)) * 1000 AS BIGINT) AS exec_ns
      FROM g JOIN m s ON s.pos = g.start_pos
      WHERE g.msg_type IN ('C', 'Z') AND g.start_pos > g.done_pos AND g.ts > s.ts)"""


_OIDS = "list_slice([23, pos % 100, 25], 1, pos % 4)"
_VALUES = ("list_slice([concat('v', CAST(pos AS VARCHAR)), NULL, CAST(pos AS VARCHAR)], "
           "1, (pos // 4) % 4)")


def _params(oids: str, values: str, formats: str) -> str:
    n = f"greatest(len({oids}), len({values}))"
    code = (f"CASE WHEN len({formats}) = 1 THEN ({formats})[1] "
            f"ELSE coalesce(({formats})[i], 0) END")
    return (f"array_to_string([concat(CAST(coalesce(({oids})[i], 0) AS VARCHAR), '/', "
            f"coalesce(({values})[i], '~'), '/', CAST({code} AS VARCHAR)) "
            f"FOR i IN range(1, {n} + 1)], ',')")


_BIND_PARAMS = _params(_OIDS.replace("pos", "p_pos"), _VALUES, "list_slice([1, 0, 1], 1, pos % 4)")

ORACLES = {}

# --- sources and sinks -----------------------------------------------------------------------

ORACLES["read_messages"] = f"""
WITH m AS ({t('messages')}) SELECT conn_key, msg_type, count(*) AS n, min(pos) AS first_pos,
max(pos) AS last_pos FROM m GROUP BY ALL"""
ORACLES["kafka_frames"] = f"""
WITH {EVENTS} SELECT conn_key AS key, pos, sql, ts, false AS corrupt FROM e"""
ORACLES["spool_events"] = f"WITH {EVENTS} SELECT conn_key, pos, sql FROM e"
ORACLES["event_log"] = f"WITH {EVENTS} SELECT conn_key, pos, ts, sql, db_user FROM e"
ORACLES["stream_event_log"] = ORACLES["event_log"]
_BROKEN = f"""{EVENTS}, r AS (SELECT pos % 4 AS partition, pos AS "offset", *,
    db_user IN ('User3', 'User4', 'User5') AS corrupt FROM e)"""
_RUNS = f"""{_BROKEN}, r1 AS (SELECT *, sum(CASE WHEN corrupt THEN 1 ELSE 0 END) OVER w AS bad,
    count(CASE WHEN corrupt THEN NULL ELSE 1 END) OVER w AS island FROM r
    WINDOW w AS (PARTITION BY partition ORDER BY "offset")),
    r2 AS (SELECT *, CASE WHEN corrupt THEN count(CASE WHEN corrupt THEN 1 END) OVER (
      PARTITION BY partition, island ORDER BY "offset") ELSE 0 END AS run FROM r1)"""
ORACLES["decode_events"] = f"""
WITH {_BROKEN} SELECT "offset", corrupt, CASE WHEN NOT corrupt THEN sql END AS sql,
CASE WHEN NOT corrupt THEN conn_key END AS conn_key FROM r"""
ORACLES["decode_breaker"] = f"""
WITH {_RUNS} SELECT partition, count(CASE WHEN corrupt THEN 1 END) AS corrupt_records,
max(run) AS longest_run, max(run) >= 5 AS tripped FROM r2 GROUP BY partition"""
ORACLES["consume_until_break"] = f"""
WITH {_RUNS}, stop AS (SELECT partition, min("offset") AS until FROM r2 WHERE run >= 5 GROUP BY partition)
SELECT partition, "offset", corrupt FROM r2 LEFT JOIN stop USING (partition)
WHERE until IS NULL OR "offset" < until"""
ORACLES["error_export"] = f"""
WITH {EVENTS} SELECT concat('-- ', strftime(ts, '%Y-%m-%dT%H:%M:%S'),
  CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE concat('.', rtrim(strftime(ts, '%f'), '0')) END,
  'Z conn=', conn_key, ' error: ', CASE db_user WHEN 'User1' THEN 'a b' WHEN 'User2' THEN 'unknown'
  ELSE 'deadlock' END, chr(10), sql, ';') AS line FROM e"""


def _diffs(table: str, threshold: float) -> str:
    return f"""r AS ({t(table)}), c AS (SELECT *, CASE
      WHEN target_error IS NOT NULL AND source_error IS NULL THEN 'ERROR'
      WHEN source_exec_ms > 0 AND target_exec_ms > source_exec_ms * {threshold} THEN 'SLOW'
      ELSE 'NONE' END AS diff_type FROM r)"""


ORACLES["diff_export"] = f"""
WITH {_diffs('order_results', 2.0)} SELECT concat(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), ' [', diff_type,
  '] ', conn_key, ': ', CASE WHEN length(sql) > 100 THEN concat(substring(sql, 1, 100), '...') ELSE sql END,
  printf(' (source=%.1fms target=%.1fms err=', source_exec_ms, target_exec_ms), '"',
  replace(replace(coalesce(target_error, ''), '"', '\\"'), chr(10), '\\n'), '")') AS line
FROM c WHERE diff_type <> 'NONE'"""
ORACLES["route_by_database"] = f"""
WITH {EVENTS} SELECT database, count(*) AS n, max(pos) AS last_pos FROM e GROUP BY database"""

_BOUNDS = "(0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)"


def _times(table: str) -> str:
    return f"""r AS ({t(table)}), times AS (
      SELECT pos, 'source' AS side, source_exec_ms / 1000 AS seconds FROM r
      UNION ALL SELECT pos, 'target', target_exec_ms / 1000 FROM r)"""


_HISTOGRAM = f"""bounds AS (SELECT CAST(b AS DOUBLE) AS b, CAST(b AS VARCHAR) AS le FROM (VALUES
    {', '.join(f"({b}, '{float(b):g}')" for b in _BOUNDS.strip('()').split(', '))}) v(b, le)
    UNION ALL SELECT CAST('inf' AS DOUBLE), '+Inf'),
    le AS (SELECT b, CASE WHEN isinf(b) THEN '+Inf' ELSE regexp_replace(CAST(b AS VARCHAR), '\\.0$', '') END AS le FROM bounds),
    h AS (SELECT s.side, le.le, count(x.seconds) AS n FROM (SELECT DISTINCT side FROM times WHERE seconds > 0) s
      CROSS JOIN le LEFT JOIN times x ON x.side = s.side AND x.seconds > 0 AND x.seconds <= le.b
      GROUP BY s.side, le.le)"""


def _p99(window: int | None = None) -> str:
    return f"""recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY pos DESC) AS back
      FROM times WHERE seconds > 0) WHERE {f'back <= {window}' if window else 'true'}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY seconds) AS rk,
      count(*) OVER (PARTITION BY side) AS n FROM recent),
    q AS (SELECT coalesce(max(CASE WHEN side = 'source' THEN seconds END), 0.0) AS source_p99,
      coalesce(max(CASE WHEN side = 'target' THEN seconds END), 0.0) AS target_p99
      FROM ranked WHERE rk = CAST(floor(0.99 * (n - 1) + 0.5) AS BIGINT) + 1)"""


def _number(x: str) -> str:
    return (f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) "
            f"ELSE CAST(CAST({x} AS DOUBLE) AS VARCHAR) END")


ORACLES["metrics_exposition"] = f"""
WITH {DECIDED}, {_times('order_results')}, {_HISTOGRAM}, {_p99()},
er AS (SELECT count(*) AS n, count(target_error) AS bad FROM r),
lines AS (
 SELECT concat('sqltide_classified_total{{class="', stmt_class, '",kept="',
   CASE WHEN action = 'keep' THEN 'true' ELSE 'false' END, '"}}') AS name, CAST(count(*) AS DOUBLE) AS v
   FROM d GROUP BY stmt_class, action
 UNION ALL SELECT 'sqltide_replay_total', n FROM er
 UNION ALL SELECT 'sqltide_replay_errors_total', bad FROM er
 UNION ALL SELECT 'sqltide_replay_error_rate', bad / n FROM er
 UNION ALL SELECT 'sqltide_alert_replay_error_rate', CASE WHEN bad / n > 0.01 THEN 1 ELSE 0 END FROM er
 UNION ALL SELECT concat('sqltide_exec_time_seconds_bucket{{le="', le, '",side="', side, '"}}'), n FROM h
 UNION ALL SELECT 'sqltide_source_exec_p99_seconds', source_p99 FROM q
 UNION ALL SELECT 'sqltide_target_exec_p99_seconds', target_p99 FROM q
 UNION ALL SELECT 'sqltide_alert_target_p99', CASE WHEN source_p99 > 0 AND target_p99 > 2 * source_p99
   THEN 1 ELSE 0 END FROM q)
SELECT concat(name, ' ', {_number('v')}) AS line FROM lines"""

# --- captured segments -----------------------------------------------------------------------

SEGMENTS = f"g AS ({t('segments')})"
ORACLES["capture_filter"] = f"""
WITH {SEGMENTS} SELECT pos, src_port, dst_port FROM g WHERE src_port = 5432 OR dst_port = 5432"""
ORACLES["capture_filter_host"] = f"""
WITH {SEGMENTS} SELECT pos, src_ip, dst_ip FROM g WHERE 6543 IN (src_port, dst_port)
AND '10.0.0.11' IN (src_ip, dst_ip)"""
CONNS = f"""{SEGMENTS}, u AS (SELECT * EXCLUDE (src_ip, dst_ip), replace(src_ip, '::ffff:', '') AS src_ip,
    replace(dst_ip, '::ffff:', '') AS dst_ip FROM g),
  ends AS (SELECT *, concat(src_ip, ':', src_port) AS a, concat(dst_ip, ':', dst_port) AS b FROM u),
  firsts AS (SELECT *, first_value(a) OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY pos) AS fa FROM ends),
  conns AS (SELECT *, CASE WHEN (dst_port = 5432) <> (src_port = 5432) THEN dst_port = 5432
      ELSE a = fa END AS from_client FROM firsts),
  keyed AS (SELECT *, CASE WHEN from_client THEN concat(a, '-', b) ELSE concat(b, '-', a) END AS conn_key FROM conns)"""
ORACLES["canonical_conn"] = f"WITH {CONNS} SELECT pos, conn_key, from_client FROM keyed"


def _ordered(source: str, keys: str) -> str:
    return f"""l2 AS (SELECT *, tcp_seq - lag(tcp_seq) OVER w AS jump FROM {source} WHERE len > 0
    WINDOW w AS (PARTITION BY {keys} ORDER BY pos)),
  o AS (SELECT *, tcp_seq + 4294967296 * coalesce(sum(CASE WHEN jump < -2147483648 THEN 1
    WHEN jump > 2147483648 THEN -1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY pos), 0) AS sq FROM l2),
  v AS (SELECT *, max(sq + len) OVER (PARTITION BY {keys} ORDER BY sq, pos {BEFORE}) AS seen FROM o)"""


_STATUS = """CAST(sq AS BIGINT) AS stream_seq,
  CASE WHEN seen IS NULL THEN 'start' WHEN sq + len <= seen THEN 'duplicate' WHEN sq < seen THEN 'overlap'
       WHEN sq > seen THEN 'gap' ELSE 'next' END AS status,
  CAST(len - coalesce(least(greatest(seen - sq, 0), len), 0) AS BIGINT) AS new_bytes,
  CAST(coalesce(greatest(sq - seen, 0), 0) AS BIGINT) AS gap_bytes"""
ORACLES["order_segments"] = f"""
WITH {CONNS}, {_ordered("keyed", "conn_key, from_client")}
SELECT pos, conn_key, from_client, {_STATUS} FROM v"""
LIVES = f"""{CONNS}, l AS (SELECT *, flags LIKE '%FIN%' OR flags LIKE '%RST%' AS closing,
    len > 0 OR flags LIKE '%SYN%' AS opening FROM keyed),
  b AS (SELECT *, lag(ts) OVER w AS before,
    max(CASE WHEN closing THEN pos END) OVER (PARTITION BY conn_key ORDER BY pos {BEFORE}) AS closed,
    max(CASE WHEN opening THEN pos END) OVER (PARTITION BY conn_key ORDER BY pos {BEFORE}) AS opened
    FROM l WINDOW w AS (PARTITION BY conn_key ORDER BY pos)),
  n AS (SELECT *, coalesce(ts - before >= INTERVAL 20000 SECONDS, false)
    OR coalesce(opening AND closed >= coalesce(opened, -1), false) AS fresh FROM b),
  s AS (SELECT *, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY conn_key ORDER BY pos) AS BIGINT) AS life FROM n),
  lives AS (SELECT conn_key, life, min(ts) AS started, max(ts) AS ended, count(*) AS segments,
    CAST(sum(len) AS BIGINT) AS bytes, CASE WHEN bool_or(flags LIKE '%RST%') THEN 'rst'
    WHEN bool_or(flags LIKE '%FIN%') THEN 'fin' ELSE 'idle' END AS end_reason FROM s GROUP BY conn_key, life)"""
ORACLES["connection_sessions"] = f"WITH {LIVES} SELECT * FROM lives"
ORACLES["order_segments_by_life"] = f"""
WITH {LIVES}, {_ordered("s", "conn_key, life, from_client")}
SELECT pos, life, {_STATUS} FROM v"""
ORACLES["capture_loss"] = f"""
WITH c AS ({t('capture_stats')}) SELECT ts, received, dropped,
  greatest(received - lag(received, 1, 0) OVER (ORDER BY ts), 0) AS received_delta,
  greatest(dropped - lag(dropped, 1, 0) OVER (ORDER BY ts), 0) AS dropped_delta,
  CASE WHEN received > 0 THEN dropped / received ELSE 0.0 END AS drop_rate,
  received > 0 AND dropped / received > 0.001 AS alert FROM c"""

# --- messages to events ------------------------------------------------------------------------

for _capped, _sql_limit in (("", 1 << 62), ("_capped", 60)):
    ORACLES[f"extract_statements{_capped}"] = f"""
WITH m AS ({t('messages')}) SELECT conn_key, pos, sql FROM m
WHERE msg_type = 'Q' AND strlen(sql) <= {_sql_limit}"""
ORACLES["statement_definitions"] = f"""
WITH m AS ({t('messages')}) SELECT conn_key, stmt_name, sql, pos AS valid_from,
lead(pos) OVER (PARTITION BY conn_key, stmt_name ORDER BY pos) AS valid_to FROM m WHERE msg_type = 'P'"""
ORACLES["correlate_binds"] = f"""
WITH {_messages()} SELECT conn_key, pos, stmt_name, CASE WHEN bound THEN d_sql END AS sql, NOT bound AS orphan,
CASE WHEN bound THEN {_BIND_PARAMS} END AS params FROM g WHERE msg_type = 'B'"""
ORACLES["zip_parameters"] = f"""
WITH m AS ({t('messages')}) SELECT pos, {_params('list_slice([23, pos % 100], 1, pos % 3)', _VALUES,
'list_slice([1, 0, 1], 1, pos % 4)')} AS params,
CAST(greatest(len(list_slice([23, pos % 100], 1, pos % 3)), len({_VALUES})) AS INT) AS n_params
FROM m WHERE msg_type = 'B'"""
for _capped, _copy_limit in (("", 1 << 62), ("_capped", 18)):
    ORACLES[f"assemble_copy{_capped}"] = f"""
WITH {_messages(max_copy=_copy_limit)}, parts AS (SELECT copy_pos, list(chunk ORDER BY pos) AS chunks FROM g
  WHERE copy_open AND msg_type = 'd' GROUP BY copy_pos)
SELECT conn_key, pos, ev_sql AS sql, CAST(copy_bytes AS BIGINT) AS copy_bytes,
CAST(coalesce(len(chunks), 0) AS INT) AS n_chunks, coalesce(array_to_string(chunks, '|'), '') AS data
FROM g LEFT JOIN parts USING (copy_pos) WHERE msg_type = 'c' AND is_event"""
ORACLES["assign_seq"] = f"""
WITH {_messages()} SELECT conn_key, pos, CAST(seq AS BIGINT) AS seq, ev_cls AS stmt_class FROM g WHERE is_event"""
ORACLES["assign_tx_id"] = f"""
WITH {_messages()} SELECT conn_key, pos, CAST(seq AS BIGINT) AS seq, ev_cls AS stmt_class,
coalesce(tx_id, 0) AS tx_id FROM g LEFT JOIN tx USING (tx_pos) WHERE is_event"""
ORACLES["pooler_sessions"] = f"""
WITH {_messages(pooler=True)} SELECT conn_key, pos, CAST(coalesce(sum(CASE WHEN resets THEN 1 ELSE 0 END) OVER (
PARTITION BY conn_key ORDER BY pos {BEFORE}), 0) AS BIGINT) AS sess FROM g"""
ORACLES["source_exec_time"] = f"""
WITH {_messages()} SELECT conn_key, pos, CAST(seq AS BIGINT) AS seq, exec_ns FROM x"""
ORACLES["dialogue_exec_counts"] = f"""
WITH m AS ({t('dialogue')}), s AS (SELECT *,
  {_last_pos("msg_type = 'Q'", "conn_key")} AS start_pos,
  coalesce({_last_pos("msg_type IN ('C', 'Z') AND NOT from_client", "conn_key")}, -1) AS done_pos,
  count(CASE WHEN msg_type = 'Q' THEN 1 END) OVER (PARTITION BY conn_key ORDER BY pos) AS seq FROM m)
SELECT conn_key, pos, seq, (pos - start_pos) * 1000000000 AS exec_ns FROM s
WHERE msg_type IN ('C', 'Z') AND NOT from_client AND start_pos > done_pos"""
for _capped, _sql_limit, _copy_limit in (("", 1 << 62, 1 << 62), ("_capped", 60, 18)):
    ORACLES[f"parse_error_counts{_capped}"] = f"""
WITH {_messages(_sql_limit, _copy_limit)} SELECT count(CASE WHEN oversized THEN 1 END) AS oversized,
count(CASE WHEN msg_type = 'B' AND NOT bound THEN 1 END) AS orphan_binds,
count(CASE WHEN oversized OR (msg_type = 'B' AND NOT bound) THEN 1 END) AS parse_errors,
count(CASE WHEN msg_type = 'c' AND copy_bytes > {_copy_limit} THEN 1 END) AS dropped_loads FROM g"""
# Binds of resets one after the other, with the last that counted.
ORACLES["pooler_prepared_resets"] = f"""
WITH RECURSIVE m AS ({t('prepared_resets')}), d AS (SELECT *,
  {_last_pos("msg_type = 'P'", "conn_key, coalesce(stmt_name, '')")} AS parsed,
  coalesce({_last_pos("msg_type = 'Q' AND sql = 'RESET ALL'", "conn_key")}, -1) AS q_reset FROM m),
c AS (SELECT conn_key, pos, parsed, row_number() OVER (PARTITION BY conn_key ORDER BY pos) AS i
  FROM d WHERE msg_type = 'B' AND parsed > q_reset),
walk AS (SELECT conn_key, i, pos, true AS counts, pos AS last FROM c WHERE i = 1 UNION ALL
  SELECT c.conn_key, c.i, c.pos, c.parsed > w.last, CASE WHEN c.parsed > w.last THEN c.pos ELSE w.last END
  FROM walk w JOIN c ON c.conn_key = w.conn_key AND c.i = w.i + 1),
r AS (SELECT m.conn_key, m.pos, coalesce(w.counts, msg_type = 'Q' AND sql = 'RESET ALL') AS resets
  FROM m LEFT JOIN walk w ON w.conn_key = m.conn_key AND w.pos = m.pos)
SELECT conn_key, pos, CAST(coalesce(sum(CASE WHEN resets THEN 1 ELSE 0 END) OVER (
PARTITION BY conn_key ORDER BY pos {BEFORE}), 0) AS BIGINT) AS sess FROM r"""
ORACLES["message_events"] = f"""
WITH {_messages()}, lx AS (SELECT conn_key, seq, max_by(exec_ns, pos) AS source_exec_ns FROM x GROUP BY ALL)
SELECT g.conn_key, pos, ev_sql AS sql, coalesce(tx_id, 0) AS tx_id, CAST(g.seq AS BIGINT) AS seq,
msg_type = 'B' AS extended, CASE WHEN msg_type = 'B' THEN stmt_name END AS stmt_name, source_exec_ns,
ev_cls AS stmt_class, tx_state, CASE WHEN msg_type = 'B' THEN {_BIND_PARAMS} END AS params
FROM g LEFT JOIN tx USING (tx_pos) LEFT JOIN lx ON lx.conn_key = g.conn_key AND lx.seq = g.seq WHERE is_event"""

ORACLES["message_decisions"] = f"""
WITH {_messages()} SELECT conn_key, pos, ev_cls AS stmt_class, tx_state, coalesce(tx_id, 0) AS tx_id,
CASE WHEN ev_cls = 'unknown' THEN 'drop' WHEN ev_cls = 'plain_select' AND tx_state <> 'in_tx' THEN 'drop'
ELSE 'keep' END AS action, CASE WHEN ev_cls = 'unknown' THEN 'indeterminate' ELSE 'rule' END AS reason
FROM g LEFT JOIN tx USING (tx_pos) WHERE is_event"""

# --- SQL text ------------------------------------------------------------------------------------

_VIEW = ("trim(regexp_replace(regexp_replace(sql, '--[^\\n]*|/\\*[^*]*\\*/|('')(?:[^'']|'''')*''"
         "|(\\$)\\$[^$]*\\$\\$|\"([A-Za-z_]+)\"', ' \\1\\2\\3 ', 'g'), '\\s+', ' ', 'g'))")
ORACLES["sql_tokens_view"] = f"WITH {EVENTS} SELECT pos, {_VIEW} AS tokens FROM e"
# What the levels of each text, known from its id, make of it.
for deep, closed in (("deep_parentheses", "ddl"), ("deep_comments", "dml")):
    ORACLES[deep] = f"""
SELECT doc_id AS pos, CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 2 END AS statements,
  CASE WHEN doc_id % 3 = 2 THEN 'plain_select' ELSE '{closed}' END AS stmt_class,
  CASE WHEN doc_id % 3 = 2 THEN 'plain_select' ELSE '{closed}' END AS batch_class,
  'select' AS command FROM documents"""
DOCS = f"e AS ({t('document_sql')})"
ORACLES["document_tokens_view"] = f"WITH {DOCS} SELECT pos, {_VIEW} AS tokens FROM e"
ORACLES["split_statements"] = f"""
WITH {EVENTS}, q AS (SELECT pos, [trim(s) FOR s IN regexp_extract_all(sql,
  '(?:[^;''$/-]|--[^\\n]*|/\\*[^*]*\\*/|{_LITERAL}|[$/-])+')] AS parts FROM e),
q2 AS (SELECT pos, [trim(s, chr(10) || ' ') FOR s IN parts IF trim(s, chr(10) || ' ') <> ''] AS parts FROM q)
SELECT pos, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS i, unnest(parts) AS statement FROM q2"""
ORACLES["classify_statement"] = f"WITH {EVENTS} SELECT pos, {single('sql')} AS stmt_class FROM e"
ORACLES["is_proc_invoking"] = f"""
WITH {EVENTS} SELECT pos, {single('sql')} = 'proc_select' AS invokes FROM e"""
ORACLES["primary_command"] = f"""
WITH {EVENTS} SELECT pos, {_primary(tokens('sql'))} AS command FROM e WHERE sql LIKE 'WITH%'"""
ORACLES["classify_batch"] = f"WITH {CLASSED} SELECT pos, stmt_class FROM k"
ORACLES["tx_state"] = f"WITH {STATED} SELECT pos, stmt_class, tx_state FROM s"
ORACLES["rule_matrix"] = f"""
WITH {CLASSED} SELECT stmt_class, count(*) AS n, CASE stmt_class WHEN 'plain_select' THEN 'drop'
WHEN 'unknown' THEN NULL ELSE 'keep' END AS in_tx, CASE stmt_class WHEN 'plain_select' THEN 'drop'
WHEN 'unknown' THEN NULL ELSE 'keep' END AS out_tx FROM k GROUP BY stmt_class"""
ORACLES["decide_custom"] = f"""
WITH {STATED}, r AS (SELECT *, CASE WHEN regexp_matches(sql, 'IN \\(') THEN 'exclude'
  WHEN stmt_class = 'unknown' THEN 'indeterminate'
  WHEN stmt_class LIKE '%_select' AND regexp_matches(sql, '^/\\*') THEN 'include'
  WHEN stmt_class LIKE '%_select' AND sql LIKE '%app.do_work(%' THEN 'replayable' ELSE 'rule' END AS reason FROM s)
SELECT pos, stmt_class, tx_state, reason, CASE WHEN reason IN ('exclude', 'indeterminate') THEN 'drop'
  WHEN reason IN ('include', 'replayable') THEN 'keep'
  WHEN stmt_class LIKE '%_select' AND tx_state <> 'in_tx' THEN 'drop' ELSE 'keep' END AS action FROM r"""
ORACLES["decide_modes"] = f"""
WITH {STATED}, modes(mode) AS (VALUES ('custom'), ('write_only'), ('all'), ('ddl_only'), ('dml_only')),
r AS (SELECT mode, stmt_class, tx_state, CASE WHEN stmt_class = 'unknown' THEN 'drop'
  WHEN mode IN ('ddl_only', 'dml_only') THEN CASE WHEN concat(stmt_class, '_only') = mode THEN 'keep' ELSE 'drop' END
  WHEN stmt_class <> 'plain_select' OR mode = 'all' THEN 'keep'
  WHEN mode = 'custom' AND tx_state = 'in_tx' THEN 'keep' ELSE 'drop' END AS action FROM s CROSS JOIN modes)
SELECT mode, stmt_class, tx_state, action, count(*) AS n FROM r GROUP BY ALL"""
ORACLES["invokes_replayable"] = f"""
WITH {EVENTS} SELECT pos, len([c FOR c IN regexp_extract_all(lower({tokens('sql')}), '{_CALL}', 1)
IF c IN ('track_click', 'app.do_work', 'run_me')]) > 0 AS invokes FROM e"""
ORACLES["matches_any"] = f"""
WITH {EVENTS} SELECT pos, regexp_matches(sql, '(?i)drop\\s+table') OR regexp_matches(sql, '\\d{{16}}') AS matches FROM e"""
_TX_CONTROL = f"{_word(tokens('sql'))} IN ('begin', 'start', 'commit', 'end', 'rollback', 'abort')"
_SESSION = "regexp_matches(upper(trim(sql)), '^(SET|RESET|DISCARD) ')"
_READ = "regexp_matches(upper(trim(sql)), '^(SELECT|WITH|EXPLAIN)')"
ORACLES["transaction_control"] = f"""
WITH {EVENTS} SELECT pos, {_TX_CONTROL} AS is_tx_control, {_SESSION} AS is_session, {_READ} AS is_read FROM e"""
ORACLES["session_command"] = f"WITH {EVENTS} SELECT pos, sql FROM e WHERE {_SESSION}"
ORACLES["read_statement"] = f"WITH {EVENTS} SELECT pos, sql FROM e WHERE {_READ}"


def stripped(sql: str) -> str:
    return (f"regexp_replace({sql}, '('')(?:[^'']|'''')*('')|(\\$\\$)[^$]*(\\$\\$)', "
            "'\\1\\2\\3\\4', 'g')")


ORACLES["strip_literals"] = f"WITH {EVENTS} SELECT pos, {stripped('sql')} AS stripped FROM e"
ORACLES["document_strip_literals"] = f"""
WITH {DOCS} SELECT pos, concat('INSERT INTO docs VALUES (', pos, ', now(), '''') -- ', source) AS stripped
FROM e JOIN documents ON doc_id = pos"""
ORACLES["replace_outside_literals"] = f"""
WITH {DOCS} SELECT pos, concat('INSERT INTO docs VALUES (', pos, ', NOW_VALUE', substring(sql, length(
concat('INSERT INTO docs VALUES (', pos, ', now()')) + 1)) AS replaced FROM e"""

# --- safeguards ------------------------------------------------------------------------------------


def masked(sql: str) -> str:
    return (f"regexp_replace(regexp_replace({sql}, '\\b\\d{{16}}\\b', '****', 'g'), "
            "'([A-Za-z0-9._]+)@([A-Za-z0-9.]+)', '\\1@masked', 'g')")


_MASKED = ("regexp_matches({0}, '\\b\\d{{16}}\\b') OR "
           "regexp_matches({0}, '([A-Za-z0-9._]+)@([A-Za-z0-9.]+)')")
ORACLES["mask_sql"] = f"""
WITH {DOCS} SELECT pos, {masked('sql')} AS sql, {_MASKED.format('sql')} AS masked FROM e"""
ORACLES["sample_percent"] = f"""
WITH {EVENTS} SELECT pos, row_number() OVER (ORDER BY pos) % 100 < 35 AS sampled FROM e"""
ORACLES["sample_percent_stable"] = f"""
WITH {EVENTS} SELECT pos, conn_key FROM e
WHERE CAST(concat('0x', substr(md5(concat(conn_key, '/', pos)), 1, 8)) AS BIGINT) % 100 < 35"""
ORACLES["include_users"] = f"""
WITH {EVENTS} SELECT pos, db_user, CASE WHEN db_user IN ('User1', 'User5') THEN 'allow' ELSE 'block' END AS guard,
CASE WHEN db_user NOT IN ('User1', 'User5') THEN 'users' END AS guard_rule FROM e"""
ORACLES["read_only"] = f"WITH {EVENTS} SELECT pos, CASE WHEN {_READ} THEN 'allow' ELSE 'block' END AS guard FROM e"
_DDL = "regexp_matches(sql, '(?i)^\\s*(?:--[^\\n]*\\n\\s*|/\\*[\\s\\S]*?\\*/\\s*)*(CREATE|ALTER|DROP|TRUNCATE|GRANT|REVOKE)\\s')"
_EXTERNAL = "regexp_matches({0}, '(?i)\\bdblink\\s*\\(|\\bnotify\\s+\\w|\\bfrom\\s+\\w+\\.\\w+\\.\\w+')"
ORACLES["exclude_ddl"] = f"WITH {EVENTS} SELECT pos, CASE WHEN {_DDL} THEN 'block' ELSE 'allow' END AS guard FROM e"
ORACLES["skip_external"] = f"""
WITH {EVENTS} SELECT pos, CASE WHEN {_EXTERNAL.format(stripped('sql'))} THEN 'block' ELSE 'allow' END AS guard FROM e"""
ORACLES["include_exclude_tables"] = f"""
WITH {EVENTS}, r AS (SELECT pos, CASE WHEN {_SESSION} THEN NULL
  WHEN NOT regexp_matches({stripped('sql')}, '(?i)\\b(orders|pages|carts)\\b') THEN 'include_tables'
  WHEN regexp_matches({stripped('sql')}, '(?i)\\bcarts\\b') THEN 'exclude_tables' END AS guard_rule FROM e)
SELECT pos, guard_rule, CASE WHEN guard_rule IS NULL THEN 'allow' ELSE 'block' END AS guard FROM r"""


def rewritten(sql: str) -> str:
    """Capture time for time functions; literals of the traffic hold one function only."""
    stamp = "concat('''', strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '+00:00''::timestamptz')"
    day = "concat('''', strftime(ts, '%Y-%m-%d'), '''::date')"
    time = "concat('''', strftime(ts, '%H:%M:%S.%f'), '+00:00''::timetz')"
    return (f"replace(replace(replace(replace(replace({sql}, '''now() ', '''~hidden '), 'now()', {stamp}), "
            f"'current_timestamp', {stamp}), 'CURRENT_DATE', {day}), 'current_time ', concat({time}, ' '))")


def rewritten_all(sql: str) -> str:
    return f"replace({rewritten(sql)}, '~hidden ', 'now() ')"


ORACLES["rewrite_time_functions"] = f"""
WITH {EVENTS}, r AS (SELECT pos, sql, {rewritten_all('sql')} AS sql_out FROM e)
SELECT pos, sql_out, CASE WHEN sql_out <> sql THEN 'rewrite' ELSE 'allow' END AS guard FROM r"""
GUARDED = f"""{EVENTS}, n AS (SELECT * EXCLUDE (sql), sql AS raw, {masked('sql')} AS sql, {_MASKED.format('sql')} AS masked,
    row_number() OVER (ORDER BY pos) AS n FROM e),
  gr AS (SELECT *, CASE WHEN n % 100 >= 80 THEN 'percentage'
    WHEN db_user NOT IN ('User0', 'User1', 'User2', 'User3', 'User4') THEN 'users'
    WHEN {_DDL} THEN 'ddl' WHEN {_EXTERNAL.format(stripped('sql'))} THEN 'external'
    WHEN NOT {_SESSION} AND regexp_matches({stripped('sql')}, '(?i)\\bcarts\\b') THEN 'exclude_tables' END AS guard_rule FROM n),
  go AS (SELECT *, CASE WHEN guard_rule IS NULL THEN {rewritten_all('sql')} ELSE sql END AS sql_out FROM gr),
  gd AS (SELECT *, CASE WHEN guard_rule IS NOT NULL THEN 'block' WHEN masked OR sql_out <> sql THEN 'rewrite'
    ELSE 'allow' END AS guard FROM go)"""
ORACLES["apply_guard"] = f"WITH {GUARDED} SELECT pos, guard, guard_rule, sql_out FROM gd"
ORACLES["guard_stats"] = f"WITH {GUARDED} SELECT guard, count(*) AS n FROM gd GROUP BY guard"
ORACLES["tx_limits"] = f"""
WITH {EVENTS}, r AS (SELECT pos, pos % 40 AS tx_id, ts, count(*) OVER w AS n,
  epoch_us(ts) - epoch_us(min(ts) OVER w) AS us FROM e WINDOW w AS (PARTITION BY pos % 40 ORDER BY pos))
SELECT pos, tx_id, CASE WHEN tx_id > 0 THEN n END AS tx_statements,
CASE WHEN tx_id > 0 AND (us > 500000000000 OR n > 12) THEN 'block' ELSE 'allow' END AS tx_guard FROM r"""
ORACLES["backpressure_state"] = f"""
WITH g AS ({t('gauges')}), p AS (SELECT *, depth > 10000 OR lag_s > 90 AS paused FROM g)
SELECT pos, paused, CASE WHEN paused AND NOT lag(paused, 1, false) OVER (ORDER BY ts) THEN 'pause'
WHEN NOT paused AND lag(paused, 1, false) OVER (ORDER BY ts) THEN 'resume' END AS edge FROM p"""
ORACLES["backpressure_intervals"] = f"""
WITH g AS ({t('gauges')}), p AS (SELECT ts, depth > 15000 AS paused FROM g),
e AS (SELECT * FROM (SELECT ts, paused, lag(paused, 1, false) OVER (ORDER BY ts) AS was FROM p) WHERE paused <> was)
SELECT paused, resumed FROM (SELECT ts AS paused, paused AS on_, lead(ts) OVER (ORDER BY ts) AS resumed FROM e) WHERE on_"""

# --- replay plan -------------------------------------------------------------------------------------

ORACLES["lane_order"] = f"""
WITH {EVENTS} SELECT conn_key AS lane, pos, row_number() OVER (PARTITION BY conn_key ORDER BY pos) AS lane_seq FROM e"""
ORACLES["lane_order_serial"] = f"""
WITH {EVENTS} SELECT '__serial__' AS lane, pos, row_number() OVER (ORDER BY pos) AS lane_seq FROM e"""
ORACLES["assign_lane"] = f"WITH {EVENTS} SELECT conn_key AS lane, count(*) AS n FROM e GROUP BY conn_key"


def _paced(source: str, factor: float) -> str:
    return f"""pa AS (SELECT *, CAST(CASE WHEN gap > 0 THEN least(floor(gap / CAST({factor} AS DOUBLE)), 30000000000)
      ELSE 0 END AS BIGINT) AS delay_ns FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY pos)) * 1000 AS gap
      FROM {source})),
    pd AS (SELECT *, CAST(sum(delay_ns) OVER (ORDER BY pos) AS BIGINT) AS due_ns FROM pa)"""


ORACLES["pace"] = f"WITH {EVENTS}, {_paced('e', 100.0)} SELECT pos, delay_ns, due_ns FROM pd"
ORACLES["rate_limit"] = f"""
WITH {EVENTS}, {_paced('e', 500.0)}, i AS (SELECT pos, due_ns, row_number() OVER (ORDER BY pos) - 1 AS i FROM pd)
SELECT pos, CAST(floor(i * CAST(2e9 AS DOUBLE) + max(due_ns - i * CAST(2e9 AS DOUBLE)) OVER (ORDER BY pos)) AS BIGINT) AS slot_ns FROM i"""
ORACLES["apply_dialect"] = f"WITH {EVENTS} SELECT pos, NOT ({_TX_CONTROL}) AS send FROM e"


def _policy(policy: str) -> str:
    allowed = 4 if policy == "retry" else 1
    events = f"""SELECT event_seq, min(pos) AS pos, min(CASE WHEN attempt <= {allowed} AND target_error IS NULL
      THEN attempt END) AS ok, count(CASE WHEN attempt <= {allowed} THEN 1 END) AS tried FROM a GROUP BY conn_key, event_seq"""
    if policy != "abort":
        return f"""SELECT '{policy}' AS policy, CASE WHEN ok IS NULL THEN 'skipped' ELSE 'ok' END AS outcome,
          ok IS NULL AS rollback, count(*) AS n, CAST(sum(coalesce(ok, tried)) AS BIGINT) AS used, max(pos) AS last_pos
          FROM ({events}) GROUP BY ALL"""
    return f"""SELECT 'abort' AS policy, outcome, false AS rollback, count(*) AS n,
      CAST(sum(CASE WHEN outcome = 'not_run' THEN 0 ELSE coalesce(ok, tried) END) AS BIGINT) AS used, max(pos) AS last_pos
      FROM (SELECT *, CASE WHEN pos > min(CASE WHEN ok IS NULL THEN pos END) OVER () THEN 'not_run'
      WHEN ok IS NULL THEN 'aborted' ELSE 'ok' END AS outcome FROM ({events})) GROUP BY ALL"""


ORACLES["resolve_error_policy"] = (
    f"WITH a AS ({t('attempts')}) " + " UNION ALL ".join(_policy(p) for p in ("skip", "retry", "abort")))
ORACLES["replayed_statements"] = f"""
WITH a AS ({t('attempts')}), o AS (SELECT event_seq, count(CASE WHEN attempt <= 1 AND target_error IS NULL THEN 1 END) AS ok
  FROM a GROUP BY conn_key, event_seq)
SELECT 'event' AS sent, count(*) AS n FROM o UNION ALL SELECT 'rollback', count(*) FROM o WHERE ok = 0"""
ORACLES["plan_replay"] = f"""
WITH {GUARDED}, kept AS (SELECT * FROM gd WHERE guard <> 'block'), {_paced('kept', 1000.0)}
SELECT pos, conn_key AS lane, row_number() OVER (PARTITION BY conn_key ORDER BY pos) AS lane_seq, delay_ns, due_ns,
NOT ({_TX_CONTROL}) AS send, sql_out FROM pd"""
ORACLES["bounded_backlog"] = """
SELECT event_id AS pos, 'block' AS policy FROM events
UNION ALL SELECT * FROM (SELECT event_id, 'drop_oldest' FROM events ORDER BY 1 DESC LIMIT 321)
UNION ALL SELECT * FROM (SELECT event_id, 'drop_newest' FROM events ORDER BY 1 LIMIT 321)"""
ORACLES["overflow_total"] = """
SELECT CASE WHEN policy = 'block' THEN 0 ELSE n - 321 END AS overflow_total, policy
FROM (SELECT count(*) AS n FROM events), (VALUES ('block'), ('drop_oldest'), ('drop_newest')) v(policy)"""
ORACLES["queue_depth"] = f"""
WITH f AS ({t('flow')}) SELECT pos, CAST(greatest(sum(CASE kind WHEN 'produced' THEN 1 ELSE -1 END)
OVER (ORDER BY pos), 0) AS BIGINT) AS depth FROM f"""
ORACLES["replay_lag"] = f"""
WITH {EVENTS} SELECT pos, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 1e6 AS lag_s FROM e"""
ORACLES["active_only"] = f"""
WITH {EVENTS}, s AS ({t('signals')}), l AS (SELECT state, ts, lead(ts) OVER (ORDER BY ts) AS until FROM s)
SELECT pos, conn_key FROM e LEFT JOIN l ON e.ts >= l.ts AND (l.until IS NULL OR e.ts < l.until)
WHERE coalesce(state, 'active') = 'active'"""
ORACLES["control_edges"] = f"""
WITH s AS ({t('signals')}), l AS (SELECT ts, state, lag(state, 1, 'active') OVER (ORDER BY ts) AS before FROM s)
SELECT ts, before, state AS after FROM l WHERE state <> before"""
ORACLES["detect_failover"] = f"""
WITH r AS ({t('resolutions')}), first AS (SELECT host, min_by(ip, ts) AS ip0 FROM r GROUP BY host),
l AS (SELECT r.*, lag(ip) OVER (PARTITION BY host ORDER BY ts) AS old FROM r WHERE ip <> '')
SELECT host, ts, coalesce(old, '') AS old_ip, ip AS new_ip FROM l JOIN first USING (host)
WHERE ip <> coalesce(old, '') AND (old IS NOT NULL OR ip0 = '')"""

# --- metrics ---------------------------------------------------------------------------------------

ORACLES["classified_counts"] = f"""
WITH {DECIDED} SELECT stmt_class, CASE WHEN action = 'keep' THEN 'true' ELSE 'false' END AS kept, count(*) AS n
FROM d GROUP BY ALL"""
ORACLES["error_rate"] = f"""
WITH a AS ({t('attempts')}) SELECT count(*) AS attempts, count(target_error) AS errors,
count(target_error) / count(*) AS error_rate, count(target_error) / count(*) > 0.01 AS alert FROM a"""
ORACLES["exec_histogram"] = f"WITH {_times('line_results')}, {_HISTOGRAM} SELECT side, le, n FROM h"
ORACLES["p99_nearest_rank"] = f"WITH {_times('order_results')}, {_p99()} SELECT * FROM q"
ORACLES["p99_recent"] = f"WITH {_times('order_results')}, {_p99(5000)} SELECT * FROM q"
# The sketch may be off by few ranks; the derived times are equal far around this rank.
ORACLES["p99_approx"] = f"""
WITH {_times('line_results')} SELECT side, quantile_disc(seconds, 0.99) AS p99 FROM times
WHERE seconds > 0 GROUP BY side"""
ORACLES["alerts"] = f"""
WITH g AS ({t('gauges')}) SELECT pos, CAST(lag_s > 60 AS DOUBLE) AS alert_lag,
CAST(depth * 10 > 100000 AS DOUBLE) AS alert_depth, CAST((pos % 3) / 100.0 > 0.01 AS DOUBLE) AS alert_error_rate,
CAST(pos % 2 > 0 AND pos % 4 > 2 * (pos % 2) AS DOUBLE) AS alert_p99,
CAST((pos % 5) / 1000.0 > 0.001 AS DOUBLE) AS alert_drop_rate FROM g"""
ORACLES["throughput"] = f"""
WITH {EVENTS} SELECT date_trunc('hour', ts) AS ts, CASE WHEN db_user = 'User1' THEN 'target' ELSE 'source' END AS side,
count(*) AS n, count(*) / 3600.0 AS qps FROM e GROUP BY ALL"""
ORACLES["compare_results"] = f"""
WITH {_diffs('line_results', 3.0)} SELECT conn_key, event_seq, attempt, diff_type,
CASE diff_type WHEN 'ERROR' THEN concat('target error: ', target_error) WHEN 'SLOW' THEN
printf('target %.0fms vs source %.0fms (%.1fx slower)', target_exec_ms, source_exec_ms, target_exec_ms / source_exec_ms)
END AS message FROM c"""
ORACLES["match_results"] = f"""
WITH r AS ({t('order_results')}), s AS (SELECT * FROM r WHERE source_exec_ms >= 5),
x AS (SELECT * FROM r WHERE target_exec_ms <= 1500),
j AS (SELECT coalesce(s.conn_key, x.conn_key) AS conn_key, coalesce(s.event_seq, x.event_seq) AS event_seq,
  CASE WHEN x.event_seq IS NULL THEN 'lost' WHEN s.event_seq IS NULL THEN 'extra' ELSE 'both' END AS presence,
  s.source_exec_ms AS se, s.source_error AS serr, x.target_exec_ms AS te, x.target_error AS terr
  FROM s FULL JOIN x ON s.conn_key = x.conn_key AND s.event_seq = x.event_seq)
SELECT conn_key, event_seq, presence, CASE WHEN terr IS NOT NULL AND serr IS NULL THEN 'ERROR'
WHEN se > 0 AND te > se * 2 THEN 'SLOW' ELSE 'NONE' END AS diff_type FROM j"""
ORACLES["diff_summary"] = f"""
WITH {_diffs('order_results', 2.0)} SELECT diff_type, count(*) AS n FROM c
WHERE diff_type <> 'NONE' GROUP BY diff_type"""
ORACLES["diff_summary_first"] = f"""
WITH {_diffs('order_results', 2.0)} SELECT diff_type, count(*) AS n FROM
(SELECT * FROM c WHERE diff_type <> 'NONE' ORDER BY pos LIMIT 5000) GROUP BY diff_type"""
ORACLES["diff_totals"] = f"""
WITH r AS ({t('line_results')}) SELECT CASE WHEN target_error IS NOT NULL AND source_error IS NULL THEN 'ERROR'
WHEN source_exec_ms > 0 AND target_exec_ms > source_exec_ms * 3 THEN 'SLOW'
WHEN source_error IS NOT NULL AND target_error IS NULL THEN 'ERROR' END AS diff_type, count(*) AS n
FROM r GROUP BY 1 HAVING diff_type IS NOT NULL"""
ORACLES["progress"] = f"""
WITH l AS ({t('progress_log')}), a AS (SELECT count(CASE WHEN kind = 'produced' THEN 1 END) AS produced,
  count(CASE WHEN kind = 'consumed' THEN 1 END) AS consumed, count(CASE WHEN kind = 'replayed' THEN 1 END) AS replayed,
  count(CASE WHEN kind = 'failed' THEN 1 END) AS failed, count(CASE WHEN kind = 'skipped' THEN 1 END) AS skipped,
  coalesce(max_by(lag_ms, CASE WHEN kind = 'replayed' THEN ts END), 0) AS current_lag_ms,
  max(CASE WHEN kind = 'produced' THEN ts END) AS last_produce, max(CASE WHEN kind = 'replayed' THEN ts END) AS last_replay FROM l)
SELECT *, CAST(2678400 AS DOUBLE) AS uptime_s, CAST(100 AS BIGINT) AS kafka_lag, produced / 2678400 AS produce_rate,
replayed / 2678400 AS replay_rate FROM a"""
ORACLES["is_stale"] = f"""
WITH l AS ({t('progress_log')}) SELECT TIMESTAMP '2024-02-01 00:00:00' - max(CASE WHEN kind = 'produced' THEN ts END)
> INTERVAL 90000 SECONDS AS is_stale FROM l"""

# --- streams -----------------------------------------------------------------------------------------

ORACLES["stream_classify_guard"] = f"""
WITH {CLASSED}, r AS (SELECT *, CASE WHEN stmt_class IN ('unknown', 'plain_select') THEN 'drop' ELSE 'keep' END AS action,
  CASE WHEN {_DDL} THEN 'ddl' END AS guard_rule FROM k),
o AS (SELECT *, CASE WHEN guard_rule IS NULL THEN {rewritten_all('sql')} ELSE sql END AS sql_out FROM r)
SELECT pos, stmt_class, action, guard_rule, sql_out, CASE WHEN guard_rule IS NOT NULL THEN 'block'
WHEN sql_out <> sql THEN 'rewrite' ELSE 'allow' END AS guard FROM o"""
ORACLES["stream_sessionize_events"] = f"""
WITH {_messages()} SELECT conn_key, pos, ev_sql AS sql, ev_cls AS stmt_class, CAST(seq AS BIGINT) AS seq, tx_pos, tx_state
FROM g WHERE is_event"""
_WATERMARK = "(SELECT max(ts) - INTERVAL 30 SECONDS FROM e)"
ORACLES["stream_metrics"] = f"""
WITH {CLASSED}, w AS (SELECT date_trunc('hour', ts) AS from_ts, date_trunc('hour', ts) + INTERVAL 1 HOUR AS to_ts, stmt_class,
  CASE WHEN stmt_class IN ('unknown', 'plain_select') THEN 'drop' ELSE 'keep' END AS action, count(*) AS n FROM k GROUP BY ALL)
SELECT * FROM w WHERE to_ts <= {_WATERMARK}"""
ORACLES["stream_sessions"] = f"""
WITH {EVENTS}, l AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOURS, true) AS fresh FROM e
  WINDOW w AS (PARTITION BY conn_key ORDER BY ts)),
n AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY conn_key ORDER BY ts) AS life FROM l),
s AS (SELECT conn_key, min(ts) AS started, max(ts) AS ended, count(*) AS segments FROM n GROUP BY conn_key, life)
SELECT * FROM s WHERE ended + INTERVAL 6 HOURS <= {_WATERMARK}"""
ORACLES["stream_connections"] = f"""
WITH {LIVES}, last AS (SELECT conn_key, max(life) AS life FROM lives GROUP BY conn_key)
SELECT lives.* FROM lives LEFT JOIN last USING (conn_key, life)
WHERE last.life IS NULL OR ended + INTERVAL 20000 SECONDS <= (
  SELECT max(ts) - INTERVAL 30 SECONDS FROM keyed)"""
# Windows of 14 days begin every 7 days from the epoch on; outcomes come up to an hour later.
ORACLES["stream_outcomes"] = f"""
WITH r AS ({t('order_results')}),
m AS (SELECT ts, source_exec_ms > 0 AND target_exec_ms > 2 * source_exec_ms AS slow,
  coalesce(target_error, '') <> '' AND coalesce(source_error, '') = '' AS differs,
  target_error IS NOT NULL AS failed, target_exec_ms <= 1500 AND event_seq % 90 <= 60 AS ran FROM r),
w AS (SELECT unnest([epoch(ts)::BIGINT // 604800 - 1, epoch(ts)::BIGINT // 604800]) AS k, * FROM m),
c AS (SELECT k, count(*) AS n, count(*) FILTER (ran) AS attempts, count(*) FILTER (ran AND failed) AS errors,
  count(*) FILTER (NOT ran) AS lost, count(*) FILTER (ran AND differs) AS diff_errors,
  count(*) FILTER (ran AND slow AND NOT differs) AS diff_slow FROM w GROUP BY k)
SELECT TIMESTAMP '1970-01-01' + k * INTERVAL 7 DAYS AS from_ts, TIMESTAMP '1970-01-01' + (k + 2) * INTERVAL 7 DAYS AS to_ts,
  attempts, errors, CASE WHEN attempts > 0 THEN errors / attempts ELSE 0.0 END AS error_rate,
  attempts > 0 AND errors / attempts > 0.01 AS alert, lost, diff_errors, diff_slow,
  n / 1209600.0 AS source_qps, attempts / 1209600.0 AS target_qps
FROM c WHERE (k + 2) * 604800 <= (SELECT epoch(max(ts))::BIGINT FROM r) - 3630"""
_HEALTH = {
    "packets_received_total": "SELECT sum(received_delta) FROM loss",
    "packets_dropped_total": "SELECT sum(dropped_delta) FROM loss",
    "packet_drop_rate": "SELECT max_by(drop_rate, ts) FROM loss",
    "alert_packet_drop_rate": "SELECT max_by(drop_rate, ts) > 0.001 FROM loss",
    "parse_errors_total": "SELECT parse_errors FROM bad",
    "queue_depth": "SELECT max_by(depth, pos) FROM depth",
    "alert_queue_depth": "SELECT max_by(depth, pos) > 100000 FROM depth",
    "replay_lag_seconds": "SELECT max_by(lag_s, pos) FROM lag",
    "alert_replay_lag": "SELECT max_by(lag_s, pos) > 60 FROM lag",
    "source_qps": "SELECT max_by(n, minute) / 60 FROM speed WHERE side = 'source'",
    "target_qps": "SELECT max_by(n, minute) / 60 FROM speed WHERE side = 'target'"}
ORACLES["health_catalog"] = f"""
WITH {_times('line_results')}, loss AS ({ORACLES['capture_loss']}), bad AS ({ORACLES['parse_error_counts']}),
depth AS ({ORACLES['queue_depth']}), lag AS ({ORACLES['replay_lag']}),
speed AS (WITH {EVENTS} SELECT CASE WHEN db_user = 'User1' THEN 'target' ELSE 'source' END AS side,
  date_trunc('minute', ts) AS minute, count(*) AS n FROM e GROUP BY ALL),
sums AS (SELECT side, sum(CAST(seconds AS DECIMAL(28, 9))) AS s, count(*) AS n FROM times WHERE seconds > 0 GROUP BY side)
{" UNION ALL ".join(f"SELECT 'sqltide_{name}' AS name, NULL AS side, CAST(({sql}) AS DOUBLE) AS value"
                    for name, sql in _HEALTH.items())}
UNION ALL SELECT 'sqltide_exec_time_seconds_sum', side, CAST(s AS DOUBLE) FROM sums
UNION ALL SELECT 'sqltide_exec_time_seconds_count', side, CAST(n AS DOUBLE) FROM sums"""
ORACLES["deliver_plan"] = f"WITH {EVENTS} SELECT conn_key AS lane, pos, NOT ({_TX_CONTROL}) AS send FROM e"
