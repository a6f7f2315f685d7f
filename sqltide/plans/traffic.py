"""Traffic tables derived from the given tables, in SQL that Spark and DuckDB both run.

``{events}``, ``{orders}``, ``{lineitem}``, ``{conversations}`` and ``{documents}`` stand
for the tables. Each row of a given table becomes one row of traffic, so the work grows
with the data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_N = "CAST(event_id AS VARCHAR(20))"
_CONN = ("concat('10.0.', CAST(user_id % 200 AS VARCHAR(10)), '.7:', "
         "CAST(1024 + user_id AS VARCHAR(10)), '-10.1.0.1:5432')")

STATEMENT = f"""
CASE event_type
WHEN 'view' THEN CASE event_id % 6
  WHEN 0 THEN concat('SELECT * FROM pages WHERE id = ', {_N})
  WHEN 1 THEN concat('SELECT count(*), max(id) FROM pages WHERE id IN (', {_N}, ', 2)')
  WHEN 2 THEN concat('WITH c AS (SELECT id FROM pages WHERE id = ', {_N}, ') SELECT * FROM c')
  WHEN 3 THEN concat('/* hint: f(x) */ SELECT name -- note; COMMIT', chr(10), ' FROM pages WHERE id = ', {_N})
  WHEN 4 THEN concat('SELECT ''it''''s; DROP TABLE t'' AS label, $$ run_me(1); COMMIT $$ AS body FROM pages WHERE id = ', {_N})
  ELSE concat('select "Count"(1), upper(''x'') from pages where id = ', {_N}) END
WHEN 'click' THEN CASE event_id % 4
  WHEN 0 THEN concat('SELECT track_click(', {_N}, ')')
  WHEN 1 THEN concat('SELECT app.do_work(', {_N}, ', now())')
  WHEN 2 THEN concat('CALL refresh_totals(', {_N}, ')')
  ELSE 'EXPLAIN SELECT 1' END
WHEN 'purchase' THEN CASE event_id % 5
  WHEN 0 THEN concat('INSERT INTO orders VALUES (', {_N}, ', now(), ''now() 4111111111111111'')')
  WHEN 1 THEN concat('UPDATE orders SET paid = current_timestamp, day = CURRENT_DATE, at = current_time WHERE id = ', {_N})
  WHEN 2 THEN concat('WITH d AS (DELETE FROM carts WHERE id = ', {_N}, ' RETURNING *) INSERT INTO orders SELECT * FROM d')
  WHEN 3 THEN concat('BEGIN; INSERT INTO audit_log VALUES (', {_N}, '); COMMIT')
  ELSE concat('SELECT 1; DELETE FROM carts WHERE id = ', {_N}, ';') END
WHEN 'signup' THEN CASE event_id % 6
  WHEN 0 THEN 'BEGIN' WHEN 1 THEN 'COMMIT' WHEN 2 THEN ' rollback'
  WHEN 3 THEN 'ROLLBACK TO SAVEPOINT s1' WHEN 4 THEN '-- open
START TRANSACTION' ELSE 'SAVEPOINT s1' END
ELSE CASE event_id % 8
  WHEN 0 THEN 'VACUUM' WHEN 1 THEN 'DROP TABLE t' WHEN 2 THEN 'SET x = 1'
  WHEN 3 THEN 'DISCARD ALL' WHEN 4 THEN 'COPY orders FROM STDIN'
  WHEN 5 THEN 'COPY (SELECT * FROM orders) TO STDOUT'
  WHEN 6 THEN concat('SELECT * FROM dblink(''host=x'', ''select ', {_N}, ''')')
  ELSE '/* a */ TRUNCATE t' END
END"""

TABLES = {
    # statements of client connections
    "sql_events": f"""
SELECT {_CONN} AS conn_key, event_id AS pos, CAST(ts AS TIMESTAMP) AS ts,
       concat('User', CAST(user_id % 7 AS VARCHAR(10))) AS db_user,
       concat('db', CAST(user_id % 9 AS VARCHAR(10))) AS database,
       {STATEMENT} AS sql
FROM {{events}}""",

    # both directions of the protocol; chunk is text here
    "messages": f"""
SELECT {_CONN} AS conn_key, event_id AS pos, CAST(ts AS TIMESTAMP) AS ts,
       event_id % 16 NOT IN (12, 13, 15) AS from_client,
       CASE WHEN event_id % 16 <= 3 THEN 'Q' WHEN event_id % 16 <= 5 THEN 'P'
            WHEN event_id % 16 <= 8 THEN 'B' WHEN event_id % 16 <= 10 THEN 'd'
            WHEN event_id % 16 = 11 THEN CASE WHEN value > 20 THEN 'c' ELSE 'f' END
            WHEN event_id % 16 = 12 THEN 'C' WHEN event_id % 16 = 14 THEN 'Q'
            ELSE 'Z' END AS msg_type,
       CASE WHEN event_id % 16 = 14 THEN concat('COPY t', {_N}, ' FROM STDIN')
            WHEN event_id % 16 <= 5 THEN {STATEMENT} END AS sql,
       CASE WHEN event_id % 16 BETWEEN 4 AND 8
            THEN CASE WHEN value > 30 THEN 's1' ELSE '' END END AS stmt_name,
       CASE WHEN event_id % 16 IN (9, 10) THEN props END AS chunk,
       CASE WHEN event_id % 16 IN (13, 15) THEN CASE event_type WHEN 'view' THEN 'I'
            WHEN 'click' THEN 'T' WHEN 'purchase' THEN 'E' ELSE '?' END END AS tx_status
FROM {{events}}""",

    # requests and responses of conversations: user asks, assistant completes
    "dialogue": """
SELECT concat('c', CAST(conv_id AS VARCHAR(20))) AS conn_key, conv_id * 1024 + turn AS pos,
       role <> 'assistant' AS from_client,
       CASE role WHEN 'user' THEN 'Q' WHEN 'assistant' THEN 'C' ELSE 'Z' END AS msg_type,
       text AS sql
FROM {conversations}""",

    # network segments; sequence numbers pass the 32-bit limit
    "segments": f"""
SELECT event_id AS pos, CAST(ts AS TIMESTAMP) AS ts,
       CASE WHEN event_id % 2 = 0 THEN concat(CASE WHEN user_id % 3 = 0 THEN '::ffff:' ELSE '' END,
            '10.0.0.', CAST(user_id % 250 AS VARCHAR(10))) ELSE '10.1.0.1' END AS src_ip,
       CASE WHEN event_id % 2 = 0 THEN CAST(1024 + user_id AS INT)
            WHEN user_id % 11 = 0 THEN 6543 ELSE 5432 END AS src_port,
       CASE WHEN event_id % 2 = 0 THEN '10.1.0.1' ELSE concat('10.0.0.',
            CAST(user_id % 250 AS VARCHAR(10))) END AS dst_ip,
       CASE WHEN event_id % 2 = 1 THEN CAST(1024 + user_id AS INT)
            WHEN user_id % 11 = 0 THEN 6543 ELSE 5432 END AS dst_port,
       (4294900000 + event_id * 7) % 4294967296 AS tcp_seq,
       CASE WHEN event_type = 'signup' THEN 0 ELSE CAST(floor(value * 100) AS INT) END AS len,
       CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'FIN,ACK'
            WHEN 1 THEN 'RST' ELSE 'ACK' END
            WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'SYN' ELSE 'ACK' END AS flags
FROM {{events}}""",

    "capture_stats": """
SELECT CAST(ts AS TIMESTAMP) AS ts, (event_id * 1000) % 500000 AS received,
       (event_id * 3) % 700 AS dropped FROM {events}""",

    "gauges": """
SELECT CAST(ts AS TIMESTAMP) AS ts, event_id AS pos, (event_id * 7919) % 20000 AS depth,
       value AS lag_s FROM {events}""",

    "flow": """
SELECT event_id AS pos, CASE WHEN event_type IN ('view', 'click') THEN 'consumed'
       ELSE 'produced' END AS kind FROM {events}""",

    "signals": """
SELECT CAST(ts AS TIMESTAMP) AS ts, CASE WHEN value > 20 THEN 'active' ELSE 'paused' END AS state
FROM {events} WHERE event_type = 'signup'""",

    "resolutions": """
SELECT concat('db', CAST(user_id % 5 AS VARCHAR(5))) AS host, CAST(ts AS TIMESTAMP) AS ts,
       CASE WHEN event_type = 'error' THEN '' ELSE concat('10.2.0.',
            CAST(CAST(floor(value / 25) AS INT) AS VARCHAR(10))) END AS ip
FROM {events}""",

    "progress_log": """
SELECT CAST(ts AS TIMESTAMP) AS ts, CASE event_type WHEN 'view' THEN 'produced'
       WHEN 'click' THEN 'consumed' WHEN 'purchase' THEN 'replayed' WHEN 'signup' THEN 'failed'
       ELSE 'skipped' END AS kind, CAST(floor(value * 10) AS BIGINT) AS lag_ms
FROM {events}""",

    # outcomes of both sides, per order line and per order
    "line_results": """
SELECT concat('s', CAST(l_suppkey AS VARCHAR(20))) AS conn_key, l_orderkey AS event_seq,
       l_orderkey AS pos, l_linenumber AS attempt,
       concat('SELECT ', CAST(l_partkey AS VARCHAR(20))) AS sql,
       l_quantity AS source_exec_ms, l_quantity * (1 + l_linenumber % 5) AS target_exec_ms,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'duplicate key value' END AS target_error,
       CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'timeout' END AS source_error,
       CAST(l_shipdate AS TIMESTAMP) AS ts
FROM {lineitem}""",

    "order_results": """
SELECT concat('c', CAST(o_custkey AS VARCHAR(20))) AS conn_key, o_orderkey AS event_seq,
       o_orderkey AS pos, concat('UPDATE orders SET priority = ''', o_orderpriority,
       ''', note = ''long enough to pass the preview of one hundred bytes'' WHERE id = ',
       CAST(o_orderkey AS VARCHAR(20))) AS sql,
       CAST(floor(o_totalprice / 1000) AS DOUBLE) AS source_exec_ms,
       CAST(floor(o_totalprice / 1000) * (1 + o_custkey % 4) AS DOUBLE) AS target_exec_ms,
       CASE WHEN o_orderstatus = 'P' THEN concat('line 1', chr(10), 'key "', o_orderpriority, '"') END AS target_error,
       CASE WHEN o_orderstatus = 'P' AND o_custkey % 3 = 0 THEN 'same' END AS source_error,
       CAST(o_orderdate AS TIMESTAMP) AS ts
FROM {orders}""",

    "attempts": """
SELECT concat('c', CAST(l_orderkey % 100 AS VARCHAR(20))) AS conn_key, l_orderkey AS event_seq,
       l_orderkey AS pos, l_linenumber AS attempt,
       CASE WHEN l_returnflag = 'R' THEN 'deadlock' END AS target_error
FROM {lineitem}""",

    # statements that carry whole documents as literals
    "document_sql": """
SELECT concat('d', CAST(doc_id % 50 AS VARCHAR(20))) AS conn_key, doc_id AS pos,
       concat('INSERT INTO docs VALUES (', CAST(doc_id AS VARCHAR(20)), ', now(), ''',
              replace(text, '''', ''''''), ''') -- ', source) AS sql
FROM {documents}""",

    # 1 to 60 levels around whole documents: balanced, one sign too many, one too few
    "deep_parentheses": """
SELECT doc_id AS pos, concat('select ''', replace(coalesce(text, ''), '''', ''''''), ''', ',
       repeat('(a ; ', CAST(doc_id % 60 + 1 AS INT)), 'b', repeat(' )', CAST(
           doc_id % 60 + CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INT)),
       ' ; drop table t') AS sql
FROM {documents}""",

    "deep_comments": """
SELECT doc_id AS pos, concat('select ''', replace(coalesce(text, ''), '''', ''''''), ''' ',
       repeat('/* it''s ; ', CAST(doc_id % 60 + 1 AS INT)), repeat(' */', CAST(
           doc_id % 60 + CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INT)),
       ' ; delete from t') AS sql
FROM {documents}""",
    # resets sent as prepared statements, parsed well before they are bound, names used again
    "prepared_resets": """
SELECT concat('c', CAST(o_custkey % 100 AS VARCHAR(20))) AS conn_key, o_orderkey * 16 AS pos,
       CAST(o_orderdate AS TIMESTAMP) AS ts, true AS from_client, 'P' AS msg_type,
       'DISCARD ALL' AS sql, concat('s', CAST(o_orderkey % 3 AS VARCHAR(20))) AS stmt_name
FROM {orders}
UNION ALL
SELECT concat('c', CAST(o_custkey % 100 AS VARCHAR(20))),
       (o_orderkey + 100 * (o_orderkey % 7)) * 16 + 1 + o_orderkey % 7,
       CAST(o_orderdate AS TIMESTAMP), true, 'B', CAST(NULL AS VARCHAR(20)),
       concat('s', CAST(o_orderkey % 3 AS VARCHAR(20)))
FROM {orders}
UNION ALL
SELECT concat('c', CAST(o_custkey % 100 AS VARCHAR(20))), o_orderkey * 16 + 12,
       CAST(o_orderdate AS TIMESTAMP), true, 'Q',
       CASE WHEN o_orderkey % 50 = 0 THEN 'RESET ALL' ELSE 'SELECT 1' END, CAST(NULL AS VARCHAR(20))
FROM {orders}""",
}

GIVEN = ("events", "orders", "lineitem", "conversations", "documents")


def oracle_table(name: str) -> str:
    return TABLES[name].format(**{t: t for t in GIVEN}).strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(TABLES[name].format(
        **{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in GIVEN}))


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of files."""
    views = {}
    for given in GIVEN:
        if f"{{{given}}}" in TABLES[name]:
            path = f"{sf_dir}/{given}.parquet"
            schema = spark.read.parquet(path).schema
            views[given] = f"stream_{given}_{uuid.uuid4().hex}"
            spark.readStream.schema(schema).parquet(f"{sf_dir}/{given}*.parquet") \
                .createOrReplaceTempView(views[given])
    return spark.sql(TABLES[name].format(**{t: views.get(t, t) for t in GIVEN}))
