"""Fixed schemas of the traffic tables.

Schemas are declared, never inferred. ``pos`` is the capture position: unique over a
whole capture and increasing in arrival order. ``ts`` alone is not a total order, as
messages that arrived together share one timestamp.
"""

from pyspark.sql import types as T

PARAM = T.StructType([
    T.StructField("oid", T.LongType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("format", T.ShortType()),
])

CONN = T.StructType([
    T.StructField("src_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("dst_port", T.IntegerType()),
])

SEGMENTS = T.StructType([
    T.StructField("pos", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("tcp_seq", T.LongType()),
    T.StructField("len", T.IntegerType()),
    T.StructField("flags", T.StringType()),
    T.StructField("payload", T.BinaryType()),
])

MESSAGES = T.StructType([
    T.StructField("conn_key", T.StringType()),
    T.StructField("life", T.LongType()),
    T.StructField("pos", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("from_client", T.BooleanType()),
    T.StructField("msg_type", T.StringType()),
    T.StructField("sql", T.StringType()),
    T.StructField("stmt_name", T.StringType()),
    T.StructField("param_oids", T.ArrayType(T.LongType())),
    T.StructField("param_formats", T.ArrayType(T.ShortType())),
    T.StructField("param_values", T.ArrayType(T.BinaryType())),
    T.StructField("chunk", T.BinaryType()),
    T.StructField("tx_status", T.StringType()),
    T.StructField("database", T.StringType()),
    T.StructField("db_user", T.StringType()),
])

SQL_EVENTS = T.StructType([
    T.StructField("conn_key", T.StringType()),
    T.StructField("life", T.LongType()),
    T.StructField("pos", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("sql", T.StringType()),
    T.StructField("tx_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("extended", T.BooleanType()),
    T.StructField("stmt_name", T.StringType()),
    T.StructField("params", T.ArrayType(PARAM)),
    T.StructField("copy_data", T.ArrayType(T.BinaryType())),
    T.StructField("source_exec_ns", T.LongType()),
    T.StructField("database", T.StringType()),
    T.StructField("db_user", T.StringType()),
])

REPLAY_RESULTS = T.StructType([
    T.StructField("conn_key", T.StringType()),
    T.StructField("event_seq", T.LongType()),
    T.StructField("sql", T.StringType()),
    T.StructField("source_exec_ms", T.DoubleType()),
    T.StructField("target_exec_ms", T.DoubleType()),
    T.StructField("source_error", T.StringType()),
    T.StructField("target_error", T.StringType()),
    T.StructField("rows_affected", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("attempt", T.IntegerType()),
])

CAPTURE_STATS = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("received", T.LongType()),
    T.StructField("dropped", T.LongType()),
])

STMT_CLASSES = (
    "plain_select", "proc_select", "call", "dml", "ddl",
    "begin", "commit_rollback", "utility", "copy_from", "unknown",
)
