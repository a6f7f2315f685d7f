"""Every operator as a query over the given tables.

``QUERIES[name](spark, sf_dir)`` returns a frame; ``oracles.ORACLES[name]`` is the same
result in plain SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltide.functions import sqltext as S
from sqltide.functions.params import split_params, zip_params
from sqltide.operators import capture, decide, guard, metrics, replay, scan, sessions
from sqltide.operators.decide import FilterOptions
from sqltide.operators.guard import GuardOptions
from sqltide.operators.sessions import SessionOptions
from sqltide.plans import pipeline
from sqltide.plans.traffic import stream, table
from sqltide.sources import codec, exports, kafka, log, tables
from sqltide.streaming import flow, outcomes
from sqltide.streaming.lives import stream_connections as closed_lives
from sqltide.streaming.sessionize import stream_sessionize

QUERIES = {}

MASKS = ((r"\b\d{16}\b", "****"), (r"([A-Za-z0-9._]+)@([A-Za-z0-9.]+)", "$1@masked"))
TABLE_RULES = GuardOptions(include_tables=("orders", "pages", "carts"), exclude_tables=("carts",))
ALL_RULES = GuardOptions(
    exclude_ddl=True, rewrite_time_functions=True, skip_external_deps=True,
    mask_patterns=MASKS, replay_percentage=80, exclude_tables=("carts",),
    include_users=("user0", "USER1", "User2", "user3", "user4"))
RULES = FilterOptions(
    exclude_patterns=(r"IN \(",), include_patterns=(r"^/\*",),
    replayable_procedures=("app.do_work",), rules={"proc_select": ("keep", "drop")})


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def ntz(c: str | Column) -> Column:
    """Timestamps leave as wall-clock times, independent of the session's zone."""
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with bound parameters and binary chunks."""
    n = (F.col("pos") % 4).cast("int")
    text = F.col("pos").cast("string")
    return table(spark, sf, "messages").withColumns({
        "chunk": F.col("chunk").cast("binary"),
        "param_oids": F.when(F.col("msg_type") == "P", F.slice(
            F.array(F.lit(23).cast("long"), F.col("pos") % 100, F.lit(25).cast("long")), F.lit(1), n)),
        "param_formats": F.when(F.col("msg_type") == "B", F.slice(
            F.array(*[F.lit(x).cast("short") for x in (1, 0, 1)]), F.lit(1), n)),
        "param_values": F.when(F.col("msg_type") == "B", F.slice(F.array(
            F.concat(F.lit("v"), text).cast("binary"), F.lit(None).cast("binary"),
            text.cast("binary")), F.lit(1), (F.floor(F.col("pos") / 4) % 4).cast("int"))),
    })


def params_text(params: Column) -> Column:
    return F.array_join(F.transform(params, lambda p: F.concat_ws(
        "/", p["oid"].cast("string"), F.coalesce(p["value"].cast("string"), F.lit("~")),
        p["format"].cast("string"))), ",")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scan.checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_stream(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over all files there are, into files, and read them back."""
    path = scratch(df.sparkSession, name)
    writer = df.writeStream.format("parquet").outputMode("append") \
        .option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")


def run_stateful(df: DataFrame, name: str) -> DataFrame:
    """The same for streams with state of their own, which only the RocksDB store holds."""
    spark, key = df.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(
        key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run_stream(df, name)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


# --- sources and sinks -------------------------------------------------------------------

@query
def read_messages(spark, sf):
    path = scratch(spark, "messages")
    messages(spark, sf).withColumn("life", F.lit(0).cast("long")).write.parquet(path)
    return tables.read_messages(spark, path).groupBy("conn_key", "msg_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"))


@query
def kafka_frames(spark, sf):
    frames = kafka.kafka_frames(table(spark, sf, "sql_events"))
    decoded = codec.decode_events(frames)
    return decoded.select("key", F.col("event.pos").alias("pos"), F.col("event.sql").alias("sql"),
                          ntz("event.ts").alias("ts"), "corrupt")


@query
def spool_events(spark, sf):
    path = scratch(spark, "spool")
    events = stream(spark, sf, "sql_events")
    tables.spool_events(events, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return tables.read_spool(spark, f"{path}/out", events.schema, streaming=False).select(
        "conn_key", "pos", "sql")


def _logged(records: DataFrame) -> DataFrame:
    return codec.good_events(codec.decode_events(records)).select(
        "conn_key", "pos", ntz("ts").alias("ts"), "sql", "db_user")


@query
def event_log(spark, sf):
    path = scratch(spark, "log")
    log.append_log(codec.encode_events(table(spark, sf, "sql_events")), path)
    return _logged(log.read_log(spark, path))


@query
def stream_event_log(spark, sf):
    path = scratch(spark, "log")
    events = codec.encode_events(stream(spark, sf, "sql_events"))
    log.stream_to_log(events, f"{path}/log", f"{path}/checkpoint").awaitTermination()
    return _logged(run_stream(log.read_log(spark, f"{path}/log", streaming=True), "log-read"))


def _broken_records(spark, sf):
    events = table(spark, sf, "sql_events")
    frames = codec.encode_events(events.withColumn("life", F.lit(0).cast("long")))
    pos = F.get_json_object("value", "$.pos").cast("long")
    user = F.get_json_object("value", "$.db_user")
    return frames.select(
        (pos % 4).alias("partition"), pos.alias("offset"),
        F.when(user.isin("User3", "User4", "User5"), F.expr("substring(value, 3)"))
         .otherwise(F.col("value")).alias("value"))


@query
def decode_events(spark, sf):
    decoded = codec.decode_events(_broken_records(spark, sf))
    return decoded.select("offset", "corrupt", F.col("event.sql").alias("sql"),
                          F.col("event.conn_key").alias("conn_key"))


@query
def decode_breaker(spark, sf):
    return codec.breaker_state(codec.decode_events(_broken_records(spark, sf)), limit=5)


@query
def consume_until_break(spark, sf):
    decoded = codec.decode_events(_broken_records(spark, sf))
    return codec.consume_until_break(decoded, limit=5).select("partition", "offset", "corrupt")


@query
def error_export(spark, sf):
    failures = table(spark, sf, "sql_events").withColumn(
        "error", F.when(F.col("db_user") == "User1", F.concat(F.lit("a"), F.char(F.lit(10)), F.lit("b")))
        .when(F.col("db_user") != "User2", F.lit("deadlock")))
    return exports.error_records(failures).withColumnRenamed("value", "line")


@query
def diff_export(spark, sf):
    return exports.diff_records(metrics.compare_results(table(spark, sf, "order_results"))) \
        .withColumnRenamed("value", "line")


@query
def route_by_database(spark, sf):
    path = scratch(spark, "routed")
    exports.route_by_database(table(spark, sf, "sql_events"), path)
    return spark.read.parquet(path).groupBy("database").agg(
        F.count(F.lit(1)).alias("n"), F.max("pos").alias("last_pos"))


@query
def metrics_exposition(spark, sf):
    decided = decide.decisions(table(spark, sf, "sql_events"))
    results = table(spark, sf, "order_results")
    rows = pipeline.metric_catalog(decided, results, metrics.exec_times(results))
    return exports.metrics_exposition(rows).withColumnRenamed("value", "line")


@query
def health_catalog(spark, sf):
    events = table(spark, sf, "sql_events")
    sides = events.withColumn("side", F.when(F.col("db_user") == "User1", "target").otherwise("source"))
    rows = pipeline.health_catalog(
        capture.capture_loss(table(spark, sf, "capture_stats")),
        sessions.parse_error_counts(messages(spark, sf)),
        replay.queue_depth(table(spark, sf, "flow")),
        replay.replay_lag(events, F.lit("2024-02-01 00:00:00").cast("timestamp")),
        metrics.throughput(sides, "1 minute"), metrics.exec_times(table(spark, sf, "line_results")))
    return rows.select("name", F.col("labels")["side"].alias("side"), "value")


# --- captured segments -------------------------------------------------------------------

@query
def capture_filter(spark, sf):
    return capture.capture_filter(table(spark, sf, "segments")).select("pos", "src_port", "dst_port")


@query
def capture_filter_host(spark, sf):
    return capture.capture_filter(
        table(spark, sf, "segments"), source_host="10.0.0.11", source_port=6543,
    ).select("pos", "src_ip", "dst_ip")


@query
def canonical_conn(spark, sf):
    return capture.canonical_conn(table(spark, sf, "segments")).select(
        "pos", "conn_key", "from_client")


@query
def order_segments(spark, sf):
    rows = capture.canonical_conn(table(spark, sf, "segments"))
    return capture.order_segments(rows).select(
        "pos", "conn_key", "from_client", "stream_seq", "status", "new_bytes", "gap_bytes")


@query
def order_segments_by_life(spark, sf):
    rows = capture.canonical_conn(table(spark, sf, "segments"))
    return capture.order_segments(capture.assign_life(rows, idle_seconds=20_000)).select(
        "pos", "life", "stream_seq", "status", "new_bytes", "gap_bytes")


@query
def connection_sessions(spark, sf):
    rows = capture.canonical_conn(table(spark, sf, "segments"))
    return capture.connection_sessions(rows, idle_seconds=20_000).withColumns(
        {"started": ntz("started"), "ended": ntz("ended")})


@query
def capture_loss(spark, sf):
    return capture.capture_loss(table(spark, sf, "capture_stats")).withColumn("ts", ntz("ts"))


# --- messages to events --------------------------------------------------------------------

@query
def extract_statements(spark, sf):
    return sessions.extract_statements(messages(spark, sf)).select("conn_key", "pos", "sql")


@query
def extract_statements_capped(spark, sf):
    return sessions.extract_statements(messages(spark, sf), max_sql_length=60).select(
        "conn_key", "pos", "sql")


@query
def statement_definitions(spark, sf):
    return sessions.statement_definitions(messages(spark, sf)).select(
        "conn_key", "stmt_name", "sql", "valid_from", "valid_to")


@query
def correlate_binds(spark, sf):
    return sessions.correlate_binds(messages(spark, sf)).select(
        "conn_key", "pos", "stmt_name", "sql", "orphan", params_text(F.col("params")).alias("params"))


@query
def zip_parameters(spark, sf):
    rows = messages(spark, sf).where(F.col("msg_type") == "B").withColumn(
        "oids", F.slice(F.array(F.lit(23).cast("long"), F.col("pos") % 100), F.lit(1),
                        (F.col("pos") % 3).cast("int")))
    zipped = rows.withColumn(
        "p", zip_params(F.col("oids"), F.col("param_formats"), F.col("param_values")))
    return zipped.select("pos", params_text(F.col("p")).alias("params"),
                         F.size(split_params(F.col("p"))["oids"]).alias("n_params"))


@query
def assemble_copy(spark, sf):
    return _loads(messages(spark, sf), SessionOptions())


@query
def assemble_copy_capped(spark, sf):
    return _loads(messages(spark, sf), SessionOptions(max_copy_bytes=18))


def _loads(rows, opts):
    return sessions.assemble_copy(rows, opts).select(
        "conn_key", "pos", "sql", "copy_bytes", F.size("copy_data").alias("n_chunks"),
        F.array_join(F.transform("copy_data", lambda c: c.cast("string")), "|").alias("data"))


@query
def assign_seq(spark, sf):
    return sessions.assign_seq(messages(spark, sf)).drop("life")


@query
def assign_tx_id(spark, sf):
    return sessions.assign_tx_id(messages(spark, sf)).drop("life")


@query
def pooler_sessions(spark, sf):
    return sessions.pooler_sessions(messages(spark, sf)).select("conn_key", "pos", "sess")


@query
def pooler_prepared_resets(spark, sf):
    return sessions.pooler_sessions(table(spark, sf, "prepared_resets")).select(
        "conn_key", "pos", "sess")


@query
def source_exec_time(spark, sf):
    return sessions.source_exec_time(messages(spark, sf)).drop("life")


@query
def dialogue_exec_counts(spark, sf):
    at = F.timestamp_seconds(F.col("pos"))
    return sessions.source_exec_time(table(spark, sf, "dialogue").withColumn("ts", at)).select(
        "conn_key", "pos", "seq", "exec_ns")


@query
def parse_error_counts(spark, sf):
    return sessions.parse_error_counts(messages(spark, sf))


@query
def parse_error_counts_capped(spark, sf):
    return sessions.parse_error_counts(
        messages(spark, sf), SessionOptions(max_sql_length=60, max_copy_bytes=18))


@query
def message_events(spark, sf):
    rows = sessions.sql_events(messages(spark, sf))
    return rows.select("conn_key", "pos", "sql", "tx_id", "seq", "extended", "stmt_name",
                       "source_exec_ns", "stmt_class", "tx_state",
                       params_text(F.col("params")).alias("params"))


@query
def message_decisions(spark, sf):
    return pipeline.capture_to_decisions(messages(spark, sf)).select(
        "conn_key", "pos", "stmt_class", "tx_state", "tx_id", "action", "reason")


# --- SQL text --------------------------------------------------------------------------------

def _statements(spark, sf):
    return table(spark, sf, "sql_events").select("pos", "sql")


@query
def sql_tokens_view(spark, sf):
    spaced = F.trim(F.regexp_replace(S.tokens_view(F.col("sql")), r"\s+", " "))
    return _statements(spark, sf).select("pos", spaced.alias("tokens"))


@query
def document_tokens_view(spark, sf):
    spaced = F.trim(F.regexp_replace(S.tokens_view(F.col("sql")), r"\s+", " "))
    return table(spark, sf, "document_sql").select("pos", spaced.alias("tokens"))


@query
def split_statements(spark, sf):
    return _statements(spark, sf).select(
        "pos", F.posexplode(S.split_statements(F.col("sql"))).alias("i", "statement"))


@query
def classify_statement(spark, sf):
    return _statements(spark, sf).select("pos", S.classify_single(F.col("sql")).alias("stmt_class"))


@query
def is_proc_invoking(spark, sf):
    return _statements(spark, sf).select("pos", S.is_proc_invoking(F.col("sql")).alias("invokes"))


@query
def primary_command(spark, sf):
    return _statements(spark, sf).where(F.col("sql").startswith("WITH")).select(
        "pos", S.primary_command(F.col("sql")).alias("command"))


@query
def classify_batch(spark, sf):
    return _statements(spark, sf).select("pos", S.classify_sql(F.col("sql")).alias("stmt_class"))


def _nested(spark, sf, name):
    sql, parts, tokens = F.col("sql"), F.col("parts"), F.col("tokens")
    # Used several times, so each text is folded once for its statements and once for its tokens.
    read = table(spark, sf, name).select(
        "pos", "sql", S.split_statements(sql).alias("parts"), S.tokens_view(sql).alias("tokens"))
    return read.select(
        "pos", F.size(parts).cast("long").alias("statements"),
        S.classify_sql(sql, tokens=tokens, statements=parts).alias("stmt_class"),
        S.classify_batch(sql, statements=parts).alias("batch_class"),
        S.primary_command(sql, tokens=tokens).alias("command"))


@query
def deep_parentheses(spark, sf):
    return _nested(spark, sf, "deep_parentheses")


@query
def deep_comments(spark, sf):
    return _nested(spark, sf, "deep_comments")


@query
def tx_state(spark, sf):
    return decide.tx_state(decide.with_class(table(spark, sf, "sql_events"))).select(
        "pos", "stmt_class", "tx_state")


@query
def rule_matrix(spark, sf):
    classed = decide.with_class(table(spark, sf, "sql_events"))
    counts = classed.groupBy("stmt_class").agg(F.count(F.lit(1)).alias("n"))
    matrix = decide.rule_matrix(spark, "write_only")
    return counts.join(F.broadcast(matrix), "stmt_class", "left")


@query
def decide_custom(spark, sf):
    return decide.decisions(table(spark, sf, "sql_events"), RULES).select(
        "pos", "stmt_class", "tx_state", "action", "reason")


@query
def decide_modes(spark, sf):
    rows = decide.tx_state(decide.with_class(table(spark, sf, "sql_events")))
    return metrics.union_all([
        decide.decide(rows, FilterOptions(mode=m)).groupBy("stmt_class", "tx_state", "action")
        .agg(F.count(F.lit(1)).alias("n")).withColumn("mode", F.lit(m)) for m in decide.MODES])


@query
def invokes_replayable(spark, sf):
    names = ["track_click", "APP.do_work", "run_me"]
    return _statements(spark, sf).select("pos", S.invokes_any(F.col("sql"), names).alias("invokes"))


@query
def matches_any(spark, sf):
    return _statements(spark, sf).select(
        "pos", S.matches_any(F.col("sql"), [r"(?i)drop\s+table", r"\d{16}"]).alias("matches"))


@query
def transaction_control(spark, sf):
    sql = F.col("sql")
    return _statements(spark, sf).select(
        "pos", S.is_transaction_control(sql).alias("is_tx_control"),
        S.is_session_command(sql).alias("is_session"), S.is_read_statement(sql).alias("is_read"))


@query
def session_command(spark, sf):
    return _statements(spark, sf).where(S.is_session_command(F.col("sql"))).select("pos", "sql")


@query
def read_statement(spark, sf):
    return _statements(spark, sf).where(S.is_read_statement(F.col("sql"))).select("pos", "sql")


@query
def strip_literals(spark, sf):
    return _statements(spark, sf).select("pos", S.strip_literals(F.col("sql")).alias("stripped"))


@query
def document_strip_literals(spark, sf):
    return table(spark, sf, "document_sql").select(
        "pos", S.strip_literals(F.col("sql")).alias("stripped"))


@query
def replace_outside_literals(spark, sf):
    replaced = S.replace_outside_literals(F.col("sql"), r"(?i)\bnow\s*\(\s*\)", "NOW_VALUE")
    return table(spark, sf, "document_sql").select("pos", replaced.alias("replaced"))


# --- safeguards --------------------------------------------------------------------------------

def _guarded(spark, sf, opts, source="sql_events"):
    return guard.apply_guard(table(spark, sf, source), opts)


@query
def mask_sql(spark, sf):
    return guard.mask_sql(table(spark, sf, "document_sql"), MASKS).select("pos", "sql", "masked")


@query
def sample_percent(spark, sf):
    return guard.sample_percent(table(spark, sf, "sql_events"), 35).select("pos", "sampled")


@query
def sample_percent_stable(spark, sf):
    rows = guard.sample_percent(table(spark, sf, "sql_events"), 35, stable=True)
    return rows.where("sampled").select("pos", "conn_key")


@query
def include_users(spark, sf):
    return _guarded(spark, sf, GuardOptions(include_users=("USER1", "user5"))).select(
        "pos", "db_user", "guard", "guard_rule")


@query
def read_only(spark, sf):
    return _guarded(spark, sf, GuardOptions(read_only=True)).select("pos", "guard")


@query
def exclude_ddl(spark, sf):
    return _guarded(spark, sf, GuardOptions(exclude_ddl=True)).select("pos", "guard")


@query
def skip_external(spark, sf):
    return _guarded(spark, sf, GuardOptions(skip_external_deps=True)).select("pos", "guard")


@query
def include_exclude_tables(spark, sf):
    return _guarded(spark, sf, TABLE_RULES).select("pos", "guard", "guard_rule")


@query
def rewrite_time_functions(spark, sf):
    return _guarded(spark, sf, GuardOptions(rewrite_time_functions=True)).select(
        "pos", "guard", "sql_out")


@query
def apply_guard(spark, sf):
    return _guarded(spark, sf, ALL_RULES).select("pos", "guard", "guard_rule", "sql_out")


@query
def guard_stats(spark, sf):
    return guard.guard_stats(_guarded(spark, sf, ALL_RULES))


@query
def tx_limits(spark, sf):
    rows = table(spark, sf, "sql_events").select("pos", "ts", (F.col("pos") % 40).alias("tx_id"))
    return guard.tx_limits(rows, 500_000, 12).select("pos", "tx_id", "tx_statements", "tx_guard")


@query
def backpressure_state(spark, sf):
    return guard.backpressure_state(table(spark, sf, "gauges"), 10_000, 90).select(
        "pos", "paused", "edge")


@query
def backpressure_intervals(spark, sf):
    states = guard.backpressure_state(table(spark, sf, "gauges"), 15_000)
    return guard.backpressure_intervals(states).select(
        ntz("paused").alias("paused"), ntz("resumed").alias("resumed"))


# --- replay plan ---------------------------------------------------------------------------------

@query
def lane_order(spark, sf):
    rows = replay.assign_lane(table(spark, sf, "sql_events"), "faithful")
    return replay.laid_out(replay.lane_order(rows)).select("lane", "pos", "lane_seq")


@query
def lane_order_serial(spark, sf):
    rows = replay.assign_lane(table(spark, sf, "sql_events"), "serial")
    return replay.lane_order(rows, hot_rows=1000, width=4096).select("lane", "pos", "lane_seq")


@query
def assign_lane(spark, sf):
    rows = replay.assign_lane(table(spark, sf, "sql_events"))
    return rows.groupBy("lane").agg(F.count(F.lit(1)).alias("n"))


@query
def pace(spark, sf):
    return replay.pace(table(spark, sf, "sql_events"), 100.0).select("pos", "delay_ns", "due_ns")


@query
def rate_limit(spark, sf):
    paced = scan.cut(replay.pace(table(spark, sf, "sql_events").select("pos", "ts"), 500.0))
    return replay.rate_limit(paced, 0.5).select("pos", F.floor("slot_ns").alias("slot_ns"))


@query
def apply_dialect(spark, sf):
    return replay.apply_dialect(table(spark, sf, "sql_events"), " Greenplum ").select("pos", "send")


@query
def resolve_error_policy(spark, sf):
    attempts = table(spark, sf, "attempts")
    return metrics.union_all([
        replay.resolve_error_policy(attempts, p).groupBy("outcome", "rollback")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("used").alias("used"),
             F.max("pos").alias("last_pos")).withColumn("policy", F.lit(p))
        for p in replay.POLICIES])


@query
def replayed_statements(spark, sf):
    outcomes = replay.resolve_error_policy(table(spark, sf, "attempts"), "skip")
    return replay.with_rollbacks(outcomes).groupBy("sent").agg(F.count(F.lit(1)).alias("n"))


@query
def plan_replay(spark, sf):
    opts = pipeline.ReplayOptions(guard=ALL_RULES, speed_factor=1000.0, dialect="greenplum")
    return pipeline.plan_replay(table(spark, sf, "sql_events"), opts).select(
        "pos", "lane", "lane_seq", "delay_ns", "due_ns", "send", "sql_out")


@query
def bounded_backlog(spark, sf):
    rows = table(spark, sf, "sql_events").select("pos")
    return metrics.union_all([
        replay.bounded_backlog(rows, 321, p).withColumn("policy", F.lit(p))
        for p in replay.OVERFLOW])


@query
def overflow_total(spark, sf):
    rows = table(spark, sf, "sql_events").select("pos")
    return metrics.union_all([
        replay.overflow_total(rows, 321, p).withColumn("policy", F.lit(p))
        for p in replay.OVERFLOW])


@query
def queue_depth(spark, sf):
    return replay.queue_depth(table(spark, sf, "flow")).select("pos", "depth")


@query
def replay_lag(spark, sf):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return replay.replay_lag(table(spark, sf, "sql_events"), now).select("pos", "lag_s")


@query
def active_only(spark, sf):
    return replay.active_only(
        table(spark, sf, "sql_events"), table(spark, sf, "signals"), width=3_600_000_000,
    ).select("pos", "conn_key")


@query
def control_edges(spark, sf):
    return replay.control_edges(table(spark, sf, "signals")).withColumn("ts", ntz("ts"))


@query
def detect_failover(spark, sf):
    return replay.detect_failover(table(spark, sf, "resolutions")).withColumn("ts", ntz("ts"))


# --- metrics -----------------------------------------------------------------------------------

@query
def classified_counts(spark, sf):
    return decide.classified_counts(decide.decisions(table(spark, sf, "sql_events")))


@query
def error_rate(spark, sf):
    rows = table(spark, sf, "attempts")
    return metrics.error_rate(rows)


@query
def exec_histogram(spark, sf):
    return metrics.exec_histogram(metrics.exec_times(table(spark, sf, "line_results")))


@query
def p99_nearest_rank(spark, sf):
    return metrics.p99_nearest_rank(metrics.exec_times(table(spark, sf, "order_results")))


@query
def p99_recent(spark, sf):
    return metrics.p99_nearest_rank(metrics.exec_times(table(spark, sf, "order_results")), window=5000)


@query
def p99_approx(spark, sf):
    return metrics.p99_approx(metrics.exec_times(table(spark, sf, "line_results")))


@query
def alerts(spark, sf):
    rows = table(spark, sf, "gauges").withColumns({
        "depth": F.col("depth") * 10, "error_rate": (F.col("pos") % 3) / 100.0,
        "source_p99": (F.col("pos") % 2).cast("double"), "target_p99": F.col("pos") % 4,
        "drop_rate": (F.col("pos") % 5) / 1000.0})
    return metrics.alerts(rows).select(
        "pos", "alert_lag", "alert_depth", "alert_error_rate", "alert_p99", "alert_drop_rate")


@query
def throughput(spark, sf):
    rows = table(spark, sf, "sql_events").withColumn(
        "side", F.when(F.col("db_user") == "User1", "target").otherwise("source"))
    return metrics.throughput(rows, "1 hour").withColumn("ts", ntz("ts"))


@query
def compare_results(spark, sf):
    return metrics.compare_results(table(spark, sf, "line_results"), 3.0).select(
        "conn_key", "event_seq", "attempt", "diff_type", "message")


@query
def match_results(spark, sf):
    rows = table(spark, sf, "order_results")
    source = rows.where(F.col("source_exec_ms") >= 5).select(
        "conn_key", "event_seq", "sql", "ts", F.col("source_exec_ms").alias("exec_ms"),
        F.col("source_error").alias("error"))
    target = rows.where(F.col("target_exec_ms") <= 1500).select(
        "conn_key", "event_seq", F.col("target_exec_ms").alias("exec_ms"),
        F.col("target_error").alias("error"))
    matched = metrics.compare_results(metrics.match_results(source, target))
    return matched.select("conn_key", "event_seq", "presence", "diff_type")


@query
def diff_summary(spark, sf):
    return metrics.diff_summary(
        metrics.compare_results(table(spark, sf, "order_results")))


@query
def diff_summary_first(spark, sf):
    return metrics.diff_summary(
        metrics.compare_results(table(spark, sf, "order_results")), max_diffs=5000)


@query
def diff_totals(spark, sf):
    compared = metrics.compare_results(table(spark, sf, "line_results"), 3.0, extended=True)
    return metrics.diff_summary(compared, None)


def _bounds():
    return (F.lit("2024-01-01 00:00:00").cast("timestamp"),
            F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query
def progress(spark, sf):
    started, now = _bounds()
    rows = metrics.progress(table(spark, sf, "progress_log"), started, now, 1500, 1400)
    return rows.withColumns({"last_produce": ntz("last_produce"), "last_replay": ntz("last_replay")})


@query
def is_stale(spark, sf):
    return metrics.is_stale(table(spark, sf, "progress_log"), *_bounds(), 90_000)


# --- streams -------------------------------------------------------------------------------------

@query
def stream_classify_guard(spark, sf):
    opts = GuardOptions(exclude_ddl=True, rewrite_time_functions=True)
    rows = flow.stream_classify_guard(stream(spark, sf, "sql_events"), FilterOptions(), opts)
    return run_stream(rows, "classify").select(
        "pos", "stmt_class", "action", "guard", "guard_rule", "sql_out")


@query
def stream_sessionize_events(spark, sf):
    rows = stream(spark, sf, "messages").withColumn("chunk", F.col("chunk").cast("binary"))
    out = run_stateful(stream_sessionize(rows), "sessionize")
    return out.where("kind = 'event'").select(
        "conn_key", "pos", "sql", "stmt_class", "seq", "tx_pos", "tx_state")


@query
def stream_connections(spark, sf):
    out = run_stateful(closed_lives(stream(spark, sf, "segments"), 20_000), "connections")
    return out.withColumns({"started": ntz("started"), "ended": ntz("ended")})


@query
def stream_metrics(spark, sf):
    rows = flow.stream_classify_guard(stream(spark, sf, "sql_events"))
    out = run_stream(flow.stream_metrics(rows, "1 hour"), "metrics")
    return out.withColumns({"from_ts": ntz("from_ts"), "to_ts": ntz("to_ts")}).drop("errors")


@query
def stream_sessions(spark, sf):
    out = run_stream(flow.stream_sessions(stream(spark, sf, "sql_events"), "6 hours"), "sessions")
    return out.withColumns({"started": ntz("started"), "ended": ntz("ended")})


@query
def stream_outcomes(spark, sf):
    def side(name):
        rows = stream(spark, sf, "order_results")
        return rows.select("conn_key", "event_seq", "ts", F.col(f"{name}_exec_ms").alias("exec_ms"),
                           F.col(f"{name}_error").alias("error"))

    late = F.make_dt_interval(mins=(F.col("event_seq") % 90).cast("int"))
    target = side("target").where("exec_ms <= 1500").withColumn("ts", F.col("ts") + late)
    matched = outcomes.matched_outcomes(side("source"), target, "1 hour")
    out = run_stream(outcomes.rolling_outcomes(matched, "14 days", "7 days"), "outcomes")
    return out.withColumns({"from_ts": ntz("from_ts"), "to_ts": ntz("to_ts")})


@query
def deliver_plan(spark, sf):
    path = scratch(spark, "delivered")
    flow.deliver_plan(stream(spark, sf, "sql_events"), f"{path}/out", f"{path}/checkpoint",
                      dialect="greenplum").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("lane", "pos", "send")
