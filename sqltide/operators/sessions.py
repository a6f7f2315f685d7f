"""Messages to statement events: the state a connection builds up, as running values.

Each rule of the form "state since the last boundary" is written as a comparison of two
running positions, for instance *a COPY is open if its start lies behind the last
terminator*. All of them share the partitioning by connection, so one shuffle serves
every window (two for rows of prepared statements). Connections above ``hot_rows``
messages are split, see ``scan``.

``messages`` rows follow ``schemas.MESSAGES``; ``life`` numbers the lives of a reused
address pair and may be missing (one life). Pipeline order of the result is ``pos``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltide.functions.params import zip_params
from sqltide.functions.sqltext import classify_sql, is_pooler_reset
from sqltide.operators import scan

CONN = ["conn_key", "life"]


@dataclass(frozen=True)
class SessionOptions:
    #: Largest text and bulk load in bytes that become events; 0 is no limit.
    max_sql_length: int = 0
    extended_query: bool = True
    connection_pooler: bool = False
    max_copy_bytes: int = 0
    builtins: tuple[str, ...] = ()
    autocommit_groups: bool = False
    hot_rows: int = scan.HOT_ROWS
    range_width: int = scan.RANGE_WIDTHS[0]


_DEFAULTS = {
    "life": "bigint", "stmt_name": "string", "param_oids": "array<bigint>",
    "param_formats": "array<smallint>", "param_values": "array<binary>",
    "chunk": "binary", "tx_status": "string", "database": "string", "db_user": "string",
}


def _complete(messages: DataFrame) -> DataFrame:
    """Add the optional message columns that a table does not have."""
    missing = {
        name: (F.lit(0) if name == "life" else F.lit(None)).cast(kind)
        for name, kind in _DEFAULTS.items() if name not in messages.columns}
    return messages.withColumns(missing) if missing else messages


def _behind(position: Column, boundary: Column) -> Column:
    """Position exists and lies after the boundary (no boundary counts as the start)."""
    return position.isNotNull() & (position > F.coalesce(boundary, F.lit(-1)))


def _is_reset(sql: Column, stmt_class: Column) -> Column:
    return stmt_class.isin("utility", "unknown") & is_pooler_reset(sql)


def _kind(*types: str) -> Column:
    return F.col("msg_type").isin(*types)


def text_rows(messages: DataFrame, opts: SessionOptions,
              keep_chunk: bool = False) -> DataFrame:
    """Rows with the facts a message shows by itself; narrow unless chunks are kept."""
    carries_sql = _kind("Q", "P") if opts.extended_query else _kind("Q")
    length = F.octet_length("sql")
    fits = F.coalesce(length <= opts.max_sql_length, F.lit(True)) \
        if opts.max_sql_length > 0 else F.lit(True)
    rows = _complete(messages).select(
        *CONN, "pos", "ts", "from_client", "msg_type", "tx_status", "database", "db_user",
        F.coalesce("stmt_name", F.lit("")).alias("stmt_name"),
        "param_oids", "param_formats", "param_values",
        F.octet_length("chunk").cast("long").alias("chunk_bytes"),
        F.when(carries_sql & fits, F.col("sql")).alias("sql"),
        (carries_sql & ~fits).alias("oversized"), *(["chunk"] if keep_chunk else []))
    rows = rows.withColumn(
        "text_class", F.when(F.col("sql").isNotNull(), classify_sql(F.col("sql"), opts.builtins)))
    pooled = F.lit(opts.connection_pooler)
    return rows.withColumns({
        "copy_start": F.coalesce(
            _kind("Q") & (F.col("text_class") == "copy_from"), F.lit(False)),
        "text_reset": F.coalesce(
            pooled & _is_reset(F.col("sql"), F.col("text_class")), F.lit(False)),
    })


def _with_definitions(rows: DataFrame, opts: SessionOptions, split: bool) -> DataFrame:
    """As-of join of each Bind with the latest earlier Parse of the same name."""
    definition = F.when(
        _kind("P") & F.col("sql").isNotNull(),
        F.struct("pos", "sql", F.col("param_oids").alias("oids"), "text_class", "text_reset"))
    prepared = scan.running(
        rows.where(_kind("P", "B")), [*CONN, "stmt_name"], "pos",
        {"def": scan.latest(definition)}, split, opts.range_width)
    prepared = prepared.withColumn("def", F.when(_kind("B"), F.col("def")))
    others = rows.where(~_kind("P", "B"))
    return others.withColumn("def", F.lit(None).cast(prepared.schema["def"].dataType)) \
        .unionByName(prepared)


def annotate(messages: DataFrame, opts: SessionOptions = SessionOptions()) -> DataFrame:
    """All messages with the connection state that holds at each of them."""
    messages = _complete(messages)
    hot = scan.find_hot(messages, CONN, opts.hot_rows)
    several = opts.connection_pooler and not text_rows(messages, opts).where(
        _kind("P") & F.col("text_reset")).groupBy(*CONN).count().where("count > 1").isEmpty()
    return scan.by_heat(
        messages, CONN, hot, lambda part, split: _annotate(part, opts, split, several))


def _real_resets(binds: DataFrame, opts: SessionOptions) -> DataFrame:
    """Binds of prepared resets that find their statement not yet forgotten.

    The first bind counts; behind a counting bind, the next that counts is the first whose Parse
    lies behind it. That successor is a running minimum from the end, over Parses and binds
    in one order. Those reached from the first are found by doubling: in each round all reached
    so far jump, and jumps double, so rounds grow with the logarithm of the longest chain. Only
    the few bind rows of reset statements take part.
    """
    binds = scan.cut(binds)
    points = binds.groupBy(*CONN, "parsed").agg((-F.min("pos")).alias("first")).select(
        *CONN, (-F.col("parsed")).alias("__back"), "first").unionByName(binds.select(
            *CONN, (-F.col("pos")).alias("__back"), F.lit(None).cast("long").alias("first")))
    jumps = scan.cut(scan.running_by(points, CONN, "__back", {"next": scan.highest(F.col("first"))},
                                     opts.hot_rows, opts.range_width)
                     .where("first is null and next is not null")
                     .select(*CONN, (-F.col("__back")).alias("pos"), (-F.col("next")).alias("to")))
    reached = scan.cut(binds.groupBy(*CONN).agg(F.min("pos").alias("pos")))
    n = reached.count()
    while True:
        more = reached.join(jumps, [*CONN, "pos"]).select(*CONN, F.col("to").alias("pos"))
        reached = scan.cut(reached.unionByName(more).distinct())
        had, n = n, reached.count()
        if n == had:
            return binds.join(reached, [*CONN, "pos"], "left_semi").drop("parsed")
        further = jumps.select(*CONN, F.col("pos").alias("to"), F.col("to").alias("__to"))
        jumps = scan.cut(jumps.join(further, [*CONN, "to"]).select(
            *CONN, "pos", F.col("__to").alias("to")))


def _annotate(messages: DataFrame, opts: SessionOptions, split: bool,
              several_resets: bool) -> DataFrame:
    rows = _with_definitions(text_rows(messages, opts), opts, split)

    def run(df: DataFrame, specs) -> DataFrame:
        return scan.running(df, CONN, "pos", specs, split, opts.range_width)

    def at(condition: Column) -> Column:
        return F.when(condition, F.col("pos"))

    simple_reset = _kind("Q") & F.col("text_reset")
    rows = run(rows, {
        "simple_reset_pos": scan.highest(at(simple_reset)),
        "copy_end_pos": scan.highest(at(_kind("c", "f"))),
        "copied": scan.total(F.when(_kind("d"), F.col("chunk_bytes"))),
    })
    found = _kind("B") & _behind(F.col("def.pos"), F.col("simple_reset_pos"))
    rows = rows.withColumn("bind_reset", F.coalesce(
        found & F.col("def.text_reset"), F.lit(False)))
    copy = F.when(F.col("copy_start"), F.struct(
        "pos", "sql", "database", "db_user", F.coalesce("copied", F.lit(0)).alias("copied")))
    rows = run(rows, {
        "copy": scan.latest(copy),
        "bind_reset_pos": scan.highest(at(F.col("bind_reset"))),
    })
    if opts.connection_pooler:
        if several_resets:
            rows = scan.cut(rows)
            real = _real_resets(rows.where("bind_reset").select(
                *CONN, "pos", F.col("def.pos").alias("parsed")), opts)
            rows = rows.drop("bind_reset").join(
                real.select(*CONN, "pos", F.lit(True).alias("bind_reset")), [*CONN, "pos"], "left")
            prepared = F.col("bind_reset")
        else:
            # One prepared reset: only its first bind counts, which forgets the statement.
            prepared = F.col("bind_reset") & _behind(F.col("def.pos"), F.col("bind_reset_pos"))
        rows = run(rows.withColumn("resets", simple_reset | F.coalesce(prepared, F.lit(False))),
                   {"reset_pos": scan.highest(at(F.col("resets")))})
    else:
        rows = rows.withColumns({
            "resets": F.lit(False), "reset_pos": F.lit(None).cast("long")})

    copy_open = _behind(F.col("copy.pos"), F.greatest("copy_end_pos", "reset_pos"))
    copy_bytes = F.coalesce("copied", F.lit(0)) - F.col("copy.copied")
    rows = rows.withColumns({
        "bound": _kind("B") & _behind(F.col("def.pos"), F.col("reset_pos")),
        "copy_id": F.when(copy_open & _kind("c", "d"), F.col("copy.pos")),
        "copy_bytes": F.when(copy_open & _kind("c"), copy_bytes),
    })
    too_large = F.col("copy_bytes") > opts.max_copy_bytes if opts.max_copy_bytes > 0 else F.lit(False)
    rows = rows.withColumn("dropped_load", F.coalesce(too_large, F.lit(False)))
    rows = rows.withColumns({
        "is_event": F.coalesce(
            (_kind("Q") & F.col("sql").isNotNull() & ~F.col("copy_start"))
            | F.col("bound") | (F.col("copy_bytes").isNotNull() & ~F.col("dropped_load")),
            F.lit(False)),
        "stmt_class": F.when(_kind("Q"), F.col("text_class"))
            .when(_kind("B"), F.col("def.text_class"))
            .when(_kind("c"), F.lit("copy_from")),
        "completes": _kind("C", "Z") & ~F.col("from_client"),
    })

    event, cls = F.col("is_event"), F.col("stmt_class")
    begins = event & (cls == "begin")
    writes = event & cls.isin("dml", "ddl", "copy_from")
    closes = event & ((cls == "commit_rollback") | F.col("resets"))
    signal = F.when(
        _kind("Z"), F.when(F.col("tx_status") == "I", "idle")
        .when(F.col("tx_status") == "T", "in_tx").when(F.col("tx_status") == "E", "failed"),
    ).when(begins, "in_tx").when(event & (cls == "commit_rollback"), "idle")
    starts = (event & _kind("Q", "B")) | F.col("copy_start")
    rows = run(rows, {
        "seq": scan.count_if(event, inclusive=True),
        "begin_pos": scan.highest(at(begins)),
        "write_pos": scan.highest(at(writes)),
        "close_pos": scan.highest(at(closes)),
        "state": scan.latest(signal),
        "start": scan.latest(F.when(starts, F.struct("pos", "ts"))),
        "complete_pos": scan.highest(at(F.col("completes"))),
    })
    rows = rows.withColumn("tx_state", F.coalesce("state", F.lit("idle")))

    begun = _behind(F.col("begin_pos"), F.col("close_pos"))
    if opts.autocommit_groups:
        opens = begins | (writes & ~begun)
        group = F.when(opens, F.col("pos")).when(event & begun, F.col("begin_pos"))
        return rows.withColumns({
            "opens_tx": F.coalesce(opens, F.lit(False)),
            "tx_pos": F.coalesce(group, F.lit(-1))})
    open_before = _behind(F.greatest("begin_pos", "write_pos"), F.col("close_pos"))
    rows = rows.withColumn(
        "opens_tx", F.coalesce(begins | (writes & ~open_before), F.lit(False)))
    rows = run(rows, {"open_pos": scan.highest(at(F.col("opens_tx")), inclusive=True)})
    in_group = event & _behind(F.col("open_pos"), F.col("close_pos"))
    return rows.withColumn("tx_pos", F.when(in_group, F.col("open_pos")).otherwise(F.lit(-1)))


# --- single operators ------------------------------------------------------------------------

def extract_statements(messages: DataFrame, max_sql_length: int = 0) -> DataFrame:
    """Events of simple queries; texts above a limit (bytes), if there is one, are left out."""
    fits = F.octet_length("sql") <= max_sql_length if max_sql_length > 0 else F.lit(True)
    return _complete(messages).where(_kind("Q") & fits).select(
        *CONN, "pos", "ts", "sql", "database", "db_user")


def statement_definitions(messages: DataFrame,
                          opts: SessionOptions = SessionOptions()) -> DataFrame:
    """Prepared statements with the positions between which each holds."""
    rows = text_rows(messages, opts).withColumn("__back", -F.col("pos"))
    if opts.connection_pooler:
        resets = _kind("Q") & F.col("text_reset")
        rows = scan.running_by(
            rows, CONN, "__back", {"next_reset": scan.latest(F.when(resets, F.col("pos")))},
            opts.hot_rows, opts.range_width)
    else:
        rows = rows.withColumn("next_reset", F.lit(None).cast("long"))
    defined = rows.where(_kind("P") & F.col("sql").isNotNull())
    defined = scan.running_by(
        defined, [*CONN, "stmt_name"], "__back",
        {"next_def": scan.latest(F.col("pos"))}, opts.hot_rows, opts.range_width)
    return defined.select(
        *CONN, "stmt_name", "sql", F.col("param_oids").alias("oids"),
        F.col("pos").alias("valid_from"),
        F.least("next_def", "next_reset").alias("valid_to"))


def correlate_binds(messages: DataFrame,
                    opts: SessionOptions = SessionOptions()) -> DataFrame:
    """Bind messages with SQL and parameters of their statement; ``orphan`` if none."""
    bound = F.col("bound")
    return annotate(messages, opts).where(_kind("B")).select(
        *CONN, "pos", "ts", "stmt_name",
        F.when(bound, F.col("def.sql")).alias("sql"),
        F.when(bound, zip_params(F.col("def.oids"), F.col("param_formats"),
                                 F.col("param_values"))).alias("params"),
        (~bound).alias("orphan"))


def assemble_copy(messages: DataFrame, opts: SessionOptions = SessionOptions()) -> DataFrame:
    """Finished bulk loads with their chunks in order; loads above a cap, if there is one, are
    left out and counted by ``parse_error_counts``."""
    in_load = _kind("c", "d") & F.col("copy_id").isNotNull()
    rows = scan.cut(annotate(messages, opts).where(in_load).select(
        *CONN, "pos", "ts", "msg_type", "copy_id", "is_event", "copy_bytes",
        F.col("copy.sql").alias("sql")))
    done = rows.where("is_event").select(*CONN, "copy_id", "pos", "ts", "sql", "copy_bytes")
    data = _load_data(rows, messages)
    return done.join(data, [*CONN, "copy_id"], "left").drop("copy_id") \
        .withColumn("copy_data", F.coalesce("copy_data", F.array().cast("array<binary>")))


def _load_data(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Chunks per finished load, fetched for kept loads only; a load is one row of the result."""
    kept = rows.where(_kind("c") & F.col("is_event")).select(*CONN, "copy_id")
    chunks = _complete(messages).where(_kind("d")).select(*CONN, "pos", "chunk")
    return (rows.where(_kind("d")).select(*CONN, "copy_id", "pos")
            .join(kept, [*CONN, "copy_id"], "left_semi")
            .join(chunks, [*CONN, "pos"])
            .groupBy(*CONN, "copy_id")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "chunk"))).alias("parts"))
            .select(*CONN, "copy_id",
                    F.transform("parts", lambda p: p["chunk"]).alias("copy_data")))


def assign_seq(messages: DataFrame, opts: SessionOptions = SessionOptions()) -> DataFrame:
    """Event numbers per connection, given out before any keep/drop decision."""
    return annotate(messages, opts).where("is_event").select(
        *CONN, "pos", "seq", "stmt_class")


def pooler_sessions(messages: DataFrame,
                    opts: SessionOptions = SessionOptions(connection_pooler=True)) -> DataFrame:
    """Every message with the number of its pooler session on the connection."""
    rows = annotate(messages, opts).select(*CONN, "pos", "msg_type", "resets")
    # All messages are still there, so their connections are counted without annotating them.
    hot = scan.find_hot(_complete(messages), CONN, opts.hot_rows)
    specs = {"sess": scan.count_if(F.col("resets"))}
    return scan.by_heat(rows, CONN, hot, lambda part, split: scan.running(
        part, CONN, "pos", specs, split, opts.range_width).select(*rows.columns, *specs),
    ).withColumn("sess", F.coalesce("sess", F.lit(0)))


def source_exec_time(messages: DataFrame,
                     opts: SessionOptions = SessionOptions()) -> DataFrame:
    """Time from the latest request to its first completion, per completion.

    ``seq`` is the latest event on the connection, to which the time belongs.
    """
    rows = annotate(messages, opts).where(
        F.col("completes") & _behind(F.col("start.pos"), F.col("complete_pos")))
    took = (F.unix_micros("ts") - F.unix_micros("start.ts")) * 1000
    return rows.select(*CONN, "pos", "seq", took.alias("exec_ns")).where("exec_ns > 0")


def parse_error_counts(messages: DataFrame,
                       opts: SessionOptions = SessionOptions()) -> DataFrame:
    """Oversized texts, binds without a statement, and bulk loads above the cap."""
    rows = annotate(messages, opts)
    orphan = _kind("B") & ~F.col("bound")
    return rows.agg(
        F.count_if("oversized").alias("oversized"), F.count_if(orphan).alias("orphan_binds"),
        F.count_if(F.col("oversized") | orphan).alias("parse_errors"),
        F.count_if("dropped_load").alias("dropped_loads"))


def number_transactions(rows: DataFrame, widths=scan.RANGE_WIDTHS) -> DataFrame:
    """Replace group positions by ids 1, 2, .. in order of allocation; 0 is no group.

    ``rows`` needs ``tx_pos`` and ``opens_tx`` and is read more than once. A group can be
    very large, so events don't meet its id by the group: each range of positions first gets
    a directory of the groups that its events name, one row for each, and events meet that by
    range and group. A key then has no more events than a range has positions.
    """
    opened = scan.running_all(
        rows.where("opens_tx").select(F.col("pos").alias("tx_pos")), "tx_pos",
        {"tx_id": scan.count_if(F.lit(True), inclusive=True)}, widths)
    ranged = rows.withColumn("__range", F.expr(f"pos DIV {widths[0]}"))
    directory = ranged.where("tx_pos >= 0").select("__range", "tx_pos").distinct() \
        .join(opened.select("tx_pos", "tx_id"), "tx_pos")
    return ranged.join(directory, ["__range", "tx_pos"], "left") \
        .withColumn("tx_id", F.coalesce("tx_id", F.lit(0))).select(*rows.columns, "tx_id")


def assign_tx_id(messages: DataFrame, opts: SessionOptions = SessionOptions()) -> DataFrame:
    """Transaction group of each event."""
    rows = annotate(messages, opts).where("is_event").select(
        *CONN, "pos", "seq", "stmt_class", "tx_pos", "opens_tx")
    return number_transactions(scan.cut(rows)).select(
        *CONN, "pos", "seq", "stmt_class", "tx_id")


def sql_events(messages: DataFrame, opts: SessionOptions = SessionOptions(),
               with_copy_data: bool = True) -> DataFrame:
    """Messages to complete statement events, with the state before each of them.

    Narrow rows are written once; chunks are joined to finished loads only, and the
    numbering of transactions is the only further shuffle of all events.
    """
    took = (F.unix_micros("ts") - F.unix_micros("start.ts")) * 1000
    timed = F.when(F.col("completes") & _behind(F.col("start.pos"), F.col("complete_pos"))
                   & (took > 0), took)
    rows = annotate(messages, opts).withColumns({
        "exec_ns": timed,
        "in_load": _kind("d") & F.col("copy_id").isNotNull(),
    }).where(F.col("is_event") | F.col("in_load") | F.col("exec_ns").isNotNull())
    # An event and the completions timed for it share (connection, seq), so this window
    # needs no shuffle of its own and its groups stay small.
    per_event = Window.partitionBy(*CONN, F.when(F.col("in_load"), -1 - F.col("pos"))
                                   .otherwise(F.col("seq")))
    rows = rows.withColumn("source_exec_ns", F.max_by(
        "exec_ns", F.when(F.col("exec_ns").isNotNull(), F.col("pos"))).over(per_event))
    bind = _kind("B")
    rows = scan.cut(rows.where(F.col("is_event") | F.col("in_load")).select(
        *CONN, "pos", "ts", "msg_type", "is_event", "copy_id",
        F.when(_kind("Q"), F.col("sql")).when(bind, F.col("def.sql"))
         .when(_kind("c"), F.col("copy.sql")).alias("sql"),
        "seq", bind.alias("extended"), F.when(bind, F.col("stmt_name")).alias("stmt_name"),
        F.when(bind, zip_params(F.col("def.oids"), F.col("param_formats"),
                                F.col("param_values"))).alias("params"),
        "source_exec_ns",
        F.coalesce("database", "copy.database").alias("database"),
        F.coalesce("db_user", "copy.db_user").alias("db_user"),
        "stmt_class", "tx_state", "tx_pos", "opens_tx"))
    events = rows.where("is_event").withColumn("copy_data", F.lit(None).cast("array<binary>"))
    if with_copy_data:
        loads = events.where(_kind("c")).drop("copy_data") \
            .join(_load_data(rows, messages), [*CONN, "copy_id"], "left") \
            .withColumn("copy_data", F.coalesce("copy_data", F.array().cast("array<binary>")))
        events = events.where(~_kind("c")).unionByName(loads)
    return number_transactions(events).select(
        *CONN, "pos", "ts", "sql", "tx_id", "seq", "extended", "stmt_name", "params",
        "copy_data", "source_exec_ns", "database", "db_user", "stmt_class", "tx_state")
