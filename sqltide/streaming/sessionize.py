"""Messages to events on a stream: one small state per connection.

The JVM classifies texts before the shuffle; the Python code below only moves state. A
micro-batch holds a connection's rows in any order, so they are sorted by ``pos`` first.
State lives in the state store and is freed after ``idle_seconds`` of event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sqltide.operators.sessions import SessionOptions, text_rows

EVENTS = T.StructType([
    T.StructField("conn_key", T.StringType()),
    T.StructField("life", T.LongType()),
    T.StructField("pos", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("kind", T.StringType()),          # event, exec or error
    T.StructField("sql", T.StringType()),
    T.StructField("stmt_class", T.StringType()),
    T.StructField("tx_state", T.StringType()),
    T.StructField("tx_pos", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("extended", T.BooleanType()),
    T.StructField("stmt_name", T.StringType()),
    T.StructField("param_oids", T.ArrayType(T.LongType())),
    T.StructField("param_formats", T.ArrayType(T.ShortType())),
    T.StructField("param_values", T.ArrayType(T.BinaryType())),
    T.StructField("copy_data", T.ArrayType(T.BinaryType())),
    T.StructField("exec_ns", T.LongType()),
    T.StructField("database", T.StringType()),
    T.StructField("db_user", T.StringType()),
])

_CORE = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("tx_pos", T.LongType()),
    T.StructField("tx_state", T.StringType()),
    T.StructField("pending_us", T.LongType()),
    T.StructField("copy_sql", T.StringType()),
    T.StructField("copy_bytes", T.LongType()),
])
_NAME = T.StructType([T.StructField("name", T.StringType())])
_DEFINITION = T.StructType([
    T.StructField("sql", T.StringType()),
    T.StructField("oids", T.ArrayType(T.LongType())),
    T.StructField("stmt_class", T.StringType()),
    T.StructField("resets", T.BooleanType()),
])
_CHUNK = T.StructType([T.StructField("chunk", T.BinaryType())])

_STATES = {"I": "idle", "T": "in_tx", "E": "failed"}
_WRITES = ("dml", "ddl", "copy_from")


def _none(value):
    return None if value is None or value is pd.NaT or value != value else value


class ConnectionState(StatefulProcessor):
    """Sequence numbers, transaction group and state, statements, bulk loads, timing."""

    def __init__(self, max_copy_bytes: int, idle_seconds: int):
        self.max_copy_bytes = max_copy_bytes or float("inf")
        self.idle_ms = idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.core = handle.getValueState("core", _CORE)
        self.statements = handle.getMapState("statements", _NAME, _DEFINITION)
        self.chunks = handle.getListState("chunks", _CHUNK)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        saved = self.core.get() if self.core.exists() else (0, -1, "idle", None, None, 0)
        self.seq, self.tx_pos, self.tx_state, self.pending, self.copy_sql, self.copied = saved
        self.fresh = []
        batch = pd.concat(list(rows), ignore_index=True).sort_values("pos", ignore_index=True)
        out = []
        for m in batch.itertuples(index=False):
            out.extend(self._on_message(m))
        if self.fresh:
            self.chunks.appendList(self.fresh)
        self.core.update((self.seq, self.tx_pos, self.tx_state, self.pending, self.copy_sql,
                          self.copied))
        self._keep_alive(batch["ts"].max())
        yield pd.DataFrame(
            [(*key, *r) for r in out], columns=EVENTS.fieldNames()).astype(object) \
            if out else pd.DataFrame(columns=EVENTS.fieldNames())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.core.clear()
        self.statements.clear()
        self.chunks.clear()
        yield pd.DataFrame(columns=EVENTS.fieldNames())

    def close(self) -> None:
        pass

    def _keep_alive(self, last) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(last.timestamp() * 1000) + self.idle_ms)

    def _on_message(self, m):
        kind = m.msg_type
        if kind in ("Q", "P") and bool(m.oversized):
            return [self._row(m, "error")]
        if kind == "P" and _none(m.sql) is not None:
            oids = _none_list(m.param_oids)
            self.statements.updateValue(
                (m.stmt_name,), (m.sql, oids, m.text_class, bool(m.text_reset)))
        elif kind == "B":
            if not self.statements.containsKey((m.stmt_name,)):
                return [self._row(m, "error")]
            sql, oids, cls, resets = self.statements.getValue((m.stmt_name,))
            row = self._event(m, sql, cls, bool(resets), oids=oids)
            self.pending = _micros(m.ts)
            return [row]
        elif kind == "Q" and _none(m.sql) is not None:
            if m.text_class == "copy_from":
                self._open_copy(m.sql)
                self.pending = _micros(m.ts)
                return []
            row = self._event(m, m.sql, m.text_class, bool(m.text_reset))
            self.pending = _micros(m.ts)
            return [row]
        elif kind == "d" and self.copy_sql is not None:
            self.copied += len(m.chunk)
            if self.copied <= self.max_copy_bytes:
                self.fresh.append((bytes(m.chunk),))
            else:
                self._drop_chunks()
        elif kind == "f":
            self._open_copy(None)
        elif kind == "c" and self.copy_sql is not None:
            sql, size = self.copy_sql, self.copied
            data = [bytes(c[0]) for c in self.chunks.get()] + [c[0] for c in self.fresh]
            self._open_copy(None)
            if size <= self.max_copy_bytes:
                return [self._event(m, sql, "copy_from", False, chunks=data)]
        elif kind in ("C", "Z") and not m.from_client:
            if kind == "Z":
                self.tx_state = _STATES.get(m.tx_status, self.tx_state)
            if self.pending is not None:
                took = (_micros(m.ts) - self.pending) * 1000
                self.pending = None
                if took > 0:
                    return [self._row(m, "exec", exec_ns=took)]
        return []

    def _event(self, m, sql, cls, resets, oids=None, chunks=None):
        if cls == "begin" or (self.tx_pos < 0 and cls in _WRITES):
            self.tx_pos = int(m.pos)
        self.seq += 1
        row = self._row(m, "event", sql, cls, oids=oids, chunks=chunks)
        if cls == "begin":
            self.tx_state = "in_tx"
        elif cls == "commit_rollback":
            self.tx_state, self.tx_pos = "idle", -1
        if resets:
            self.statements.clear()
            self._open_copy(None)
            self.tx_pos = -1
        return row

    def _row(self, m, kind, sql=None, cls=None, oids=None, chunks=None, exec_ns=None):
        bound = kind == "event" and m.msg_type == "B"
        return (
            int(m.pos), m.ts, kind, sql, cls, self.tx_state, self.tx_pos, self.seq, bound,
            m.stmt_name if bound else None, oids,
            _none_list(m.param_formats) if bound else None,
            _none_list(m.param_values) if bound else None, chunks, exec_ns,
            _none(m.database), _none(m.db_user))

    def _open_copy(self, sql) -> None:
        self.copy_sql, self.copied = sql, 0
        self._drop_chunks()

    def _drop_chunks(self) -> None:
        self.fresh = []
        self.chunks.clear()


def _none_list(values):
    return None if values is None or isinstance(values, float) else list(values)


def _micros(ts) -> int:
    return int(pd.Timestamp(ts).value // 1000)


def stream_sessionize(messages: DataFrame, opts: SessionOptions = SessionOptions(),
                      idle_seconds: int = 300, lateness: str = "30 seconds") -> DataFrame:
    """Events, execution times and errors of a message stream, in ``EVENTS`` rows.

    ``tx_pos`` names the transaction group by the position of its first statement (-1 for
    none); the batch operators number groups instead.
    """
    rows = text_rows(messages, opts, keep_chunk=True).withWatermark("ts", lateness)
    rows = rows.select(
        "conn_key", "life", "pos", "ts", "from_client", "msg_type", "sql", "stmt_name",
        "text_class", "text_reset", "oversized", "param_oids", "param_formats",
        "param_values", "chunk", "tx_status", "database", "db_user")
    return rows.groupBy("conn_key", "life").transformWithStateInPandas(
        statefulProcessor=ConnectionState(opts.max_copy_bytes, idle_seconds),
        outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")
