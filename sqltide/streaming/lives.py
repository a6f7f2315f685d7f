"""Ends of connections on a stream of segments.

The JVM tells what each segment does; the Python code below works on whole arrays of a
connection's rows in a micro-batch and keeps one small row per connection in the state store.
Payloads never reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sqltide.operators.capture import does, named_by_row

LIVES = T.StructType([
    T.StructField("conn_key", T.StringType()),
    T.StructField("life", T.LongType()),
    T.StructField("started", T.TimestampType()),
    T.StructField("ended", T.TimestampType()),
    T.StructField("segments", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("end_reason", T.StringType()),
])

_OPEN = ("life", "started", "ended", "segments", "bytes", "fin", "rst", "last", "closed", "opened")
_STATE = T.StructType([T.StructField(name, T.LongType()) for name in _OPEN]
                      + [T.StructField("conn_key", T.StringType())])
_NEVER = -(1 << 62)


class Lives(StatefulProcessor):
    """Closes lives by FIN, RST or silence and gives each out once."""

    def __init__(self, idle_seconds: int):
        self.idle_us = idle_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("pos", ignore_index=True)
        saved, name = self._saved() if self.open.exists() else (None, batch["conn_key"].iloc[0])
        pos, at = batch["pos"].to_numpy(), batch["at"].to_numpy()
        closing = (batch["fin"] | batch["rst"]).to_numpy()
        before = np.concatenate([[saved["last"] if saved else at[0]], at[:-1]])
        closed = _latest(pos, closing, saved["closed"] if saved else _NEVER)
        opened = _latest(pos, batch["opening"].to_numpy(), saved["opened"] if saved else _NEVER)
        fresh = (at - before >= self.idle_us) | (
            batch["opening"].to_numpy() & (closed[:-1] > _NEVER) & (closed[:-1] >= opened[:-1]))
        batch["life"] = np.cumsum(fresh) + (saved["life"] if saved else 0)
        lives = batch.groupby("life", as_index=False).agg(
            started=("at", "min"), ended=("at", "max"), segments=("at", "size"),
            bytes=("bytes", "sum"), fin=("fin", "max"), rst=("rst", "max"))
        if saved:
            lives = pd.concat([pd.DataFrame([saved])[lives.columns], lives]).groupby(
                "life", as_index=False).agg(
                started=("started", "min"), ended=("ended", "max"), segments=("segments", "sum"),
                bytes=("bytes", "sum"), fin=("fin", "max"), rst=("rst", "max"))
        kept = lives.iloc[-1].to_dict() | {
            "last": at[-1], "closed": closed[-1], "opened": opened[-1]}
        self.open.update((*(int(kept[c]) for c in _OPEN), name))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((kept["ended"] + self.idle_us) // 1000))
        yield _closed(name, lives.iloc[:-1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        saved, name = self._saved()
        self.open.clear()
        yield _closed(name, pd.DataFrame([saved]))

    def _saved(self) -> tuple[dict, str]:
        *numbers, name = self.open.get()
        return dict(zip(_OPEN, numbers, strict=True)), name

    def close(self) -> None:
        pass


def _latest(pos: np.ndarray, hit: np.ndarray, before: int) -> np.ndarray:
    """The highest position so far that hits: before each row, then behind the last."""
    return np.maximum.accumulate(np.concatenate([[before], np.where(hit, pos, _NEVER)]))


def _closed(name, lives: pd.DataFrame) -> pd.DataFrame:
    reason = np.where(lives["rst"] > 0, "rst", np.where(lives["fin"] > 0, "fin", "idle"))
    times = {c: pd.to_datetime(lives[c].astype("int64"), unit="us") for c in ("started", "ended")}
    return pd.DataFrame({
        "conn_key": name, "life": lives["life"].astype("int64"), **times,
        "segments": lives["segments"].astype("int64"), "bytes": lives["bytes"].astype("int64"),
        "end_reason": reason}, columns=LIVES.fieldNames())


def stream_connections(segments: DataFrame, idle_seconds: int = 300,
                       lateness: str = "30 seconds", server_port: int = 5432) -> DataFrame:
    """Closed lives of connections, in ``LIVES`` rows, as ``connection_sessions`` has them.

    Both directions of a connection meet under their unordered pair of ends; which end is the
    client is told by the server port, else by the first packet since it was last forgotten.

    A life is given out once: when the next one opens, or when the watermark passes
    ``idle_seconds`` behind its latest segment. Bare acknowledgements behind a FIN or RST still
    count to the closed life and open none. A connection whose life the watermark closed is
    forgotten, with its FIN, and counts its lives from 0 again. Rows without time or position are left out; rows behind the
    watermark are dropped by Spark and counted by ``late_rows``. A row that arrives in a later
    micro-batch than rows behind it counts to the life that is open then.
    """
    rows = segments.where("ts IS NOT NULL AND pos IS NOT NULL").withWatermark("ts", lateness)
    acts = does()
    rows = named_by_row(rows, server_port).select(
        "pair", "conn_key", "pos", "ts", F.unix_micros("ts").alias("at"),
        F.coalesce(F.col("len").cast("long"), F.lit(0).cast("long")).alias("bytes"),
        *[acts[name].alias(name) for name in ("fin", "rst", "opening")])
    return rows.groupBy("pair").transformWithStateInPandas(
        statefulProcessor=Lives(idle_seconds), outputStructType=LIVES,
        outputMode="Append", timeMode="EventTime")
