"""Captured network segments: direction, order, lifetime and loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltide.operators import scan

STREAM = ["conn_key", "from_client"]
DROP_RATE_LIMIT = 0.001
_WRAP = 1 << 32
DAY = 86_400_000_000


def capture_filter(segments: DataFrame, port: int = 5432, source_host: str | None = None,
                   source_port: int = 0) -> DataFrame:
    """Rows from or to the server port, and from or to one host if given.

    Plain column comparisons, so the Parquet scan receives them.
    """
    wanted = (source_port or port) if source_host else port
    on_port = (F.col("src_port") == wanted) | (F.col("dst_port") == wanted)
    if not source_host:
        return segments.where(on_port)
    return segments.where(
        on_port & ((F.col("src_ip") == source_host) | (F.col("dst_ip") == source_host)))


def _unmapped(ip: str) -> Column:
    return F.regexp_replace(ip, r"(?i)^::ffff:(\d+\.\d+\.\d+\.\d+)$", "$1")


def conn_key(src_ip, src_port, dst_ip, dst_port) -> Column:
    return F.concat(src_ip, F.lit(":"), src_port.cast("string"), F.lit("-"),
                    dst_ip, F.lit(":"), dst_port.cast("string"))


def canonical_conn(segments: DataFrame, server_port: int = 5432) -> DataFrame:
    """Orient every segment client to server: adds ``conn``, ``conn_key``, ``from_client``.

    The server port decides. Only pairs in which no side or both sides use it need their
    first packet looked up; all other rows stay a projection.
    """
    rows = segments.withColumns({"src_ip": _unmapped("src_ip"), "dst_ip": _unmapped("dst_ip")})
    to_server = F.col("dst_port") == server_port
    from_server = F.col("src_port") == server_port
    clear = rows.where(to_server != from_server).withColumn("from_client", to_server)

    here = F.concat_ws(":", "src_ip", F.col("src_port").cast("string"))
    there = F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string"))
    open_ends = rows.where(to_server == from_server).withColumns({
        "__pair": F.concat_ws("|", F.least(here, there), F.greatest(here, there)),
        "__from": here})
    first = open_ends.groupBy("__pair").agg(F.min_by("__from", "pos").alias("__client"))
    looked_up = open_ends.join(first, "__pair") \
        .withColumn("from_client", F.col("__from") == F.col("__client")) \
        .drop("__pair", "__from", "__client")

    rows = clear.unionByName(looked_up)
    ends = {
        name: F.when(F.col("from_client"), F.col(a)).otherwise(F.col(b))
        for name, a, b in [
            ("src_ip", "src_ip", "dst_ip"), ("src_port", "src_port", "dst_port"),
            ("dst_ip", "dst_ip", "src_ip"), ("dst_port", "dst_port", "src_port")]}
    return rows.withColumns({
        "conn": F.struct(*[c.alias(n) for n, c in ends.items()]),
        "conn_key": conn_key(*ends.values())})


def named_by_row(segments: DataFrame, server_port: int = 5432) -> DataFrame:
    """Add ``pair``, equal for both directions, and ``conn_key`` as far as one row can tell it.

    Where no side or both sides use the server port, the sender counts as the client; the
    ``conn_key`` of a pair's first packet is then the one that ``canonical_conn`` gives.
    """
    ip = {c: _unmapped(c) for c in ("src_ip", "dst_ip")}
    sent = conn_key(ip["src_ip"], F.col("src_port"), ip["dst_ip"], F.col("dst_port"))
    answered = conn_key(ip["dst_ip"], F.col("dst_port"), ip["src_ip"], F.col("src_port"))
    answer = (F.col("src_port") == server_port) & (F.col("dst_port") != server_port)
    return segments.withColumns({
        "pair": F.concat_ws("|", F.least(sent, answered), F.greatest(sent, answered)),
        "conn_key": F.when(answer, answered).otherwise(sent)})


def order_segments(segments: DataFrame, keys=tuple(STREAM), hot_rows: int = scan.HOT_ROWS,
                   width: int = scan.RANGE_WIDTHS[0],
                   byte_width: int = 1 << 26) -> DataFrame:
    """Put payload in stream order; mark duplicates, overlaps and gaps.

    The 32-bit sequence is unwrapped along arrival order first. The result stays one row
    per segment with its new bytes (``payload`` without what was seen before): a stream
    is never gathered into one value. No handshake is needed. Where a ``life`` tells
    connections on the same ports apart, each has a stream of its own.
    """
    keys = [*keys, *(["life"] if "life" in segments.columns and "life" not in keys else [])]
    data = segments.where(F.col("len") > 0)
    end = F.col("stream_seq") + F.col("len")

    def ordered(rows: DataFrame, split: bool) -> DataFrame:
        rows = scan.running(rows, keys, "pos", {"__prev": scan.latest(F.col("tcp_seq"))},
                            split, width)
        jump = F.col("tcp_seq") - F.col("__prev")
        turn = F.when(jump < -(_WRAP >> 1), 1).when(jump > (_WRAP >> 1), -1).otherwise(0)
        rows = scan.running(
            rows.withColumn("__turn", turn.cast("long")), keys, "pos",
            {"__turns": scan.total(F.col("__turn"), inclusive=True)}, split, width)
        rows = rows.withColumn("stream_seq", F.col("tcp_seq") + F.col("__turns") * _WRAP)
        return scan.running(rows, keys, "stream_seq", {"__seen": scan.highest(end)},
                            split, byte_width, ties=["pos"])

    rows = scan.by_heat(data, keys, scan.find_hot(data, keys, hot_rows), ordered)
    seen = F.col("__seen")
    known = F.least(F.greatest(seen - F.col("stream_seq"), F.lit(0)), F.col("len"))
    status = (F.when(seen.isNull(), "start").when(end <= seen, "duplicate")
              .when(F.col("stream_seq") < seen, "overlap")
              .when(F.col("stream_seq") > seen, "gap").otherwise("next"))
    out = [c for c in segments.columns if c != "payload"]
    rows = rows.withColumns({
        "status": status,
        "new_bytes": (F.col("len") - F.coalesce(known, F.lit(0))).cast("long"),
        "gap_bytes": F.coalesce(
            F.greatest(F.col("stream_seq") - seen, F.lit(0)), F.lit(0)).cast("long"),
    })
    if "payload" in segments.columns:
        rows = rows.withColumn("payload", F.expr(
            "substring(payload, CAST(len - new_bytes AS INT) + 1)"))
        out.append("payload")
    return rows.select(*out, "stream_seq", "status", "new_bytes", "gap_bytes")


def does() -> dict[str, Column]:
    """What a segment does to its connection: ``fin``, ``rst``, ``opening``."""
    flags = F.upper(F.coalesce("flags", F.lit("")))
    return {"fin": flags.contains("FIN"), "rst": flags.contains("RST"),
            "opening": F.coalesce(F.col("len") > 0, F.lit(False)) | flags.contains("SYN")}


def assign_life(segments: DataFrame, idle_seconds: int = 300,
                hot_rows: int = scan.HOT_ROWS,
                width: int = scan.RANGE_WIDTHS[0]) -> DataFrame:
    """Number the lives of each connection.

    A life ends after FIN or RST, or after ``idle_seconds`` without a segment. Bare
    acknowledgements behind a FIN still belong to the closed life.
    """
    acts = does()
    closing, opening = acts["fin"] | acts["rst"], acts["opening"]

    def lives(rows: DataFrame, split: bool) -> DataFrame:
        rows = scan.running(rows, ["conn_key"], "pos", {
            "__before": scan.latest(F.col("ts")),
            "__closed": scan.highest(F.when(closing, F.col("pos"))),
            "__opened": scan.highest(F.when(opening, F.col("pos"))),
        }, split, width)
        quiet = F.unix_micros("ts") - F.unix_micros("__before") >= idle_seconds * 1_000_000
        reopened = opening & (F.col("__closed") >= F.coalesce("__opened", F.lit(-1)))
        rows = rows.withColumn("__new", F.coalesce(quiet, F.lit(False))
                               | F.coalesce(reopened, F.lit(False)))
        return scan.running(
            rows, ["conn_key"], "pos",
            {"life": scan.count_if(F.col("__new"), inclusive=True)}, split, width)

    hot = scan.find_hot(segments, ["conn_key"], hot_rows)
    return scan.by_heat(segments, ["conn_key"], hot, lives).select(*segments.columns, "life")


def connection_sessions(segments: DataFrame, idle_seconds: int = 300,
                        hot_rows: int = scan.HOT_ROWS,
                        width: int = scan.RANGE_WIDTHS[0]) -> DataFrame:
    """One row per life of a connection, with the reason of its end."""
    acts = does()
    return assign_life(segments, idle_seconds, hot_rows, width).groupBy("conn_key", "life").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"),
        F.count(F.lit(1)).alias("segments"),
        F.sum(F.col("len").cast("long")).alias("bytes"),
        F.when(F.bool_or(acts["rst"]), "rst")
         .when(F.bool_or(acts["fin"]), "fin").otherwise("idle").alias("end_reason"))


def capture_loss(stats: DataFrame, limit: float = DROP_RATE_LIMIT) -> DataFrame:
    """Counter increments and drop rate from cumulative totals.

    A total that goes backwards is a new baseline and adds nothing.
    """
    rows = scan.running_all(
        stats.withColumn("__at", F.unix_micros("ts")), "__at",
        {"__received": scan.latest(F.col("received")), "__dropped": scan.latest(F.col("dropped"))},
        (DAY, 1 << 12))

    def step(now: str, before: str) -> Column:
        return F.greatest(F.col(now) - F.coalesce(before, F.lit(0)), F.lit(0))

    rate = F.when(F.col("received") > 0, F.col("dropped") / F.col("received")).otherwise(0.0)
    return rows.select(
        "ts", "received", "dropped",
        step("received", "__received").alias("received_delta"),
        step("dropped", "__dropped").alias("dropped_delta"),
        rate.alias("drop_rate"), (rate > limit).alias("alert"))
