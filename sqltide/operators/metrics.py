"""Outcome analytics: counters, histograms, percentiles, alerts and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltide.operators import scan

# Alert thresholds, histogram bounds in seconds, sample window.
LAG_LIMIT_S = 60.0
DEPTH_LIMIT = 100_000
ERROR_RATE_LIMIT = 0.01
P99_RATIO_LIMIT = 2.0
DROP_RATE_LIMIT = 0.001
EXEC_BOUNDS = (0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def error_rate(attempts: DataFrame, limit: float = ERROR_RATE_LIMIT,
               level: str = "attempt") -> DataFrame:
    """Failed share of all attempts, or of events by their last attempt (``final``)."""
    if level == "final":
        attempts = attempts.groupBy("conn_key", "event_seq").agg(
            F.max_by("target_error", "attempt").alias("target_error"))
    elif level != "attempt":
        raise ValueError("level is attempt or final")
    errors = F.count("target_error")
    n = F.count(F.lit(1))
    rate = F.when(n > 0, errors / n).otherwise(0.0)
    return attempts.agg(
        n.alias("attempts"), errors.alias("errors"), rate.alias("error_rate"),
        (rate > limit).alias("alert"))


def exec_times(results: DataFrame) -> DataFrame:
    """Source and target times of ``replay_results`` as (pos, side, seconds) rows."""
    sides = F.explode(F.array(
        F.struct(F.lit("source").alias("side"), (F.col("source_exec_ms") / 1000).alias("s")),
        F.struct(F.lit("target").alias("side"), (F.col("target_exec_ms") / 1000).alias("s"))))
    return results.select("pos", sides.alias("t")).select(
        "pos", F.col("t.side").alias("side"), F.col("t.s").alias("seconds"))


def exec_histogram(times: DataFrame) -> DataFrame:
    """Cumulative counts per side and bound; times that are not positive do not count."""
    bounds = [*EXEC_BOUNDS, float("inf")]
    seconds = F.col("seconds")
    counted = times.where(seconds > 0).groupBy("side").agg(
        F.sum("seconds").alias("__sum"),
        *[F.count_if(seconds <= F.lit(b)).alias(f"__le{i}") for i, b in enumerate(bounds)])
    rows = F.explode(F.array(*[
        F.struct(F.lit("+Inf" if b == float("inf") else f"{b:g}").alias("le"),
                 F.col(f"__le{i}").alias("n"))
        for i, b in enumerate(bounds)]))
    return counted.select("side", rows.alias("b")).select(
        "side", F.col("b.le").alias("le"), F.col("b.n").alias("n"))


def p99_nearest_rank(times: DataFrame, q: float = 0.99,
                     window: int | None = None) -> DataFrame:
    """Nearest-rank quantile of all samples per side, or of the last ``window`` if that is
    given (0 without samples)."""
    if window is None:
        return _rank_of_all(times.where(F.col("seconds") > 0), q)
    recent = scan.last_rows(times.where(F.col("seconds") > 0), "pos", window, ["side"],
                            few_keys=True)
    sides = Window.partitionBy("side")
    ranked = recent.withColumns({
        "__rank": F.row_number().over(sides.orderBy("seconds")),
        "__n": F.count(F.lit(1)).over(sides)})
    wanted = F.greatest(F.least(F.floor(q * (F.col("__n") - 1) + 0.5), F.col("__n") - 1), F.lit(0))
    found = ranked.where(F.col("__rank") == wanted + 1).select("side", "seconds")
    return found.agg(*[
        F.coalesce(F.max(F.when(F.col("side") == side, F.col("seconds"))), F.lit(0.0))
         .alias(f"{side}_p99") for side in ("source", "target")])


#: Bins of a pass, and where infinite and undefined values go, above all binary exponents.
BINS, INFINITE, UNDEFINED = 1 << 14, 9998, 9999


def _rank_of_all(times: DataFrame, q: float) -> DataFrame:
    """The value at the nearest rank of each side, by distributed selection.

    Each pass counts the values per bin, with the smallest and largest in it, and goes on inside
    the bin that holds the wanted rank: first by binary exponents, then by equal parts of what
    is left between that bin's ends. Bins never part equal values and each pass has both
    ends in different bins, so it ends, mostly in three passes. Only counts of bins travel.
    """
    x = F.col("seconds")
    exponent = F.when(F.isnan(x), UNDEFINED).when(x == float("inf"), INFINITE) \
        .otherwise(F.floor(F.log2(x)).cast("int"))
    sides = ("source", "target")
    bins = _bins(times.where(F.col("side").isin(*sides)), exponent)
    sizes = {side: sum(r.n for r in rows) for side, rows in bins.items()}
    left = {side: max(0, min(int(q * (n - 1) + 0.5), n - 1)) for side, n in sizes.items()}
    found = dict.fromkeys(sides, 0.0)
    while bins:
        ends = {}
        for side, rows in bins.items():
            for r in sorted(rows, key=lambda r: r.bin):
                if left[side] < r.n:
                    break
                left[side] -= r.n
            if r.bin == UNDEFINED or r.low == r.high:
                found[side] = r.low
            else:
                ends[side] = (r.low, r.high)
        if not ends:
            break
        inside, part = F.lit(False), F.lit(None).cast("int")
        for side, (low, high) in ends.items():
            mine = (F.col("side") == side) & x.between(low, high)
            inside |= mine
            part = F.when(mine, F.floor((x - low) / (high - low) * BINS).cast("int")).otherwise(part)
        bins = _bins(times.where(inside), part)
    return times.sparkSession.range(1).select(
        *[F.lit(float(found[side])).alias(f"{side}_p99") for side in sides])


def _bins(times: DataFrame, bin_: Column) -> dict[str, list]:
    """Per side, the bins that hold values: at most as many as a pass has."""
    out: dict[str, list] = {}
    for r in times.groupBy("side", bin_.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("seconds").alias("low"),
            F.max("seconds").alias("high")).collect():
        out.setdefault(r.side, []).append(r)
    return out


def p99_approx(times: DataFrame, q: float = 0.99, accuracy: int = 10_000) -> DataFrame:
    """Quantile over all samples from a mergeable sketch."""
    return times.where(F.col("seconds") > 0).groupBy("side").agg(
        F.percentile_approx("seconds", q, accuracy).alias("p99"))


def alerts(gauges: DataFrame) -> DataFrame:
    """Alert values (1 firing, 0 clear) of one row of gauges; every limit is strict.

    Needs ``lag_s``, ``depth``, ``error_rate``, ``source_p99``, ``target_p99`` and
    ``drop_rate``.
    """
    conditions = {
        "alert_lag": F.col("lag_s") > LAG_LIMIT_S,
        "alert_depth": F.col("depth") > DEPTH_LIMIT,
        "alert_error_rate": F.col("error_rate") > ERROR_RATE_LIMIT,
        "alert_p99": (F.col("source_p99") > 0)
        & (F.col("target_p99") > P99_RATIO_LIMIT * F.col("source_p99")),
        "alert_drop_rate": F.col("drop_rate") > DROP_RATE_LIMIT,
    }
    return gauges.withColumns({n: c.cast("double") for n, c in conditions.items()})


def throughput(events: DataFrame, every: str = "1 second") -> DataFrame:
    """Events per window and side; ``qps`` is the count over the window length."""
    counted = events.groupBy(F.window("ts", every).alias("w"), "side") \
        .agg(F.count(F.lit(1)).alias("n"))
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    return counted.select(F.col("w.start").alias("ts"), "side", "n",
                          (F.col("n") / seconds).alias("qps"))


def match_results(source: DataFrame, target: DataFrame) -> DataFrame:
    """Join outcomes of both sides on (conn_key, event_seq); lost events stay visible."""
    left = source.select("conn_key", "event_seq", "sql", "ts",
                         F.col("exec_ms").alias("source_exec_ms"),
                         F.col("error").alias("source_error"), F.lit(True).alias("__s"))
    right = target.select("conn_key", "event_seq",
                          F.col("exec_ms").alias("target_exec_ms"),
                          F.col("error").alias("target_error"), F.lit(True).alias("__t"))
    return left.join(right, ["conn_key", "event_seq"], "full_outer") \
        .withColumn("presence", F.when(F.col("__t").isNull(), "lost")
                    .when(F.col("__s").isNull(), "extra").otherwise("both")) \
        .drop("__s", "__t")


def compare_results(results: DataFrame, slow_threshold: float = 2.0,
                    extended: bool = False) -> DataFrame:
    """Add ``diff_type`` (ERROR, SLOW or NONE) and ``message``.

    ``extended`` also reports errors of the source alone (ERROR) and targets faster than
    the threshold (FAST).
    """
    def text(name: str) -> Column:
        column = F.col(name) if name in results.columns else F.lit(None).cast("string")
        return F.coalesce(column, F.lit(""))

    source, target = F.col("source_exec_ms"), F.col("target_exec_ms")
    failed = (text("target_error") != "") & (text("source_error") == "")
    slow = (source > 0) & (target > source * slow_threshold)
    kinds = F.when(failed, "ERROR").when(slow, "SLOW")
    if extended:
        kinds = kinds.when((text("source_error") != "") & (text("target_error") == ""), "ERROR") \
            .when((target > 0) & (source > target * slow_threshold), "FAST")
    kind = kinds.otherwise("NONE")
    message = F.when(failed, F.concat(F.lit("target error: "), text("target_error"))) \
        .when(slow, F.format_string("target %.0fms vs source %.0fms (%.1fx slower)",
                                    F.bround(target, 0), F.bround(source, 0),
                                    F.bround(target / source, 1)))
    return results.withColumns({"diff_type": kind, "message": message})


def diff_summary(compared: DataFrame, max_diffs: int | None = None) -> DataFrame:
    """Counts by type over all differences, or over the first ``max_diffs`` if that is given."""
    diffs = compared.where(F.col("diff_type") != "NONE")
    if max_diffs is not None:
        diffs = scan.first_rows(diffs, "pos", max_diffs)
    return diffs.groupBy("diff_type").agg(F.count(F.lit(1)).alias("n"))


def progress(log: DataFrame, started: Column, now: Column, high_watermark: int = 0,
             committed: int = 0) -> DataFrame:
    """One row of counters and rates from a log (ts, kind, lag_ms).

    Kinds are produced, consumed, replayed, failed and skipped.
    """
    kinds = ("produced", "consumed", "replayed", "failed", "skipped")

    def is_kind(k: str) -> Column:
        return F.col("kind") == k

    totals = log.agg(
        *[F.count_if(is_kind(k)).alias(k) for k in kinds],
        F.max_by("lag_ms", F.when(is_kind("replayed"), F.col("ts"))).alias("current_lag_ms"),
        F.max(F.when(is_kind("produced"), F.col("ts"))).alias("last_produce"),
        F.max(F.when(is_kind("replayed"), F.col("ts"))).alias("last_replay"))
    uptime = (F.unix_micros(now) - F.unix_micros(started)) / 1e6

    def rate(kind: str) -> Column:
        return F.when(uptime > 0, F.col(kind) / uptime).otherwise(0.0)

    return totals.withColumns({
        "uptime_s": uptime,
        "kafka_lag": F.lit(high_watermark - committed).cast("long"),
        "produce_rate": rate("produced"), "replay_rate": rate("replayed"),
        "current_lag_ms": F.coalesce("current_lag_ms", F.lit(0).cast("long"))})


def is_stale(log: DataFrame, started: Column, now: Column, threshold_s: float) -> DataFrame:
    """Whether nothing was produced for longer than the threshold."""
    seen = log.agg(F.max(F.when(F.col("kind") == "produced", F.col("ts"))).alias("last"))
    idle = F.unix_micros(now) - F.unix_micros(F.coalesce("last", started))
    return seen.select((idle > int(threshold_s * 1_000_000)).alias("is_stale"))


def metric_rows(df: DataFrame, values: dict[str, str], labels: dict[str, str] | None = None) -> DataFrame:
    """Aggregates as (name, labels, value): ``values`` maps metric names to columns."""
    pairs = [x for k, c in (labels or {}).items() for x in (F.lit(k), F.col(c).cast("string"))]
    label_map = F.create_map(*pairs) if pairs else F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value"))
        for n, c in values.items()]))
    return df.select(label_map.alias("labels"), rows.alias("m")) \
        .select(F.col("m.name").alias("name"), "labels", F.col("m.value").alias("value"))


def union_all(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
