"""Text reports and routed output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DATABASES = 64
SQL_PREVIEW = 100


def _utc(ts: Column) -> Column:
    return F.to_utc_timestamp(ts, F.current_timezone())


def rfc3339(ts: Column, fraction: bool = True) -> Column:
    """UTC time such as 2024-01-02T15:04:05.12Z, without trailing zeros of the fraction."""
    seconds = F.date_format(_utc(ts), "yyyy-MM-dd'T'HH:mm:ss")
    if not fraction:
        return F.concat(seconds, F.lit("Z"))
    micros = F.regexp_replace(
        F.concat(F.lit("."), F.date_format(_utc(ts), "SSSSSS")), r"\.?0+$", "")
    return F.concat(seconds, micros, F.lit("Z"))


def error_records(failures: DataFrame) -> DataFrame:
    """Two-line record per failed statement (ts, conn_key, sql, error)."""
    reason = F.regexp_replace(F.coalesce("error", F.lit("unknown")), r"[\r\n]", " ")
    return failures.select(F.concat(
        F.lit("-- "), rfc3339(F.col("ts")), F.lit(" conn="), F.col("conn_key"),
        F.lit(" error: "), reason, F.lit("\n"),
        F.regexp_replace("sql", r"\n+\z", ""), F.lit(";")).alias("value"))


def error_export(failures: DataFrame, path: str) -> None:
    error_records(failures).write.mode("append").text(path)


def _preview(sql: Column) -> Column:
    """First bytes of a long statement, with a mark that it goes on."""
    head = F.substring(F.encode(sql, "UTF-8"), 1, SQL_PREVIEW).cast("string")
    return F.when(F.octet_length(sql) > SQL_PREVIEW, F.concat(head, F.lit("..."))).otherwise(sql)


def _quoted(text: Column) -> Column:
    named = {"\\": r"\\", '"': r"\"", "\a": r"\a", "\b": r"\b", "\f": r"\f", "\n": r"\n", "\r": r"\r",
             "\t": r"\t", "\v": r"\v"}
    control = {chr(c): f"\\x{c:02x}" for c in (*range(32), 127) if chr(c) not in named}
    for char, shown in (named | control).items():
        text = F.replace(text, F.lit(char), F.lit(shown))
    return F.concat(F.lit('"'), text, F.lit('"'))


def diff_records(compared: DataFrame) -> DataFrame:
    """One line per difference."""
    return compared.where(F.col("diff_type") != "NONE").select(F.concat(
        rfc3339(F.col("ts"), fraction=False), F.lit(" ["), F.col("diff_type"), F.lit("] "),
        F.col("conn_key"), F.lit(": "), _preview(F.col("sql")),
        F.format_string(" (source=%.1fms target=%.1fms err=",
                        F.bround("source_exec_ms", 1), F.bround("target_exec_ms", 1)),
        _quoted(F.coalesce("target_error", F.lit(""))), F.lit(")")).alias("value"))


def diff_export(compared: DataFrame, path: str) -> None:
    diff_records(compared).write.mode("append").text(path)


def route_by_database(events: DataFrame, path: str, max_databases: int = MAX_DATABASES) -> None:
    """Write one folder per source database; more than ``max_databases`` is an error."""
    found = events.select("database").distinct().limit(max_databases + 1).count()
    if found > max_databases:
        raise ValueError(f"more than {max_databases} databases")
    events.write.mode("append").partitionBy("database").parquet(path)


def metrics_exposition(rows: DataFrame) -> DataFrame:
    """Lines such as ``name{label="x"} 1`` of (name, labels, value) rows."""
    def escaped(v: Column) -> Column:
        for char, shown in [("\\", r"\\"), ('"', r"\""), ("\n", r"\n")]:
            v = F.replace(v, F.lit(char), F.lit(shown))
        return v

    entries = F.array_sort(F.map_entries("labels"))
    pairs = F.array_join(F.transform(entries, lambda e: F.concat(
        e["key"], F.lit('="'), escaped(e["value"]), F.lit('"'))), ",")
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), pairs, F.lit("}"))) \
        .otherwise(F.lit(""))
    whole = F.col("value").cast("long")
    number = F.when(F.col("value") == whole, whole.cast("string")) \
        .otherwise(F.col("value").cast("string"))
    return rows.select(F.concat(F.col("name"), labels, F.lit(" "), number).alias("value"))
