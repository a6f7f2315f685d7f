"""Events as self-contained text records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltide import schemas
from sqltide.operators import scan

BREAK_AFTER = 50
_FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_CORRUPT = "_corrupt"


def encode_events(events: DataFrame, key: str = "conn_key") -> DataFrame:
    """Records of (key, value); bytes are kept as base64, absent fields stay absent."""
    return events.select(
        F.col(key).alias("key"), F.to_json(F.struct("*"), _FORMAT).alias("value"))


def decode_events(records: DataFrame, schema: T.StructType = schemas.SQL_EVENTS,
                  value: str = "value") -> DataFrame:
    """Adds ``event`` and ``corrupt``; a record that cannot be read has a null event."""
    with_error = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(value).cast("string"), with_error, {
        **_FORMAT, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    rows = records.withColumn("__parsed", parsed)
    corrupt = F.col("__parsed").isNull() | F.col(f"__parsed.{_CORRUPT}").isNotNull() \
        | F.col("__parsed.conn_key").isNull()
    event = F.struct(*[F.col(f"__parsed.{f.name}").alias(f.name) for f in schema.fields])
    return rows.withColumn("corrupt", F.coalesce(corrupt, F.lit(True))) \
        .withColumn("event", F.when(~F.col("corrupt"), event)).drop("__parsed")


def good_events(decoded: DataFrame) -> DataFrame:
    return decoded.where(~F.col("corrupt")).select("event.*")


def corrupt_count(decoded: DataFrame) -> DataFrame:
    return decoded.agg(F.count_if("corrupt").alias("corrupt_records"))


def _corrupt_run(decoded: DataFrame, keys, order: str, **split) -> DataFrame:
    """Length of the run of corrupt records that ends at each row."""
    rows = scan.running_by(decoded, list(keys), order, {
        "__bad": scan.count_if(F.col("corrupt"), inclusive=True)}, **split)
    rows = scan.running_by(rows, list(keys), order, {
        "__base": scan.latest(F.when(~F.col("corrupt"), F.col("__bad")), inclusive=True)},
        **split)
    run: Column = F.col("__bad") - F.coalesce("__base", F.lit(0))
    return rows.withColumn("run", run).drop("__bad", "__base")


def consume_until_break(decoded: DataFrame, keys=("partition",), order: str = "offset",
                        limit: int = BREAK_AFTER, **split) -> DataFrame:
    """Rows a consumer takes before ``limit`` corrupt records in a row stop it."""
    rows = _corrupt_run(decoded, keys, order, **split)
    rows = scan.running_by(rows, list(keys), order, {
        "__stop": scan.highest(F.when(F.col("run") >= limit, 1), inclusive=True)}, **split)
    return rows.where(F.col("__stop").isNull()).drop("run", "__stop")


def breaker_state(decoded: DataFrame, keys=("partition",), order: str = "offset",
                  limit: int = BREAK_AFTER, **split) -> DataFrame:
    """Longest run of corrupt records per partition, and whether it stops the consumer."""
    return _corrupt_run(decoded, keys, order, **split).groupBy(*keys).agg(
        F.count_if("corrupt").alias("corrupt_records"), F.max("run").alias("longest_run"),
        (F.max("run") >= limit).alias("tripped"))
