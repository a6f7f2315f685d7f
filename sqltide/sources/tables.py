"""Tables of captured traffic, at rest and in motion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sqltide import schemas


def read_table(spark: SparkSession, path: str, schema, streaming: bool = False,
               **options) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).options(**options).parquet(path)


def read_messages(spark: SparkSession, path: str, streaming: bool = False,
                  **options) -> DataFrame:
    """Message log of both directions, ordered by ``pos`` per connection."""
    return read_table(spark, path, schemas.MESSAGES, streaming, **options)


def read_segments(spark: SparkSession, path: str, streaming: bool = False,
                  **options) -> DataFrame:
    return read_table(spark, path, schemas.SEGMENTS, streaming, **options)


def spool_events(events: DataFrame, path: str, checkpoint: str,
                 trigger: dict | None = None):
    """Durable event log on disk; the checkpoint is the cursor after a restart."""
    return (events.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_spool(spark: SparkSession, path: str, schema=schemas.SQL_EVENTS,
               streaming: bool = True, **options) -> DataFrame:
    """Events of a spool; each streaming reader keeps its own cursor."""
    return read_table(spark, path, schema, streaming, **options)
