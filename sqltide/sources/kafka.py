"""Kafka source and sink of events.

The connector is an extra package of Spark; the options below are all this module adds.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sqltide import schemas
from sqltide.sources import codec

GROUP = "sqltide-replayer"
_MECHANISMS = {
    "plain": "PLAIN", "scram-sha-256": "SCRAM-SHA-256", "scram-sha-512": "SCRAM-SHA-512"}
_LOGIN = {
    "PLAIN": "org.apache.kafka.common.security.plain.PlainLoginModule",
    "SCRAM-SHA-256": "org.apache.kafka.common.security.scram.ScramLoginModule",
    "SCRAM-SHA-512": "org.apache.kafka.common.security.scram.ScramLoginModule",
}


@dataclass(frozen=True)
class KafkaOptions:
    brokers: tuple[str, ...]
    topic: str
    sasl_mechanism: str = ""
    sasl_username: str = ""
    sasl_password: str = ""
    sasl_password_env: str = ""
    tls_enabled: bool = False
    tls_skip_verify: bool = False
    tls_ca_file: str = ""
    tls_cert_file: str = ""
    tls_key_file: str = ""


def _password(opts: KafkaOptions) -> str:
    if opts.sasl_password_env:
        return os.environ.get(opts.sasl_password_env, "")
    return opts.sasl_password


def connection_options(opts: KafkaOptions) -> dict[str, str]:
    """``kafka.*`` options for brokers, login and encryption."""
    if not opts.brokers or not opts.topic:
        raise ValueError("brokers and topic are required")
    out = {"kafka.bootstrap.servers": ",".join(opts.brokers)}
    if opts.sasl_mechanism:
        mechanism = _MECHANISMS.get(opts.sasl_mechanism.lower())
        if mechanism is None:
            raise ValueError(f"mechanism {opts.sasl_mechanism!r} is none of {', '.join(_MECHANISMS)}")
        password = _password(opts)
        if not opts.sasl_username or not password:
            raise ValueError("login needs a user name and a password")
        escaped = [x.replace("\\", "\\\\").replace('"', '\\"')
                   for x in (opts.sasl_username, password)]
        out["kafka.sasl.mechanism"] = mechanism
        out["kafka.sasl.jaas.config"] = (
            f'{_LOGIN[mechanism]} required username="{escaped[0]}" password="{escaped[1]}";')
    out["kafka.security.protocol"] = (
        ("SASL_" if opts.sasl_mechanism else "") + ("SSL" if opts.tls_enabled else "PLAINTEXT"))
    if opts.tls_enabled:
        if opts.tls_ca_file:
            out["kafka.ssl.truststore.type"] = "PEM"
            out["kafka.ssl.truststore.location"] = opts.tls_ca_file
        if opts.tls_cert_file and opts.tls_key_file:
            out["kafka.ssl.keystore.type"] = "PEM"
            with open(opts.tls_cert_file) as cert, open(opts.tls_key_file) as key:
                out["kafka.ssl.keystore.certificate.chain"] = cert.read()
                out["kafka.ssl.keystore.key"] = key.read()
        if opts.tls_skip_verify:
            out["kafka.ssl.endpoint.identification.algorithm"] = ""
    return out


def read_options(opts: KafkaOptions) -> dict[str, str]:
    return {**connection_options(opts), "subscribe": opts.topic,
            "startingOffsets": "earliest", "kafka.group.id": GROUP}


def write_options(opts: KafkaOptions) -> dict[str, str]:
    return {**connection_options(opts), "topic": opts.topic, "kafka.acks": "all"}


def read_events_kafka(spark: SparkSession, opts: KafkaOptions, streaming: bool = True,
                      schema=schemas.SQL_EVENTS) -> DataFrame:
    """Decoded records with ``partition``, ``offset``, ``event`` and ``corrupt``."""
    reader = spark.readStream if streaming else spark.read
    records = reader.format("kafka").options(**read_options(opts)).load()
    return codec.decode_events(records.select("key", "value", "partition", "offset"), schema)


def kafka_frames(events: DataFrame) -> DataFrame:
    """Key and value of each record; the connection is the key, so it stays in one partition."""
    return codec.encode_events(events)


def write_events_kafka(events: DataFrame, opts: KafkaOptions, checkpoint: str | None = None):
    """Append a batch, or start a streaming query if ``events`` is a stream."""
    frames = kafka_frames(events)
    if not events.isStreaming:
        return frames.write.format("kafka").options(**write_options(opts)).save()
    return (frames.writeStream.format("kafka").options(**write_options(opts))
            .option("checkpointLocation", checkpoint).start())
