"""Kafka readers and writers: connection options by provider, topic streams, sink options.

The connector package comes with the cluster's Spark; nothing here needs it until a stream is loaded.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

CODECS = ("none", "gzip", "snappy", "lz4", "zstd")
_PLAIN = "org.apache.kafka.common.security.plain.PlainLoginModule"
_SCRAM = "org.apache.kafka.common.security.scram.ScramLoginModule"
_KERBEROS = "com.sun.security.auth.module.Krb5LoginModule"


@dataclass(frozen=True)
class Cluster:
    """How to reach a Kafka cluster. ``provider`` is confluent, redpanda, azure or plain."""

    brokers: str
    provider: str = "plain"
    protocol: str = ""
    sasl_mechanism: str = ""
    username: str = ""
    password: str = ""
    api_key: str = ""
    api_secret: str = ""
    connection_string: str = ""
    kerberos_service: str = ""


def _login(module: str, user: str, secret: str) -> str:
    quoted = [v.replace("\\", "\\\\").replace('"', '\\"') for v in (user, secret)]
    return f'{module} required username="{quoted[0]}" password="{quoted[1]}";'


def _sasl(mechanism: str, jaas: str, protocol: str = "SASL_SSL") -> dict[str, str]:
    return {
        "kafka.security.protocol": protocol,
        "kafka.sasl.mechanism": mechanism,
        "kafka.sasl.jaas.config": jaas,
    }


def security_options(cluster: Cluster) -> dict[str, str]:
    """Security settings of a cluster as ``kafka.*`` options; incomplete credentials raise ValueError."""
    if cluster.provider == "confluent":
        if not (cluster.api_key and cluster.api_secret):
            raise ValueError("confluent needs an API key and secret")
        return _sasl("PLAIN", _login(_PLAIN, cluster.api_key, cluster.api_secret))
    if cluster.provider == "azure":
        if not cluster.connection_string:
            raise ValueError("azure needs a connection string")
        return _sasl("PLAIN", _login(_PLAIN, "$ConnectionString", cluster.connection_string))
    if cluster.provider == "redpanda" and cluster.username and cluster.password:
        return _sasl("SCRAM-SHA-256", _login(_SCRAM, cluster.username, cluster.password))

    tls, mechanism = "SSL" in cluster.protocol.upper(), cluster.sasl_mechanism.upper()
    if not mechanism:
        return {"kafka.security.protocol": "SSL" if tls else "PLAINTEXT"}
    protocol = "SASL_SSL" if tls else "SASL_PLAINTEXT"
    if mechanism == "GSSAPI":
        if not cluster.kerberos_service:
            raise ValueError("GSSAPI needs a Kerberos service name")
        options = _sasl(mechanism, f"{_KERBEROS} required useTicketCache=true;", protocol)
        return {**options, "kafka.sasl.kerberos.service.name": cluster.kerberos_service}
    if mechanism not in ("PLAIN", "SCRAM-SHA-256", "SCRAM-SHA-512"):
        raise ValueError(f"unsupported SASL mechanism: {cluster.sasl_mechanism}")
    if not (cluster.username and cluster.password):
        raise ValueError(f"{mechanism} needs a username and password")
    module = _PLAIN if mechanism == "PLAIN" else _SCRAM
    return _sasl(mechanism, _login(module, cluster.username, cluster.password), protocol)


def broker_list(brokers: str) -> str:
    """Brokers without blanks and empty entries."""
    return ",".join(b.strip() for b in brokers.split(",") if b.strip())


def source_options(
    cluster: Cluster, *, topics: Sequence[str] = (), pattern: str = "", max_offsets: int | None = None, **extra: str
) -> dict[str, str]:
    """Options of a topic source: a fixed list, or a pattern that also picks up topics created later."""
    if bool(topics) == bool(pattern):
        raise ValueError("give either topics or a pattern")
    subscription = {"subscribePattern": pattern} if pattern else {"subscribe": ",".join(topics)}
    limit = {"maxOffsetsPerTrigger": str(max_offsets)} if max_offsets else {}
    return {
        "kafka.bootstrap.servers": broker_list(cluster.brokers), "includeHeaders": "true", **subscription, **limit,
        **security_options(cluster), **extra,
    }


def sink_options(cluster: Cluster, *, compression: str = "none", batch_kib: int = 1000) -> dict[str, str]:
    """Options of the record sink: idempotent producer with a codec and batch size."""
    if compression not in CODECS:
        raise ValueError(f"unknown compression: {compression}")
    return {
        "kafka.bootstrap.servers": broker_list(cluster.brokers),
        "kafka.compression.type": compression,
        "kafka.enable.idempotence": "true",
        "kafka.batch.size": str(batch_kib * 1024),
        **security_options(cluster),
    }


def read_topics(spark: SparkSession, cluster: Cluster, *, streaming: bool = True, **options) -> DataFrame:
    """Records of a topic list or pattern, as a stream or (with starting and ending offsets) as a batch."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").options(**source_options(cluster, **options)).load()


def as_records(kafka_rows: DataFrame) -> DataFrame:
    """Rows in the connector's schema under the names the operators use."""
    return kafka_rows.select(
        "topic", F.col("partition").alias("partition_id"), F.col("offset").alias("rec_offset"), F.col("key").alias("rec_key"),
        F.col("value").alias("rec_value"), "headers", F.col("timestamp").alias("ts"),
    )


def as_kafka_rows(mirrored: DataFrame) -> DataFrame:
    """Mirrored records in the schema of the sink; a null partition leaves the choice to the producer."""
    return mirrored.select(
        "topic", F.col("partition_id").alias("partition"), F.col("rec_key").alias("key"), F.col("rec_value").alias("value"),
        *(["headers"] if "headers" in mirrored.columns else []),
    )


def write_topics(mirrored: DataFrame, cluster: Cluster, *, compression: str = "none", batch_kib: int = 1000) -> None:
    """Write a batch of mirrored records to their topics."""
    options = sink_options(cluster, compression=compression, batch_kib=batch_kib)
    as_kafka_rows(mirrored).write.format("kafka").options(**options).save()


def stream_topics(
    mirrored: DataFrame, cluster: Cluster, checkpoint: str, *, compression: str = "none", batch_kib: int = 1000
) -> DataStreamWriter:
    """A stream writer of mirrored records; ``start()`` runs it."""
    options = sink_options(cluster, compression=compression, batch_kib=batch_kib)
    return as_kafka_rows(mirrored).writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint)
