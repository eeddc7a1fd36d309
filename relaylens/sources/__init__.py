"""Readers and writers: Kafka options, log files, table store, metric payloads, report files."""
