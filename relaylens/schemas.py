"""The mirroring tables: columns and types, and the values their enumerated columns may hold."""

from __future__ import annotations

from pyspark.sql.types import StructType

# Column domains.
DOMAINS: dict[str, tuple[str, ...]] = {
    "job_status": ("active", "paused", "failed", "running"),
    "insight_type": (
        "anomaly", "optimization", "prediction", "incident_report", "recommendation", "enhanced_analysis", "log_analysis",
        "incident_analysis", "historical_trend", "fallback_analysis", "throttling_adjustment",
    ),
    "report_period": ("daily", "weekly", "monthly"),
    "snapshot_type": ("startup", "periodic", "manual"),
    "cluster_type": ("source", "target"),
    "connection_type": ("source_consumer", "target_producer"),
    "progress_status": ("active", "paused", "error", "completed"),
    "validation_status": ("pending", "validated", "invalid"),
    "checkpoint_type": ("pre_migration", "post_migration", "recovery"),
    "analysis_type": ("gap_detection", "offset_comparison", "consistency_check", "resume_validation"),
    "gap_type": ("missing_messages", "offset_mismatch", "partial_replication"),
    "resolution_status": ("unresolved", "in_progress", "resolved", "ignored"),
}

# Which domain a table's column has.
COLUMN_DOMAINS: dict[str, dict[str, str]] = {
    "replication_jobs": {"status": "job_status"},
    "ai_insights": {"insight_type": "insight_type"},
    "compliance_reports": {"period": "report_period"},
    "job_inventory_snapshots": {"snapshot_type": "snapshot_type"},
    "cluster_inventory": {"cluster_type": "cluster_type"},
    "connection_inventory": {"connection_type": "connection_type"},
    "mirror_progress": {"status": "progress_status"},
    "mirror_progress_history": {"status": "progress_status"},
    "resume_points": {"validation_status": "validation_status"},
    "migration_checkpoints": {"checkpoint_type": "checkpoint_type"},
    "mirror_state_analysis": {"analysis_type": "analysis_type"},
    "mirror_gaps": {"gap_type": "gap_type", "resolution_status": "resolution_status"},
}

_PROGRESS = (
    "job_id string, source_topic string, target_topic string, partition_id int, source_offset bigint, target_offset bigint, "
    "source_high_water_mark bigint, target_high_water_mark bigint, last_replicated_offset bigint, replication_lag bigint, "
    "last_updated timestamp, status string"
)

_COLUMNS = {
    "kafka_clusters": "name string, provider string, cluster_id string, brokers string, security_config string, api_key string, "
    "api_secret string, connection_string string, status string, updated_at timestamp",
    "replication_jobs": "id string, name string, source_cluster_name string, target_cluster_name string, status string, "
    "batch_size int, parallelism int, compression string, preserve_partitions boolean, failed_reason string, "
    "created_at timestamp, updated_at timestamp",
    "topic_mappings": "id bigint, job_id string, source_topic_pattern string, target_topic_pattern string, enabled boolean",
    "metric_samples": "job_id string, ts timestamp, messages_replicated bigint, bytes_transferred bigint, messages_consumed bigint, "
    "bytes_consumed bigint, current_lag bigint, error_count bigint",
    "aggregated_metrics": "job_id string, ts timestamp, messages_replicated_delta bigint, bytes_transferred_delta bigint, "
    "messages_consumed_delta bigint, bytes_consumed_delta bigint, avg_lag bigint, error_count_delta bigint",
    "ai_insights": "id bigint, job_id string, insight_type string, severity_level string, ai_model string, recommendation string, "
    "ts timestamp, resolution_status string, response_time_ms bigint, accuracy_score double, user_feedback string, "
    "resolved_at timestamp",
    "operational_events": "id bigint, event_type string, initiator string, details string, ts timestamp",
    "configuration": "key string, value string, updated_at timestamp",
    "users": "id bigint, username string, is_initial boolean, created_at timestamp",
    "roles": "id bigint, name string",
    "permissions": "id bigint, name string",
    "user_roles": "user_id bigint, role_id bigint",
    "role_permissions": "role_id bigint, permission_id bigint",
    "compliance_reports": "period string, start_date timestamp, end_date timestamp, generated_by bigint, generated_at timestamp, "
    "report_data string",
    "job_inventory_snapshots": "id bigint, job_id string, snapshot_type string, created_at timestamp",
    "cluster_inventory": "id bigint, snapshot_id bigint, cluster_type string, cluster_name string, provider string, brokers string, "
    "broker_count int, total_topics int, controller_id int, cluster_id string",
    "topic_inventory": "id bigint, cluster_inventory_id bigint, topic_name string, partition_count int, replication_factor int, "
    "is_internal boolean, compression_type string, config_data string",
    "partition_inventory": "id bigint, topic_inventory_id bigint, partition_id int, leader_id int, replica_ids string, "
    "isr_ids string, high_water_mark bigint",
    "consumer_group_inventory": "id bigint, snapshot_id bigint, group_id string, group_state string, protocol_type string, "
    "protocol string, member_count int",
    "consumer_group_offsets": "id bigint, consumer_group_inventory_id bigint, topic_name string, partition_id int, "
    "current_offset bigint, high_water_mark bigint, lag bigint",
    "connection_inventory": "id bigint, snapshot_id bigint, connection_type string, provider string, brokers string, "
    "security_protocol string, sasl_mechanism string, api_key_prefix string, connection_successful boolean, "
    "connection_time_ms bigint, error_message string",
    "mirror_progress": _PROGRESS,
    "mirror_progress_history": _PROGRESS,
    "resume_points": "job_id string, source_topic string, target_topic string, partition_id int, safe_resume_offset bigint, "
    "calculated_at timestamp, validation_status string, migration_checkpoint_id bigint, gap_detected boolean, "
    "gap_start_offset bigint, gap_end_offset bigint",
    "migration_checkpoints": "id bigint, job_id string, checkpoint_type string, source_consumer_group_offsets string, "
    "target_high_water_marks string, created_at timestamp, created_by string, migration_reason string, validation_results string",
    "mirror_state_analysis": "id bigint, job_id string, analysis_type string, source_cluster_state string, "
    "target_cluster_state string, analysis_results string, recommendations string, critical_issues_count int, "
    "warning_issues_count int, analyzed_at timestamp, analyzer_version string",
    "mirror_gaps": "job_id string, source_topic string, target_topic string, partition_id int, gap_start_offset bigint, "
    "gap_end_offset bigint, gap_size bigint, detected_at timestamp, gap_type string, resolution_status string, "
    "resolution_method string, resolved_at timestamp",
    "records": "key binary, value binary, headers array<struct<key: string, value: binary>>, topic string, partition int, "
    "offset bigint, timestamp timestamp, timestampType int",
    "log_lines": "value string",
}

TABLES = tuple(_COLUMNS)


def schema(table: str) -> StructType:
    """The columns of a table; needs a running session, which parses the types."""
    return StructType.fromDDL(_COLUMNS[table])
