"""Roles and permissions as data, and declared against observed job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective_permissions(user_roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """All (user, permission) pairs granted through roles.

    Users are dealt out before they meet their permissions: a small table of users is one part, and one task would hold
    all its pairs to tell them apart. The pairs then need no other exchange. The number of parts is given, as adaptive
    execution would join parts by the bytes of the users, which say little about their pairs.
    """
    granted = role_permissions.select("role_id", "permission").distinct()
    parts = int(user_roles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = user_roles.select("user_id", "username", "role_id").repartition(parts, "user_id", "username")
    return dealt.join(granted, "role_id").select("user_id", "username", "permission").distinct()


def user_roles_listing(user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """Users with their role names, by username."""
    return user_roles.join(roles, "role_id").select("user_id", "username", "role").orderBy("username", "role")


def unauthorised_actions(events: DataFrame, required: DataFrame, permissions: DataFrame) -> DataFrame:
    """What initiators did without the permission it needs: events per initiator and type.

    Events are counted per (initiator, type) before they meet the permissions, so a busy initiator is one
    row per type by then.
    """
    done = events.groupBy("initiator", "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")
    )
    needed = done.join(required, "event_type")
    held = permissions.select(F.col("username").alias("initiator"), "permission")
    return needed.join(held, ["initiator", "permission"], "left_anti").select(
        "initiator", "event_type", "permission", "events", "first_at", "last_at"
    )


def running_jobs(points: DataFrame, *, as_of: Column, span: str, ts: str = "ts") -> DataFrame:
    """Jobs with a metric point in the last ``span``."""
    return points.filter((F.col(ts) > as_of - F.expr(span)) & (F.col(ts) <= as_of)).select("job_id").distinct()


def state_corrections(jobs: DataFrame, running: DataFrame) -> DataFrame:
    """Jobs whose declared status disagrees with what runs: active but idle, paused but running, or unregistered."""
    seen = running.select("job_id").distinct().withColumn("is_running", F.lit(True))
    both = jobs.select("job_id", "status").join(seen, "job_id", "full_outer").select(
        "job_id", "status", F.coalesce("is_running", F.lit(False)).alias("is_running")
    )
    corrected = (
        F.when((F.col("status") == "active") & ~F.col("is_running"), "paused")
        .when((F.col("status") == "paused") & F.col("is_running"), "active")
        .when(F.col("status").isNull(), "unregistered")
    )
    return both.withColumn("corrected_status", corrected).filter(F.col("corrected_status").isNotNull())
