"""Compliance: report windows, audit sections, health score, whole reports, schedules, retention classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens.functions.dated import on_days
from relaylens.functions.ratios import percent

PERIODS = ("daily", "weekly", "monthly")

# Advice texts of a report.
LOW_SCORE_ADVICE = "Review system performance and address any recurring errors"
DENIED_ADVICE = "Review user permissions and access controls - high number of permission denied events"
ERROR_ADVICE = "Investigate and reduce error rate - currently above acceptable threshold"
NORMAL_ADVICE = "System is operating within normal parameters"

# Audit category and retention in years by event type; any other type is general, one year.
RETENTION = {
    "Job Management": (7, ("job_created", "job_updated", "job_deleted")),
    "Infrastructure Changes": (10, ("cluster_added", "cluster_removed", "cluster_updated")),
    "Access Control": (3, ("user_login", "user_logout", "authentication_failed")),
    "System Configuration": (5, ("configuration_changed",)),
}
GENERAL = ("General Operations", 1)


def report_window(period: str, as_of: Column) -> tuple[Column, Column]:
    """Inclusive bounds: today's 24 hours, the last 7 days, or the last calendar month."""
    if period == "daily":
        start = F.date_trunc("day", as_of).cast("timestamp_ntz")
        return start, start + F.expr("INTERVAL 24 HOURS")
    if period == "weekly":
        return as_of - F.expr("INTERVAL 7 DAYS"), as_of
    if period == "monthly":
        return as_of - F.expr("INTERVAL 1 MONTH"), as_of
    raise ValueError(f"invalid period: {period}")


def in_windows(rows: DataFrame, *, as_of: Column, ts: str = "ts") -> DataFrame:
    """Rows once per report period whose window holds them, in a ``period`` column.

    A literal array is exploded instead of joining a table of periods; the outer bounds are a plain
    filter, which reaches the scan.
    """
    bounds = {p: report_window(p, as_of) for p in PERIODS}
    earliest = F.least(*[b[0] for b in bounds.values()])
    latest = F.greatest(*[b[1] for b in bounds.values()])
    matching = F.array_compact(
        F.array(*[F.when(F.col(ts).between(start, end), F.lit(p)) for p, (start, end) in bounds.items()])
    )
    inside = on_days(rows, ts, earliest, latest).filter((F.col(ts) >= earliest) & (F.col(ts) <= latest))
    return inside.withColumn("period", F.explode(matching))


def all_periods(df: DataFrame, *, as_of: Column) -> DataFrame:
    """One row per period with its bounds."""
    rows = [
        F.struct(F.lit(p).alias("period"), start.alias("start_date"), end.alias("end_date"))
        for p, (start, end) in ((p, report_window(p, as_of)) for p in PERIODS)
    ]
    return df.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("w")).select("w.*")


def event_sections(events: DataFrame, *, as_of: Column) -> DataFrame:
    """Access audit and security events per period, from one aggregation of the events."""
    kind = F.col("event_type")
    counted = in_windows(events, as_of=as_of).groupBy("period").agg(
        F.count_if(kind == "auth_login").alias("total_login_attempts"),
        F.count_if(kind == "auth_failed").alias("failed_login_attempts"),
        F.count_distinct(F.when(F.col("initiator") != "system", F.col("initiator"))).alias("unique_active_users"),
        F.count_if(kind == "permission_denied").alias("permission_denied_events"),
        F.count_if(kind == "config_change").alias("configuration_changes"),
    )
    full = all_periods(events, as_of=as_of).select("period").join(counted, "period", "left").na.fill(0)
    attempts, failed = F.col("total_login_attempts"), F.col("failed_login_attempts")
    return full.withColumn(
        "success_rate", F.round(F.coalesce(percent(attempts - failed, attempts), F.lit(0.0)), 6)
    ).withColumn("security_incidents", F.col("permission_denied_events"))


def access_audit(events: DataFrame, *, as_of: Column) -> DataFrame:
    """Logins, failures, people seen and success percentage per period."""
    return event_sections(events, as_of=as_of).select(
        "period", "total_login_attempts", "failed_login_attempts", "unique_active_users", "success_rate"
    )


def security_events(events: DataFrame, *, as_of: Column) -> DataFrame:
    """Denied requests, configuration changes and incidents per period."""
    return event_sections(events, as_of=as_of).select(
        "period", "permission_denied_events", "configuration_changes", "security_incidents"
    )


def metric_sections(points: DataFrame, *, as_of: Column) -> DataFrame:
    """Data processing and performance per period, from one aggregation of the metric points."""
    running = F.col("messages_replicated_delta") > 0
    summed = in_windows(points, as_of=as_of).groupBy("period").agg(
        F.sum("messages_replicated_delta").alias("total_messages"),
        F.sum("bytes_transferred_delta").alias("total_bytes"),
        F.sum("avg_lag").alias("lag_sum"),
        F.sum("error_count_delta").alias("total_errors"),
        F.count(F.lit(1)).alias("points"),
        F.count_if(running).alias("running_points"),
    )
    full = all_periods(points, as_of=as_of).select("period").join(summed, "period", "left").na.fill(0)

    def mean(total: str) -> Column:
        return F.round(F.coalesce(F.try_divide(F.col(total).cast("double"), n), F.lit(0.0)), 6)

    n = F.col("points")
    return full.select(
        "period", "total_messages", "total_bytes", "total_errors",
        mean("lag_sum").alias("average_lag"),
        mean("total_messages").alias("average_throughput"),
        F.round(F.coalesce(percent(F.col("total_errors"), F.col("total_messages")), F.lit(0.0)), 6).alias("error_rate_percentage"),
        F.round(F.coalesce(percent(F.col("running_points"), n), F.lit(0.0)), 6).alias("uptime_percentage"),
    )


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Active jobs now, under every period."""
    periods = F.explode(F.array(*[F.lit(p) for p in PERIODS])).alias("period")
    return jobs.filter(F.col("status") == "active").select(periods).groupBy("period").agg(F.count(F.lit(1)).alias("active_jobs"))


def data_processing(points: DataFrame, jobs: DataFrame, *, as_of: Column) -> DataFrame:
    """Messages, bytes and average lag per period, with the number of active jobs."""
    sections = metric_sections(points, as_of=as_of).select("period", "total_messages", "total_bytes", "average_lag")
    return sections.join(active_jobs(jobs), "period", "left").na.fill(0, ["active_jobs"])


def performance(points: DataFrame, *, as_of: Column) -> DataFrame:
    """Average messages per point, errors, error percentage and share of points with traffic, per period."""
    return metric_sections(points, as_of=as_of).select(
        "period", "average_throughput", "total_errors", "error_rate_percentage", "uptime_percentage"
    )


def config_changes(events: DataFrame, *, as_of: Column) -> DataFrame:
    """Configuration changes per period, newest first: the audit trail stays rows, however long it gets."""
    changes = in_windows(events.filter(F.col("event_type") == "config_change"), as_of=as_of)
    return changes.select("period", "ts", "event_id", "initiator", "details").orderBy(
        "period", F.col("ts").desc(), F.col("event_id").desc()
    )


def audit_trail_pages(events: DataFrame, *, as_of: Column, page_size: int = 1000) -> DataFrame:
    """The audit trail of every period as JSON lists, to be stored beside its report.

    A page holds the changes of ``page_size`` event ids, so a row stays bounded however long the trail gets.
    """
    changes = in_windows(events.filter(F.col("event_type") == "config_change"), as_of=as_of)
    page = F.expr(f"CAST(event_id DIV {int(page_size)} AS BIGINT)").alias("page")
    entries = F.sort_array(F.collect_list(F.struct("event_id", "initiator", "details")))
    return changes.groupBy("period", page).agg(F.count(F.lit(1)).alias("changes"), F.to_json(entries).alias("trail"))


def insight_usage(insights: DataFrame, *, as_of: Column) -> DataFrame:
    """Insights per period and type, with the period's total."""
    counted = in_windows(insights, as_of=as_of).groupBy("period", "insight_type").agg(F.count(F.lit(1)).alias("insights"))
    totals = counted.groupBy("period").agg(F.sum("insights").alias("total_insights"))
    return counted.join(totals, "period")


def health_columns(df: DataFrame) -> DataFrame:
    """Score, status and advice from ``permission_denied_events`` and ``error_rate_percentage``."""
    denied, errors = F.col("permission_denied_events"), F.col("error_rate_percentage")
    score = F.greatest(F.lit(100.0) - denied * F.lit(0.5) - errors * 10, F.lit(0.0))
    scored = df.withColumn("overall_health_score", F.round(score, 6))
    health = F.col("overall_health_score")
    advice = F.array_compact(
        F.array(
            F.when(health < 90, LOW_SCORE_ADVICE), F.when(denied > 10, DENIED_ADVICE), F.when(errors > 1.0, ERROR_ADVICE)
        )
    )
    return scored.withColumn(
        "compliance_status",
        F.when(health < 70, "NON_COMPLIANT").when(health < 90, "ATTENTION_REQUIRED").otherwise("COMPLIANT"),
    ).withColumn(
        "recommendations", F.to_json(F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(NORMAL_ADVICE))))
    )


def health_summary(events: DataFrame, points: DataFrame, *, as_of: Column) -> DataFrame:
    """Health score, status and advice per period."""
    joined = security_events(events, as_of=as_of).join(performance(points, as_of=as_of), "period")
    return health_columns(joined).select(
        "period", "permission_denied_events", "error_rate_percentage", "overall_health_score", "compliance_status",
        "recommendations",
    )


def compliance_reports(
    events: DataFrame, points: DataFrame, insights: DataFrame, jobs: DataFrame, *, as_of: Column
) -> DataFrame:
    """All sections of the daily, weekly and monthly report, one row per period; one scan per input.

    The audit trail is referred to by its number of changes; its rows come from :func:`config_changes`.
    """
    usage = insight_usage(insights, as_of=as_of).groupBy("period").agg(
        F.max("total_insights").alias("total_insights_generated"),
        F.to_json(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("insight_type", "insights"))))
        ).alias("insights_by_type"),
    )
    joined = (
        all_periods(events, as_of=as_of)
        .join(event_sections(events, as_of=as_of), "period")
        .join(metric_sections(points, as_of=as_of), "period")
        .join(usage, "period", "left")
        .join(active_jobs(jobs), "period", "left")
        .na.fill(0, ["active_jobs"])
    )
    return health_columns(joined).withColumn(
        "total_insights_generated", F.coalesce("total_insights_generated", F.lit(0))
    ).withColumn("insights_by_type", F.coalesce("insights_by_type", F.lit("{}")))


def stored_reports(reports: DataFrame, *, as_of: Column, generated_by: int = 0) -> DataFrame:
    """Reports as they are stored: period, bounds, author, time, and the sections as one JSON text."""
    plain = ("period", "start_date", "end_date")
    sections = F.struct(*[F.col(c) for c in reports.columns if c not in plain])
    return reports.select(
        *plain, F.lit(generated_by).cast("long").alias("generated_by"), as_of.alias("generated_at"),
        F.to_json(sections).alias("report_data"),
    )


def newest_reports(stored: DataFrame, *, limit: int = 50) -> DataFrame:
    """Stored reports, newest first."""
    return stored.orderBy(F.col("generated_at").desc(), "period").limit(limit)


def report_rows(reports: DataFrame, events: DataFrame, period: str, *, as_of: Column, title: str = "Compliance Report") -> DataFrame:
    """A report as ordered text rows ``(section, at, row_id, c1, c2, c3)``: header, summary, audit trail."""
    chosen = reports.filter(F.col("period") == period)
    blank = F.lit("")

    def day(c: str) -> Column:
        return F.date_format(c, "yyyy-MM-dd")

    lines = [
        (1, F.lit(title), blank, blank),
        (2, F.lit("Period"), F.col("period"), blank),
        (3, F.lit("Date Range"), F.concat(day("start_date"), F.lit(" to "), day("end_date")), blank),
        (4, F.lit("Generated"), F.date_format(as_of, "yyyy-MM-dd HH:mm:ss"), blank),
        (5, blank, blank, blank),
        (6, F.lit("COMPLIANCE SUMMARY"), blank, blank),
        (7, F.lit("Metric"), F.lit("Value"), blank),
        (8, F.lit("Health Score"), F.concat(F.format_string("%.1f", "overall_health_score"), F.lit("%")), blank),
        (9, F.lit("Status"), F.col("compliance_status"), blank),
        (10, blank, blank, blank),
        (11, F.lit("AUDIT TRAIL (Configuration Changes)"), blank, blank),
        (12, F.lit("Timestamp"), F.lit("Initiator"), F.lit("Details")),
    ]
    head = chosen.select(
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("section"), a.alias("c1"), b.alias("c2"), c.alias("c3")) for i, a, b, c in lines])
        ).alias("line")
    ).select("line.section", F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(None).cast("long").alias("row_id"), "line.c1", "line.c2", "line.c3")
    trail = config_changes(events, as_of=as_of).filter(F.col("period") == period).select(
        F.lit(13).alias("section"), F.col("ts").alias("at"), F.col("event_id").alias("row_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("c1"), F.col("initiator").alias("c2"), F.col("details").alias("c3"),
    )
    return head.unionByName(trail).orderBy("section", F.col("at").desc(), F.col("row_id").desc())


def due_reports(calendar: DataFrame, *, run_hour: int) -> DataFrame:
    """Rows ``(period, now_ts, last_run)`` whose report is due: right hour, right day, not yet run in the period."""
    now, last = F.col("now_ts"), F.col("last_run")

    def new(unit: str) -> Column:
        return last.isNull() | (F.date_trunc(unit, now) != F.date_trunc(unit, last))

    due = (
        F.when(F.col("period") == "daily", new("day"))
        .when(F.col("period") == "weekly", (F.dayofweek(now) == 2) & new("week"))
        .when(F.col("period") == "monthly", (F.dayofmonth(now) == 1) & new("month"))
        .otherwise(False)
    )
    return calendar.filter((F.hour(now) == run_hour) & due)


def retention_classes(events: DataFrame) -> DataFrame:
    """Events per audit category, with the day they may be dropped."""
    category, years = F.lit(GENERAL[0]), F.lit(GENERAL[1])
    for name, (keep, types) in RETENTION.items():
        member = F.col("event_type").isin(*types)
        category, years = F.when(member, name).otherwise(category), F.when(member, keep).otherwise(years)
    return (
        events.select(F.to_date("ts").alias("day"), category.alias("category"), years.alias("years"))
        .groupBy("category", "years", "day")
        .agg(F.count(F.lit(1)).alias("events"))
        .select("category", F.col("years").alias("retention_years"), F.expr("add_months(day, years * 12)").alias("expires_on"), "events")
    )


def newest_events(events: DataFrame, *, limit: int = 100) -> DataFrame:
    """The newest operational events."""
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(limit)
