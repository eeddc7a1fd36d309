"""Log lines to columns, pattern counts and per-job summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylens.functions.timeline import hour_of

# [time] LEVEL [file.go:12] [AI:category:subcategory] [job:id] [component:name] message; "[Job id]" is older.
LINE = (
    r"^\[([^\]]+)\]\s+(\S+)\s+"
    r"(?:\[([^\]\[:]+\.[a-z]+:[0-9]+|unknown)\]\s*)?"
    r"(?:\[AI:([^:\]]+):([^:\]]+)[^\]]*\]\s*)?"
    r"(?:\[(?:job:|Job )([^\]]+)\]\s*)?"
    r"(?:\[component:([^\]]+)\]\s*)?"
    r"(.*)$"
)
FIELDS = ("time", "level", "caller", "category", "subcategory", "job_id", "component", "message")
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"
_SEPARATOR = "\u0001"


def _fields(lines: DataFrame, line: str) -> DataFrame:
    """All fields of a line from one regular expression; a line that does not match is a single field.

    The one-element explode makes Spark compute the fields once; as a plain column the expression would be
    repeated in every filter and column that uses it.
    """
    rewritten = F.regexp_replace(F.col(line), LINE, _SEPARATOR.join(f"${i}" for i in range(1, len(FIELDS) + 1)))
    return lines.select("*", F.explode(F.array(F.split(rewritten, _SEPARATOR))).alias("__parts"))


def _time() -> Column:
    matched = F.size("__parts") == len(FIELDS)
    return F.when(matched, F.try_to_timestamp(F.col("__parts")[0], F.lit(TIME_FORMAT))).cast("timestamp_ntz")


def parse_log_lines(lines: DataFrame, *, line: str = "line") -> DataFrame:
    """Well-formed lines as ``ts, level, caller, category, subcategory, job_id, component, message``."""
    parsed = _fields(lines, line).withColumn("ts", _time()).filter(F.col("ts").isNotNull())
    values: list[Column] = [F.col("__parts")[i].alias(name) for i, name in enumerate(FIELDS) if name not in ("time", "message")]
    kept = [c for c in lines.columns if c != line]
    return parsed.select(*kept, "ts", *values, F.trim(F.col("__parts")[7]).alias("message"))


def malformed_log_lines(lines: DataFrame, *, line: str = "line") -> DataFrame:
    """Lines that are not log entries."""
    return _fields(lines, line).filter(_time().isNull()).select(*lines.columns)


def job_log_entries(parsed: DataFrame, *, since: Column, job_id: str | None = None) -> DataFrame:
    """Entries tagged for a job (or for any) and newer than ``since``."""
    owner = F.col("job_id") != "" if job_id is None else F.col("job_id") == job_id
    return parsed.filter(owner & (F.col("ts") > since))


def pattern_counts(parsed: DataFrame) -> DataFrame:
    """Entries by level, category, subcategory, job and hour."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return parsed.groupBy("level", "category", "subcategory", "job_id", hour).agg(F.count(F.lit(1)).alias("lines"))


def job_log_summary(parsed: DataFrame, *, newest: int = 50, order: Sequence[str] = ("ts",), ts: str = "ts") -> DataFrame:
    """Per job: error and warning counts, severity, and the newest messages of the producer and of the rest.

    One pass over the entries: hours count theirs and keep the newest of each side, days those of their hours, jobs those of their days. So
    no task gets more of a busy job than an hour's entries or the newest messages of its days.
    """
    picked = F.struct(F.struct(*order).alias("at"), "message")
    sides = Window.partitionBy("job_id", "hour", "is_producer").orderBy(picked.desc())
    entries = parsed.filter(F.col("job_id") != "").select(
        "job_id", "level", "message", *order, (F.col("component") == "producer").alias("is_producer"), hour_of(ts).alias("hour")
    ).repartition("job_id", "hour")
    ranked = entries.withColumn("rank", F.row_number().over(sides))

    def top(lists: Column) -> Column:
        return F.slice(F.sort_array(lists, asc=False), 1, newest)

    def of_side(side: Column) -> Column:
        return top(F.collect_list(F.when(side & (F.col("rank") <= newest), picked)))

    counts = {"error_count": F.count_if(F.col("level") == "ERROR"), "warn_count": F.count_if(F.col("level") == "WARN")}
    rows = ranked.groupBy("job_id", "hour").agg(
        *[c.alias(n) for n, c in counts.items()], of_side(F.col("is_producer")).alias("producer"), of_side(~F.col("is_producer")).alias("consumer")
    )
    for keys in (("job_id", F.expr("hour DIV 24").alias("day")), ("job_id",)):
        rows = rows.groupBy(*keys).agg(
            *[F.sum(n).alias(n) for n in counts], *[top(F.flatten(F.collect_list(s))).alias(s) for s in ("producer", "consumer")]
        )
    severity = F.when(F.col("error_count") > 10, "high").when(F.col("error_count") > 0, "medium").otherwise("low")
    logs = [F.array_join(F.transform(s, lambda m: m["message"]), "\n").alias(f"{s}_logs") for s in ("producer", "consumer")]
    return rows.select("job_id", "error_count", "warn_count", *logs, severity.alias("severity"))
