"""Topic mapping rules, and the records that follow them.

Rules are rows ``(job_id, rule_pos, source_pattern, target_pattern, enabled)``; a topic listing is a
distinct list of names. A resolved map has one row per job, topic and target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylens.functions.templates import is_pattern, java_pattern, java_replaced_pattern, java_replacement

# Parts that distinct topic names are dealt into for patterns that need no particular characters.
SHARES = 32


def _pattern_matches(topics: DataFrame, rules: DataFrame) -> DataFrame:
    """Enabled pattern rules with the listed topics they match (unanchored) and the target each yields.

    A pattern that needs three plain characters in a row, at any place, meets the topics that hold those, by an equi join on the three
    characters. A pattern without them meets all distinct names, which are dealt into ``SHARES`` shares that each such pattern joins.
    """
    patterns = rules.filter(F.col("enabled") & is_pattern(F.col("source_pattern"))).select(
        "job_id", "rule_pos", "source_pattern",
        java_pattern(F.col("source_pattern")).alias("pattern"),
        java_replacement(F.col("target_pattern")).alias("replacement"),
    )
    names = topics.select("topic").distinct()
    needed = required_gram(F.col("source_pattern"))
    every = F.transform(F.sequence(F.lit(0), F.lit(SHARES - 1)), lambda k: F.concat(F.lit("share "), k.cast("string")))
    keyed = patterns.withColumn("gram", F.explode(F.when(needed.isNotNull(), F.array(needed)).otherwise(every)))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("topic") - 2, F.lit(1))), lambda i: F.substring(F.col("topic"), i, F.lit(3))))
    share = F.concat(F.lit("share "), F.pmod(F.hash("topic"), F.lit(SHARES)).cast("string"))
    candidates = names.withColumn("gram", F.explode(F.concat(grams, F.array(share)))).join(keyed, "gram")
    return candidates.filter(F.expr("topic RLIKE pattern")).select(
        "job_id", "rule_pos", "source_pattern", "topic",
        F.regexp_replace(F.col("topic"), java_replaced_pattern(F.col("pattern")), F.col("replacement")).alias("target_topic"),
    )


def required_gram(pattern: Column) -> Column:
    """Three plain characters that stand in every match of a pattern, null where none are certain.

    Groups, classes, escapes and whatever a quantifier makes optional or repeats only part the runs of plain characters; patterns
    with alternatives outside groups, nested groups or flags have no certain characters.
    """
    outside = F.regexp_replace(pattern, r"\([^()]*\)[?*+]?", "\u0001")
    parted = F.regexp_replace(F.regexp_replace(outside, r"\\.", "\u0001"), r"\[[^\]]*\]", "\u0001")
    sure = F.regexp_replace(F.regexp_replace(parted, r".(\{[^}]*\}|[?*])", "\u0001"), r"[^A-Za-z0-9_-]", "\u0001")
    gram = F.regexp_extract(sure, r"[A-Za-z0-9_-]{3}", 0)
    unsure = F.contains(outside, F.lit("|")) | F.contains(outside, F.lit("(")) | F.contains(pattern, F.lit("(?")) | F.contains(pattern, F.lit("\\Q"))
    return F.when((gram != "") & ~unsure, gram)


def _exact_rules(rules: DataFrame) -> DataFrame:
    target = F.when(F.coalesce("target_pattern", F.lit("")) == "", F.col("source_pattern")).otherwise(F.col("target_pattern"))
    return rules.filter(F.col("enabled") & ~is_pattern(F.col("source_pattern"))).select(
        "job_id", "rule_pos", F.col("source_pattern").alias("topic"), target.alias("target_topic")
    )


def resolve_mappings(topics: DataFrame, rules: DataFrame) -> DataFrame:
    """All (job, topic, target) a job's enabled rules produce; ``rule_pos`` is the first rule that does."""
    matched = _pattern_matches(topics, rules).drop("source_pattern")
    return (
        _exact_rules(rules).unionByName(matched)
        .groupBy("job_id", "topic", "target_topic")
        .agg(F.min("rule_pos").alias("rule_pos"))
    )


def topic_map(resolved: DataFrame) -> DataFrame:
    """One target per (job, topic): that of the first rule."""
    first = F.min(F.struct("rule_pos", "target_topic"))
    return resolved.groupBy("job_id", "topic").agg(first.alias("m")).select(
        "job_id", "topic", F.col("m.target_topic").alias("target_topic")
    )


def unmatched_rules(topics: DataFrame, rules: DataFrame) -> DataFrame:
    """Enabled pattern rules that match no listed topic."""
    patterns = rules.filter(F.col("enabled") & is_pattern(F.col("source_pattern")))
    return patterns.join(_pattern_matches(topics, rules), ["job_id", "rule_pos"], "left_anti").select(
        "job_id", "rule_pos", "source_pattern"
    )


def mapping_conflicts(resolved: DataFrame) -> DataFrame:
    """Mappings that clash: a topic with several targets, a target with several sources, an empty target."""
    # a resolved map has each (job, topic, target) once, so rows count targets and sources
    counted = resolved.select(
        "job_id", "topic", "target_topic", F.count("target_topic").over(Window.partitionBy("job_id", "topic")).alias("targets"),
        F.count("topic").over(Window.partitionBy("job_id", "target_topic")).alias("sources"),
    )

    def kind(name: str, holds: Column, n: Column) -> Column:
        return F.when(holds, F.struct(F.lit(name).alias("conflict"), n.cast("long").alias("n")))

    found = F.array_compact(F.array(
        kind("multiple_targets", F.col("targets") > 1, F.col("targets")), kind("multiple_sources", F.col("sources") > 1, F.col("sources")),
        kind("empty_target", F.col("target_topic") == "", F.lit(1)),
    ))
    return counted.select("job_id", "topic", "target_topic", F.explode(found).alias("c")).select("job_id", "topic", "target_topic", "c.conflict", "c.n")


def require_clean(resolved: DataFrame) -> DataFrame:
    """``resolved`` itself, or a ValueError naming one clash."""
    clash = mapping_conflicts(resolved).orderBy("job_id", "conflict", "target_topic", "topic").limit(2).collect()
    if clash:
        listed = ", ".join(f"{c.topic} -> {c.target_topic}" for c in clash)
        raise ValueError(f"job {clash[0].job_id}: {clash[0].conflict}: {listed}")
    return resolved


def missing_source_topics(resolved: DataFrame, topics: DataFrame) -> DataFrame:
    """Mapped topics the source cluster does not list."""
    return resolved.join(topics.select("topic"), "topic", "left_anti").select("job_id", "topic", "target_topic")


def newly_discovered(topics: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """Listed topics that a pattern rule matches and the known map of the job lacks, with their targets."""
    return topic_map(_pattern_matches(topics, rules)).join(known, ["job_id", "topic"], "left_anti")


def active_mappings(jobs: DataFrame, rules: DataFrame) -> DataFrame:
    """Enabled rules of active jobs."""
    active = jobs.filter(F.col("status") == "active").select("job_id", "name")
    return active.join(rules.filter("enabled"), "job_id").select(
        "job_id", "name", "rule_pos", "source_pattern", "target_pattern"
    )


def kept_partition(partition: Column, target_partitions: Column) -> Column:
    """The source partition where the target has it, else null (the sink then picks by key)."""
    return F.when(partition < target_partitions, partition)


def route_keys(records: DataFrame) -> list[str]:
    return ["job_id", "topic"] if "job_id" in records.columns else ["topic"]


def mirror(
    records: DataFrame, mapping: DataFrame, target_partitions: DataFrame, *, preserve_partitions: bool = True, small_map: bool = False
) -> DataFrame:
    """Records under their target topics. Key, value and headers stay; unmapped records are left out.

    ``mapping`` is a :func:`topic_map`, ``target_partitions`` has ``(target_topic, partitions)``. Records with a
    ``job_id`` follow the rules of their job, others those of every job. The planner chooses how to join by the sizes it
    knows and finds; a caller that knows the map to be small says so with ``small_map``, and the records are not shuffled.
    """
    routes = mapping.join(target_partitions, "target_topic", "left")
    out = records.join(F.broadcast(routes) if small_map else routes, route_keys(records))
    partition = kept_partition(F.col("partition_id"), F.col("partitions")) if preserve_partitions else F.lit(None).cast("int")
    payload = [c for c in ("rec_key", "rec_value", "headers") if c in records.columns]
    return out.select(
        "job_id", F.col("target_topic").alias("topic"), partition.alias("partition_id"), *payload,
        F.col("topic").alias("source_topic"), F.col("partition_id").alias("source_partition"),
        F.col("rec_offset").alias("source_offset"),
    )


def rejected(records: DataFrame, mapping: DataFrame, *, small_map: bool = False) -> DataFrame:
    """Records without a mapping for their job and topic."""
    mapped = mapping.select(*route_keys(records)).distinct()
    return records.join(F.broadcast(mapped) if small_map else mapped, route_keys(records), "left_anti").select(*records.columns)


def size_tiers(records: DataFrame, *, large: int = 5120, medium: int = 2048, sample_every: int = 100) -> DataFrame:
    """Messages, bytes and sampled messages per topic and size tier (bytes of key and value; empty ones skipped)."""
    size = F.coalesce(F.octet_length("rec_key"), F.lit(0)) + F.coalesce(F.octet_length("rec_value"), F.lit(0))
    tier = F.when(F.col("bytes") > large, "large").when(F.col("bytes") > medium, "medium").otherwise("small")
    sized = records.select("topic", "rec_offset", size.cast("long").alias("bytes")).filter("bytes > 0")
    return sized.groupBy("topic", tier.alias("tier")).agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum("bytes").alias("bytes"),
        F.max("bytes").alias("largest"),
        F.count_if((F.col("bytes") > medium) | (F.col("rec_offset") % sample_every == 0)).alias("sampled"),
    )
