import pytest
from pyspark.sql import functions as F

from relaylens.functions.templates import java_pattern, java_replacement
from relaylens.operators import mapping

RULE = "job_id string, rule_pos int, source_pattern string, target_pattern string, enabled boolean"


def resolve(spark, rules, topics):
    listing = spark.createDataFrame([(t,) for t in topics], "topic string")
    rule_rows = spark.createDataFrame([("j", i, s, t, on) for i, (s, t, on) in enumerate(rules, 1)], RULE)
    return mapping.resolve_mappings(listing, rule_rows), listing, rule_rows


def pairs(df):
    return {(r.topic, r.target_topic) for r in df.collect()}


def test_anchored_pattern(spark):
    got, _, _ = resolve(spark, [("orders", "orders_copy", True), ("events-1$", "events_copy", True)], ["orders", "events-1", "events-2"])
    assert pairs(got) == {("orders", "orders_copy"), ("events-1", "events_copy")}


def test_patterns_match_anywhere(spark):
    got, _, _ = resolve(spark, [("vents.1", "x", True)], ["my-events-12"])
    assert pairs(got) == {("my-events-12", "my-ex2")}


def test_blank_target_keeps_the_name(spark):
    got, _, _ = resolve(spark, [("orders", "", True), ("e.*", "", True)], ["orders", "ev"])
    assert pairs(got) == {("orders", "orders"), ("ev", "ev")}


def test_captures(spark):
    got, _, _ = resolve(spark, [("orders-(.*)", "backup-$1", True)], ["orders-1", "orders-2"])
    assert pairs(got) == {("orders-1", "backup-1"), ("orders-2", "backup-2")}


def test_disabled_and_unmatched_rules(spark):
    got, listing, rules = resolve(spark, [("a", "b", False), ("z.*", "y", True)], ["a"])
    assert pairs(got) == set()
    assert [r.source_pattern for r in mapping.unmatched_rules(listing, rules).collect()] == ["z.*"]


def test_collision_names_both(spark):
    got, _, _ = resolve(spark, [("events-.*", "events_copy", True)], ["events-1", "events-2"])
    with pytest.raises(ValueError, match="events-1.*events-2"):
        mapping.require_clean(got)


def test_exact_rules_collide_too(spark):
    got, _, _ = resolve(spark, [("a", "t", True), ("b", "t", True), ("a", "u", True)], [])
    kinds = {r.conflict for r in mapping.mapping_conflicts(got).collect()}
    assert kinds == {"multiple_targets", "multiple_sources"}


def test_clean_map_passes(spark):
    got, _, _ = resolve(spark, [("a", "t", True)], [])
    assert mapping.require_clean(got) is got


@pytest.mark.parametrize("topic,pattern,template,want", [
    ("a12", "a(1)(2)", "x-${1}0-$2", "x-10-2"), ("a1", "a(?P<n>1)", "x-$n-${n}", "x-1-1"), ("a1", "a(1)", "p$1x|", "p|"),
    ("a1", "a(1)", "cost$$", "cost$"), ("a1", "a(1)", "b\\d", "b\\d"), ("a1", "a(1)", "c$", "c$"),
])
def test_templates(spark, topic, pattern, template, want):
    df = spark.createDataFrame([(topic, pattern, template)], "topic string, p string, t string")
    df = df.select("topic", java_pattern(F.col("p")).alias("p"), java_replacement(F.col("t")).alias("t"))
    assert df.select(F.expr("regexp_replace(topic, p, t)")).first()[0] == want


def mirrored(spark, counts, partition=2):
    records = spark.createDataFrame([("j", "orders", partition, 7, "k", "v")], "job_id string, topic string, partition_id int, rec_offset long, rec_key string, rec_value string")
    routes = spark.createDataFrame([("j", "orders", "copy")], "job_id string, topic string, target_topic string")
    target = spark.createDataFrame(counts, "target_topic string, partitions int")
    return mapping.mirror(records, routes, target).first()


def test_partition_is_kept_where_it_exists(spark):
    assert mirrored(spark, [("copy", 3)]).partition_id == 2
    assert mirrored(spark, [("copy", 2)]).partition_id is None
    assert mirrored(spark, []).partition_id is None


def test_mirrored_and_rejected_are_all_records(spark, views):
    routes = mapping.topic_map(mapping.resolve_mappings(views.topic_listing, views.rules))
    targets = spark.createDataFrame([], "target_topic string, partitions int")
    assert mapping.mirror(views.records, routes, targets).count() + mapping.rejected(views.records, routes).count() == views.records.count()


def test_size_tiers(spark):
    sizes = [(0, 1), (100, 100), (2049, 3), (5121, 4), (5120, 5)]
    df = spark.createDataFrame([("t", off, "", "é" * (n // 2) + "x" * (n % 2)) for n, off in sizes], "topic string, rec_offset long, rec_key string, rec_value string")
    got = {r.tier: (r.messages, r.sampled) for r in mapping.size_tiers(df).collect()}
    assert got == {"small": (1, 1), "medium": (2, 2), "large": (1, 1)}


@pytest.mark.parametrize("pattern,gram", [
    (".*-click", "-cl"), ("^events-(a|b)x", "eve"), ("ab+cde", "cde"), ("abc?d", None), ("a(bcd)?efg", "efg"), ("(?i)events", None), ("abc|def", None), ("[abc]def", "def"),
    (r"\.abc", "abc"), ("abcd{2}", "abc"), ("ab{2,300}", None), (".*", None), ("", None), ("((a)b)cde", None), (r"\Qabc\E", None),
])
def test_required_gram(spark, pattern, gram):
    df = spark.createDataFrame([(pattern,)], "p string")
    assert df.select(mapping.required_gram(F.col("p"))).first()[0] == gram


def test_patterns_without_an_index_match_all_names(spark):
    topics = spark.range(500).selectExpr("concat('t', id) AS topic")
    rules = spark.createDataFrame([("j", 1, ".*7", "x", True), ("j", 2, ".*t4.+", "y", True)], "job_id string, rule_pos int, source_pattern string, target_pattern string, enabled boolean")
    got = mapping.resolve_mappings(topics, rules)
    want = {("x", f"t{k}") for k in range(500) if "7" in str(k)} | {("y", f"t{k}") for k in range(500) if str(k)[0] == "4" and k > 9}
    assert {(r.target_topic[0], r.topic) for r in got.collect()} == want
    assert "NestedLoopJoin" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("topic,pattern,target", [("ab", ".*", "-"), ("baaac", "a*", "-b-c-"), ("abc", "x*", "-a-b-c-"), ("", ".*", "-"), ("aab", "a*?", "-a-a-b-"), ("xax", "|x", "-x-a-x-")])
def test_empty_matches_behind_a_match_do_not_count(spark, topic, pattern, target):
    from relaylens.functions.templates import java_replaced_pattern

    df = spark.createDataFrame([(topic, pattern)], "t string, p string")
    assert df.select(F.regexp_replace(F.col("t"), java_replaced_pattern(F.col("p")), F.lit("-"))).first()[0] == target
