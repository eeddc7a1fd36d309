"""The named queries of this subpackage, each over its whole tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relaylens.llm import decontaminate, line_runs, lloyd, mixing, near_dup, periodic, personal, quality, secrets, substrings, token_counts, token_output, warc
from relaylens.llm.common import table

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_table(table(spark, sf_dir, "documents"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_table(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("spans")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_table(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.line_table(table(spark, sf_dir, "documents"), min_words=line_runs.MIN_WORDS)


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivative_table(table(spark, sf_dir, "pages"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_table(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_table(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_table(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster_table(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, QueryFn] = {f.__name__: f for f in (
    op1_secret_scan, op2_token_output, op3_source_mix, op4_benchmark_decontamination, op5_token_counts,
    op6_minhash_near_dedup, op7_quality_rules, op8_line_dedup, op9_warc_derivatives, op10_personal_data,
    op11_substring_dedup, op12_periodic_runs, op13_centroid_clustering,
)}

#: Words, windows and hits by joins on the windows' text. DuckDB's regular expressions take no range of bytes, so the
#: words are found by their complement in ASCII.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrases AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
            FROM b, LATERAL unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
places AS (SELECT doc_id, i, l AS n, array_to_string(w[i:i + l - 1], ' ') AS phrase
       FROM d, (SELECT DISTINCT n AS l FROM phrases) AS lengths, LATERAL unnest(range(1, len(w) - l + 2)) AS r(i)),
hits AS (SELECT a.doc_id, a.i, a.n, p.item_id FROM places AS a JOIN phrases AS p USING (n, phrase)),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, LATERAL unnest(range(n)) AS r(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _lloyd_sql(clusters: int = 8, rounds: int = 10) -> str:
    """Every round written out: distances to all centroids, the nearest of them, and floored means by component."""
    near = (
        "SELECT vec_id, n, v, (best % 1024)::INTEGER AS cluster, (best // 1024)::BIGINT AS distance FROM (SELECT vec_id, v.n, v.v,"
        " min(list_sum([(v.v[i] - c.c[i]) * (v.v[i] - c.c[i]) FOR i IN range(1, 65)])::HUGEINT * 1024 + c.cluster) AS best"
        " FROM v, c{0} AS c GROUP BY vec_id, v.n, v.v)"
    )
    means = (
        "SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{0} AS c LEFT JOIN (SELECT cluster, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY i) AS c"
        " FROM (SELECT cluster, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS k FROM a{0}, range(1, 65) AS r(i) GROUP BY cluster, i) GROUP BY cluster) AS m"
        " ON c.cluster = m.cluster"
    )
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS n, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, v"
        f" FROM v ORDER BY h, v LIMIT {clusters}))",
    ]
    for k in range(rounds):
        steps += [f"a{k} AS MATERIALIZED ({near.format(k)})", f"c{k + 1} AS MATERIALIZED ({means.format(k)})"]
    steps.append(f"a{rounds} AS MATERIALIZED ({near.format(rounds)})")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, a.cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,"
        f" (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} AS a JOIN c{rounds} AS c ON a.cluster = c.cluster"
    )


ORACLES: dict[str, str] = {
    "op1_secret_scan": secrets.duck_sql(), "op4_benchmark_decontamination": OP4_SQL, "op9_warc_derivatives": warc.duck_sql(),
    "op13_centroid_clustering": _lloyd_sql(),
}
