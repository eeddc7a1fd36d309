"""The registered queries against their SQL twins, and that each covers its whole table."""

import pytest

import __spark_entry__ as entry
from relaylens.llm import queries
from tests.compare import connect, differences
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLES[name]) == []


def test_all_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", ["op2_token_output", "op3_source_mix", "op5_token_counts", "op6_minhash_near_dedup", "op7_quality_rules", "op8_line_dedup", "op10_personal_data", "op11_substring_dedup", "op12_periodic_runs"])
def test_every_document_is_covered(spark, name):
    out = queries.QUERIES[name](spark, SMALL)
    ids = sorted(r.doc_id for r in out.select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect())


@pytest.mark.parametrize("name", ["op1_secret_scan", "op10_personal_data"])
def test_native_queries_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("EvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas"))
