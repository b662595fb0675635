"""Every registered query against its reference SQL, at the smallest scale."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import ORDERED, TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
#: One query per module keeps the suite short; tools/check.py runs them all.
SAMPLE = (
    "top_candidates", "assemble_extraction", "representative_conditions", "phase_transitions", "metrics_by_subset",
    "repair_proposals", "policy_metrics", "carry_forward_decisions", "facet_counts", "contradiction_pairs", "scan_pubmed_xml",
    "top_domain_papers", "refresh_queue", "refresh_delivered", "refresh_checks", "evidence_batch_gates", "incremental_decisions",
    "regression_scenarios",
)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_reference_sql_has_a_query():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert len(queries) > 150


@pytest.mark.parametrize("key", SAMPLE)
def test_query_matches_reference_sql(spark, con, key):
    df = entry.queries()[key](spark, SF)
    got = rows_of(df.columns, df.collect(), key in ORDERED)
    cur = con.execute(entry.oracle_sql()[key])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall(), key in ORDERED)
