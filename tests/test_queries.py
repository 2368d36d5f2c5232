"""Registered queries against their SQL: all of them, or a core with GATEWISE_CORE_QUERIES=1."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.harness import DATA, compare, duck

SF = str(DATA / "sf0.001")
CORE = ("clean_shipped", "clean_documented", "checks_compare", "profile", "audit_dominant_user", "feat_all",
        "sample_events", "split_by_time", "rule_score", "fpr_budget", "replay", "ip_prior", "contract",
        "normalize_ssh", "stream_features")


def names():
    return CORE if os.environ.get("GATEWISE_CORE_QUERIES") else sorted(oracle_sql())


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, name):
    assert compare(queries()[name](spark, SF), duck(SF), oracle_sql()[name]) is None


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_entry(spark):
    assert entry(spark).count() == 1000
