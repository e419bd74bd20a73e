"""Every registered query next to its SQL on the smallest tables, and plan checks."""

import os

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from locusmill.plans import bioviews as V
from locusmill.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Queries that SQL cannot follow at this size; their operators are compared with brute force,
#: and their steps, or short forms of them, are queries with SQL.
NO_SQL = {"homologs", "homolog_summary", "rbh", "homolog_promoters", "promoter_dedup", "em_motifs", "perm_pvalues"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_has_sql():
    assert set(registry.QUERIES) - set(entry.oracle_sql()) == NO_SQL


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    message, _, _, ok = compare(spark, con, SF, name, registry.QUERIES[name], entry.oracle_sql().get(name))
    assert ok, message


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_annotation_never_reads_sequences(spark):
    text = plan(registry.QUERIES["conserved_products"](spark, SF))
    assert "documents" not in text and "l_extendedprice" not in text
    assert "ArrowEvalPython" not in text and "MapInPandas" not in text


def test_filters_reach_the_scan(spark):
    df = V.table(spark, SF, "lineitem").where("l_suppkey = 3").select("l_orderkey")
    text = plan(df)
    assert "PushedFilters: [IsNotNull(l_suppkey), EqualTo(l_suppkey,3)]" in text and "l_tax" not in text


@pytest.mark.parametrize("name", ["proximity_clusters", "context_window", "motif_scan", "kmer_l2fc", "exact_match", "presence_matrix", "promoter_dedup"])
def test_no_cross_join(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_k_is_one_operator(spark):
    assert "TakeOrderedAndProject" in plan(registry.QUERIES["kmer_topn"](spark, SF))
