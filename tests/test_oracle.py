"""Registered queries against their DuckDB text on the smallest data set.

The composed scan is shared between the queries here, except in the last test.
"""

import compare
import pytest

import __spark_entry__ as entry_point
from codestrata.plans import corpus, registry
from codestrata.plans.oracle_queries import oracle_texts

SF_DIR = "/root/testdata/sf0.001"
TEXTS = oracle_texts()
SCAN = registry._scan


@pytest.fixture(scope="module", autouse=True)
def shared_scan():
    original, known = registry._scan, {}

    def once(spark, sf_dir):
        if sf_dir not in known:
            known[sf_dir] = original(spark, sf_dir)
        return known[sf_dir]

    registry._scan = once
    yield
    registry._scan = original


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", list(TEXTS))
def test_equal_to_oracle(spark, con, name):
    assert compare.difference(registry.QUERIES[name](spark, SF_DIR), con, TEXTS[name]) == ""


@pytest.mark.parametrize("name", ["ranked_opportunities", "run_verdict"])
def test_equal_with_a_scan_of_its_own(spark, con, name, monkeypatch):
    monkeypatch.setattr(registry, "_scan", SCAN)
    assert compare.difference(registry.QUERIES[name](spark, SF_DIR), con, TEXTS[name]) == ""


def test_every_query_is_listed():
    assert set(registry.QUERIES) - set(TEXTS) == {"compact_payload"}
    assert set(registry.QUERIES) <= set(entry_point.queries())


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_every_document_is_a_file(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    listing = corpus.listing(spark, sf_dir).select("repo", "path")
    depth = listing.filter("path like '%/%'")
    assert depth.count() == depth.distinct().count() == documents
    assert listing.select("repo").distinct().count() == -(-documents // (corpus.KINDS * corpus.BLOCKS_PER_REPO))


def test_every_event_is_a_version(spark):
    assert registry.run_log(spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/events.parquet").count()
