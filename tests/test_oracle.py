"""Every catalogue query with an SQL restatement equals DuckDB's result at sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def results(spark):
    return compare(spark, SF_SMALL, NAMES, verbose=False)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(results, name):
    status, detail = results[name]
    assert status == "OK", f"{name}: {status} {detail}"


def test_every_query_has_a_known_check():
    forest = [n for n in E.queries() if n.startswith("rf_") or n.startswith("stream_")]
    assert set(E.queries()) == set(NAMES) | set(forest) | set(E.LLM_QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["Elevation_Zone", "zone_name", "n_sites", "n_suitable", "suitable_share", "mean_elevation"]
    assert df.count() >= 1
