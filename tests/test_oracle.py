"""Every registered query against its oracle on whole tables."""

import pytest

import __spark_entry__ as contract
import compare


@pytest.fixture(scope="module")
def connection(medium):
    with compare.oracle(medium) as open_connection:
        yield open_connection


def test_every_query_has_an_oracle():
    assert set(contract.reports()) <= contract.queries().keys()
    assert set(contract.reports()) <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", contract.reports())
def test_query_equals_oracle(spark, medium, connection, name):
    frame = contract.queries()[name](spark, medium)
    assert compare.differences(frame, connection, contract.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["industry", "postings", "avg_salary"]
    assert frame.count() == 12
